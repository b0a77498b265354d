"""Held-out accuracy and the defined cases of the quality classifier."""

import zlib

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from stratadoc.llm.quality import score_quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in score_quality(spark, docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good = [x.score for x, q in held if q == 1]
    bad = [x.score for x, q in held if q == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    right = sum(x.predicted == q for x, q in held) / len(held)
    assert auc > 0.97 and right > 0.95, (auc, right, len(held))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from stratadoc.llm.quality import score_quality

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end quality", "toxic")
    score = lambda x: {r.doc_id: r.score for r in score_quality(spark, docs.repartition(3), x).collect()}
    assert score(labels) == score(flipped)


def test_odd_rows(spark):
    from stratadoc.llm.quality import keep_good, score_quality

    docs = spark.createDataFrame([(i, "good words in order here " * (i + 1) if i % 2 else "BAD!! " * 40, "c") for i in range(40)] + [(None, None, "c"), (50, "", None), (51, "x" * 100_000, "c"), (51, "x" * 100_000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    rows = score_quality(spark, docs, labels).collect()
    assert len(rows) == 44 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 40)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if (r.doc_id or 99) < 40} == set(range(1, 40, 2))
    one_class = score_quality(spark, docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1
    assert score_quality(spark, docs.limit(0), labels.limit(0)).count() == 0
