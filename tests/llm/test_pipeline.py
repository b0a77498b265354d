"""The pipeline against brute-force versions of its stages, and its odd rows."""

from collections import defaultdict

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_agree_with_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from stratadoc.llm.decontaminate import edits_allowed, words_of
    from test_decontaminate import fit
    from test_media_and_simhash import brute_components, brute_print
    from test_plain_contracts import BASE, ids_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    good = {r.doc_id: r for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(q == 1 and i not in good for i, q in labels.items()) <= 0.02 * len(labels)
    kept.write.parquet(f"file://{tmp_path}/1")
    two = P.one_of_each_group(spark, spark.read.parquet(f"file://{tmp_path}/1"), SF)
    assert two.columns == docs.columns
    prints = {i: brute_print(r.text) for i, r in good.items()}
    groups = brute_components(list(prints.values()))
    first = defaultdict(list)
    for i, f in prints.items():
        first[groups[f]].append(i)
    want = {min(m) for m in first.values()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(want)
    three = P.decontaminate(spark, two, SF)
    leaked = set()
    for i in want:
        w = words_of(good[i].text)
        own = {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
        for p in bench:
            grams = {tuple(p[k : k + 2]) for k in range(len(p) - 1)}
            if len(grams & own) >= 0.2 * len(grams) and fit(p, w) <= edits_allowed(len(p)):
                leaked.add(i)
    left = want - leaked
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(left)
    four = P.secrets(spark, three, SF)
    rows = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and set(rows) == left
    for i, r in rows.items():
        assert not any(ok(m) for _, p, ok in BASE for m in p.finditer(r.text)) or "[secret]" in r.text
        assert r.n_chars == (len(r.text) if r.text != good[i].text else good[i].n_chars)
    got = P.run(spark, SF)
    tokens = dict(zip(rows, ids_of([r.text for r in rows.values()])))
    sizes = defaultdict(int)
    for r in got.collect():
        sizes[r.doc_id] += r.length
        assert r.doc_tokens == len(tokens[r.doc_id]) + 1
    assert sizes == {i: len(t) + 1 for i, t in tokens.items()}


def test_odd_rows_pass_through(spark, tmp_path):
    import corpus_pipeline as P

    good = "it was of the kind that one would find in a quiet house near an old river with some trees {} and no other"
    rows = [(i, good.format(f"a{i} b{i * 7} c{i * 13} d{i * 3}") * 3, "en", None, None) for i in range(30)]
    rows += [(None, "rows without an id stay in place here", None, "s", 5), (None, None, "en", "s", None), (70, None, None, None, None), (71, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1), (5, "another text under the same id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{name}")
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert out.where("doc_id = 5").count() == 1 and out.where("doc_id is null").count() == 2
        if name in ("decontamination", "secrets"):
            assert out.count() == docs.count()
