"""Leaks against an exhaustive edit search, and the recall of the LSH step alone."""

import random
from collections import Counter

import numpy as np

SMALL = "/root/testdata/sf0.001"


def fit(pattern, text):
    """least edit distance of the pattern to any stretch of the text, by plain dynamic programming"""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i = rng.randrange(len(words))
        what = rng.randrange(3)
        if what == 0:
            words[i] = f"sub{rng.randrange(99)}"
        elif what == 1 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"ins{rng.randrange(99)}")
    return words


def test_least_edits():
    from stratadoc.llm.decontaminate import least_edits

    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        assert least_edits(p, t)[0] == fit(p, t)


def test_recall_of_walks():
    from stratadoc.llm.decontaminate import LeakFinder, edits_allowed, words_of

    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((6, 12, 30, 60))))) for i in range(200)]
    finder = LeakFinder(items)
    hit = 0
    for i, text in items:
        w = words_of(text)
        doc = [f"x{rng.randrange(99)}" for _ in range(50)]
        at = rng.randrange(50)
        doc[at:at] = edited(rng, w, edits_allowed(len(w)))
        hit += any(f[1] == i for f in finder.find([" ".join(doc)]))
    assert hit >= 0.95 * len(items)


def test_against_exhaustive_search(spark):
    from stratadoc.llm.decontaminate import find_leaks, words_of

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    texts = [r.text for r in bench.collect()]
    odd_items = [(900, None), (901, ""), (902, "three short words"), (903, "one two three four five"), (904, texts[0]), (None, "null id item of seven words here")]
    odd_docs = [(7000, None), (7001, ""), (None, "x " + texts[1].upper().replace(" ", "!! ")), (7002, texts[0]), (7002, texts[0]), (7003, "one two three four five"), (7004, "one two THREE; x four five"), (7005, "null id item of seven words here"), (7006, "the " * 30_000 + texts[2])]
    odd_docs += [(7100 + i, "pre fix " * 20 + " ".join(edited(rng, t.split(), max(1, len(t.split()) // 8))) + " post fix" * 20) for i, t in enumerate(texts)]
    bench = bench.union(spark.createDataFrame(odd_items, bench.schema))
    docs = docs.union(spark.createDataFrame(odd_docs, docs.schema))
    got = Counter((r.doc_id, r.item_id, r.edits) for r in find_leaks(spark, docs, bench).collect())
    items = [(r.item_id, words_of(r.text or "")) for r in bench.collect()]
    grams = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for _, w in items]
    want = Counter()
    for r in docs.collect():
        w = words_of(r.text or "")
        if len(w) > 20_000:
            w = w[-300:]
        own = {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
        for (item, p), g in zip(items, grams):
            if len(p) >= 5 and len(g & own) >= len(g) * 0.2 and (d := fit(p, w)) <= int(0.2 * len(p) + 1e-9):
                want[r.doc_id, item, d] += 1
    missed = want - got
    assert not got - want and sum(missed.values()) <= 0.02 * sum(want.values()), missed
    assert {(7002, 904, 0), (7003, 903, 0), (7004, 903, 1), (7005, None, 0), (7006, texts.index(texts[2]), 0)} <= set(got)
    empty = spark.createDataFrame([], docs.schema)
    assert find_leaks(spark, empty, bench).count() == 0 and find_leaks(spark, docs, spark.createDataFrame([], bench.schema)).count() == 0


def test_blocks_and_dropping(spark):
    from stratadoc.llm.decontaminate import drop_leaked, find_leaks

    bench = spark.createDataFrame([(i, " ".join(f"a{i}b{k}" for k in range(8))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"a{i}b{k}" for k in range(8)), "q") for i in range(20, 40)], "doc_id long, text string, item_id string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(spark, docs, bench, 7).collect()} == {(i, i) for i in range(20, 30)}
    left = drop_leaked(docs, bench, 7)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == list(range(30, 40))


def test_windows_on_sparse_gaps():
    from stratadoc.llm.decontaminate import LeakFinder

    f = LeakFinder([(1, "a b c d e f g h")])
    assert np.array_equal(f.windows(np.zeros(3, np.int64))[0], [])
    assert [x[:2] for x in f.find(["a b c d e f g h", "", "zz", "b c d e f g h"])] == [(0, 1), (3, 1)]
