"""Long and hostile texts in bounded time; columns with names of any kind; cases that were cut before."""

import random
import time

import numpy as np
import pytest

ODD = ["_blob", "_new", "_starts", "a.b", "blob", "starts", "ends", "kinds", "c1", "fp", "root", "n", "Doc Id"]


def with_odd_columns(spark, rows):
    names = ["doc_id", "text", *ODD, "m"]
    data = [(*r, *(f"{k}-{r[0]}" for k in ODD), {"k": str(r[0])}) for r in rows]
    kinds = ["bigint", "string", *["string"] * len(ODD), "map<string,string>"]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def test_stages_return_extra_columns_unchanged(spark):
    import corpus_pipeline as P

    good = "it was of the kind that one would find in a quiet house near an old river with some trees {} and no other"
    rows = [(i, good.format(f"a{i} b{i * 7} c{i * 13}") + (" token=abcdefgh1234" if i % 3 == 0 else "")) for i in range(12)] + [(3, good.format("other words under one id"))]
    df = with_odd_columns(spark, rows)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns, name
        for r in out.collect():
            for k in ODD:
                assert r[k] == f"{k}-{r['doc_id']}", (name, k)
            assert r["m"] == {"k": str(r["doc_id"])}
    redacted = {r["doc_id"]: r["text"] for r in P.secrets(spark, df, "").collect() if r["doc_id"] != 3}
    assert all(("[secret]" in t) == (i % 3 == 0) and "abcdefgh1234" not in t for i, t in redacted.items())


def test_group_keeps_its_own_row_of_a_repeated_id(spark):
    import corpus_pipeline as P

    a, b = "one two three four five six seven eight nine ten " * 6, "totally different words are written in this text here now " * 6
    df = spark.createDataFrame([(3, b), (5, a), (5, b), (9, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in P.one_of_each_group(spark, df, "").collect())
    assert got == [(3, b), (5, a)]


def test_column_names_match_in_any_case(spark):
    from stratadoc.llm.secret_scan import redact

    df = spark.createDataFrame([(1, "token=abcdefgh1")], "Doc_ID long, Text string")
    out = redact(spark, df)
    assert out.columns == ["Doc_ID", "Text"] and out.first().Text == "[secret]"


@pytest.mark.parametrize("text", ["eyJ" * 1_700_000, "eyJabcdefgh." * 400_000, "the " * 1_300_000, "AKIA" * 1_200_000, "token=" * 800_000, "a" * 5_000_000, "-" * 5_000_000])
def test_secrets_of_five_megabytes(text):
    from stratadoc.llm.secret_scan import find_spans

    began = time.process_time()
    find_spans(text)
    assert time.process_time() - began < 8


def test_added_rules():
    from stratadoc.llm.secret_scan import find_spans

    token = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    cases = {
        f"x {token} y": ("web_token", 2, 2 + len(token)),
        f"glued{token}": ("web_token", 5, 5 + len(token)),
        "g ghp_" + "a1" * 18: ("service_token", 2, 42),
        "s xoxb-123456789012-abc": ("service_token", 2, 23),
        "s sk_live_" + "a" * 20: ("service_token", 2, 30),
        "u postgres://me:pass@host/x": ("url_login", 2, 21),
    }
    for text, span in cases.items():
        assert span in find_spans(text), text
    assert not [s for s in find_spans("eyJabc.def.ghi eyJ https://host/path@x") if s[0] in ("web_token", "url_login")]


def test_ledger_keeps_versions_and_survives_two_writers(spark, tmp_path):
    from stratadoc.llm.secret_scan import BlobLedger, find_spans

    folder = f"file://{tmp_path}/ledger"
    versions = [[(1, "token=abcdefgh"), (2, "plain")], [(1, "token=changed1"), (2, "plain")], [(1, "token=abcdefgh"), (3, "password: hunter2222")]]
    frames = [spark.createDataFrame(v, "doc_id long, text string") for v in versions]
    counts = []
    for df in frames:
        ledger = BlobLedger(spark, folder)
        ledger.scan(df)
        counts.append(spark.read.parquet(folder).count())
    assert counts == [2, 3, 4]  # only texts that were never seen are scanned
    history = frames[0].union(frames[1]).union(frames[2])
    found = {(r.doc_id, tuple(r.kinds)) for r in BlobLedger(spark, folder).findings(history).collect()}
    assert found == {(i, tuple(s[0] for s in find_spans(t))) for v in versions for i, t in v}
    spark.read.parquet(folder).write.mode("append").parquet(folder)  # as if another run had scanned the same blobs
    assert BlobLedger(spark, folder).findings(history).count() == 6


def test_one_huge_turn_and_many_words(spark):
    from stratadoc.llm.chat_format import conversation_digests

    text = "<|é" * 1_500_000
    df = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", text, "y"), (2, 0, "assistant", "z" * 5000, "z")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in conversation_digests(spark, df).collect()}
    assert got[1].loss_chars == len(text) and got[2].loss_chars == 5000 and got[-1].n_turns == 2


def test_short_items_and_unspaced_scripts():
    from stratadoc.llm.decontaminate import LeakFinder, words_of

    assert words_of("日本語 text ไท") == ["日", "本", "語", "text", "ไ", "ท"]
    items = [(1, "solo"), (2, "two words"), (3, "one two three four"), (4, "これは長い文章です漢字かな"), (5, ""), (6, "!!")]
    found = lambda t: sorted(f[1] for f in LeakFinder(items).find([t]))
    assert found("x solo y") == [1] and found("two x words") == [] and found("a two words b one two three four c") == [2, 3]
    assert found("前置これは長い文章です漢字かな後") == [4] and found("これは長い文章でした漢字かな") == [4] and found("") == []


@pytest.mark.parametrize("n", [5, 6, 8, 12, 20, 40, 80])
def test_recall_at_the_most_edits_by_length(n):
    from stratadoc.llm.decontaminate import LeakFinder, edits_allowed
    from test_decontaminate import edited

    rng = random.Random(n)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(n))) for i in range(120)]
    finder = LeakFinder(items)
    docs = [" ".join([*(f"x{k}" for k in range(20)), *edited(rng, t.split(), edits_allowed(n)), *(f"y{k}" for k in range(20))]) for _, t in items]
    found = {(place, item) for place, item, *_ in finder.find(docs)}
    assert sum((k, k) in found for k in range(len(items))) >= 0.9 * len(items)


def test_exhaustive_search_of_small_texts():
    """Every stretch of every text against every item by plain dynamic programming, without any filter before it."""
    from stratadoc.llm.decontaminate import LeakFinder, edits_allowed, words_of
    from test_decontaminate import edited, fit

    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice((2, 4, 5, 7, 11, 18))))) for i in range(60)]
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [" ".join([*(f"w{rng.randrange(40)}" for _ in range(30)), *edited(rng, t.split(), rng.randrange(edits_allowed(len(t.split())) + 1))]) for _, t in items]
    got = {(k, i, e) for k, i, e, *_ in LeakFinder(items).find(texts)}
    want = {(k, i, d) for k, t in enumerate(texts) for i, p in items if (d := fit(words_of(p), words_of(t))) <= edits_allowed(len(words_of(p)))}
    assert not got - want and len(got) >= 0.95 * len(want), (len(got), len(want))


def test_frequent_words_take_bounded_windows():
    from stratadoc.llm.decontaminate import LeakFinder

    items = [(i, f"the the the the the the w{i} the the the") for i in range(200)]
    finder = LeakFinder(items)
    w = np.full(2000, finder.vocabulary["the"])
    sizes = [len(i) for i, _ in finder.window_parts(w, 10_000)]
    assert max(sizes) <= 10_000 and sum(sizes) >= 100_000


def test_item_blocks_are_bounded_however_often_a_text_repeats(spark):
    from stratadoc.llm.decontaminate import find_leaks, item_blocks

    items = spark.createDataFrame([(i % 500, "one two three four five six seven") for i in range(1500)], "item_id long, text string")
    sizes = [len(b) for b in item_blocks(items, 100)]
    assert sum(sizes) == 500 and max(sizes) < 200
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight")], "doc_id long, text string")
    assert find_leaks(spark, docs, items, 100).count() == 500


def test_hot_buckets_are_refined_to_the_end(spark):
    """Fingerprints that share 40 bits: all links are found, and no bucket is left that the values of the last bits would not bound."""
    from stratadoc.llm.simhash_dedup import STEPS, block_keys, components_of
    from test_media_and_simhash import brute_components

    assert [sum(s) for s in STEPS] == [64, 48, 36, 27, 20] and 64 - sum(s[0] for s in STEPS) == 15
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(0xABCD_EF01_2300_0000) | rng.integers(0, 1 << 24, 600, np.uint64))
    near = fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    brute = brute_components([int(x) for x in fps])
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(brute[int(f)], i)
    got = {r.fp: r.component_id for r in components_of(spark, df, 10).collect()}
    assert got == {int(s): first[brute[int(f)]] for s, f in zip(fps.view(np.int64), fps)}
    hot = []
    for _ in range(4):
        keys, _ = block_keys(fps, hot, True)
        values, n = np.unique(keys, return_counts=True)
        hot.append(values[n > 10])
    keys, out = block_keys(fps, hot)
    buckets = {}
    for k, f in zip(keys.tolist(), out.tolist()):
        buckets.setdefault(k, []).append(f)
    pairs = {(a, b) for fs in buckets.values() for a in fs for b in fs if a < b and (a ^ b).bit_count() <= 3}
    assert pairs == {(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 3}


def test_classifier_scores_equal_a_plain_forward_pass(spark):
    import pickle

    from stratadoc.llm.quality import FORM_DIMS, NONZERO, WORD_DIMS, fit_model, index_vector, score_quality, shape

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, "Word, " * 200 + "x" * 3000), (9003, "a1 B2 " * 45)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    model = pickle.loads(fit_model(docs, labels))
    scores = {r.doc_id: r.score for r in score_quality(spark, docs, labels).collect()}
    assert NONZERO == np.count_nonzero(index_vector("shape:a", FORM_DIMS))
    for r in docs.collect()[::9] + odd.collect():
        tokens = (r.text or "").split()
        x = np.zeros(WORD_DIMS + FORM_DIMS)
        for t in tokens:
            row = model.words.get(t.lower(), 0)
            x[:WORD_DIMS] += model.vectors[row - 1] if row else 0
            x[WORD_DIMS:] += index_vector("shape:" + shape(t), FORM_DIMS)
        for k in range(1, 9):
            x[WORD_DIMS:] += sum(a == b for a, b in zip(tokens, tokens[k:])) * index_vector(f"=prev{k}", FORM_DIMS)
        for at in range(0, len(tokens), 64):
            some = tokens[at : at + 64]
            x[WORD_DIMS:] += len(some) * index_vector(f"distinct{len(set(some)) * 10 // len(some)}", FORM_DIMS)
        x /= max(1, len(tokens))
        n = model.network
        a, b, c, d = n.w
        logit = np.tanh((x - n.mean) / n.scale @ a + b) @ c + d[0]
        assert abs(1 / (1 + np.exp(-logit / n.temperature)) - scores[r.doc_id]) < 1e-3, r.doc_id


def test_warc_record_ids_are_unique_and_files_are_read_once(spark):
    from stratadoc.llm.shared import filesystem
    from stratadoc.llm.warc import archive_pages, page_digests, records_in

    big = "".join(chr(33 + i * i % 90) for i in range(100_000))
    rows = [(1, "u", "same", "x"), (1, "u", "same", "y"), (2, "u", big, "x"), (2, "u", big, "y"), (3, None, "same", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    ids = []
    for r in archive_pages(spark, df).collect():
        system, name = filesystem(r.path)
        with system.open_input_stream(name, compression=None) as stream:
            ids += [f["warc-record-id"] for f, _ in records_in(stream)]
    assert len(ids) == len(set(ids)) > 5
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in page_digests(spark, df).collect()) == [(1, "response", None), (1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 1)]


def test_extra_columns_with_clashing_names(spark):
    from stratadoc.llm.decontaminate import find_leaks
    from stratadoc.llm.media_jpeg import media_digests
    from stratadoc.llm.simhash_dedup import near_duplicates

    docs = spark.createDataFrame([(1, "one two three four five six", "f", 1, "m"), (2, None, "f", 1, "m")], "doc_id long, text string, fp string, component_id int, media string")
    assert sorted(r.doc_id for r in media_digests(docs).collect()) == [1, 2]
    assert sorted(r.component_id for r in near_duplicates(spark, docs).collect()) == [1, 2]
    items = spark.createDataFrame([(7, "one two three four five six", "e")], "item_id long, text string, edits string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(spark, docs, items).collect()] == [(1, 7)]
