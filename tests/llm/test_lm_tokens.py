"""Tokens found in Arrow equal those of plain Python, slice by slice; a text's score equals a plain forward pass."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SIGNS = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "The", "the", "É", "été", "w.", "x,", "longer-than-eleven", "中文", "İ"]


def texts(n, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [None, "", *made, "z" * 5000, "same same", "same same"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_give_the_tokens_of_each_text(monkeypatch, kind):
    from stratadoc.llm import lm_score as L

    monkeypatch.setattr(L, "SLICE_BYTES", 700)
    rows = texts(300)
    seen = 0
    for first, tokens in L.token_slices(pa.array(rows, kind)):
        words, forms = tokens.words.to_pylist(), tokens.forms()
        assert first == seen
        for k in range(len(tokens.cuts) - 1):
            codes = tokens.codes[tokens.cuts[k] : tokens.cuts[k + 1]]
            want = L.tokens_of(rows[first + k] or "")
            assert [words[c] for c in codes] == want and [int(forms[c]) for c in codes] == [L.form_of(w) for w in want]
        seen += len(tokens.cuts) - 1
    assert seen == len(rows)


def test_counts_over_slices_and_flushes(monkeypatch):
    from stratadoc.llm import lm_score as L

    monkeypatch.setattr(L, "SLICE_BYTES", 500)
    monkeypatch.setattr(L, "COUNT_ROWS", 40)
    rows = texts(300)
    got = Counter()
    for batch in L.count_tokens(iter([pa.RecordBatch.from_arrays([pa.array(part)], names=["text"]) for part in (rows[:100], rows[100:])])):
        for r in batch.to_pylist():
            assert r["form"] == L.form_of(r["token"])
            got[r["token"]] += r["n"]
    assert got == Counter(w for t in rows for w in L.tokens_of(t or ""))


def plain_score(net, vocabulary, text):
    """log10 probability of a text by one step after another, in plain loops and double precision."""
    from stratadoc.llm import lm_score as L

    v = {k: a.astype(np.float64) for k, a in net.views.items()}
    n = L.HIDDEN
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    h, last, total = np.zeros(n), net.start, 0.0
    for token in L.tokens_of(text):
        place = vocabulary.place.get(token)
        symbol = net.n_words + L.form_of(token) if place is None else place
        g = h @ v["u"] + v["b"]
        x = v["x"][last]
        r, z = 1 / (1 + np.exp(-x[:n] - g[:n])), 1 / (1 + np.exp(-x[n : 2 * n] - g[n : 2 * n]))
        new = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * new + z * h
        s = np.append(h, 1.0)
        c = symbol // net.class_words if symbol < net.n_words else net.word_classes + symbol - net.n_words
        group, within = divmod(c, net.group_classes)
        width = net.group_classes - (net.spare["c"] if group == net.n_groups - 1 else 0)
        total += soft(s @ v["g"][0])[group] + soft((s @ v["c"][group])[:width])[within]
        if symbol < net.n_words:
            width = net.class_words - (net.spare["w"] if c == net.word_classes - 1 else 0)
            total += soft((s @ v["w"][c])[:width])[symbol - c * net.class_words]
        else:
            form = symbol - net.n_words
            total += np.log(vocabulary.tail[token] + 0.5) - vocabulary.form_log[form] * np.log(10)
        last = symbol
    return total / np.log(10)


def test_score_is_that_of_a_plain_forward_pass(spark, monkeypatch):
    """The query's score column against the plain pass, with the weights and counts that the query itself made."""
    from stratadoc.llm import lm_score as L

    made = {}
    train, start = L.train, L.Vocabulary

    def kept(spark, training, vocabulary):
        made["flat"] = train(spark, training, vocabulary)
        made["vocabulary"] = vocabulary
        return made["flat"]

    monkeypatch.setattr(L, "train", kept)
    monkeypatch.setattr(L, "HEAD_PARTS", 3000)  # so that some words are in the tail
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9000, None), (9001, "never seen words here"), (9002, "of the " * 3000)], docs.schema))
    rows = L.score_documents(spark, docs).collect()
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    vocabulary = made["vocabulary"]
    assert isinstance(vocabulary, start) and 100 < vocabulary.n_words < 3000
    counts = Counter(w for i, t in by_id.items() if not next(r for r in rows if r.doc_id == i).held_out for w in L.tokens_of(t))
    vocabulary.tail = counts
    net = L.Network(vocabulary.n_words, made["flat"])
    tails = 0
    for r in sorted(rows, key=lambda r: r.doc_id)[::12] + [r for r in rows if r.doc_id >= 9000]:
        want = plain_score(net, vocabulary, by_id[r.doc_id])
        assert abs(want - r.score) < 1e-4 * max(1, abs(want)), r.doc_id
        tails += sum(w not in vocabulary.place for w in L.tokens_of(by_id[r.doc_id]))
    assert tails > 100
