"""The language model: gradients, normalization, state across windows, exact counts, and gain over the base."""

import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def small_network(n_words=40, seed=1):
    from stratadoc.llm.lm_score import Network

    return Network(n_words, seed=seed)


def test_gradients():
    from stratadoc.llm.lm_score import Network

    net = small_network()
    net = Network(net.n_words, net.flat.astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, net.start + 1, (5, 3)), rng.integers(0, net.start, (5, 3))
    keep, h = np.ones((5, 3)), np.zeros((3, 16))
    keep[2, 1] = 0

    def loss():
        states, trace = net.steps(x, keep, h)
        return states, trace, -net.outputs(states.reshape(15, -1).astype(np.float64), y.ravel())[0].mean()

    states, trace, _ = loss()
    grads = net.zeros()
    _, back = net.outputs(states.reshape(15, -1).astype(np.float64), y.ravel(), grads)
    net.back(x, keep, trace, back.reshape(5, 3, -1), grads)
    for at in rng.choice(len(net.flat), 200, replace=False):
        old = net.flat[at]
        net.flat[at] = old + 1e-3
        up = loss()[2]
        net.flat[at] = old - 1e-3
        down = loss()[2]
        net.flat[at] = old
        assert abs((up - down) / 2e-3 - grads.flat[at]) < 2e-4


def test_probabilities_add_up_to_one():
    net = small_network(40)
    states = np.random.default_rng(1).normal(0, 1, (2, 16)).astype(np.float32)
    for s in states:
        every = np.arange(net.start)
        score, _ = net.outputs(np.repeat(s[None], net.start, 0), every)
        assert abs(np.exp(score).sum() - 1) < 1e-5


def test_state_is_carried_across_windows():
    from stratadoc.llm.lm_score import Lanes

    net = small_network()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, net.start, n).astype(np.int32) for n in (1, 100, 37, 5, 16, 17, 300)]
    got = Lanes(docs, net.start, 3).score(net, len(docs))
    for d, g in zip(docs, got):
        h, total, last = np.zeros((1, 16), np.float32), 0.0, net.start
        for s in d:
            states, _ = net.steps(np.array([[last]]), np.ones((1, 1), np.float32), h)
            h = states[-1]
            total += net.outputs(h, np.array([s]))[0][0]
            last = s
        assert abs(total - g) < 1e-3 * max(1, abs(total))


@pytest.fixture(scope="module")
def scored(spark):
    from stratadoc.llm.lm_score import score_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(None, "The the  THE\x0bthe\x1cx"), (9000, None), (9001, ""), (9002, "unseenword " * 9), (9003, "of the " * 40_000), (9002, "unseenword " * 9)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    return [(r.doc_id, r.text) for r in docs.collect()], score_documents(spark, docs.withColumn("score", docs.text).withColumn("n", docs.doc_id)).collect()


def test_base_is_exact(scored):
    texts, rows = scored
    tokens = {(i, t): [*(t or "").encode().lower().split(), b"\n"] for i, t in texts}
    counts = Counter(x for i, t in texts if fold(i) != 1 for x in tokens[i, t])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        own = tokens[i, t]
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        want[(i, fold(i) == 1, len(own), sum(counts[x] > 0 for x in own), n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want


def test_model_beats_the_base_on_held_out_texts(spark):
    from stratadoc.llm.lm_score import score_documents

    rows = score_documents(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in rows if r.held_out]
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1, gain


def test_without_training_rows(spark):
    from stratadoc.llm.lm_score import score_documents

    held = next(i for i in range(100) if fold(i) == 1)
    rows = score_documents(spark, spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in rows] == [(3, 0, 0, 0.0)] and rows[0].score < 0
    assert score_documents(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_window_takes_one_order_and_one_tanh_a_unit(monkeypatch):
    """What a window costs: gates by exponentials, rows sorted once for all outputs, with and without gradients."""
    from stratadoc.llm import lm_score as L

    met = {"tanh": 0, "argsort": 0}
    tanh, argsort = np.tanh, np.argsort

    def counted_tanh(values, *more, **named):
        met["tanh"] += np.size(values)
        return tanh(values, *more, **named)

    def counted_argsort(values, *more, **named):
        met["argsort"] += 1
        return argsort(values, *more, **named)

    monkeypatch.setattr(L.np, "tanh", counted_tanh)
    monkeypatch.setattr(L.np, "argsort", counted_argsort)
    net = small_network()
    x = np.random.default_rng(3).integers(0, net.start, (4, 6))
    states, _ = net.steps(x, np.ones((4, 6)), np.zeros((6, 16), np.float32))
    assert met == {"tanh": 4 * 6 * 16, "argsort": 0}
    for grads in (None, net.zeros()):
        met["argsort"] = 0
        net.outputs(states.reshape(24, 16), x.ravel(), grads)
        assert met["argsort"] == 1


def test_gates_far_out_and_blocks_of_few_rows(monkeypatch):
    """Sums beyond what an exponential holds close or open a gate; a node's rows in several blocks give the same gradients."""
    import warnings

    from stratadoc.llm import lm_score as L

    net, rng = small_network(), np.random.default_rng(4)
    net.views["x"][3, :16], net.views["x"][3, 16:32] = 1e4, -1e4
    net.views["x"][5, :16], net.views["x"][5, 16:32] = -1e4, 1e4
    h = rng.normal(0, 1, (1, 16)).astype(np.float32)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        new = net.steps(np.array([[3]]), np.ones((1, 1)), h)[0][0]
        kept = net.steps(np.array([[5]]), np.ones((1, 1)), h)[0][0]
    assert np.abs(new - np.tanh(net.views["x"][3, 32:] + h @ net.views["u"][:, 32:] + net.views["b"][32:])).max() < 1e-5
    assert np.abs(kept - h).max() < 1e-6

    states, y, made = rng.normal(0, 1, (300, 16)).astype(np.float32), rng.integers(0, net.start, 300), []
    for floats in (1 << 18, 100, 1):
        monkeypatch.setattr(L, "BLOCK_FLOATS", floats)
        grads = net.zeros()
        score, back = net.outputs(states, y, grads)
        made.append((score, back, grads.flat))
    for other in made[1:]:
        assert all(np.abs(a - b).max() < 1e-5 for a, b in zip(made[0], other, strict=True))
