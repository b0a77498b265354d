"""The model's words follow the training vocabulary."""

import numpy as np


def vocabulary(n):
    from stratadoc.llm.lm_score import Vocabulary, form_of

    head = [(f"w{i}".encode(), 10 * n - 9 * i, form_of(f"w{i}".encode())) for i in range(n)]
    forms = {}
    for _, c, form in head:
        a, b = forms.get(form, (0, 0))
        forms[form] = (a + c, b + 1)
    return Vocabulary(head, forms, sum(c for _, c, _ in head), n)


def test_all_head_words_are_in_the_network():
    from stratadoc.llm.lm_score import Network

    v = vocabulary(5000)
    symbols, _, tail = v.encode([b"w0", b"w1024", b"w4999", b"unseen"])
    assert symbols[:3].tolist() == [0, 1024, 4999] and symbols[3] >= v.n_words == 5000 and tail == [b"unseen"]
    net = Network(v.n_words)
    assert net.word_classes * net.class_words >= 5000 and abs(net.word_classes - net.class_words) <= 1


def test_wide_network_starts_at_the_counts_and_adds_up_to_one():
    from stratadoc.llm.lm_score import Network

    v = vocabulary(40_000)  # more symbols than a short integer holds
    net = Network(v.n_words).start_from(v)
    every = np.arange(net.start)
    score, _ = net.outputs(np.zeros((net.start, 16), np.float32), every)
    assert abs(np.exp(score).sum() - 1) < 1e-4
    assert np.abs(score[: v.n_words] - np.log((v.counts + 0.5) / (v.n + v.n_words / 2 + 12))).max() < 1e-2


def test_training_reaches_words_beyond_the_first_1024():
    from stratadoc.llm.lm_score import Adam, Lanes, Network

    v = vocabulary(40_000)
    net = Network(v.n_words).start_from(v)
    docs = [np.array([39_000, 39_001] * 40, np.int32) for _ in range(8)]
    lanes = Lanes(docs, net.start)
    before = lanes.score(net, 8).sum()
    adam = Adam(net, 0.02)
    for _ in range(20):
        lanes.train(net, adam)
    assert lanes.score(net, 8).sum() > before / 2
