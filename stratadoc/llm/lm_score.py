"""A gated recurrent language model over words, and complete-document log-likelihoods.

Counts. Every training token is counted (per task first, then by word). Words that hold at least 1 / 2^18 of all
training tokens are the head: by their share there are at most 2^18 of them, so they may be sent to every task. All
other words are the tail, and their counts are joined by word.

Model. A GRU reads words; its output is factored by class. All words of the head are in word classes, by frequency,
about as many classes as words in each, with a softmax within each; every other word is in a class of form (its last sign,
its length, whether it is ASCII), within which its probability is its smoothed count. P(word) = P(class | state)
P(word | class, state), which adds up to one over known words and one unknown word per class of form. The class is itself
chosen in two steps, a group of classes and the class within it. Biases start from the counts, so that rare words start as
what they were counted as.

Training. One task starts the model from at most `WARM_ROWS` documents (those with the smallest hash of doc_id);
then every task trains a copy on all training documents it reads, by backpropagation truncated to windows of
`WINDOW` steps, with the state carried from window to window through each whole document; the copies are averaged by
their numbers of tokens, in groups, so the driver receives a bounded number of them.

Scoring. Documents run side by side in lanes; the state is carried across windows until a document ends, so every
token is scored given the whole text before it.

Cases: a null or empty text is its end token. Equal rows stay rows. A null doc_id hashes as the empty text. With no
training token, base_score is 0 for any text. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm.shared import hash_fold, shared_folder, slices_by_bytes

END = b"\n"  # no word holds white space
HEAD_PARTS = 1 << 18
LEAST_CLASS_WORDS, HIDDEN = 32, 16
FORMS = 24
WINDOW, LANES = 32, 512
#: Tokens of whole documents that are trained on or scored side by side: many, so that lanes are of nearly equal length.
BUFFER_TOKENS = 4_000_000
#: Scoring gathers the states of so many tokens before it looks at their outputs.
SCORED_TOKENS = 1 << 15
#: Parts of the work that stay within a core's cache: logits, and weights in an update.
BLOCK_FLOATS, ADAM_FLOATS = 1 << 18, 1 << 14
#: Input symbols met so often in a window are rare.
RARE = 8
SLICE_BYTES, COUNT_ROWS = 4 << 20, 1 << 20
WARM_ROWS, WARM_ROUNDS = 1500, 2
WARM_RATE, RATE = 0.02, 0.012
GROUP, PART_FLOATS = 64, 1 << 16
WEIGHT_SCHEMA = "task long, part int, n long, weights binary"
COUNT_SCHEMA = "token binary, form int, n long"
PART_SCHEMA = "row long, doc_id long, token binary, at array<int>, n array<int>, n_tokens long, n_known long, head_sum double, rest double"
PART_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def tokens_of(text: str) -> list[bytes]:
    """Words in ASCII lower case, between ASCII white space, and the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


#: Class of a word's last byte: a letter or digit, a full stop, a comma, another sign.
LAST = [0 if chr(b).isalnum() or b >= 128 else 1 if b == 46 else 2 if b == 44 else 3 for b in range(256)]


def form_of(token: bytes) -> int:
    n = len(token)
    return LAST[token[-1]] * 6 + (4 if n > 11 else 2 if n > 6 else 0) + (not token.isascii())


# --- the network ---------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights as one flat float32 vector with named views. Input symbols: words, then forms, then the start.

    The last row of an output's weights is its bias: states are given with a one after them. Classes are chosen in two
    steps, a group of about sqrt(classes) of them and the class within it.
    """

    def __init__(self, n_words: int, flat: np.ndarray | None = None, seed: int = 11):
        self.n_words = n_words
        self.class_words = max(LEAST_CLASS_WORDS, int(np.ceil(np.sqrt(n_words))))
        self.word_classes = -(-n_words // self.class_words)
        self.n_classes = self.word_classes + FORMS
        self.group_classes = int(np.ceil(np.sqrt(self.n_classes)))
        self.n_groups = -(-self.n_classes // self.group_classes)
        self.start = n_words + FORMS
        h = HIDDEN
        shapes = {"x": (self.start + 1, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "g": (1, h + 1, self.n_groups), "c": (self.n_groups, h + 1, self.group_classes), "w": (self.word_classes, h + 1, self.class_words)}
        total = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.15, total).astype(np.float32)
        self.flat, self.views, at = flat, {}, 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            self.views[name] = flat[at : at + n].reshape(s)
            at += n
        self.n_inputs = (self.start + 1) * 3 * h
        # places of the last node that nothing has
        self.spare = {"g": 0, "c": self.n_groups * self.group_classes - self.n_classes, "w": self.word_classes * self.class_words - n_words}

    def zeros(self) -> Network:
        return Network(self.n_words, np.zeros_like(self.flat))

    def start_from(self, vocabulary: Vocabulary) -> Network:
        """Sets the biases to the logarithms of the counts of groups, of classes within them and of words within those."""

        def nodes(counts: np.ndarray, width: int) -> np.ndarray:
            padded = np.zeros(-(-len(counts) // width) * width)
            padded[: len(counts)] = counts
            return padded.reshape(-1, width)

        def biases(counts: np.ndarray) -> np.ndarray:
            most = counts.max(1, keepdims=True, initial=0)
            return np.where(counts > 0, np.log(np.where(counts > 0, counts, 1) / np.where(most > 0, most, 1)), 0)

        words = nodes(vocabulary.counts[: self.n_words] + 0.5, self.class_words)
        classes = nodes(np.concatenate([words.sum(1), 10.0**vocabulary.form_log]), self.group_classes)
        for name, counts in (("w", words), ("c", classes), ("g", classes.sum(1)[None])):
            self.views[name][:, -1] = biases(counts)
        return self

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.n_words, symbols // self.class_words, self.word_classes + symbols - self.n_words)

    def steps(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step of symbols x (steps, lanes) from state h, and what the way back needs. Each gate's values of a
        step are consecutive, and so are those of the gates r and z, whose sigmoids are taken together."""
        v, n = self.views, HIDDEN
        kind = np.result_type(v["x"], h)
        gates = v["x"].reshape(-1, n).take(3 * x[:, None].astype(np.intp) + np.arange(3)[:, None], 0).astype(kind, copy=False)
        to = self.by_gate().astype(kind)
        by = np.repeat(v["b"].reshape(3, 1, n), x.shape[1], 1).astype(kind)
        to[:2] *= -1  # r and z are 1 / (1 + exp(-sum))
        np.subtract(-by[:2], gates[:, :2], out=gates[:, :2])
        fresh = [np.flatnonzero(row) for row in keep == 0]
        shape = (*x.shape, n)
        states, before, inner = np.empty(shape, kind), np.empty(shape, kind), np.empty(shape, kind)
        work = np.empty((3, *shape[1:]), kind)
        with np.errstate(over="ignore"):  # 1 / inf is 0
            for t in range(len(x)):
                before[t] = h
                if len(fresh[t]):
                    before[t, fresh[t]] = 0
                h, both, value = before[t], gates[t, :2], gates[t, 2]
                np.matmul(h, to, out=work)
                both += work[:2]
                np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                np.add(work[2], by[2], out=inner[t])
                np.multiply(both[0], inner[t], out=work[0])
                value += work[0]
                np.tanh(value, out=value)
                np.subtract(h, value, out=states[t])
                states[t] *= both[1]
                states[t] += value
                h = states[t]
        return states, (before, gates, inner, fresh)

    def by_gate(self) -> np.ndarray:
        """A copy of the recurrent weights, (gate, from, to)."""
        return np.array(np.moveaxis(self.views["u"].reshape(HIDDEN, 3, HIDDEN), 1, 0), order="C")

    def choose(self, name: str, states: np.ndarray, node: np.ndarray, place: np.ndarray, grads: Network | None, share: float, scored: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log probability of each place of its node, by a softmax over the node's places; states end in ones.

        With grads, `share` times the gradients of the negated sum take the place of what the nodes met had there, and those of
        the states, without their ones, are returned; with scored=False the probabilities are left out.
        Rows must be sorted by node, so that a node's rows are one product; a block of rows stays within the cache.
        """
        weights, m = self.views[name], len(node)
        n_nodes, inner, width = weights.shape
        back = None if grads is None else np.empty((m, inner - 1), states.dtype)
        score = np.empty(m) if scored else None
        cuts = np.searchsorted(node, np.arange(n_nodes + 1)).tolist()
        parts = [(k, i, min(i + self.block(width), b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for i in range(a, b, self.block(width))]
        ones, e_all = np.ones(width, states.dtype), np.empty((self.block(width), width), states.dtype)
        at = 0
        while at < len(parts):
            to, start = at + 1, parts[at][1]
            while to < len(parts) and parts[to][2] - start <= len(e_all):
                to += 1
            own, end = parts[at:to], parts[to - 1][2]
            at, e = to, e_all[: end - start]

            def logits(own=own, start=start, e=e) -> None:
                for k, i, j in own:
                    np.matmul(states[i:j], weights[k], out=e[i - start : j - start])
                if self.spare[name] and own[-1][0] == n_nodes - 1:
                    last = next(i for k, i, _ in own if k == n_nodes - 1)
                    e[last - start :, width - self.spare[name] :] = -np.inf

            logits()
            values, places = e.reshape(-1), np.arange(0, e.size, width) + place[start:end]
            picked = values[places] if scored else None
            with np.errstate(over="ignore"):
                np.exp(e, out=e)
                total = e @ ones
            if not (total.min() > 1e-25 and total.max() < 1e25):  # far out logits: relative to each row's largest
                logits()
                most = e.max(1)
                e -= most[:, None]
                picked = picked - most if scored else None
                np.exp(e, out=e)
                total = e @ ones
            if scored:
                score[start:end] = picked - np.log(total)
            if grads is None:
                continue
            # each row of e by share / total is what it adds to the gradients
            values[places] -= total
            factor = share / total
            scaled = states[start:end, :-1]
            if width < inner:
                e *= factor[:, None]
                of_bias = np.ones_like(factor)
            else:
                scaled, of_bias = scaled * factor[:, None], factor
            for k, i, j in own:
                rows, own_e, own_grads = slice(i - start, j - start), e[i - start : j - start], grads.views[name][k]
                if i == cuts[k]:
                    np.matmul(scaled[rows].T, own_e, out=own_grads[:-1])
                    np.matmul(of_bias[rows], own_e, out=own_grads[-1])
                else:
                    own_grads[:-1] += scaled[rows].T @ own_e
                    own_grads[-1] += of_bias[rows] @ own_e
                np.matmul(own_e, weights[k, :-1].T, out=back[i:j])
            if width >= inner:
                back[start:end] *= factor[:, None]
        return score, back

    @staticmethod
    def block(width: int) -> int:
        return max(1, BLOCK_FLOATS // width)

    def outputs(self, states: np.ndarray, y: np.ndarray, grads: Network | None = None, least: int = 1, scored: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log probability of each symbol given its state; and, with grads, the states' gradients of the mean loss,
        where fewer than `least` symbols count as so many. scored=False leaves out the former."""
        share, classes = states.dtype.type(1 / max(least, len(y), 1)), self.class_of(y)
        # sorted by class, rows are sorted by group too, and those of words come before those of forms
        order = np.argsort(classes.astype(np.int16 if self.n_classes < 1 << 15 else np.int32), kind="stable")
        classes, words = classes[order], y[order]
        ordered = np.empty((len(states), states.shape[1] + 1), states.dtype)
        ordered[:, :-1], ordered[:, -1] = states.take(order, 0), 1
        group, n = classes // self.group_classes, int(np.searchsorted(classes, self.word_classes))
        found, back = self.choose("g", ordered, np.zeros_like(group), group, grads, share, scored)
        more, inner = self.choose("c", ordered, group, classes - group * self.group_classes, grads, share, scored)
        word_found, word_back = self.choose("w", ordered[:n], classes[:n], words[:n] - classes[:n] * self.class_words, grads, share, scored)
        score = None
        if scored:
            found += more
            found[:n] += word_found
            score = np.empty_like(found)
            score[order] = found
        if grads is None:
            return score, None
        back += inner
        back[:n] += word_back
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return score, back.take(place, 0)

    def back(self, x: np.ndarray, keep: np.ndarray, trace: tuple, back: np.ndarray, grads: Network, scattered: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Adds the gradients of one window; nothing flows to the window before. Returns the input symbols met and their
        gradients, which are added only if `scattered`."""
        n, lanes = HIDDEN, x.shape[1]
        before, gates, recurrent, fresh = trace
        r, z, new = gates[:, 0], gates[:, 1], gates[:, 2]
        rest = 1 - z
        by_z = before - new
        by_z *= z
        by_z *= rest
        rest *= 1 - new * new  # by the new value
        by_r = 1 - r
        by_r *= r
        by_r *= recurrent
        # gradients, step by step, of the new value's sum, of the gates' sums and of the recurrent part of the new value
        to = np.empty((len(x), 4, lanes, n), z.dtype)
        weights = np.ascontiguousarray(self.by_gate().transpose(0, 2, 1))
        carried, d, work = np.zeros_like(back[0]), np.empty_like(back[0]), np.empty((3, lanes, n), back.dtype)
        for t in range(len(x) - 1, -1, -1):
            to_new, to_r, to_z, to_inner = to[t]
            np.add(back[t], carried, out=d)
            np.multiply(d, rest[t], out=to_new)
            np.multiply(d, by_z[t], out=to_z)
            np.multiply(to_new, by_r[t], out=to_r)
            np.multiply(to_new, r[t], out=to_inner)
            np.multiply(d, z[t], out=carried)
            np.matmul(to[t, 1:], weights, out=work)
            for part in work:
                carried += part
            if len(fresh[t]):
                carried[fresh[t]] = 0
        of_weights = np.matmul(before.transpose(0, 2, 1)[:, None], to[:, 1:]).sum(0)
        grads.views["u"] += np.moveaxis(of_weights, 0, 1).reshape(n, 3 * n)
        grads.views["b"] += np.matmul(np.ones(lanes, back.dtype), to[:, 1:]).sum(0).ravel()
        # where r, z and the new value of each place are
        at = (4 * lanes * np.arange(len(x))[:, None] + np.arange(lanes)).reshape(-1, 1) + lanes * np.array([1, 2, 0])
        rows, of_rows = summed_by(x.ravel(), to.reshape(-1, n), at)
        if scattered:
            grads.views["x"][rows] += of_rows
        return rows, of_rows


def summed_by(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their values): a key's values are the rows at[key's place] of `values`, side by side. Most keys
    are rare: their values are added place by place, for all keys at once, and only those of frequent keys key by key."""
    order = np.argsort(keys.astype(np.uint16 if keys.max(initial=0) < 1 << 16 else np.int32), kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    counts = np.diff(cuts, append=len(order))
    ordered = values.take(at.take(order, 0), 0).reshape(len(order), -1)
    sums = ordered.take(cuts, 0)
    for place in range(1, RARE):
        more = np.flatnonzero((counts > place) & (counts <= RARE))
        if not len(more):
            break
        sums[more] += ordered.take(cuts[more] + place, 0)
    ones = np.ones(counts.max(initial=0), values.dtype)
    for k in np.flatnonzero(counts > RARE).tolist():
        np.matmul(ones[: counts[k]], ordered[cuts[k] : cuts[k] + counts[k]], out=sums[k])
    return keys[order[cuts]], sums


class Adam:
    """Input rows are updated, and their moments decay, only in windows that hold them; all else in every window."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.step = network, rate, 0
        self.first, self.second = np.zeros_like(network.flat), np.zeros_like(network.flat)

    def moved(self, grad: np.ndarray, first: np.ndarray, second: np.ndarray, work: np.ndarray) -> np.ndarray:
        """The step of these weights, in `work`; the moments, as sums without their factors 0.1 and 0.002, are updated in place."""
        scale = np.sqrt(0.002 / (1 - 0.998**self.step))
        first *= np.float32(0.9)
        first += grad
        second *= np.float32(0.998)
        np.multiply(grad, grad, out=work)
        second += work
        np.sqrt(second, out=work)
        work += np.float32(1e-6 / scale)
        np.divide(first, work, out=work)
        work *= np.float32(0.1 * self.rate / (1 - 0.9**self.step) / scale)
        return work

    def update(self, grads: Network, rows: np.ndarray, of_rows: np.ndarray) -> None:
        """rows and of_rows: the input symbols met and their gradients; all other gradients are in grads and become zero."""
        self.step += 1
        n, net = self.network.n_inputs, self.network
        rest = grads.flat[n:]
        norm = float(np.sqrt(np.vdot(of_rows, of_rows) + rest @ rest))
        if norm > 1:
            of_rows *= np.float32(1 / norm)
            rest *= np.float32(1 / norm)
        shape = net.views["x"].shape
        first, second = self.first[:n].reshape(shape), self.second[:n].reshape(shape)
        first_rows, second_rows = first.take(rows, 0), second.take(rows, 0)
        net.views["x"][rows] = net.views["x"].take(rows, 0) - self.moved(of_rows, first_rows, second_rows, np.empty_like(of_rows))
        first[rows], second[rows] = first_rows, second_rows
        work = np.empty(ADAM_FLOATS, net.flat.dtype)
        for at in range(n, len(net.flat), ADAM_FLOATS):  # a part stays within the cache
            to = min(at + ADAM_FLOATS, len(net.flat))
            net.flat[at:to] -= self.moved(grads.flat[at:to], self.first[at:to], self.second[at:to], work[: to - at])
        rest.fill(0)


class Lanes:
    """Documents side by side: each lane holds some, one after another; longer lanes come first."""

    def __init__(self, docs: list[np.ndarray], start: int, most: int = LANES):
        n = max(1, min(most, len(docs)))
        heap = [(0, k) for k in range(n)]
        members: list[list[int]] = [[] for _ in range(n)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            load, k = heapq.heappop(heap)
            members[k].append(i)
            heapq.heappush(heap, (load + len(docs[i]), k))
        loads = np.array([sum(len(docs[i]) for i in m) for m in members])
        order = np.argsort(-loads, kind="stable")
        self.load = loads[order]
        ordered = [i for k in order for i in members[k]]
        self.y = np.concatenate([docs[i] for i in ordered]) if ordered else np.empty(0, np.int32)
        self.doc = np.repeat(np.array(ordered, np.int32), [len(docs[i]) for i in ordered])
        self.fresh = np.diff(self.doc, prepend=-1) != 0
        self.x = np.empty(len(self.y), np.int32)
        self.x[1:] = self.y[:-1]
        self.x[self.fresh] = start
        self.begin = np.cumsum(self.load) - self.load

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(live lanes, places (steps, lanes), which of these are within the lane)."""
        for t in range(0, int(self.load[0]) if len(self.load) else 0, WINDOW):
            live = int(np.searchsorted(-self.load, -t, side="left"))
            steps = min(WINDOW, int(self.load[0]) - t)
            at = t + np.arange(steps)[:, None]
            inside = at < self.load[:live]
            yield live, np.where(inside, self.begin[:live] + at, self.begin[:live]), inside

    def train(self, network: Network, adam: Adam) -> None:
        h, grads = np.zeros((len(self.load), HIDDEN), np.float32), network.zeros()
        least = WINDOW * len(self.load) // 2  # the last lanes of a buffer must not weigh more than whole windows
        for live, at, inside in self.windows():
            x, keep = self.x.take(at), ~self.fresh.take(at)
            states, trace = network.steps(x, keep, h[:live])
            h[:live] = states[-1]
            y, flat = self.y.take(at).ravel(), states.reshape(-1, HIDDEN)
            if inside.all():
                _, back = network.outputs(flat, y, grads, least, scored=False)
            else:
                where, back = np.flatnonzero(inside), np.zeros_like(flat)
                _, back[where] = network.outputs(flat.take(where, 0), y[where], grads, least, scored=False)
            adam.update(grads, *network.back(x, keep, trace, back.reshape(states.shape), grads, scattered=False))

    def score(self, network: Network, n_docs: int) -> np.ndarray:
        """Natural log probability of each document's symbols."""
        h, out, held = np.zeros((len(self.load), HIDDEN), np.float32), np.zeros(n_docs), []

        def add() -> None:
            places = np.concatenate([p for p, _ in held])
            score, _ = network.outputs(np.concatenate([s for _, s in held]), self.y[places])
            np.add(out, np.bincount(self.doc[places], weights=score, minlength=n_docs), out=out)
            held.clear()

        for live, at, inside in self.windows():
            states, _ = network.steps(self.x.take(at), ~self.fresh.take(at), h[:live])
            h[:live] = states[-1]
            at, states = at.ravel(), states.reshape(-1, HIDDEN)
            if not inside.all():
                where = np.flatnonzero(inside)
                at, states = at[where], states.take(where, 0)
            held.append((at, states))
            if sum(len(p) for p, _ in held) >= SCORED_TOKENS:
                add()
        if held:
            add()
        return out


# --- vocabulary and tasks ------------------------------------------------------------------------------


class Vocabulary:
    """The head words with their counts, the words of the model, and the sums of each form's tail."""

    def __init__(self, head: list[tuple[bytes, int, int]], forms: dict[int, tuple[int, int]], n: int, v: int):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.n_words = len(head)
        self.counts = np.array([c for _, c, _ in head], np.float64)
        self.place = {token: i for i, (token, _, _) in enumerate(head)}
        self.words = pa.array([token for token, _, _ in head], pa.large_binary())
        # one more entry, for words that are not in the head
        self.symbols = np.array([i if i < self.n_words else self.n_words + form for i, (_, _, form) in enumerate(head)] + [0], np.int32)
        self.logs = np.array([np.log10(c + 0.5) for _, c, _ in head] + [0.0])
        self.n, self.v = n, v
        sums = {k: list(forms.get(k, (0, 0))) for k in range(FORMS)}
        for _, c, form in head[: self.n_words]:
            sums[form][0] -= c
            sums[form][1] -= 1
        self.form_log = np.array([np.log10(sums[k][0] + 0.5 * (sums[k][1] + 1)) for k in range(FORMS)])

    def of_words(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places in the head or -1) of the distinct words."""
        places = pc.index_in(tokens.words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int32)
        return np.where(places < 0, tokens.forms().astype(np.int32) + self.n_words, self.symbols[places]).astype(np.int32), places

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(symbols, places in the head or -1, the words that are not in the head)."""
        places = np.fromiter(map(self.place.get, tokens, repeat(-1)), np.int32, len(tokens))
        symbols, out = self.symbols[places], np.flatnonzero(places < 0)
        tail = [tokens[i] for i in out.tolist()]
        symbols[out] = np.fromiter(map(form_of, tail), np.int32, len(tail)) + self.n_words
        return symbols, places, tail


class Tokens:
    """The tokens of some texts: distinct words, their codes in order (one code more is the end), and each text's cuts."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
        coded = split.values.dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int32), len(texts)
        named = pc.binary_length(coded.dictionary).to_numpy() > 0  # blanks at a text's borders leave empty pieces
        real = named[codes] if len(codes) else np.empty(0, bool)
        text = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))[real]
        self.words = coded.dictionary.cast(pa.large_binary())
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n) + 1)])
        self.codes = np.full(self.cuts[-1], len(self.words), np.int32)
        self.codes[np.arange(len(text)) + text] = codes[real]
        # the end as a word of its own
        self.words = pa.concat_arrays([self.words, pa.array([END], pa.large_binary())])

    def forms(self) -> np.ndarray:
        """form_of of each distinct word."""
        offsets, data = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1], np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        lengths, wide = np.diff(offsets), np.concatenate([[0], np.cumsum(data >= 128)])
        last = np.array(LAST)[data[np.maximum(offsets[1:] - 1, 0)]]
        return last * 6 + np.where(lengths > 11, 4, np.where(lengths > 6, 2, 0)) + (wide[offsets[1:]] > wide[offsets[:-1]])


def token_slices(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(place of the first text, tokens of some texts); a null text is empty."""
    for start, end in slices_by_bytes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
        # taken, not sliced: kernels misread the cast of a slice, whose first offset is not zero
        yield start, Tokens(texts.take(pa.array(np.arange(start, end))))


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # words, forms, numbers

    def summed() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded = pa.concat_arrays([w for w, _, _ in held]).dictionary_encode()
        codes, forms = coded.indices.to_numpy(), np.empty(len(coded.dictionary), np.int32)
        forms[codes] = np.concatenate([f for _, f, _ in held])
        numbers = np.bincount(codes, weights=np.concatenate([n for _, _, n in held]), minlength=len(forms))
        return coded.dictionary, forms, numbers.astype(np.int64)

    def rows(words: pa.Array, forms: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(np.arange(len(words))[part])).cast(pa.binary()), pa.array(forms[part], pa.int32()), pa.array(numbers[part], pa.int64())], names=["token", "form", "n"])

    for batch in batches:
        for _, tokens in token_slices(batch.column(0)):
            n = np.bincount(tokens.codes, minlength=len(tokens.words))
            met = np.flatnonzero(n)
            held.append((tokens.words.take(pa.array(met)), tokens.forms()[met], n[met]))
            if sum(len(w) for w, _, _ in held) > COUNT_ROWS:
                held[:] = [summed()]
                if 4 * len(held[0][0]) > 3 * COUNT_ROWS:
                    yield from rows(*held.pop())
    if held:
        yield from rows(*summed())


def training_buffers(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[list[np.ndarray]]:
    """The symbols of whole documents, about BUFFER_TOKENS at a time."""
    docs, held = [], 0
    for batch in batches:
        for _, tokens in token_slices(batch.column(1)):
            symbols = vocabulary.of_words(tokens)[0][tokens.codes]
            docs += np.split(symbols, tokens.cuts[1:-1])
            held += len(symbols)
            if held >= BUFFER_TOKENS:
                yield docs
                docs, held = [], 0
    if docs:
        yield docs


def train_tasks(vocabulary: Vocabulary, flat: np.ndarray | None, rounds: int, rate: float):
    """A task's copy of the model, trained on all texts that it reads: (task, tokens, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network = Network(vocabulary.n_words).start_from(vocabulary) if flat is None else Network(vocabulary.n_words, flat.copy())
        adam, seen = Adam(network, rate), 0
        for docs in training_buffers(batches, vocabulary):
            lanes = Lanes(docs, network.start)
            for _ in range(rounds):
                lanes.train(network, adam)
            seen += len(lanes.y)
        if seen or flat is None:
            for part, at in enumerate(range(0, len(network.flat), PART_FLOATS)):
                yield weight_row(TaskContext.get().partitionId(), part, seen, network.flat[at : at + PART_FLOATS])

    return run


def weight_row(task: int, part: int, n: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["task", "part", "n", "weights"])


def averaged(copies: DataFrame) -> DataFrame:
    """One copy for each group of GROUP tasks: their mean, weighted by tokens, part by part, so that no task holds whole copies."""

    def mean(key, table):
        total, mix = 0, None
        for n, raw in zip(table.column("n").to_pylist(), table.column("weights"), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
            total, mix = total + n, part if mix is None else mix + part
        return pa.Table.from_batches([weight_row(key[0].as_py(), key[1].as_py(), total, mix / max(total, 1))])

    return copies.withColumn("task", F.expr(f"task div {GROUP}")).groupBy("task", "part").applyInArrow(mean, WEIGHT_SCHEMA)


def joined_weights(rows: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(rows, key=lambda r: r.part)])


def train(spark: SparkSession, training: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The model's weights after the warm start and one pass of all tasks over all training(doc_id, text)."""
    ids = training.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_ROWS).distinct()
    # of rows with one doc_id only the smallest text, so that the task's rows are bounded
    warm = training.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions("doc_id")
    rows = warm.mapInArrow(train_tasks(vocabulary, None, WARM_ROUNDS, WARM_RATE), WEIGHT_SCHEMA).collect()
    flat = joined_weights(rows) if rows else Network(vocabulary.n_words).start_from(vocabulary).flat
    copies = averaged(training.select("doc_id", "text").mapInArrow(train_tasks(vocabulary, flat, 1, RATE), WEIGHT_SCHEMA))
    folder, level = shared_folder(spark, "lm-weights"), 0
    while True:  # until one copy is left
        copies.write.parquet(f"{folder}/{level}")
        copies, level = spark.read.schema(WEIGHT_SCHEMA).parquet(f"{folder}/{level}"), level + 1
        if copies.where("task > 0").isEmpty():
            break
        copies = averaged(copies)
    rows = copies.collect()
    return joined_weights(rows) if sum(r.n for r in rows) else flat


class Tails:
    """The words outside the head of the documents that are held: (words, document, code, times) of some texts at a time."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, tokens: Tokens, places: np.ndarray, first: int) -> None:
        tail = np.flatnonzero(places[tokens.codes] < 0)
        of = np.searchsorted(tokens.cuts, tail, side="right") - 1
        pairs, times = np.unique(of * np.int64(len(places)) + tokens.codes[tail], return_counts=True)
        used, code = np.unique(pairs % len(places), return_inverse=True)
        self.parts.append((tokens.words.take(pa.array(used)), (first + pairs // len(places)).astype(np.int32), code, times.astype(np.int32)))

    def rows(self, row: int) -> Iterator[pa.RecordBatch]:
        """One row per word, with the documents that hold it, counted from `row`, and how often each does."""
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        begin = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        codes = coded.indices.to_numpy()
        code = np.concatenate([codes[b + p[2]] for b, p in zip(begin, self.parts, strict=False)])
        order = np.argsort(code, kind="stable")
        at, times = (np.concatenate([p[k] for p in self.parts])[order] for k in (1, 3))
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
        for start in range(0, len(ends), 20_000):
            stop = min(start + 20_000, len(ends))
            low = int(ends[start - 1]) if start else 0
            offsets = pa.array(np.concatenate([[0], ends[start:stop] - low]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[low : ends[stop - 1]], pa.int32())) for v in (at, times)]
            yield parts_batch(np.full(stop - start, row), None, coded.dictionary.take(pa.array(np.arange(start, stop))), *lists, None, None, None, None)
        self.parts.clear()


def score_parts(vocabulary: Vocabulary, flat: np.ndarray):
    """Rows of PART_SCHEMA: one per document (token null), and one per distinct word outside the head of documents that are
    scored together, with the places and numbers of it in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network, row, words = Network(vocabulary.n_words, flat.copy()), TaskContext.get().partitionId() << 33, vocabulary.n_words
        docs: list[np.ndarray] = []
        columns: list[list] = [[] for _ in range(5)]
        tails, n_held = Tails(), 0

        def scored() -> Iterator[pa.RecordBatch]:
            yield from tails.rows(row)
            logs = Lanes(docs, network.start).score(network, len(docs)) / np.log(10)
            ids, n, known, head_sum, rest = columns
            yield parts_batch(np.arange(row, row + len(docs)), ids, None, None, None, n, known, head_sum, np.array(rest) + logs)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, tokens in token_slices(batch.column(1)):
                symbols, places = vocabulary.of_words(tokens)
                codes, starts, n = tokens.codes, tokens.cuts[:-1], len(tokens.cuts) - 1
                logs = vocabulary.logs[places]  # zero outside the head
                # words in the classes of form take their smoothed counts within the class
                formed = symbols >= words
                rest = np.where(formed, logs - vocabulary.form_log[np.where(formed, symbols - words, 0)], 0.0)
                sums = (np.add.reduceat(values[codes], starts).tolist() for values in ((places >= 0).astype(np.int64), logs, rest))
                for column, values in zip(columns, (ids[first : first + n], np.diff(tokens.cuts).tolist(), *sums), strict=True):
                    column.extend(values)
                tails.add(tokens, places, len(docs))
                docs += np.split(symbols[codes], tokens.cuts[1:-1])
                n_held += len(codes)
                if n_held >= BUFFER_TOKENS:
                    yield from scored()
                    row += len(docs)
                    docs, columns, n_held = [], [[] for _ in range(5)], 0
        if docs:
            yield from scored()

    return run


def parts_batch(*columns) -> pa.RecordBatch:
    n = len(columns[0])
    made = [pa.nulls(n, k) if c is None else c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, PART_KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in PART_SCHEMA.split(", ")])


def score_documents(spark: SparkSession, docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """The contract's rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    training = rows.where(hash_fold("doc_id") != held_out_fold)
    folder = shared_folder(spark, "lm")
    partial = training.select("text").mapInArrow(count_tokens, COUNT_SCHEMA)
    partial.groupBy("token").agg(F.first("form").alias("form"), F.sum("n").alias("c")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("token binary, form int, c long").parquet(f"{folder}/counts")
    forms = {r.form: (r.n, r.v) for r in counts.groupBy("form").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n, v = sum(x[0] for x in forms.values()), sum(x[1] for x in forms.values())
    least = max(1, -(-n // HEAD_PARTS))  # at most HEAD_PARTS words hold so many tokens each
    head = [(bytes(r.token), r.c, r.form) for r in counts.where(F.col("c") >= least).toLocalIterator()]
    vocabulary = Vocabulary(head, forms, n, v)
    flat = train(spark, training, vocabulary)
    parts = rows.mapInArrow(score_parts(vocabulary, flat), PART_SCHEMA)
    # a document's own row goes along under a key of its own: no word holds a line end
    parts = parts.withColumn("token", F.coalesce("token", F.concat(F.lit(END + END), F.col("row").cast("string").cast("binary"))))
    tail = counts.where(F.col("c") < least).select("token", "c").hint("shuffle_hash")
    c = F.coalesce("c", F.lit(0))
    # a document's row stays one; a word's row becomes one for each document that holds it
    each = F.explode_outer(F.arrays_zip("at", "n")).alias("in_doc")
    own = ("doc_id", "n_tokens", "n_known", "head_sum", "rest")
    joined = parts.join(tail, "token", "left").select("row", *own, F.log10(c + 0.5).alias("log"), (c > 0).alias("is_known"), each)
    joined = joined.select((F.col("row") + F.coalesce("in_doc.at", F.lit(0))).alias("row"), *own, "log", "is_known", F.col("in_doc.n").alias("n"))
    sums = (F.sum(F.col("n") * F.col("log")).alias("tail_sum"), F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("tail_known"))
    whole = joined.groupBy("row").agg(*(F.max(k).alias(k) for k in own), *sums)
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    base = F.col("head_sum") + tail_sum - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return whole.select(
        "doc_id",
        (hash_fold("doc_id") == held_out_fold).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("rest") + tail_sum).alias("score"),
    )


