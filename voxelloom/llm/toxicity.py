"""Operator 3 - toxicity by a bidirectional gated recurrent network.

Each word (a run of letters and digits) enters as a hashed word embedding plus
embeddings of the characters it begins with.  A bidirectional GRU reads windows
of words, attention pools its states and a logistic unit scores the window; the
network is trained in numpy by back-propagation through time on windows chosen
anew from all windows of each labelled document as the network improves.  A
document's score is the highest of all its overlapping windows, which cover the
whole text; every run of up to WINDOW - STRIDE + 1 words lies whole in one.

Defined results
    * null or empty text: one window of padding is scored.
    * no labelled rows: 0.5 for all; one label only: that label's share,
      kept off 0 and 1.
    * repeated rows are scored alike; other columns never matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import samples, textkit

FOLDS, HELD = 3, 1
#: Labelled documents of each label that the network is fitted on, and bytes of
#: their texts, at most; a text that would go beyond is left out whole.
SAMPLE_PER_LABEL = 1500
SAMPLE_BYTES = 12 << 20
THRESHOLD = 0.7

WINDOW, STRIDE = 48, 24
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 13
#: Bytes of the beginnings of words whose hashes are character inputs.
PREFIXES = (3, 5, 7)
EMBED, HIDDEN, ATTEND = 12, 8, 8
INPUTS = WORD_BUCKETS + 3 * CHAR_BUCKETS
BATCH, EPOCHS, RATE = 64, 6, 6e-3
#: Small samples are passed over until the network has had this many updates.
MIN_UPDATES = 500
WARM_UPDATES = 90
#: Documents that shrink a word's log-odds by half, share of it that its
#: embedding starts from, and documents that must show an input.
SHRINK, START, MIN_DOCS = 4, 0.3, 3
#: Log-odds of a plainly toxic word.
CLEAR = 1.5
SCORE_BATCH = 1024


#: ASCII signs divide words, but for the apostrophe.
_LETTERS = bytes(i if i >= 128 or chr(i).isalnum() or i == 39 else 32 for i in range(256))


def word_inputs(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): four embedding rows for every word; row 0 pads."""
    t = textkit.tokenize([x.translate(_LETTERS) if x else x for x in texts])
    ids = np.zeros((len(t.hashes), 4), np.uint16)
    if not len(t.hashes):
        return ids, t.offsets
    ids[:, 0] = 1 + t.hashes % np.uint64(WORD_BUCKETS - 1)
    b, gram = t.buf.astype(np.uint32), np.zeros(len(t.starts), np.uint32)
    for j in range(PREFIXES[-1]):
        byte = np.where(t.starts + j < t.ends, b[np.minimum(t.starts + j, len(b) - 1)], 0)
        gram = gram * np.uint32(0x01000193) ^ byte
        if j + 1 in PREFIXES:
            k = PREFIXES.index(j + 1)
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            ids[:, 1 + k] = WORD_BUCKETS + k * CHAR_BUCKETS + (mixed >> np.uint32(8)) % np.uint32(CHAR_BUCKETS)
    return ids, t.offsets


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover ``n`` words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def windows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW x 4 ids, windows of each text)."""
    ids, offsets = word_inputs(texts)
    padded = np.concatenate([ids, np.zeros((WINDOW, 4), np.uint16)])
    starts, counts, ends = [], np.zeros(len(texts), np.int64), []
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        s = window_starts(int(b - a)) + a
        counts[i] = len(s)
        starts.append(s)
        ends.append(np.full(len(s), b))
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    out = padded[at]
    out[at >= np.concatenate(ends)[:, None]] = 0
    return out, counts


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Parameters: embeddings, GRU of both directions, attention, output."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)

        def normal(scale, *shape):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "E": normal(0.03, INPUTS, EMBED),
            "W": normal(EMBED**-0.5, 2, EMBED, 3 * HIDDEN),
            "B": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "U": normal(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
            "A": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTEND),
            "v": normal(ATTEND**-0.5, ATTEND),
            "o": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN),
            "c": np.zeros(1, np.float32),
        }
        self.table = None

    def prepare(self) -> Network:
        """Projected embeddings: scoring reads four rows for each word."""
        self.table = np.concatenate([self.p["E"] @ self.p["W"][d] for d in (0, 1)], axis=1)
        return self

    def _states(self, xs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, 2, B, H); direction 1 reads from the end.  xs: (T, 2, B, 3H)."""
        steps, _, batch, _ = xs.shape
        h = np.zeros((2, batch, HIDDEN), np.float32)
        out = np.empty((steps, 2, batch, HIDDEN), np.float32)
        for t in range(steps):
            hu = h @ self.p["U"]
            x = xs[t]
            zr = _sigmoid(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            un = hu[..., 2 * HIDDEN :]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * un)
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, un))
            out[t] = h = new
        return out

    def score(self, ids: np.ndarray) -> np.ndarray:
        """Probability of each window."""
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), SCORE_BATCH):
            some = ids[i : i + SCORE_BATCH].transpose(1, 0, 2)  # (T, B, 4)
            x = self.table[some[..., 0]]
            for k in (1, 2, 3):
                x += self.table[some[..., k]]
            steps, batch, _ = x.shape
            xs = np.empty((steps, 2, batch, 3 * HIDDEN), np.float32)
            xs[:, 0], xs[:, 1] = x[..., : 3 * HIDDEN], x[::-1, :, 3 * HIDDEN :]
            xs += self.p["B"]
            h = self._states(xs)
            both = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
            e = np.tanh(both @ self.p["A"]) @ self.p["v"]
            e -= e.max(0)
            np.exp(e, out=e)
            e /= e.sum(0)
            pooled = np.einsum("tb,tbh->bh", e, both)
            out[i : i + batch] = _sigmoid(pooled @ self.p["o"] + self.p["c"][0])
        return out

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log loss of a batch of windows."""
        p, batch = self.p, len(ids)
        some = ids.transpose(1, 0, 2).astype(np.int64)
        emb = p["E"][some].sum(2)  # (T, B, D)
        xs = np.stack([emb @ p["W"][0], emb[::-1] @ p["W"][1]], axis=1) + p["B"]
        keep: list = []
        h = self._states(xs, keep)
        both = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
        act = np.tanh(both @ p["A"])
        e = act @ p["v"]
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, both)
        prob = _sigmoid(pooled @ p["o"] + p["c"][0])
        g: dict = {}
        d = ((prob - y) / batch).astype(np.float32)
        g["o"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        d_pool = np.outer(d, p["o"])
        d_w = np.einsum("bh,tbh->tb", d_pool, both)
        d_both = w[..., None] * d_pool
        d_e = w * (d_w - (w * d_w).sum(0))
        g["v"] = np.einsum("tb,tba->a", d_e, act)
        d_act = d_e[..., None] * p["v"] * (1 - act * act)
        g["A"] = np.einsum("tbh,tba->ha", both, d_act)
        d_both += d_act @ p["A"].T
        d_h = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1)
        back = np.zeros((2, batch, HIDDEN), np.float32)
        d_xs = np.empty_like(xs)
        g["U"] = np.zeros_like(p["U"])
        u_t = p["U"].transpose(0, 2, 1)
        for t in range(len(keep) - 1, -1, -1):
            prev, z, r, n, un = keep[t]
            d_new = d_h[t] + back
            d_z = d_new * (prev - n) * z * (1 - z)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_r = d_n * un * r * (1 - r)
            d_xs[t] = np.concatenate([d_z, d_r, d_n], axis=2)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=2)
            g["U"] += prev.transpose(0, 2, 1) @ d_hu
            back = d_new * z + d_hu @ u_t
        g["B"] = d_xs.sum((0, 2))[:, None, :]
        flat = emb.reshape(-1, EMBED)
        forward, backward = d_xs[:, 0], d_xs[::-1, 1]
        g["W"] = np.stack([flat.T @ s.reshape(-1, 3 * HIDDEN) for s in (forward, backward)])
        d_emb = (forward @ p["W"][0].T + backward @ p["W"][1].T).reshape(-1, EMBED)
        rows = some.reshape(-1, 4)
        g["E"] = (rows, d_emb)
        return g

    def fit_epoch(self, ids, y, state: dict, rng) -> None:
        """One pass of Adam; embedding rows are updated where they occur."""
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            g = self.gradients(ids[some], y[some])
            rows, d_emb = g.pop("E")
            state["step"] += 1
            fix1, fix2 = 1 - 0.9 ** state["step"], 1 - 0.999 ** state["step"]
            for k, d in g.items():
                m, v = state["m"][k], state["v"][k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                self.p[k] -= state["rate"] * (m / fix1) / (np.sqrt(v / fix2) + 1e-7)
            unique, at = np.unique(rows, return_inverse=True)
            d_emb = np.repeat(d_emb, 4, axis=0) * self.known[rows.reshape(-1)][:, None]
            total = np.zeros((len(unique), EMBED), np.float32)
            np.add.at(total, at.reshape(-1), d_emb)
            seen = state["squares"]
            seen[unique] += (total * total).sum(1)
            self.p["E"][unique] -= (10 * state["rate"]) * total / (np.sqrt(seen[unique])[:, None] + 1e-6)


def fit_network(docs_windows: list[np.ndarray], labels: np.ndarray, seed: int = 21) -> Network:
    """Multiple-instance training: documents are labelled, windows are read.

    A toxic document contributes the window that scores highest so far, a
    clean one its highest and a random window.  The first choice goes by the
    log-odds of single words, until the network has had WARM_UPDATES.  Inputs
    that fewer than MIN_DOCS documents show stay 0, so none is learnt by heart.
    """
    rng = np.random.default_rng(seed)
    sizes = np.array([len(w) for w in docs_windows])
    stacked = np.concatenate(docs_windows)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    seen = [np.zeros(INPUTS), np.zeros(INPUTS)]
    for w, label in zip(docs_windows, labels, strict=True):
        seen[int(label)][np.unique(w)] += 1
    odds = np.log((seen[1] + 0.5) / (labels.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - labels).sum() + 1))
    odds[0] = 0
    shown = seen[0] + seen[1]
    odds *= shown / (shown + SHRINK)
    value = odds[stacked].max((1, 2))
    net = Network(seed)
    # words start from their log-odds, shrunk where few documents show them
    net.p["E"][:, 0] += (START * odds).astype(np.float32)
    net.known = shown >= MIN_DOCS
    net.p["E"][~net.known] = 0
    state = {
        "step": 0, "m": {k: np.zeros_like(v) for k, v in net.p.items() if k != "E"},
        "v": {k: np.zeros_like(v) for k, v in net.p.items() if k != "E"}, "squares": np.full(INPUTS, 1e-4, np.float32),
    }
    updates = -(-2 * len(sizes) // BATCH)
    epochs = max(EPOCHS, -(-MIN_UPDATES // updates))
    warm = max(1, -(-WARM_UPDATES // updates))
    for epoch in range(epochs):
        top = np.array([s + value[s:e].argmax() for s, e in zip(starts, ends, strict=True)])
        other = starts + rng.integers(0, 1 << 30, len(sizes)) % sizes
        positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        copies = max(1, round(2 * len(negative) / len(positive) / 2))
        chosen = np.concatenate([np.tile(top[positive], copies), top[negative], other[negative]])
        y = np.concatenate([np.ones(len(positive) * copies), np.zeros(2 * len(negative))]).astype(np.float32)
        # clean words said over and over, which few documents show
        said = other[rng.choice(negative, len(negative) // 3)]
        word = stacked[said, rng.integers(0, WINDOW, len(said))]
        ids = np.concatenate([stacked[chosen], np.repeat(word[:, None], WINDOW, axis=1)])
        # half the toxic windows lose their plainest word if another one is left
        toxic = ids[: len(positive) * copies]
        strength = odds[toxic].max(2)
        plainest = toxic[np.arange(len(toxic)), strength.argmax(1), 0]
        same = toxic[..., 0] == plainest[:, None]
        left = np.where(same, -9, strength).max(1) >= CLEAR
        same &= (left & (rng.random(len(toxic)) < 0.5))[:, None]
        toxic[same] = 0
        state["rate"] = RATE * max(0.1, 1 - epoch / epochs)
        net.fit_epoch(ids, np.append(y, np.zeros(len(said), np.float32)), state, rng)
        if warm - 1 <= epoch < epochs - 1:
            value = net.prepare().score(stacked)
    return net.prepare()


class Model:
    """The network, or a constant where there was too little to learn."""

    def __init__(self, network: Network | None = None, constant: float = 0.5):
        self.network, self.constant = network, constant

    def score(self, texts: list) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for at, part in textkit.chunks(texts):
            ids, counts = windows(part)
            ends = np.cumsum(counts)
            out[at : at + len(part)] = np.maximum.reduceat(self.network.score(ids), ends - counts)
        return out

    def window_scores(self, text: bytes | None) -> np.ndarray:
        """Score of each window of one text."""
        return self.network.score(windows([text])[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on all windows of at most SAMPLE_PER_LABEL documents of each label."""
    sample = samples.labelled_sample(docs, labels, label, FOLDS, HELD, SAMPLE_PER_LABEL)

    size = F.sum(F.octet_length("text")).over(samples.in_order(label).rowsBetween(Window.unboundedPreceding, 0))
    sizes = sample.select("doc_id", "label", size.alias("size")).where(F.col("size") <= SAMPLE_BYTES)
    # at most SAMPLE_PER_LABEL ids of each label are broadcast
    sample = sample.join(F.broadcast(sizes.select("doc_id")), "doc_id")

    def cut(parts):
        for pdf in parts:
            cells = [windows([text.encode("utf-8")])[0].astype(np.uint16).tobytes() for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": cells})

    # the windows of at most 2 * SAMPLE_BYTES of text, about three times as large
    rows = sample.mapInPandas(cut, "doc_id long, label int, ids binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["ids"]))
    if not rows:
        return Model()
    y = np.array([r["label"] for r in rows], np.float32)
    if y.min() == y.max():
        return Model(constant=float(y.sum() + 1) / (len(y) + 2))
    cut_windows = [np.frombuffer(r["ids"], np.uint16).reshape(-1, WINDOW, 4) for r in rows]
    return Model(fit_network(cut_windows, y))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Per document: doc_id and the highest window probability."""
    model = train(docs, labels, label)
    return textkit.map_texts(docs, lambda texts: [pa.array(model.score(texts), pa.float64())], "score double")
