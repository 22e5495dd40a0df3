"""Operator 9 - quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; its context vector adds the index
vectors of its neighbours in all documents, labelled or not.  Word vectors and
the random vectors of character trigrams are pooled per whole document and
scored by a two-layer numpy network, whose probabilities are calibrated with a
temperature fitted on a part of the sample that training leaves out.

Defined results
    * null or empty text: the score of a document without words.
    * labels other than 0 and 1, null ids and held-out rows are not learnt from.
    * no labelled rows: 0.5 for all; one label only: that label's share,
      kept off 0 and 1.
    * repeated rows are scored alike; other columns never matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common, samples, textkit

FOLDS, HELD = 5, 0
#: Labelled documents of each label that the network is fitted on, at most.
SAMPLE_PER_LABEL = 2500
THRESHOLD = 0.3

WORD_BUCKETS, WORD_DIM, NONZERO = 1 << 15, 48, 6
CHAR_BUCKETS, CHAR_DIM = 1 << 12, 32
SAMPLE_TASKS = 4
#: Word buckets in one row of partial sums; tasks that sum, for each core.
CONTEXT_BLOCK, CONTEXT_TASKS = 256, 4
HIDDEN = 32
_DOCS_AT_ONCE = 64


def index_vectors(buckets: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors of unit length."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dim), np.float32)
    rows = np.repeat(np.arange(buckets), NONZERO)
    at = rng.integers(0, dim, len(rows))
    np.add.at(out, (rows, at), rng.choice(np.array([-1, 1], np.float32), len(rows)))
    return out / np.float32(NONZERO**0.5)


def sparse_form(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole-number values of each vector's at most NONZERO entries."""
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    return at, np.rint(np.take_along_axis(index, at, 1) * NONZERO**0.5)


def context_sums(texts: list, at: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
    """Adds the neighbours' index vectors to ``total`` (bucket, dimension)."""
    for _, part in textkit.chunks(texts, 1 << 19):
        t = textkit.tokenize(part, lower=False)
        if len(t.hashes) < 2:
            continue
        ids = (t.hashes % np.uint64(len(total))).astype(np.int64)
        text = t.text_of()
        near = text[1:] == text[:-1]
        left, right = ids[:-1][near], ids[1:][near]
        for own, other in ((left, right), (right, left)):
            cells = (own[:, None] * total.shape[1] + at[other]).ravel()
            total += np.bincount(cells, values[other].ravel(), total.size).reshape(total.shape)


class Pooler:
    """Pooled features of whole documents."""

    def __init__(self, words: np.ndarray, chars: np.ndarray):
        self.words, self.chars = words, chars

    @property
    def width(self) -> int:
        return self.words.shape[1] + self.chars.shape[1] + 8

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for at, part in textkit.chunks(texts):
            for i in range(0, len(part), _DOCS_AT_ONCE):
                some = part[i : i + _DOCS_AT_ONCE]
                out[at + i : at + i + len(some)] = self._pool(some)
        return out

    def _pool(self, texts: list) -> np.ndarray:
        t = textkit.tokenize(texts, lower=False)
        n = np.maximum(t.counts, 1).astype(np.float32)[:, None]
        ids = (t.hashes % np.uint64(len(self.words))).astype(np.int64)
        pooled = textkit.sums_by_text(self.words[ids], t.offsets) / n
        b = t.buf.astype(np.uint32)
        grams = (b[:-2] * 7919 + b[1:-1] * 104729 + b[2:] * 1299709) % np.uint32(len(self.chars))
        owner = np.repeat(np.arange(len(texts)), np.diff(t.text_starts))[: len(grams) - 1]
        cells = owner * len(self.chars) + grams[1 : 1 + len(owner)]
        counts = np.bincount(cells, minlength=len(texts) * len(self.chars)).reshape(len(texts), -1).astype(np.float32)
        size = np.maximum(counts.sum(1, keepdims=True), 1)
        chars = counts @ self.chars / size
        same = np.zeros(len(ids), np.float32)
        if len(ids) > 1:
            same[1:] = t.hashes[1:] == t.hashes[:-1]
        text = t.text_of()
        distinct = np.zeros(len(texts), np.float32)
        if len(ids):
            order = np.lexsort((t.hashes, text))
            h, w = t.hashes[order], text[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
            distinct = np.bincount(w[new], minlength=len(texts)).astype(np.float32)
        lengths = textkit.sums_by_text((t.ends - t.starts).astype(np.float32), t.offsets)
        kinds = np.zeros(256, np.int64)
        kinds[65:91], kinds[48:58], kinds[128:], kinds[97:123] = 1, 2, 3, 3
        owner_b = np.repeat(np.arange(len(texts)), np.diff(t.text_starts))[: len(b) - 1]
        by_kind = np.bincount(owner_b * 4 + kinds[t.buf[1 : 1 + len(owner_b)]], minlength=len(texts) * 4)
        by_kind = by_kind.reshape(-1, 4)[: len(texts)] / np.maximum(np.diff(t.text_starts), 1)[:, None]
        scalars = np.column_stack(
            [
                np.log1p(t.counts),
                np.linalg.norm(pooled, axis=1),
                textkit.sums_by_text(same, t.offsets) / n[:, 0],
                distinct / n[:, 0],
                lengths / n[:, 0] / 10,
                by_kind[:, 0],
                by_kind[:, 1],
                by_kind[:, 3],
            ]
        )
        return np.column_stack([pooled, chars, scalars]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Two dense layers with a temperature; fitted with Adam in numpy."""

    def __init__(self, shift, scale, weights, temperature=1.0):
        self.shift, self.scale, self.weights, self.temperature = shift, scale, weights, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        x = np.clip((x - self.shift) / self.scale, -8, 8)
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x).astype(np.float64) / self.temperature)

    @classmethod
    def fit(cls, x, y, importance, seed=11, epochs=30, batch=64, rate=3e-3, decay=1e-4):
        rng = np.random.default_rng(seed)
        shift, scale = x.mean(0), x.std(0) + 1e-3
        w = [
            rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        ]
        net, step = cls(shift, scale, w), 0
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z = np.clip((x - shift) / scale, -8, 8).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                h = np.maximum(z[some] @ w[0] + w[1], 0)
                g = (sigmoid(h @ w[2] + w[3][0]) - y[some]) * importance[some] / len(some)
                g = g.astype(np.float32)
                gh = np.outer(g, w[2]) * (h > 0)
                step += 1
                for k, d in enumerate((z[some].T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], g.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return net

    def calibrate(self, x, y, importance) -> Network:
        """The temperature with the least weighted log loss on other rows."""
        logits = self.logits(x).astype(np.float64)
        tried = np.geomspace(0.3, 8, 60)
        loss = [
            -(importance * np.log(np.clip(np.where(y == 1, sigmoid(logits / t), sigmoid(-logits / t)), 1e-12, 1))).mean()
            for t in tried
        ]
        self.temperature = float(tried[int(np.argmin(loss))])
        return self


class Model:
    """Pooler with network, or a constant where there was too little to learn."""

    def __init__(self, pooler=None, network=None, constant=0.5):
        self.pooler, self.network, self.constant = pooler, network, constant

    def score(self, texts: list) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.predict(self.pooler(texts))


def learn_contexts(docs: DataFrame, index: np.ndarray) -> np.ndarray:
    """Context sums of all documents' words, in units of a vector's entry.

    Sums are whole numbers, so the order in which tasks end does not matter.
    """
    common.bounded_batches(docs.sparkSession)
    at, values = sparse_form(index)

    def run(batches):
        total = np.zeros((WORD_BUCKETS, WORD_DIM))
        for batch in batches:
            context_sums(batch.column(0).to_pylist(), at, values, total)
        blocks = [i for i in range(0, len(total), CONTEXT_BLOCK) if total[i : i + CONTEXT_BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([total[i : i + CONTEXT_BLOCK].tobytes() for i in blocks], pa.binary())],
            names=["first", "sums"],
        )

    def add(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b) for b in group.column("sums").to_pylist())
        return pa.table({"first": group.column("first")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    texts = docs.where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("_text"))
    # one partial table for each task: their number is that of the cores, not of the files
    texts = texts.coalesce(CONTEXT_TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    rows = texts.mapInArrow(run, "first int, sums binary").groupBy("first").applyInArrow(add, "first int, sums binary")
    total = np.zeros((WORD_BUCKETS, WORD_DIM))
    for r in rows.collect():  # WORD_BUCKETS vectors
        sums = np.frombuffer(r["sums"]).reshape(-1, WORD_DIM)
        total[r["first"] : r["first"] + len(sums)] = sums
    return total


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Word vectors of all documents; fit on at most SAMPLE_PER_LABEL of each label."""
    sample = samples.labelled_sample(docs, labels, label, FOLDS, HELD, SAMPLE_PER_LABEL)
    sample = sample.coalesce(SAMPLE_TASKS)
    index = index_vectors(WORD_BUCKETS, WORD_DIM, 5)

    words = index.copy()
    context = learn_contexts(docs, index)
    norms = np.linalg.norm(context, axis=1, keepdims=True)
    words += (context / np.maximum(norms, 1e-6)).astype(np.float32)
    pooler = Pooler(words, index_vectors(CHAR_BUCKETS, CHAR_DIM, 6))

    def features(parts):
        ids, y, x = [], [], []
        for pdf in parts:
            ids.append(pdf["doc_id"].to_numpy(np.int64))
            y.append(pdf["label"].to_numpy(np.int32))
            x.append(pooler(list(pdf["text"].str.encode("utf-8"))))
        if ids:  # one matrix for each task
            yield pd.DataFrame({k: [np.concatenate(v).tobytes()] for k, v in (("ids", ids), ("y", y), ("x", x))})

    parts = sample.where("label IN (0, 1)").mapInPandas(features, "ids binary, y binary, x binary").collect()
    if not parts:
        return Model()
    ids, y, x = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in (("ids", np.int64), ("y", np.int32), ("x", np.float32)))
    x = x.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], y, ids))  # whichever task was first
    y, x = y[order].astype(np.float32), x[order]
    if not len(y):
        return Model()
    if y.min() == y.max():
        return Model(constant=float(y.sum() + 1) / (len(y) + 2))
    learnt = labels.where(F.col("doc_id").isNotNull() & (common.fold_of("doc_id", FOLDS) != HELD))
    by_label = learnt.groupBy(F.col(label).cast("int").alias("label")).count().where("label IN (0, 1)")
    shares = {r["label"]: r["count"] for r in by_label.collect()}
    n = {k: max(1.0, float((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(shares.values()))
    importance = np.where(y == 1, shares.get(1, 1) / total / n[1], shares.get(0, 1) / total / n[0]) * len(y)
    rare = np.sqrt(importance)  # between natural and equal shares, for the fit only
    kept = np.random.default_rng(3).random(len(y)) < 0.2
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
        return Model(pooler, Network.fit(x, y, rare / rare.mean()))
    net = Network.fit(x[~kept], y[~kept], (rare / rare.mean())[~kept])
    return Model(pooler, net.calibrate(x[kept], y[kept], importance[kept]))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: dict | None = None, name: str = "score") -> DataFrame:
    """Per document: doc_id and, as ``name``, the calibrated probability of
    label 1; ``keep`` (name to Column) stays beside it."""
    model = train(docs, labels, label)
    return textkit.map_texts(
        docs, lambda texts: [pa.array(model.score(texts), pa.float64())], f"{name} double", keep=keep
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose probability reaches the threshold."""
    keep = {c: F.col(f"`{c}`") for c in docs.columns if c != "doc_id"}
    name = "_quality"
    while name in docs.columns:
        name += "_"
    scored = score_quality(docs, labels, keep=keep, name=name)
    return scored.where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
