"""Operator 4 - language-model scoring with a hashed maximum-entropy model.

A token's probability is a product of softmaxes along a tree of classes:

    P(w | h) = prod over levels of softmax_branch(b[node] + sum_f W[f(h), node])

The most frequent words are the leaves of the tree, WIDE branches at each of
its LEVELS; words of a letter cluster and of like frequency stand together.
The features f of the history are the word before, the two words before, the
word before last (a skip) and the clusters of the last four words.  Each is
hashed with the node it speaks about, so n-grams predict classes and, on the
last level, words.  One leaf of each cluster stands for all its other words: a
word there has its smoothed share of the training counts, an unseen word that
of one word never seen.

Word counts and letter statistics are taken over all training documents.
Weights are trained by synchronous gradient rounds: each task sums, over its
documents, what the features saw and what the model expected of them, the sums
are added up by blocks of rows, and every weight moves along the difference,
scaled by its row.  In the first round the model knows the class shares only,
so the expectation is in closed form (iterative scaling); later rounds evaluate
it token by token, and a Gaussian prior pulls the weights to 0.  Rounds go on
until the next one would gain less than SETTLED.  Sums are whole numbers, so
scores don't depend on how the documents are dealt to tasks.  Scoring runs in sparse numpy batches: of all
weights a token touches FEATURES x LEVELS rows.

The weights have between 2**15 and MOST_ROWS rows, TOKENS_PER_ROW tokens each
as long as they grow.  Only the most frequent words travel with the tasks
(their number is fixed); all other words are looked up by a join on the table
of counts, which grows with the corpus.

Defined results
    * null or empty text: the end token alone.
    * no training documents: all counts 0.
    * words are compared by a 64-bit hash; repeated rows are scored alike and,
      when they train, count each.  Other columns never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common, textkit

FOLDS, HELD = 10, 0
SMOOTH = 0.1
CLUSTERS, GRAMS = 8, 2048
#: Documents that the first cluster centres are chosen among; the centres then
#: are the mean of all documents that are nearest.
SEED_DOCS = 1500
#: Words whose counts go with the tasks.
COMMON_WORDS = 1 << 18
WIDE, LEVELS, FEATURES = 16, 3, 4
LEAVES = WIDE**LEVELS
#: Share of the weight rows for each level; a node's share of its level's is
#: that of the tokens below it.
LEVEL_SHARES = (0.25, 0.35, 0.4)
MOST_ROWS, TOKENS_PER_ROW = 1 << 19, 8
#: First round: step length, and tokens that a row needs to count as much as its prior.
RATE, PRIOR = 0.5, 8.0
#: Later rounds: precision of the weights' prior, the longest move of a weight,
#: and the gain (log10 a token, as foreseen) below which training has settled.
PULL, LONGEST, SETTLED = 4.0, 1.0, 0.005
#: A probability of 1 in the whole numbers that are summed.
UNIT = 1 << 16
#: Bytes of text whose tokens are ordered together, tokens taken at a time, rows in a block of sums.
CHUNK, BATCH, BLOCK_ROWS = 1 << 21, 8192, 1024
#: Tasks that sum, for each core: every one sends a table of sums.
SUM_TASKS = 4
#: Stands for the end of a text; no word hashes to it in practice.
END = np.uint64(0xE7D0000000000001)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[[9, 10, 11, 12, 13, 32]] = True
#: All white space is alike to the letters beside it.
_PLAIN = np.where(_NOT_LETTER, 32, np.arange(256)).astype(np.uint32)


def _grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes around each position."""
    b = _PLAIN[buf]
    mixed = b[at - 1] * np.uint32(7919) + b[at] * np.uint32(104729) + b[np.minimum(at + 1, len(b) - 1)] * np.uint32(1299709)
    return (mixed ^ (mixed >> np.uint32(11))) % np.uint32(GRAMS)


def clusters_of(t: textkit.Tokens, which: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cluster of the words ``which``: the likeliest for their letters."""
    lengths = (t.ends - t.starts)[which]
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(t.starts[which] - (ends - lengths), lengths)
    return np.add.reduceat(table[_grams(t.buf, at)], ends - lengths, axis=0).argmax(1)


def first_centres(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """CLUSTERS centres (of unit length) from gram counts of some documents."""
    rng = np.random.default_rng(seed)
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    centres = [share[rng.integers(len(share))]]
    while len(centres) < CLUSTERS:
        near = np.maximum.reduce([share @ c for c in centres])
        centres.append(share[int(near.argmin())])
    centres = np.array(centres)
    for _ in range(8):
        group = (share @ centres.T).argmax(1)
        for k in range(CLUSTERS):
            if (group == k).any():
                c = share[group == k].sum(0)
                centres[k] = c / max(np.linalg.norm(c), 1e-9)
    return centres


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the text's letter grams."""
    t = textkit.tokenize([text])
    at = np.flatnonzero(~_NOT_LETTER[t.buf])
    return np.bincount(_grams(t.buf, at), minlength=GRAMS) if len(at) else np.zeros(GRAMS, np.int64)


class Vocabulary:
    """The most frequent words with their counts and clusters, and the tree."""

    def __init__(self, hashes, counts, clusters, total, types, tail_tokens, tail_types, grams):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.clusters = clusters[order].astype(np.int64)
        self.total, self.types, self.grams = total, types, grams
        self.log_counts = np.log(self.counts + SMOOTH)
        tail_tokens, tail_types = tail_tokens.astype(np.float64), tail_types.astype(np.float64)
        head = np.lexsort((self.hashes, -self.counts))[: LEAVES - CLUSTERS]
        tail_tokens = tail_tokens - np.bincount(self.clusters[head], self.counts[head], CLUSTERS)
        tail_types = tail_types - np.bincount(self.clusters[head], minlength=CLUSTERS)
        self.tail_norm = np.log(tail_tokens + SMOOTH * (tail_types + 1))
        # leaves: cluster by cluster the rest of its words, then its frequent ones
        cluster = np.concatenate([np.arange(CLUSTERS), self.clusters[head]])
        mass = np.concatenate([tail_tokens + 1.0, self.counts[head]])
        rank = np.concatenate([np.full(CLUSTERS, -np.inf), -self.counts[head].astype(float)])
        at = np.lexsort((np.arange(len(mass)), rank, cluster))
        leaf_of = np.empty(len(mass), np.int64)
        leaf_of[at] = np.arange(len(mass))
        self.tail_leaf = leaf_of[:CLUSTERS]
        self.head = np.zeros(len(self.hashes), bool)
        self.head[head] = True
        self.leaf = self.tail_leaf[self.clusters]
        self.leaf[head] = leaf_of[CLUSTERS:]
        shares = np.zeros(LEAVES)
        shares[: len(mass)] = mass[at]
        levels = [shares.reshape(WIDE**i, WIDE, -1).sum(2) for i in range(LEVELS)]
        self.first_node = np.cumsum([0, *[len(m) for m in levels]])[:LEVELS]
        below = np.concatenate(levels)
        part = below / np.maximum(below.sum(1, keepdims=True), 1e-9)
        self.bias = np.log(np.maximum(part, 1e-17)).astype(np.float32)
        # rows of the weights: a range for each node
        wanted = 1 << max(0, int(np.ceil(np.log2(max(1, total) / TOKENS_PER_ROW))))
        room = min(max(wanted, 1 << 15), MOST_ROWS)
        slots = [np.maximum(8, m.sum(1) / m.sum() * room * x) for m, x in zip(levels, LEVEL_SHARES, strict=True)]
        self.slots = np.concatenate(slots).astype(np.uint64)
        self.offset = np.concatenate([[0], np.cumsum(self.slots)]).astype(np.int64)
        self.rows = int(self.offset[-1])
        # direct-mapped front of the sorted table
        self.shift = np.uint64(64 - 20)
        self.front = np.zeros(1 << 20, np.int32)
        order = np.argsort(self.counts, kind="stable")
        self.front[(self.hashes[order] >> self.shift).astype(np.int64)] = order

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.front[(h >> self.shift).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.hashes[at] != h)
        second = np.minimum(np.searchsorted(self.hashes, h[missed]), len(self.hashes) - 1)
        at[missed] = np.where(self.hashes[second] == h[missed], second, -1)
        return at

    def prior(self) -> np.ndarray:
        """The share of each branch for every row of the weights."""
        return np.exp(self.bias)[np.repeat(np.arange(len(self.slots)), self.slots.astype(np.int64))]


class Stream:
    """Tokens of a chunk of texts with ends, leaves and hashed histories."""

    def __init__(self, texts: list, vocabulary: Vocabulary):
        self.v = v = vocabulary
        t = textkit.tokenize(texts)
        n_docs = len(texts)
        doc = t.text_of()
        total = len(t.hashes) + n_docs
        self.offsets = t.offsets + np.arange(n_docs + 1)
        at = np.arange(len(t.hashes)) + doc
        h = np.full(total, END, np.uint64)
        h[at] = t.hashes
        row = v.find(h)
        unknown = np.flatnonzero(row[at] < 0)
        self.h, self.known = h, row >= 0
        self.cluster, self.leaf, self.in_tail = np.zeros(total, np.int64), np.zeros(total, np.int64), np.ones(total, bool)
        self.log_counts = np.full(total, np.log(SMOOTH))
        known = row[self.known]
        self.cluster[self.known], self.leaf[self.known] = v.clusters[known], v.leaf[known]
        self.in_tail[self.known], self.log_counts[self.known] = ~v.head[known], v.log_counts[known]
        self.cluster[at[unknown]] = clusters_of(t, unknown, v.grams)
        self.leaf[~self.known] = v.tail_leaf[self.cluster[~self.known]]
        since = np.arange(total) - np.repeat(self.offsets[:-1], np.diff(self.offsets))

        def back(values, steps):
            out = np.zeros_like(values)
            out[steps:] = values[:-steps]
            out[since < steps] = 0
            return out

        h1, h2 = back(h, 1), back(h, 2)
        c = [back(self.cluster + 1, s) for s in (1, 2, 3, 4)]
        near = (((c[0] * 9 + c[1]) * 9 + c[2]) * 9 + c[3]).astype(np.uint64)
        history = (h1, h2 * _SALTS[0] + h1, h2, near)
        self.history = [textkit.mix64(x * _SALTS[3] + salt) >> np.uint64(32) for x, salt in zip(history, _SALTS, strict=True)]

    def batches(self, size: int = BATCH):
        """For each level and some tokens at a time: (their places, level, nodes, branches, rows of the weights).

        Tokens of one node, at the root of one word before, come together, so
        their rows lie close to each other.
        """
        by_word = np.argsort((self.history[0] >> np.uint64(16)).astype(np.uint16), kind="stable")
        by_leaf = np.argsort(self.leaf.astype(np.uint16), kind="stable")
        for level in range(LEVELS):
            order = by_leaf if level else by_word
            for i in range(0, len(order), size):
                part = order[i : i + size]
                leaf = self.leaf[part]
                above = leaf // WIDE ** (LEVELS - level)
                node = self.v.first_node[level] + above
                branch = leaf // WIDE ** (LEVELS - level - 1) - above * WIDE
                slots, offset = self.v.slots[node], self.v.offset[node]
                yield part, level, node, branch, [offset + ((x[part] * slots) >> np.uint64(32)).astype(np.int64) for x in self.history]


def scores_of(v: Vocabulary, W: np.ndarray, node: np.ndarray, rows: list) -> np.ndarray:
    """Unnormalised log probabilities of the branches."""
    z = np.take(v.bias, node, axis=0)
    own = np.empty_like(z)
    for r in rows:  # all in range: "clip" only spares a copy
        z += np.take(W, r, axis=0, out=own, mode="clip")
    return z


def over_branches(z: np.ndarray) -> np.ndarray:
    """Sums of the rows, always added in the same order."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = z[:, :half] + z[:, half:]
    return z[:, 0]


def log_probabilities(s: Stream, W: np.ndarray) -> np.ndarray:
    """Natural log; for words outside the tree without their count."""
    out = np.zeros(len(s.h))
    for part, _, node, branch, rows in s.batches():
        z = scores_of(s.v, W, node, rows)
        out[part] += z[np.arange(len(z)), branch]
        out[part] -= np.log(over_branches(np.exp(z, out=z)))
    out[s.in_tail] -= s.v.tail_norm[s.cluster[s.in_tail]]
    return out


def add_sums(s: Stream, W: np.ndarray | None, seen: np.ndarray, expected: np.ndarray | None) -> None:
    """Adds how often each (row, branch) was seen and, by the weights, expected."""
    for _, _, node, branch, rows in s.batches():
        for r in rows:
            np.add.at(seen, r * WIDE + branch, np.float32(1))
        if expected is not None:
            z = np.exp(scores_of(s.v, W, node, rows))
            z /= z.sum(1, keepdims=True)
            for r in rows:
                order = np.argsort(r, kind="stable")
                ranked = r[order]
                heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                expected[ranked[heads]] += np.add.reduceat(z[order], heads, axis=0)


def step(v: Vocabulary, W: np.ndarray | None, seen: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
    """The weights after one gradient round over the sums of all tasks."""
    prior = v.prior()
    if W is None:  # what the class shares expect
        expected, W = seen.sum(1, keepdims=True) * prior, np.float32(0)
    return W + (RATE * (np.log(seen + PRIOR * prior) - np.log(expected + PRIOR * prior))).astype(np.float32)


def add_expected(s: Stream, W: np.ndarray, expected: np.ndarray) -> None:
    """Adds what the weights expect of each (row, branch), in UNITs.

    Whole numbers, so float64 sums are exact too (to 2**37 tokens); two of them
    are added as one complex number, which takes half the steps of int64.
    """
    pairs = expected.view(np.complex128) if expected.dtype == np.float64 else expected
    width = WIDE * expected.itemsize // pairs.itemsize
    places = np.arange(width)
    for _, _, node, _, rows in s.batches():
        z = scores_of(s.v, W, node, rows)
        np.exp(z, out=z)
        z *= (UNIT / over_branches(z))[:, None]
        units = np.rint(z, out=z).astype(expected.dtype).view(pairs.dtype).ravel()
        for r in rows:
            np.add.at(pairs, (r[:, None] * width + places).ravel(), units)


def move(W: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> float:
    """Moves the weights (in place) towards what was seen; the gain foreseen, in nats.

    A token's score is a sum over FEATURES rows, so that many times the
    variance of a branch bounds the curvature.
    """
    gain = 0.0
    for i in range(0, len(W), BLOCK_ROWS):
        w, e = W[i : i + BLOCK_ROWS], expected[i : i + BLOCK_ROWS].astype(np.float64)
        slope = seen[i : i + BLOCK_ROWS] - e - PULL * w
        curve = FEATURES * e * (1 - e / np.maximum(e.sum(1, keepdims=True), 1e-9)) + PULL
        by = np.clip(slope / curve, -LONGEST, LONGEST)
        gain += float((by * slope - 0.5 * curve * by * by).sum())
        w += by.astype(np.float32)
    return gain


def _sorted_sums(h: np.ndarray, n: np.ndarray, extra: np.ndarray):
    order = np.argsort(h, kind="stable")
    h = h[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[heads], (np.add.reduceat(n[order], heads) if len(h) else n), extra[order][heads]


def count_words(training: DataFrame, grams: np.ndarray) -> DataFrame:
    """(h, cluster, n) of every distinct word of the training documents."""

    def run(batches):
        parts, held = [], 0

        def flush():
            if not parts:
                return None
            h, n, k = _sorted_sums(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(n)], names=["h", "cluster", "n"]
            )

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for _, part in textkit.chunks(texts):
                t = textkit.tokenize(part)
                h, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                parts.append((h, n.astype(np.int64), clusters_of(t, first, grams)))
                held += len(h)
            parts.append((np.array([END]), np.array([len(texts)], np.int64), np.zeros(1, np.int64)))
            if held > 3_000_000:
                yield flush()
                held = 0
        out = flush()
        if out is not None:
            yield out

    slim = training.select("doc_id", F.encode("text", "UTF-8").alias("_text"))
    rows = slim.mapInArrow(run, "h long, cluster int, n long")
    return rows.groupBy("h").agg(F.first("cluster").alias("cluster"), F.sum("n").alias("n"))


def _learn_clusters(training: DataFrame) -> np.ndarray:
    """Log probability of each gram in CLUSTERS groups of all training documents."""
    training = training.where("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    ids = training.select("doc_id").orderBy(F.xxhash64(F.lit("lm"), "doc_id"), "doc_id").limit(SEED_DOCS)
    ids = common.durable(ids.distinct().coalesce(1), "lm-sample")
    sample = training.join(F.broadcast(ids), training["doc_id"].eqNullSafe(ids["doc_id"])).select(training["doc_id"], "text")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))  # SEED_DOCS rows
    counted = textkit.map_texts(sample, lambda texts: [pa.array([gram_counts(t).tobytes() for t in texts], pa.binary())], "grams binary")
    rows = counted.select("grams").collect()  # SEED_DOCS rows of fixed size
    if not rows:
        return np.zeros((GRAMS, CLUSTERS), np.float32)
    centres = first_centres(np.array(sorted(np.frombuffer(r["grams"], np.int64).tolist() for r in rows)).astype(np.float64))

    def run(batches):
        sums = np.zeros((CLUSTERS, GRAMS), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = gram_counts(text)
                sums[int((centres @ np.sqrt(own)).argmax())] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLUSTERS, dtype=np.int32)), pa.array([r.tobytes() for r in sums], pa.binary())], names=["k", "sums"])

    def add(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, np.int64) for b in group.column("sums").to_pylist())
        return pa.table({"k": group.column("k")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = training.select(F.encode("text", "UTF-8").alias("_text")).mapInArrow(run, "k int, sums binary")
    total = np.full((CLUSTERS, GRAMS), 0.5)
    for r in parts.groupBy("k").applyInArrow(add, "k int, sums binary").collect():  # CLUSTERS rows
        total[r["k"]] += np.frombuffer(r["sums"], np.int64)
    return np.log(total / total.sum(1, keepdims=True)).T.astype(np.float32)


def _vocabulary(counts: DataFrame, grams: np.ndarray) -> Vocabulary:
    facts = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).first()
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).count().collect()  # 8 for each power of two
    chosen, room = 1 << 30, COMMON_WORDS
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        chosen = r["level"]
    kept = counts.where(level >= chosen).select("h", "cluster", "n").toArrow()  # at most COMMON_WORDS rows
    tail = {r["cluster"]: (r["n"], r["types"]) for r in counts.groupBy("cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    columns = [kept.column(i).to_numpy() for i in range(3)]
    return Vocabulary(
        columns[0].astype(np.int64).view(np.uint64), columns[2].astype(np.int64), columns[1].astype(np.int64),
        int(facts["total"] or 0), int(facts["types"]),
        np.array([tail.get(k, (0, 0))[0] for k in range(CLUSTERS)]), np.array([tail.get(k, (0, 0))[1] for k in range(CLUSTERS)]), grams,
    )


def _sums(training: DataFrame, shared, size: int, W: np.ndarray | None) -> np.ndarray:
    """What all training documents have of every (row, branch): without weights
    how often it was seen, with weights how often they expect it.

    ``shared`` is the broadcast vocabulary of ``size`` rows.  Neither the shuffled sums nor the
    weights stay on disk for the next round.
    """
    context = training.sparkSession.sparkContext
    slim = training.select(F.encode("text", "UTF-8").alias("_text"))
    # expectations fill the whole table, so fewer tasks send one
    slim = slim.coalesce((SUM_TASKS if W is None else 1) * context.defaultParallelism)
    kind, sent_as, unit = (np.float32, np.float32, 1) if W is None else (np.float64, np.int64, UNIT)
    sent = None if W is None else context.broadcast(W.astype(np.float16))

    def run(batches):
        v = shared.value
        sums = np.zeros(v.rows * WIDE, kind)
        weights = None if sent is None else sent.value.astype(np.float32)
        for batch in batches:
            for _, part in textkit.chunks(batch.column(0).to_pylist(), CHUNK):
                if weights is None:
                    add_sums(Stream(part, v), None, sums, None)
                else:
                    add_expected(Stream(part, v), weights, sums)
        sums = sums.reshape(-1, WIDE)
        at = [i for i in range(0, v.rows, BLOCK_ROWS) if sums[i : i + BLOCK_ROWS].any()]
        for some in (at[i : i + 32] for i in range(0, len(at), 32)):
            parts = pa.array([sums[i : i + BLOCK_ROWS].astype(sent_as).tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), parts], names=["first", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for b in group.column("sums").to_pylist():
            part = np.frombuffer(b, sent_as)
            total = total + (part.astype(np.float64) if sent_as is np.float32 else part)
        out = (total / unit).astype(np.float32).tobytes()
        return pa.table({"first": group.column("first")[:1], "sums": pa.array([out], pa.binary())})

    schema = "first int, sums binary"
    with common.shuffles_removed(training.sparkSession):
        summed = slim.mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema).toArrow()  # the size of the model
    if sent is not None:
        sent.destroy()
    table = np.zeros((size, WIDE), np.float32)
    for first, part in zip(summed.column("first").to_pylist(), summed.column("sums"), strict=True):
        rows = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, WIDE)
        table[first : first + len(rows)] = rows
    return table


def train(training: DataFrame, v: Vocabulary, rounds: int | None = None) -> np.ndarray:
    """Weights after gradient rounds over all training documents.

    Without a number of ``rounds`` they go on until the gain that the last
    move foresaw is below SETTLED, or no longer falls.
    """
    shared = training.sparkSession.sparkContext.broadcast(v)
    seen = _sums(training, shared, v.rows, None)
    W, made, last = step(v, None, seen, None), 1, np.inf
    while made < rounds if rounds is not None else last >= SETTLED:
        gain = move(W, seen, _sums(training, shared, v.rows, W)) / max(1, v.total) / np.log(10)
        made += 1
        if rounds is None and gain >= last:
            break
        last = gain
    shared.destroy()
    return W


def score_texts(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    training = docs.where(common.fold_of("doc_id", FOLDS) != HELD)
    grams = _learn_clusters(training)
    counts = common.durable(count_words(training, grams), "lm-counts")
    vocabulary = _vocabulary(counts, grams)
    weights = train(training, vocabulary, rounds).astype(np.float16)
    total, types = vocabulary.total, vocabulary.types
    log_norm = float(np.log(total + SMOOTH * (types + 1)))

    def run(texts):
        n_tokens, n_known, base, score, tails, times = [], [], [], [], [], []
        for _, part in textkit.chunks(texts, CHUNK):
            s = Stream(part, vocabulary)
            logs = log_probabilities(s, weights32())
            value = np.where(s.known, s.log_counts, 0.0)
            starts = s.offsets[:-1]
            n_tokens.append(np.diff(s.offsets))
            n_known.append(np.add.reduceat(s.known.astype(np.int64), starts))
            base.append(np.add.reduceat(value - log_norm, starts))
            score.append(np.add.reduceat(logs + np.where(s.in_tail, value, 0), starts))
            for a, b in zip(starts, s.offsets[1:], strict=True):
                h, n = np.unique(s.h[a:b][~s.known[a:b]], return_counts=True)
                tails.append(h.view(np.int64))
                times.append(n)
        sizes = np.cumsum([0, *[len(h) for h in tails]])
        flat_h = np.concatenate(tails) if tails else np.zeros(0, np.int64)
        flat_n = np.concatenate(times) if times else np.zeros(0, np.int64)
        return [
            *[pa.array(np.concatenate(x) if x else np.zeros(0)).cast(kind) for x, kind in
              ((n_tokens, pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (score, pa.float64()))],
            pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat_h, pa.int64())),
            pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat_n.astype(np.int32), pa.int32())),
        ]

    wide: list[np.ndarray] = []

    def weights32():
        if not wide:
            wide.append(weights.astype(np.float32))
        return wide[0]

    fields = "n_tokens long, n_known long, base double, score double, tail_h array<long>, tail_n array<int>"
    scored = textkit.map_texts(docs, run, fields).withColumn("uid", F.monotonically_increasing_id())
    scored = common.durable(scored, "lm-scored")

    # words that did not travel with the tasks: their counts come by a join
    rare = scored.where(F.size("tail_h") > 0).select("uid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("w"))
    rare = rare.select("uid", F.col("w.tail_h").alias("h"), F.col("w.tail_n").alias("times"))
    joined = rare.join(counts.select("h", "n"), "h", "left")
    value = F.col("times") * F.log(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    sums = joined.groupBy("uid").agg(F.sum(value).alias("tail_value"), F.sum(known).alias("tail_known"))
    out = scored.drop("tail_h", "tail_n").join(sums, "uid", "left")
    ten, tail = float(np.log(10)), F.coalesce("tail_value", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        ((F.col("base") + tail) / ten).alias("base_score"),
        ((F.col("score") + tail) / ten).alias("score"),
    )
