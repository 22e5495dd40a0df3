"""Operator 1 - exact top-k search with a pivot-distance index.

Largest inner products are nearest neighbours after one more coordinate makes
all indexed vectors equally long: |q'-x'|^2 = |q|^2 + M^2 - 2<q,x>.  Every
vector is keyed by its nearest pivot and its distance to it; the distances of
a pivot are cut into annuli.  A query first looks into the annulus nearest to
it, which gives a bound on its k-th distance.  It then expands only into
annuli whose triangle-inequality bound |d(q,p) - d(x,p)| does not exceed that
distance; the others cannot hold a better vector.

Annuli are spread over units of a bounded number of vectors.  Queries and
vectors of a unit meet in one task, vectors first, queries streaming past.
The driver holds the pivots and one row per annulus, both of fixed number.

Defined results
    * vectors that are null or hold null or non-finite components, and rows
      without id, take no part; vectors of different length are compared as
      if padded with zeros.
    * the query's own rows are those with its id; of repeated rows each
      counts as a candidate, and repeated queries are answered once.
    * fewer than k candidates: all of them.  Ties go to the smaller id.
    * scores beyond 64 bits are cut off at the largest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import common

K = 20
SCALE = 64
#: Vectors the pivots are chosen from, pivots, and annuli of each pivot.
PIVOT_SAMPLE, PIVOTS, ANNULI = 2048, 32, 24
#: Vectors in a unit, at least and at most.
UNIT_MIN, UNIT_MAX = 2048, 32_768
_EXACT = 2.0**53


def _valid(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): quantised vectors, exact in double."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    quantised = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), quantised.alias("v"))


def choose_pivots(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Farthest-first choice, then one averaging step, as k-means would."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    near = distances(sample, pivots).argmin(1)
    return np.array([sample[near == i].mean(0) if (near == i).any() else pivots[i] for i in range(len(pivots))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """List column as a matrix of ``dim`` columns, short rows padded."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out, at = np.zeros((len(lengths), dim)), 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64, cut off at its ends."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if reach < _EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Index:
    """Pivots and bounds of the annuli, small enough to go with each task."""

    def __init__(self, dim: int, longest: float, pivots: np.ndarray):
        self.dim, self.longest, self.pivots = dim, longest, pivots
        self.step = np.ones(len(pivots))
        self.low = self.high = self.size = self.units = None
        self.slack = 1e-6 * (1.0 + longest)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Indexed vectors with the coordinate that makes them equally long."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))])

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annulus, distance to the nearest pivot)."""
        d = distances(self.lift(x), self.pivots)
        pivot = d.argmin(1)
        own = d[np.arange(len(x)), pivot]
        ring = np.minimum((own / self.step[pivot]).astype(np.int64), ANNULI - 1)
        return pivot * ANNULI + ring, own

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Lower bound on the distance to anything in each annulus."""
        d = np.repeat(distances(np.column_stack([q, np.zeros(len(q))]), self.pivots), ANNULI, axis=1)
        bound = np.maximum(np.maximum(d - self.high, self.low - d), 0) - self.slack
        bound[:, self.size == 0] = np.inf
        return bound

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance that belongs to an inner product."""
        return np.sqrt(np.maximum((q * q).sum(1) + self.longest**2 - 2 * score, 0)) + self.slack


def _visit(units: DataFrame, asked: DataFrame, dim: int, k: int, parts: int) -> DataFrame:
    """(query_id, id, score): the best k of each unit for each query sent there.

    ``units`` (unit, id, v) and ``asked`` (unit, id, v, least) are sorted so
    that the vectors of a unit come before its queries, which are then read in
    batches.  Scores below ``least``, the k-th found so far, are not returned.
    """
    both = units.select("unit", F.lit(0).alias("side"), "id", "v", F.lit(None).cast("long").alias("least")).unionByName(
        asked.select("unit", F.lit(1).alias("side"), "id", "v", "least")
    )
    dealt = both.repartition(parts, "unit").sortWithinPartitions("unit", "side", "id")

    def run(batches):
        unit, ids, rows = None, [], []
        base_ids = base = None
        for batch in batches:
            if not batch.num_rows:
                continue
            units_, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            all_ids, matrix = batch.column(2).to_numpy(), _rows(batch.column(3), dim)
            least = batch.column(4).fill_null(np.iinfo(np.int64).min).to_numpy()
            cuts = np.flatnonzero((units_[1:] != units_[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if units_[a] != unit:
                    unit, ids, rows, base = units_[a], [], [], None
                if sides[a] == 0:
                    ids.append(all_ids[a:b].copy())
                    rows.append(matrix[a:b].copy())
                    continue
                if not ids:
                    continue
                if base is None:
                    base_ids, base = np.concatenate(ids), np.concatenate(rows)
                for c in range(a, b, 256):
                    q_ids, q = all_ids[c : min(b, c + 256)], matrix[c : min(b, c + 256)]
                    yield _best(q_ids, inner_products(q, base), base_ids, k, least[c : min(b, c + 256)])

    return dealt.mapInArrow(run, "query_id long, id long, score long")


def _best(q_ids, scores, ids, k, least):
    """The k best of each row, ties to the smaller id, own id left out.

    ``ids`` ascend, so that one integer key orders by score and then by id.
    """
    n = scores.shape[1]
    take = min(k, n)
    own = ids[None, :] == q_ids[:, None]
    if int(np.abs(scores).max(initial=0)) < (1 << 62) // (n + 1):
        key = scores * n - np.arange(n)
        key[own] = np.iinfo(np.int64).min
        col = np.argpartition(key, n - take, axis=1)[:, n - take :]
    else:
        col = np.array([sorted(range(n), key=lambda j: (own[i, j], -int(scores[i, j]), j))[:take] for i in range(len(q_ids))])
    row = np.repeat(np.arange(len(q_ids)), take)
    col = col.reshape(-1)
    kept = ~own[row, col] & (scores[row, col] >= least[row])
    row, col = row[kept], col[kept]
    columns = [pa.array(q_ids[row]), pa.array(ids[col]), pa.array(scores[row, col])]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` selects.

    Exact: every annulus that could hold one of the best k is visited.
    """
    spark = vectors.sparkSession
    flagged = vectors.withColumn("_is_query", is_query)
    base = common.durable(_valid(flagged, id_col, vec_col, scale), "knn-rows")
    queries = _valid(flagged.where("_is_query"), id_col, vec_col, scale).dropDuplicates(["id"])
    queries = common.durable(queries, "knn-queries")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(squares).alias("m")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"] or not facts["dim"]:
        return empty
    sample = base.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()
    index = Index(facts["dim"], facts["m"] ** 0.5, np.zeros((1, facts["dim"] + 1)))
    picked = np.zeros((len(sample), index.dim))
    for i, r in enumerate(sample):
        picked[i, : len(r["v"])] = r["v"]
    index.pivots = choose_pivots(index.lift(picked), PIVOTS)
    index.step = np.full(len(index.pivots), 1.0)
    reach = distances(index.lift(picked), index.pivots).min(1)
    index.step[:] = max(float(reach.max()) / ANNULI, 1e-9)

    def keyed(batches):
        for batch in batches:
            annulus, own = index.key(_rows(batch.column(1), index.dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(annulus), pa.array(own)], names=["id", "v", "annulus", "own"]
            )

    keys = common.durable(base.mapInArrow(keyed, "id long, v array<double>, annulus long, own double"), "knn-keys")
    cells = len(index.pivots) * ANNULI
    index.low, index.high = np.full(cells, np.inf), np.full(cells, -np.inf)
    index.size = np.zeros(cells, np.int64)
    for r in keys.groupBy("annulus").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        index.low[r["annulus"]], index.high[r["annulus"]], index.size[r["annulus"]] = r["a"], r["b"], r["n"]

    # sorted annuli fill units; an annulus above the limit is spread over several
    limit = int(min(UNIT_MAX, max(UNIT_MIN, facts["n"] / 64)))
    index.units, unit, room = np.zeros((cells, 2), np.int64), 0, limit
    for cell in range(cells):
        n = int(index.size[cell])
        if n > room and room < limit:
            unit, room = unit + 1, limit
        pieces = max(1, -(-n // limit))
        index.units[cell] = unit, pieces
        if pieces > 1:
            unit, room = unit + pieces, limit
        else:
            room -= n
    table = spark.createDataFrame(
        [(c, int(u), int(p)) for c, (u, p) in enumerate(index.units) if index.size[c]], "annulus long, unit long, pieces long"
    )
    spread = F.col("unit") + F.pmod(F.xxhash64("id"), "pieces")
    units = keys.join(F.broadcast(table), "annulus").select(spread.alias("unit"), "id", "v")
    units = common.durable(units, "knn-units")
    parts = int(max(8, min(4096, unit + 1)))

    def route(first: bool):
        def run(batches):
            for batch in batches:
                q = _rows(batch.column(1), index.dim)
                bound = index.bounds(q)
                if first:
                    wanted = np.zeros(bound.shape, bool)
                    wanted[np.arange(len(q)), bound.argmin(1)] = True
                else:
                    reach = index.reach(q, batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                    wanted = bound <= np.where(np.isnan(reach), np.inf, reach)[:, None]
                    wanted &= index.size > 0
                row, cell = np.nonzero(wanted)
                count = index.units[cell, 1]
                row, start = np.repeat(row, count), np.repeat(index.units[cell, 0], count)
                within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                pairs = np.unique(np.column_stack([row, start + within]), axis=0)
                picked = batch.take(pa.array(pairs[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 1]), picked.column(0), picked.column(1), picked.column(2)], names=["unit", "id", "v", "least"]
                )

        return run

    asked = "unit long, id long, v array<double>, least long"
    unbounded = queries.select("id", "v", F.lit(None).cast("long").alias("score"))
    near = _visit(units, unbounded.mapInArrow(route(True), asked), index.dim, k, parts)
    kth = _ranked(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    bounded = common.durable(queries.join(kth, "id", "left").select("id", "v", "score"), "knn-bounded")
    found = _visit(units, bounded.mapInArrow(route(False), asked), index.dim, k, parts)
    return _ranked(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
