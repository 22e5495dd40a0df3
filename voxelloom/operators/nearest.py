"""Mutual nearest neighbours of two sets of points in the plane.

Points are dealt to the leaves of a k-d tree, so a leaf holds about ``UNIT`` of
them however dense they lie.  Each point asks the leaf whose box is nearest,
then every leaf that this answer cannot exclude; inside a leaf the search goes
the same way over small boxes.  A bound is found with the rounding of the
distances themselves, so it never exceeds one, and results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from voxelloom.session import ensure_checkpoint_dir

#: Points that a leaf is meant to hold, leaves at most, and points that the tree is made from.
UNIT = 32_768
LEAVES = 1024
SAMPLE = 65_536
#: Points that ask one leaf in one task; where more come, they are dealt to several.
ASKS = 131_072
#: Points in a box of the search inside a leaf, and distances taken at once.
BOX = 64
AT_ONCE = 1 << 20
SIDES = ("fixed", "moving")
FIELDS = "side int, id long, r double, c double, d double, other long, leaf int"


def split(points: np.ndarray, size: int) -> np.ndarray:
    """Rows (axis, cut, left, right) of a k-d tree over distinct points; a leaf has axis -1 and its number as cut."""
    nodes, leaves, todo = [], 0, [(points, -1, 0)]
    while todo:
        part, parent, at = todo.pop()
        if parent >= 0:
            nodes[parent][at] = len(nodes)
        with np.errstate(over="ignore"):
            spread = np.ptp(part, axis=0) if len(part) else np.zeros(2)
        axis = int(np.argmax(spread))
        if len(part) <= size or not spread[axis] > 0:
            nodes.append([-1, leaves, 0, 0])
            leaves += 1
            continue
        line = np.sort(part[:, axis])
        cut = line[len(line) // 2 - 1]
        if cut == line[-1]:
            cut = line[np.searchsorted(line, cut) - 1]
        todo += [(part[part[:, axis] > cut], len(nodes), 3), (part[part[:, axis] <= cut], len(nodes), 2)]
        nodes.append([axis, cut, 0, 0])
    return np.array(nodes, float)


def leaf_of(nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Number of the leaf that each point falls into."""
    axis, cut, below = nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2:].astype(int)
    at, open_ = np.zeros(len(points), int), np.arange(len(points))
    while len(open_ := open_[axis[at[open_]] >= 0]):
        node = at[open_]
        at[open_] = below[node, (points[open_, axis[node]] > cut[node]).astype(int)]
    return cut[at].astype(int)


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each point to each box; empty boxes are infinitely far."""
    with np.errstate(over="ignore"):
        r, c = [np.maximum(np.maximum(low[None, :, k] - points[:, None, k], points[:, None, k] - high[None, :, k]), 0.0) for k in (0, 1)]
        return np.sqrt(r * r + c * c)


def search(points: np.ndarray, ids: np.ndarray, xy: np.ndarray, max_dist: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of the nearest of ``xy`` below ``max_dist`` for each point, ties to the smaller id; else inf and -1."""
    best, other = np.full(len(points), np.inf), np.full(len(points), -1, np.int64)
    if not len(points) or not len(xy):
        return best, other
    order = np.argsort(ids, kind="stable")
    ids, xy = ids[order], xy[order]
    box = leaf_of(split(np.unique(xy, axis=0), BOX), xy)
    order = np.argsort(box, kind="stable")
    ids, xy, box = ids[order], xy[order], box[order]
    starts = np.flatnonzero(np.diff(box, prepend=-1))
    sizes = np.diff(starts, append=len(box))
    low, high = np.minimum.reduceat(xy, starts), np.maximum.reduceat(xy, starts)
    place = starts[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)

    def in_box(who, where):
        """Best of a box for each pair; the rows of a box go by id, so the first is the smallest."""
        d, k = np.empty(len(who)), np.empty(len(who), int)
        step = max(1, AT_ONCE // place.shape[1])
        for i in range(0, len(who), step):
            rows = place[where[i : i + step]]
            with np.errstate(over="ignore"):
                gap = xy[rows] - points[who[i : i + step], None]
                gap = np.sqrt(gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1])
            at = np.argmin(gap, axis=1)[:, None]
            d[i : i + step], k[i : i + step] = np.take_along_axis(gap, at, 1)[:, 0], np.take_along_axis(rows, at, 1)[:, 0]
        return d, ids[k]

    step = max(1, AT_ONCE // len(starts))
    for i in range(0, len(points), step):
        gaps = box_gaps(points[i : i + step], low, high)
        first = np.argmin(gaps, axis=1)
        all_ = np.arange(len(first))
        d, k = in_box(all_ + i, first)
        gaps[all_, first] = np.inf
        who, where = np.nonzero((gaps <= d[:, None]) & (gaps < max_dist))
        more_d, more_k = in_box(who + i, where)
        who, d, k = np.concatenate([all_, who]), np.concatenate([d, more_d]), np.concatenate([k, more_k])
        order = np.lexsort((k, d, who))
        order = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
        best[i : i + step], other[i : i + step] = d[order], k[order]
    best[~(best < max_dist)] = np.inf
    other[np.isinf(best)] = -1
    return best, other


def _xy(table) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in ("r", "c")]).astype(float).reshape(-1, 2)


def _rows(table, leaf, d=None, other=None) -> pa.Table:
    """``table`` with these leaves and answers; inf is no answer."""
    none = np.isinf(d) if d is not None else np.ones(len(leaf), bool)
    d, other = (d, other) if d is not None else (np.zeros(len(leaf)), np.zeros(len(leaf), np.int64))
    head = [table.column(n) for n in ("side", "id", "r", "c")]
    tail = [pa.array(d, pa.float64(), mask=none), pa.array(other, pa.int64(), mask=none), pa.array(leaf, pa.int32())]
    return pa.Table.from_arrays([*head, *tail], names=["side", "id", "r", "c", "d", "other", "leaf"])


def _ask_first(xy: np.ndarray, side: np.ndarray, boxes: np.ndarray, max_dist: float) -> np.ndarray:
    """Leaf of the other side whose box is nearest; -1 where none is below ``max_dist``."""
    leaf = np.full(len(xy), -1)
    step = max(1, AT_ONCE // boxes.shape[1])
    for s in (0, 1):
        mine = np.flatnonzero(side == s)
        for i in range(0, len(mine), step):
            rows = mine[i : i + step]
            gaps = box_gaps(xy[rows], *boxes[1 - s].swapaxes(0, 1))
            at = np.argmin(gaps, axis=1)
            leaf[rows] = np.where(gaps[np.arange(len(at)), at] < max_dist, at, -1)
    return leaf


def _visit(asks: DataFrame, targets: DataFrame, counts: dict, kernel) -> DataFrame:
    """``kernel`` on the points that ask a leaf and the leaf's points; points above ``ASKS`` are dealt to several tasks."""
    spark = asks.sparkSession
    many = {k: -(-n // ASKS) for k, n in counts.items() if n > ASKS}
    asks, targets = asks.withColumn("part", F.lit(0)), targets.withColumn("part", F.lit(0))
    if many:
        dealt = F.broadcast(spark.createDataFrame([(*k, n) for k, n in many.items()], "side int, leaf int, parts int"))
        parts = F.coalesce("parts", F.lit(1))
        asks = asks.join(dealt, ["side", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("id", "r", "c"), parts).cast("int")).drop("parts")
        targets = targets.join(dealt, ["side", "leaf"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    keys = ["side", "leaf", "part"]
    return asks.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(kernel, FIELDS)


def _tree(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Tree over a sample of the points, the sample's (side, r, c) and the points' number; it sets the size of leaves, no result."""
    n = points.count()
    share = SAMPLE / max(n, 1)
    some = points.select("side", "r", "c")
    some = some if share >= 1 else some.sample(share, seed=7)
    seen = some.toArrow()
    xy = _xy(seen)
    size = max(UNIT * len(xy) // max(n, 1), 2 * len(xy) // LEAVES, 1)
    return split(np.unique(xy, axis=0), size), np.column_stack([seen.column("side").to_numpy(), xy]), n


def _boxes(targets: DataFrame, leaves: int) -> np.ndarray:
    """Boxes of the targets by their side and leaf: [side, leaf, low or high, axis]; empty ones are infinitely far."""
    ends = [f(a).alias(f"{f.__name__}_{a}") for f in (F.min, F.max) for a in "rc"]
    boxes = np.full((2, leaves, 2, 2), np.inf)
    for row in targets.groupBy("of", "leaf").agg(*ends).collect():
        boxes[row["of"], row["leaf"]] = [[row["min_r"], row["min_c"]], [row["max_r"], row["max_c"]]]
    return boxes


def mutual_nearest(fixed: DataFrame, moving: DataFrame, max_dist: float) -> DataFrame:
    """Pairs (moving, fixed, d) that are each other's nearest below ``max_dist`` (strictly).

    Points are (id, r, c) with whole-numbered ids; ties go to the smaller id,
    and an id with several points counts by the nearest of them.  Points with
    a null or non-finite part have no neighbours.
    """
    for side in (fixed, moving):
        if not isinstance(side.schema["id"].dataType, IntegralType):
            raise TypeError("ids must be whole numbers")
    ensure_checkpoint_dir(fixed.sparkSession)
    limit = float(max_dist)
    columns = [F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in "rc"]]
    fixed_, moving_ = [s.select(F.lit(i).alias("side"), *columns) for i, s in enumerate((fixed, moving))]
    finite = " AND ".join(["id IS NOT NULL", *[f"abs({a}) < double('inf')" for a in "rc"]])
    points = fixed_.unionByName(moving_).where(finite).checkpoint()
    nodes, seen, n = _tree(points)
    leaves = int((nodes[:, 0] < 0).sum())

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(nodes, _xy(b)), pa.int32())], names=[*b.schema.names, "leaf"])

    # what a side is asked for stands under the side that asks
    targets = points.groupBy((1 - F.col("side")).alias("side"), F.col("side").alias("of"), "r", "c").agg(F.min("id").alias("id"))
    targets = targets.mapInArrow(deal, "side int, of int, r double, c double, id long, leaf int")
    boxes = _boxes(targets, leaves)
    targets = targets.drop("of")

    def ask(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            rows = _rows(t, _ask_first(_xy(t), t.column("side").to_numpy(), boxes, limit))
            yield from rows.to_batches()

    def answer(asks, target):
        d, other = search(_xy(asks), target.column("id").to_numpy(), _xy(target), limit)
        return _rows(asks, np.full(len(d), -1), d, other)

    def first(asks, target):
        """Answers, and a row for every other leaf that an answer cannot exclude."""
        if not len(asks):
            return answer(asks, target)
        own, side = asks.column("leaf")[0].as_py(), asks.column("side")[0].as_py()
        xy, out = _xy(asks), answer(asks, target)
        reach = out.column("d").to_numpy(zero_copy_only=False)
        reach = np.where(np.isnan(reach), np.inf, reach)
        tables, step = [out], max(1, AT_ONCE // leaves)
        for i in range(0, len(xy), step):
            gaps = box_gaps(xy[i : i + step], *boxes[1 - side].swapaxes(0, 1))
            gaps[:, own] = np.inf
            who, where = np.nonzero((gaps <= reach[i : i + step, None]) & (gaps < limit))
            tables.append(_rows(asks.take(pa.array(who + i)), where))
        return pa.concat_tables(tables)

    guess = _ask_first(seen[:, 1:], seen[:, 0], boxes, limit)
    found, many = np.unique(np.column_stack([seen[:, 0], guess]).astype(int), axis=0, return_counts=True)
    counts = {tuple(k): int(m * n / len(seen)) for k, m in zip(found.tolist(), many.tolist(), strict=True)}
    asks = points.mapInArrow(ask, FIELDS).where("leaf >= 0")
    answers = _visit(asks, targets, counts, first)
    if leaves > 1:
        made = answers.checkpoint()
        further = made.where("leaf >= 0")
        counts = {(r["side"], r["leaf"]): r["count"] for r in further.groupBy("side", "leaf").count().collect()}
        answers = made.where("leaf < 0").unionByName(_visit(further, targets, counts, answer))
    best = answers.where("d IS NOT NULL").groupBy("side", "id").agg(F.min(F.struct("d", "other")).alias("best"))
    of_f, of_m = [
        best.where(F.col("side") == i).select(F.col("id").alias(mine), F.col("best.other").alias(theirs), F.col("best.d").alias(d))
        for i, mine, theirs, d in ((0, "fixed", "moving", "back"), (1, "moving", "fixed", "d"))
    ]
    ids = [F.col(s).cast(t.schema["id"].dataType).alias(s) for s, t in (("moving", moving), ("fixed", fixed))]
    return of_m.join(of_f, ["moving", "fixed"]).select(*ids, "d")
