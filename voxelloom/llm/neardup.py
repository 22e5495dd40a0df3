"""Operator 7 - near-duplicate documents with SetSketch registers.

The set of a document is its distinct word shingles.  A SetSketch register is
an exponentially spaced, truncated minimum of the set's hashes: registers merge
by maximum and agree with a probability close to the Jaccard similarity.  Runs
of registers are banded; documents that share a band value are candidates,
whose similarity is first estimated by maximum likelihood from the registers
that are larger, smaller and equal and then confirmed on the full sets.

Groups are never expanded into all pairs.  Documents of equal sets are one
node.  In each band bucket every node is compared with one leader, the node
that collides most.  What that leaves unconnected meets, register against
register inside bounded blocks, the other nodes of its buckets.  Only nodes that
look similar to another one leave a block; they come back to it with their full
sets, on which the block confirms its pairs itself.  A pair is passed over only
if confirmed links connect it already, and of the confirmed links a spanning
forest leaves the block: fewer than it has nodes, and no link between different
components is lost.

Defined results
    * null text or text without words: empty set, linked with nothing.
    * fewer words than a shingle: the whole sequence is the one shingle.
    * equal sets (also of repeated rows) are linked; component_id is the
      smallest id, a null id counting only where a component has no other.
    * empty table: no rows.  Other columns never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common, graph, textkit

WIDTH = 5
#: Documents are linked with 100 * intersection >= PERCENT * union.
PERCENT = 80
REGISTERS = 320
#: Chance of sharing no band, at most, of two documents at exactly the threshold.
MISS = 5e-6
#: Spacing of the register values and their scale and largest value.
BASE, SCALE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Estimates this many standard deviations below the threshold are dropped.
DEVIATIONS = 4.26
#: Nodes of each side that meet in one block, and shingles of their sets (8 bytes each).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Tasks that the members of one hub may be dealt to for the check.
SALTS = 64
#: Rows of up to 40 bytes that are broadcast (about 20 MB as a hash table).
BROADCAST_ROWS = 200_000
#: Nodes with more than this share of all rows, so fewer than its inverse, are broadcast.
HOT_SHARE = 1 / 1024

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with MISS at most."""
    for rows in range(16, 1, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def floor_of(percent: int) -> float:
    """The least estimate that still goes to the check on full sets."""
    at = percent / 100
    return at - DEVIATIONS * (at * (1 - at) / REGISTERS) ** 0.5


def shingle_sets(texts: list, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for _, part in textkit.chunks(texts):
        t = textkit.tokenize(part)
        wide = textkit.combine(t.hashes, width) if len(t.hashes) >= width else None
        for i in range(len(part)):
            a, b = t.offsets[i], t.offsets[i + 1]
            if b - a >= width:
                out.append(np.unique(wide[a : b - width + 1]))
            elif b > a:
                out.append(textkit.combine(t.hashes[a:b], int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of one set, uint16."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        block = (short[i : i + 512, None] ^ _FLIP) * _MULTIPLY
        np.minimum(low, block.min(0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / SCALE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum.reduce(sketches)


def _probability(x: np.ndarray) -> np.ndarray:
    inner = np.clip(1 - x * (BASE - 1) / BASE, 1e-12, None)
    return -np.log(inner) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of register rows, sizes known."""
    larger, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    tried = np.linspace(0.0, 1.0, 129)[None, :] * top
    above, below = _probability(np.clip(u - v * tried, 0, 1)), _probability(np.clip(v - u * tried, 0, 1))
    level = np.clip(1 - above - below, 1e-12, 1)
    fit = larger * np.log(np.clip(above, 1e-12, 1)) + smaller * np.log(np.clip(below, 1e-12, 1)) + equal * np.log(level)
    return np.take_along_axis(np.broadcast_to(tried, fit.shape), fit.argmax(1)[:, None], 1)[:, 0]


def _sketch(texts: list, width: int) -> list:
    sizes, nodes, sketches = [], [], []
    for s in shingle_sets(texts, width):
        sizes.append(len(s))
        if not len(s):
            nodes.append(None)
            sketches.append(None)
            continue
        spread = textkit.mix64(s + np.uint64(0x51ED270B))
        total, folded = int(spread.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(s)) ^ len(s)
        nodes.append(total.to_bytes(8, "big") + folded.to_bytes(8, "big"))
        sketches.append(registers(s).tobytes())
    return [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _close(percent: int, n_a, n_b):
    """Sizes that allow the threshold."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _maybe_broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` (narrow, durable) with a broadcast hint if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _canonical(pairs: DataFrame) -> DataFrame:
    """(hub, member) pairs once each, as (a, b, hub) with a < b."""
    ends = F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")
    return pairs.groupBy(*ends).agg(F.min("hub").alias("hub"))


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b, hub) whose estimated similarity is at least ``floor``."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "hub", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (3, 4))
            good = estimate(_matrix(batch.column(5)), _matrix(batch.column(6)), n_a, n_b) >= floor
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(3)], names=["a", "b", "hub"])

    return both.mapInArrow(run, "a binary, b binary, hub binary")


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of every node of ``wanted`` (node)."""
    wanted = common.durable(wanted.distinct().join(nodes, "node").select("node", F.col("rep").alias("w_id"), F.col("text_key").alias("w_key")), "dup-wanted")
    small = _maybe_broadcast(wanted)
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    texts = source.join(small, source["doc_id"].eqNullSafe(small["w_id"]) & (source["key"] == small["w_key"]))
    return common.durable(texts.select("node", F.encode("text", "UTF-8").alias("text")).dropDuplicates(["node"]), "dup-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) that the full shingle sets confirm.

    The text of a hub goes once to each task that has members of it and is
    followed there by the members' texts.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = _texts_of(ends, nodes, docs)
    member = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    dealt = pairs.select("hub", member.alias("member")).withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    hubs = dealt.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub")
    members = dealt.join(texts.withColumnRenamed("node", "member"), "member")
    columns = ["hub", "salt", "member", "text"]
    rows = hubs.withColumn("member", F.lit(None).cast("binary")).select(columns).unionByName(members.select(columns))
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())

    def run(batches):
        own = None
        for batch in batches:
            hub, other, text = (batch.column(i).to_pylist() for i in (0, 2, 3))
            a, b = [], []
            for h, m, s in zip(hub, other, shingle_sets(text, width), strict=True):
                if m is None:
                    own = s
                    continue
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                shared = int((own[at] == s).sum())
                if 100 * shared >= percent * (len(own) + len(s) - shared):
                    a.append(h)
                    b.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the ``others`` (sorted sets, none empty) are linked with ``own``."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= percent * (len(own) + sizes - shared)


def _sides(group: pa.Table) -> list[dict]:
    """The two sides of a block, the open nodes first, as arrays."""
    seeks, codes = group.column("seeks").to_numpy(), {}
    names = group.column("node").to_pylist()
    rank = {v: i for i, v in enumerate(sorted(set(names)))}
    labels = [codes.setdefault(v, len(codes)) for v in group.column("label").to_pylist()]
    out = []
    for flag in (True, False):
        at = np.flatnonzero(seeks == flag)
        part = group.take(pa.array(at)).combine_chunks()
        out.append({
            "at": at, "node": [names[i] for i in at], "rank": np.array([rank[names[i]] for i in at], np.int64),
            "code": np.array([labels[i] for i in at], np.int64), "n": part.column("n").to_numpy().astype(float),
            "regs": np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS),
            "leads": part.column("leads").to_numpy().astype(bool), "open": part.column("open").to_numpy().astype(bool),
            "set": part.column("set").to_pylist() if "set" in part.column_names else None,
        })
    return out


def _candidates(side: dict, other: dict, band: int, banded: tuple[int, int], floor: float, percent: int):
    """For each open node its (places in ``other``, estimates) above ``floor``.

    Only nodes of another label count that do not lead the bucket, which every
    node has met, and whose first common band this bucket is.  Two open nodes
    meet in one of their two blocks, from the smaller one.
    """
    n_bands, n_rows = banded
    for i, (code, rank, n) in enumerate(zip(side["code"], side["rank"], side["n"], strict=True)):
        apart = (other["code"] != code) & ~other["leads"] & (~other["open"] | (other["rank"] > rank))
        at = np.flatnonzero(apart & (np.minimum(other["n"], n) * 100 >= np.maximum(other["n"], n) * percent))
        if len(at):
            agree = other["regs"][at] == side["regs"][i]
            rough = agree.mean(1) >= floor - 0.05
            at, agree = at[rough], agree[rough]
        if len(at):
            bands = agree[:, : n_bands * n_rows].reshape(len(at), n_bands, n_rows).all(2)
            at = at[bands.argmax(1) == band]
        if len(at):
            close = estimate(np.repeat(side["regs"][i : i + 1], len(at), 0), other["regs"][at], np.full(len(at), n), other["n"][at])
            good = close >= floor
            if good.any():
                yield i, at[good], close[good]


def _confirmed(found, side: dict, other: dict, percent: int):
    """(i, j) of the links that full sets confirm, without those that close a circle."""
    sets, sets_y = ([np.frombuffer(b, np.uint64) for b in s["set"]] for s in (side, other))
    codes, codes_y = side["code"].tolist(), other["code"].tolist()
    forest = graph.Forest()
    for i, at, close in found:
        at, size = at[np.argsort(-close, kind="stable")].tolist(), 1
        while at:
            own = forest.root(codes[i])
            at = [j for j in at if forest.root(codes_y[j]) != own]
            some, at, size = at[:size], at[size:], size * 4
            if some:
                linked = _similar(sets[i], [sets_y[j] for j in some], percent)
                yield from ((i, j) for j, good in zip(some, linked, strict=True) if good and forest.join(codes[i], codes_y[j]))


def _block_links(live: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed links (a, b) that connect all similar nodes that share a bucket.

    In each bucket of several components the nodes outside the leader's are
    the open side; it meets all nodes of the bucket in blocks of about BLOCK
    nodes and BLOCK_SHINGLES shingles a side.
    """
    banded, floor = banding(percent), floor_of(percent)
    known = live.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rule = known.groupBy("bkey").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"),
        F.max(F.when(F.col("leads"), F.col("label"))).alias("main"),
    ).where("l0 <> l1 AND size > 2")  # two nodes have met already
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("volume") / F.lit(BLOCK_SHINGLES))).cast("int")
    rule = _maybe_broadcast(common.durable(rule.select("bkey", blocks.alias("blocks"), "main"), "dup-open"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = known.join(rule, "bkey").join(nodes.select("node", "regs"), "node").withColumn("own", own)
    rows = rows.withColumn("open", F.col("label") != F.col("main"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["bkey", "band", "node", "label", "n", "leads", "open", "regs"]
    seekers = rows.where("open").select(*columns, F.lit(True).alias("seeks"), F.col("own").alias("x"), F.explode(every).alias("y"))
    others = rows.select(*columns, F.lit(False).alias("seeks"), F.explode(every).alias("x"), F.col("own").alias("y"))

    def pairs(group: pa.Table, side: dict, other: dict):
        return _candidates(side, other, group.column("band")[0].as_py(), banded, floor, percent)

    def meet(group: pa.Table) -> pa.Table:
        side, other = _sides(group)
        stays = np.zeros(group.num_rows, bool)
        for i, at, _ in pairs(group, side, other):
            stays[side["at"][i]] = stays[other["at"][at]] = True
        return group.filter(pa.array(stays))

    def confirm(group: pa.Table) -> pa.Table:
        side, other = _sides(group)
        links = list(_confirmed(pairs(group, side, other), side, other, percent))
        ends = [side["node"][i] for i, _ in links], [other["node"][j] for _, j in links]
        return pa.table({name: pa.array(nodes, pa.binary()) for name, nodes in zip("ab", ends, strict=True)})

    both = seekers.unionByName(others)
    met = common.durable(both.groupBy("bkey", "x", "y").applyInArrow(meet, both.schema), "dup-blocks")
    texts = _texts_of(met.select("node"), nodes, docs)

    def shingled(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    # written first, so that no task runs two Python workers at once
    sets = common.durable(texts.mapInArrow(shingled, "node binary, set binary"), "dup-sets")
    return met.join(sets, "node").groupBy("bkey", "x", "y").applyInArrow(confirm, "a binary, b binary")


def _nodes(base: DataFrame) -> DataFrame:
    """One row for each distinct set: its smallest row, copies, smallest id and registers."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = base.where("n > 0").groupBy("node").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs")
    )
    return nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "copies", "n", "regs")


def _buckets(nodes: DataFrame, percent: int) -> DataFrame:
    """(bkey, band, node, n, leader, n_leader, leads) of buckets with at least two nodes."""
    n_bands, n_rows = banding(percent)
    at = F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1)))
    bands = nodes.select("node", "n", "regs", at.alias("band")).select(
        F.xxhash64("band", F.substring(F.col("regs"), F.col("band") * (2 * n_rows) + 1, F.lit(2 * n_rows))).alias("bkey"), "band", "node", "n",
    )
    shared = common.durable(bands.groupBy("bkey").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "dup-buckets")
    live = common.durable(bands.join(_maybe_broadcast(shared), "bkey"), "dup-live")
    # every node meets the leader of its bucket: the one that collides most
    weight = live.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = live.join(weight, "node").groupBy("bkey").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    leaders = leaders.select("bkey", F.col("top.node").alias("leader"), F.col("top.n").alias("n_leader"))
    led = live.join(leaders, "bkey").withColumn("leads", F.col("node") == F.col("leader"))
    return common.durable(led.drop("size"), "dup-led")


def _linked(nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, label) of every node with a link; label: smallest node of its component."""
    live, floor = _buckets(nodes, percent), floor_of(percent)
    met = live.where(~F.col("leads") & _close(percent, F.col("n"), F.col("n_leader")))
    met = _canonical(met.select(F.col("leader").alias("hub"), F.col("node").alias("member")))
    tested = common.durable(_estimated(met, nodes, floor), "dup-met")
    # written first, so that no task runs two Python workers at once
    links = common.durable(_verified(tested, nodes, docs, percent, width), "dup-links")
    labels = common.durable(graph.components(links), "dup-labels")
    found = common.durable(_block_links(live, labels, nodes, docs, percent, width), "dup-found")
    if found.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return common.durable(graph.components(known.unionByName(found)), "dup-labels")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """Per row: doc_id, text_key, n and of its component, if it has one, the
    smallest id (``component_id``) and smallest row (``first``)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = {"text_key": F.xxhash64("text")}
    base = common.durable(
        textkit.map_texts(docs, lambda texts: _sketch(texts, width), "n long, node binary, regs binary", keep=key), "dup-sketches"
    )
    nodes = common.durable(_nodes(base), "dup-nodes")
    labels = _linked(nodes, docs, percent, width)

    # the answer is found on nodes and then given to rows
    place = F.struct(F.col("rep").isNull().alias("last"), F.col("rep").alias("doc_id"), "text_key")
    labelled = nodes.select("node", "rep", "text_key", "copies").join(labels, "node", "left").where("label IS NOT NULL OR copies > 1")
    labelled = common.durable(labelled.withColumn("label", F.coalesce("label", "node")), "dup-labelled")
    groups = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.min(place).alias("first"))
    answers = labelled.select("node", "copies", "label").join(_maybe_broadcast(common.durable(groups, "dup-groups")), "label")
    answers = common.durable(answers.drop("label"), "dup-answers")
    slim = base.select("doc_id", "text_key", "n", "node")
    least = slim.count() * HOT_SHARE
    hot = answers.where(F.col("copies") > least).select("node", F.struct("component_id", "first").alias("hot"))
    rest = answers.where(F.col("copies") <= least).select(F.col("node").alias("key"), F.struct("component_id", "first").alias("cold"))
    rows = slim.join(F.broadcast(hot), "node", "left")
    # rows that need no partner are spread by their own identity
    spread = F.concat(F.lit("-").cast("binary"), F.xxhash64("doc_id", "text_key").cast("string").cast("binary"))
    rows = rows.withColumn("key", F.when(F.col("hot").isNull() & F.col("node").isNotNull(), F.col("node")).otherwise(spread))
    out = rows.join(rest, "key", "left").withColumn("own", F.coalesce("hot", "cold"))
    return out.select("doc_id", "text_key", "n", "own.component_id", "own.first")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id, kept."""
    out = _grouped(docs, id_col, text_col, percent, width).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def remove_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """One row of each component: the smallest id, of its texts the smallest key.

    Of equal rows and of rows that differ in other columns only, the smallest
    stays.  Rows with empty sets are linked with nothing and all stay.
    """
    linked = _grouped(docs, id_col, text_col, percent, width).where("first IS NOT NULL")
    keys = linked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("first").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    marked = keys.withColumn("_stays", stays).where("copies > 1 OR NOT _stays")
    marked = common.durable(marked.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), "_stays"), "dup-gone")
    few = _maybe_broadcast(marked)
    match = docs[id_col].eqNullSafe(F.col("_gone_id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("_gone_key"))
    single = docs.join(few, match, "left_anti")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    repeated = docs.join(few.where("_stays"), match).groupBy("_gone_id", "_gone_key").agg(F.min(row).alias("_row"))
    return single.unionByName(repeated.select("_row.*"))
