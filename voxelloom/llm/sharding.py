"""Operator 8 - sharding by best-fit-decreasing bin packing.

Documents of equal text form an indivisible group.  Groups sorted by size
enter the bin with the tightest remaining capacity, found in a balanced tree;
the smallest capacity that needs no more than the wanted number of shards is
used, so that shard sizes come out nearly equal.

Only a bounded list is packed on the driver: groups above 1/64 of a mean shard
one by one (fewer than 64 x shards of them can exist), all smaller groups in
parcels of whole groups, whose number is fixed.

Defined results
    * null text: no bytes, no checksum (null), and a group of its own; empty
      text: a group with the checksum 0.
    * a group larger than a mean shard keeps a shard to itself.
    * empty table: no rows.  Repeated rows are separate documents.
    * ties are ordered by hash, id and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common
from voxelloom.llm.balanced_tree import BalancedTree

SHARDS = 40
#: Bytes that each document counts besides its text.
OVERHEAD = 16
#: A group above 1/FINE of a mean shard is packed by itself.
FINE = 64
#: Parcels of smaller groups.
PARCELS = 8192


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; a size above the capacity gets a bin of its own."""
    bins, tree = 0, BalancedTree()
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.ceiling((sizes[i], -1))
        if found is None:
            room, at, bins = max(capacity, sizes[i]), bins, bins + 1
        else:
            tree.remove(found)
            room, at = found
        placed[i] = at
        tree.add((room - sizes[i], at))
    return placed


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing with the smallest capacity that fits ``shards``.

    Sizes above the mean of what is left get a shard each, first.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    placed, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > left:
        placed[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, free = order[alone:], shards - alone
    if not rest:
        return placed
    of_rest = [sizes[i] for i in rest]
    low = -(-left // free)
    high = low + max(of_rest)
    best = best_fit_decreasing(of_rest, high)
    while max(best) >= free:
        high *= 2
        best = best_fit_decreasing(of_rest, high)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(of_rest, middle)
        if max(tried) < free:
            best, high = tried, middle
        else:
            low = middle + 1
    for i, at in zip(rest, best, strict=True):
        placed[i] = alone + at
    return placed


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard and slot within it."""
    spark = docs.sparkSession
    text = F.col(text_col)
    raw = F.encode(text, "UTF-8")
    base = common.durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(raw, 256)), F.unhex(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("~"))))).alias("grp"),
        ).withColumn("parcel", F.pmod(F.xxhash64("grp"), F.lit(PARCELS)).cast("int")),
        "shard-sized",
    )
    total = base.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total["rows"]:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = base.groupBy("grp", "parcel").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * (FINE * shards) > total["bytes"]
    items = (
        groups.groupBy(F.when(large, F.col("grp")).alias("grp"), F.when(~large, F.col("parcel")).alias("parcel"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most FINE * shards groups and PARCELS parcels
    )
    items.sort(key=lambda r: (-r["bytes"], bytes(r["grp"] or b""), -1 if r["parcel"] is None else r["parcel"]))
    placed = pack_into([r["bytes"] for r in items], shards)
    whole = [(bytes(r["grp"]), s) for r, s in zip(items, placed, strict=True) if r["grp"] is not None]
    parcels = [(r["parcel"], s) for r, s in zip(items, placed, strict=True) if r["grp"] is None]
    by_group = spark.createDataFrame(whole, "grp binary, s_grp int")
    by_parcel = spark.createDataFrame(parcels, "parcel int, s_parcel int")
    rows = (
        base.join(F.broadcast(by_group), "grp", "left")
        .join(F.broadcast(by_parcel), "parcel", "left")
        .select(
            "doc_id", "size", "text_crc32",
            F.coalesce("s_grp", "s_parcel").alias("shard"),
            common.order_key(F.col("doc_id"), F.col("text_crc32")).alias("k"),
        )
        .withColumn("bucket", common.bucket_of(F.col("k"), common.bucket_count(total["rows"])))
    )
    cells = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("cell_total"))
    order = ["k", "doc_id", "text_crc32", "size"]
    return common.with_running(rows, cells, "shard", order, F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )
