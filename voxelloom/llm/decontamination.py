"""Operator 5 - benchmark decontamination (DataFrame operations only).

A prefix-filtered set join.  The set of a window of consecutive item words is
its three-word shingles (fewer words: the whole item).  Since a window must be
contained whole, one shingle is a sufficient prefix: shingles are ordered by
their rarity in the corpus and only the rarest of each window is joined.  A
joined shingle fixes the alignment of item and document; alignments whose
windows would stick out of the document are dropped by length and position,
the others are verified word by word over item-sized windows.

Defined results
    * null or empty text: no words, no hits; items without words never occur.
    * an item id that is null counts in hits but is not listed; an id on
      several items is listed once.
    * rows that repeat an id are judged by their own text.
    * other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import common

WINDOW = 10
SHINGLE = 3
#: Tables of up to this many short rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    split = F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS)
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def _shingles(words: Column, width: int) -> Column:
    """Hash of the shingle that starts at each position."""
    count = F.size(words) - F.lit(width - 1)
    at = F.sequence(F.lit(0), count - 1)
    hashed = F.transform(at, lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + j) for j in range(width)]))
    return F.when(count > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: key, id, words, window and shingle width."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
    items = items.where(F.size("item_words") > 0).distinct()
    key = F.xxhash64(F.coalesce("item_id", F.lit("~")), F.concat_ws(" ", "item_words"))
    size = F.size("item_words")
    return items.select(
        key.alias("item"), "item_id", "item_words", size.alias("m"),
        F.least(size, F.lit(WINDOW)).alias("win"), F.least(size, F.lit(SHINGLE)).alias("width"),
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): doc_id, text_key, n_words of each row; and of each
    hit word doc_id, text_key, position, item, item_id."""
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    slim = source.select(
        "doc_id", "text_key",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long").alias("n_words"),
    )
    items = common.durable(_items(benchmark, item_col, item_text_col), "bench-items")
    n_items = items.count()
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most SHINGLE rows

    parts = None
    for width in widths:
        some = items.where(F.col("width") == width)
        part = some.select("item", "m", "win", "width", F.posexplode(_shingles(F.col("item_words"), width)).alias("p", "h"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        none = slim.select(
            "doc_id", "text_key", F.lit(0).alias("position"), F.lit(0).cast("long").alias("item"), F.lit("").alias("item_id")
        )
        return slim, none.where("false")
    shingles = common.durable(parts, "bench-shingles")
    known = shingles.select("h").distinct()
    n_known = known.count()

    # every place in the documents where an item's shingle stands
    seen = None
    words = source.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    for width in widths:
        part = words.select(
            "doc_id", "text_key", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), width)).alias("j", "h")
        )
        seen = part if seen is None else seen.unionByName(part)
    places = common.durable(seen.join(_bounded(known, n_known), "h", "left_semi"), "bench-places")

    # order by rarity: the rarest shingle of each window is its prefix
    rarity = places.groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    ranked = shingles.join(rarity, "h")  # a shingle that is nowhere leaves its windows without a place
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") + F.col("width") - F.col("win")), F.least("p", F.col("m") - F.col("win")))
    in_windows = ranked.withColumn("start", F.explode(starts))
    rule = Window.partitionBy("item", "start").orderBy("seen", "h", "p")
    all_present = F.count(F.lit(1)).over(Window.partitionBy("item", "start")) == F.col("win") - F.col("width") + 1
    # of windows with the same words one is enough: it is found wherever they stand
    one_of = items.select("item", "item_words", "win", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("win"))).alias("start"))
    one_of = one_of.groupBy("item", F.slice("item_words", F.col("start") + 1, F.col("win")).alias("own")).agg(F.min("start").alias("start"))
    prefix = (
        in_windows.withColumn("whole", all_present).withColumn("at", F.row_number().over(rule))
        .where("at = 1 AND whole").select("h", "item", "p", "start", "win").distinct()
        .join(one_of.select("item", "start"), ["item", "start"], "left_semi")
    )
    prefix = common.durable(prefix, "bench-prefix")
    aligned = (
        places.join(_bounded(prefix, prefix.count()), "h")
        .withColumn("shift", F.col("j") - F.col("p"))
        .where("shift + start >= 0 AND shift + start + win <= n")
        .select("doc_id", "text_key", "item", "shift", "start", "win").distinct()
    )
    # neighbouring windows of one alignment as one range of the item's words
    along = Window.partitionBy("doc_id", "text_key", "item", "shift").orderBy("start")
    apart = F.coalesce((F.col("start") > F.lag("start").over(along) + F.col("win")).cast("int"), F.lit(1))
    ranges = aligned.withColumn("apart", apart).withColumn("island", F.sum("apart").over(along))
    ranges = ranges.groupBy("doc_id", "text_key", "item", "shift", "island").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("win")).alias("stop"))
    aligned = common.durable(ranges.drop("island"), "bench-aligned")

    # verify word by word in the documents concerned
    wanted = aligned.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).distinct()
    same = source["doc_id"].eqNullSafe(F.col("w_id")) & (source["text_key"] == F.col("w_key"))
    texts = source.join(_bounded(wanted, wanted.count()), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    placed = texts.select(
        F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"), F.posexplode(words_of(F.col("text"))).alias("position", "word")
    )
    parts_of = items.select("item", "item_id", "win", F.posexplode("item_words").alias("p", "expected"))
    asked = aligned.select("doc_id", "text_key", "item", "shift", F.explode(F.sequence(F.col("first"), F.col("stop") - 1)).alias("p"))
    asked = asked.join(_bounded(parts_of, shingles.count()), ["item", "p"]).withColumn("at", F.col("shift") + F.col("p"))
    found = (
        asked["doc_id"].eqNullSafe(placed["t_id"]) & (asked["text_key"] == placed["t_key"])
        & (asked["at"] == placed["position"]) & (asked["expected"] == placed["word"])
    )
    matched = asked.join(placed, found).select("doc_id", "text_key", "item", "item_id", "shift", "win", "p")
    within = Window.partitionBy("doc_id", "text_key", "item", "shift")
    runs = matched.withColumn("run", F.col("p") - F.row_number().over(within.orderBy("p")))
    whole = Window.partitionBy("doc_id", "text_key", "item", "shift", "run")
    hits = runs.withColumn("length", F.count(F.lit(1)).over(whole)).where("length >= win")
    return slim, hits.select("doc_id", "text_key", (F.col("shift") + F.col("p")).alias("position"), "item", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, item_ids."""
    slim, hits = find_hits(docs, benchmark, **columns)
    hits = common.durable(hits, "bench-hits")
    words = hits.select("doc_id", "text_key", "position").distinct()
    words = words.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = hits.select("doc_id", "text_key", "item_id").distinct().groupBy("doc_id", "text_key")
    listed = listed.agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))

    def matching(table: DataFrame, prefix: str) -> DataFrame:
        return table.withColumnsRenamed({"doc_id": f"{prefix}_id", "text_key": f"{prefix}_key"})

    w, i = matching(words, "w"), matching(listed, "i")
    out = slim.join(w, slim["doc_id"].eqNullSafe(w["w_id"]) & (slim["text_key"] == w["w_key"]), "left")
    out = out.join(i, slim["doc_id"].eqNullSafe(i["i_id"]) & (slim["text_key"] == i["i_key"]), "left")
    return out.select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""
    _, hits = find_hits(docs, benchmark, id_col=id_col, text_col=text_col)
    bad = common.durable(hits.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct(), "bench-bad")
    match = docs[id_col].eqNullSafe(F.col("_bad_id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("_bad_key"))
    return docs.join(_bounded(bad, bad.count()), match, "left_anti")
