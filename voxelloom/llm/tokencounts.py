"""Operator 6 - token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are
kept as additive deltas.  A change inserts, deletes or revises a document; it
adds its new count and takes away its old one, wherever the two belong.  A
batch of changes is summed into one delta and committed under its id: the
delta becomes visible when Spark's job commit leaves its success marker, and a
batch that is already visible is not applied again, so replays after a lost
driver or executor are harmless.

Defined results
    * null text: 0 tokens; it counts as a document.  Null source or language:
      a group of its own.
    * groups whose documents and tokens have come back to 0 are left out.
    * empty changes commit an empty delta.  Repeated rows count each.
    * other columns of the documents never matter.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import common, textkit

#: Where the public vocabularies are, and the one that counts by default.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
WORDS_VERSION, BPE_VERSION = "words@1", f"{VOCABULARY}@1"

KEYS = ["source", "lang", "tokenizer"]
DELTA_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
_encoders: dict = {}


def _encoder(name: str, content: bytes, pattern: str):
    """One encoder for each worker process."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def bpe_counts(docs: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, lang, words, bpe of each document; the vocabulary file (below
    2 MB) is read on the driver and goes with the tasks."""
    import public_tokenizers

    with open(f"{directory}/{vocabulary}.tiktoken", "rb") as f:
        content = f.read()
    pattern = public_tokenizers.PATTERN
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")

    def run(texts):
        encode = _encoder(vocabulary, content, pattern).encode_ordinary
        counts = [len(encode(t.decode("utf-8", "replace"))) if t else 0 for t in texts]
        return [pa.array(counts, pa.int64())]

    keep = {"source": F.col("source"), "lang": F.col("lang"), "words": words}
    return textkit.map_texts(docs, run, "bpe long", keep=keep)


def long_counts(counted: DataFrame) -> DataFrame:
    """One row for each document and tokenizer version."""
    versions = F.array(
        F.struct(F.lit(WORDS_VERSION).alias("tokenizer"), F.col("words").alias("tokens")),
        F.struct(F.lit(BPE_VERSION).alias("tokenizer"), F.col("bpe").alias("tokens")),
    )
    return counted.select("doc_id", "source", "lang", F.explode(versions).alias("v")).select(
        "doc_id", "source", "lang", "v.tokenizer", "v.tokens"
    )


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add the documents of ``counts``."""
    none = F.lit(None)
    return counts.select(
        F.lit("insert").alias("op"), "doc_id", "tokenizer", "source", "lang", "tokens",
        none.cast("string").alias("old_source"), none.cast("string").alias("old_lang"), none.cast("long").alias("old_tokens"),
    )


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Inserts, deletes and revisions that lead from one state to the next.

    Both hold one row for each (doc_id, tokenizer).
    """
    old = before.select("doc_id", "tokenizer", F.struct("source", "lang", "tokens").alias("o"))
    both = after.select("doc_id", "tokenizer", F.struct("source", "lang", "tokens").alias("n")).join(
        old, ["doc_id", "tokenizer"], "full_outer"
    )
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("revise")
    changed = both.where(~F.col("n").eqNullSafe(F.col("o")))
    return changed.select(
        op.alias("op"), "doc_id", "tokenizer", "n.source", "n.lang", "n.tokens",
        F.col("o.source").alias("old_source"), F.col("o.lang").alias("old_lang"), F.col("o.tokens").alias("old_tokens"),
    )


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of the changes; hot groups are summed before the shuffle."""
    plus = F.when(
        F.col("op").isin("insert", "revise"),
        F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(1).cast("long").alias("docs"), F.col("tokens").alias("tokens")),
    )
    minus = F.when(
        F.col("op").isin("delete", "revise"),
        F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens")),
    )
    sides = changes.select("tokenizer", F.explode(F.array(plus, minus)).alias("s")).where("s IS NOT NULL")
    sums = sides.groupBy("s.source", "s.lang", "tokenizer").agg(F.sum("s.docs").alias("docs"), F.sum("s.tokens").alias("tokens"))
    return sums.select(*KEYS, F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


class Rollup:
    """Committed deltas below one folder of a shared file system.

    With ``root`` a later driver finds what was committed; without it the
    folder is one of the session's own and goes with the other durable tables.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or common.scratch(spark, "rollup")).rstrip("/")

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        found, fs = self._path(path)
        return fs.exists(found)

    def _folder(self, batch_id: str) -> str:
        return f"{self.root}/batch={hashlib.sha256(batch_id.encode()).hexdigest()[:32]}"

    def committed(self, batch_id: str) -> bool:
        return self._exists(f"{self._folder(batch_id)}/_SUCCESS")

    def commit(self, changes: DataFrame, batch_id: str) -> bool:
        """Apply a batch once; False if it had been applied before."""
        if self.committed(batch_id):
            return False
        delta(changes).write.mode("overwrite").parquet(self._folder(batch_id))
        return True

    def batches(self) -> list[str]:
        """Folders of the visible batches."""
        found, fs = self._path(f"{self.root}/batch=*/_SUCCESS")
        listed = fs.globStatus(found) if self._exists(self.root) else None
        return sorted(s.getPath().getParent().toString() for s in listed or [])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all visible batches."""
        folders = self.batches()
        if not folders:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        rows = self.spark.read.schema(DELTA_SCHEMA).parquet(*folders)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")


def rollup_documents(docs: DataFrame, batch_id: str = "documents-1", directory: str = TOKENIZER_DIR, root: str | None = None) -> DataFrame:
    """Totals after committing the documents as one batch, and its replay."""
    store = Rollup(docs.sparkSession, root)
    counted = long_counts(bpe_counts(docs, directory))
    store.commit(inserts(counted), batch_id)
    store.commit(inserts(counted), batch_id)  # a replay changes nothing
    return store.totals()
