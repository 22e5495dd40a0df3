"""Shared helpers: reading tables, durable intermediate tables, bucketed order.

Durable tables are written to the folder named by ``spark.checkpoint.dir`` so
that lineage is cut in storage every executor can reach; a lost executor only
costs the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that one ordered bucket holds on average; bounds every window below.
ROWS_PER_BUCKET = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    Where none is set, a session whose executors are threads of this process
    (master ``local``) gets a temporary one; on a cluster that is an error, as
    executors would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxelloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_written: list[tuple] = []


def release(first: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the durable tables written since there were ``first``, but for
    those that ``keep`` reads."""
    needed = {f.rsplit("/", 1)[0] for f in keep.inputFiles()} if keep is not None else set()
    stays = []
    for context, path in _written[first:]:
        if any(n.endswith(path.removeprefix("file://")) for n in needed):
            stays.append((context, path))
            continue
        with contextlib.suppress(Exception):
            found = context._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)
    _written[first:] = stays


#: Durable tables live as long as the driver's process at most.
atexit.register(release)


def written() -> int:
    """How many durable tables there are, for a later :func:`release`."""
    return len(_written)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, removed with the durable tables."""
    path = f"{shared_dir(spark)}/voxelloom/{tag}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    return path


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table is removed when the driver's process ends in the usual way.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made and run inside leave no shuffle files when they end.

    Otherwise these stay until the driver's JVM happens to collect the plan.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches near 4 MB, unless the session says otherwise.

    The default of 64 MB, held in several copies by every task and its Python
    worker, is what long texts would fill.  The setting is read when a plan
    runs, so it stays with the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(key, "4m")


def fold_of(column: str, folds: int):
    """``crc32(id as text) mod folds``; a null id counts as remainder 0."""
    crc = F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))
    return F.coalesce(F.pmod(crc, F.lit(folds)), F.lit(0)).cast("int")


def order_key(*columns):
    """A 52-bit uniform key of the columns, the same in Spark and in SQL."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def bucket_of(key, buckets: int):
    """Ordered bucket of a 52-bit key: a range partition of uniform keys."""
    return F.floor(key.cast("double") / F.lit(float(1 << 52)) * F.lit(float(buckets))).cast("long")


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def with_running(
    rows: DataFrame, cells: DataFrame, group: str, order: list[str], value, out: str
) -> DataFrame:
    """Exclusive running total of ``value`` within ``group`` in key order.

    ``rows`` carry ``group``, ``bucket`` and the ``order`` columns; ``cells``
    hold one row per (group, bucket) with ``cell_total`` (and whatever else
    should be attached).  Only cell totals are scanned group by group; rows
    are ordered inside one bounded cell, so no task gets a whole hot group.
    """
    over_cells = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_base", F.coalesce(F.sum("cell_total").over(over_cells), F.lit(0)))
    inside = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(cells, [group, "bucket"])
    return joined.withColumn(out, F.col("cell_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
