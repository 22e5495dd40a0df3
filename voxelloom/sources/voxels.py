"""Voxel tables: (t, p, c, z, y, x, v) rows and their chunk form.

The voxel form serves relational operators; the chunk form carries blocks of
voxels as binary payloads for numeric kernels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ["t", "p", "c", "z", "y", "x"]
CHUNK_FIELDS = (
    "t int, p int, c int, z0 int, y0 int, x0 int, nz int, ny int, nx int, dtype string, payload binary"
)
#: Value ranges by stored type; unsigned types are widened in Spark.
DTYPE_RANGES = {
    "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295),
    "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _volume_of(id_: Column) -> list[Column]:
    """The t, p, c of a vector."""
    return [
        F.floor(id_ / 100).cast("int").alias("t"),
        (F.floor(id_ / 20) % 5).cast("int").alias("p"),
        (F.floor(id_ / 10) % 2).cast("int").alias("c"),
    ]


def embedding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (t, p, c) that have vectors, one row each; no voxels are made."""
    return table(spark, sf_dir, "embeddings").select(*_volume_of(F.col("vec_id"))).distinct()


def embedding_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 plane per vector; ten planes make a volume."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    value = F.rint(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), F.col("e").cast("double") * 1000 + 2000)))
    id_ = F.col("vec_id")
    return rows.select(
        *_volume_of(id_),
        (id_ % 10).cast("int").alias("z"),
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        value.cast("int").alias("v"),
    )


def canonical(source: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Rows of present axes as (t, p, c, z, y, x, v); absent axes become 0."""
    unknown = [a for a in axes if a not in AXES]
    if unknown:
        raise ValueError(f"unknown axes: {unknown}")
    picked = [F.col(a).cast("int").alias(a) if a in axes else F.lit(0).alias(a) for a in AXES]
    return source.select(*picked, F.col(value).alias("v"))


def to_chunks(voxels: DataFrame, chunk_zyx: tuple[int, int, int], dtype: str = "float32") -> DataFrame:
    """Blocks of at most ``chunk_zyx`` voxels; each group is one block."""
    cz, cy, cx = chunk_zyx
    keyed = voxels
    for axis, size in (("z", cz), ("y", cy), ("x", cx)):
        keyed = keyed.withColumn(f"{axis}0", (F.floor(F.col(axis) / size) * size).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        at = [pdf[a].to_numpy() - int(first[f"{a}0"]) for a in "zyx"]
        shape = [int(i.max()) + 1 for i in at]
        block = np.zeros(shape, dtype)
        block[tuple(at)] = pdf["v"].to_numpy()
        row = {k: int(first[k]) for k in ("t", "p", "c", "z0", "y0", "x0")}
        row |= dict(zip(("nz", "ny", "nx"), shape, strict=True))
        return pd.DataFrame([row | {"dtype": dtype, "payload": block.tobytes()}])

    return keyed.groupBy("t", "p", "c", "z0", "y0", "x0").applyInPandas(pack, CHUNK_FIELDS)


def block_of(row) -> np.ndarray:
    """The array of one chunk row."""
    shape = (int(row["nz"]), int(row["ny"]), int(row["nx"]))
    return np.frombuffer(row["payload"], row["dtype"]).reshape(shape)


def blocks_in(batch: pa.RecordBatch):
    """(row as a dict without payload, block) of every chunk row in a batch."""
    names = [n for n in batch.schema.names if n != "payload"]
    for i, row in enumerate(batch.select(names).to_pylist()):
        shape = (row["nz"], row["ny"], row["nx"])
        yield row, np.frombuffer(batch.column("payload")[i].as_buffer(), row["dtype"])[: shape[0] * shape[1] * shape[2]].reshape(shape)


def chunk_batch(rows: list[dict], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Chunk rows (t, p, c, z0, y0, x0) with their blocks as a batch of CHUNK_FIELDS."""
    numbers = {k: [int(r[k]) for r in rows] for k in ("t", "p", "c", "z0", "y0", "x0")}
    numbers |= {n: [b.shape[i] for b in blocks] for i, n in enumerate(("nz", "ny", "nx"))}
    columns = [pa.array(v, pa.int32()) for v in numbers.values()]
    columns += [pa.array([b.dtype.name for b in blocks], pa.string()), pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*numbers, "dtype", "payload"])


def to_voxels(chunks: DataFrame) -> DataFrame:
    """Voxel rows of a chunk table; NaN stays NaN."""

    def unpack(batches):
        for batch in batches:
            for row, block in blocks_in(batch):
                z, y, x = (i.reshape(-1) for i in np.indices(block.shape, dtype=np.int32))
                n = block.size
                columns = [pa.array(np.full(n, row[k], np.int32)) for k in ("t", "p", "c")]
                columns += [pa.array(i + np.int32(row[k])) for i, k in ((z, "z0"), (y, "y0"), (x, "x0"))]
                columns.append(pa.array(block.reshape(-1).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(columns, names=[*AXES, "v"])

    return chunks.mapInArrow(unpack, "t int, p int, c int, z int, y int, x int, v double")
