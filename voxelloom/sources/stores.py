"""Parquet stores: ingestion, block writes, levels and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators import regions

KEYS = ["t", "p", "c"]
SORTED = ["z", "y", "x"]


class Store:
    """Components of one experiment below a folder, partitioned by t, p, c.

    Outputs are latest-only; a write is complete when Spark's success marker
    stands, and complete levels are not built again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, component: str) -> str:
        return f"{self.root}/{component}"

    def _exists(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def complete(self, component: str) -> bool:
        return self._exists(f"{self.path(component)}/_SUCCESS")

    def write(self, component: str, voxels: DataFrame) -> None:
        """Whole component; files are sorted so that z, y, x bounds prune."""
        dealt = voxels.repartition(*KEYS, F.floor(F.col("z") / 64)).sortWithinPartitions(*KEYS, *SORTED)
        dealt.write.mode("overwrite").partitionBy(*KEYS).parquet(self.path(component))

    def write_block(self, component: str, voxels: DataFrame) -> None:
        """Replaces the (t, p, c) partitions that occur in ``voxels``."""
        rows = voxels.repartition(*KEYS).sortWithinPartitions(*SORTED)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path(component))

    def read(self, component: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(component))
        return rows.withColumns({k: F.col(k).cast("int") for k in KEYS})

    def ingest(self, voxels: DataFrame, factors: tuple[int, ...] = (1, 2, 4, 8), force: bool = False) -> list[str]:
        """Level 0 and its strided levels; complete ones are reused."""
        made = []
        for level, factor in enumerate(factors):
            component = f"data_pyramid/level_{level}" if level else "data"
            made.append(component)
            if self.complete(component) and not force:
                continue
            if level == 0:
                self.write(component, voxels)
                continue
            before = factors[level - 1]
            chained = factor % before == 0
            source, step = (made[level - 1], factor // before) if chained else ("data", factor)
            self.write(component, regions.stride_level(self.read(source), {a: step for a in "zyx"}))
        return made

    def put_metadata(self, name: str, value: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self.path(f"metadata/{name}"))

    def metadata(self, name: str) -> dict:
        rows = self.spark.read.text(self.path(f"metadata/{name}")).collect()  # one line
        return json.loads(rows[0]["value"])


def repair_stage(store: Store, rows: list[dict], translations: dict[int, tuple], positions: int) -> dict:
    """Writes stage rows and translations that a store lacks; pixels stay as they are.

    ``rows`` are stage rows by position, ``translations`` their z, y, x in
    micrometres; there must be one for each of the store's positions.
    """
    if len(rows) < positions:
        raise ValueError(f"{len(rows)} stage rows for {positions} positions")
    value = {"stage_rows": rows[:positions], "position_translations_zyx_um": [list(map(float, translations[p])) for p in range(positions)]}
    store.put_metadata("stage", value)
    return {"positions": positions, "stage_rows": len(rows)}


def export_volumes(chunks: DataFrame, dtype: str = "uint16") -> DataFrame:
    """One TIFF file's bytes for each (t, p, c): (t, p, c, name, content)."""
    import numpy as np
    import pandas as pd

    from voxelloom.sources.formats import encode_tiff
    from voxelloom.sources.voxels import block_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [int((pdf[f"{a}0"] + pdf[f"n{a}"]).max()) for a in "zyx"]
        volume = np.zeros(shape, dtype)
        info = np.iinfo(dtype) if np.issubdtype(np.dtype(dtype), np.integer) else None
        for _, row in pdf.iterrows():
            block = block_of(row).astype(float)
            block = np.clip(np.rint(block), info.min, info.max) if info else block
            at = tuple(slice(int(row[f"{a}0"]), int(row[f"{a}0"] + row[f"n{a}"])) for a in "zyx")
            volume[at] = block
        key = {k: int(pdf[k].iloc[0]) for k in KEYS}
        return pd.DataFrame([key | {"name": f"t{key['t']:04d}_p{key['p']:04d}_c{key['c']:04d}.tif", "content": encode_tiff(volume)}])

    return chunks.groupBy(*KEYS).applyInPandas(run, "t int, p int, c int, name string, content binary")
