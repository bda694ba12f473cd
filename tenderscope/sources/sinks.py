"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderscope.operators import tables
from tenderscope.session import scratch_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, keys: list[str], seq: list[str]) -> str:
    """Upsert into a Parquet inventory and return the path of the new version.

    A version is written beside the old one, so a failed job leaves it intact and
    no job reads the files it is overwriting.
    """
    old = spark.read.parquet(path)
    version = scratch_path(spark, "inventory")
    tables.upsert_latest(old, new.select(*old.columns), keys, seq).write.parquet(version)
    return version
