"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder beside the warehouse in local mode."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which outlives lost executors."""
    path = new_path(df.sparkSession, name)
    # Shuffle files go when their query has ended: what it made is a table.
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """written for each of a few tables, by name, as jobs at the same time: small ones don't wait for one another, and the scheduler shares out the executors."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        return dict(zip(tables, pool.map(lambda n: written(tables[n], n), tables), strict=True))
