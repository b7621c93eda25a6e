"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shared import new_path, written

__all__ = ["ascii_lower", "columns", "connected_components", "fresh", "id_crc", "in_arrow", "new_path", "open_folder", "table", "written"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
BATCH = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns are never read, so clashing names do no harm."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of df's own (Spark tells names apart without their case)."""
    own, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in own:
            n += "_"
        own.add(n.lower())
        out.append(n)
    return out


def in_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of BATCH rows and of spark.sql.execution.arrow.maxBytesPerBatch (by default 64 MB; a longer row is a batch of its own), whichever is less, for a worker holds a batch's input and output at once. Columns may have any names. The number of rows stays set in the session, for what is returned runs later."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def open_folder(uri: str):
    """Arrow's file system and path for a folder in the shared place, as Hadoop names it: file, hdfs, viewfs, gs, s3 and abfss as they are, s3a and s3n as s3; Arrow takes credentials of object stores from the environment of the executors."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a://", "s3n://")) else uri)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. lower() does so too where all characters are ASCII, and is faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_crc(c: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node that node reaches; only nodes with an edge to another appear.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond") in turn until nothing changes: a logarithmic number of rounds in practice, each two aggregations that combine before the shuffle and two equi-joins whose hot keys adaptive execution splits. Each round is a written table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = written(e, name), None
    while True:
        got = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == before or not got[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = got
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
