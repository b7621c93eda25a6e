"""A synthetic catalog of T tables with C columns each, a chain of foreign keys and an index per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import object_key
from ..plans.model import Canonical


def synth_catalog(spark: SparkSession, tables: int, columns: int, fk_every: int = 1, index_every: int = 1, alias: str = "bench", partitions: int | None = None) -> Canonical:
    """Every list is a range of table numbers, so it has as many partitions as asked for and no shuffle. With a foreign key and an index on every table there are 1 + T * (C + 4) nodes, the database and schema nodes counted once together with the chain's missing first link, and T * (C + 8) - 2 edges."""
    source, sk = "synthetic", F.lit(f"synthetic:{alias}").alias("snapshot_key")
    k = lambda kind, name, sub=None: object_key(source, alias, "main", "main", kind, name, sub)
    t = spark.range(0, tables, 1, partitions).withColumn("name", F.format_string("table_%04d", "id"))
    name_of = lambda i: F.format_string("table_%04d", i)
    col = lambda table, i: k("column", table, F.lit(f"col_{i:03d}"))
    one = spark.range(1)
    database, schema = k("database", F.lit("main")), k("schema", F.lit("main"))
    rows: dict[str, DataFrame] = {
        "databases": one.select(sk, database.alias("key"), F.lit("main").alias("name"), F.lit(source).alias("source_kind"), F.lit(alias).alias("connection_alias")),
        "schemas": one.select(sk, schema.alias("key"), database.alias("database_key"), F.lit("main").alias("name")),
        "tables": t.select(sk, k("table", F.col("name")).alias("key"), schema.alias("schema_key"), "name", F.lit("base_table").alias("kind")),
    }
    c = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("cname", F.format_string("col_%03d", "i"))
    rows["columns"] = c.select(sk, k("column", F.col("name"), F.col("cname")).alias("key"), k("table", F.col("name")).alias("table_key"), F.col("cname").alias("name"), (F.col("i") + 1).alias("ordinal_position"), F.when(F.col("i") == 0, "integer").otherwise("text").alias("data_type"), (F.col("i") > 0).alias("is_nullable"), F.lit(False).alias("is_generated"))
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    shape = lambda df, name, kind, cols, table, to: df.select(sk, k(kind, F.col("name"), F.lit(name)).alias("key"), k("table", F.col("name")).alias("table_key"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), cols.alias("columns"), table.alias("referenced_table_key"), to.alias("referenced_columns"))
    pk = shape(t, "pk", "primary_key", F.array(col(F.col("name"), 0)), text, none)
    before = name_of(F.col("id") - 1)
    fk = shape(t.where((F.col("id") > 0) & (F.col("id") % fk_every == 0)), "fk", "foreign_key", F.array(col(F.col("name"), min(1, columns - 1))), k("table", before), F.array(col(before, 0)))
    rows["constraints"] = pk.unionByName(fk)
    rows["indexes"] = t.where(F.col("id") % index_every == 0).select(sk, k("index", F.col("name"), F.lit("ix")).alias("key"), k("table", F.col("name")).alias("table_key"), F.lit("ix").alias("name"), F.array(col(F.col("name"), min(1, columns - 1))).alias("columns"), F.lit(False).alias("is_unique"), F.lit(False).alias("is_primary"))
    rows["capabilities"] = one.select(sk, F.lit(source).alias("source_kind"), *[F.lit(True).alias(n) for n in ("metadata_only", "schemas", "tables", "columns", "constraints", "indexes")], *[F.lit("supported").alias(n) for n in ("views", "triggers", "routines", "dependencies")], none.alias("limitations"), none.alias("notes"))
    return Canonical.of(spark, **rows)


def change_types(c: Canonical, every: int, to: str = "bigint") -> Canonical:
    """Every n-th column, by a hash of its key, gets another type."""
    hit = F.pmod(F.xxhash64("key"), F.lit(every)) == 0
    return c.with_tables(columns=c.columns.withColumn("data_type", F.when(hit, to).otherwise(F.col("data_type"))))
