"""A catalog fleet read from retail tables: their rows stand for the tables, columns, keys, views, routines and triggers of one database for each region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import object_key
from ..plans.model import Canonical
from ..plans.shared import written

SOURCE, DATABASE = "tpch", "w"


def _key(kind: str, name: Column, sub: Column | None = None) -> Column:
    return object_key(SOURCE, F.col("alias"), DATABASE, F.col("nn"), kind, name, sub)


def _name(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def following(df: DataFrame, group: str, order: str, **fields: str) -> DataFrame:
    """Adds the fields of the next row of the group by order: ranges of rows, the next row within each, and for its last row the first of the range behind, so that no group is one task's."""
    parts = written(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()), "ordered")
    row = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    firsts = parts.groupBy(group, "_part").agg(F.min_by(row, order).alias("_first"))
    behind = firsts.select(group, "_part", F.lead("_first").over(W.partitionBy(group).orderBy("_part")).alias("_behind"))
    within = parts.withColumn("_next", F.lead(row).over(W.partitionBy(group, "_part").orderBy(order)))
    return within.join(behind, [group, "_part"]).select(*df.columns, *[F.coalesce("_next", "_behind")[n].alias(n) for n in fields])


def retail_catalog(spark: SparkSession, sf_dir: str, generation: int = 1) -> Canonical:
    """The canonical tables. Generation 2 has another alias, lacks some columns and has other types in some, for diffs.

    Everything is keyed by customer, part or supplier, so that joins and windows are as wide as those tables; only nations and regions, 25 and 5 rows by definition of the tables, are broadcast.
    """
    t = lambda n, *cols: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*cols)
    suffix = "" if generation == 1 else f"_v{generation}"
    region = t("region", "r_regionkey", "r_name").select("r_regionkey", F.concat("r_name", F.lit(suffix)).alias("alias"))
    nation = F.broadcast(t("nation", "n_nationkey", "n_name", "n_regionkey").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nn"), F.col("n_regionkey").alias("rk"), "alias"))
    sk = F.concat(F.lit(SOURCE + ":"), F.col("alias")).alias("snapshot_key")
    in_nation = lambda df, c: df.join(nation, F.col(c) == F.col("n_nationkey")).withColumn("schema_key", _key("schema", F.col("nn")))

    databases = region.select(sk, object_key(SOURCE, F.col("alias"), DATABASE, DATABASE, "database", DATABASE).alias("key"), F.lit(DATABASE).alias("name"), F.lit(SOURCE).alias("source_kind"), F.col("alias").alias("connection_alias"))
    schemas = nation.select(sk, _key("schema", F.col("nn")).alias("key"), object_key(SOURCE, F.col("alias"), DATABASE, DATABASE, "database", DATABASE).alias("database_key"), F.col("nn").alias("name"))

    customers = in_nation(t("customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey").withColumn("tname", _name("c", "c_custkey"))
    customers = customers.withColumn("table_key", _key("table", F.col("tname")))
    tables = customers.select(sk, F.col("table_key").alias("key"), "schema_key", F.col("tname").alias("name"), F.lit("base_table").alias("kind"))

    orders = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ordinal = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    size = F.count("*").over(W.partitionBy("o_custkey"))
    cols = orders.withColumn("ordinal", ordinal).withColumn("n", size).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    cols = cols.withColumn("cname", _name("o", "o_orderkey")).withColumn("column_key", _key("column", F.col("tname"), F.col("cname")))
    data_type = F.col("o_orderpriority")
    if generation > 1:
        cols = cols.where(~((F.col("o_orderkey") % 97 == 0) & (F.col("ordinal") > 1) & (F.col("ordinal") < F.col("n"))))
        data_type = F.when(F.col("o_orderkey") % 100 == 0, "CHANGED").otherwise(data_type)
    # Columns, keys, constraints, indexes, views and routines all come from these two, which are joined once.
    cols = written(cols, "retail_columns")
    columns = cols.select(sk, F.col("column_key").alias("key"), "table_key", F.col("cname").alias("name"), F.col("ordinal").alias("ordinal_position"), data_type.alias("data_type"), (F.col("o_orderstatus") != "F").alias("is_nullable"), (F.col("o_orderstatus") == "P").alias("is_generated"))

    in_order = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("ordinal", "column_key")))), lambda x: x.column_key)
    owner = ["c_custkey", "alias", "nn", "rk", "tname", "table_key", "c_acctbal"]
    keyed = cols.groupBy(*owner).agg(F.min_by("column_key", "ordinal").alias("first"), F.max_by("column_key", "ordinal").alias("last"), in_order(F.col("ordinal") <= 2).alias("two"), in_order(F.col("ordinal") <= 3).alias("three"))
    keyed = following(keyed, "rk", "c_custkey", next_table="table_key", next_pk="first")
    none = F.array().cast("array<string>")

    def constraint(name: str, kind: str, object_kind: str, columns_: Column, where: Column | None = None, **more: Column) -> DataFrame:
        rows = keyed if where is None else keyed.where(where)
        return rows.select(sk, _key(object_kind, F.col("tname"), F.lit(name)).alias("key"), "table_key", F.lit(name).alias("name"), F.lit(kind).alias("kind"), columns_.alias("columns"), more.get("table", F.lit(None).cast("string")).alias("referenced_table_key"), more.get("to", none).alias("referenced_columns"), more.get("expression", F.lit(None).cast("string")).alias("expression"))

    constraints = (
        constraint("pk", "primary_key", "primary_key", F.array("first"))
        .unionByName(constraint("fk", "foreign_key", "foreign_key", F.array("last"), F.col("next_table").isNotNull(), table=F.col("next_table"), to=F.array("next_pk")))
        .unionByName(constraint("uq", "unique", "unique_constraint", F.col("two"), F.col("c_acctbal") > 9000))
        .unionByName(constraint("ck", "check", "check_constraint", F.col("three"), F.col("c_acctbal") < 0, expression=F.lit("o_totalprice > 0")))
    )
    by_priority = cols.groupBy("alias", "nn", "tname", "table_key", "o_orderpriority").agg(in_order(F.lit(True)).alias("columns")).withColumn("iname", _name("ix_", "o_orderpriority"))
    indexes = by_priority.select(sk, _key("index", F.col("tname"), F.col("iname")).alias("key"), "table_key", F.col("iname").alias("name"), "columns", (F.size("columns") == 1).alias("is_unique"), F.lit(False).alias("is_primary"))

    supplier = in_nation(t("supplier", "s_suppkey", "s_nationkey"), "s_nationkey").withColumn("vname", _name("s", "s_suppkey"))
    supplier = following(supplier.withColumn("view_key", _key("view", F.col("vname"))), "s_nationkey", "s_suppkey", next_view="view_key")
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    bought = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", F.col("rk").alias("c_rk"), F.col("table_key"), F.col("alias").alias("c_alias"), F.col("nn").alias("c_nn"), "tname"), F.col("o_custkey") == F.col("c_custkey"))
    bought = written(bought, "retail_lines")
    supplied = bought.select("l_suppkey", "c_rk", "table_key").distinct().join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_rk") == F.col("rk"))).groupBy("s_suppkey").agg(F.collect_list("table_key").alias("uses"))
    both = F.concat(F.coalesce("uses", none), F.when(F.col("next_view").isNotNull(), F.array("next_view")).otherwise(none))
    views = supplier.join(supplied, "s_suppkey", "left").select(sk, F.col("view_key").alias("key"), "schema_key", F.col("vname").alias("name"), F.array_sort(F.array_distinct(both)).alias("depends_on"))

    part = in_nation(t("part", "p_partkey", "p_size").where("p_size <= 2").withColumn("p_nation", (F.col("p_partkey") % 25).cast("int")), "p_nation").withColumn("rname", _name("p", "p_partkey"))
    part = part.withColumn("routine_key", _key("routine", F.col("rname")))
    first_lines = bought.where("l_linenumber = 1").join(part.select("p_partkey", F.col("rk").alias("p_rk")), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("c_rk") == F.col("p_rk")))
    column_key = object_key(SOURCE, F.col("c_alias"), DATABASE, F.col("c_nn"), "column", F.col("tname"), _name("o", "o_orderkey"))
    used = first_lines.select("p_partkey", F.explode(F.array("table_key", column_key)).alias("dep")).groupBy("p_partkey").agg(F.collect_set("dep").alias("uses"))
    routines = part.join(used, "p_partkey", "left").select(sk, F.col("routine_key").alias("key"), "schema_key", F.col("rname").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("procedure").alias("kind"), F.array_sort(F.coalesce("uses", none)).alias("depends_on"))

    smallest = part.groupBy("p_nation").agg(F.min("routine_key").alias("executes"))
    event_types = t("events", "user_id", "event_type").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("events"))
    triggers = customers.join(event_types, F.col("c_custkey") == F.col("user_id")).join(smallest, F.col("c_nationkey") == F.col("p_nation"), "left").select(sk, _key("trigger", F.col("tname"), F.lit("t")).alias("key"), "table_key", F.lit("t").alias("name"), F.lit("AFTER").alias("timing"), "events", F.col("executes").alias("executes_routine_key"))

    full = F.lit("supported")
    capabilities = region.select(sk, F.lit(SOURCE).alias("source_kind"), *[F.lit(True).alias(n) for n in ("metadata_only", "schemas", "tables", "columns", "constraints", "indexes")], *[full.alias(n) for n in ("views", "triggers", "routines", "dependencies")], none.alias("limitations"), none.alias("notes"))
    return Canonical.of(spark, databases=databases, schemas=schemas, tables=tables, columns=columns, constraints=constraints, indexes=indexes, views=views, routines=routines, triggers=triggers, capabilities=capabilities)
