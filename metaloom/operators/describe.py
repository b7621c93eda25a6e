"""Table descriptions, dependents, inventory and finders (T1 to T7), in bulk over all tables of all snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import capability_warnings, contains_ci, object_key, parse_key
from ..plans.model import KEY_PARTS, Canonical, Graph
from .store import paginate

KEY = ["snapshot_key", "table_key"]


def _listed(*cols: str | Column, order: str) -> Column:
    """A group's rows as an array of structs in order of a first field."""
    return F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *cols)))


def _names(c: Column) -> Column:
    """Sub-object names of an array of keys."""
    return F.transform(c, lambda k: parse_key(k)["sub_object"])


def describe_tables(c: Canonical, keys: DataFrame | None = None) -> DataFrame:
    """Of each table (or those of keys(snapshot_key, table_key)): columns by ordinal, primary key, constraints, foreign keys out and in, indexes, each list by name, and warnings. Each list is one aggregation by table, so tables of any number share five shuffles."""
    tables = c.tables.select("snapshot_key", F.col("key").alias("table_key"), "name", "kind")
    tables = tables if keys is None else tables.join(keys.select(*KEY), KEY, "left_semi")
    k, fk = c.constraints, c.constraints.where("kind = 'foreign_key'")
    parts = [
        c.columns.groupBy(*KEY).agg(_listed("name", "data_type", "is_nullable", "default_value", "is_generated", order="ordinal_position").alias("columns")),
        k.where("kind = 'primary_key'").groupBy(*KEY).agg(F.min_by(_names(F.col("columns")), "name").alias("primary_key")),
        k.groupBy(*KEY).agg(_listed("kind", _names(F.col("columns")).alias("columns"), "expression", order="name").alias("constraints")),
        fk.groupBy(*KEY).agg(_listed("referenced_table_key", _names(F.col("columns")).alias("columns"), _names(F.col("referenced_columns")).alias("referenced_columns"), order="name").alias("foreign_keys")),
        fk.groupBy("snapshot_key", F.col("referenced_table_key").alias("table_key")).agg(_listed(F.col("key").alias("constraint_key"), _names(F.col("columns")).alias("columns"), order="name").alias("referenced_by")),
        c.indexes.groupBy(*KEY).agg(_listed("is_unique", "is_primary", _names(F.col("columns")).alias("columns"), order="name").alias("indexes")),
    ]
    out = reduce(lambda a, b: a.join(b, KEY, "left"), parts, tables)
    caps = c.capabilities.select("snapshot_key", capability_warnings(F.struct(*[x for x in c.capabilities.columns if x != "snapshot_key"])).alias("warnings"))
    return out.join(caps, "snapshot_key", "left")


def dependents(g: Graph) -> DataFrame:
    """(snapshot_key, table_key, dependent_key, kind, relation, column_keys): views and routines that use a table or its columns, and its triggers, one row for each dependent; the columns used are sorted."""
    e = g.edges
    kind = lambda t: F.when(t.startswith("VIEW"), "view").when(t.startswith("ROUTINE"), "routine").otherwise("trigger")
    none = F.lit(None).cast("string").alias("column_key")
    on_table = e.where(F.col("edge_type").isin("VIEW_DEPENDS_ON_TABLE", "ROUTINE_DEPENDS_ON_TABLE")).select("snapshot_key", F.col("edge_to").alias("table_key"), F.col("edge_from").alias("dependent_key"), kind(F.col("edge_type")).alias("kind"), none)
    triggers = e.where("edge_type = 'TABLE_HAS_TRIGGER'").select("snapshot_key", F.col("edge_from").alias("table_key"), F.col("edge_to").alias("dependent_key"), F.lit("trigger").alias("kind"), none)
    of = e.where("edge_type = 'TABLE_HAS_COLUMN'").select("snapshot_key", F.col("edge_from").alias("table_key"), F.col("edge_to").alias("column_key"))
    on_column = e.where(F.col("edge_type").isin("VIEW_DEPENDS_ON_COLUMN", "ROUTINE_DEPENDS_ON_COLUMN")).select("snapshot_key", F.col("edge_to").alias("column_key"), F.col("edge_from").alias("dependent_key"), kind(F.col("edge_type")).alias("kind"))
    on_column = on_column.join(of, ["snapshot_key", "column_key"]).select("snapshot_key", "table_key", "dependent_key", "kind", "column_key")
    relation = F.when(F.col("kind") == "trigger", "table_has_trigger").otherwise(F.concat(F.col("kind"), F.lit("_depends_on")))
    rows = on_table.unionByName(triggers).unionByName(on_column)
    return rows.groupBy("snapshot_key", "table_key", "dependent_key", "kind").agg(F.array_sort(F.collect_set("column_key")).alias("column_keys")).withColumn("relation", relation)


def inventory(c: Canonical, g: Graph) -> DataFrame:
    """T1 and T2 of every table in one pass."""
    deps = dependents(g).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("dependent_key", "kind", "relation", "column_keys"))).alias("dependents"))
    return describe_tables(c).join(deps, KEY, "left")


def inventory_page(c: Canonical, g: Graph, snapshot_key: str, offset: int = 0, limit: int = 1000) -> tuple[DataFrame, dict]:
    """T3's page in key order: the page's keys are cut first, and only those tables are described. limit is at most 5000; next_offset is None at the end."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    applied = min(limit, 5000)
    own = c.tables.where(F.col("snapshot_key") == snapshot_key).select("snapshot_key", F.col("key").alias("table_key"))
    total = own.count()
    page = own.orderBy("table_key").offset(offset).limit(applied)
    deps = dependents(g).join(page, KEY, "left_semi").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("dependent_key", "kind", "relation", "column_keys"))).alias("dependents"))
    more = offset + applied < total
    return describe_tables(c, page).join(deps, KEY, "left").orderBy("table_key"), {"total": total, "offset": offset, "limit_applied": applied, "clamped": applied != limit, "has_more": more, "next_offset": offset + applied if more else None}


def _tables(g: Graph) -> DataFrame:
    p = parse_key(F.col("node_key"))
    return g.nodes.where("label = 'Table'").select("snapshot_key", p["database"].alias("database"), p["schema"].alias("schema"), F.col("display_name").alias("table"), F.col("node_key").alias("key"))


def list_tables(g: Graph, snapshot_key: str, name: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, dict]:
    """T4: by (database, schema, table, key)."""
    rows = _tables(g).where(F.col("snapshot_key") == snapshot_key)
    rows = rows if not name else rows.where(contains_ci(F.col("table"), name))
    return paginate(rows, ["database", "schema", "table", "key"], offset, limit)


def find_tables(g: Graph, query: str) -> DataFrame:
    """T5: tables of all snapshots whose name contains query, by Unicode case folding; ordered (table, schema, database, key) where shown."""
    return _tables(g).where(contains_ci(F.col("table"), query))


def find_columns(g: Graph, query: str) -> DataFrame:
    """Columns by name, with the key of their table and the details of their type."""
    p = parse_key(F.col("node_key"))
    table_key = object_key(*[F.lit("table") if n == "object_kind" else p[n] for n in KEY_PARTS[:6]])
    rows = g.nodes.where("label = 'Column'").where(contains_ci(F.col("display_name"), query))
    detail = lambda x: F.get_json_object("payload_json", f"$.{x}")
    return rows.select("snapshot_key", p["database"].alias("database"), p["schema"].alias("schema"), p["object_name"].alias("table"), F.col("display_name").alias("column"), F.col("node_key").alias("key"), table_key.alias("table_key"), detail("data_type").alias("data_type"), detail("is_nullable").alias("is_nullable"))


def resolve_tables(g: Graph, selectors: DataFrame) -> DataFrame:
    """selectors(snapshot_key, selector) -> (snapshot_key, selector, status, table_key, candidates): a key, which must be a table's, or a name that is unique; not_a_table, not_found, or ambiguous with the sorted keys."""
    by_key = selectors.join(g.nodes.select("snapshot_key", F.col("node_key").alias("selector"), "label"), ["snapshot_key", "selector"], "left")
    names = _tables(g).groupBy("snapshot_key", F.col("table").alias("selector")).agg(F.array_sort(F.collect_list("key")).alias("found"))
    r = by_key.join(names, ["snapshot_key", "selector"], "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    status = F.when(F.col("label") == "Table", "found").when(F.col("label").isNotNull(), "not_a_table").when(n == 1, "found").when(n > 1, "ambiguous").otherwise("not_found")
    key = F.when(F.col("label") == "Table", F.col("selector")).when(F.col("label").isNull() & (n == 1), F.get("found", F.lit(0)))
    return r.select("snapshot_key", "selector", status.alias("status"), key.alias("table_key"), F.when(status == "ambiguous", F.concat_ws(",", "found")).alias("candidates"))
