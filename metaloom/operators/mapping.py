"""Canonical mapping (B*): extract tables of the information_schema family to canonical tables, and checks on extracts before mapping.

x holds the extract's tables by lower-case name, each with snapshot_key, and databases(snapshot_key, source_kind, connection_alias, name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import object_key, parse_key
from ..plans.model import MAX_TEXT, Canonical
from ..plans.shared import written

Extract = dict[str, DataFrame]
# Table types and kinds.
TABLE_KINDS = {"BASE TABLE": "base_table", "TEMPORARY": "temporary", "FOREIGN": "foreign", "PARTITIONED TABLE": "partitioned", "PARTITION": "partition", "VIRTUAL": "virtual", "SHADOW": "shadow"}
CONSTRAINT_TYPES = {"PRIMARY KEY": "primary_key", "FOREIGN KEY": "foreign_key", "UNIQUE": "unique", "CHECK": "check"}
KEY_KINDS = {"primary_key": "primary_key", "foreign_key": "foreign_key", "unique": "unique_constraint", "check": "check_constraint"}


def _map(c: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), c)


def _scoped(x: Extract, name: str) -> DataFrame:
    db = x["databases"].select("snapshot_key", F.col("source_kind").alias("_source"), F.col("connection_alias").alias("_alias"), F.col("name").alias("_database"))
    return x[name].join(db, "snapshot_key")


def _key(kind: Column | str, schema: str, name: str | Column, sub: str | Column | None = None) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return object_key(F.col("_source"), F.col("_alias"), F.col("_database"), F.col(schema), kind, col(name), None if sub is None else col(sub))


def prop(kind: str, v: Column) -> Column:
    """A tagged property value."""
    return F.struct(F.lit(kind).alias("type"), v.cast("string").alias("value"))


def _ordered(place: str, *fields: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(place).cast("int").alias("_p"), *fields)))


def map_schemas(x: Extract, only: list[str] | None = None) -> DataFrame:
    """B1: the schemas that have tables, views or routines, or those asked for."""
    parts = [_scoped(x, n).select("snapshot_key", "_source", "_alias", "_database", F.col(c).alias("_schema")) for n, c in (("schemata", "SCHEMA_NAME"), ("tables", "TABLE_SCHEMA")) if n in x]
    rows = reduce(DataFrame.unionByName, parts).distinct()
    rows = rows if only is None else rows.where(F.col("_schema").isin(*only))
    database = object_key(F.col("_source"), F.col("_alias"), F.col("_database"), F.col("_database"), "database", F.col("_database"))
    return rows.select("snapshot_key", _key("schema", "_schema", "_schema").alias("key"), database.alias("database_key"), F.col("_schema").alias("name"))


def map_tables(x: Extract) -> DataFrame:
    """B2: all but views."""
    t = _scoped(x, "tables").where("TABLE_TYPE not in ('VIEW', 'SYSTEM VIEW')")
    return t.select("snapshot_key", _key("table", "TABLE_SCHEMA", "TABLE_NAME").alias("key"), _key("schema", "TABLE_SCHEMA", "TABLE_SCHEMA").alias("schema_key"), F.col("TABLE_NAME").alias("name"), F.coalesce(_map(F.col("TABLE_TYPE"), TABLE_KINDS), F.lit("base_table")).alias("kind"))


def map_columns(x: Extract) -> DataFrame:
    """Columns of tables; those of views are B9's."""
    own = x["tables"].where("TABLE_TYPE not in ('VIEW', 'SYSTEM VIEW')").select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME")
    c = _scoped(x, "columns").join(own, ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left_semi")
    return c.select("snapshot_key", _key("column", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME").alias("key"), _key("table", "TABLE_SCHEMA", "TABLE_NAME").alias("table_key"), F.col("COLUMN_NAME").alias("name"), F.col("ORDINAL_POSITION").cast("int").alias("ordinal_position"), F.col("COLUMN_TYPE").alias("data_type"), (F.col("IS_NULLABLE") == "YES").alias("is_nullable"), F.col("COLUMN_DEFAULT").alias("default_value"), F.coalesce(F.col("EXTRA").contains("GENERATED"), F.lit(False)).alias("is_generated"))


def map_constraints(x: Extract) -> DataFrame:
    """Key usage grouped by constraint in order of ordinals; the pairs of a foreign key keep their order; checks take their clause and, where the extract has it, the columns used."""
    at = ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME"]
    use = _scoped(x, "key_column_usage")
    column = _key("column", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME")
    ref_table = _key("table", "REFERENCED_TABLE_SCHEMA", "REFERENCED_TABLE_NAME")
    ref_column = _key("column", "REFERENCED_TABLE_SCHEMA", "REFERENCED_TABLE_NAME", "REFERENCED_COLUMN_NAME")
    pairs = use.withColumn("c", column).withColumn("rt", ref_table).withColumn("rc", F.when(F.col("REFERENCED_COLUMN_NAME").isNotNull(), ref_column))
    keys = pairs.groupBy(*at).agg(_ordered("ORDINAL_POSITION", F.col("c"), F.col("rc")).alias("parts"), F.max("rt").alias("referenced_table_key"))
    out = _scoped(x, "table_constraints").join(keys, at, "left")
    if "check_constraints" in x:
        out = out.join(x["check_constraints"].select("snapshot_key", F.col("CONSTRAINT_SCHEMA").alias("TABLE_SCHEMA"), "TABLE_NAME", "CONSTRAINT_NAME", "CHECK_CLAUSE"), at, "left")
    else:
        out = out.withColumn("CHECK_CLAUSE", F.lit(None).cast("string"))
    kind = _map(F.col("CONSTRAINT_TYPE"), CONSTRAINT_TYPES)
    none = F.array().cast("array<string>")
    columns = F.coalesce(F.transform("parts", lambda p: p.c), none)
    refs = F.coalesce(F.filter(F.transform("parts", lambda p: p.rc), lambda k: k.isNotNull()), none)
    return out.select("snapshot_key", _key(_map(kind, KEY_KINDS), "TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME").alias("key"), _key("table", "TABLE_SCHEMA", "TABLE_NAME").alias("table_key"), F.col("CONSTRAINT_NAME").alias("name"), kind.alias("kind"), columns.alias("columns"), "referenced_table_key", refs.alias("referenced_columns"), F.col("CHECK_CLAUSE").alias("expression"))


def map_indexes(x: Extract) -> DataFrame:
    """Index parts in order; parts without a column are expressions, joined by commas."""
    s = _scoped(x, "statistics").withColumn("c", F.when(F.col("COLUMN_NAME").isNotNull(), _key("column", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME")))
    rows = s.groupBy("snapshot_key", "_source", "_alias", "_database", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME").agg(_ordered("SEQ_IN_INDEX", F.col("c"), F.col("EXPRESSION").alias("e")).alias("parts"), F.min("NON_UNIQUE").alias("non_unique"))
    kept = lambda f: F.filter(F.transform("parts", f), lambda v: v.isNotNull())
    expressions = kept(lambda p: p.e)
    return rows.select("snapshot_key", _key("index", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME").alias("key"), _key("table", "TABLE_SCHEMA", "TABLE_NAME").alias("table_key"), F.col("INDEX_NAME").alias("name"), kept(lambda p: p.c).alias("columns"), (F.col("non_unique") == 0).alias("is_unique"), (F.col("INDEX_NAME") == "PRIMARY").alias("is_primary"), F.when(F.size(expressions) > 0, F.concat_ws(", ", expressions)).alias("expression"))


def index_part_issues(x: Extract) -> DataFrame:
    """B5's check: the parts of one index disagree on whether it is unique."""
    s = _scoped(x, "statistics")
    rows = s.groupBy("snapshot_key", "_source", "_alias", "_database", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME").agg((F.min("NON_UNIQUE") != F.max("NON_UNIQUE")).alias("bad")).where("bad")
    return rows.select("snapshot_key", F.lit("index_parts_inconsistent").alias("code"), _key("index", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME").alias("object_key"), F.lit("the parts of an index disagree").alias("message"))


def ordinal_issues(x: Extract) -> DataFrame:
    """Ordinals of a table's columns, or of a key's parts, that aren't 1 to n."""
    parts = []
    for name, group, place in (("columns", ["TABLE_SCHEMA", "TABLE_NAME"], "ORDINAL_POSITION"), ("key_column_usage", ["TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME"], "ORDINAL_POSITION"), ("statistics", ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME"], "SEQ_IN_INDEX")):
        if name in x:
            at = F.row_number().over(W.partitionBy("snapshot_key", *group).orderBy(place))
            bad = x[name].withColumn("_at", at).where(F.col("_at") != F.col(place)).select("snapshot_key", F.concat_ws(".", *group).alias("object_key")).distinct()
            parts.append(bad.select("snapshot_key", F.lit("ordinals_not_contiguous").alias("code"), "object_key", F.lit(f"{name} has ordinals other than 1 to n").alias("message")))
    return reduce(DataFrame.unionByName, parts)


def _usage(x: Extract) -> DataFrame:
    """(snapshot_key, view's schema and name, dep): what VIEW_TABLE_USAGE names, resolved to a view where it is one, else to a table."""
    use = _scoped(x, "view_table_usage")
    views = x["views"].select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", F.lit(True).alias("_view"))
    met = use.join(views, ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left")
    kind = F.when(F.col("_view"), "view").otherwise("table")
    return met.select("snapshot_key", "VIEW_SCHEMA", "VIEW_NAME", _key(kind, "TABLE_SCHEMA", "TABLE_NAME").alias("dep"))


def map_views(x: Extract) -> DataFrame:
    """Dependencies sorted and without repeats."""
    deps = _usage(x).groupBy("snapshot_key", F.col("VIEW_SCHEMA").alias("TABLE_SCHEMA"), F.col("VIEW_NAME").alias("TABLE_NAME")).agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    v = _scoped(x, "views").join(deps, ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left")
    return v.select("snapshot_key", _key("view", "TABLE_SCHEMA", "TABLE_NAME").alias("key"), _key("schema", "TABLE_SCHEMA", "TABLE_SCHEMA").alias("schema_key"), F.col("TABLE_NAME").alias("name"), F.col("VIEW_DEFINITION").alias("definition"), F.coalesce("deps", F.array().cast("array<string>")).alias("depends_on"))


def out_of_scope(x: Extract) -> DataFrame:
    """B8's check: views that use what the extract doesn't hold."""
    have = x["tables"].select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME").unionByName(x["views"].select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"))
    lost = _scoped(x, "view_table_usage").join(have, ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left_anti")
    return lost.select("snapshot_key", F.lit("dependency_out_of_scope").alias("code"), _key("view", "VIEW_SCHEMA", "VIEW_NAME").alias("object_key"), F.lit("a view uses an object outside the extract").alias("message"))


def map_view_columns(x: Extract) -> DataFrame:
    """Output columns of views as metadata objects."""
    c = _scoped(x, "columns").join(x["views"].select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"), ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left_semi")
    properties = F.create_map(F.lit("data_type"), prop("string", F.col("COLUMN_TYPE")), F.lit("ordinal_position"), prop("unsigned", F.col("ORDINAL_POSITION")))
    return c.select("snapshot_key", _key("view_column", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME").alias("key"), _key("view", "TABLE_SCHEMA", "TABLE_NAME").alias("parent_key"), F.col("COLUMN_NAME").alias("name"), properties.alias("properties"))


def map_triggers(x: Extract) -> DataFrame:
    """One object for each trigger, its events sorted without repeats; the owner is a view where there is one of that name."""
    views = x["views"].select("snapshot_key", F.col("TABLE_SCHEMA").alias("EVENT_OBJECT_SCHEMA"), F.col("TABLE_NAME").alias("EVENT_OBJECT_TABLE"), F.lit(True).alias("_view"))
    t = _scoped(x, "triggers").join(views, ["snapshot_key", "EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE"], "left")
    routine = F.when(F.col("ACTION_ROUTINE").isNotNull(), _key("routine", "ACTION_ROUTINE_SCHEMA", "ACTION_ROUTINE"))
    t = t.withColumn("owner", _key(F.when(F.col("_view"), "view").otherwise("table"), "EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE")).withColumn("key", _key("trigger", "EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE", "TRIGGER_NAME")).withColumn("routine", routine)
    return t.groupBy("snapshot_key", "key").agg(F.min("owner").alias("table_key"), F.min("TRIGGER_NAME").alias("name"), F.min("ACTION_TIMING").alias("timing"), F.array_sort(F.collect_set("EVENT_MANIPULATION")).alias("events"), F.min("ACTION_STATEMENT").alias("definition"), F.min("routine").alias("executes_routine_key"))


def map_routines(x: Extract) -> DataFrame:
    """An overload's signature is its sub-object; dependencies come from routine_usage, where the extract has it."""
    r = _scoped(x, "routines")
    none = F.array().cast("array<string>")
    if "routine_usage" in x:
        use = _scoped(x, "routine_usage")
        dep = F.when(F.col("COLUMN_NAME").isNull(), _key("table", "TABLE_SCHEMA", "TABLE_NAME")).otherwise(_key("column", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME"))
        deps = use.withColumn("dep", dep).groupBy("snapshot_key", "ROUTINE_SCHEMA", "SPECIFIC_NAME").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
        r = r.join(deps, ["snapshot_key", "ROUTINE_SCHEMA", "SPECIFIC_NAME"], "left")
    else:
        r = r.withColumn("deps", none)
    return r.select("snapshot_key", _key("routine", "ROUTINE_SCHEMA", "ROUTINE_NAME", _signature()).alias("key"), _key("schema", "ROUTINE_SCHEMA", "ROUTINE_SCHEMA").alias("schema_key"), F.col("ROUTINE_NAME").alias("name"), F.lower("ROUTINE_TYPE").alias("kind"), F.col("ROUTINE_DEFINITION").alias("definition"), F.coalesce("deps", none).alias("depends_on"))


def _signature() -> Column:
    return F.when(F.col("SPECIFIC_NAME") != F.col("ROUTINE_NAME"), F.col("SPECIFIC_NAME"))


def _routine_keys(x: Extract) -> DataFrame:
    """(snapshot_key, ROUTINE_SCHEMA, SPECIFIC_NAME, ROUTINE_NAME, routine_key)."""
    return _scoped(x, "routines").select("snapshot_key", "ROUTINE_SCHEMA", "SPECIFIC_NAME", "ROUTINE_NAME", _key("routine", "ROUTINE_SCHEMA", "ROUTINE_NAME", _signature()).alias("routine_key"))


def map_parameters(x: Extract) -> tuple[DataFrame, DataFrame]:
    """Parameters as metadata objects of their routine, overloads included, and HAS_PARAMETER relationships by ordinal."""
    own = _routine_keys(x).withColumnRenamed("ROUTINE_SCHEMA", "SPECIFIC_SCHEMA")
    p = _scoped(x, "parameters").where("ORDINAL_POSITION > 0").join(own, ["snapshot_key", "SPECIFIC_SCHEMA", "SPECIFIC_NAME"])
    p = p.withColumn("name", F.coalesce("PARAMETER_NAME", F.concat(F.lit("argument_"), F.col("ORDINAL_POSITION").cast("string"))))
    p = p.withColumn("key", _key("routine_parameter", "SPECIFIC_SCHEMA", "ROUTINE_NAME", F.concat_ws(":", "SPECIFIC_NAME", F.col("ORDINAL_POSITION").cast("string"), "name")))
    properties = F.create_map(F.lit("ordinal_position"), prop("unsigned", F.col("ORDINAL_POSITION")))
    return p.select("snapshot_key", "key", F.col("routine_key").alias("parent_key"), "name", properties.alias("properties")), p.select("snapshot_key", F.lit("has_parameter").alias("kind"), F.col("routine_key").alias("from_key"), F.col("key").alias("to_key"), F.col("ORDINAL_POSITION").cast("int").alias("ordinal"))


def map_sequences(x: Extract) -> DataFrame:
    """B14. This family's catalog names no user of a sequence, so that there are no USES_SEQUENCE relationships."""
    s = _scoped(x, "sequences")
    return s.select("snapshot_key", _key("sequence", "SEQUENCE_SCHEMA", "SEQUENCE_NAME").alias("key"), _key("schema", "SEQUENCE_SCHEMA", "SEQUENCE_SCHEMA").alias("parent_key"), F.col("SEQUENCE_NAME").alias("name"))


def map_partitions(x: Extract) -> tuple[DataFrame, DataFrame]:
    """(objects, issues): partitions of a table and, under each, its sub-partitions. A partition has a row for each of its sub-partitions; its own values are those of the first. Rows of tables that aren't partitioned have no partition's name."""
    own = x["tables"].select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", F.lit(True).alias("_table"))
    p = _scoped(x, "partitions").where("PARTITION_NAME is not null").join(own, ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"], "left")
    part, sub = F.concat(F.lit("partition:"), F.col("PARTITION_NAME")), F.concat(F.lit("partition:"), F.col("PARTITION_NAME"), F.lit(":subpartition:"), F.col("SUBPARTITION_NAME"))
    p = p.withColumn("partition_key", _key("extension", "TABLE_SCHEMA", "TABLE_NAME", part)).withColumn("sub_key", F.when(F.col("SUBPARTITION_NAME").isNotNull(), _key("extension", "TABLE_SCHEMA", "TABLE_NAME", sub))).withColumn("table_key", _key("table", "TABLE_SCHEMA", "TABLE_NAME"))
    known = p.where("_table")
    held = ["PARTITION_NAME", "PARTITION_ORDINAL_POSITION", "PARTITION_METHOD", "PARTITION_EXPRESSION", "PARTITION_DESCRIPTION"]
    whole = known.groupBy("snapshot_key", "partition_key", "table_key").agg(F.min_by(F.struct(*held), F.coalesce("SUBPARTITION_ORDINAL_POSITION", F.lit(0))).alias("p")).select("*", "p.*")
    subs = known.where("sub_key is not null").dropDuplicates(["snapshot_key", "sub_key"])

    def made(df: DataFrame, key: str, parent: str, of: str, kind: str) -> DataFrame:
        held = {"ordinal_position": prop("unsigned", F.col(f"{of}_ORDINAL_POSITION")), "method": prop("string", F.col(f"{of}_METHOD")), "expression": prop("string", F.col(f"{of}_EXPRESSION"))}
        held |= {"description": prop("string", F.col("PARTITION_DESCRIPTION"))} if of == "PARTITION" else {}
        properties = F.map_filter(F.create_map(*[v for n, c in held.items() for v in (F.lit(n), c)]), lambda _, v: v.value.isNotNull())
        return df.select("snapshot_key", F.col(key).alias("key"), F.col(parent).alias("parent_key"), F.col(f"{of}_NAME").alias("name"), F.lit(kind).alias("extension_kind"), F.col(f"{of}_EXPRESSION").alias("definition"), properties.alias("properties"))

    twice = known.where("sub_key is not null").groupBy("snapshot_key", F.col("sub_key").alias("object_key")).agg(F.count("*").alias("n")).where("n > 1")
    issue = lambda df, code, message: df.select("snapshot_key", F.lit(code).alias("code"), "object_key", F.lit(message).alias("message"))
    lost = p.where("_table is null").select("snapshot_key", F.col("partition_key").alias("object_key")).distinct()
    return made(whole, "partition_key", "table_key", "PARTITION", "mysql_partition").unionByName(made(subs, "sub_key", "partition_key", "SUBPARTITION", "mysql_subpartition")), issue(twice, "duplicate_subpartition", "a sub-partition is repeated").unionByName(issue(lost, "partition_table_missing", "a partition is of a table that the extract lacks"))


def map_events(x: Extract) -> DataFrame:
    """B20."""
    e = _scoped(x, "events")
    return e.select("snapshot_key", _key("event", "EVENT_SCHEMA", "EVENT_NAME").alias("key"), _key("schema", "EVENT_SCHEMA", "EVENT_SCHEMA").alias("parent_key"), F.col("EVENT_NAME").alias("name"), F.col("EVENT_DEFINITION").alias("definition"))


def map_invokes(x: Extract) -> DataFrame:
    """INVOKES from views to the routines that VIEW_ROUTINE_USAGE names. V14 refuses such ends; they are mapped all the same, so that the snapshot fails for it."""
    use = _scoped(x, "view_routine_usage").withColumnRenamed("SPECIFIC_SCHEMA", "ROUTINE_SCHEMA").join(_routine_keys(x), ["snapshot_key", "ROUTINE_SCHEMA", "SPECIFIC_NAME"])
    return use.select("snapshot_key", F.lit("invokes").alias("kind"), _key("view", "TABLE_SCHEMA", "TABLE_NAME").alias("from_key"), F.col("routine_key").alias("to_key"))


def merge_properties(a: Column, b: Column) -> tuple[Column, Column]:
    """Both maps together, and whether they disagree on a key."""
    conflict = F.exists(F.map_entries(F.map_zip_with(a, b, lambda _, x, y: x.isNotNull() & y.isNotNull() & (x != y))), lambda e: e.value)
    only = F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))
    return F.map_concat(a, only), conflict


def unique_relationships(r: DataFrame, vendor: str) -> tuple[DataFrame, DataFrame]:
    """One row for each (kind, from, to, ordinal), and the repeated ones as issues; SQLite drops repeats without one."""
    at = ["snapshot_key", "kind", "from_key", "to_key", "ordinal"]
    again = r.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    issues = again.select("snapshot_key", F.lit("duplicate_relationship").alias("code"), F.concat(F.col("kind"), F.lit(":"), F.col("from_key"), F.lit("->"), F.col("to_key")).alias("object_key"), F.lit("a relationship is repeated").alias("message"))
    return r.dropDuplicates(at), issues if vendor != "sqlite" else issues.where("false")


def normalise(c: Canonical) -> Canonical:
    """Dependencies, events, notes and limitations sorted without repeats; the order of key, reference and index columns stays."""
    tidy = lambda name: F.array_sort(F.array_distinct(name))
    return c.with_tables(views=c.views.withColumn("depends_on", tidy("depends_on")), routines=c.routines.withColumn("depends_on", tidy("depends_on")), triggers=c.triggers.withColumn("events", tidy("events")), capabilities=c.capabilities.withColumn("limitations", tidy("limitations")).withColumn("notes", tidy("notes")))


def digests(x: Extract) -> DataFrame:
    """(snapshot_key, table_name, n, sum, xor): of each snapshot's rows of each table a digest that doesn't depend on their order and is put together from parts, so that a scan and a row for each task and snapshot are all that it takes."""
    parts = []
    for name in sorted(x.keys()):
        cols = sorted(x[name].columns)
        hashed = lambda seed, cols=cols: F.xxhash64(F.lit(seed), *cols, *[F.col(c).isNull() for c in cols])
        parts.append(x[name].groupBy("snapshot_key").agg(F.count("*").alias("n"), F.sum(hashed(1).cast("decimal(38,0)")).alias("sum"), F.bit_xor(hashed(2)).alias("xor")).select("snapshot_key", F.lit(name).alias("table_name"), "n", "sum", "xor"))
    return reduce(DataFrame.unionByName, parts)


def unstable(first: Extract, second: Extract) -> DataFrame:
    """(snapshot_key, table_name, rows): rows that only one of two reads of an extract has. Digests are compared first; rows are only where these differ, of those tables and snapshots alone."""
    both = first.keys() & second.keys()
    sides = [digests({n: x[n] for n in both}) for x in (first, second)]
    keys = ["snapshot_key", "table_name"]
    renamed = sides[1].select(*keys, *[F.col(c).alias(f"{c}_") for c in ("n", "sum", "xor")])
    same = F.col("n").eqNullSafe(F.col("n_")) & F.col("sum").eqNullSafe(F.col("sum_")) & F.col("xor").eqNullSafe(F.col("xor_"))
    apart = written(sides[0].join(renamed, keys, "full").where(~same).select(*keys), "apart")
    parts = [apart.where("false").select(*keys, F.lit(0).cast("long").alias("rows"))]
    # The names of tables are a list of fixed size.
    for name in sorted(r[0] for r in apart.select("table_name").distinct().collect()):
        own = apart.where(F.col("table_name") == name)
        a, b = [x[name].select(*first[name].columns).join(own, "snapshot_key", "left_semi") for x in (first, second)]
        rows = a.exceptAll(b).unionByName(b.exceptAll(a))
        parts.append(rows.groupBy("snapshot_key").agg(F.count("*").alias("rows")).select("snapshot_key", F.lit(name).alias("table_name"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def open_dependencies(x: Extract, c: Canonical, vendor: str) -> DataFrame:
    """Bodies whose dependencies no catalog vouches for. The MySQL family has none for routines, triggers and events; PostgreSQL none for bodies in languages that it doesn't parse, SQL Server none for references found only at run time and for texts that are run."""
    if vendor in ("postgres", "yugabytedb"):
        from . import postgres

        return postgres.open_dependencies(x)
    if vendor == "sqlserver":
        from . import sqlserver

        ids = sqlserver.registry(x)
        return sqlserver.open_dependencies(x, ids, sqlserver.dependencies(x, ids)[0])
    if vendor not in ("mysql", "mariadb"):
        raise ValueError(f"no rule for {vendor}")
    rows = c.routines.select("snapshot_key", "key").unionByName(c.triggers.select("snapshot_key", "key"))
    if "events" in x:
        rows = rows.unionByName(map_events(x).select("snapshot_key", "key"))
    return rows.select("snapshot_key", F.lit("dependency_closure_unproven").alias("code"), F.col("key").alias("object_key"), F.lit("no catalog proves what this body uses").alias("message"))


def large_texts(x: Extract) -> DataFrame:
    """Definitions over 1 MiB."""
    fields = [("views", "VIEW_DEFINITION", ["TABLE_SCHEMA", "TABLE_NAME"]), ("routines", "ROUTINE_DEFINITION", ["ROUTINE_SCHEMA", "ROUTINE_NAME"]), ("triggers", "ACTION_STATEMENT", ["EVENT_OBJECT_SCHEMA", "TRIGGER_NAME"])]
    parts = [x[t].where(F.octet_length(c) > MAX_TEXT).select("snapshot_key", F.lit("metadata_text_too_large").alias("code"), F.concat_ws(".", *at).alias("object_key"), F.lit(f"{t}.{c} is over the size limit").alias("message")) for t, c, at in fields if t in x]
    return reduce(DataFrame.unionByName, parts)


def inventory_issues(x: Extract) -> DataFrame:
    """Names that aren't unique, and columns, keys and index parts of tables that the extract lacks."""
    at = ["snapshot_key", "TABLE_SCHEMA", "TABLE_NAME"]
    issue = lambda df, code, message: df.select("snapshot_key", F.lit(code).alias("code"), F.concat_ws(".", "TABLE_SCHEMA", "TABLE_NAME").alias("object_key"), F.lit(message).alias("message"))
    twice = x["tables"].groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    parts = [issue(twice, "duplicate_table_name", "two tables share a name")]
    parts += [issue(x[n].select(*at).distinct().join(x["tables"], at, "left_anti"), "table_missing", f"{n} names a table that the extract lacks") for n in ("columns", "table_constraints", "key_column_usage", "statistics") if n in x]
    return reduce(DataFrame.unionByName, parts)


def unsupported(x: Extract) -> DataFrame:
    """Tables of a type that the model has no kind for."""
    known = [*TABLE_KINDS, "VIEW", "SYSTEM VIEW"]
    return x["tables"].where(~F.col("TABLE_TYPE").isin(*known)).select("snapshot_key", F.lit("unsupported_object").alias("code"), F.concat_ws(".", "TABLE_SCHEMA", "TABLE_NAME").alias("object_key"), F.col("TABLE_TYPE").alias("message"))


def map_catalog(x: Extract, vendor: str = "mysql") -> Canonical:
    """All of an extract: of information_schema, of pg_catalog for postgres and yugabytedb, or of sys for sqlserver."""
    if vendor in ("postgres", "yugabytedb"):
        from . import postgres

        return postgres.map_catalog(x)
    if vendor == "sqlserver":
        from . import sqlserver

        return sqlserver.map_catalog(x)[0]
    spark = x["tables"].sparkSession
    db = x["databases"]
    databases = db.select("snapshot_key", object_key(F.col("source_kind"), F.col("connection_alias"), F.col("name"), F.col("name"), "database", F.col("name")).alias("key"), "name", "source_kind", "connection_alias")
    parameters = map_parameters(x) if "parameters" in x else None
    objects = [map_view_columns(x), *([parameters[0]] if parameters else []), *([map_sequences(x)] if "sequences" in x else []), *([map_events(x)] if "events" in x else []), *([map_partitions(x)[0]] if "partitions" in x else [])]
    links = [*([parameters[1]] if parameters else []), *([map_invokes(x)] if "view_routine_usage" in x else [])]
    more = {"metadata_objects": reduce(lambda a, b: a.unionByName(b, True), objects)}
    if links:
        more["relationships"] = reduce(lambda a, b: a.unionByName(b, True), links)
    return Canonical.of(spark, databases=databases, schemas=map_schemas(x), tables=map_tables(x), columns=map_columns(x), constraints=map_constraints(x), indexes=map_indexes(x), views=map_views(x), triggers=map_triggers(x), routines=map_routines(x), **more)


def as_information_schema(c: Canonical) -> Extract:
    """The other way: the extract that a server with these objects would give. Used to make extracts from other sources, and to hold the mapping against itself."""
    p = lambda col, f: parse_key(F.col(col))[f]
    sub = lambda col: parse_key(F.col(col))["sub_object"]
    owner = lambda col: [p(col, "schema").alias("TABLE_SCHEMA"), p(col, "object_name").alias("TABLE_NAME")]
    text = lambda: F.lit(None).cast("string")
    kind = F.element_at(F.create_map(*[F.lit(v) for k, n in TABLE_KINDS.items() for v in (n, k)]), F.col("kind"))
    tables = c.tables.select("snapshot_key", *owner("key"), kind.alias("TABLE_TYPE")).unionByName(c.views.select("snapshot_key", *owner("key"), F.lit("VIEW").alias("TABLE_TYPE")))
    columns = c.columns.select("snapshot_key", *owner("key"), F.col("name").alias("COLUMN_NAME"), F.col("ordinal_position").alias("ORDINAL_POSITION"), F.col("data_type").alias("COLUMN_TYPE"), F.when(F.col("is_nullable"), "YES").otherwise("NO").alias("IS_NULLABLE"), F.col("default_value").alias("COLUMN_DEFAULT"), F.when(F.col("is_generated"), "STORED GENERATED").otherwise("").alias("EXTRA"))
    kinds = F.element_at(F.create_map(*[F.lit(v) for k, n in CONSTRAINT_TYPES.items() for v in (n, k)]), F.col("kind"))
    constraints = c.constraints.select("snapshot_key", *owner("key"), F.col("name").alias("CONSTRAINT_NAME"), kinds.alias("CONSTRAINT_TYPE"))
    pairs = c.constraints.select("snapshot_key", *owner("key"), F.col("name").alias("CONSTRAINT_NAME"), "kind", "referenced_table_key", F.posexplode(F.arrays_zip("columns", "referenced_columns")).alias("i", "z"))
    usage = pairs.select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME", sub("z.columns").alias("COLUMN_NAME"), (F.col("i") + 1).alias("ORDINAL_POSITION"), p("referenced_table_key", "schema").alias("REFERENCED_TABLE_SCHEMA"), p("referenced_table_key", "object_name").alias("REFERENCED_TABLE_NAME"), sub("z.referenced_columns").alias("REFERENCED_COLUMN_NAME"))
    checks = c.constraints.where("kind = 'check'").select("snapshot_key", p("key", "schema").alias("CONSTRAINT_SCHEMA"), p("key", "object_name").alias("TABLE_NAME"), F.col("name").alias("CONSTRAINT_NAME"), F.col("expression").alias("CHECK_CLAUSE"))
    statistics = c.indexes.select("snapshot_key", *owner("key"), F.col("name").alias("INDEX_NAME"), F.when(F.col("is_unique"), 0).otherwise(1).alias("NON_UNIQUE"), F.posexplode("columns").alias("i", "c")).select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "NON_UNIQUE", (F.col("i") + 1).alias("SEQ_IN_INDEX"), sub("c").alias("COLUMN_NAME"), text().alias("EXPRESSION"))
    views = c.views.select("snapshot_key", *owner("key"), F.col("definition").alias("VIEW_DEFINITION"))
    uses = c.views.select("snapshot_key", p("key", "schema").alias("VIEW_SCHEMA"), p("key", "object_name").alias("VIEW_NAME"), F.explode("depends_on").alias("d")).select("snapshot_key", "VIEW_SCHEMA", "VIEW_NAME", *owner("d"))
    triggers = c.triggers.select("snapshot_key", p("key", "schema").alias("EVENT_OBJECT_SCHEMA"), p("key", "object_name").alias("EVENT_OBJECT_TABLE"), F.col("name").alias("TRIGGER_NAME"), F.col("timing").alias("ACTION_TIMING"), F.explode("events").alias("EVENT_MANIPULATION"), F.col("definition").alias("ACTION_STATEMENT"), p("executes_routine_key", "schema").alias("ACTION_ROUTINE_SCHEMA"), p("executes_routine_key", "object_name").alias("ACTION_ROUTINE"))
    routines = c.routines.select("snapshot_key", p("key", "schema").alias("ROUTINE_SCHEMA"), F.col("name").alias("ROUTINE_NAME"), F.coalesce(sub("key"), F.col("name")).alias("SPECIFIC_NAME"), F.upper("kind").alias("ROUTINE_TYPE"), F.col("definition").alias("ROUTINE_DEFINITION"))
    routine_usage = c.routines.select("snapshot_key", p("key", "schema").alias("ROUTINE_SCHEMA"), F.coalesce(sub("key"), F.col("name")).alias("SPECIFIC_NAME"), F.explode("depends_on").alias("d")).select("snapshot_key", "ROUTINE_SCHEMA", "SPECIFIC_NAME", *owner("d"), sub("d").alias("COLUMN_NAME"))
    return {"databases": c.databases.select("snapshot_key", "source_kind", "connection_alias", "name"), "tables": tables, "columns": columns, "table_constraints": constraints, "key_column_usage": usage, "check_constraints": checks, "statistics": statistics, "views": views, "view_table_usage": uses, "triggers": triggers, "routines": routines, "routine_usage": routine_usage}
