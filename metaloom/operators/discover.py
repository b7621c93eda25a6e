"""Discovered counts (B30): how many objects and relations of each category the raw catalog tables hold, counted on raw rows and ids alone, so that certification compares two independent numbers.

Each raw table is scanned once: the scan adds up all the categories that its rows count for, to one row for each snapshot and task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import OBJECT_CATEGORIES, RELATION_CATEGORIES
from ..plans.shared import written_all
from .mapping import CONSTRAINT_TYPES, KEY_KINDS, Extract
from .postgres import CONSTRAINTS as PG_CONSTRAINTS
from .postgres import KEY_KINDS as PG_KEY_KINDS

AT = ["snapshot_key"]
NONE = "the catalog has no such rows"


def _scan(df: DataFrame, evidence: str, objects: dict[str, Column | int] | None = None, relations: dict[str, Column | int] | None = None) -> DataFrame:
    """(snapshot_key, domain, category, n, evidence) of one table; a category counts the rows where its column is true, or adds up its numbers."""
    wanted = [(d, c, n) for d, of in (("object", objects), ("relationship", relations)) for c, n in (of or {}).items()]
    # A null condition counts for nothing.
    sums = df.groupBy(*AT).agg(*[F.sum(F.coalesce((F.lit(n) if isinstance(n, int) else n).cast("long"), F.lit(0))).alias(f"n{k}") for k, (_, _, n) in enumerate(wanted)])
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("category"), F.col(f"n{k}").alias("n")) for k, (d, c, _) in enumerate(wanted)])
    return sums.select(*AT, F.explode(rows).alias("r")).select(*AT, "r.*", F.lit(evidence).alias("evidence"))


def _summed(scans: list[DataFrame], databases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, relations), each (snapshot_key, category, discovered, evidence) over all categories; one that no scan counts is 0, and says so. The scans run once, as parts of one written table."""
    scans = list(written_all({f"counts_{k}": reduce(DataFrame.unionByName, scans[k::4]) for k in range(min(4, len(scans)))}).values())
    got = reduce(DataFrame.unionByName, scans).groupBy(*AT, "domain", "category").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("evidence")), "; ").alias("seen"))
    every = [F.struct(F.lit(d).alias("domain"), F.lit(c).alias("category")) for d, names in (("object", OBJECT_CATEGORIES), ("relationship", RELATION_CATEGORIES)) for c in names]
    rows = databases.select(*AT).distinct().select(*AT, F.explode(F.array(*every)).alias("c")).select(*AT, "c.*").join(got, [*AT, "domain", "category"], "left")
    rows = rows.select(*AT, "domain", "category", F.coalesce("n", F.lit(0)).cast("long").alias("discovered"), F.coalesce("seen", F.lit(NONE)).alias("evidence"))
    return tuple(rows.where(F.col("domain") == d).drop("domain") for d in ("object", "relationship"))


def _is(c: str, *values: str) -> Column:
    return F.col(c).isin(*values)


ONE = 1


def information_schema(x: Extract) -> list[DataFrame]:
    view = _is("TABLE_TYPE", "VIEW", "SYSTEM VIEW")
    kinds = x["tables"].select(*AT, "TABLE_SCHEMA", "TABLE_NAME", view.alias("_view"))
    schemas = [x[n].select(*AT, F.col(c).alias("s")) for n, c in (("schemata", "SCHEMA_NAME"), ("tables", "TABLE_SCHEMA")) if n in x]
    fk = F.col("REFERENCED_COLUMN_NAME").isNotNull()
    first = F.col("SEQ_IN_INDEX") == 1
    triggers = x["triggers"].groupBy(*AT, "EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE", "TRIGGER_NAME").agg(F.max("ACTION_ROUTINE").alias("routine"))
    out = [
        _scan(x["databases"], "the connection's database", {"database": ONE}),
        _scan(reduce(DataFrame.unionByName, schemas).distinct(), "distinct schema names", {"schema": ONE}, {"database_has_schema": ONE}),
        _scan(x["tables"], "TABLES", {"table": ~view, "view": view}, {"schema_has_table": ~view, "schema_has_view": view}),
        _scan(x["columns"].join(kinds, [*AT, "TABLE_SCHEMA", "TABLE_NAME"], "left"), "COLUMNS", {"column": ~F.col("_view"), "view_column": F.col("_view")}, {"table_has_column": ~F.col("_view"), "metadata_parent": F.col("_view")}),
        _scan(x["table_constraints"], "TABLE_CONSTRAINTS", {KEY_KINDS[k]: F.col("CONSTRAINT_TYPE") == t for t, k in CONSTRAINT_TYPES.items()}, {"table_has_constraint": ONE}),
        _scan(x["key_column_usage"], "KEY_COLUMN_USAGE", relations={"constraint_column": ~fk, "foreign_key_column_pair": fk}),
        _scan(x["statistics"], "STATISTICS", {"index": first}, {"table_has_index": first, "index_column": F.col("COLUMN_NAME").isNotNull()}),
        _scan(triggers, "distinct TRIGGERS", {"trigger": ONE}, {"trigger_target": ONE, "trigger_routine": F.col("routine").isNotNull()}),
        _scan(x["routines"], "ROUTINES", {"routine": ONE}, {"schema_has_routine": ONE}),
        _scan(x["view_table_usage"].distinct(), "VIEW_TABLE_USAGE", relations={"view_dependency": ONE}),
    ]
    if "routine_usage" in x:
        out.append(_scan(x["routine_usage"].distinct(), "routine usage", relations={"routine_dependency": ONE}))
    if "parameters" in x:
        named = F.col("ORDINAL_POSITION") > 0
        out.append(_scan(x["parameters"], "PARAMETERS", {"routine_parameter": named}, {"metadata_parent": named, "metadata_relationship": named}))
    for name, category in (("sequences", "sequence"), ("events", "event")):
        if name in x:
            out.append(_scan(x[name], name.upper(), {category: ONE}, {"metadata_parent": ONE}))
    if "partitions" in x:
        at = [*AT, "TABLE_SCHEMA", "TABLE_NAME", "PARTITION_NAME"]
        named = x["partitions"].where("PARTITION_NAME is not null")
        for rows in (named.select(*at).distinct(), named.where("SUBPARTITION_NAME is not null").select(*at, "SUBPARTITION_NAME").distinct()):
            out.append(_scan(rows, "distinct PARTITIONS", {"extension": ONE}, {"metadata_parent": ONE}))
    if "view_routine_usage" in x:
        out.append(_scan(x["view_routine_usage"], "VIEW_ROUTINE_USAGE", relations={"metadata_relationship": ONE}))
    return out


def pg_catalog(x: Extract) -> list[DataFrame]:
    kind = _is("relkind", "r", "p", "f")
    classes = lambda c: x["pg_class"].select(*AT, F.col("oid").alias(c), "relkind")
    of = lambda name, c: x[name].join(classes(c), [*AT, c])
    view, mat = F.col("relkind") == "v", F.col("relkind") == "m"
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    used = lambda c: F.size(F.filter(c, lambda n: n != 0))
    out = [
        _scan(x["databases"], "the connection's database", {"database": ONE}),
        _scan(x["pg_namespace"], "pg_namespace", {"schema": ONE}, {"database_has_schema": ONE}),
        _scan(x["pg_class"], "pg_class", {"table": kind, "view": view, "materialized_view": mat, "sequence": F.col("relkind") == "S"}, {"schema_has_table": kind, "schema_has_view": view, "metadata_parent": mat | (F.col("relkind") == "S")}),
        _scan(of("pg_attribute", "attrelid").where("attnum > 0 and not attisdropped"), "pg_attribute", {"column": kind, "view_column": view | mat}, {"table_has_column": kind, "metadata_parent": view | mat}),
    ]
    if "pg_constraint" in x:
        typed = kind & (F.col("contype") != "x")
        k = of("pg_constraint", "conrelid").where(F.col("contype").isin(*PG_CONSTRAINTS) & (kind | mat))
        fk, excludes = typed & (F.col("contype") == "f"), kind & (F.col("contype") == "x")
        n = lambda c, cond: F.when(cond, c)
        counted = {v: (F.col("contype") == t) & (typed | mat) for t, v in PG_KEY_KINDS.items() if t != "x"}
        out.append(_scan(k, "pg_constraint", counted | {"exclusion_constraint": excludes}, {"table_has_constraint": typed, "constraint_column": n(size("conkey"), typed & (F.col("contype") != "f")), "foreign_key_column_pair": n(size("conkey"), fk), "metadata_parent": mat | excludes, "metadata_relationship": n(size("conkey"), excludes)}))
    if "pg_index" in x:
        i = of("pg_index", "indrelid").where(kind | mat)
        out.append(_scan(i, "pg_index", {"index": ONE}, {"table_has_index": kind, "metadata_parent": mat, "index_column": F.when(kind, used(F.expr("slice(indkey, 1, indnkeyatts)"))), "metadata_relationship": used(F.expr("slice(indkey, indnkeyatts + 1, size(indkey))"))}))
    if "pg_depend" in x:
        # What a dependency leads to: a column only of a table, else the whole relation.
        d = x["pg_depend"].where("refclassid = 'pg_class'").join(classes("refobjid").withColumnRenamed("relkind", "refkind"), [*AT, "refobjid"])
        d = d.where(_is("refkind", *"rpfvmSiIc")).withColumn("sub", F.when(_is("refkind", "r", "p", "f"), F.col("refobjsubid")).otherwise(0))
        if "pg_rewrite" in x:
            rules = x["pg_rewrite"].select(*AT, F.col("oid").alias("objid"), "ev_class")
            u = d.where("classid = 'pg_rewrite'").join(rules, [*AT, "objid"]).where("ev_class <> refobjid").join(classes("ev_class"), [*AT, "ev_class"]).select(*AT, "ev_class", "relkind", "refobjid", "sub", "refkind").distinct()
            whole = (F.col("sub") == 0) & _is("refkind", "r", "p", "f", "v")
            out.append(_scan(u, "pg_depend of pg_rewrite", relations={"view_dependency": view, "metadata_relationship": F.when(mat, 1 + whole.cast("int"))}))
        p = d.where("classid = 'pg_proc'").select(*AT, "objid", "refobjid", "sub").distinct()
        out.append(_scan(p, "pg_depend of pg_proc", relations={"routine_dependency": ONE}))
        s = d.where("classid = 'pg_class' and refobjsubid > 0 and deptype in ('a', 'i')").where(_is("refkind", "r", "p", "f")).join(classes("objid"), [*AT, "objid"])
        out.append(_scan(s, "pg_depend of sequences", relations={"metadata_relationship": F.col("relkind") == "S"}))
    types = None
    if "pg_type" in x:
        rows = classes("typrelid").where("relkind <> 'c'").select(*AT, "typrelid")
        types = x["pg_type"].where("typtype in ('e', 'd', 'c', 'r')").join(rows, [*AT, "typrelid"], "left_anti")
        domain = F.col("typtype") == "d"
        out.append(_scan(types, "pg_type", {"user_defined_type": ~domain, "domain": domain}, {"metadata_parent": ONE}))
        ids = lambda c: types.select(*AT, F.col("oid").alias(c))
        a = of("pg_attribute", "attrelid").where("attnum > 0 and not attisdropped").where(kind | view | mat).join(ids("atttypid"), [*AT, "atttypid"])
        out.append(_scan(a, "pg_attribute of user types", relations={"metadata_relationship": ONE}))
        if "pg_proc" in x:
            out.append(_scan(x["pg_proc"].join(ids("prorettype"), [*AT, "prorettype"]), "pg_proc of user types", relations={"metadata_relationship": ONE}))
        if "pg_enum" in x:
            out.append(_scan(x["pg_enum"].join(ids("enumtypid"), [*AT, "enumtypid"]), "pg_enum", {"enum_value": ONE}, {"metadata_parent": ONE}))
    if "pg_proc" in x:
        arguments = size("proargtypes")
        out.append(_scan(x["pg_proc"], "pg_proc", {"routine": ONE, "routine_parameter": arguments}, {"schema_has_routine": ONE, "metadata_parent": arguments, "metadata_relationship": arguments}))
    if "pg_trigger" in x:
        out.append(_scan(of("pg_trigger", "tgrelid").where("not tgisinternal").where(kind | view), "pg_trigger", {"trigger": ONE}, {"trigger_target": ONE, "trigger_routine": F.col("tgfoid") != 0, "metadata_relationship": size("tgattr")}))
    if "pg_roles" in x:
        roles = lambda c: x["pg_roles"].select(*AT, F.col("oid").alias(c))
        out.append(_scan(x["pg_roles"], "pg_roles", {"principal": ONE}, {"metadata_parent": ONE}))
        out.append(_scan(x["pg_class"].where(_is("relkind", *"rpfvmS")).join(roles("relowner"), [*AT, "relowner"]), "pg_class.relowner", relations={"metadata_relationship": ONE}))
        out.append(_scan(x["pg_namespace"].join(roles("nspowner"), [*AT, "nspowner"]), "pg_namespace.nspowner", relations={"metadata_relationship": ONE}))
        if "pg_auth_members" in x:
            out.append(_scan(x["pg_auth_members"], "pg_auth_members", relations={"metadata_relationship": ONE}))
    if "pg_policy" in x:
        out.append(_scan(x["pg_policy"], "pg_policy", {"policy": ONE}, {"metadata_parent": ONE, "metadata_relationship": ONE}))
    if "pg_inherits" in x:
        out.append(_scan(x["pg_inherits"], "pg_inherits", relations={"metadata_relationship": ONE}))
    for name, category in (("pg_event_trigger", "event"), ("pg_extension", "extension")):
        if name in x:
            out.append(_scan(x[name], name, {category: ONE}, {"metadata_parent": ONE} | ({"metadata_relationship": ONE} if category == "event" else {})))
    return out


def discovered(x: Extract, vendor: str = "mysql") -> tuple[DataFrame, DataFrame]:
    """(objects, relations), each (snapshot_key, category, discovered, evidence), of all 26 and all 16 categories, with 0 for what the raw tables have none of. Tables that the extract lacks count nothing, as mapping makes nothing of them."""
    if vendor not in ("mysql", "mariadb", "postgres", "yugabytedb"):
        raise ValueError(f"no counts for {vendor}")
    scans = pg_catalog if vendor in ("postgres", "yugabytedb") else information_schema
    return _summed(scans(x), x["databases"])
