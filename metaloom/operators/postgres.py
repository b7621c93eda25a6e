"""Canonical mapping (B*) of PostgreSQL catalogs: raw pg_catalog tables of any number of databases to canonical tables, by joins on oids.

x holds the extract's tables by name, each with snapshot_key, and databases(snapshot_key, source_kind, connection_alias, name). Object classes in pg_depend and expressions are texts, as regclass and pg_get_expr give them; attribute lists are arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import object_key
from ..plans.model import Canonical
from ..plans.shared import written
from .mapping import Extract, _ordered, _scoped, prop

# Letters that the catalog has for kinds of relations, constraints, routines and types, and bits of trigger types.
RELATIONS = {"r": "table", "p": "table", "f": "table", "v": "view", "m": "materialized_view", "S": "sequence", "i": "index", "I": "index", "c": "user_defined_type"}
CONSTRAINTS = {"p": "primary_key", "u": "unique", "f": "foreign_key", "c": "check", "x": "exclusion"}
KEY_KINDS = {"p": "primary_key", "u": "unique_constraint", "f": "foreign_key", "c": "check_constraint", "x": "exclusion_constraint"}
ROUTINES = {"f": "function", "a": "function", "w": "function", "p": "procedure"}
EVENTS = {4: "INSERT", 8: "DELETE", 16: "UPDATE", 32: "TRUNCATE"}
OPAQUE = ["c", "internal", "plpgsql", "plpython3u", "plperl", "pltcl"]
AT = ["snapshot_key"]


def _named(c: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), c)


def _key(kind: Column | str, schema: Column, name: Column, sub: Column | None = None) -> Column:
    return object_key(F.col("_source"), F.col("_alias"), F.col("_database"), schema, kind, name, sub)


def _schemas(x: Extract) -> DataFrame:
    return _scoped(x, "pg_namespace").select("snapshot_key", "_source", "_alias", "_database", F.col("oid").alias("nsp"), F.col("nspname").alias("schema"), "nspowner").withColumn("schema_key", _key("schema", F.col("schema"), F.col("schema")))


def prepared(x: Extract) -> Extract:
    """The extract with its relations, attributes and routines as written tables: most of what is made of it goes by their keys, which are worked out once."""
    if "_relations" in x:
        return x
    x = x | {"_relations": written(relations(x), "relations")}
    x = x | {"_attributes": written(attributes(x), "attributes")}
    return x | {"_routines": written(_routines(x), "routines")} if "pg_proc" in x else x


def relations(x: Extract) -> DataFrame:
    """(snapshot_key, rel, what, key, schema, schema_key, name, relkind, ...): everything of pg_class that the model has a kind for."""
    if "_relations" in x:
        return x["_relations"]
    r = x["pg_class"].withColumnsRenamed({"oid": "rel", "relnamespace": "nsp"}).join(_schemas(x), [*AT, "nsp"])
    return r.withColumn("what", _named(F.col("relkind"), RELATIONS)).where("what is not null").withColumn("key", _key(F.col("what"), F.col("schema"), F.col("relname")))


def attributes(x: Extract) -> DataFrame:
    """(snapshot_key, rel, attnum, what, key, owner_key, ...): columns of tables, views and materialised views."""
    if "_attributes" in x:
        return x["_attributes"]
    a = x["pg_attribute"].where("attnum > 0 and not attisdropped").withColumnRenamed("attrelid", "rel")
    r = relations(x).where("what in ('table', 'view', 'materialized_view')").select(*AT, "rel", "what", F.col("key").alias("owner_key"), "schema", "relname", "_source", "_alias", "_database")
    kind = F.when(F.col("what") == "table", "column").otherwise("view_column")
    return a.join(r, [*AT, "rel"]).withColumn("key", _key(kind, F.col("schema"), F.col("relname"), F.col("attname")))


def _listed(rows: DataFrame, atts: DataFrame, rel: str, numbers: str, name: str, by: list[str]) -> DataFrame:
    """by -> name: the keys of the attributes numbered in an array, in its order."""
    each = rows.select(*by, F.col(rel).alias("rel"), F.posexplode(numbers).alias("at", "attnum")).join(atts.select(*AT, "rel", F.col("attnum").cast("int").alias("attnum"), "key"), [*AT, "rel", "attnum"])
    return each.groupBy(*by).agg(F.transform(_ordered("at", F.col("key").alias("k")), lambda p: p.k).alias(name))


def map_schemas(x: Extract) -> DataFrame:
    """B1."""
    return _schemas(x).select("snapshot_key", F.col("schema_key").alias("key"), object_key(F.col("_source"), F.col("_alias"), F.col("_database"), F.col("_database"), "database", F.col("_database")).alias("database_key"), F.col("schema").alias("name"))


def map_tables(x: Extract) -> DataFrame:
    """B2: a partition before a partitioned table, for it may be both."""
    kind = F.when(F.col("relispartition"), "partition").when(F.col("relkind") == "p", "partitioned").when(F.col("relkind") == "f", "foreign").when(F.col("relpersistence") == "t", "temporary").otherwise("base_table")
    return relations(x).where("what = 'table'").select("snapshot_key", "key", "schema_key", F.col("relname").alias("name"), kind.alias("kind"))


def map_columns(x: Extract) -> DataFrame:
    """B3."""
    d = x["pg_attrdef"].select(*AT, F.col("adrelid").alias("rel"), F.col("adnum").alias("attnum"), "adbin") if "pg_attrdef" in x else None
    a = attributes(x).where("what = 'table'")
    a = a.join(d, [*AT, "rel", "attnum"], "left") if d is not None else a.withColumn("adbin", F.lit(None).cast("string"))
    return a.select("snapshot_key", "key", F.col("owner_key").alias("table_key"), F.col("attname").alias("name"), F.col("attnum").cast("int").alias("ordinal_position"), F.col("format_type").alias("data_type"), (~F.col("attnotnull")).alias("is_nullable"), F.col("adbin").alias("default_value"), (F.col("attgenerated") != "").alias("is_generated"))


def _constraints(x: Extract) -> DataFrame:
    """Constraints of relations with their key, and the ordered keys of both column lists."""
    by, atts, none = [*AT, "con"], attributes(x), F.array().cast("array<string>")
    k = x["pg_constraint"].withColumnRenamed("oid", "con").where(F.col("contype").isin(*CONSTRAINTS))
    own = relations(x).select(*AT, F.col("rel").alias("conrelid"), "what", F.col("key").alias("owner_key"), "schema", "relname", "_source", "_alias", "_database")
    target = relations(x).select(*AT, F.col("rel").alias("confrelid"), F.col("key").alias("referenced_table_key"))
    out = k.join(own, [*AT, "conrelid"]).join(target, [*AT, "confrelid"], "left")
    out = out.join(_listed(k, atts, "conrelid", "conkey", "columns", by), by, "left").join(_listed(k.where("contype = 'f'"), atts, "confrelid", "confkey", "referenced", by), by, "left")
    key = _key(_named(F.col("contype"), KEY_KINDS), F.col("schema"), F.col("relname"), F.col("conname"))
    return out.select(*AT, "what", "owner_key", "contype", key.alias("key"), F.col("conname").alias("name"), F.coalesce("columns", none).alias("columns"), "referenced_table_key", F.coalesce("referenced", none).alias("referenced_columns"), "conbin")


def map_constraints(x: Extract) -> DataFrame:
    """B4; exclusion constraints are B23's, those of materialised views B10's."""
    k = _constraints(x).where("what = 'table' and contype <> 'x'")
    return k.select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", _named(F.col("contype"), CONSTRAINTS).alias("kind"), "columns", "referenced_table_key", "referenced_columns", F.when(F.col("contype") == "c", F.col("conbin")).alias("expression"))


def _indexes(x: Extract) -> DataFrame:
    by, atts, none = [*AT, "indexrelid"], attributes(x), F.array().cast("array<string>")
    i = x["pg_index"].withColumn("keys", F.expr("slice(indkey, 1, indnkeyatts)")).withColumn("rest", F.expr("slice(indkey, indnkeyatts + 1, size(indkey))"))
    own = relations(x).where("what in ('table', 'materialized_view')").select(*AT, F.col("rel").alias("indrelid"), "what", F.col("key").alias("owner_key"), "schema", "relname", "_source", "_alias", "_database")
    named = x["pg_class"].select(*AT, F.col("oid").alias("indexrelid"), F.col("relname").alias("name"))
    out = i.join(own, [*AT, "indrelid"]).join(named, by)
    for numbers, name in (("keys", "columns"), ("rest", "included")):
        out = out.join(_listed(i, atts, "indrelid", numbers, name, by), by, "left").withColumn(name, F.coalesce(name, none))
    return out.withColumn("key", _key("index", F.col("schema"), F.col("relname"), F.col("name")))


def map_indexes(x: Extract) -> DataFrame:
    """Key columns in order; other terms are the expression."""
    return _indexes(x).where("what = 'table'").select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", "columns", F.col("indisunique").alias("is_unique"), F.col("indisprimary").alias("is_primary"), F.col("indpred").alias("predicate"), F.col("indexprs").alias("expression"))


def _targets(x: Extract, of_class: str) -> DataFrame:
    """(snapshot_key, objid, dep): what objects of a class depend on: relations, or columns where pg_depend names one of a table."""
    d = x["pg_depend"].where((F.col("classid") == of_class) & (F.col("refclassid") == "pg_class"))
    r = relations(x).select(*AT, F.col("rel").alias("refobjid"), F.col("key").alias("of_rel"))
    a = attributes(x).where("what = 'table'").select(*AT, F.col("rel").alias("refobjid"), F.col("attnum").cast("int").alias("refobjsubid"), F.col("key").alias("of_att"))
    return d.join(r, [*AT, "refobjid"]).join(a, [*AT, "refobjid", "refobjsubid"], "left").select(*AT, "objid", F.coalesce("of_att", "of_rel").alias("dep"))


def _view_uses(x: Extract) -> DataFrame:
    rules = x["pg_rewrite"].select(*AT, F.col("oid").alias("objid"), F.col("ev_class").alias("rel"))
    own = relations(x).select(*AT, "rel", F.col("key").alias("own"))
    return _targets(x, "pg_rewrite").join(rules, [*AT, "objid"]).join(own, [*AT, "rel"]).where("dep <> own").select(*AT, "rel", "own", "dep").distinct()


def map_views(x: Extract) -> DataFrame:
    """Through the rewrite rules; a view's rule depends on the view itself, which doesn't count."""
    deps = _view_uses(x).groupBy(*AT, "rel").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    v = relations(x).where("what = 'view'").join(deps, [*AT, "rel"], "left")
    return v.select("snapshot_key", "key", "schema_key", F.col("relname").alias("name"), F.col("definition"), F.coalesce("deps", F.array().cast("array<string>")).alias("depends_on"))


def _routines(x: Extract) -> DataFrame:
    if "_routines" in x:
        return x["_routines"]
    p = x["pg_proc"].withColumnsRenamed({"oid": "proc", "pronamespace": "nsp"}).join(_schemas(x), [*AT, "nsp"])
    return p.withColumn("key", _key("routine", F.col("schema"), F.col("proname"), F.when(F.col("arguments") != "", F.col("arguments"))))


def map_routines(x: Extract) -> DataFrame:
    """The identity arguments, where there are any, tell overloads apart."""
    deps = _targets(x, "pg_proc").groupBy(*AT, F.col("objid").alias("proc")).agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    r = _routines(x).join(deps, [*AT, "proc"], "left")
    return r.select("snapshot_key", "key", "schema_key", F.col("proname").alias("name"), _named(F.col("prokind"), ROUTINES).alias("kind"), F.col("prosrc").alias("definition"), F.coalesce("deps", F.array().cast("array<string>")).alias("depends_on"))


def _triggers(x: Extract) -> DataFrame:
    own = relations(x).where("what in ('table', 'view')").select(*AT, F.col("rel").alias("tgrelid"), F.col("key").alias("table_key"), "schema", "relname", "_source", "_alias", "_database")
    routine = _routines(x).select(*AT, F.col("proc").alias("tgfoid"), F.col("key").alias("routine"))
    t = x["pg_trigger"].where("not tgisinternal").join(own, [*AT, "tgrelid"]).join(routine, [*AT, "tgfoid"], "left")
    return t.withColumn("key", _key("trigger", F.col("schema"), F.col("relname"), F.col("tgname")))


def map_triggers(x: Extract) -> DataFrame:
    """Timing and events from the bits of tgtype."""
    bit = lambda b: F.col("tgtype").bitwiseAND(b) > 0
    timing = F.when(bit(2), "BEFORE").when(bit(64), "INSTEAD OF").otherwise("AFTER")
    events = F.array_sort(F.array_compact(F.array(*[F.when(bit(b), e) for b, e in EVENTS.items()])))
    return _triggers(x).select("snapshot_key", "key", "table_key", F.col("tgname").alias("name"), timing.alias("timing"), events.alias("events"), "definition", F.col("routine").alias("executes_routine_key"))


def _types(x: Extract) -> DataFrame:
    """User types: enums and composites, and domains."""
    t = x["pg_type"].withColumnsRenamed({"oid": "typ", "typnamespace": "nsp"}).where("typtype in ('e', 'd', 'c', 'r')").join(_schemas(x), [*AT, "nsp"])
    # Each relation has a row type of its own, which is no type of the user's.
    rows = relations(x).where("relkind <> 'c'").select(*AT, F.col("rel").alias("typrelid"))
    t = t.join(rows, [*AT, "typrelid"], "left_anti")
    return t.withColumn("key", _key(F.when(F.col("typtype") == "d", "domain").otherwise("user_defined_type"), F.col("schema"), F.col("typname")))


def _object(df: DataFrame, key: str, parent: str, name: str, definition: Column | None = None, extension: Column | None = None, **properties: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    pairs = [v for n, c in properties.items() for v in (F.lit(n), c)]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,struct<type:string,value:string>>")
    held = F.map_filter(held, lambda _, v: v.value.isNotNull())
    return df.select("snapshot_key", F.col(key).alias("key"), F.col(parent).alias("parent_key"), F.col(name).alias("name"), (none if extension is None else extension).alias("extension_kind"), (none if definition is None else definition).alias("definition"), held.alias("properties"))


def _relation(df: DataFrame, kind: str, from_: str, to: str, ordinal: Column | None = None) -> DataFrame:
    return df.select("snapshot_key", F.lit(kind).alias("kind"), F.col(from_).alias("from_key"), F.col(to).alias("to_key"), (F.lit(None) if ordinal is None else ordinal).cast("int").alias("ordinal"))


class _Parts:
    """The parts of a result by the kinds that their rows can be of; where one kind is asked for, those that can't be."""

    def __init__(self, only: str | None):
        self.only, self.kept, self.first = only, [], None

    def add(self, kinds: str, df: DataFrame) -> None:
        self.first = df if self.first is None else self.first
        if self.only is None or self.only in kinds.split():
            self.kept.append(df)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.kept) if self.kept else self.first.where("false")


def metadata(x: Extract, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata objects and relationships: included columns (B6), view columns (B9), materialised views with their keys and indexes (B10), columns of UPDATE OF (B11), parameters and return types (B13), sequences (B14), types, domains and enum values (B15), roles, owners and members (B17), policies (B18), partitions and inheritance (B19), event triggers (B20), exclusion constraints (B23), extensions. Tables that the extract lacks give none. only: a kind of objects or of relationships; what can't be of that kind is left out of the plan."""
    x = prepared(x)
    objects, links = _Parts(only), _Parts(only)
    rel, att = relations(x), attributes(x)
    has = lambda *names: all(n in x for n in names)
    number = F.col("attnum").cast("int")
    objects.add("view_column", _object(att.where("what <> 'table'"), "key", "owner_key", "attname", data_type=prop("string", F.col("format_type")), ordinal_position=prop("unsigned", number)))
    m = rel.where("what = 'materialized_view'")
    objects.add("materialized_view", _object(m, "key", "schema_key", "relname", F.col("definition")))
    if has("pg_rewrite", "pg_depend"):
        uses = _view_uses(x).join(m.select(*AT, "rel"), [*AT, "rel"])
        links.add("depends_on", _relation(uses, "depends_on", "own", "dep"))
        links.add("materializes", _relation(uses.where("dep rlike ':(table|view):'"), "materializes", "own", "dep"))
    if has("pg_index"):
        i = _indexes(x)
        objects.add("index", _object(i.where("what = 'materialized_view'"), "key", "owner_key", "name", unique=prop("boolean", F.col("indisunique"))))
        links.add("includes_column", _relation(i.select(*AT, "key", "columns", F.posexplode("included").alias("at", "c")), "includes_column", "key", "c", F.size("columns") + F.col("at") + 1))
    if has("pg_constraint"):
        k = _constraints(x)
        objects.add("primary_key unique_constraint foreign_key check_constraint exclusion_constraint", _object(k.where("what = 'materialized_view'"), "key", "owner_key", "name"))
        x_only = k.where("what = 'table' and contype = 'x'")
        objects.add("exclusion_constraint", _object(x_only, "key", "owner_key", "name", F.col("conbin")))
        links.add("excludes_with", _relation(x_only.select(*AT, "key", F.posexplode("columns").alias("at", "c")), "excludes_with", "key", "c", F.col("at") + 1))
    s = rel.where("what = 'sequence'")
    if has("pg_sequence"):
        s = s.join(x["pg_sequence"].withColumnRenamed("seqrelid", "rel"), [*AT, "rel"], "left")
        objects.add("sequence", _object(s, "key", "schema_key", "relname", start_value=prop("integer", F.col("seqstart")), increment=prop("integer", F.col("seqincrement")), cycles=prop("boolean", F.col("seqcycle"))))
    else:
        objects.add("sequence", _object(s, "key", "schema_key", "relname"))
    if has("pg_depend"):
        owned = x["pg_depend"].where("classid = 'pg_class' and refclassid = 'pg_class' and refobjsubid > 0 and deptype in ('a', 'i')").join(s.select(*AT, F.col("rel").alias("objid"), F.col("key").alias("sequence_key")), [*AT, "objid"])
        at = att.where("what = 'table'").select(*AT, F.col("rel").alias("refobjid"), number.alias("refobjsubid"), F.col("key").alias("column_key"))
        links.add("uses_sequence", _relation(owned.join(at, [*AT, "refobjid", "refobjsubid"]), "uses_sequence", "column_key", "sequence_key"))
    if has("pg_type"):
        t = _types(x)
        of = t.select(*AT, "typ", F.col("key").alias("type_key"))
        objects.add("user_defined_type domain", _object(t, "key", "schema_key", "typname", kind=prop("string", F.col("typtype"))))
        links.add("uses_type", _relation(att.join(of.withColumnRenamed("typ", "atttypid"), [*AT, "atttypid"]), "uses_type", "key", "type_key"))
        if has("pg_proc"):
            links.add("returns_type", _relation(_routines(x).join(of.withColumnRenamed("typ", "prorettype"), [*AT, "prorettype"]), "returns_type", "key", "type_key"))
        if has("pg_enum"):
            e = x["pg_enum"].withColumnRenamed("enumtypid", "typ").join(t.select(*AT, "typ", F.col("key").alias("type_key"), "schema", "typname", "_source", "_alias", "_database"), [*AT, "typ"])
            e = e.withColumn("key", _key("enum_value", F.col("schema"), F.col("typname"), F.col("enumlabel")))
            objects.add("enum_value", _object(e, "key", "type_key", "enumlabel", sort_order=prop("string", F.col("enumsortorder"))))
    if has("pg_proc"):
        p = _routines(x).withColumnRenamed("key", "routine_key").select("*", F.posexplode("proargtypes").alias("at", "type"))
        p = p.withColumn("name", F.coalesce(F.when(F.get("proargnames", F.col("at")) != "", F.get("proargnames", F.col("at"))), F.concat(F.lit("argument_"), (F.col("at") + 1).cast("string"))))
        p = p.withColumn("key", _key("routine_parameter", F.col("schema"), F.col("proname"), F.concat(F.col("arguments"), F.lit("#"), (F.col("at") + 1).cast("string"), F.lit(":"), F.col("name"))))
        objects.add("routine_parameter", _object(p, "key", "routine_key", "name", data_type=prop("string", F.col("type")), ordinal_position=prop("unsigned", F.col("at") + 1)))
        links.add("has_parameter", _relation(p, "has_parameter", "routine_key", "key", F.col("at") + 1))
    if has("pg_roles"):
        db = x["databases"].select(*AT, F.col("source_kind").alias("_source"), F.col("connection_alias").alias("_alias"), F.col("name").alias("_database"))
        roles = x["pg_roles"].join(db, AT).withColumn("key", _key("principal", F.col("_database"), F.col("rolname"))).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
        objects.add("principal", _object(roles, "key", "database_key", "rolname"))
        of = roles.select(*AT, F.col("oid").alias("owner"), F.col("key").alias("role_key"))
        owned = rel.where("what not in ('index', 'user_defined_type')").select(*AT, "key", F.col("relowner").alias("owner")).unionByName(_schemas(x).select(*AT, F.col("schema_key").alias("key"), F.col("nspowner").alias("owner")))
        links.add("owned_by", _relation(owned.join(of, [*AT, "owner"]), "owned_by", "key", "role_key"))
        if has("pg_auth_members"):
            member = x["pg_auth_members"].join(of.select(*AT, F.col("owner").alias("member"), F.col("role_key").alias("member_key")), [*AT, "member"]).join(of.select(*AT, F.col("owner").alias("roleid"), "role_key"), [*AT, "roleid"])
            links.add("depends_on", _relation(member, "depends_on", "member_key", "role_key"))
    if has("pg_policy"):
        own = rel.select(*AT, F.col("rel").alias("polrelid"), F.col("key").alias("owner_key"), "schema", "relname", "_source", "_alias", "_database")
        pol = x["pg_policy"].join(own, [*AT, "polrelid"]).withColumn("key", _key("policy", F.col("schema"), F.col("relname"), F.col("polname")))
        objects.add("policy", _object(pol, "key", "owner_key", "polname", F.col("polqual"), command=prop("string", F.col("polcmd"))))
        links.add("depends_on", _relation(pol, "depends_on", "key", "owner_key"))
    if has("pg_inherits"):
        end = lambda c, n: rel.where("what = 'table'").select(*AT, F.col("rel").alias(c), F.col("key").alias(n), *([F.col("relispartition")] if n == "child" else []))
        inh = x["pg_inherits"].join(end("inhrelid", "child"), [*AT, "inhrelid"]).join(end("inhparent", "parent"), [*AT, "inhparent"])
        links.add("partition_of", _relation(inh.where("relispartition"), "partition_of", "child", "parent"))
        links.add("inherits_from", _relation(inh.where("not relispartition"), "inherits_from", "child", "parent", F.col("inhseqno")))
    if has("pg_event_trigger", "pg_proc"):
        routine = _routines(x).select(*AT, F.col("proc").alias("evtfoid"), F.col("key").alias("routine_key"), "_source", "_alias", "_database")
        ev = x["pg_event_trigger"].join(routine, [*AT, "evtfoid"]).withColumn("key", _key("event", F.col("_database"), F.col("evtname"))).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
        objects.add("event", _object(ev, "key", "database_key", "evtname", event=prop("string", F.col("evtevent"))))
        links.add("invokes", _relation(ev, "invokes", "key", "routine_key"))
    if has("pg_trigger"):
        named = _triggers(x).where(F.size("tgattr") > 0).select(*AT, F.col("key").alias("trigger_key"), F.col("tgrelid").alias("rel"), F.explode("tgattr").alias("attnum"))
        links.add("depends_on", _relation(named.join(att.select(*AT, "rel", number.alias("attnum"), "key"), [*AT, "rel", "attnum"]), "depends_on", "trigger_key", "key"))
    if has("pg_extension"):
        ext = x["pg_extension"].withColumnRenamed("extnamespace", "nsp").join(_schemas(x), [*AT, "nsp"]).withColumn("key", _key("extension", F.col("schema"), F.col("extname")))
        objects.add("extension", _object(ext, "key", "schema_key", "extname", extension=F.lit("postgresql_extension"), version=prop("string", F.col("extversion"))))
    return objects.all(), links.all()


def placement(x: Extract) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """B24, of YugabyteDB: (objects, links, annotations, issues): table spaces and table groups as extensions of the database; the database's default, each group's and each stored relation's table space, and which group a relation is in. What has no table space of its own takes the database's default; one that isn't in the extract is an issue.

    Besides pg_catalog's tables, x has pg_tablespace(oid, spcname, spcowner, spcoptions), pg_yb_tablegroup(oid, grpname, grpowner, grptablespace), yb_database(dattablespace, datcolocated), a row for each snapshot, and yb_relation(relid, reltablespace, num_tablets, is_colocated, tablegroup_oid), where relations without tablets aren't stored.
    """
    db = _scoped(x, "yb_database").withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
    of_db = db.select(*AT, "database_key", F.col("dattablespace").alias("default"))
    named = lambda table, prefix, name: _scoped(x, table).join(of_db, AT).withColumn("key", _key("extension", F.col("_database"), F.concat(F.lit(prefix), F.col(name))))
    spaces, groups = named("pg_tablespace", "tablespace:", "spcname"), named("pg_yb_tablegroup", "tablegroup:", "grpname")
    options = F.array_join("spcoptions", ",")
    objects = _object(spaces, "key", "database_key", "spcname", extension=F.lit("yugabytedb_tablespace"), placement_options=prop("string", options)).unionByName(_object(groups, "key", "database_key", "grpname", extension=F.lit("yugabytedb_tablegroup"), catalog_tablespace_oid=prop("integer", F.col("grptablespace"))))
    space = spaces.select(*AT, F.col("oid").alias("space"), F.col("key").alias("space_key"), F.col("spcname").alias("space_name"))
    group = groups.select(*AT, F.col("oid").alias("tablegroup_oid"), F.col("key").alias("group_key"))
    # 0 means that the catalog names none.
    effective = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.col("default")).otherwise(F.col(c)).alias("space")
    link = lambda df, from_, to, name: df.where(F.col(to).isNotNull()).select("snapshot_key", F.lit("extension").alias("kind"), F.lit(name).alias("extension_name"), F.col(from_).alias("from_key"), F.col(to).alias("to_key"))
    issue = lambda df, code, key, message: df.select("snapshot_key", F.lit(code).alias("code"), F.col(key).alias("object_key"), F.lit(message).alias("message"))
    at_db = db.select(*AT, "database_key", "datcolocated", F.col("dattablespace").alias("space")).join(space, [*AT, "space"], "left")
    at_group = groups.select(*AT, "key", effective("grptablespace")).join(space, [*AT, "space"], "left")
    rel = relations(x).select(*AT, F.col("rel").alias("relid"), "key")
    rows = x["yb_relation"].join(rel, [*AT, "relid"], "left").join(of_db, AT)
    stored = rows.where("num_tablets is not null and key is not null").select(*AT, "key", "num_tablets", "is_colocated", "tablegroup_oid", effective("reltablespace")).join(space, [*AT, "space"], "left")
    member = rows.where("key is not null and coalesce(tablegroup_oid, 0) <> 0").join(group, [*AT, "tablegroup_oid"], "left")
    links = [link(at_db, "database_key", "space_key", "yugabytedb_default_tablespace"), link(at_group, "key", "space_key", "yugabytedb_uses_tablespace"), link(stored, "key", "space_key", "yugabytedb_uses_tablespace"), link(member, "key", "group_key", "yugabytedb_member_of_tablegroup")]
    # The merged properties of the database and of stored relations.
    noted = lambda df, key, **p: df.select("snapshot_key", F.col(key).alias("object_key"), F.map_filter(F.create_map(*[v for n, c in p.items() for v in (F.lit(n), c)]), lambda _, v: v.value.isNotNull()).alias("properties"))
    notes = noted(at_db, "database_key", yugabytedb_database_colocated=prop("boolean", F.col("datcolocated")), yugabytedb_default_tablespace=prop("string", F.col("space_name"))).unionByName(noted(stored, "key", yugabytedb_num_tablets=prop("integer", F.col("num_tablets")), yugabytedb_is_colocated=prop("boolean", F.col("is_colocated")), yugabytedb_effective_tablespace=prop("string", F.col("space_name"))))
    number = rows.where("key is null").withColumn("number", F.col("relid").cast("string"))
    issues = [issue(at_db.where("space_key is null"), "default_tablespace_missing", "database_key", "the database's default table space isn't in the extract"), issue(at_group.where("space_key is null"), "tablespace_missing", "key", "a table group's table space isn't in the extract"), issue(stored.where("space_key is null"), "tablespace_missing", "key", "a relation's table space isn't in the extract"), issue(member.where("group_key is null"), "tablegroup_missing", "key", "a relation's table group isn't in the extract"), issue(number, "placed_relation_missing", "number", "a placement is of no relation of the extract")]
    return objects, reduce(DataFrame.unionByName, links), notes, reduce(DataFrame.unionByName, issues)


def unsupported(x: Extract) -> DataFrame:
    """Relations of a kind that the model has none for; TOAST tables are storage."""
    return x["pg_class"].where(~F.col("relkind").isin(*RELATIONS, "t")).select("snapshot_key", F.lit("unsupported_object").alias("code"), F.col("relname").alias("object_key"), F.col("relkind").alias("message"))


def open_dependencies(x: Extract) -> DataFrame:
    """Routines in languages whose bodies the catalog doesn't follow."""
    r = _routines(x).where(F.col("language").isin(*OPAQUE))
    return r.select("snapshot_key", F.lit("dependency_closure_unproven").alias("code"), F.col("key").alias("object_key"), F.col("language").alias("message"))


def map_catalog(x: Extract) -> Canonical:
    """All of a pg_catalog extract."""
    x = prepared(x)
    db, (objects, links) = x["databases"], metadata(x)
    notes = {}
    if "yb_relation" in x:
        more, placed, held, _ = placement(x)
        objects, links, notes = objects.unionByName(more), links.unionByName(placed, True), {"annotations": held}
    databases = db.select("snapshot_key", object_key(F.col("source_kind"), F.col("connection_alias"), F.col("name"), F.col("name"), "database", F.col("name")).alias("key"), "name", "source_kind", "connection_alias")
    return Canonical.of(db.sparkSession, databases=databases, schemas=map_schemas(x), tables=map_tables(x), columns=map_columns(x), constraints=map_constraints(x), indexes=map_indexes(x), views=map_views(x), triggers=map_triggers(x), routines=map_routines(x), metadata_objects=objects, relationships=links, **notes)


def as_pg_catalog(c: Canonical) -> Extract:
    """The other way, for the typed tables: the extract that a server with these objects would give, with hashes of keys as oids. Triggers come as AFTER INSERT, whatever their events."""
    oid = lambda k: F.xxhash64(F.col(k))
    text = F.lit(None).cast("string")
    col = c.columns.select(*AT, F.col("key").alias("ckey"), F.col("ordinal_position").alias("attnum"), oid("table_key").alias("of"))

    def numbers(df: DataFrame, column: str, name: str) -> DataFrame:
        each = df.select(*AT, "key", F.posexplode(column).alias("at", "ckey")).join(col, [*AT, "ckey"])
        return each.groupBy(*AT, "key").agg(F.transform(_ordered("at", F.col("attnum").alias("n")), lambda p: p.n).alias(name))

    relation = lambda df, kind, nsp, definition: df.select(*AT, oid("key").alias("oid"), F.col("name").alias("relname"), nsp.alias("relnamespace"), F.lit(kind).alias("relkind"), F.lit(False).alias("relispartition"), F.lit("p").alias("relpersistence"), F.lit(10).cast("long").alias("relowner"), definition.alias("definition"))
    in_table = lambda df: df.join(c.tables.select(*AT, F.col("key").alias("table_key"), "schema_key"), [*AT, "table_key"])
    classes = [relation(c.tables, "r", oid("schema_key"), text), relation(c.views, "v", oid("schema_key"), F.col("definition")), relation(in_table(c.indexes), "i", oid("schema_key"), text)]
    kinds = _named(F.col("kind"), {v: k for k, v in CONSTRAINTS.items()})
    k, none = c.constraints, F.array().cast("array<int>")
    constraints = k.join(numbers(k, "columns", "conkey"), [*AT, "key"], "left").join(numbers(k, "referenced_columns", "confkey"), [*AT, "key"], "left")
    i = c.indexes.join(numbers(c.indexes, "columns", "indkey"), [*AT, "key"])
    views = c.views.select(*AT, oid("key").alias("objid"), F.explode("depends_on").alias("dep")).select(*AT, F.lit("pg_rewrite").alias("classid"), "objid", F.lit("pg_class").alias("refclassid"), oid("dep").alias("refobjid"), F.lit(0).alias("refobjsubid"), F.lit("n").alias("deptype"))
    uses = c.routines.select(*AT, oid("key").alias("objid"), F.explode("depends_on").alias("ckey")).join(col, [*AT, "ckey"], "left")
    routines = uses.select(*AT, F.lit("pg_proc").alias("classid"), "objid", F.lit("pg_class").alias("refclassid"), F.coalesce("of", F.xxhash64("ckey")).alias("refobjid"), F.coalesce("attnum", F.lit(0)).alias("refobjsubid"), F.lit("n").alias("deptype"))
    letter = _named(F.col("kind"), {"function": "f", "procedure": "p"})
    return {
        "databases": c.databases.select("snapshot_key", "source_kind", "connection_alias", "name"),
        "pg_namespace": c.schemas.select(*AT, oid("key").alias("oid"), F.col("name").alias("nspname"), F.lit(10).cast("long").alias("nspowner")),
        "pg_class": reduce(DataFrame.unionByName, classes),
        "pg_attribute": c.columns.select(*AT, oid("table_key").alias("attrelid"), F.col("name").alias("attname"), F.col("ordinal_position").alias("attnum"), F.lit(25).cast("long").alias("atttypid"), F.col("data_type").alias("format_type"), (~F.col("is_nullable")).alias("attnotnull"), F.when(F.col("is_generated"), "s").otherwise("").alias("attgenerated"), F.lit(False).alias("attisdropped")),
        "pg_constraint": constraints.select(*AT, oid("key").alias("oid"), F.col("name").alias("conname"), oid("table_key").alias("conrelid"), kinds.alias("contype"), F.coalesce("conkey", none).alias("conkey"), F.when(F.col("referenced_table_key").isNotNull(), oid("referenced_table_key")).otherwise(0).alias("confrelid"), F.coalesce("confkey", none).alias("confkey"), F.col("expression").alias("conbin")),
        "pg_index": i.select(*AT, oid("key").alias("indexrelid"), oid("table_key").alias("indrelid"), F.col("is_unique").alias("indisunique"), F.col("is_primary").alias("indisprimary"), "indkey", F.size("indkey").alias("indnkeyatts"), F.col("predicate").alias("indpred"), F.col("expression").alias("indexprs")),
        "pg_rewrite": c.views.select(*AT, oid("key").alias("oid"), oid("key").alias("ev_class")),
        "pg_depend": views.unionByName(routines),
        "pg_proc": c.routines.select(*AT, oid("key").alias("oid"), F.col("name").alias("proname"), oid("schema_key").alias("pronamespace"), letter.alias("prokind"), F.lit("").alias("arguments"), F.lit(25).cast("long").alias("prorettype"), F.array().cast("array<string>").alias("proargnames"), F.array().cast("array<string>").alias("proargtypes"), F.col("definition").alias("prosrc"), F.when(F.col("kind") == "function", "sql").otherwise("plpgsql").alias("language")),
        "pg_trigger": c.triggers.select(*AT, oid("table_key").alias("tgrelid"), F.col("name").alias("tgname"), F.when(F.col("executes_routine_key").isNotNull(), oid("executes_routine_key")).otherwise(0).alias("tgfoid"), F.lit(4).alias("tgtype"), F.array().cast("array<int>").alias("tgattr"), F.lit(False).alias("tgisinternal"), F.col("definition")),
    }
