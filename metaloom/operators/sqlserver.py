"""Canonical mapping (B*) of SQL Server catalogs: raw sys tables of any number of databases to canonical tables.

x holds the extract's tables by name, each with snapshot_key, and databases(snapshot_key, source_kind, connection_alias, name). Everything that the catalog refers to by number goes through one registry of ids tagged by class, so that a reference of any class is resolved by one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import object_key
from ..plans.model import Canonical
from ..plans.shared import written
from .mapping import Extract, _ordered, _scoped, prop

AT = ["snapshot_key"]
# The catalog's classes of things that have ids, its type letters of objects, and their kinds.
DATABASE, OBJECT, PARAMETER, SCHEMA, PRINCIPAL, TYPE, INDEX, TABLE_TYPE_COLUMN, XML, SCHEME, FUNCTION = 0, 1, 2, 3, 4, 6, 7, 8, 10, 20, 21
ROUTINES = {"P": "procedure", "PC": "procedure", "FN": "function", "IF": "function", "TF": "function", "FS": "function", "FT": "function", "AF": "function"}
KEYS = {"PK": "primary_key", "UQ": "unique"}
KEY_KINDS = {"primary_key": "primary_key", "unique": "unique_constraint", "foreign_key": "foreign_key", "check": "check_constraint"}
#: Kinds that views and routines may depend on by the lists of their own; other dependencies are relationships.
LISTED = ["database", "schema", "table", "column", "primary_key", "foreign_key", "unique_constraint", "check_constraint", "index", "view", "trigger", "routine"]
NONE = "array<string>"


def _named(c: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), c)


def _key(kind: Column | str, schema: Column, name: Column, sub: Column | None = None) -> Column:
    return object_key(F.col("_source"), F.col("_alias"), F.col("_database"), schema, kind, name, sub)


SCOPE = ["_source", "_alias", "_database"]


def _schemas(x: Extract) -> DataFrame:
    return _scoped(x, "schemas").select(*AT, *SCOPE, "schema_id", F.col("name").alias("schema"), F.col("principal_id").alias("schema_owner")).withColumn("schema_key", _key("schema", F.col("schema"), F.col("schema")))


def _in_schema(x: Extract, name: str, kind: Column | str) -> DataFrame:
    """Rows of a table with a schema_id and a name, with their key."""
    rows = x[name].withColumnRenamed("principal_id", "owner_id") if "principal_id" in x[name].columns else x[name].withColumn("owner_id", F.lit(None).cast("long"))
    return rows.join(_schemas(x), [*AT, "schema_id"]).withColumn("key", _key(kind, F.col("schema"), F.col("name")))


def _relations(x: Extract) -> DataFrame:
    """Tables and views: (snapshot_key, object_id, what, key, schema, name, ...)."""
    cols = [*AT, *SCOPE, "object_id", "schema", "schema_key", "name", "key", "owner_id"]
    return _in_schema(x, "tables", "table").select(*cols, F.lit("table").alias("what")).unionByName(_in_schema(x, "views", "view").select(*cols, F.lit("view").alias("what")))


def _owners(x: Extract, c: str) -> DataFrame:
    return _relations(x).select(*AT, *SCOPE, F.col("object_id").alias(c), "what", F.col("key").alias("owner_key"), "schema", F.col("name").alias("owner_name"))


def _columns(x: Extract) -> DataFrame:
    kind = F.when(F.col("what") == "table", "column").otherwise("view_column")
    return x["columns"].join(_owners(x, "object_id"), [*AT, "object_id"]).withColumn("key", _key(kind, F.col("schema"), F.col("owner_name"), F.col("name")))


def map_schemas(x: Extract) -> DataFrame:
    """B1."""
    return _schemas(x).select("snapshot_key", F.col("schema_key").alias("key"), object_key(F.col("_source"), F.col("_alias"), F.col("_database"), F.col("_database"), "database", F.col("_database")).alias("database_key"), F.col("schema").alias("name"))


def map_tables(x: Extract) -> DataFrame:
    """B2."""
    return _in_schema(x, "tables", "table").select("snapshot_key", "key", "schema_key", "name", F.lit("base_table").alias("kind"))


def map_columns(x: Extract) -> DataFrame:
    """Defaults come from constraints of their own; ordinals are places among the columns that are left, for ids of dropped columns stay unused."""
    c = _columns(x).where("what = 'table'")
    if "default_constraints" in x:
        d = x["default_constraints"].select(*AT, F.col("parent_object_id").alias("object_id"), F.col("parent_column_id").alias("column_id"), F.col("definition").alias("default_value"))
        c = c.join(d, [*AT, "object_id", "column_id"], "left")
    else:
        c = c.withColumn("default_value", F.lit(None).cast("string"))
    ordinal = F.row_number().over(W.partitionBy(*AT, "object_id").orderBy("column_id"))
    return c.select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", ordinal.alias("ordinal_position"), F.col("type_name").alias("data_type"), "is_nullable", "default_value", F.col("is_computed").alias("is_generated"))


def _index_columns(x: Extract) -> DataFrame:
    c = _columns(x).select(*AT, "object_id", "column_id", F.col("key").alias("column_key"))
    return x["index_columns"].join(c, [*AT, "object_id", "column_id"])


def _listed(rows: DataFrame, by: list[str], place: str, *keys: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.transform(_ordered(place, F.col(k).alias("k")), lambda p: p.k).alias(k) for k in keys])


def map_constraints(x: Extract) -> DataFrame:
    """Keys take the columns of the index behind them, foreign keys their pairs, checks their text."""
    none = F.array().cast(NONE)
    of_index = _listed(_index_columns(x).where("not is_included_column"), [*AT, "object_id", "index_id"], "key_ordinal", "column_key").select(*AT, F.col("object_id").alias("parent_object_id"), F.col("index_id").alias("unique_index_id"), F.col("column_key").alias("columns"))
    owner = _owners(x, "parent_object_id").where("what = 'table'")
    k = x["key_constraints"].withColumn("kind", _named(F.trim("type"), KEYS)).join(owner, [*AT, "parent_object_id"]).join(of_index, [*AT, "parent_object_id", "unique_index_id"], "left")
    text = lambda: F.lit(None).cast("string")
    out = lambda df, columns, target, referenced, expression: df.withColumn("key", _key(_named(F.col("kind"), KEY_KINDS), F.col("schema"), F.col("owner_name"), F.col("name"))).select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", "kind", F.coalesce(columns, none).alias("columns"), target.alias("referenced_table_key"), F.coalesce(referenced, none).alias("referenced_columns"), expression.alias("expression"))
    parts = [out(k, F.col("columns"), text(), none, text())]
    col = lambda o, c, n: _columns(x).select(*AT, F.col("object_id").alias(o), F.col("column_id").alias(c), F.col("key").alias(n))
    pairs = x["foreign_key_columns"].join(col("parent_object_id", "parent_column_id", "from_column"), [*AT, "parent_object_id", "parent_column_id"]).join(col("referenced_object_id", "referenced_column_id", "to_column"), [*AT, "referenced_object_id", "referenced_column_id"])
    pairs = _listed(pairs, [*AT, "constraint_object_id"], "constraint_column_id", "from_column", "to_column").withColumnRenamed("constraint_object_id", "object_id")
    target = _owners(x, "referenced_object_id").select(*AT, "referenced_object_id", F.col("owner_key").alias("target_key"))
    fk = x["foreign_keys"].withColumn("kind", F.lit("foreign_key")).join(owner, [*AT, "parent_object_id"]).join(target, [*AT, "referenced_object_id"], "left").join(pairs, [*AT, "object_id"], "left")
    parts.append(out(fk, F.col("from_column"), F.col("target_key"), F.col("to_column"), text()))
    # The columns of a check are what the catalog says that it depends on.
    uses = x["sql_expression_dependencies"].where(f"referenced_class = {OBJECT} and referenced_minor_id > 0").select(*AT, F.col("referencing_id").alias("object_id"), F.col("referenced_id").alias("parent_object_id"), F.col("referenced_minor_id").alias("column_id"))
    used = uses.distinct().join(col("parent_object_id", "column_id", "column_key"), [*AT, "parent_object_id", "column_id"])
    used = _listed(used, [*AT, "object_id", "parent_object_id"], "column_id", "column_key")
    ck = x["check_constraints"].withColumn("kind", F.lit("check")).join(owner, [*AT, "parent_object_id"]).join(used, [*AT, "object_id", "parent_object_id"], "left")
    parts.append(out(ck, F.col("column_key"), text(), none, F.col("definition")))
    return reduce(DataFrame.unionByName, parts)


def _indexes(x: Extract) -> DataFrame:
    """Indexes with a name: those without are heaps."""
    return x["indexes"].where("name is not null").join(_owners(x, "object_id"), [*AT, "object_id"]).withColumn("key", _key("index", F.col("schema"), F.col("owner_name"), F.col("name")))


def map_indexes(x: Extract) -> DataFrame:
    """B5."""
    cols = _listed(_index_columns(x).where("not is_included_column"), [*AT, "object_id", "index_id"], "key_ordinal", "column_key")
    i = _indexes(x).where("what = 'table'").join(cols, [*AT, "object_id", "index_id"], "left")
    return i.select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", F.coalesce("column_key", F.array().cast(NONE)).alias("columns"), "is_unique", F.col("is_primary_key").alias("is_primary"), F.col("filter_definition").alias("predicate"), F.lit(None).cast("string").alias("expression"))


def _routines(x: Extract) -> DataFrame:
    return _in_schema(x, "objects", "routine").withColumn("kind", _named(F.trim("type"), ROUTINES)).where("kind is not null")


def _bodies(x: Extract) -> DataFrame:
    return x["sql_modules"].select(*AT, "object_id", "definition")


def _triggers(x: Extract) -> DataFrame:
    owner = _owners(x, "parent_id")
    return x["triggers"].join(owner, [*AT, "parent_id"]).withColumn("key", _key("trigger", F.col("schema"), F.col("owner_name"), F.col("name")))


def registry(x: Extract) -> DataFrame:
    """(snapshot_key, class, major, minor, kind, key): every id of the catalog that anything can refer to, a written table."""
    db = x["databases"].select(*AT, F.col("source_kind").alias("_source"), F.col("connection_alias").alias("_alias"), F.col("name").alias("_database"))
    zero = F.lit(0).cast("long")

    def ids(df: DataFrame, of_class: int, kind: Column | str, major: Column | str, minor: Column | str | None = None, key: str = "key") -> DataFrame:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        return df.select(*AT, F.lit(of_class).alias("class"), col(major).cast("long").alias("major"), (zero if minor is None else col(minor).cast("long")).alias("minor"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(key).alias("key"))

    out = [
        ids(db.withColumn("key", _key("database", F.col("_database"), F.col("_database"))), DATABASE, "database", zero),
        ids(_schemas(x), SCHEMA, "schema", "schema_id", key="schema_key"),
        ids(_relations(x), OBJECT, F.col("what"), "object_id"),
        ids(_columns(x), OBJECT, F.when(F.col("what") == "table", "column").otherwise("view_column"), "object_id", "column_id"),
        ids(_routines(x), OBJECT, "routine", "object_id"),
        ids(_triggers(x), OBJECT, "trigger", "object_id"),
        ids(_indexes(x), INDEX, "index", "object_id", "index_id"),
    ]
    for name, kind in (("key_constraints", _named(_named(F.trim("type"), KEYS), KEY_KINDS)), ("foreign_keys", F.lit("foreign_key")), ("check_constraints", F.lit("check_constraint"))):
        if name in x:
            c = x[name].withColumn("kind", kind).join(_owners(x, "parent_object_id"), [*AT, "parent_object_id"]).withColumn("key", _key(F.col("kind"), F.col("schema"), F.col("owner_name"), F.col("name")))
            out.append(ids(c, OBJECT, F.col("kind"), "object_id"))
    for name, kind in (("sequences", "sequence"), ("synonyms", "synonym")):
        if name in x:
            out.append(ids(_in_schema(x, name, kind), OBJECT, kind, "object_id"))
    if "types" in x:
        out.append(ids(_in_schema(x, "types", "user_defined_type"), TYPE, "user_defined_type", "user_type_id"))
    if "parameters" in x:
        out.append(ids(_parameters(x), PARAMETER, "routine_parameter", "object_id", "parameter_id"))
    for name, of_class, number, sub, schema in (("partition_functions", FUNCTION, "function_id", "partition-function:", None), ("partition_schemes", SCHEME, "data_space_id", "partition-scheme:", None), ("database_principals", PRINCIPAL, "principal_id", None, None)):
        if name in x:
            rows = _scoped(x, name)
            kind = "extension" if sub else "principal"
            key = _key(kind, F.col("_database"), F.col("name"), F.concat(F.lit(sub), F.col(number).cast("string")) if sub else None)
            out.append(ids(rows.withColumn("key", key), of_class, kind, number))
    if "xml_schema_collections" in x:
        out.append(ids(_collections(x), XML, "extension", "xml_collection_id"))
    return written(reduce(DataFrame.unionByName, out), "registry")


def _parameters(x: Extract) -> DataFrame:
    """Parameters of routines; number 0 is what a function returns."""
    r = _routines(x).select(*AT, *SCOPE, "object_id", "schema", F.col("name").alias("routine_name"), F.col("key").alias("routine_key"))
    p = x["parameters"].where("parameter_id > 0").join(r, [*AT, "object_id"])
    return p.withColumn("key", _key("routine_parameter", F.col("schema"), F.col("routine_name"), F.concat(F.col("parameter_id").cast("string"), F.lit(":"), F.col("name"))))


def _collections(x: Extract) -> DataFrame:
    return _in_schema(x, "xml_schema_collections", "extension").withColumn("key", _key("extension", F.col("schema"), F.col("name"), F.lit("xml-schema-collection")))


def _object(df: DataFrame, parent: str, name: Column | str, extension: str | None = None, definition: Column | None = None, **properties: Column) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    held = F.create_map(*[v for n, c in properties.items() for v in (F.lit(n), c)]) if properties else F.create_map().cast("map<string,struct<type:string,value:string>>")
    held = F.map_filter(held, lambda _, v: v.value.isNotNull())
    return df.select("snapshot_key", "key", F.col(parent).alias("parent_key"), (F.col(name) if isinstance(name, str) else name).alias("name"), text(None if extension is None else F.lit(extension)).alias("extension_kind"), text(definition).alias("definition"), held.alias("properties"))


def _link(df: DataFrame, kind: str, from_: str, to: str, ordinal: Column | None = None, extension: str | None = None) -> DataFrame:
    return df.select("snapshot_key", F.lit(kind).alias("kind"), F.lit(extension).cast("string").alias("extension_name"), F.col(from_).alias("from_key"), F.col(to).alias("to_key"), (F.lit(None) if ordinal is None else ordinal).cast("int").alias("ordinal"))


def _issue(df: DataFrame, code: str, subject: Column | str, message: Column | str) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select("snapshot_key", F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("object_key"), lit(message).alias("message"))


def _registered(ids: DataFrame, of_class: int | None, **names: str) -> DataFrame:
    """The registry with its columns renamed, all classes or one."""
    rows = ids if of_class is None else ids.where(F.col("class") == of_class)
    return rows.select(*AT, *[F.col(c).alias(n) for c, n in names.items()])


# Extended properties


def extended_properties(x: Extract, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, issues): each property as an extension under what it describes, whatever its class: one join with the registry by (class, major, minor). A target that isn't registered is an issue."""
    p = _scoped(x, "extended_properties").select("*", F.col("major_id").cast("long").alias("major"), F.col("minor_id").cast("long").alias("minor"))
    got = p.join(ids.select(*AT, "class", "major", "minor", F.col("key").alias("target_key"), F.col("kind").alias("target_kind")), [*AT, "class", "major", "minor"], "left")
    number = F.concat_ws(":", F.col("class").cast("string"), F.col("major_id").cast("string"), F.col("minor_id").cast("string"), "name")
    # Its key has the schema and the name of what it describes.
    parts = F.split(F.regexp_replace("target_key", "^v2:", ""), ":")
    plain = lambda c: F.replace(F.replace(c, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    at = lambda i: F.when(F.col("target_key").startswith("v2:"), plain(parts[i])).otherwise(parts[i])
    found = got.where("target_key is not null").withColumn("key", _key("extension", at(3), at(5), F.concat(F.lit("extended-property:"), number)))
    objects = _object(found, "target_key", "name", "sqlserver_extended_property", **{"class": prop("integer", F.col("class"))}, major_id=prop("integer", F.col("major_id")), minor_id=prop("integer", F.col("minor_id")), value_is_null=prop("boolean", F.col("value").isNull()), display_value=prop("string", F.col("value")))
    return objects, _issue(got.where("target_key is null"), "extended_property_target_missing", number, "an extended property describes something that isn't in the extract")


# synonyms


def name_parts(c: Column) -> Column:
    """A multi-part name as struct(server, database, schema, entity): parts by dots outside of brackets, brackets and doubled closing ones undone, empty parts null. Names of more than four parts have no entity."""
    raw = F.regexp_extract_all(c, F.lit(r"(?:^|\.)(\[(?:[^\]]|\]\])*\]|[^.]*)"), F.lit(1))
    parts = F.transform(raw, lambda p: F.when(p.startswith("["), F.replace(F.regexp_replace(p, r"^\[|\]$", ""), F.lit("]]"), F.lit("]"))).otherwise(p))
    parts = F.transform(parts, lambda p: F.nullif(p, F.lit("")))
    n = F.size(parts)
    at = lambda i: F.when(n <= 4, F.get(parts, n - i))
    return F.struct(at(4).alias("server"), at(3).alias("database"), at(2).alias("schema"), at(1).alias("entity"))


def _named_objects(x: Extract) -> DataFrame:
    """(snapshot_key, target_schema, target_name, local_key): what a schema and a name can mean: tables, views, routines, sequences and synonyms, which share one name space."""
    cols = [*AT, F.col("schema").alias("target_schema"), F.col("name").alias("target_name"), F.col("key").alias("local_key")]
    parts = [_relations(x).select(*cols), _routines(x).select(*cols)]
    parts += [_in_schema(x, n, k).select(*cols) for n, k in (("sequences", "sequence"), ("synonyms", "synonym")) if n in x]
    return reduce(DataFrame.unionByName, parts)


def _external_key(full: str) -> Column:
    return _key("extension", F.lit("external"), F.col(full), F.lit("reference"))


def _local(database: str) -> Column:
    return F.col("n.server").isNull() & (F.col("n.database").isNull() | (F.lower("n.database") == F.lower(database)))


def synonyms(x: Extract) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(objects, links, external references wanted, issues). A name of this server and database (whatever its case) that is known leads to that object; any other to an external reference, made once for each name. A synonym without a name is an issue."""
    s = _in_schema(x, "synonyms", "synonym").withColumn("n", name_parts(F.col("base_object_name")))
    own = F.when(_local("_database"), F.col("n.schema")), F.when(_local("_database"), F.col("n.entity"))
    s = s.withColumn("target_schema", own[0]).withColumn("target_name", own[1]).join(_named_objects(x), [*AT, "target_schema", "target_name"], "left")
    blank = F.coalesce(F.trim("base_object_name"), F.lit("")) == ""
    s = s.withColumn("to_key", F.coalesce("local_key", F.when(~blank, _external_key("base_object_name"))))
    objects = _object(s, "schema_key", "name", base_object_name=prop("string", F.col("base_object_name")))
    wanted = s.where(F.col("local_key").isNull() & ~blank).select(*AT, *SCOPE, F.col("base_object_name").alias("full"), F.lit(0).alias("rank"), F.lit("synonym_target").alias("reference_kind"), "n")
    return objects, _link(s.where("to_key is not null"), "synonym_for", "key", "to_key"), wanted, _issue(s.where(blank), "synonym_target_missing", "key", "a synonym names nothing")


def external_references(wanted: list[DataFrame]) -> DataFrame:
    """One external-reference object for each distinct full name of a snapshot; its parts and kind are those of the first that wants it, synonyms before dependencies."""
    rows = reduce(DataFrame.unionByName, wanted).groupBy(*AT, *SCOPE, "full").agg(F.min(F.struct("rank", "reference_kind", "n")).alias("w"))
    rows = rows.withColumn("key", _external_key("full")).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
    part = lambda c: prop("string", F.col(f"w.n.{c}"))
    return _object(rows, "database_key", "full", "sqlserver_external_reference", reference_kind=prop("string", F.col("w.reference_kind")), server=part("server"), database=part("database"), schema=part("schema"), entity=part("entity"))


# Partition functions, boundaries, schemes and partitions


def partition_intervals(x: Extract) -> DataFrame:
    """(snapshot_key, function_id, partition_number, lower, upper, lower_closed): a function's ordered boundaries as its partitions' intervals, the first and the last open-ended; a boundary belongs to the partition on its right or to that on its left, as the function says. Functions have at most 14 999 boundaries."""
    b = x["partition_range_values"].select(*AT, "function_id", "boundary_id", F.col("value").cast("string").alias("value"))
    by = W.partitionBy(*AT, "function_id").orderBy("boundary_id")
    closed = b.withColumn("lower", F.lag("value").over(by)).withColumn("partition_number", F.row_number().over(by)).select(*AT, "function_id", "partition_number", "lower", F.col("value").alias("upper"))
    last = b.groupBy(*AT, "function_id").agg(F.count("*").cast("int").alias("n"), F.max_by("value", "boundary_id").alias("lower"))
    f = x["partition_functions"].select(*AT, "function_id", "boundary_value_on_right")
    ends = f.join(last, [*AT, "function_id"], "left").select(*AT, "function_id", (F.coalesce("n", F.lit(0)) + 1).alias("partition_number"), "lower", F.lit(None).cast("string").alias("upper"))
    return closed.unionByName(ends).join(f, [*AT, "function_id"]).select(*AT, "function_id", "partition_number", "lower", "upper", F.col("boundary_value_on_right").alias("lower_closed"))


def partitions(x: Extract, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, links, issues): functions with their boundaries, schemes with the function they use, and partitions of tables (heaps) and indexes, each with the scheme of its index and the interval that the scheme's function gives it."""
    f = _scoped(x, "partition_functions").withColumn("key", _key("extension", F.col("_database"), F.col("name"), F.concat(F.lit("partition-function:"), F.col("function_id").cast("string")))).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
    functions = _object(f, "database_key", "name", "sqlserver_partition_function", fanout=prop("integer", F.col("fanout")), boundary_on_right=prop("boolean", F.col("boundary_value_on_right")))
    v = x["partition_range_values"].join(f.select(*AT, *SCOPE, "function_id", F.col("name").alias("function_name"), F.col("key").alias("function_key")), [*AT, "function_id"]).withColumn("key", _key("extension", F.col("_database"), F.col("function_name"), F.concat(F.lit("partition-boundary:"), F.col("boundary_id").cast("string"))))
    boundaries = _object(v, "function_key", F.concat(F.col("function_name"), F.lit(" boundary "), F.col("boundary_id").cast("string")), "sqlserver_partition_boundary", boundary_id=prop("integer", F.col("boundary_id")), value=prop("string", F.col("value")))
    s = _scoped(x, "partition_schemes").withColumn("key", _key("extension", F.col("_database"), F.col("name"), F.concat(F.lit("partition-scheme:"), F.col("data_space_id").cast("string")))).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
    s = s.join(f.select(*AT, "function_id", F.col("key").alias("function_key")), [*AT, "function_id"], "left")
    schemes = _object(s, "database_key", "name", "sqlserver_partition_scheme")
    of_index = x["indexes"].select(*AT, "object_id", "index_id", "data_space_id").join(s.select(*AT, "data_space_id", "function_id", F.col("key").alias("scheme_key")), [*AT, "data_space_id"])
    # Partitions of index 0 are those of the table itself.
    p = x["partitions"].withColumn("class", F.when(F.col("index_id") == 0, OBJECT).otherwise(INDEX)).withColumn("major", F.col("object_id").cast("long")).withColumn("minor", F.col("index_id").cast("long"))
    p = p.join(ids.select(*AT, "class", "major", "minor", F.col("key").alias("parent_key")), [*AT, "class", "major", "minor"], "left").join(of_index, [*AT, "object_id", "index_id"], "left").join(partition_intervals(x), [*AT, "function_id", "partition_number"], "left")
    number = F.concat_ws(":", F.col("object_id").cast("string"), F.col("index_id").cast("string"), F.col("partition_number").cast("string"))
    own = p.where("parent_key is not null").join(_owners(x, "object_id"), [*AT, "object_id"]).withColumn("key", _key("extension", F.col("schema"), F.col("owner_name"), F.concat(F.lit("partition:"), F.col("index_id").cast("string"), F.lit(":"), F.col("partition_number").cast("string"))))
    rows = _object(own, "parent_key", F.concat(F.lit("partition "), F.col("partition_number").cast("string")), "sqlserver_partition", index_id=prop("integer", F.col("index_id")), partition_number=prop("integer", F.col("partition_number")), data_compression=prop("string", F.col("data_compression_desc")), lower=prop("string", F.col("lower")), upper=prop("string", F.col("upper")), lower_closed=prop("boolean", F.col("lower_closed")))
    links = [_link(s.where("function_key is not null"), "extension", "key", "function_key", extension="partition_scheme_uses_function"), _link(own.where("scheme_key is not null"), "extension", "key", "scheme_key", extension="partition_uses_scheme")]
    issues = [_issue(s.where("function_key is null"), "partition_function_missing", "key", "a scheme uses a function that isn't in the extract"), _issue(p.where("parent_key is null"), "partition_parent_missing", number, "a partition is of nothing in the extract"), _issue(own.where("scheme_key is not null and lower_closed is null"), "partition_number_invalid", "key", "the function has no such partition")]
    return reduce(DataFrame.unionByName, [functions, boundaries, schemes, rows]), reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, issues)


# XML schema collections, temporal tables


def xml_collections(x: Extract) -> DataFrame:
    """Collections and their namespaces; an empty namespace is the default one."""
    c = _collections(x)
    out = _object(c, "schema_key", "name", "sqlserver_xml_schema_collection", xml_collection_id=prop("integer", F.col("xml_collection_id")))
    if "xml_schema_namespaces" not in x:
        return out
    of = c.select(*AT, *SCOPE, "xml_collection_id", "schema", F.col("name").alias("collection"), F.col("key").alias("collection_key"))
    n = x["xml_schema_namespaces"].join(of, [*AT, "xml_collection_id"]).withColumn("key", _key("extension", F.col("schema"), F.col("collection"), F.concat(F.lit("xml-schema-namespace:"), F.col("xml_namespace_id").cast("string"))))
    return out.unionByName(_object(n, "collection_key", F.when(F.col("name") == "", "default namespace").otherwise(F.col("name")), "sqlserver_xml_schema_namespace", xml_namespace_id=prop("integer", F.col("xml_namespace_id")), namespace=prop("string", F.col("name"))))


def temporal_links(x: Extract) -> tuple[DataFrame, DataFrame]:
    """(links, issues): system-versioned tables (temporal_type 2) with their history tables (temporal_type 1). The link must hold both ways: a history table has one versioned table, a versioned one a history table of the extract; one self-join of the tables, both sides kept."""
    t = _in_schema(x, "tables", "table").select(*AT, "object_id", "key", F.col("temporal_type").cast("int").alias("temporal_type"), "history_table_id")
    versioned = t.where("temporal_type = 2").select(*AT, F.col("key").alias("versioned_key"), F.col("history_table_id").alias("object_id"))
    history = t.select(*AT, "object_id", F.col("key").alias("history_key"), "temporal_type")
    both = versioned.join(history, [*AT, "object_id"], "left")
    good = both.where("temporal_type = 1")
    shared = good.groupBy(*AT, "history_key").agg(F.count("*").alias("n")).where("n > 1")
    lost = history.where("temporal_type = 1").join(versioned.select(*AT, "object_id"), [*AT, "object_id"], "left_anti")
    issues = [
        _issue(both.where("history_key is null"), "temporal_history_missing", "versioned_key", "a versioned table's history isn't in the extract"),
        _issue(both.where("history_key is not null and temporal_type <> 1"), "temporal_history_mismatch", "versioned_key", "a versioned table's history is no history table"),
        _issue(shared, "temporal_history_shared", "history_key", "a history table has more than one versioned table"),
        _issue(lost, "temporal_history_orphaned", "history_key", "a history table has no versioned table"),
    ]
    return _link(good, "extension", "versioned_key", "history_key", extension="temporal_history_table"), reduce(DataFrame.unionByName, issues)


# Dependencies


def dependencies(x: Extract, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, external references wanted) of sql_expression_dependencies. resolved(snapshot_key, referencing_id, state, from_key, from_kind, to_key, to_kind): a target by its id and class, else by its schema and name in this database, else an external reference. state is resolved, caller_dependent (found only when it runs) or ambiguous."""
    d = _scoped(x, "sql_expression_dependencies")
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    d = d.select("*", long("referencing_id").alias("from_major"), long("referencing_minor_id").alias("from_minor"), long("referenced_id").alias("to_major"), F.when(F.col("referenced_class").isin(OBJECT, INDEX), long("referenced_minor_id")).otherwise(0).cast("long").alias("to_minor"))
    whole = _registered(ids, OBJECT, major="from_major", minor="m", kind="whole_kind", key="whole_key").where("m = 0").drop("m")
    part = _registered(ids, OBJECT, major="from_major", minor="from_minor", kind="part_kind", key="part_key").where("from_minor > 0")
    target = ids.select(*AT, F.col("class").alias("referenced_class"), F.col("major").alias("to_major"), F.col("minor").alias("to_minor"), F.col("kind").alias("direct_kind"), F.col("key").alias("direct_key"))
    got = d.join(whole, [*AT, "from_major"], "left").join(part, [*AT, "from_major", "from_minor"], "left").join(target, [*AT, "referenced_class", "to_major", "to_minor"], "left")
    got = got.withColumn("n", F.struct(F.col("referenced_server_name").alias("server"), F.col("referenced_database_name").alias("database"), F.col("referenced_schema_name").alias("schema"), F.col("referenced_entity_name").alias("entity")))
    got = got.withColumn("target_schema", F.when(_local("_database"), F.col("n.schema"))).withColumn("target_name", F.when(_local("_database"), F.col("n.entity"))).join(_named_objects(x), [*AT, "target_schema", "target_name"], "left")
    got = got.withColumn("full", F.concat_ws(".", "n.server", "n.database", "n.schema", "n.entity"))
    state = F.when(F.coalesce("is_ambiguous", F.lit(False)), "ambiguous").when(F.coalesce("is_caller_dependent", F.lit(False)), "caller_dependent").otherwise("resolved")
    kind_of = lambda c: F.split(F.regexp_replace(c, "^v2:", ""), ":")[4]
    to = F.coalesce("direct_key", "local_key", F.when(F.col("full") != "", _external_key("full")))
    rows = written(got.select(*AT, *SCOPE, "referencing_id", state.alias("state"), F.coalesce("part_key", "whole_key").alias("from_key"), F.coalesce("part_kind", "whole_kind").alias("from_kind"), to.alias("to_key"), kind_of(to).alias("to_kind"), (F.col("direct_key").isNull() & F.col("local_key").isNull() & (F.col("full") != "")).alias("outside"), "full", "n", F.when(F.col("referenced_id").isNotNull(), "unmodeled_local_reference").otherwise("symbolic_reference").alias("reference_kind")), "dependencies")
    # Checks take their columns as members, so that what they depend on there is no relationship.
    own = rows.where("from_key is not null and to_key is not null and from_key <> to_key and not (from_kind = 'check_constraint' and to_kind in ('column', 'table'))")
    wanted = own.where("outside").select(*AT, *SCOPE, "full", F.lit(1).alias("rank"), "reference_kind", "n")
    return own.drop("outside", "full", "n", "reference_kind", *SCOPE), wanted


def _uses(deps: DataFrame, kind: str) -> DataFrame:
    listed = deps.where((F.col("from_kind") == kind) & F.col("to_kind").isin(*LISTED))
    return listed.groupBy(*AT, F.col("from_key").alias("key")).agg(F.array_sort(F.collect_set("to_key")).alias("deps"))


def dependency_links(deps: DataFrame) -> DataFrame:
    """What isn't in the lists of views and routines, as relationships by the kinds of both ends."""
    rest = deps.where(~(F.col("from_kind").isin("view", "routine") & F.col("to_kind").isin(*LISTED))).select(*AT, "from_key", "to_key", "from_kind", "to_kind").distinct()
    kind = F.when((F.col("from_kind") == "column") & (F.col("to_kind") == "sequence"), "uses_sequence").when((F.col("from_kind") == "trigger") & (F.col("to_kind") == "routine"), "invokes").otherwise("depends_on")
    return rest.select("snapshot_key", kind.alias("kind"), F.lit(None).cast("string").alias("extension_name"), "from_key", "to_key", F.lit(None).cast("int").alias("ordinal"))


#: Statements that run text which no catalog follows: EXEC of a text, of a variable in brackets, of a variable that isn't assigned to, and sp_executesql.
DYNAMIC = r"(?i)\bexec(?:ute)?\s*(?:\(\s*(?:@|N?')|N?'|@\w+\s*(?![\w\s]*=)|@\w+\s*=\s*(?:@|N?')|(?:[\w\[\]]+\s*\.\s*){0,3}\[?sp_executesql\b)"


def open_dependencies(x: Extract, ids: DataFrame, deps: DataFrame) -> DataFrame:
    """(snapshot_key, code, object_key, message): bodies whose dependencies the catalog doesn't vouch for: those with a caller-dependent or ambiguous reference, those that run texts, and whatever reaches one of these through its own dependencies, level by level until no more is reached; each once, for the reason found first."""
    own = deps.where("state <> 'resolved'").groupBy(*AT, F.col("from_key").alias("key")).agg(F.concat(F.lit("a reference is "), F.min("state")).alias("why"))
    bodies = _registered(ids, OBJECT, major="object_id", kind="kind", key="key").where("kind in ('routine', 'trigger', 'view')")
    # Comments may hold anything.
    plain = F.regexp_replace(F.regexp_replace("definition", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    dynamic = _bodies(x).where(plain.rlike(DYNAMIC)).join(bodies, [*AT, "object_id"]).select(*AT, "key", F.lit("it runs a text").alias("why"))
    found = written(own.unionByName(dynamic).groupBy(*AT, "key").agg(F.min("why").alias("why")), "open")
    reached, level = found, found
    while not level.isEmpty():
        more = deps.where("from_kind in ('routine', 'trigger', 'view')").join(level.select(*AT, F.col("key").alias("to_key")), [*AT, "to_key"]).select(*AT, F.col("from_key").alias("key")).distinct()
        level = written(more.join(reached, [*AT, "key"], "left_anti").withColumn("why", F.lit("it reaches an open body")), "open")
        reached = reached.unionByName(level)
    return _issue(reached, "dependency_closure_unproven", "key", F.col("why"))


def map_views(x: Extract, deps: DataFrame) -> DataFrame:
    """B8."""
    v = _relations(x).where("what = 'view'").join(_bodies(x), [*AT, "object_id"], "left").join(_uses(deps, "view"), [*AT, "key"], "left")
    return v.select("snapshot_key", "key", "schema_key", "name", "definition", F.coalesce("deps", F.array().cast(NONE)).alias("depends_on"))


def map_routines(x: Extract, deps: DataFrame) -> DataFrame:
    """B12."""
    r = _routines(x).join(_bodies(x), [*AT, "object_id"], "left").join(_uses(deps, "routine"), [*AT, "key"], "left")
    return r.select("snapshot_key", "key", "schema_key", "name", "kind", "definition", F.coalesce("deps", F.array().cast(NONE)).alias("depends_on"))


def map_triggers(x: Extract) -> DataFrame:
    """One object for each trigger; this catalog's triggers have bodies of their own and execute no routine."""
    events = x["trigger_events"].groupBy(*AT, "object_id").agg(F.array_sort(F.collect_set("type_desc")).alias("events"))
    t = _triggers(x).join(events, [*AT, "object_id"], "left").join(_bodies(x), [*AT, "object_id"], "left")
    return t.select("snapshot_key", "key", F.col("owner_key").alias("table_key"), "name", F.when(F.col("is_instead_of_trigger"), "INSTEAD OF").otherwise("AFTER").alias("timing"), F.coalesce("events", F.array().cast(NONE)).alias("events"), "definition", F.lit(None).cast("string").alias("executes_routine_key"))


def metadata(x: Extract, ids: DataFrame, deps: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, relationships, issues) besides the typed tables: view columns (B9), included columns (B6), parameters (B13), sequences (B14), types (B15), synonyms and external references (B16), principals and owners (B17), partitions (B19), extended properties (B21), XML collections and temporal tables (B22). Tables that the extract lacks give none."""
    has = lambda *names: all(n in x for n in names)
    objects = [_object(_columns(x).where("what = 'view'"), "owner_key", "name", data_type=prop("string", F.col("type_name")), ordinal_position=prop("unsigned", F.col("column_id")))]
    links, issues, outside = [dependency_links(deps)], [], [wanted]
    i = _index_columns(x).where("is_included_column").join(_indexes(x).select(*AT, "object_id", "index_id", F.col("key").alias("index_key")), [*AT, "object_id", "index_id"])
    links.append(_link(i, "includes_column", "index_key", "column_key", F.col("index_column_id")))
    if has("parameters"):
        p = _parameters(x)
        objects.append(_object(p, "routine_key", "name", data_type=prop("string", F.col("type_name")), ordinal_position=prop("unsigned", F.col("parameter_id"))))
        links.append(_link(p, "has_parameter", "routine_key", "key", F.col("parameter_id")))
    if has("sequences"):
        objects.append(_object(_in_schema(x, "sequences", "sequence"), "schema_key", "name"))
    if has("types"):
        objects.append(_object(_in_schema(x, "types", "user_defined_type"), "schema_key", "name"))
        of = _registered(ids, TYPE, major="user_type_id", key="type_key")
        links.append(_link(_columns(x).where("what = 'table'").join(of, [*AT, "user_type_id"]), "uses_type", "key", "type_key"))
    if has("synonyms"):
        got = synonyms(x)
        for to, df in zip((objects, links, outside, issues), got, strict=True):
            to.append(df)
    if has("database_principals"):
        p = _scoped(x, "database_principals").withColumn("key", _key("principal", F.col("_database"), F.col("name"))).withColumn("database_key", _key("database", F.col("_database"), F.col("_database")))
        objects.append(_object(p, "database_key", "name"))
        # An object without an owner of its own has its schema's.
        owned = _in_schema(x, "tables", "table").select(*AT, "key", F.coalesce("owner_id", "schema_owner").alias("principal_id")).unionByName(_in_schema(x, "views", "view").select(*AT, "key", F.coalesce("owner_id", "schema_owner").alias("principal_id"))).unionByName(_schemas(x).select(*AT, F.col("schema_key").alias("key"), F.col("schema_owner").alias("principal_id")))
        links.append(_link(owned.join(p.select(*AT, "principal_id", F.col("key").alias("owner")), [*AT, "principal_id"]), "owned_by", "key", "owner"))
    if has("partition_functions", "partition_schemes", "partitions", "partition_range_values"):
        for to, df in zip((objects, links, issues), partitions(x, ids), strict=True):
            to.append(df)
    if has("xml_schema_collections"):
        objects.append(xml_collections(x))
    if "history_table_id" in x["tables"].columns:
        for to, df in zip((links, issues), temporal_links(x), strict=True):
            to.append(df)
    if has("extended_properties"):
        for to, df in zip((objects, issues), extended_properties(x, ids), strict=True):
            to.append(df)
    objects.append(external_references(outside))
    none = x["databases"].where("false").select("snapshot_key", *[F.lit(None).cast("string").alias(n) for n in ("code", "object_key", "message")])
    return reduce(DataFrame.unionByName, objects), reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, issues, none)


def map_catalog(x: Extract) -> tuple[Canonical, DataFrame]:
    """All of a sys extract, and the issues of its references."""
    db, ids = x["databases"], registry(x)
    deps, wanted = dependencies(x, ids)
    objects, links, issues = metadata(x, ids, deps, wanted)
    databases = db.select("snapshot_key", object_key(F.col("source_kind"), F.col("connection_alias"), F.col("name"), F.col("name"), "database", F.col("name")).alias("key"), "name", "source_kind", "connection_alias")
    c = Canonical.of(db.sparkSession, databases=databases, schemas=map_schemas(x), tables=map_tables(x), columns=map_columns(x), constraints=map_constraints(x), indexes=map_indexes(x), views=map_views(x, deps), triggers=map_triggers(x), routines=map_routines(x, deps), metadata_objects=objects, relationships=links)
    return c, issues


def as_sys(c: Canonical) -> Extract:
    """The other way, for the typed tables: the extract that a server with these objects would give, with hashes of keys as ids. Triggers come without the routines that they execute."""
    oid = lambda k: F.xxhash64(F.col(k))
    table = lambda df: df.select("*", oid("table_key").alias("parent_object_id"))
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    col = c.columns.select(*AT, F.col("key").alias("ckey"), oid("table_key").alias("object_id"), F.col("ordinal_position").alias("column_id"))
    k = table(c.constraints)
    keyed = k.where("kind in ('primary_key', 'unique')")
    letter = _named(F.col("kind"), {v: n for n, v in KEYS.items()})
    # An index behind each key and unique constraint has no name here, for the fleet has none for it.
    hidden = keyed.select(*AT, F.col("parent_object_id").alias("object_id"), oid("key").alias("index_id"), text.alias("name"), F.lit(True).alias("is_unique"), (F.col("kind") == "primary_key").alias("is_primary_key"), text.alias("filter_definition"), F.lit(0).cast("long").alias("data_space_id"), "columns")
    indexes = c.indexes.select(*AT, oid("table_key").alias("object_id"), oid("key").alias("index_id"), "name", "is_unique", F.col("is_primary").alias("is_primary_key"), F.col("predicate").alias("filter_definition"), F.lit(0).cast("long").alias("data_space_id"), "columns").unionByName(hidden)
    of_index = indexes.select(*AT, "object_id", "index_id", F.posexplode("columns").alias("at", "ckey")).join(col.select(*AT, "ckey", "column_id"), [*AT, "ckey"]).select(*AT, "object_id", "index_id", (F.col("at") + 1).alias("index_column_id"), "column_id", (F.col("at") + 1).alias("key_ordinal"), F.lit(False).alias("is_included_column"))
    fk = k.where("kind = 'foreign_key'")
    pairs = fk.select(*AT, oid("key").alias("constraint_object_id"), F.posexplode(F.arrays_zip("columns", "referenced_columns")).alias("at", "z"))
    end = lambda name, o, n: col.select(*AT, F.col("ckey").alias(name), F.col("object_id").alias(o), F.col("column_id").alias(n))
    pairs = pairs.select(*AT, "constraint_object_id", (F.col("at") + 1).alias("constraint_column_id"), F.col("z.columns").alias("a"), F.col("z.referenced_columns").alias("b")).join(end("a", "parent_object_id", "parent_column_id"), [*AT, "a"]).join(end("b", "referenced_object_id", "referenced_column_id"), [*AT, "b"]).drop("a", "b")
    uses = c.views.select(*AT, "key", F.explode("depends_on").alias("ckey")).unionByName(c.routines.select(*AT, "key", F.explode("depends_on").alias("ckey"))).unionByName(c.constraints.where("kind = 'check'").select(*AT, "key", F.explode("columns").alias("ckey")))
    uses = uses.join(col, [*AT, "ckey"], "left")
    deps = uses.select(*AT, F.lit(OBJECT).alias("referencing_class"), oid("key").alias("referencing_id"), F.lit(0).alias("referencing_minor_id"), F.lit(OBJECT).alias("referenced_class"), text.alias("referenced_server_name"), text.alias("referenced_database_name"), text.alias("referenced_schema_name"), F.lit("x").alias("referenced_entity_name"), F.coalesce("object_id", F.xxhash64("ckey")).alias("referenced_id"), F.coalesce("column_id", F.lit(0)).alias("referenced_minor_id"), F.lit(False).alias("is_caller_dependent"), F.lit(False).alias("is_ambiguous"))
    bodies = c.views.select(*AT, oid("key").alias("object_id"), "definition").unionByName(c.routines.select(*AT, oid("key").alias("object_id"), "definition")).unionByName(c.triggers.select(*AT, oid("key").alias("object_id"), "definition"))
    one = F.lit(1).cast("long")
    return {
        "databases": c.databases.select("snapshot_key", "source_kind", "connection_alias", "name"),
        "schemas": c.schemas.select(*AT, oid("key").alias("schema_id"), "name", one.alias("principal_id")),
        "tables": c.tables.select(*AT, oid("key").alias("object_id"), oid("schema_key").alias("schema_id"), "name", none.alias("principal_id"), F.lit(0).alias("temporal_type"), none.alias("history_table_id")),
        "columns": c.columns.select(*AT, oid("table_key").alias("object_id"), F.col("ordinal_position").alias("column_id"), "name", F.lit(0).cast("long").alias("user_type_id"), F.col("data_type").alias("type_name"), "is_nullable", F.col("is_generated").alias("is_computed")),
        "key_constraints": keyed.select(*AT, oid("key").alias("object_id"), "name", "parent_object_id", letter.alias("type"), oid("key").alias("unique_index_id")),
        "foreign_keys": fk.select(*AT, oid("key").alias("object_id"), "name", "parent_object_id", oid("referenced_table_key").alias("referenced_object_id")),
        "foreign_key_columns": pairs,
        "check_constraints": k.where("kind = 'check'").select(*AT, oid("key").alias("object_id"), "name", "parent_object_id", F.col("expression").alias("definition")),
        "indexes": indexes.drop("columns"),
        "index_columns": of_index,
        "views": c.views.select(*AT, oid("key").alias("object_id"), oid("schema_key").alias("schema_id"), "name", none.alias("principal_id")),
        "objects": c.routines.select(*AT, oid("key").alias("object_id"), oid("schema_key").alias("schema_id"), "name", F.when(F.col("kind") == "function", "FN").otherwise("P").alias("type")),
        "sql_modules": bodies,
        "triggers": c.triggers.select(*AT, oid("key").alias("object_id"), "name", oid("table_key").alias("parent_id"), (F.col("timing") == "INSTEAD OF").alias("is_instead_of_trigger")),
        "trigger_events": c.triggers.select(*AT, oid("key").alias("object_id"), F.explode("events").alias("type_desc")),
        "sql_expression_dependencies": deps,
    }
