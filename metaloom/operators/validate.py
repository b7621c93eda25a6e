"""Validation rules (V1 to V15): each code is one query over the canonical tables of all snapshots; rule(c) gives (snapshot_key, code, object_key, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parse_key, rel_edge_type
from ..plans.model import CONSTRAINTS, ENDPOINTS, MAX_PROPERTIES, MAX_PROPERTY_ITEMS, MAX_PROPERTY_NAME, MAX_PROPERTY_TEXT, MAX_TEXT, METADATA_KINDS, PARENTS, Canonical
from ..plans.shared import written, written_all


EXPECTED = {"databases": "database", "schemas": "schema", "tables": "table", "columns": "column", "indexes": "index", "views": "view", "triggers": "trigger", "routines": "routine"}
OWNED = ["columns", "constraints", "indexes", "triggers"]


def _out(df: DataFrame, code: str, message: str, key: Column | str = "key") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select("snapshot_key", F.lit(code).alias("code"), key.alias("object_key"), F.lit(message).alias("message"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _parsed(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({f"{c}_p": parse_key(F.col(c)) for c in cols})


def _constraint_kind() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONSTRAINTS.items() for x in kv]), F.col("kind"))


def _codes(df: DataFrame, *checks: tuple[Column, str, str], key: Column | str = "key") -> DataFrame:
    """All row-local checks (condition, code, message) of a table in one scan."""
    key = F.col(key) if isinstance(key, str) else key
    hold = [F.coalesce(c, F.lit(False)) for c, _, _ in checks]
    found = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))) for h, (_, code, message) in zip(hold, checks, strict=True)]))
    rows = df.where(reduce(lambda a, b: a | b, hold)).select("snapshot_key", key.alias("object_key"), F.explode(found).alias("i"))
    return rows.select("snapshot_key", "i.code", "object_key", "i.message")


def _distinct_from(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def registry(c: Canonical) -> DataFrame:
    """(snapshot_key, key, list, expected, name, p, owner): every object with its parsed key and its table's. validate() writes it once for all rules."""
    if "registry" in c.t:
        return c.t["registry"]
    parts = []
    for n, kind in [*EXPECTED.items(), ("constraints", ""), ("metadata_objects", None)]:
        expected = _constraint_kind() if kind == "" else F.lit(kind).cast("string")
        owner = F.col("table_key") if n in OWNED else F.lit(None).cast("string")
        parts.append(c.t[n].select("snapshot_key", "key", F.lit(n).alias("list"), expected.alias("expected"), "name", owner.alias("owner_key")))
    return reduce(DataFrame.unionByName, parts).select("snapshot_key", "key", "list", "expected", "name", parse_key(F.col("key")).alias("p"), parse_key(F.col("owner_key")).alias("owner"))


def registered(c: Canonical, metadata: bool = False) -> DataFrame:
    """The registry's typed objects, and the metadata objects where asked for."""
    r = registry(c)
    return r if metadata else r.where("list <> 'metadata_objects'")


def header(c: Canonical) -> DataFrame:
    """V1."""
    db = c.databases
    caps = db.join(c.capabilities.select("snapshot_key", F.col("source_kind").alias("of_caps")), "snapshot_key")
    return _codes(db, (_blank(F.col("source_kind")), "snapshot_source_missing", "a snapshot needs a source kind"), (_blank(F.col("connection_alias")), "connection_alias_missing", "a snapshot needs an alias")).unionByName(_out(caps.where("of_caps is distinct from source_kind"), "capability_source_mismatch", "capabilities are of another source"))


def registration(c: Canonical) -> DataFrame:
    """V2."""
    r = registered(c)
    twice = r.groupBy("snapshot_key", "key").agg(F.count("*").alias("n")).where("n > 1").select("snapshot_key", "key", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return _out(r.where("p.object_kind is distinct from expected"), "object_kind_mismatch", "the key's kind isn't the object's").unionByName(_out(twice, "duplicate_object_key", "a key stands for more than one object"))


def scope(c: Canonical) -> DataFrame:
    """V3: each key once."""
    r = registered(c).join(c.databases.select("snapshot_key", "connection_alias", parse_key(F.col("key")).alias("d")), "snapshot_key")
    blank = reduce(lambda a, b: a | b, [_blank(F.col(f"p.{x}")) for x in ("source_kind", "database", "schema", "object_name")])
    return _codes(
        r,
        (_distinct_from("p.connection_alias", "connection_alias"), "connection_alias_mismatch", "the key's alias isn't the snapshot's"),
        (blank, "object_identity_incomplete", "a required part of the key is empty"),
        (_distinct_from("p.source_kind", "d.source_kind") | _distinct_from("p.database", "d.database"), "object_source_scope_mismatch", "the key is of another source or database"),
    ).distinct()


def identity(c: Canonical) -> DataFrame:
    """V4: a routine may have any sub-object, other objects without an owner none; owned ones are named with their owner's name and their own."""
    r = registered(c).join(c.databases.select("snapshot_key", "connection_alias"), "snapshot_key")
    owned = F.col("list").isin(*OWNED)
    want, sub = F.when(owned, F.col("owner.object_name")).otherwise(F.col("name")), F.when(owned, F.col("name")).when(F.col("list") == "routines", F.col("p.sub_object"))
    is_list = lambda n: F.col("list") == n
    temporary = c.tables.where("kind = 'temporary'").select("snapshot_key", "key", parse_key(F.col("key")).alias("p"))
    return _codes(
        r,
        (_distinct_from("p.connection_alias", "connection_alias"), "connection_alias_mismatch", "the key's alias isn't the snapshot's"),
        (~F.col("p.object_name").eqNullSafe(want) | ~F.col("p.sub_object").eqNullSafe(sub), "object_identity_mismatch", "the key doesn't name the object"),
        (is_list("databases") & _distinct_from("p.database", "name"), "database_identity_mismatch", "the key's database isn't the name"),
        (is_list("schemas") & _distinct_from("p.schema", "name"), "schema_identity_mismatch", "the key's schema isn't the name"),
    ).unionByName(_out(temporary.where("coalesce(p.schema, '') = ''"), "invalid_table_scope", "a temporary table needs a schema"))


def _large(column: str, code: str) -> tuple[Column, str, str]:
    return F.octet_length(column) > MAX_TEXT, code, "the text is over the size limit"


def columns(c: Canonical) -> DataFrame:
    """V5."""
    again = c.columns.groupBy("snapshot_key", "table_key", "ordinal_position").agg(F.array_sort(F.collect_list("key")).alias("keys")).where("size(keys) > 1")
    again = again.select("snapshot_key", F.explode(F.slice("keys", 2, 1 << 30)).alias("key"))
    return _codes(c.columns, (F.col("ordinal_position") == 0, "invalid_column_ordinal", "ordinals start at 1"), _large("default_value", "column_default_too_large")).unionByName(_out(again, "duplicate_column_ordinal", "two columns of a table share an ordinal"))


def _repeats(column: str, code: str) -> tuple[Column, str, str]:
    return F.size(F.array_distinct(column)) < F.size(column), code, f"{column} names the same thing twice"


def constraints(c: Canonical) -> DataFrame:
    """V6."""
    key_kind, n, m = F.col("kind").isin("primary_key", "unique"), F.size("columns"), F.size("referenced_columns")
    return _codes(
        c.constraints,
        _repeats("columns", "duplicate_constraint_column"),
        _repeats("referenced_columns", "duplicate_constraint_reference_column"),
        _large("expression", "constraint_expression_too_large"),
        (key_kind & (n == 0), "constraint_columns_missing", "a key has no columns"),
        (key_kind & (F.col("referenced_table_key").isNotNull() | (m > 0)), "unexpected_constraint_reference", "only foreign keys refer to others"),
        ((F.col("kind") == "check") & _blank(F.col("expression")), "check_expression_missing", "a check has no expression"),
    )


def foreign_keys(c: Canonical) -> DataFrame:
    """V7."""
    return _codes(
        c.constraints.where("kind = 'foreign_key'"),
        (F.size("columns") == 0, "foreign_key_columns_missing", "a foreign key has no columns"),
        (F.col("referenced_table_key").isNull(), "foreign_key_target_missing", "a foreign key has no target"),
        (F.size("columns") != F.size("referenced_columns"), "foreign_key_cardinality_mismatch", "both sides must have as many columns"),
    )


def indexes(c: Canonical) -> DataFrame:
    """V8."""
    missing = (F.size("columns") == 0) & _blank(F.col("expression"))
    return _codes(c.indexes, _repeats("columns", "duplicate_index_column"), (missing, "index_definition_missing", "an index has neither columns nor an expression"), _large("predicate", "index_predicate_too_large"), _large("expression", "index_expression_too_large"))


def programs(c: Canonical) -> DataFrame:
    """V9."""
    views = _codes(c.views, _repeats("depends_on", "duplicate_view_dependency"), _large("definition", "view_definition_too_large"))
    triggers = _codes(c.triggers, (F.coalesce(F.size("events"), F.lit(0)) == 0, "trigger_events_missing", "a trigger needs an event"), _repeats("events", "duplicate_trigger_event"), _large("definition", "trigger_definition_too_large"))
    return views.unionByName(triggers).unionByName(_codes(c.routines, _repeats("depends_on", "duplicate_routine_dependency"), _large("definition", "routine_definition_too_large")))


def references(c: Canonical) -> DataFrame:
    """Targets exist and are of the right kind, children share their parent's scope, columns are of the table they're named with. One left join of all references with the registry finds the first two; a column whose key goes on from its table's needs no parsing."""
    one = lambda df, target, kinds: df.select("snapshot_key", F.col("key").alias("owner"), F.col(target).alias("target"), F.lit(kinds).alias("kinds"))
    many = lambda df, target, kinds: df.select("snapshot_key", F.col("key").alias("owner"), F.explode(target).alias("target"), F.lit(kinds).alias("kinds"))
    fk = c.constraints.where("kind = 'foreign_key' and referenced_table_key is not null")
    refs = [one(c.schemas, "database_key", "database"), one(c.tables, "schema_key", "schema"), one(c.views, "schema_key", "schema"), one(c.routines, "schema_key", "schema"), one(c.triggers, "table_key", "table view"), one(c.triggers.where("executes_routine_key is not null"), "executes_routine_key", "routine"), one(fk, "referenced_table_key", "table")]
    refs += [one(c.t[n], "table_key", "table") for n in ("columns", "constraints", "indexes")]
    refs += [many(c.constraints, "columns", "column"), many(c.indexes, "columns", "column"), many(fk, "referenced_columns", "column"), many(c.views, "depends_on", ""), many(c.routines, "depends_on", "")]
    have = registered(c).select("snapshot_key", F.col("key").alias("target"), F.col("p.object_kind").alias("have")).distinct()
    met = reduce(DataFrame.unionByName, refs).join(have, ["snapshot_key", "target"], "left")
    held = _codes(
        met,
        (F.col("have").isNull(), "relationship_target_missing", "the snapshot lacks a target"),
        ((F.col("kinds") != "") & ~F.array_contains(F.split("kinds", " "), F.col("have")), "relationship_target_kind_mismatch", "a target is of another kind"),
        key="owner",
    )
    child = registered(c).where(F.col("list").isin(*OWNED))
    apart = _out(child.where("p.database is distinct from owner.database or p.schema is distinct from owner.schema"), "object_scope_mismatch", "child and parent are of different scopes")
    member = [c.t[n].select("snapshot_key", "key", F.explode("columns").alias("column"), "table_key") for n in ("constraints", "indexes")]
    member.append(fk.select("snapshot_key", "key", F.explode("referenced_columns").alias("column"), F.col("referenced_table_key").alias("table_key")))
    start = F.concat(F.replace(F.col("table_key"), F.lit(":table:"), F.lit(":column:")), F.lit(":"))
    rest = F.substr(F.col("column"), F.length(start) + 1)
    plain = F.startswith(F.col("column"), start) & (F.length(rest) > 0) & (F.instr(rest, ":") == 0)
    odd = reduce(DataFrame.unionByName, member).where(~F.coalesce(plain, F.lit(False)))
    other = " or ".join(f"column_p.{x} is distinct from table_key_p.{x}" for x in ("database", "schema", "object_name"))
    return reduce(DataFrame.unionByName, [held, apart, _out(_parsed(odd, "column", "table_key").where(other), "column_owner_mismatch", "a column is of another table")])


def _bad_extension(c: Column) -> Column:
    return _blank(c) | (F.octet_length(c) > MAX_PROPERTY_NAME) | c.rlike(r"\p{Cntrl}")


def metadata_objects(c: Canonical) -> DataFrame:
    """V11."""
    m = _parsed(c.metadata_objects, "key").join(c.databases.select("snapshot_key", "connection_alias", parse_key(F.col("key")).alias("d")), "snapshot_key")
    every = registered(c, metadata=True)
    twice = every.groupBy("snapshot_key", "key").agg(F.count("*").alias("n"), F.count_if(F.col("expected").isNull()).alias("m")).where("n > 1 and m > 0")
    orphans = c.metadata_objects.where("parent_key is not null").join(every.select("snapshot_key", F.col("key").alias("parent_key")), ["snapshot_key", "parent_key"], "left_anti")
    extension, kind = F.col("key_p.object_kind") == "extension", F.col("extension_kind")
    out = [
        _out(twice, "duplicate_object_key", "a key stands for more than one object"),
        _out(orphans, "metadata_parent_missing", "the snapshot lacks the parent"),
        _out(m.where(~F.coalesce(F.col("key_p.object_kind").isin(*METADATA_KINDS), F.lit(False))), "metadata_object_kind_invalid", "such objects have a typed table"),
        _out(m.where("key_p.source_kind is distinct from d.source_kind or key_p.connection_alias is distinct from connection_alias"), "metadata_source_mismatch", "the key is of another source or alias"),
        _out(m.where("key_p.database is distinct from d.database"), "metadata_database_mismatch", "the key is of another database"),
        _out(m.where(_blank(F.col("name"))), "metadata_name_missing", "a metadata object needs a name"),
        _out(m.where(extension & _bad_extension(kind)), "extension_kind_invalid", "an extension needs a short kind without controls"),
        _out(m.where(~extension & kind.isNotNull()), "extension_kind_unexpected", "only extensions have an extension kind"),
    ]
    return reduce(DataFrame.unionByName, out)


def parents(c: Canonical) -> DataFrame:
    """V12; the matrix of parents is a literal."""
    have = registered(c, metadata=True).select("snapshot_key", F.col("key").alias("parent_key"), F.col("p").alias("parent_p")).dropDuplicates(["snapshot_key", "parent_key"])
    m = _parsed(c.metadata_objects.where("parent_key is not null"), "key").join(have, ["snapshot_key", "parent_key"])
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in PARENTS.items() for x in kv]), F.col("key_p.object_kind"))
    wrong = m.where(allowed.isNotNull() & ~F.array_contains(F.split(allowed, " "), F.col("parent_p.object_kind")))
    apart = m.where(" or ".join(f"key_p.{x} is distinct from parent_p.{x}" for x in ("source_kind", "connection_alias", "database")))
    return _out(wrong, "metadata_parent_kind_mismatch", "the parent's kind isn't allowed").unionByName(_out(apart, "metadata_parent_scope_mismatch", "object and parent are of different scopes"))


def annotations(c: Canonical) -> DataFrame:
    """V13."""
    twice = c.annotations.groupBy("snapshot_key", "object_key").agg(F.count("*").alias("n")).where("n > 1").select("snapshot_key", "object_key", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    empty = c.annotations.where(F.col("definition").isNull() & (F.coalesce(F.size("properties"), F.lit(0)) == 0))
    lost = c.annotations.join(registered(c, metadata=True).select("snapshot_key", F.col("key").alias("object_key")), ["snapshot_key", "object_key"], "left_anti")
    return _out(twice, "duplicate_object_annotation", "an object may have one annotation", "object_key").unionByName(_out(empty, "empty_object_annotation", "an annotation says nothing", "object_key")).unionByName(_out(lost, "relationship_target_missing", "the snapshot lacks a target", "object_key"))


def relationships(c: Canonical) -> DataFrame:
    """V14; the matrix of endpoints is a literal."""
    subject = F.concat(rel_edge_type(F.col("kind"), F.col("extension_name")), F.lit(":"), F.col("from_key"), F.lit("->"), F.col("to_key"))
    r = c.relationships.withColumn("key", subject)
    have = registered(c, metadata=True).select("snapshot_key", "key", F.col("p.object_kind").alias("k")).dropDuplicates(["snapshot_key", "key"])
    end = lambda which: have.select("snapshot_key", F.col("key").alias(f"{which}_key"), F.col("k").alias(f"{which}_kind"))
    met = r.join(end("from"), ["snapshot_key", "from_key"], "left").join(end("to"), ["snapshot_key", "to_key"], "left")
    held = lambda c_, kinds: F.lit(True) if kinds == "*" else c_.isin(*kinds.split())
    good = F.lit(True)
    for kind, pairs in ENDPOINTS.items():
        sides = [p.split(" > ") for p in pairs]
        good = F.when(F.col("kind") == kind, reduce(lambda a, b: a | b, [held(F.col("from_kind"), a) & held(F.col("to_kind"), b) for a, b in sides])).otherwise(good)
    again = r.groupBy("snapshot_key", "key", "kind", "extension_name", "from_key", "to_key", "ordinal").agg(F.count("*").alias("n")).where("n > 1").select("snapshot_key", "key", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    out = [
        _out(r.where("ordinal = 0"), "relationship_ordinal_invalid", "ordinals start at 1"),
        _out(r.where((F.col("kind") == "extension") & _bad_extension(F.col("extension_name"))), "extension_relationship_invalid", "an extension needs a short name without controls"),
        _out(again, "duplicate_metadata_relationship", "a relationship is repeated"),
        _out(met.where("from_kind is not null and to_kind is not null").where(~good), "metadata_relationship_kind_mismatch", "the ends' kinds aren't allowed"),
        _out(met.where("from_kind is null"), "relationship_target_missing", "the snapshot lacks a target"),
        _out(met.where("to_kind is null"), "relationship_target_missing", "the snapshot lacks a target"),
    ]
    return reduce(DataFrame.unionByName, out)


def sizes(c: Canonical) -> DataFrame:
    """Definitions and properties of metadata objects, annotations and relationships."""
    subject = F.concat(rel_edge_type(F.col("kind"), F.col("extension_name")), F.lit(":"), F.col("from_key"), F.lit("->"), F.col("to_key"))
    none = F.lit(None).cast("string").alias("definition")
    rows = c.metadata_objects.select("snapshot_key", "key", "definition", "properties").unionByName(c.annotations.select("snapshot_key", F.col("object_key").alias("key"), "definition", "properties")).unionByName(c.relationships.select("snapshot_key", subject.alias("key"), none, "properties"))
    entries = F.map_entries("properties")
    items = lambda e: F.from_json(e.value.value, "array<string>")
    long_list = lambda e: (e.value.type == "string_list") & ((F.size(items(e)) > MAX_PROPERTY_ITEMS) | F.exists(items(e), lambda x: F.octet_length(x) > MAX_PROPERTY_TEXT))
    large = lambda e: F.coalesce(((e.value.type == "string") & (F.octet_length(e.value.value) > MAX_PROPERTY_TEXT)) | long_list(e), F.lit(False))
    return _codes(
        rows,
        _large("definition", "definition_too_large"),
        (F.size("properties") > MAX_PROPERTIES, "too_many_properties", "there are too many properties"),
        (F.exists(F.map_keys("properties"), _bad_extension), "property_name_invalid", "a property's name is empty, long or has controls"),
        (F.exists(entries, large), "property_value_too_large", "a property is over the size limit"),
    )


RULES = {"v1": header, "v2": registration, "v3": scope, "v4": identity, "v5": columns, "v6": constraints, "v7": foreign_keys, "v8": indexes, "v9": programs, "v10": references, "v11": metadata_objects, "v12": parents, "v13": annotations, "v14": relationships, "v15": sizes}


#: Rules whose issues one job writes; each group reads the same tables.
GROUPS = [["v1", "v5", "v6", "v7", "v8", "v9"], ["v2", "v3", "v4"], ["v10"], ["v11", "v12"], ["v13", "v14", "v15"]]


def validate(c: Canonical) -> DataFrame:
    """All issues of all snapshots. Keys are parsed once, into a written registry; the rules' issues are written by groups, as jobs at the same time, so that no plan holds all of them."""
    c = c.with_tables(registry=written(registry(c), "registry"))
    issues = written_all({f"issues_{k}": reduce(DataFrame.unionByName, [RULES[n](c) for n in group]) for k, group in enumerate(GROUPS)})
    return reduce(DataFrame.unionByName, issues.values())
