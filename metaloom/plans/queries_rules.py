"""Registered queries over the validation codes that the first set of mutations doesn't bring about: one mutation for each, by a number in the key, and no code left out of any result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import validate as V
from .fleet import catalog
from .model import MAX_TEXT, Canonical
from .oracles import over_fleet
from .queries_graph import _n, _sub

Q: dict = {}
SQL: dict = {}
_LONG = MAX_TEXT + 1


def _long() -> Column:
    return F.repeat(F.lit("x"), F.lit(_LONG))


def _swap(c: str, cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.col(c))


def _broken(s, d) -> Canonical:
    c = catalog(s, d)
    none, k = F.array().cast("array<string>"), _n("key")
    twice = lambda x: F.concat(x, x)
    kind = lambda x: F.col("kind") == x
    schema = F.split("key", ":")[3]
    blank = F.concat(F.regexp_extract("key", "^(.*:)[^:]*$", 1), F.lit(" "))
    t = c.tables
    tables = t.withColumn("key", F.when(k % 107 == 0, blank).when(k % 109 == 0, F.replace("key", F.concat(F.lit(":"), schema, F.lit(":")), F.lit("::"))).otherwise(F.col("key"))).withColumn("kind", _swap("kind", k % 109 == 0, F.lit("temporary")))
    key = c.constraints
    key = key.withColumn("columns", F.when(kind("primary_key") & (k % 71 == 0), twice(F.col("columns"))).when(kind("foreign_key") & (k % 61 == 0), none).otherwise(F.col("columns")))
    key = key.withColumn("referenced_columns", F.when(kind("foreign_key") & (k % 73 == 0), twice(F.col("referenced_columns"))).when(kind("foreign_key") & (k % 67 == 0), none).otherwise(F.col("referenced_columns")))
    key = key.withColumn("referenced_table_key", _swap("referenced_table_key", kind("primary_key") & (k % 79 == 0), F.col("table_key"))).withColumn("expression", _swap("expression", kind("check") & (k % 3 == 0), _long()))
    return c.with_tables(
        databases=c.databases.withColumn("source_kind", _swap("source_kind", F.col("connection_alias") == "ASIA", F.lit(" "))).withColumn("name", _swap("name", F.col("connection_alias") == "EUROPE", F.lit("x"))),
        schemas=c.schemas.withColumn("name", _swap("name", F.regexp_extract("name", "([0-9]+)$", 1).cast("int") % 5 == 0, F.lit("x"))),
        tables=tables,
        columns=c.columns.withColumn("default_value", _swap("default_value", _sub("key") % 997 == 0, _long())),
        constraints=key,
        indexes=c.indexes.withColumn("columns", _swap("columns", k % 59 == 0, twice(F.col("columns")))).withColumn("predicate", _swap("predicate", k % 53 == 0, _long())).withColumn("expression", _swap("expression", k % 47 == 0, _long())),
        views=c.views.withColumn("definition", _swap("definition", k % 3 == 0, _long())),
        routines=c.routines.withColumn("depends_on", _swap("depends_on", k % 5 == 0, twice(F.col("depends_on")))).withColumn("definition", _swap("definition", k % 7 == 0, _long())),
        triggers=c.triggers.withColumn("events", _swap("events", k % 11 == 0, twice(F.col("events")))).withColumn("definition", _swap("definition", k % 13 == 0, _long())),
    )


def _rule(name: str, rule, sql: str, *ctes: str, of=_broken):
    Q[name] = lambda s, d: rule(of(s, d)).select("snapshot_key", "code", "object_key")
    SQL[name] = over_fleet(sql, *ctes)


def _rows(*of: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT sk AS snapshot_key, '{code}' AS code, {key} AS object_key FROM {rest}" for code, key, rest in of)


_KEYS = "keys AS (SELECT *, CASE WHEN ck % 107 = 0 THEN pre || 'table: ' WHEN ck % 109 = 0 THEN replace(tkey, ':' || nn || ':', '::') ELSE tkey END AS k FROM cust)"
_rule("v1_source", V.header, _rows(("snapshot_source_missing", "dkey", "db WHERE sk = 'tpch:ASIA'"), ("capability_source_mismatch", "dkey", "db WHERE sk = 'tpch:ASIA'")))
_rule("v3_incomplete", V.scope, "SELECT DISTINCT * FROM (" + _rows(*[(code, "k", "keys WHERE ck % 107 = 0") for code in ("object_identity_incomplete",)], *[(code, "k", "keys WHERE ck % 109 = 0 AND ck % 107 <> 0") for code in ("connection_alias_mismatch", "object_identity_incomplete", "object_source_scope_mismatch")]) + ")", _KEYS)
_rule(
    "v4_names",
    V.identity,
    _rows(("object_identity_mismatch", "k", "keys WHERE ck % 107 = 0 OR ck % 109 = 0"), ("connection_alias_mismatch", "k", "keys WHERE ck % 109 = 0 AND ck % 107 <> 0"), ("invalid_table_scope", "k", "keys WHERE ck % 109 = 0 AND ck % 107 <> 0"), ("object_identity_mismatch", "dkey", "db WHERE sk = 'tpch:EUROPE'"), ("database_identity_mismatch", "dkey", "db WHERE sk = 'tpch:EUROPE'"), ("object_identity_mismatch", "skey", "nat WHERE nk % 5 = 0"), ("schema_identity_mismatch", "skey", "nat WHERE nk % 5 = 0")),
    _KEYS,
)
_rule("v5_defaults", V.columns, _rows(("column_default_too_large", "ckey", "col WHERE ok % 997 = 0")))
_OF = lambda kind, m: f"con WHERE kind = '{kind}' AND ck % {m} = 0"
_rule("v6_lists", V.constraints, _rows(("duplicate_constraint_column", "key", _OF("primary_key", 71)), ("duplicate_constraint_reference_column", "key", _OF("foreign_key", 73)), ("unexpected_constraint_reference", "key", _OF("primary_key", 79)), ("constraint_expression_too_large", "key", _OF("check", 3))))
_rule("v7_pairs", V.foreign_keys, _rows(("foreign_key_columns_missing", "key", _OF("foreign_key", 61)), ("foreign_key_cardinality_mismatch", "key", "con WHERE kind = 'foreign_key' AND ((ck % 61 = 0) <> (ck % 67 = 0 AND ck % 73 <> 0) OR (ck % 73 = 0))")))
_rule("v8_texts", V.indexes, _rows(("duplicate_index_column", "key", "ix WHERE ck % 59 = 0"), ("index_predicate_too_large", "key", "ix WHERE ck % 53 = 0"), ("index_expression_too_large", "key", "ix WHERE ck % 47 = 0")))
_rule("v9_bodies", V.programs, _rows(("view_definition_too_large", "key", "vw WHERE vk % 3 = 0"), ("duplicate_routine_dependency", "key", "rt WHERE pk % 5 = 0 AND key IN (SELECT key FROM rdep)"), ("routine_definition_too_large", "key", "rt WHERE pk % 7 = 0"), ("duplicate_trigger_event", "key", "tr WHERE ck % 11 = 0"), ("trigger_definition_too_large", "key", "tr WHERE ck % 13 = 0")))


def _misplaced(s, d) -> Canonical:
    """Indexes of one table in 43 say that they are of a schema, triggers of one in 17 are in a schema of their own."""
    c, k = catalog(s, d), _n("key")
    schema = F.regexp_replace("table_key", "^(.*:)([^:]*):table:.*$", "$1$2:schema:$2")
    moved = F.regexp_replace("key", ":[^:]*:trigger:", ":zz:trigger:")
    return c.with_tables(indexes=c.indexes.withColumn("table_key", _swap("table_key", k % 43 == 0, schema)), triggers=c.triggers.withColumn("key", _swap("key", k % 17 == 0, moved)))


_rule("v10_kinds_and_owners", V.references, _rows(("relationship_target_kind_mismatch", "key", "ix WHERE ck % 43 = 0"), ("column_owner_mismatch", "key", "ix_col WHERE ck % 43 = 0"), ("object_scope_mismatch", "regexp_replace(key, ':[^:]*:trigger:', ':zz:trigger:')", "tr WHERE ck % 17 = 0")), of=_misplaced)

# Sequences: part p of size 3 or 4 stands for one in its nation, and for each the first number that divides p says what is wrong with it.
_MODULI = [13, 17, 19, 23, 29]
_WRONG = "CASE " + " ".join(f"WHEN p_partkey % {m} = 0 THEN {m}" for m in _MODULI) + " ELSE 0 END"
_SEQ = f"seq AS (SELECT p_partkey AS q, {_WRONG} AS m, nk, sk, pre, skey, pre || 'sequence:q' || p_partkey AS plain, CASE m WHEN 13 THEN pre || 'table:q' || p_partkey WHEN 17 THEN 'other:' || (pre || 'sequence:q' || p_partkey)[6:] WHEN 19 THEN replace(pre, ':w:', ':ww:') || 'sequence:q' || p_partkey WHEN 23 THEN pre || 'extension:q' || p_partkey ELSE pre || 'sequence:q' || p_partkey END AS key FROM part JOIN nat ON p_partkey % 25 = nk WHERE p_size IN (3, 4))"
_ONE = "one AS (SELECT sk, min(ckey) AS c FROM col WHERE pos = 1 GROUP BY sk)"


def _objects(s, d) -> Canonical:
    c = catalog(s, d)
    part = s.read.parquet(f"{d}/part.parquet").where("p_size in (3, 4)").select(F.col("p_partkey").alias("q"), F.expr(_WRONG).alias("m"), F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("name"))
    schemas = c.schemas.select("snapshot_key", F.col("key").alias("schema_key"), "name")
    of = part.join(schemas, "name").withColumn("pre", F.regexp_extract("schema_key", "^(.*:)schema:", 1)).withColumn("number", F.concat(F.lit("q"), F.col("q").cast("string")))
    key = F.concat("pre", F.when(F.col("m") == 13, "table:").when(F.col("m") == 23, "extension:").otherwise("sequence:"), "number")
    key = F.when(F.col("m") == 17, F.regexp_replace(key, "^tpch:", "other:")).when(F.col("m") == 19, F.replace(key, F.lit(":w:"), F.lit(":ww:"))).otherwise(key)
    q = F.col("q")
    prop = lambda v: F.struct(F.lit("string").alias("type"), v.alias("value"))
    few = F.create_map(F.lit("p"), prop(F.when(q % 5 == 0, F.repeat(F.lit("y"), F.lit(65_537))).otherwise("v")))
    many = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(257)), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("key"), prop(F.lit("v")).alias("value"))))
    objects = of.select("snapshot_key", key.alias("key"), F.when(F.col("m") == 29, F.concat("schema_key", F.lit("x"))).otherwise(F.col("schema_key")).alias("parent_key"), F.col("number").alias("name"), F.when(F.col("m") == 23, " ").alias("extension_kind"), F.when(q % 11 == 0, _long()).alias("definition"), F.when(q % 7 == 0, many).otherwise(few).alias("properties"))
    first = c.columns.where("ordinal_position = 1").groupBy("snapshot_key").agg(F.min("key").alias("from_key"))
    plain = F.concat("pre", F.lit("sequence:"), "number")
    links = of.where("m = 0").join(first, "snapshot_key").select("snapshot_key", F.when(q % 31 == 0, "extension").otherwise("uses_sequence").alias("kind"), F.when(q % 31 == 0, " ").alias("extension_name"), "from_key", plain.alias("to_key"), F.lit(1).alias("ordinal"), F.explode(F.when(q % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
    return Canonical.of(s, **{k: v for k, v in c.t.items() if k not in ("metadata_objects", "annotations", "relationships")}, metadata_objects=objects, relationships=links)


_M = lambda code, m: (code, "key", f"seq WHERE m = {m}")
_rule("v11_keys_and_parents", V.metadata_objects, _rows(_M("metadata_object_kind_invalid", 13), _M("metadata_source_mismatch", 17), _M("metadata_database_mismatch", 19), _M("extension_kind_invalid", 23), _M("metadata_parent_missing", 29)), _SEQ, of=_objects)
_rule("v12_scopes", V.parents, _rows(_M("metadata_parent_scope_mismatch", 17), _M("metadata_parent_scope_mismatch", 19)), _SEQ, of=_objects)
_LINK = "CASE WHEN q % 31 = 0 THEN 'EXTENSION: ' ELSE 'USES_SEQUENCE' END || ':' || c || '->' || plain"
_rule("v14_repeats_and_extensions", V.relationships, f"SELECT sk AS snapshot_key, 'duplicate_metadata_relationship' AS code, {_LINK} AS object_key FROM seq JOIN one USING (sk) WHERE m = 0 AND q % 6 = 0 UNION ALL SELECT sk, 'extension_relationship_invalid', {_LINK} FROM seq JOIN one USING (sk), range(1, 3) r(i) WHERE m = 0 AND q % 31 = 0 AND (i = 1 OR q % 6 = 0)", _SEQ, _ONE, of=_objects)
_rule("v15_values", V.sizes, _rows(("property_value_too_large", "key", "seq WHERE q % 5 = 0 AND q % 7 <> 0"), ("too_many_properties", "key", "seq WHERE q % 7 = 0"), ("definition_too_large", "key", "seq WHERE q % 11 = 0")), _SEQ, of=_objects)
