"""Registered queries over mapping, validation, certification and projection, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import certify as C
from ..operators import mapping as M
from ..operators import postgres as PG
from ..operators import project as P
from ..operators import validate as V
from ..operators.discover import discovered
from ..plans.model import OBJECT_CATEGORIES, RELATION_CATEGORIES, Canonical
from .fleet import catalog, graph
from .oracles import over_fleet

Q: dict = {}
SQL: dict = {}


def _n(col: str):
    """The number at the end of a key's object name."""
    return F.regexp_extract(F.split(F.col(col), ":")[5], "([0-9]+)$", 1).try_cast("long")


def _sub(col: str):
    return F.regexp_extract(col, "([0-9]+)$", 1).try_cast("long")


def _extract(spark, sf):
    return M.as_information_schema(catalog(spark, sf))


# Mapping


def _mapped(name: str, f, sql: str):
    Q[name], SQL[name] = f, over_fleet(sql)


join = lambda c: F.array_join(c, "|")
_mapped("b1_map_schemas", lambda s, d: M.map_schemas(_extract(s, d)).select("snapshot_key", "key", "database_key", "name"), "SELECT nat.sk AS snapshot_key, skey AS key, dkey AS database_key, nn AS name FROM nat JOIN db USING (sk) WHERE nk IN (SELECT nk FROM cust UNION SELECT nk FROM vw)")
_mapped("b2_map_tables", lambda s, d: M.map_tables(_extract(s, d)).select("snapshot_key", "key", "schema_key", "name", "kind"), "SELECT sk AS snapshot_key, tkey AS key, skey AS schema_key, 'c' || ck AS name, 'base_table' AS kind FROM cust")
_mapped("b3_map_columns", lambda s, d: M.map_columns(_extract(s, d)).select("key", "table_key", "ordinal_position", "data_type", "is_nullable", "is_generated"), "SELECT ckey AS key, tkey AS table_key, pos::INTEGER AS ordinal_position, prio AS data_type, st <> 'F' AS is_nullable, st = 'P' AS is_generated FROM col")
_mapped("b4_map_constraints", lambda s, d: M.map_constraints(_extract(s, d)).select("key", "table_key", "kind", join("columns").alias("columns"), "referenced_table_key", join("referenced_columns").alias("referenced_columns"), "expression"), "SELECT con.key, con.tkey AS table_key, con.kind, cs AS columns, CASE WHEN con.kind = 'foreign_key' THEN next_t END AS referenced_table_key, CASE WHEN con.kind = 'foreign_key' THEN next_c ELSE '' END AS referenced_columns, CASE WHEN con.kind = 'check' THEN 'o_totalprice > 0' END AS expression FROM con JOIN chain USING (ck) JOIN (SELECT key, string_agg(ckey, '|' ORDER BY pos) AS cs FROM con_col GROUP BY key) USING (key)")
_mapped("b5_map_indexes", lambda s, d: M.map_indexes(_extract(s, d)).select("key", "table_key", "name", join("columns").alias("columns"), "is_unique", "is_primary"), "SELECT key, tkey AS table_key, 'ix_' || prio AS name, string_agg(ckey, '|' ORDER BY pos) AS columns, count(*) = 1 AS is_unique, false AS is_primary FROM ix_col GROUP BY ALL")


def _shifted(s, d):
    x = _extract(s, d)
    hit = _sub("COLUMN_NAME") % 501 == 0
    return x | {"columns": x["columns"].withColumn("ORDINAL_POSITION", F.col("ORDINAL_POSITION") + F.when(hit, 100).otherwise(0)), "statistics": x["statistics"].withColumn("NON_UNIQUE", F.when(_sub("COLUMN_NAME") % 11 == 0, 1 - F.col("NON_UNIQUE")).otherwise(F.col("NON_UNIQUE")))}


_mapped("b5_index_part_issues", lambda s, d: M.index_part_issues(_shifted(s, d)).select("code", "object_key"), "SELECT 'index_parts_inconsistent' AS code, key AS object_key FROM (SELECT ix_col.key, ix.n, count(*) FILTER (ok % 11 = 0) AS hit FROM ix_col JOIN ix USING (key) JOIN col USING (ckey) GROUP BY ALL) WHERE hit > 0 AND hit < n")
_mapped("b7_ordinal_issues", lambda s, d: M.ordinal_issues(_shifted(s, d)).select("snapshot_key", "code", "object_key"), "SELECT DISTINCT sk AS snapshot_key, 'ordinals_not_contiguous' AS code, nn || '.c' || ck AS object_key FROM col WHERE ok % 501 = 0")
_mapped("b8_map_views", lambda s, d: M.map_views(_extract(s, d)).select("key", "schema_key", join("depends_on").alias("depends_on")), "SELECT vw.key, skey AS schema_key, coalesce(string_agg(dep, '|' ORDER BY dep), '') AS depends_on FROM vw LEFT JOIN vdep USING (key) GROUP BY ALL")


def _lost(s, d):
    x = _extract(s, d)
    return x | {"tables": x["tables"].where((F.col("TABLE_TYPE") == "VIEW") | (F.regexp_extract("TABLE_NAME", "([0-9]+)$", 1).try_cast("long") % 211 != 0))}


_mapped("b8_out_of_scope", lambda s, d: M.out_of_scope(_lost(s, d)).groupBy("code", "object_key").agg(F.count("*").alias("n")), "SELECT 'dependency_out_of_scope' AS code, vdep.key AS object_key, count(*) AS n FROM vdep JOIN cust ON dep = tkey WHERE ck % 211 = 0 GROUP BY ALL")
_mapped("b11_map_triggers", lambda s, d: M.map_triggers(_extract(s, d)).select("key", "table_key", "timing", join("events").alias("events"), "executes_routine_key"), "SELECT key, tkey AS table_key, 'AFTER' AS timing, (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events WHERE user_id = ck) AS events, rkey AS executes_routine_key FROM tr")
_mapped("b12_map_routines", lambda s, d: M.map_routines(_extract(s, d)).select("key", "schema_key", "kind", join("depends_on").alias("depends_on")), "SELECT rt.key, skey AS schema_key, CASE WHEN pk % 2 = 0 THEN 'function' ELSE 'procedure' END AS kind, coalesce(string_agg(dep, '|' ORDER BY dep), '') AS depends_on FROM rt LEFT JOIN rdep USING (key) GROUP BY ALL")


def b25_merge_properties(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_type")
    a, b = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), F.create_map(F.lit("type"), F.when(F.col("p_partkey") % 7 == 0, F.lit("other")).otherwise(F.col("p_type")), F.lit("id"), F.col("p_partkey").cast("string"))
    merged, conflict = M.merge_properties(a, b)
    return p.select("p_partkey", F.to_json(F.sort_array(F.map_entries(merged))).alias("merged"), conflict.alias("conflict"))


Q["b25_merge_properties"] = b25_merge_properties
SQL["b25_merge_properties"] = """SELECT p_partkey, '[{"key":"brand","value":"' || p_brand || '"},{"key":"id","value":"' || p_partkey || '"},{"key":"type","value":"' || p_type || '"}]' AS merged, p_partkey % 7 = 0 AS conflict FROM part"""


def _relations(s, d):
    g = graph(s, d)
    r = g.edges.where("edge_type = 'COLUMN_IN_INDEX'").select("snapshot_key", F.lit("depends_on").alias("kind"), F.col("edge_from").alias("from_key"), F.col("edge_to").alias("to_key"), F.lit(None).cast("int").alias("ordinal"))
    return r.unionByName(r.where(_sub("from_key") % 13 == 0))


_mapped("b26_unique_relationships", lambda s, d: M.unique_relationships(_relations(s, d), "mysql")[1].select("code", "object_key"), "SELECT 'duplicate_relationship' AS code, 'depends_on:' || ix_col.ckey || '->' || key AS object_key FROM ix_col JOIN col USING (ckey) WHERE ok % 13 = 0")


def _untidy(c: Canonical) -> Canonical:
    twice = lambda x: F.concat(F.reverse(x), x)
    return c.with_tables(views=c.views.withColumn("depends_on", twice("depends_on")), triggers=c.triggers.withColumn("events", twice("events")))


_mapped("b27_normalise", lambda s, d: (lambda c: c.views.select("key", join("depends_on").alias("items")).unionByName(c.triggers.select("key", join("events").alias("items"))))(M.normalise(_untidy(catalog(s, d)))), "SELECT vw.key, coalesce(string_agg(dep, '|' ORDER BY dep), '') AS items FROM vw LEFT JOIN vdep USING (key) GROUP BY ALL UNION ALL SELECT key, (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events WHERE user_id = ck) FROM tr")
_mapped("b28_unstable", lambda s, d: M.unstable(_extract(s, d), _shifted(s, d)), "SELECT sk AS snapshot_key, 'columns' AS table_name, 2 * count(*) AS rows FROM col WHERE ok % 501 = 0 GROUP BY ALL UNION ALL SELECT sk, 'statistics', 2 * count(*) FROM col WHERE ok % 11 = 0 GROUP BY ALL")
_mapped("b29_open_dependencies", lambda s, d: M.open_dependencies({}, catalog(s, d), "mysql").select("code", "object_key"), "SELECT 'dependency_closure_unproven' AS code, key AS object_key FROM rt UNION ALL SELECT 'dependency_closure_unproven', key FROM tr")


def _large(s, d):
    x = _extract(s, d)
    hit = F.regexp_extract("ROUTINE_NAME", "([0-9]+)$", 1).try_cast("long") % 29 == 0
    return x | {"routines": x["routines"].withColumn("ROUTINE_DEFINITION", F.when(hit, F.repeat(F.lit("x"), F.lit(1_048_577))))}


_mapped("b31_large_texts", lambda s, d: M.large_texts(_large(s, d)).select("snapshot_key", "code", "object_key"), "SELECT rt.sk AS snapshot_key, 'metadata_text_too_large' AS code, nn || '.p' || pk AS object_key FROM rt JOIN nat USING (nk) WHERE pk % 29 = 0")
_mapped("b32_inventory_issues", lambda s, d: M.inventory_issues(_lost(s, d)).groupBy("code", "object_key").agg(F.count("*").alias("n")), "SELECT 'table_missing' AS code, nn || '.c' || ck AS object_key, 4 AS n FROM cust WHERE ck % 211 = 0 AND ck IN (SELECT ck FROM col)")


def _odd_types(s, d):
    x = _extract(s, d)
    return x | {"tables": x["tables"].withColumn("TABLE_TYPE", F.when(F.regexp_extract("TABLE_NAME", "^c([0-9]+)$", 1).try_cast("long") % 17 == 0, "QUEUE").otherwise(F.col("TABLE_TYPE")))}


_mapped("b33_unsupported", lambda s, d: M.unsupported(_odd_types(s, d)).select("snapshot_key", "code", "object_key", "message"), "SELECT sk AS snapshot_key, 'unsupported_object' AS code, nn || '.c' || ck AS object_key, 'QUEUE' AS message FROM cust WHERE ck % 17 = 0")


# The same fleet as PostgreSQL's catalog would hold it, and what only a server's catalog has, from the fleet's own rows.


def _pg(s, d):
    return PG.as_pg_catalog(catalog(s, d))


def _programs(s, d):
    """Parameters, one for each thing that a routine uses, an event for each trigger, a sequence for each routine, and the columns of views."""
    x, c = _extract(s, d), catalog(s, d)
    at = lambda f: F.split("key", ":")[f]
    r = c.routines.select("snapshot_key", at(3).alias("SPECIFIC_SCHEMA"), F.col("name").alias("SPECIFIC_NAME"), F.posexplode("depends_on").alias("i", "dep"))
    parameters = r.select("snapshot_key", "SPECIFIC_SCHEMA", "SPECIFIC_NAME", (F.col("i") + 1).alias("ORDINAL_POSITION"), F.when(F.col("i") > 0, F.concat(F.lit("a"), F.col("i").cast("string"))).alias("PARAMETER_NAME"))
    events = c.triggers.select("snapshot_key", at(3).alias("EVENT_SCHEMA"), at(5).alias("EVENT_NAME"), F.lit("body").alias("EVENT_DEFINITION"))
    sequences = c.routines.select("snapshot_key", at(3).alias("SEQUENCE_SCHEMA"), F.col("name").alias("SEQUENCE_NAME"))
    outputs = c.views.select("snapshot_key", at(3).alias("TABLE_SCHEMA"), F.col("name").alias("TABLE_NAME"), F.posexplode("depends_on").alias("i", "dep"))
    columns = outputs.select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", F.concat(F.lit("v"), F.col("i").cast("string")).alias("COLUMN_NAME"), (F.col("i") + 1).alias("ORDINAL_POSITION"), F.lit("text").alias("COLUMN_TYPE"), F.lit("YES").alias("IS_NULLABLE"), F.lit(None).cast("string").alias("COLUMN_DEFAULT"), F.lit("").alias("EXTRA"))
    calls = c.triggers.where("executes_routine_key is not null").select("snapshot_key", F.split("executes_routine_key", ":")[3].alias("SPECIFIC_SCHEMA"), F.split("executes_routine_key", ":")[5].alias("SPECIFIC_NAME"), at(3).alias("TABLE_SCHEMA"), at(5).alias("TABLE_NAME"))
    return x | {"parameters": parameters, "events": events, "sequences": sequences, "view_routine_usage": calls, "columns": x["columns"].unionByName(columns)}


_VIEW_COLUMN = "SELECT replace(key, ':view:', ':view_column:') || ':v' || (i - 1) AS key, key AS parent_key, 'v' || (i - 1) AS name FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY dep) AS i FROM vdep)"
_PARAMETER = "SELECT 'v2:' || replace(key, ':routine:', ':routine_parameter:') || ':' || r || '%3A' || i || '%3A' || n AS key, key AS parent_key, n AS name, i FROM (SELECT key, string_split(key, ':')[6] AS r, i, CASE WHEN i = 1 THEN 'argument_1' ELSE 'a' || (i - 1) END AS n FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY dep) AS i FROM rdep))"
_kept = lambda s, d, kind: M.map_catalog(_programs(s, d)).metadata_objects.where(F.col("key").contains(f":{kind}:")).select("key", "parent_key", "name")
_mapped("b9_view_columns", lambda s, d: _kept(s, d, "view_column"), _VIEW_COLUMN)
_mapped("b13_parameters", lambda s, d: _kept(s, d, "routine_parameter"), f"SELECT key, parent_key, name FROM ({_PARAMETER})")
_mapped("b13_has_parameter", lambda s, d: M.map_catalog(_programs(s, d)).relationships.where("kind = 'has_parameter'").select("from_key", "to_key", "ordinal"), f"SELECT parent_key AS from_key, key AS to_key, i::INTEGER AS ordinal FROM ({_PARAMETER})")
_mapped("b14_sequences", lambda s, d: _kept(s, d, "sequence"), "SELECT replace(key, ':routine:', ':sequence:') AS key, skey AS parent_key, 'p' || pk AS name FROM rt")
_mapped("b20_events", lambda s, d: _kept(s, d, "event"), "SELECT replace(tkey, ':table:', ':event:') AS key, regexp_replace(tkey, '^(tpch:[^:]*:w:)([^:]*):.*', '\\1\\2:schema:\\2') AS parent_key, 'c' || ck AS name FROM tr")
_mapped("b20_invokes", lambda s, d: M.map_catalog(_programs(s, d)).relationships.where("kind = 'invokes'").select("from_key", "to_key"), "SELECT replace(tkey, ':table:', ':view:') AS from_key, rkey AS to_key FROM tr WHERE rkey IS NOT NULL")


def _as_pg(name: str, f, like: str):
    """A query over the PostgreSQL form, whose rows are those of the information_schema form's query."""
    Q[name], SQL[name] = f, SQL[like]


_as_pg("b2_pg_tables", lambda s, d: PG.map_tables(_pg(s, d)), "b2_map_tables")
_as_pg("b3_pg_columns", lambda s, d: PG.map_columns(_pg(s, d)).select("key", "table_key", "ordinal_position", "data_type", "is_nullable", "is_generated"), "b3_map_columns")
_as_pg("b4_pg_constraints", lambda s, d: PG.map_constraints(_pg(s, d)).select("key", "table_key", "kind", join("columns").alias("columns"), "referenced_table_key", join("referenced_columns").alias("referenced_columns"), "expression"), "b4_map_constraints")
_as_pg("b5_pg_indexes", lambda s, d: PG.map_indexes(_pg(s, d)).select("key", "table_key", "name", join("columns").alias("columns"), "is_unique", "is_primary"), "b5_map_indexes")
_as_pg("b8_pg_views", lambda s, d: PG.map_views(_pg(s, d)).select("key", "schema_key", join("depends_on").alias("depends_on")), "b8_map_views")
_as_pg("b12_pg_routines", lambda s, d: PG.map_routines(_pg(s, d)).select("key", "schema_key", "kind", join("depends_on").alias("depends_on")), "b12_map_routines")
_mapped("b1_pg_schemas", lambda s, d: PG.map_schemas(_pg(s, d)), "SELECT sk AS snapshot_key, skey AS key, dkey AS database_key, nn AS name FROM nat JOIN db USING (sk)")
_mapped("b11_pg_triggers", lambda s, d: PG.map_triggers(_pg(s, d)).select("key", "table_key", "timing", join("events").alias("events"), "executes_routine_key"), "SELECT key, tkey AS table_key, 'AFTER' AS timing, 'INSERT' AS events, rkey AS executes_routine_key FROM tr")
_mapped("b29_pg_open_dependencies", lambda s, d: M.open_dependencies(_pg(s, d), catalog(s, d), "postgres").select("code", "object_key", "message"), "SELECT 'dependency_closure_unproven' AS code, key AS object_key, 'plpgsql' AS message FROM rt WHERE pk % 2 = 1")


def _pg_parts(s, d):
    """PostgreSQL's own objects over the fleet: the last part of each index is included only, columns have their priority's enum type, the first column of a table owns a sequence, tables whose number ends in 7 are partitions of their follower, one role owns all."""
    x, c = _pg(s, d), catalog(s, d)
    nsp = x["pg_namespace"].select("snapshot_key", F.col("oid").alias("nsp"))
    words = c.columns.select("snapshot_key", "data_type").distinct()
    own = lambda df, kind, name: df.select("snapshot_key", F.xxhash64(F.lit(kind), "nsp", name).alias("oid"), name.alias("relname"), F.col("nsp").alias("relnamespace"), F.lit(kind).alias("relkind"), F.lit(False).alias("relispartition"), F.lit("p").alias("relpersistence"), F.lit(10).cast("long").alias("relowner"), F.lit(None).cast("string").alias("definition"))
    sequences = own(nsp, "S", F.lit("seq"))
    types = nsp.join(words, "snapshot_key").select("snapshot_key", F.xxhash64("nsp", "data_type").alias("oid"), F.col("data_type").alias("typname"), F.col("nsp").alias("typnamespace"), F.lit("e").alias("typtype"), F.lit(0).cast("long").alias("typrelid"))
    enums = types.select("snapshot_key", F.col("oid").alias("enumtypid"), F.lit("one").alias("enumlabel"), F.lit(1.0).alias("enumsortorder"))
    of = x["pg_class"].select("snapshot_key", F.col("oid").alias("attrelid"), F.col("relnamespace").alias("nsp"))
    attribute = x["pg_attribute"].join(of, ["snapshot_key", "attrelid"]).withColumn("atttypid", F.xxhash64("nsp", "format_type"))
    uses = attribute.where("attnum = 1").join(sequences.select("snapshot_key", F.col("relnamespace").alias("nsp"), F.col("oid").alias("objid")), ["snapshot_key", "nsp"]).select("snapshot_key", F.lit("pg_class").alias("classid"), "objid", F.lit("pg_class").alias("refclassid"), F.col("attrelid").alias("refobjid"), F.lit(1).alias("refobjsubid"), F.lit("a").alias("deptype"))
    fk = x["pg_constraint"].where("contype = 'f'").select("snapshot_key", F.col("conrelid").alias("inhrelid"), F.col("confrelid").alias("inhparent"), F.lit(1).alias("inhseqno"))
    index = x["pg_index"].withColumn("indnkeyatts", F.greatest(F.col("indnkeyatts") - 1, F.lit(1)))
    roles = x["databases"].select("snapshot_key", F.lit(10).cast("long").alias("oid"), F.lit("owner").alias("rolname"))
    return x | {"pg_class": x["pg_class"].withColumn("relispartition", (F.col("relkind") == "r") & F.col("relname").endswith("7")).unionByName(sequences), "pg_attribute": attribute.drop("nsp"), "pg_type": types, "pg_enum": enums, "pg_depend": x["pg_depend"].unionByName(uses), "pg_inherits": fk, "pg_index": index, "pg_roles": roles}


_linked = lambda kind: lambda s, d: PG.metadata(_pg_parts(s, d), kind)[1].where(F.col("kind") == kind).select("from_key", "to_key", "ordinal")
_made = lambda kind: lambda s, d: PG.metadata(_pg_parts(s, d), kind)[0].where(F.col("key").contains(f":{kind}:")).select("key", "parent_key", "name")
_mapped("b6_pg_included_columns", _linked("includes_column"), "SELECT key AS from_key, ckey AS to_key, k::INTEGER AS ordinal FROM (SELECT key, ckey, row_number() OVER (PARTITION BY key ORDER BY pos) AS k, count(*) OVER (PARTITION BY key) AS n FROM ix_col) WHERE k = n AND n > 1")
_mapped("b14_pg_sequences", _made("sequence"), "SELECT pre || 'sequence:seq' AS key, skey AS parent_key, 'seq' AS name FROM nat")
_mapped("b14_pg_uses_sequence", _linked("uses_sequence"), "SELECT ckey AS from_key, pre || 'sequence:seq' AS to_key, NULL::INTEGER AS ordinal FROM col WHERE pos = 1")
_mapped("b15_pg_types", _made("user_defined_type"), "SELECT pre || 'user_defined_type:' || prio AS key, skey AS parent_key, prio AS name FROM nat JOIN (SELECT DISTINCT sk, prio FROM col) USING (sk)")
_mapped("b15_pg_enum_values", _made("enum_value"), "SELECT pre || 'enum_value:' || prio || ':one' AS key, pre || 'user_defined_type:' || prio AS parent_key, 'one' AS name FROM nat JOIN (SELECT DISTINCT sk, prio FROM col) USING (sk)")
_mapped("b15_pg_uses_type", _linked("uses_type"), "SELECT ckey AS from_key, pre || 'user_defined_type:' || prio AS to_key, NULL::INTEGER AS ordinal FROM col")
_mapped("b17_pg_owned_by", lambda s, d: _linked("owned_by")(s, d).select("from_key", "to_key"), "SELECT key AS from_key, replace(dkey, ':database:w', ':principal:owner') AS to_key FROM (SELECT sk, skey AS key FROM nat UNION ALL SELECT sk, tkey FROM cust UNION ALL SELECT sk, key FROM vw UNION ALL SELECT sk, pre || 'sequence:seq' FROM nat) JOIN db USING (sk)")
_mapped("b19_pg_partition_of", _linked("partition_of"), "SELECT tkey AS from_key, next_t AS to_key, NULL::INTEGER AS ordinal FROM chain WHERE next_t IS NOT NULL AND ck % 10 = 7")
_mapped("b19_pg_inherits_from", _linked("inherits_from"), "SELECT tkey AS from_key, next_t AS to_key, 1 AS ordinal FROM chain WHERE next_t IS NOT NULL AND ck % 10 <> 7")


# Validation: the catalog with one mutation for each rule, by a number in the key.


def _corrupt(s, d) -> Canonical:
    c = catalog(s, d)
    none = F.array().cast("array<string>")
    t = c.tables
    return c.with_tables(
        databases=c.databases.withColumn("connection_alias", F.when(F.col("connection_alias") == "EUROPE", " ").otherwise(F.col("connection_alias"))),
        capabilities=c.capabilities.withColumn("source_kind", F.when(F.col("snapshot_key").like("tpch:A%"), "other").otherwise(F.col("source_kind"))),
        tables=t.withColumn("name", F.when(_n("key") % 103 == 0, "x").otherwise(F.col("name"))).unionByName(t.where(_n("key") % 101 == 0)),
        views=c.views.withColumn("key", F.when(_n("key") % 7 == 0, F.replace("key", F.lit(":view:"), F.lit(":routine:"))).otherwise(F.col("key"))).withColumn("depends_on", F.when(_n("key") % 5 == 0, F.concat("depends_on", "depends_on")).otherwise(F.col("depends_on"))),
        columns=c.columns.withColumn("ordinal_position", F.when(_sub("key") % 501 == 0, 0).otherwise(F.col("ordinal_position"))).withColumn("key", F.when(_sub("key") % 503 == 0, F.regexp_replace("key", "^tpch:", "other:")).otherwise(F.col("key"))),
        constraints=c.constraints.withColumn("columns", F.when((F.col("kind") == "primary_key") & (_n("key") % 97 == 0), none).otherwise(F.col("columns"))).withColumn("expression", F.when(_n("key") % 10 == 0, " ").otherwise(F.col("expression"))).withColumn("referenced_table_key", F.when(_n("key") % 89 != 0, F.col("referenced_table_key"))),
        indexes=c.indexes.withColumn("columns", F.when(_n("key") % 83 == 0, none).otherwise(F.col("columns"))),
        triggers=c.triggers.withColumn("events", F.when(_n("key") % 7 == 0, none).otherwise(F.col("events"))),
    )


def _rule(name: str, rule, sql: str, codes: list[str] | None = None):
    def f(s, d):
        got = rule(_corrupt(s, d))
        got = got if codes is None else got.where(F.col("code").isin(*codes))
        return got.select("snapshot_key", "code", "object_key")

    Q[name], SQL[name] = f, over_fleet(sql)


_rule("v1_header", V.header, "SELECT sk AS snapshot_key, CASE WHEN sk = 'tpch:EUROPE' THEN 'connection_alias_missing' ELSE 'capability_source_mismatch' END AS code, dkey AS object_key FROM db WHERE sk LIKE 'tpch:A%' OR sk = 'tpch:EUROPE'")
_rule("v2_registration", V.registration, "SELECT sk AS snapshot_key, 'object_kind_mismatch' AS code, replace(key, ':view:', ':routine:') AS object_key FROM vw WHERE vk % 7 = 0 UNION ALL SELECT sk, 'duplicate_object_key', tkey FROM cust WHERE ck % 101 = 0")
_rule("v3_scope", V.scope, "SELECT sk AS snapshot_key, 'object_source_scope_mismatch' AS code, regexp_replace(ckey, '^tpch:', 'other:') AS object_key FROM col WHERE ok % 503 = 0 UNION ALL SELECT sk, 'connection_alias_mismatch', CASE WHEN label = 'View' AND regexp_extract(node_key, '([0-9]+)$', 1)::BIGINT % 7 = 0 THEN replace(node_key, ':view:', ':routine:') WHEN label = 'Column' AND regexp_extract(node_key, '([0-9]+)$', 1)::BIGINT % 503 = 0 THEN regexp_replace(node_key, '^tpch:', 'other:') ELSE node_key END FROM nodes WHERE sk = 'tpch:EUROPE'")
_rule("v4_identity", V.identity, "SELECT sk AS snapshot_key, 'object_identity_mismatch' AS code, tkey AS object_key FROM cust WHERE ck % 103 = 0", ["object_identity_mismatch", "database_identity_mismatch", "schema_identity_mismatch", "invalid_table_scope"])
_rule("v5_columns", V.columns, "SELECT sk AS snapshot_key, 'invalid_column_ordinal' AS code, CASE WHEN ok % 503 = 0 THEN regexp_replace(ckey, '^tpch:', 'other:') ELSE ckey END AS object_key FROM col WHERE ok % 501 = 0 UNION ALL SELECT sk, 'duplicate_column_ordinal', k FROM (SELECT sk, k, row_number() OVER (PARTITION BY tkey ORDER BY k) AS n FROM (SELECT sk, tkey, CASE WHEN ok % 503 = 0 THEN regexp_replace(ckey, '^tpch:', 'other:') ELSE ckey END AS k FROM col WHERE ok % 501 = 0)) WHERE n > 1")
_rule("v6_constraints", V.constraints, "SELECT sk AS snapshot_key, 'constraint_columns_missing' AS code, key AS object_key FROM con WHERE kind = 'primary_key' AND ck % 97 = 0 UNION ALL SELECT sk, 'check_expression_missing', key FROM con WHERE kind = 'check' AND ck % 10 = 0")
_rule("v7_foreign_keys", V.foreign_keys, "SELECT sk AS snapshot_key, 'foreign_key_target_missing' AS code, key AS object_key FROM con WHERE kind = 'foreign_key' AND ck % 89 = 0")
_rule("v8_indexes", V.indexes, "SELECT sk AS snapshot_key, 'index_definition_missing' AS code, key AS object_key FROM ix WHERE ck % 83 = 0")
_rule("v9_programs", V.programs, "SELECT sk AS snapshot_key, 'trigger_events_missing' AS code, key AS object_key FROM tr WHERE ck % 7 = 0 UNION ALL SELECT sk, 'duplicate_view_dependency', CASE WHEN vk % 7 = 0 THEN replace(key, ':view:', ':routine:') ELSE key END FROM vw WHERE vk % 5 = 0 AND key IN (SELECT key FROM vdep)")


def v10_references(s, d):
    """Tables and columns that others refer to are gone."""
    c = catalog(s, d)
    gone = c.with_tables(tables=c.tables.where(_n("key") % 211 != 0), columns=c.columns.where(_sub("key") % 499 != 0))
    return V.references(gone).groupBy("snapshot_key", "code", "object_key").agg(F.count("*").alias("n"))


Q["v10_references"] = v10_references
SQL["v10_references"] = over_fleet(
    "SELECT sk AS snapshot_key, 'relationship_target_missing' AS code, owner AS object_key, count(*) AS n FROM refs JOIN gone ON target = lost GROUP BY ALL",
    "gone AS (SELECT tkey AS lost FROM cust WHERE ck % 211 = 0 UNION ALL SELECT ckey FROM col WHERE ok % 499 = 0)",
    "refs AS (SELECT sk, ckey AS owner, tkey AS target FROM col WHERE ok % 499 <> 0 UNION ALL SELECT sk, key, tkey FROM con UNION ALL SELECT sk, key, tkey FROM ix UNION ALL SELECT sk, key, tkey FROM tr UNION ALL SELECT sk, key, ckey FROM con_col UNION ALL SELECT sk, key, ckey FROM ix_col UNION ALL SELECT con.sk, key, next_t FROM con JOIN chain USING (ck) WHERE kind = 'foreign_key' UNION ALL SELECT con.sk, key, next_c FROM con JOIN chain USING (ck) WHERE kind = 'foreign_key' UNION ALL SELECT sk, key, dep FROM vdep UNION ALL SELECT sk, key, dep FROM rdep)",
)


# Sequences: part p of size 3 or 4 stands for one in its nation; the first column of a customer's table uses it.
_SEQ = "seq AS (SELECT p_partkey AS q, nk, sk, pre, skey, pre || 'sequence:q' || p_partkey AS key FROM part JOIN nat ON p_partkey % 25 = nk WHERE p_size IN (3, 4))"


def _metadata(s, d) -> Canonical:
    c = catalog(s, d)
    prefix = F.concat(F.regexp_extract("schema_key", "^(.*:)schema:", 1), F.lit("sequence:q"))
    part = s.read.parquet(f"{d}/part.parquet").where("p_size in (3, 4)").select("p_partkey", F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("nation"))
    schemas = c.schemas.select("snapshot_key", F.col("key").alias("schema_key"), F.col("database_key"), F.col("name").alias("nation"))
    q = part.join(schemas, "nation").withColumn("key", F.concat(prefix, F.col("p_partkey").cast("string")))
    prop = F.struct(F.lit("string").alias("type"), F.lit("v").alias("value"))
    name = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("q"), F.col("p_partkey").cast("string")))
    objects = q.select("snapshot_key", "key", F.when(F.col("p_partkey") % 7 == 0, F.col("database_key")).otherwise(F.col("schema_key")).alias("parent_key"), name.alias("name"), F.when(F.col("p_partkey") % 5 == 0, "kind").alias("extension_kind"), F.create_map(F.when(F.col("p_partkey") % 11 == 0, F.lit("")).otherwise(F.lit("p")), prop).alias("properties"))
    notes = q.select("snapshot_key", F.col("key").alias("object_key"), F.when(F.col("p_partkey") % 4 != 0, "text").alias("definition"))
    notes = notes.unionByName(notes.where(_n("object_key") % 6 == 0))
    first = c.columns.where("ordinal_position = 1").groupBy("snapshot_key").agg(F.min("key").alias("to_col"), F.min("table_key").alias("to_table"))
    rel = q.join(first, "snapshot_key").select("snapshot_key", F.lit("uses_sequence").alias("kind"), F.when(F.col("p_partkey") % 9 == 0, F.col("to_table")).otherwise(F.col("to_col")).alias("from_key"), F.col("key").alias("to_key"), F.when(F.col("p_partkey") % 8 == 0, 0).otherwise(1).alias("ordinal"))
    return Canonical.of(s, **{k: v for k, v in c.t.items() if k not in ("metadata_objects", "annotations", "relationships")}, metadata_objects=objects, annotations=notes, relationships=rel)


def _meta_rule(name: str, rule, sql: str):
    Q[name] = lambda s, d: rule(_metadata(s, d)).select("snapshot_key", "code", "object_key")
    SQL[name] = over_fleet(sql, _SEQ, "one AS (SELECT sk, min(ckey) AS c, min(tkey) AS t FROM col WHERE pos = 1 GROUP BY sk)")


_meta_rule("v11_metadata_objects", V.metadata_objects, "SELECT sk AS snapshot_key, 'metadata_name_missing' AS code, key AS object_key FROM seq WHERE q % 3 = 0 UNION ALL SELECT sk, 'extension_kind_unexpected', key FROM seq WHERE q % 5 = 0")
_meta_rule("v12_parents", V.parents, "SELECT sk AS snapshot_key, 'metadata_parent_kind_mismatch' AS code, key AS object_key FROM seq WHERE q % 7 = 0")
_meta_rule("v13_annotations", V.annotations, "SELECT sk AS snapshot_key, 'duplicate_object_annotation' AS code, key AS object_key FROM seq WHERE q % 6 = 0 UNION ALL SELECT sk, 'empty_object_annotation', key FROM seq WHERE q % 4 = 0 UNION ALL SELECT sk, 'empty_object_annotation', key FROM seq WHERE q % 12 = 0")
_meta_rule("v14_relationships", V.relationships, "SELECT seq.sk AS snapshot_key, code, 'USES_SEQUENCE:' || CASE WHEN q % 9 = 0 THEN t ELSE c END || '->' || key AS object_key FROM seq JOIN one USING (sk) JOIN (SELECT 'relationship_ordinal_invalid' AS code, 8 AS m UNION ALL SELECT 'metadata_relationship_kind_mismatch', 9) ON q % m = 0")
_meta_rule("v15_sizes", V.sizes, "SELECT sk AS snapshot_key, 'property_name_invalid' AS code, key AS object_key FROM seq WHERE q % 11 = 0")
Q["v_all_rules"] = lambda s, d: V.validate(_corrupt(s, d)).where("code in ('duplicate_object_key', 'invalid_column_ordinal', 'index_definition_missing', 'trigger_events_missing', 'foreign_key_target_missing')").groupBy("snapshot_key", "code").agg(F.count("*").alias("n"))
SQL["v_all_rules"] = over_fleet("SELECT sk AS snapshot_key, 'duplicate_object_key' AS code, count(*) AS n FROM cust WHERE ck % 101 = 0 GROUP BY ALL UNION ALL SELECT sk, 'invalid_column_ordinal', count(*) FROM col WHERE ok % 501 = 0 GROUP BY ALL UNION ALL SELECT sk, 'index_definition_missing', count(*) FROM ix WHERE ck % 83 = 0 GROUP BY ALL UNION ALL SELECT sk, 'trigger_events_missing', count(*) FROM tr WHERE ck % 7 = 0 GROUP BY ALL UNION ALL SELECT sk, 'foreign_key_target_missing', count(*) FROM con WHERE kind = 'foreign_key' AND ck % 89 = 0 GROUP BY ALL")

# Certification

_LABEL = "lower(regexp_replace(label, '([a-z])([A-Z])', '\\1_\\2', 'g'))"
_OBJECTS = f"objects AS (SELECT c.category, reg.sk, coalesce(n, 0) AS emitted FROM (SELECT unnest({OBJECT_CATEGORIES}) AS category) c CROSS JOIN reg LEFT JOIN (SELECT sk, {_LABEL} AS category, count(*) AS n FROM nodes GROUP BY ALL) m ON m.sk = reg.sk AND m.category = c.category)"
_REL = "rels AS (SELECT sk, CASE WHEN edge_type LIKE 'COLUMN_IN_INDEX' THEN 'index_column' WHEN edge_type LIKE 'COLUMN_IN_%' THEN 'constraint_column' WHEN edge_type = 'FK_FROM_COLUMN' THEN 'foreign_key_column_pair' WHEN edge_type LIKE 'VIEW_DEPENDS%' THEN 'view_dependency' WHEN edge_type LIKE 'ROUTINE_DEPENDS%' THEN 'routine_dependency' WHEN edge_type = 'TABLE_HAS_TRIGGER' THEN 'trigger_target' WHEN edge_type = 'TRIGGER_EXECUTES_ROUTINE' THEN 'trigger_routine' ELSE lower(edge_type) END AS category, count(*) AS n FROM edges WHERE edge_type NOT IN ('FK_TO_COLUMN', 'TRIGGER_ON_TABLE') GROUP BY ALL)"
_RELATIONS = f"relations AS (SELECT c.category, reg.sk, coalesce(n, 0) AS emitted FROM (SELECT unnest({RELATION_CATEGORIES}) AS category) c CROSS JOIN reg LEFT JOIN rels m ON m.sk = reg.sk AND m.category = c.category)"


def _certified(name: str, f, sql: str):
    Q[name], SQL[name] = f, over_fleet(sql, _OBJECTS, _REL, _RELATIONS)


def _discovered(s, d):
    """Independent counts; tables are counted one too many in two regions, index columns in one, triggers and view dependencies not at all in one, columns and routines without evidence in another."""
    at = lambda *names: F.col("snapshot_key").isin(*[f"tpch:{n}" for n in names])
    of = lambda *names: F.col("category").isin(*names)
    more = ((of("table") & at("ASIA", "EUROPE")) | (of("index_column") & at("EUROPE"))).cast("long")
    blank = of("column", "schema_has_routine") & at("AFRICA")
    seen = [x.withColumn("discovered", F.col("discovered") + more).withColumn("evidence", F.when(blank, " ").otherwise(F.col("evidence"))) for x in discovered(_pg(s, d), "postgres")]
    return [x.where(~(of("trigger", "view_dependency") & at("AMERICA"))) for x in seen]


_ISSUES = "issues AS (SELECT 'tpch:' || n AS sk, code, subject FROM (VALUES ('ASIA', 'object_count_mismatch', 'object_counts.table'), ('EUROPE', 'object_count_mismatch', 'object_counts.table'), ('EUROPE', 'relationship_count_mismatch', 'relationship_counts.index_column'), ('AFRICA', 'discovery_evidence_missing', 'object_counts.column'), ('AFRICA', 'discovery_evidence_missing', 'relationship_counts.schema_has_routine'), ('AMERICA', 'discovered_count_missing', 'object_counts.trigger'), ('AMERICA', 'discovered_relationship_count_missing', 'relationship_counts.view_dependency')) v(n, code, subject))"


def _reconciled(s, d):
    c = catalog(s, d)
    objects, relations = _discovered(s, d)
    return C.reconcile(objects, C.emitted_objects(c)).unionByName(C.reconcile(relations, C.emitted_relations(c), "relationship"))


_certified("c1_emitted_objects", lambda s, d: C.emitted_objects(catalog(s, d)), "SELECT sk AS snapshot_key, category, emitted FROM objects")
_certified("c2_emitted_relations", lambda s, d: C.emitted_relations(catalog(s, d)), "SELECT sk AS snapshot_key, category, emitted FROM relations")
Q["c3_reconcile"] = lambda s, d: _reconciled(s, d).select("snapshot_key", "code", "subject")
SQL["c3_reconcile"] = over_fleet("SELECT sk AS snapshot_key, code, subject FROM issues", _ISSUES)


def _proof(s, d):
    names = F.array_sort(F.collect_list(F.split("key", ":")[3]))
    p = catalog(s, d).schemas.groupBy("snapshot_key").agg(names.alias("schemas"))
    asia, europe = F.col("snapshot_key") == "tpch:ASIA", F.col("snapshot_key") == "tpch:EUROPE"
    proofs = p.select("snapshot_key", F.when(asia, "").otherwise("retail").alias("adapter"), F.lit("1").alias("adapter_version"), F.lit("srv").alias("server"), F.lit("9").alias("server_version"), F.when(europe, F.array().cast("array<string>")).when(F.col("snapshot_key") == "tpch:AMERICA", F.array(F.lit(" "))).otherwise(F.array(F.lit("w"))).alias("catalogs"), F.when(asia, F.reverse("schemas")).otherwise(F.col("schemas")).alias("schemas"))
    checks = p.select("snapshot_key", F.posexplode(F.when(europe, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("position", "name"), F.lit("seen").alias("evidence")).where("snapshot_key <> 'tpch:AFRICA'")
    return proofs, checks


Q["c4_check_proof"] = lambda s, d: C.check_proof(*_proof(s, d)).select("snapshot_key", "code", "subject")
SQL["c4_check_proof"] = "SELECT 'tpch:' || r_name AS snapshot_key, code, subject FROM region JOIN (VALUES ('ASIA', 'proof_value_missing', 'adapter'), ('ASIA', 'scope_not_canonical', 'scope.schemas'), ('EUROPE', 'scope_missing', 'scope.catalogs'), ('EUROPE', 'duplicate_capability_check', 'capability_checks.a'), ('EUROPE', 'capability_checks_not_canonical', 'capability_checks'), ('AFRICA', 'capability_proof_missing', 'capability_checks'), ('AMERICA', 'scope_value_missing', 'scope.catalogs')) v(n, code, subject) ON n = r_name"


def c5_check_capabilities(s, d):
    c = catalog(s, d)
    at = lambda n: F.col("snapshot_key") == f"tpch:{n}"
    caps = c.capabilities.withColumn("metadata_only", ~at("ASIA")).withColumn("indexes", ~at("EUROPE")).withColumn("views", F.when(at("AFRICA"), "partial").otherwise("supported")).withColumn("limitations", F.when(at("AMERICA"), F.array(F.lit("x"))).otherwise(F.col("limitations"))).withColumn("source_kind", F.when(at("ASIA"), "x").otherwise(F.col("source_kind")))
    return C.check_capabilities(caps, c.databases).select("snapshot_key", "code", "subject")


Q["c5_check_capabilities"] = c5_check_capabilities
SQL["c5_check_capabilities"] = "SELECT 'tpch:' || r_name AS snapshot_key, code, 'capabilities.' || subject AS subject FROM region JOIN (VALUES ('ASIA', 'metadata_only_required', 'metadata_only'), ('ASIA', 'capability_source_mismatch', 'source_kind'), ('EUROPE', 'required_capability_missing', 'indexes'), ('AFRICA', 'required_capability_incomplete', 'views'), ('AMERICA', 'adapter_limitations_present', 'limitations')) v(n, code, subject) ON n = r_name"


def c6_verify_stored(s, d):
    c = catalog(s, d)
    o, r = C.emitted_objects(c), C.emitted_relations(c)
    place = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col("category"))
    proof = lambda counts, domain, names: counts.select("snapshot_key", F.lit(2).alias("contract_version"), F.lit(domain).alias("domain"), place(names).alias("position"), "category", F.col("emitted").alias("discovered"), "emitted")
    p = proof(o, "object", OBJECT_CATEGORIES).unionByName(proof(r, "relationship", RELATION_CATEGORIES))
    at = lambda n: F.col("snapshot_key") == f"tpch:{n}"
    p = p.withColumn("contract_version", F.when(at("ASIA"), 1).otherwise(2)).withColumn("emitted", F.col("emitted") + (at("EUROPE") & (F.col("category") == "view")).cast("long"))
    p = p.where(~(at("AFRICA") & F.col("category").isin("event", "trigger_target"))).unionByName(p.where(at("AMERICA") & F.col("category").isin("index_column", "view")))
    p = p.withColumn("position", F.when(at("EUROPE") & (F.col("category") == "database"), 99).otherwise(F.col("position"))).withColumn("discovered", F.col("discovered") + (at("EUROPE") & (F.col("category") == "index_column")).cast("long"))
    return C.verify_stored(p, o, r).select("snapshot_key", "code", "subject")


Q["c6_verify_stored"] = c6_verify_stored
SQL["c6_verify_stored"] = "SELECT 'tpch:' || r_name AS snapshot_key, code, subject FROM region JOIN (VALUES ('ASIA', 'unsupported_contract_version', 'contract_version'), ('EUROPE', 'object_count_mismatch', 'object_counts.view'), ('EUROPE', 'relationship_count_mismatch', 'relationship_counts.index_column'), ('EUROPE', 'snapshot_not_canonical', 'object_counts'), ('AFRICA', 'object_count_missing', 'object_counts.event'), ('AFRICA', 'relationship_count_missing', 'relationship_counts.trigger_target'), ('AMERICA', 'duplicate_object_count', 'object_counts.view'), ('AMERICA', 'duplicate_relationship_count', 'relationship_counts.index_column')) v(n, code, subject) ON n = r_name"
Q["c7_verdict"] = lambda s, d: C.verdict(catalog(s, d).databases, _reconciled(s, d))
SQL["c7_verdict"] = over_fleet("SELECT reg.sk AS snapshot_key, CASE WHEN count(code) > 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN count(*) FILTER (code LIKE '%count%') > 0 THEN 'completeness_mismatch' WHEN count(code) > 0 THEN 'validation_failed' END AS code, count(code) AS issues FROM reg LEFT JOIN issues USING (sk) GROUP BY reg.sk", _ISSUES)


def c8_check_requests(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    m, name = F.col("c_custkey") % 8, F.col("c_name")
    alias = F.when(m == 0, " ").when(m == 1, F.repeat(name, F.lit(100))).when(m == 2, F.concat(name, F.lit("\t"))).when(m == 3, F.concat(F.lit("pg://u:p@"), name)).otherwise(name)
    scopes = F.when(m == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    r = c.select("c_custkey", alias.alias("alias"), scopes.alias("scopes"), F.when(m == 5, 0).otherwise(1000).alias("timeout_ms"), F.lit("mysql").alias("requested"), F.when(m == 6, "mariadb").otherwise("mysql").alias("product"))
    return C.check_requests(r).select("c_custkey", "reason")


Q["c8_check_requests"] = c8_check_requests
SQL["c8_check_requests"] = "SELECT c_custkey, ['alias_missing', 'alias_too_long', 'alias_has_controls', 'alias_has_secret', 'scope_repeated', 'timeout_out_of_range', 'product_mismatch', NULL][c_custkey % 8 + 1] AS reason FROM customer"

# Projection

_mapped("p1_project_nodes", lambda s, d: graph(s, d).nodes.select("snapshot_key", "node_key", "label", "display_name", F.get_json_object("payload_json", "$.name").alias("name"), F.get_json_object("payload_json", "$.key.object_name").alias("object_name")), "SELECT sk AS snapshot_key, node_key, label, display_name, display_name AS name, string_split(node_key, ':')[6] AS object_name FROM nodes")
_edge_cols = ["snapshot_key", "edge_key", "edge_from", "edge_to", "edge_type"]
_E = "SELECT sk AS snapshot_key, edge_key, edge_from, edge_to, edge_type FROM edges WHERE "
_mapped("p2_ownership_edges", lambda s, d: P.ownership_edges(catalog(s, d)).select(*_edge_cols), _E + "edge_type LIKE '%\\_HAS\\_%' ESCAPE '\\'")
_mapped("p3_membership_edges", lambda s, d: P.membership_edges(catalog(s, d)).select(*_edge_cols), _E + "edge_type LIKE 'COLUMN\\_IN%' ESCAPE '\\' OR edge_type LIKE 'FK%'")
_mapped("p4_dependency_edges", lambda s, d: P.dependency_edges(catalog(s, d)).select(*_edge_cols), _E + "edge_type LIKE '%DEPENDS%' OR edge_type LIKE 'TRIGGER%'")
Q["p5_relationship_edges"] = lambda s, d: P.relationship_edges(_metadata(s, d)).select(*_edge_cols)
SQL["p5_relationship_edges"] = over_fleet("SELECT sk AS snapshot_key, 'USES_SEQUENCE:' || f || '->' || key || ':' || CASE WHEN q % 8 = 0 THEN 0 ELSE 1 END AS edge_key, f AS edge_from, key AS edge_to, 'USES_SEQUENCE' AS edge_type FROM (SELECT seq.sk, q, key, CASE WHEN q % 9 = 0 THEN t ELSE c END AS f FROM seq JOIN one USING (sk))", _SEQ, "one AS (SELECT sk, min(ckey) AS c, min(tkey) AS t FROM col WHERE pos = 1 GROUP BY sk)")


def p6_check_projection(s, d):
    """Views of two nations depend on something that gives no edge, so that their snapshots fail."""
    c = catalog(s, d)
    views = c.views.withColumn("depends_on", F.when(F.col("schema_key").rlike(":schema:NATION_[12]$"), F.concat("depends_on", F.array("schema_key"))).otherwise(F.col("depends_on")))
    changed = c.with_tables(views=views)
    return P.check_projection(P.project(changed), C.emitted_objects(changed), C.emitted_relations(changed))


Q["p6_check_projection"] = p6_check_projection
SQL["p6_check_projection"] = over_fleet("SELECT reg.sk AS snapshot_key, n AS want_nodes, e + more AS want_edges, n AS nodes, e AS edges, more = 0 AS accepted FROM reg JOIN (SELECT sk, count(*) AS n FROM nodes GROUP BY sk) USING (sk) JOIN (SELECT sk, count(*) AS e FROM edges GROUP BY sk) USING (sk) JOIN (SELECT reg.sk, count(vk) AS more FROM reg LEFT JOIN (SELECT vw.sk, vk FROM vw JOIN nat USING (nk) WHERE nn IN ('NATION_1', 'NATION_2')) v USING (sk) GROUP BY ALL) USING (sk)")
_mapped("p7_dedupe_edges", lambda s, d: (lambda e: P.dedupe_edges(reduce(DataFrame.unionByName, [e, e.where("edge_type like 'VIEW%'")])).select(*_edge_cols))(graph(s, d).edges), _E + "true")
