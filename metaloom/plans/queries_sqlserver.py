"""Registered queries over the SQL Server form of the fleet, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as INV
from ..operators import mapping as M
from ..operators import postgres as PG
from ..operators import sqlserver as MS
from .fleet import catalog
from .oracles import over_fleet
from .queries_graph import SQL as GRAPH_SQL
from .queries_graph import _extract, _n, _pg, join

Q: dict = {}
SQL: dict = {}


def _sys(s, d):
    return MS.as_sys(catalog(s, d))


def _resolved(x):
    ids = MS.registry(x)
    return ids, *MS.dependencies(x, ids)


def _like(name: str, f, like: str):
    Q[name], SQL[name] = f, GRAPH_SQL[like]


_like("b1_ms_schemas", lambda s, d: MS.map_schemas(_sys(s, d)), "b1_pg_schemas")
_like("b2_ms_tables", lambda s, d: MS.map_tables(_sys(s, d)), "b2_map_tables")
_like("b3_ms_columns", lambda s, d: MS.map_columns(_sys(s, d)).select("key", "table_key", "ordinal_position", "data_type", "is_nullable", "is_generated"), "b3_map_columns")
_like("b4_ms_constraints", lambda s, d: MS.map_constraints(_sys(s, d)).select("key", "table_key", "kind", join("columns").alias("columns"), "referenced_table_key", join("referenced_columns").alias("referenced_columns"), "expression"), "b4_map_constraints")
_like("b5_ms_indexes", lambda s, d: MS.map_indexes(_sys(s, d)).select("key", "table_key", "name", join("columns").alias("columns"), "is_unique", "is_primary"), "b5_map_indexes")
_like("b8_ms_views", lambda s, d: (lambda x: MS.map_views(x, _resolved(x)[1]).select("key", "schema_key", join("depends_on").alias("depends_on")))(_sys(s, d)), "b8_map_views")
_like("b12_ms_routines", lambda s, d: (lambda x: MS.map_routines(x, _resolved(x)[1]).select("key", "schema_key", "kind", join("depends_on").alias("depends_on")))(_sys(s, d)), "b12_map_routines")


def _mapped(name: str, f, sql: str, *ctes: str):
    Q[name], SQL[name] = f, over_fleet(sql, *ctes)


_mapped("b11_ms_triggers", lambda s, d: MS.map_triggers(_sys(s, d)).select("key", "table_key", "timing", join("events").alias("events")), "SELECT key, tkey AS table_key, 'AFTER' AS timing, (SELECT string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM events WHERE user_id = ck) AS events FROM tr")


def _synonyms(s, d):
    """A synonym for each table: by schema and name, with the database in another case, in another database, and on another server; two of these share each external name. One in fifty names nothing."""
    x, c = _sys(s, d), catalog(s, d)
    k, nation = _n("key"), F.split("key", ":")[3]
    base = F.when(k % 50 == 0, " ").when(k % 4 == 0, F.concat(F.lit("["), nation, F.lit("].["), "name", F.lit("]"))).when(k % 4 == 1, F.concat(F.lit("W."), nation, F.lit("."), "name")).when(k % 4 == 2, F.concat(F.lit("other.dbo.t"), (k % 7).cast("string"))).otherwise(F.concat(F.lit("[srv]]x].w.dbo.t"), (k % 7).cast("string")))
    synonyms = c.tables.select("snapshot_key", F.xxhash64(F.lit("y"), "key").alias("object_id"), F.xxhash64("schema_key").alias("schema_id"), F.concat(F.lit("y"), "name").alias("name"), base.alias("base_object_name"))
    return x | {"synonyms": synonyms}


_SYN = "syn AS (SELECT ck, sk, pre || 'synonym:yc' || ck AS key, tkey, 'tpch:' || alias || ':w:external:extension:' AS ext, CASE WHEN ck % 50 = 0 THEN NULL WHEN ck % 4 = 2 THEN 'other.dbo.t' || (ck % 7) WHEN ck % 4 = 3 THEN '[srv]]x].w.dbo.t' || (ck % 7) END AS far FROM cust)"
_mapped("b16_ms_synonym_for", lambda s, d: MS.synonyms(_synonyms(s, d))[1].select("from_key", "to_key"), "SELECT key AS from_key, coalesce(ext || far || ':reference', tkey) AS to_key FROM syn WHERE ck % 50 <> 0", _SYN)
_mapped("b16_ms_external_references", lambda s, d: MS.external_references([MS.synonyms(_synonyms(s, d))[2]]).select("key", "parent_key", "name", *[F.col("properties")[p]["value"].alias(p) for p in ("server", "database", "schema", "entity", "reference_kind")]), "SELECT DISTINCT ext || far || ':reference' AS key, dkey AS parent_key, far AS name, CASE WHEN ck % 4 = 3 THEN 'srv]x' END AS server, CASE WHEN ck % 4 = 3 THEN 'w' ELSE 'other' END AS database, 'dbo' AS schema, 't' || (ck % 7) AS entity, 'synonym_target' AS reference_kind FROM syn JOIN db USING (sk) WHERE far IS NOT NULL", _SYN)
_mapped("b16_ms_issues", lambda s, d: MS.synonyms(_synonyms(s, d))[3].select("snapshot_key", "code", "object_key"), "SELECT sk AS snapshot_key, 'synonym_target_missing' AS code, key AS object_key FROM syn WHERE ck % 50 = 0", _SYN)


def _noted(s, d):
    """Extended properties of the database, schemas, every third table, first columns, indexes on one column and a principal; and of tables that aren't there."""
    x = _sys(s, d)
    zero = F.lit(0).cast("long")
    note = lambda df, of_class, major, minor: df.select("snapshot_key", F.lit(of_class).alias("class"), major.cast("long").alias("major_id"), minor.cast("long").alias("minor_id"), F.lit("note").alias("name"), F.lit("text").alias("value"))
    number = F.substring("name", 2, 20).cast("long")
    rows = [note(x["databases"], 0, zero, zero), note(x["schemas"], 3, F.col("schema_id"), zero), note(x["tables"].where(number % 3 == 0), 1, F.col("object_id"), zero), note(x["columns"].where("column_id = 1"), 1, F.col("object_id"), F.col("column_id")), note(x["indexes"].where("name is not null and is_unique"), 7, F.col("object_id"), F.col("index_id")), note(x["databases"], 4, F.lit(1), zero), note(x["tables"].where(number % 50 == 0), 1, number, zero)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    principals = x["databases"].select("snapshot_key", F.lit(1).cast("long").alias("principal_id"), F.lit("owner").alias("name"))
    return x | {"extended_properties": out, "database_principals": principals}


_mapped(
    "b21_ms_extended_properties",
    lambda s, d: (lambda x: MS.extended_properties(x, MS.registry(x))[0].select("parent_key", "name", F.col("properties")["class"]["value"].alias("class"), F.col("properties")["display_value"]["value"].alias("value")))(_noted(s, d)),
    "SELECT parent_key, 'note' AS name, class::VARCHAR AS class, 'text' AS value FROM (SELECT dkey AS parent_key, 0 AS class FROM db UNION ALL SELECT skey, 3 FROM nat UNION ALL SELECT tkey, 1 FROM cust WHERE ck % 3 = 0 UNION ALL SELECT ckey, 1 FROM col WHERE pos = 1 UNION ALL SELECT key, 7 FROM ix WHERE n = 1 UNION ALL SELECT replace(dkey, ':database:w', ':principal:owner'), 4 FROM db)",
)
_mapped("b21_ms_issues", lambda s, d: (lambda x: MS.extended_properties(x, MS.registry(x))[1].select("snapshot_key", "code", "object_key"))(_noted(s, d)), "SELECT sk AS snapshot_key, 'extended_property_target_missing' AS code, '1:' || ck || ':0:note' AS object_key FROM cust WHERE ck % 50 = 0")


def _partitioned(s, d):
    """One function of a snapshot, with its priorities as boundaries to the right where the region's name has an A in front; its scheme is used by indexes on one column, with all of its partitions and one too many where the table's number ends in 9. Heaps of every fifth table have one partition, and one partition is of nothing."""
    x, c = _sys(s, d), catalog(s, d)
    words = c.columns.select("snapshot_key", "data_type").distinct()
    bounds = words.groupBy("snapshot_key").agg(F.array_sort(F.collect_list("data_type")).alias("v"))  # at most as many as there are priorities
    right = F.col("snapshot_key").like("tpch:A%")
    number = F.substring("owner", 2, 20).cast("long")
    i = x["indexes"].withColumn("data_space_id", F.when(F.col("name").isNotNull() & F.col("is_unique"), 7).otherwise(0).cast("long"))
    own = i.where("data_space_id = 7").join(bounds, "snapshot_key").join(x["tables"].select("snapshot_key", "object_id", F.col("name").alias("owner")), ["snapshot_key", "object_id"])
    part = lambda df, index, n: df.select("snapshot_key", "object_id", index.cast("long").alias("index_id"), n.alias("partition_number"), F.lit("NONE").alias("data_compression_desc"))
    rows = part(own.select("*", F.explode(F.sequence(F.lit(1), F.size("v") + 1 + (number % 10 == 9).cast("int"))).alias("p")), F.col("index_id"), F.col("p"))
    heaps = x["tables"].where(F.substring("name", 2, 20).cast("long") % 5 == 0)
    rows = rows.unionByName(part(heaps, F.lit(0), F.lit(1))).unionByName(part(x["databases"].withColumn("object_id", F.lit(5).cast("long")), F.lit(0), F.lit(1)))
    return x | {
        "indexes": i,
        "partition_functions": bounds.select("snapshot_key", F.lit(3).cast("long").alias("function_id"), F.lit("pf").alias("name"), (F.size("v") + 1).alias("fanout"), right.alias("boundary_value_on_right")),
        "partition_range_values": bounds.select("snapshot_key", F.lit(3).cast("long").alias("function_id"), F.posexplode("v").alias("at", "value")).select("snapshot_key", "function_id", (F.col("at") + 1).alias("boundary_id"), "value"),
        "partition_schemes": bounds.select("snapshot_key", F.lit(7).cast("long").alias("data_space_id"), F.lit("ps").alias("name"), F.lit(3).cast("long").alias("function_id")),
        "partitions": rows,
    }


_BOUNDS = "bounds AS (SELECT sk, prio, row_number() OVER (PARTITION BY sk ORDER BY prio) AS i, count(*) OVER (PARTITION BY sk) AS n FROM (SELECT DISTINCT sk, prio FROM col))"
_IVALS = "ivals AS (SELECT sk, i AS p, lag(prio) OVER (PARTITION BY sk ORDER BY i) AS lower, prio AS upper FROM bounds UNION ALL SELECT sk, n + 1, prio, NULL FROM bounds WHERE i = n)"
_PARTS = "parts AS (SELECT ix.sk, ix.key AS parent, ix.ck, unnest(range(1, n.n + 2 + CASE WHEN ix.ck % 10 = 9 THEN 1 ELSE 0 END)) AS p FROM ix JOIN (SELECT sk, max(n) AS n FROM bounds GROUP BY sk) n USING (sk) WHERE ix.n = 1)"
_mapped("b19_ms_intervals", lambda s, d: MS.partition_intervals(_partitioned(s, d)).select("snapshot_key", "partition_number", "lower", "upper", "lower_closed"), "SELECT sk AS snapshot_key, p::INTEGER AS partition_number, lower, upper, sk LIKE 'tpch:A%' AS lower_closed FROM ivals", _BOUNDS, _IVALS)
_PARTITIONS = lambda k: lambda s, d: (lambda x: MS.partitions(x, MS.registry(x))[k])(_partitioned(s, d))
_mapped(
    "b19_ms_partitions",
    lambda s, d: _PARTITIONS(0)(s, d).select("parent_key", "name", "extension_kind", *[F.col("properties")[p]["value"].alias(p) for p in ("lower", "upper", "lower_closed")]),
    "SELECT dkey AS parent_key, 'pf' AS name, 'sqlserver_partition_function' AS extension_kind, NULL AS lower, NULL AS upper, NULL AS lower_closed FROM db UNION ALL SELECT dkey, 'ps', 'sqlserver_partition_scheme', NULL, NULL, NULL FROM db UNION ALL SELECT replace(dkey, ':database:w', ':extension:pf:partition-function%3A3').replace('tpch:', 'v2:tpch:'), 'pf boundary ' || i, 'sqlserver_partition_boundary', NULL, NULL, NULL FROM db JOIN bounds USING (sk) UNION ALL SELECT tkey, 'partition 1', 'sqlserver_partition', NULL, NULL, NULL FROM cust WHERE ck % 5 = 0 UNION ALL SELECT parent, 'partition ' || parts.p, 'sqlserver_partition', lower, upper, CASE WHEN ivals.p IS NOT NULL THEN CASE WHEN parts.sk LIKE 'tpch:A%' THEN 'true' ELSE 'false' END END FROM parts LEFT JOIN ivals ON ivals.sk = parts.sk AND ivals.p = parts.p",
    _BOUNDS, _IVALS, _PARTS,
)
_mapped("b19_ms_partition_links", lambda s, d: _PARTITIONS(1)(s, d).groupBy("snapshot_key", "extension_name").agg(F.count("*").alias("n"), F.count_distinct("to_key").alias("targets")), "SELECT sk AS snapshot_key, 'partition_uses_scheme' AS extension_name, count(*) AS n, 1::BIGINT AS targets FROM parts GROUP BY sk UNION ALL SELECT sk, 'partition_scheme_uses_function', 1, 1 FROM db", _BOUNDS, _PARTS)
_mapped("b19_ms_issues", lambda s, d: _PARTITIONS(2)(s, d).groupBy("snapshot_key", "code").agg(F.count("*").alias("n")), "SELECT sk AS snapshot_key, 'partition_parent_missing' AS code, 1::BIGINT AS n FROM db UNION ALL SELECT sk, 'partition_number_invalid', count(*) FROM ix WHERE n = 1 AND ck % 10 = 9 GROUP BY sk", _BOUNDS)


def _temporal(s, d):
    """Tables whose number ends in 5 are versioned, with the table that their foreign key leads to as their history; tables whose number ends in 6 claim to be histories."""
    x, c = _sys(s, d), catalog(s, d)
    next_ = c.constraints.where("kind = 'foreign_key'").select("snapshot_key", F.xxhash64("table_key").alias("object_id"), F.xxhash64("referenced_table_key").alias("next_id"))
    k = F.substring("name", 2, 20).cast("long") % 10
    t = x["tables"].drop("temporal_type", "history_table_id").join(next_, ["snapshot_key", "object_id"], "left")
    return x | {"tables": t.withColumn("temporal_type", F.when(k == 5, 2).when(k == 6, 1).otherwise(0)).withColumn("history_table_id", F.when(k == 5, F.col("next_id"))).drop("next_id")}


_TIMES = "times AS (SELECT cust.sk, cust.tkey, next_t, split_part(next_t, ':', 6)[2:]::BIGINT AS nk FROM cust LEFT JOIN chain USING (ck) WHERE ck % 10 = 5)"
_mapped("b22_ms_temporal_history", lambda s, d: MS.temporal_links(_temporal(s, d))[0].select("from_key", "to_key", "extension_name"), "SELECT tkey AS from_key, next_t AS to_key, 'temporal_history_table' AS extension_name FROM times WHERE nk % 10 = 6", _TIMES)
_mapped("b22_ms_temporal_issues", lambda s, d: MS.temporal_links(_temporal(s, d))[1].select("snapshot_key", "code", "object_key"), "SELECT sk AS snapshot_key, CASE WHEN next_t IS NULL THEN 'temporal_history_missing' ELSE 'temporal_history_mismatch' END AS code, tkey AS object_key FROM times WHERE next_t IS NULL OR nk % 10 <> 6 UNION ALL SELECT sk, 'temporal_history_orphaned', tkey FROM cust WHERE ck % 10 = 6 AND tkey NOT IN (SELECT next_t FROM times WHERE next_t IS NOT NULL)", _TIMES)


def _xml(s, d):
    x = _sys(s, d)
    c = x["schemas"].select("snapshot_key", F.xxhash64(F.lit("xml"), "schema_id").alias("xml_collection_id"), "schema_id", F.lit("xc").alias("name"))
    n = c.select("snapshot_key", "xml_collection_id", F.posexplode(F.array(F.lit(""), F.lit("urn:a"))).alias("xml_namespace_id", "name"))
    return x | {"xml_schema_collections": c, "xml_schema_namespaces": n}


_mapped("b22_ms_xml", lambda s, d: MS.xml_collections(_xml(s, d)).select("parent_key", "name", "extension_kind"), "SELECT skey AS parent_key, 'xc' AS name, 'sqlserver_xml_schema_collection' AS extension_kind FROM nat UNION ALL SELECT pre || 'extension:xc:xml-schema-collection', unnest(['default namespace', 'urn:a']), 'sqlserver_xml_schema_namespace' FROM nat")


def _open(s, d):
    """Every ninth view has references that are only found when it runs, every seventh ambiguous ones; every third routine runs a text, the others only speak of it."""
    x = _sys(s, d)
    views = x["views"].select("snapshot_key", F.col("object_id").alias("referencing_id"), F.substring("name", 2, 20).cast("long").alias("k"))
    deps = x["sql_expression_dependencies"].join(views, ["snapshot_key", "referencing_id"], "left")
    deps = deps.withColumn("is_caller_dependent", F.coalesce(F.col("k") % 9 == 0, F.lit(False))).withColumn("is_ambiguous", F.coalesce(F.col("k") % 7 == 0, F.lit(False))).drop("k")
    k = F.substring("name", 2, 20).cast("long")
    body = F.when(k % 3 == 0, F.when(k % 2 == 0, "begin EXECUTE ( @sql ) end").otherwise("exec sys.sp_executesql @sql")).otherwise("-- exec (@sql)\nexec dbo.p @a = 1")
    return x | {"sql_expression_dependencies": deps, "sql_modules": x["objects"].select("snapshot_key", "object_id", body.alias("definition"))}


_mapped(
    "b29_ms_open_dependencies",
    lambda s, d: (lambda x: (lambda r: MS.open_dependencies(x, r[0], r[1]).select("object_key", "code"))(_resolved(x)))(_open(s, d)),
    "SELECT DISTINCT key AS object_key, 'dependency_closure_unproven' AS code FROM reach",
    "reach AS (SELECT key FROM rt WHERE pk % 3 = 0 UNION SELECT vdep.key FROM vdep JOIN vw USING (key) WHERE vk % 9 = 0 OR vk % 7 = 0 UNION SELECT vdep.key FROM vdep JOIN reach ON dep = reach.key)",
)
SQL["b29_ms_open_dependencies"] = SQL["b29_ms_open_dependencies"].replace("WITH", "WITH RECURSIVE", 1)

# Inventory of raw ids, placement and sub-partitions, whose tables other vendors have


def _lost_rows(s, d):
    """One table in thirteen is gone from the catalog, one in seventeen there twice."""
    x = _sys(s, d)
    k = F.substring("name", 2, 20).cast("long")
    t = x["tables"]
    return x | {"tables": t.where(k % 13 != 0).unionByName(t.where(k % 17 == 0).where(k % 13 != 0))}


_mapped("b32_ms_inventory", lambda s, d: INV.inventory(_lost_rows(s, d), "sqlserver").groupBy("snapshot_key", "code", F.regexp_extract("message", r"rows of (\S+)", 1).alias("place")).agg(F.count("*").alias("things"), F.sum(F.regexp_extract("message", r"^(\d+)", 1).cast("long")).alias("n")), "SELECT sk AS snapshot_key, 'duplicate_id' AS code, '' AS place, count(*) AS things, 2 * count(*) AS n FROM cust WHERE ck % 17 = 0 AND ck % 13 <> 0 GROUP BY sk UNION ALL SELECT sk, 'reference_missing', place, count(DISTINCT gone), count(*) FROM refs GROUP BY sk, place", "refs AS (SELECT sk, 'columns.object_id' AS place, tkey AS gone FROM col WHERE ck % 13 = 0 UNION ALL SELECT sk, CASE kind WHEN 'primary_key' THEN 'key_constraints' WHEN 'unique' THEN 'key_constraints' WHEN 'foreign_key' THEN 'foreign_keys' ELSE 'check_constraints' END || '.parent_object_id', tkey FROM con WHERE ck % 13 = 0 UNION ALL SELECT con.sk, 'foreign_keys.referenced_object_id', next_t FROM con JOIN chain USING (ck) WHERE kind = 'foreign_key' AND split_part(next_t, ':', 6)[2:]::BIGINT % 13 = 0 UNION ALL SELECT sk, 'indexes.object_id', tkey FROM ix WHERE ck % 13 = 0 UNION ALL SELECT sk, 'indexes.object_id', tkey FROM con WHERE kind IN ('primary_key', 'unique') AND ck % 13 = 0 UNION ALL SELECT sk, 'triggers.parent_id', tkey FROM tr WHERE ck % 13 = 0)")


def _lost_pg(s, d):
    """Relations of tables whose number divides by 13 are gone, and first columns of those whose number divides by 19."""
    x = _pg(s, d)
    k = F.substring("relname", 2, 20).try_cast("long")
    first = x["pg_class"].where((F.col("relkind") == "r") & (k % 19 == 0)).select("snapshot_key", F.col("oid").alias("attrelid"), F.lit(1).alias("attnum"))
    return x | {"pg_class": x["pg_class"].where(F.coalesce(~((F.col("relkind") == "r") & (k % 13 == 0)), F.lit(True))), "pg_attribute": x["pg_attribute"].join(first, ["snapshot_key", "attrelid", "attnum"], "left_anti")}


_mapped("b32_pg_inventory", lambda s, d: INV.inventory(_lost_pg(s, d), "postgres").groupBy("snapshot_key", "code", F.regexp_extract("message", r"rows of (\S+)", 1).alias("place")).agg(F.count("*").alias("things"), F.sum(F.regexp_extract("message", r"^(\d+)", 1).cast("long")).alias("n")), "SELECT sk AS snapshot_key, 'reference_missing' AS code, place, count(DISTINCT gone) AS things, count(*) AS n FROM refs GROUP BY sk, place", "cut AS (SELECT sk, ckey FROM col WHERE pos = 1 AND ck % 19 = 0)", "refs AS (SELECT sk, 'pg_attribute.attrelid' AS place, tkey AS gone FROM col WHERE ck % 13 = 0 AND NOT (pos = 1 AND ck % 19 = 0) UNION ALL SELECT sk, 'pg_constraint.conrelid', tkey FROM con WHERE ck % 13 = 0 UNION ALL SELECT con.sk, 'pg_constraint.confrelid', next_t FROM con JOIN chain USING (ck) WHERE kind = 'foreign_key' AND split_part(next_t, ':', 6)[2:]::BIGINT % 13 = 0 UNION ALL SELECT con_col.sk, 'pg_constraint.conkey', ckey FROM con_col JOIN cut USING (ckey) UNION ALL SELECT con.sk, 'pg_constraint.confkey', next_c FROM con JOIN chain USING (ck) JOIN cut ON cut.ckey = next_c WHERE kind = 'foreign_key' UNION ALL SELECT sk, 'pg_index.indrelid', tkey FROM ix WHERE ck % 13 = 0 UNION ALL SELECT ix_col.sk, 'pg_index.indkey', ckey FROM ix_col JOIN cut USING (ckey) UNION ALL SELECT sk, 'pg_trigger.tgrelid', tkey FROM tr WHERE ck % 13 = 0 UNION ALL SELECT sk, 'pg_depend.refobjid', dep FROM vdep WHERE dkind = 'TABLE' AND split_part(dep, ':', 6)[2:]::BIGINT % 13 = 0 UNION ALL SELECT sk, 'pg_depend.refobjid', regexp_replace(dep, ':column:(c[0-9]+):.*', ':table:\\1') FROM rdep WHERE split_part(dep, ':', 6)[2:]::BIGINT % 13 = 0)")


def _placed(s, d):
    """Three table spaces and a group for each nation; the group is in the second space, tables whose number divides by 4 in the third, by 7 in one that isn't there, the others in the database's default. Tables whose number divides by 3 belong to their nation's group, and views aren't stored."""
    x = _pg(s, d)
    long = lambda c: F.lit(c).cast("long")
    k = F.substring("relname", 2, 20).try_cast("long")
    spaces = x["databases"].select("snapshot_key", F.explode(F.sequence(long(1), long(3))).alias("oid")).select("snapshot_key", "oid", F.concat(F.lit("space"), F.col("oid").cast("string")).alias("spcname"), long(10).alias("spcowner"), F.array(F.lit("a=1"), F.lit("b=2")).alias("spcoptions"))
    groups = x["pg_namespace"].select("snapshot_key", "oid", F.concat(F.lit("g_"), "nspname").alias("grpname"), long(10).alias("grpowner"), long(2).alias("grptablespace"))
    rel = x["pg_class"].where("relkind in ('r', 'v')")
    placed = rel.select("snapshot_key", F.col("oid").alias("relid"), F.when(k % 4 == 0, long(3)).when(k % 7 == 0, long(99)).otherwise(long(0)).alias("reltablespace"), F.when(F.col("relkind") == "r", long(4)).alias("num_tablets"), F.lit(True).alias("is_colocated"), F.when((F.col("relkind") == "r") & (k % 3 == 0), F.col("relnamespace")).alias("tablegroup_oid"))
    return x | {"pg_tablespace": spaces, "pg_yb_tablegroup": groups, "yb_database": x["databases"].select("snapshot_key", F.when(F.col("snapshot_key") == "tpch:ASIA", long(77)).otherwise(long(1)).alias("dattablespace"), F.lit(True).alias("datcolocated")), "yb_relation": placed}


_SPACES = "spaces AS (SELECT sk, dkey, replace(dkey, ':w:database:w', ':w:extension:tablespace%3Aspace').replace('tpch:', 'v2:tpch:') AS stem FROM db)"
_GROUP = "'v2:' || regexp_replace(pre, ':[^:]*:$', ':w:extension:') || 'tablegroup%3Ag_' || nn"
_WHERE = "CASE WHEN ck % 4 = 0 THEN stem || '3' WHEN ck % 7 = 0 THEN NULL WHEN sk = 'tpch:ASIA' THEN NULL ELSE stem || '1' END"
_mapped("b24_placement_links", lambda s, d: PG.placement(_placed(s, d))[1].select("extension_name", "from_key", "to_key"), f"SELECT 'yugabytedb_default_tablespace' AS extension_name, dkey AS from_key, stem || '1' AS to_key FROM spaces WHERE sk <> 'tpch:ASIA' UNION ALL SELECT 'yugabytedb_uses_tablespace', {_GROUP}, stem || '2' FROM nat JOIN spaces USING (sk) UNION ALL SELECT 'yugabytedb_uses_tablespace', tkey, place FROM (SELECT tkey, {_WHERE} AS place FROM cust JOIN spaces USING (sk)) WHERE place IS NOT NULL UNION ALL SELECT 'yugabytedb_member_of_tablegroup', tkey, {_GROUP} FROM cust WHERE ck % 3 = 0", _SPACES)
_mapped("b24_placement_issues", lambda s, d: PG.placement(_placed(s, d))[3].select("code", "object_key"), f"SELECT 'default_tablespace_missing' AS code, dkey AS object_key FROM db WHERE sk = 'tpch:ASIA' UNION ALL SELECT 'tablespace_missing', tkey FROM cust JOIN spaces USING (sk) WHERE {_WHERE} IS NULL", _SPACES)
_mapped("b24_placement_objects", lambda s, d: (lambda got: got[0].select("key", "parent_key", "name", "extension_kind").unionByName(got[2].where("object_key like '%:table:%'").select(F.col("object_key").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.col("properties")["yugabytedb_effective_tablespace"]["value"].alias("name"), F.lit("annotation").alias("extension_kind"))))(PG.placement(_placed(s, d))), f"SELECT stem || i AS key, dkey AS parent_key, 'space' || i AS name, 'yugabytedb_tablespace' AS extension_kind FROM spaces, range(1, 4) r(i) UNION ALL SELECT {_GROUP}, dkey, 'g_' || nn, 'yugabytedb_tablegroup' FROM nat JOIN db USING (sk) UNION ALL SELECT tkey, NULL, 'space' || right({_WHERE}, 1), 'annotation' FROM cust JOIN spaces USING (sk)", _SPACES)


def _subpartitioned(s, d):
    """Tables whose number ends in 3 have two partitions with two sub-partitions each, those in 4 two partitions alone; some are of tables that aren't there."""
    x = _extract(s, d)
    k = F.substring("TABLE_NAME", 2, 20).try_cast("long") % 10
    base = x["tables"].where("TABLE_TYPE = 'BASE TABLE'").select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", k.alias("k"))
    rows = base.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("p")).select("*", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(None).cast("int")))).alias("q"))
    name = lambda c, n: F.concat(F.lit(c), F.col(n).cast("string"))
    named = F.col("k").isin(3, 4, 6)
    table = F.when(F.col("k") == 6, F.concat(F.lit("lost"), "TABLE_NAME")).otherwise(F.col("TABLE_NAME"))
    return x | {"partitions": rows.select("snapshot_key", "TABLE_SCHEMA", table.alias("TABLE_NAME"), F.when(named, name("p", "p")).alias("PARTITION_NAME"), F.when(named & F.col("q").isNotNull(), F.concat(name("p", "p"), name("s", "q"))).alias("SUBPARTITION_NAME"), F.col("p").alias("PARTITION_ORDINAL_POSITION"), F.col("q").alias("SUBPARTITION_ORDINAL_POSITION"), F.lit("RANGE").alias("PARTITION_METHOD"), F.lit("HASH").alias("SUBPARTITION_METHOD"), F.lit("a").alias("PARTITION_EXPRESSION"), F.lit("b").alias("SUBPARTITION_EXPRESSION"), F.col("p").cast("string").alias("PARTITION_DESCRIPTION"))}


_P = "parts AS (SELECT sk, ck, tkey, 'v2:' || pre || 'extension:c' || ck || ':partition%3Ap' || p AS pkey, p FROM cust, range(1, 3) r(p) WHERE ck % 10 IN (3, 4))"
_mapped("b19_subpartitions", lambda s, d: M.map_partitions(_subpartitioned(s, d))[0].select("key", "parent_key", "name", "extension_kind", "definition"), "SELECT pkey AS key, tkey AS parent_key, 'p' || p AS name, 'mysql_partition' AS extension_kind, 'a' AS definition FROM parts UNION ALL SELECT pkey || '%3Asubpartition%3Ap' || p || 's' || q, pkey, 'p' || p || 's' || q, 'mysql_subpartition', 'b' FROM parts, range(1, 3) r(q) WHERE ck % 10 = 3", _P)
_mapped("b19_subpartition_issues", lambda s, d: M.map_partitions(_subpartitioned(s, d))[1].select("code", "object_key"), "SELECT 'partition_table_missing' AS code, 'v2:' || pre || 'extension:lostc' || ck || ':partition%3Ap' || p AS object_key FROM cust, range(1, 3) r(p) WHERE ck % 10 = 6")
