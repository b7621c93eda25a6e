"""Registered queries over discovered counts and stored proofs, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import certify as C
from ..operators import discover as B
from ..operators import mapping as M
from ..operators import proof as P
from ..operators import store as S
from .fleet import graph
from .model import OBJECT_CATEGORIES, RELATION_CATEGORIES, Graph
from .oracles import over_fleet
from .queries_graph import _OBJECTS, _REL, _RELATIONS, _extract, _pg, _pg_parts, _programs
from .shared import new_path, written_all

Q: dict = {}
SQL: dict = {}

# Discovered counts

_SEEN_SCHEMAS = "(SELECT count(DISTINCT nn) FROM nat WHERE nat.sk = o.sk AND nk IN (SELECT nk FROM cust UNION SELECT nk FROM vw))"


def _counted(name: str, vendor: str, extract, domain: int, sql: str):
    Q[name] = lambda s, d: B.discovered(extract(s, d), vendor)[domain].select("snapshot_key", "category", "discovered")
    SQL[name] = over_fleet(sql, _OBJECTS, _REL, _RELATIONS)


_counted("b30_discovered_objects", "mysql", _extract, 0, f"SELECT sk AS snapshot_key, category, CASE WHEN category = 'schema' THEN {_SEEN_SCHEMAS} ELSE emitted END AS discovered FROM objects o")
_counted("b30_discovered_relations", "mysql", _extract, 1, f"SELECT sk AS snapshot_key, category, CASE WHEN category = 'database_has_schema' THEN {_SEEN_SCHEMAS} ELSE emitted END AS discovered FROM relations o")
_MORE = "CASE category WHEN 'sequence' THEN (SELECT count(*) FROM nat WHERE nat.sk = o.sk) WHEN 'principal' THEN 1 WHEN 'user_defined_type' THEN {types} WHEN 'enum_value' THEN {types} ELSE emitted END"
_TYPES = "(SELECT count(*) FROM nat JOIN (SELECT DISTINCT sk, prio FROM col) USING (sk) WHERE nat.sk = o.sk)"
_counted("b30_pg_discovered_objects", "postgres", _pg_parts, 0, f"SELECT sk AS snapshot_key, category, {_MORE.format(types=_TYPES)} AS discovered FROM objects o")
_LAST = "(SELECT count(*) FROM (SELECT key FROM ix_col JOIN ix USING (key) WHERE ix.sk = o.sk GROUP BY key HAVING count(*) > 1))"
_PG_LINKS = f"{_LAST} + (SELECT count(*) + count(*) FILTER (pos = 1) FROM col WHERE col.sk = o.sk) + (SELECT count(*) FROM chain JOIN cust USING (ck) WHERE cust.sk = o.sk AND next_t IS NOT NULL) + (SELECT 2 * count(*) FROM nat WHERE nat.sk = o.sk) + (SELECT count(*) FROM cust WHERE cust.sk = o.sk) + (SELECT count(*) FROM vw WHERE vw.sk = o.sk)"
_counted("b30_pg_discovered_relations", "postgres", _pg_parts, 1, f"SELECT sk AS snapshot_key, category, CASE category WHEN 'index_column' THEN emitted - {_LAST} WHEN 'metadata_parent' THEN 1 + (SELECT count(*) FROM nat WHERE nat.sk = o.sk) + 2 * {_TYPES} WHEN 'metadata_relationship' THEN {_PG_LINKS} ELSE emitted END AS discovered FROM relations o")


def c3_reconcile_mapped(s, d):
    """Of each vendor's extract the counts on raw rows against those of what is mapped from it: how many categories of each domain agree."""
    parts = []
    for vendor, x in (("mysql", _programs(s, d)), ("postgres", _pg_parts(s, d))):
        # Counts and mapping both read every raw table, some many times: their joins are worked out once, and the plans behind them are short.
        x = x | written_all(x)
        c = M.map_catalog(x, vendor)
        c = c.with_tables(**written_all({n: c.t[n] for n in ("tables", "columns", "constraints", "indexes", "views", "triggers", "routines", "metadata_objects", "relationships")}))
        for domain, seen, made in zip(("object", "relationship"), B.discovered(x, vendor), (C.emitted_objects(c), C.emitted_relations(c)), strict=True):
            both = made.join(seen, ["snapshot_key", "category"], "left")
            parts.append(both.groupBy("snapshot_key").agg(F.count("*").alias("categories"), F.count_if(F.col("emitted") == F.col("discovered")).alias("agreed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("emitted").eqNullSafe(F.col("discovered")), F.col("category")))), ",").alias("apart")).select("snapshot_key", F.lit(vendor).alias("vendor"), F.lit(domain).alias("domain"), "categories", "agreed", "apart"))
    return reduce(DataFrame.unionByName, parts)


Q["c3_reconcile_mapped"] = c3_reconcile_mapped
SQL["c3_reconcile_mapped"] = f"SELECT 'tpch:' || r_name AS snapshot_key, vendor, domain, n::BIGINT AS categories, n::BIGINT AS agreed, '' AS apart FROM region, (VALUES ('mysql'), ('postgres')) v(vendor), (VALUES ('object', {len(OBJECT_CATEGORIES)}), ('relationship', {len(RELATION_CATEGORIES)})) m(domain, n)"

# Stored proofs


def _proven(s, d) -> Graph:
    """The fleet as it is read back from a store with proofs: one region has none, one claims a contract without one, one's proof and one's edges are tampered with, and the last is in order."""
    g, x = graph(s, d), _pg(s, d)
    at = lambda n: F.col("snapshot_key") == f"tpch:{n}"
    names = F.array_sort(F.collect_list("nspname"))
    heads = x["pg_namespace"].groupBy("snapshot_key").agg(names.alias("schemas")).select("snapshot_key", F.lit("retail").alias("adapter"), F.lit("1").alias("adapter_version"), F.lit("srv").alias("server"), F.lit("9").alias("server_version"), F.array(F.lit("w")).alias("catalogs"), "schemas")
    checks = heads.select("snapshot_key", F.posexplode(F.array(F.lit("columns"), F.lit("tables"))).alias("position", "name"), F.lit("read").alias("evidence"))
    p = P.make_proof(heads, checks, B.discovered(x, "postgres"), P.stored_counts(g))
    proven = ~(at("AMERICA") | at("AFRICA"))
    more = (at("ASIA") & (F.col("category") == "table")).cast("long")
    p = P.Proof(p.heads.where(proven), p.counts.where(proven).withColumn("discovered", F.col("discovered") + more).withColumn("emitted", F.col("emitted") + more), p.checks.where(proven))
    claim = F.when(at("AFRICA"), '{"contract_version":2}').otherwise(F.col("payload_json"))
    path = new_path(s, "proven")
    S.write_snapshot(Graph(g.snapshots.withColumn("payload_json", claim), g.nodes, g.edges.where(~(at("EUROPE") & F.col("edge_type").isin("VIEW_DEPENDS_ON_TABLE", "VIEW_DEPENDS_ON_VIEW"))), p), path, "g")
    return S.read_graph(s, path)


_STATES = "states AS (SELECT 'tpch:' || r_name AS snapshot_key, CASE r_name WHEN 'AMERICA' THEN 'legacy_non_authoritative' WHEN 'AFRICA' THEN 'unverifiable' WHEN 'ASIA' THEN 'unverifiable' WHEN 'EUROPE' THEN 'unverifiable' ELSE 'complete' END AS authority, CASE WHEN r_name NOT IN ('AMERICA', 'AFRICA') THEN 2 END AS contract_version, CASE r_name WHEN 'AFRICA' THEN 'proof_missing:completeness' WHEN 'ASIA' THEN 'object_count_mismatch:object_counts.table' WHEN 'EUROPE' THEN 'relationship_count_mismatch:relationship_counts.view_dependency' ELSE '' END AS issues FROM region)"
Q["l14_authority"] = lambda s, d: P.authority(_proven(s, d)).withColumn("issues", F.array_join("issues", ","))
SQL["l14_authority"] = f"WITH {_STATES} SELECT snapshot_key, contract_version::INTEGER AS contract_version, authority, issues FROM states"
_LISTED = "listed AS (SELECT snapshot_key, contract_version::INTEGER AS contract_version, authority, issues, 'tpch' AS entrypoint_source, 'tpch' AS source, replace(snapshot_key, 'tpch:', '') AS alias, 0::BIGINT AS captured_at_unix_ms, (SELECT count(*) FROM nodes n WHERE n.sk = snapshot_key) AS objects, (SELECT count(*) FROM edges e WHERE e.sk = snapshot_key AND NOT (e.sk = 'tpch:EUROPE' AND edge_type LIKE 'VIEW_DEPENDS%')) AS relationships, CASE authority WHEN 'complete' THEN 'retail' END AS adapter, CASE authority WHEN 'complete' THEN 'srv' END AS server, CASE authority WHEN 'complete' THEN '9' END AS server_version FROM states)"
Q["l11_list_snapshots"] = lambda s, d: S.list_snapshots(_proven(s, d))
SQL["l11_list_snapshots"] = over_fleet("SELECT * EXCLUDE (issues) FROM listed", _STATES, _LISTED)


def l12_describe_snapshot(s, d):
    """Every region by key and by alias, and a name that is none."""
    r = s.read.parquet(f"{d}/region.parquet").select("r_name")
    asked = r.select(F.col("r_name").alias("selector")).unionByName(r.select(F.concat(F.lit("tpch:"), "r_name").alias("selector"))).unionByName(r.select(F.concat(F.lit("no "), "r_name").alias("selector")))
    return S.describe_snapshots(_proven(s, d), asked).withColumn("issues", F.array_join("issues", ","))


def _json(table: str, names: list[str]) -> str:
    return f"(SELECT '[' || string_agg('{{\"category\":\"' || category || '\",\"discovered\":' || emitted || ',\"emitted\":' || emitted || '}}', ',' ORDER BY list_position({names}, category)) || ']' FROM {table} WHERE sk = snapshot_key)"


#: The evidence texts are the operator's own; the rest of the proof is compared whole.
Q["l12_describe_snapshot"] = lambda s, d: l12_describe_snapshot(s, d).withColumn("completeness", F.regexp_replace("completeness", ',"evidence":"[^"]*"(?=\\},\\{"category|\\}\\],"(?:relationship_counts|capability_checks))', ""))
SQL["l12_describe_snapshot"] = over_fleet(
    f"""SELECT selector, CASE WHEN snapshot_key IS NULL THEN 'not_found' ELSE 'found' END AS status, l.*,
    CASE authority WHEN 'complete' THEN '{{"contract_version":2,"adapter":{{"name":"retail","version":"1"}},"server":{{"name":"srv","version":"9"}},"scope":{{"catalogs":["w"],"schemas":[' || (SELECT string_agg('"' || nn || '"', ',' ORDER BY nn) FROM nat WHERE nat.sk = snapshot_key) || ']}},"object_counts":' || {_json("objects", OBJECT_CATEGORIES)} || ',"relationship_counts":' || {_json("relations", RELATION_CATEGORIES)} || ',"capability_checks":[{{"name":"columns","evidence":"read"}},{{"name":"tables","evidence":"read"}}]}}' END AS completeness
    FROM (SELECT r_name AS selector, 'tpch:' || r_name AS k FROM region UNION ALL SELECT 'tpch:' || r_name, 'tpch:' || r_name FROM region UNION ALL SELECT 'no ' || r_name, NULL FROM region) a LEFT JOIN listed l ON snapshot_key = k""",
    _STATES, _LISTED, _OBJECTS, _REL, _RELATIONS,
)
