"""Registered queries over extracts read as a data source and over bounded result envelopes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import envelopes as E
from ..operators import mapping as M
from ..operators import traverse as G
from ..sources.catalog_source import read_catalog, write_extract
from .fleet import graph
from .oracles import bounded_levels, bounded_paths, over_both, over_fleet
from .queries_graph import _extract
from .queries_store import _DIFF, _SEEDED, _TABLES, ASIA, _pairs, _tables, _two
from .shared import new_path

Q: dict = {}
SQL: dict = {}

# Extracts


def _written(s, d) -> str:
    """The fleet's extract as a server's tables would be dumped, database by database."""
    path = new_path(s, "extract")
    write_extract({n.upper(): df for n, df in _extract(s, d).items() if n in ("tables", "columns", "table_constraints", "key_column_usage")}, path)
    return path


Q["s1_catalog_source"] = lambda s, d: read_catalog(s, _written(s, d), "COLUMNS", "mysql").select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", F.col("ORDINAL_POSITION").cast("int").alias("ordinal"))
SQL["s1_catalog_source"] = over_fleet("SELECT sk AS snapshot_key, nn AS TABLE_SCHEMA, 'c' || ck AS TABLE_NAME, 'o' || ok AS COLUMN_NAME, pos::INTEGER AS ordinal FROM col")


def s1_pushed_filters(s, d):
    x = read_catalog(s, _written(s, d), "TABLES", "mysql")
    return x.where(F.col("snapshot_key").isin("tpch:ASIA", "tpch:EUROPE") & F.col("TABLE_SCHEMA").isin("NATION_2", "NATION_7", "NATION_12", "NATION_13") & (F.col("TABLE_TYPE") == "BASE TABLE")).select("snapshot_key", "TABLE_SCHEMA", "TABLE_NAME")


Q["s1_pushed_filters"] = s1_pushed_filters
SQL["s1_pushed_filters"] = over_fleet("SELECT sk AS snapshot_key, nn AS TABLE_SCHEMA, 'c' || ck AS TABLE_NAME FROM cust WHERE sk IN ('tpch:ASIA', 'tpch:EUROPE') AND nn IN ('NATION_2', 'NATION_7', 'NATION_12', 'NATION_13')")


def s1_mapped(s, d):
    path = _written(s, d)
    x = _extract(s, d) | {n: read_catalog(s, path, n.upper(), "mysql") for n in ("tables", "table_constraints", "key_column_usage")}
    return M.map_constraints(x).select("key", "table_key", "kind", F.array_join("columns", "|").alias("columns"))


Q["s1_mapped"] = s1_mapped
SQL["s1_mapped"] = over_fleet("SELECT con.key, con.tkey AS table_key, con.kind, string_agg(ckey, '|' ORDER BY pos) AS columns FROM con JOIN con_col USING (key) GROUP BY con.key, con.tkey, con.kind")

# Envelopes

_BOUNDS = lambda depth, limit: f'"direction":"both","max_depth":{min(depth, 8)},"depth_requested":{depth},"depth_applied":{min(depth, 8)},"depth_clamped":{str(depth > 8).lower()},"result_limit_requested":{limit},"result_limit_applied":{min(limit, 200)},"result_limit_clamped":{str(limit > 200).lower()}'
_HIT = """'{"node_key":"' || h.node || '","label":"' || label || '","display_name":"' || display_name || '","depth":' || depth || ',"edge_type_used":"' || edge_type || '","edge_from":"' || edge_from || '","edge_to":"' || edge_to || '"}'"""
Q["s12_impact_json"] = lambda s, d: E.impact_envelopes(graph(s, d), _tables(s, d), "both", 2, 30)
SQL["s12_impact_json"] = over_fleet(
    f"""SELECT e.sk AS snapshot_key, e.seed, '{{"snapshot_key":"' || e.sk || '","object_key":"' || e.seed || '",{_BOUNDS(2, 30)},"truncated":' || e.truncated || ',"groups":[' || coalesce(string_agg(g.text, ',' ORDER BY g.depth, g.label), '') || ']}}' AS json
    FROM end2 e LEFT JOIN (SELECT h.sk, h.seed, depth, label, '{{"label":"' || label || '","depth":' || depth || ',"nodes":[' || string_agg({_HIT}, ',' ORDER BY position) || ']}}' AS text FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) h JOIN nodes n ON n.node_key = h.node GROUP BY h.sk, h.seed, depth, label) g ON g.sk = e.sk AND g.seed = e.seed
    GROUP BY e.sk, e.seed, e.truncated""",
    *bounded_levels(_TABLES, 2, 30),
)
_EDGE = "ord[i - 1][2:]"
_HOP = f"""'{{"node_key":"' || path[i] || '","label":"' || label || '","edge_type_used":' || CASE WHEN i = 1 THEN 'null,"edge_from":null,"edge_to":null' ELSE '"' || split_part({_EDGE}, ':', 1) || '","edge_from":"' || regexp_extract({_EDGE}, '^[A-Z_]*:(.*)->', 1) || '","edge_to":"' || regexp_extract({_EDGE}, '->(.*)$', 1) || '"' END || '}}'"""
Q["s12_trace_json"] = lambda s, d: E.trace_envelopes(graph(s, d), _tables(s, d), "both", 2, 12)
SQL["s12_trace_json"] = over_fleet(
    f"""SELECT e.sk AS snapshot_key, e.seed, '{{"snapshot_key":"' || e.sk || '","object_key":"' || e.seed || '",{_BOUNDS(2, 12)},"truncated":' || e.truncated || ',"paths":[' || coalesce(string_agg(p.text, ',' ORDER BY p.depth, p.position), '') || ']}}' AS json
    FROM end2 e LEFT JOIN (SELECT h.sk, seed, depth, position, '{{"hops":[' || string_agg({_HOP}, ',' ORDER BY i) || ']}}' AS text FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)) h JOIN nodes n ON n.node_key = path[i] GROUP BY h.sk, seed, depth, position) p ON p.sk = e.sk AND p.seed = e.seed
    GROUP BY e.sk, e.seed, e.truncated""",
    *bounded_paths(_TABLES, 2, 12),
)


def s12_diff_json(s, d):
    """The envelope's counts, flags and lists, read back from its JSON."""
    got = E.diff_envelopes(_two(s, d), _pairs(s, d), 20)
    at = lambda p: F.get_json_object("json", f"$.{p}")
    keys = lambda name, key: F.array_join(F.transform(F.from_json(at(name), f"array<struct<{key}:string>>"), lambda x: x[key]), ",")
    impact = F.from_json(at("impacted"), "array<struct<seed_node_key:string,impact:array<struct<node_key:string>>>>")
    return got.select("pair", at("from_snapshot_key").alias("a"), at("to_snapshot_key").alias("b"), *[at(f"counts.{n}").cast("long").alias(n) for n in ("nodes_added", "nodes_removed", "nodes_changed", "edges_removed", "impacted_seeds")], at("result_limit_applied").cast("int").alias("limit_applied"), keys("removed_nodes", "node_key").alias("removed"), keys("changed_nodes", "node_key").alias("changed"), F.array_join(F.transform(impact, lambda x: x.seed_node_key), ",").alias("seeds"), F.aggregate(impact, F.lit(0), lambda n, x: n + F.size(x.impact)).cast("long").alias("hits"))


_COUNT = lambda table, change: f"(SELECT count(*) FROM {table} WHERE pair = reg.sk AND change = '{change}')"
_FIRST = lambda of: f"coalesce((SELECT string_agg(node_key, ',' ORDER BY ckey) FROM (SELECT node_key, ckey FROM {of} WHERE pair = reg.sk ORDER BY ckey LIMIT 20)), '')"
_REMOVED = "gone AS (SELECT pair, ckey, node_key FROM dn WHERE change = 'removed')"
Q["s12_diff_json"] = s12_diff_json
SQL["s12_diff_json"] = over_both(
    f"SELECT replace(reg.sk, 'tpch:', '') AS pair, reg.sk AS a, reg.sk || '_v2' AS b, {_COUNT('dn', 'added')} AS nodes_added, {_COUNT('dn', 'removed')} AS nodes_removed, (SELECT count(*) FROM changed WHERE pair = reg.sk) AS nodes_changed, {_COUNT('de', 'removed')} AS edges_removed, {_COUNT('dn', 'added')} + {_COUNT('dn', 'removed')} + (SELECT count(*) FROM changed WHERE pair = reg.sk) AS impacted_seeds, 20::INTEGER AS limit_applied, {_FIRST('gone')} AS removed, {_FIRST('changed')} AS changed, coalesce((SELECT string_agg(seed, ',' ORDER BY k) FROM dseeds WHERE pair = reg.sk), '') AS seeds, (SELECT count(*) FROM hits JOIN budgets USING (pair, k) WHERE position <= budget AND pair = reg.sk) AS hits FROM reg",
    *_DIFF, _REMOVED, *_SEEDED,
).replace("WITH", "WITH RECURSIVE", 1)

# G6 with a start, and with all of its parts; G9: what is asked for beyond the bounds


def _from_start(s, d):
    g = graph(s, d)
    start = g.nodes.where("label = 'Table' and snapshot_key = 'tpch:ASIA'").selectExpr("min(node_key)").first()[0]
    rows, envelope = G.query_graph(g, ASIA, G.Query(start=start, direction="both", depth=99, limit=40, edge_type="TABLE_HAS_COLUMN"))
    return rows.withColumn("depth_applied", F.lit(envelope["depth_applied"])).withColumn("limit_clamped", F.lit(envelope["limit_clamped"])).withColumn("truncated", F.lit(envelope["truncated"]))


Q["g6_query_start"] = _from_start
SQL["g6_query_start"] = over_fleet("SELECT 'hit' AS part, ckey AS key, 'Column' AS kind, 1 AS depth, 8 AS depth_applied, false AS limit_clamped, (SELECT count(*) > 40 FROM col WHERE tkey = (SELECT min(tkey) FROM cust WHERE sk = 'tpch:ASIA')) AS truncated FROM col WHERE tkey = (SELECT min(tkey) FROM cust WHERE sk = 'tpch:ASIA') ORDER BY ckey LIMIT 40")


def _three_parts(s, d):
    g = graph(s, d)
    nodes, first = G.query_graph(g, ASIA, G.Query(label="View", limit=7))
    both, second = G.query_graph(g, ASIA, G.Query(label="View", edge_type="VIEW_DEPENDS_ON_TABLE", limit=7))
    return nodes.withColumn("asked", F.lit("nodes")).withColumn("truncated", F.lit(first["truncated"])).unionByName(both.withColumn("asked", F.lit("both")).withColumn("truncated", F.lit(second["truncated"])))


Q["g6_query_parts"] = _three_parts
_VIEWS = "SELECT key, row_number() OVER (ORDER BY key) AS i, count(*) OVER () AS n FROM vw WHERE sk = 'tpch:ASIA'"
_USES = "SELECT edge_key AS key, row_number() OVER (ORDER BY edge_key) AS i, count(*) OVER () AS n FROM edges WHERE sk = 'tpch:ASIA' AND edge_type = 'VIEW_DEPENDS_ON_TABLE'"
_LEFT = "greatest(0, 7 - (SELECT least(7, count(*)) FROM vw WHERE sk = 'tpch:ASIA'))"
_CUT = f"(SELECT (SELECT count(*) FROM vw WHERE sk = 'tpch:ASIA') > 7 OR (SELECT count(*) FROM edges WHERE sk = 'tpch:ASIA' AND edge_type = 'VIEW_DEPENDS_ON_TABLE') > {_LEFT})"
SQL["g6_query_parts"] = over_fleet(f"SELECT 'node' AS part, key, 'View' AS kind, NULL::INTEGER AS depth, 'nodes' AS asked, n > 7 AS truncated FROM ({_VIEWS}) WHERE i <= 7 UNION ALL SELECT 'node', key, 'View', NULL, 'both', {_CUT} FROM ({_VIEWS}) WHERE i <= 7 UNION ALL SELECT 'edge', key, 'VIEW_DEPENDS_ON_TABLE', NULL, 'both', {_CUT} FROM ({_USES}) WHERE i <= {_LEFT}")
