"""Registered queries over the store, traversals, diffs and descriptions, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as T
from ..operators import diff as D
from ..operators import store as S
from ..operators import traverse as G
from .fleet import catalog, graph
from .model import SCHEMAS, Graph
from .oracles import PRIORITY, bounded_levels, bounded_paths, budget_of_hits, levels, over_both, over_fleet
from .shared import new_path

Q: dict = {}
SQL: dict = {}
ASIA = "tpch:ASIA"


def _q(name: str, f, sql: str | None = None):
    Q[name] = f
    if sql is not None:
        SQL[name] = sql


# Sinks


def _stored(s, d):
    """Three generations written and read back: the first has all snapshots, the later ones that of one region; the last of them, g10, is in force though g9 sorts behind it."""
    g, path = graph(s, d), new_path(s, "store")
    S.write_snapshot(g, path, "g1")
    last = Graph(*[x.where(F.col("snapshot_key") == ASIA) for x in (g.snapshots, g.nodes, g.edges)])
    S.write_snapshot(Graph(last.snapshots, last.nodes.where("label = 'Schema'"), last.edges), path, "g9")
    S.write_snapshot(Graph(last.snapshots, last.nodes.where("label <> 'Column'"), last.edges), path, "g10")
    return S.read_graph(s, path)


_q("s9_write_snapshot", lambda s, d: _stored(s, d).nodes.groupBy("snapshot_key", "label").agg(F.count("*").alias("n")), over_fleet("SELECT sk AS snapshot_key, label, count(*) AS n FROM nodes WHERE NOT (sk = 'tpch:ASIA' AND label = 'Column') GROUP BY ALL"))


def s10_upsert(s, d):
    g = graph(s, d)
    new = g.nodes.where("label = 'Table'").withColumn("display_name", F.concat("display_name", F.lit("_new")))
    moved = new.withColumn("node_key", F.concat("node_key", F.lit("x"))).where("snapshot_key = 'tpch:ASIA'")
    return S.upsert(g.nodes, new.unionByName(moved), ["snapshot_key", "node_key"]).select("node_key", "label", "display_name")


_q("s10_upsert", s10_upsert, over_fleet("SELECT node_key, label, CASE WHEN label = 'Table' THEN display_name || '_new' ELSE display_name END AS display_name FROM nodes UNION ALL SELECT node_key || 'x', label, display_name || '_new' FROM nodes WHERE label = 'Table' AND sk = 'tpch:ASIA'"))


def s11_delete(s, d):
    g = graph(s, d)
    g = S.delete_snapshot(g, s.createDataFrame([("tpch:EUROPE",)], "snapshot_key string"))
    g = S.delete_nodes(g, g.nodes.where("label = 'Index'").select("snapshot_key", "node_key"))
    g = S.delete_edges(g, g.edges.where("edge_type = 'TRIGGER_ON_TABLE'").select("snapshot_key", "edge_key"))
    return S.counts(g)


_q("s11_delete", s11_delete, over_fleet("SELECT sk AS snapshot_key, count(*) FILTER (kind = 'n') AS nodes, count(*) FILTER (kind = 'e') AS edges FROM (SELECT sk, 'n' AS kind FROM nodes WHERE label <> 'Index' UNION ALL SELECT sk, 'e' FROM edges WHERE edge_type NOT IN ('TRIGGER_ON_TABLE', 'TABLE_HAS_INDEX', 'COLUMN_IN_INDEX')) WHERE sk <> 'tpch:EUROPE' GROUP BY sk"))
_q("s12_json_rows", lambda s, d: S.to_json_rows(graph(s, d).nodes.select("node_key", "label", F.lit(None).cast("string").alias("note")), "node_key"), over_fleet("""SELECT node_key, '{"node_key":"' || node_key || '","label":"' || label || '","note":null}' AS json FROM nodes"""))

# Lookups

_NODE = "SELECT sk AS snapshot_key, node_key, label, display_name FROM nodes"
_show = lambda df: df.select("snapshot_key", "node_key", "label", "display_name")
_q("l1_node", lambda s, d: _show(S.node(graph(s, d), ASIA, "tpch:ASIA:w:w:database:w")), over_fleet(_NODE + " WHERE node_key = 'tpch:ASIA:w:w:database:w'"))
_q("l2_nodes", lambda s, d: _show(S.nodes(graph(s, d), ASIA, "View")), over_fleet(_NODE + " WHERE sk = 'tpch:ASIA' AND label = 'View'"))
_q("l3_edges", lambda s, d: S.edges(graph(s, d), ASIA, edge_type="FK_TO_COLUMN").select("edge_key", "edge_from", "edge_to"), over_fleet("SELECT edge_key, edge_from, edge_to FROM edges WHERE sk = 'tpch:ASIA' AND edge_type = 'FK_TO_COLUMN'"))


def _adjacent(direction: str, n: int, edge_type: str | None = None):
    def f(s, d):
        g = graph(s, d)
        return S.adjacent(g, g.nodes.where("label in ('Table', 'Schema')").select("snapshot_key", "node_key"), direction, n, edge_type).select("edge_key", "place")

    end = "edge_from" if direction == "outbound" else "edge_to"
    where = f"edge_type = '{edge_type}'" if edge_type else "true"
    order = "edge_key" if edge_type else f"{PRIORITY}, edge_key"
    return f, over_fleet(f"SELECT edge_key, place::INTEGER AS place FROM (SELECT edge_key, row_number() OVER (PARTITION BY {end} ORDER BY {order}) AS place FROM edges JOIN nodes ON node_key = {end} WHERE label IN ('Table', 'Schema') AND {where}) WHERE place <= {n}")


_q("l4_adjacent", *_adjacent("outbound", 5))
_q("l4_adjacent_inbound", *_adjacent("inbound", 3))
_q("l5_adjacent_of_type", *_adjacent("outbound", 4, "TABLE_HAS_COLUMN"))
_q("l6_counts", lambda s, d: S.counts(graph(s, d)), over_fleet("SELECT sk AS snapshot_key, (SELECT count(*) FROM nodes n WHERE n.sk = reg.sk) AS nodes, (SELECT count(*) FROM edges e WHERE e.sk = reg.sk) AS edges FROM reg"))


def _page(f):
    def run(s, d):
        rows, envelope = f(s, d)
        return rows.select("node_key", "label").withColumn("total", F.lit(envelope["total"]).cast("long")).withColumn("has_more", F.lit(envelope["has_more"]))

    return run


_q("l7_list_objects", _page(lambda s, d: S.list_objects(graph(s, d), ASIA, offset=40, limit=60)), over_fleet("SELECT node_key, label, (SELECT count(*) FROM nodes WHERE sk = 'tpch:ASIA') AS total, (SELECT count(*) > 100 FROM nodes WHERE sk = 'tpch:ASIA') AS has_more FROM (SELECT * FROM nodes WHERE sk = 'tpch:ASIA' ORDER BY label, node_key LIMIT 60 OFFSET 40)"))
_q("l7_list_objects_of_kind", _page(lambda s, d: S.list_objects(graph(s, d), ASIA, "index", "URGENT", limit=50)), over_fleet("SELECT node_key, label, (SELECT count(*) FROM nodes WHERE sk = 'tpch:ASIA' AND label = 'Index' AND contains(lower(node_key), 'urgent')) AS total, (SELECT count(*) > 50 FROM nodes WHERE sk = 'tpch:ASIA' AND label = 'Index' AND contains(lower(node_key), 'urgent')) AS has_more FROM (SELECT * FROM nodes WHERE sk = 'tpch:ASIA' AND label = 'Index' AND contains(lower(node_key), 'urgent') ORDER BY node_key LIMIT 50)"))
_q("l8_find_objects", lambda s, d: _show(S.find_objects(graph(s, d), "TABLE:C1")), over_fleet(_NODE + " WHERE contains(lower(node_key), 'table:c1')"))
_q("l9_object_summary", lambda s, d: S.object_summary(graph(s, d).nodes.withColumn("label", F.when(F.col("node_key").rlike(":view:s.*3$"), "Table").otherwise(F.col("label")))).select("node_key", "kind", "schema", "object_name", "sub_object", "status"), over_fleet("SELECT node_key, string_split(node_key, ':')[5] AS kind, string_split(node_key, ':')[4] AS \"schema\", string_split(node_key, ':')[6] AS object_name, string_split(node_key, ':')[7] AS sub_object, CASE WHEN regexp_matches(node_key, ':view:s.*3$') THEN 'invalid_metadata' ELSE 'ok' END AS status FROM nodes"))
_q("l10_describe_objects", lambda s, d: (lambda g: S.describe_objects(g, g.nodes.where("label = 'View'").select("snapshot_key", "node_key"), 10).select("node_key", "direction", "place", "edge_type", "related_key", "related_label", "truncated"))(graph(s, d)), over_fleet(f"SELECT node_key, direction, place::INTEGER AS place, edge_type, related_key, label AS related_label, truncated FROM (SELECT own AS node_key, direction, edge_type, other AS related_key, row_number() OVER w AS place, count(*) OVER (PARTITION BY own, direction) > 10 AS truncated FROM (SELECT edge_from AS own, edge_to AS other, 'outbound' AS direction, edge_type, edge_key FROM edges UNION ALL SELECT edge_to, edge_from, 'inbound', edge_type, edge_key FROM edges) JOIN vw ON vw.key = own WINDOW w AS (PARTITION BY own, direction ORDER BY {PRIORITY}, edge_key)) x JOIN (SELECT node_key AS k, label FROM nodes) n ON k = related_key WHERE place <= 10"))


def l13_resolve_snapshots(s, d):
    g, r = graph(s, d), s.read.parquet(f"{d}/region.parquet")
    twin = g.snapshots.where("snapshot_key = 'tpch:ASIA'").withColumn("snapshot_key", F.lit("pg:ASIA"))
    selectors = r.select(F.col("r_name").alias("selector")).unionByName(r.select(F.concat(F.lit("tpch:"), F.col("r_name")).alias("selector"))).unionByName(r.select(F.concat(F.lit("no "), F.col("r_name")).alias("selector")))
    return S.resolve_snapshots(Graph(g.snapshots.unionByName(twin), g.nodes, g.edges), selectors)


_q("l13_resolve_snapshots", l13_resolve_snapshots, "SELECT selector, status, snapshot_key, candidates FROM (SELECT r_name AS selector, CASE WHEN r_name = 'ASIA' THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN r_name <> 'ASIA' THEN 'tpch:' || r_name END AS snapshot_key, CASE WHEN r_name = 'ASIA' THEN 'pg:ASIA,tpch:ASIA' END AS candidates FROM region UNION ALL SELECT 'tpch:' || r_name, 'found', 'tpch:' || r_name, NULL FROM region UNION ALL SELECT 'no ' || r_name, 'not_found', NULL, NULL FROM region)")
_q("l15_graph_stats", lambda s, d: S.graph_stats(graph(s, d)), over_fleet("SELECT 5::BIGINT AS snapshots, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"))
_q("l17_stored_capabilities", lambda s, d: S.stored_capabilities(graph(s, d).snapshots, SCHEMAS["capabilities"].replace("snapshot_key string, ", "")).select("snapshot_key", "source_kind", "metadata_only", "views", F.size("limitations").alias("limitations")), over_fleet("SELECT sk AS snapshot_key, 'tpch' AS source_kind, true AS metadata_only, 'supported' AS views, 0::INTEGER AS limitations FROM reg"))

# Traversals: from every table, or from every routine and trigger (whose walks both ways don't all pass through a schema's tables).

_TABLES, _BODIES = "SELECT sk, tkey AS seed FROM cust", "SELECT sk, key AS seed FROM rt UNION ALL SELECT sk, key FROM tr"


def _tables(s, d):
    return catalog(s, d).tables.select("snapshot_key", F.col("key").alias("seed"))


def _bodies(s, d):
    c = catalog(s, d)
    return c.routines.unionByName(c.triggers, True).select("snapshot_key", F.col("key").alias("seed"))


def _hops(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT sk, seed, node, edge_key, edge_type, depth FROM hop{k}" for k in range(1, depth + 1))


def _impact(seeds, of: str, direction: str, depth: int):
    f = lambda s, d: G.impact_many(graph(s, d), seeds(s, d), direction, depth).select("snapshot_key", "seed", "node_key", "label", "depth", "edge_type", "edge_key")
    sql = f"SELECT h.sk AS snapshot_key, seed, h.node AS node_key, label, depth::INTEGER AS depth, edge_type, edge_key FROM ({_hops(depth)}) h JOIN nodes n ON n.node_key = h.node"
    return f, over_fleet(sql, *levels(of, depth, direction))


_q("g1_impact_outbound", *_impact(_tables, _TABLES, "outbound", 2))
_q("g1_impact_inbound", *_impact(_tables, _TABLES, "inbound", 3))
_q("g3_impact_many", *_impact(_bodies, _BODIES, "both", 2))


def g1_grouped(s, d):
    return G.impact_many(graph(s, d), _bodies(s, d), "both", 2).groupBy("snapshot_key", "seed", "label", "depth").agg(F.count("*").alias("n"), F.min("node_key").alias("first_key"))


_q("g1_grouped", g1_grouped, over_fleet(f"SELECT h.sk AS snapshot_key, seed, label, depth::INTEGER AS depth, count(*) AS n, min(h.node) AS first_key FROM ({_hops(2)}) h JOIN nodes n ON n.node_key = h.node GROUP BY ALL", *levels(_BODIES, 2)))


def _all_hops(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM hop{k}" for k in (1, 2, 3))


_HITS = f"SELECT h.sk AS snapshot_key, seed, node AS node_key, label, display_name, depth::INTEGER AS depth, edge_type, edge_from, edge_to, position::BIGINT AS position FROM ({_all_hops('sk, seed, node, depth, edge_type, edge_from, edge_to, position')}) h JOIN nodes n ON n.sk = h.sk AND n.node_key = h.node"
_q("g2_impact_bounded", lambda s, d: G.impact_bounded(graph(s, d), _tables(s, d), "both", 3, 60).hits, over_fleet(_HITS, *bounded_levels(_TABLES, 3, 60)))
_q("g2_ends", lambda s, d: G.impact_bounded(graph(s, d), _tables(s, d), "both", 3, 60).ends, over_fleet("SELECT sk AS snapshot_key, seed, used::BIGINT AS used, truncated FROM end3", *bounded_levels(_TABLES, 3, 60)))
_q("g4_trace", lambda s, d: G.trace_many(graph(s, d), _tables(s, d), "outbound", 3).select("seed", "depth", F.concat_ws("|", F.transform("path", lambda h: h.node)).alias("nodes"), F.concat_ws("|", F.transform("path", lambda h: h.edge_type)).alias("edges")), over_fleet("SELECT seed, depth::INTEGER AS depth, array_to_string(path, '|') AS nodes, array_to_string(types, '|') AS edges FROM walk WHERE depth > 0", f"walk0 AS ({_TABLES})", *[f"walk{k} AS (SELECT w.sk, w.seed, {k} AS depth, list_append(w.path, e.edge_to) AS path, list_append(w.types, e.edge_type) AS types FROM {'(SELECT sk, seed, [seed] AS path, []::VARCHAR[] AS types FROM walk0)' if k == 1 else f'walk{k - 1}'} w JOIN edges e ON e.sk = w.sk AND e.edge_from = w.path[-1] WHERE NOT list_contains(w.path, e.edge_to))" for k in (1, 2, 3)], "walk AS (SELECT * FROM walk1 UNION ALL SELECT * FROM walk2 UNION ALL SELECT * FROM walk3)"))
_q("g5_trace_bounded", lambda s, d: G.trace_bounded(graph(s, d), _tables(s, d), "both", 3, 50).hits.select("seed", "depth", "position", F.concat_ws("|", F.transform("path", lambda h: h.node)).alias("nodes")), over_fleet(f"SELECT seed, depth::INTEGER AS depth, position::BIGINT AS position, array_to_string(path, '|') AS nodes FROM ({_all_hops('seed, depth, position, path')})", *bounded_paths(_TABLES, 3, 50)))


def _asked(q: G.Query):
    return lambda s, d: (lambda got: got[0].withColumn("truncated", F.lit(got[1]["truncated"])))(G.query_graph(graph(s, d), ASIA, q))


_q("g6_query_nodes", _asked(G.Query(label="Index", name_contains="URGENT", array_field="columns", array_min=2, limit=500)), over_fleet("SELECT 'node' AS part, key, 'Index' AS kind, NULL::INTEGER AS depth, (SELECT count(*) > 500 FROM ix WHERE sk = 'tpch:ASIA' AND prio LIKE '%URGENT%' AND n >= 2) AS truncated FROM ix WHERE sk = 'tpch:ASIA' AND prio LIKE '%URGENT%' AND n >= 2 ORDER BY key LIMIT 500"))
_q("g6_query_edges", _asked(G.Query(edge_type="TABLE_HAS_TRIGGER", limit=20)), over_fleet("SELECT 'edge' AS part, edge_key AS key, edge_type AS kind, NULL::INTEGER AS depth, (SELECT count(*) > 20 FROM edges WHERE sk = 'tpch:ASIA' AND edge_type = 'TABLE_HAS_TRIGGER') AS truncated FROM edges WHERE sk = 'tpch:ASIA' AND edge_type = 'TABLE_HAS_TRIGGER' ORDER BY edge_key LIMIT 20"))
_q("g7_filtered_traversal", lambda s, d: G.filtered_traversal(graph(s, d), _tables(s, d), "both", 3, 25).hits.select("seed", "node_key", "depth", "edge_key"), over_fleet(f"SELECT seed, node AS node_key, depth::INTEGER AS depth, edge_key FROM ({_all_hops('seed, node, depth, edge_key')})", *budget_of_hits(_TABLES, 3, 25)))


def g8_resolve_starts(s, d):
    t = catalog(s, d).tables
    text = F.lit(None).cast("string")
    r = t.select("snapshot_key", F.col("key").alias("object_key"), text.alias("table_name"), text.alias("column_name")).unionByName(t.select("snapshot_key", text.alias("object_key"), F.concat("name", F.lit("0")).alias("table_name"), text.alias("column_name"))).unionByName(t.select("snapshot_key", text.alias("object_key"), text.alias("table_name"), F.regexp_replace("name", "^c", "o").alias("column_name")))
    return G.resolve_starts(graph(s, d), r)


_q("g8_resolve_starts", g8_resolve_starts, over_fleet("SELECT r.sk AS snapshot_key, object_key, table_name, column_name, CASE WHEN hit IS NOT NULL THEN 'found' ELSE 'not_found' END AS status, hit AS start FROM (SELECT sk, tkey AS object_key, NULL::VARCHAR AS table_name, NULL::VARCHAR AS column_name, tkey AS hit FROM cust UNION ALL SELECT sk, NULL, 'c' || ck || '0', NULL, (SELECT tkey FROM cust x WHERE x.ck = cust.ck * 10 AND cust.ck > 0 AND x.sk = cust.sk) FROM cust UNION ALL SELECT sk, NULL, NULL, 'o' || ck, (SELECT ckey FROM col x WHERE x.ok = cust.ck AND x.sk = cust.sk) FROM cust) r"))

# Diffs of each region's two generations


def _two(s, d) -> Graph:
    a, b = graph(s, d), graph(s, d, 2)
    return Graph(a.snapshots.unionByName(b.snapshots), a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges))


def _pairs(s, d):
    r = s.read.parquet(f"{d}/region.parquet")
    return r.select(F.col("r_name").alias("pair"), F.concat(F.lit("tpch:"), F.col("r_name")).alias("a"), F.concat(F.lit("tpch:"), F.col("r_name"), F.lit("_v2")).alias("b"))


def _alias(key: str) -> str:
    return f"regexp_replace({key}, 'tpch:[^:]*:', 'tpch:_:', 'g')"


_DIFF = [
    f"n1 AS (SELECT sk AS pair, {_alias('node_key')} AS ckey, node_key, label FROM nodes)", f"n2 AS (SELECT left(sk, length(sk) - 3) AS pair, {_alias('node_key')} AS ckey, node_key, label FROM nodes2)",
    f"e1 AS (SELECT sk AS pair, {_alias('edge_key')} AS ckey, edge_type FROM edges)", f"e2 AS (SELECT left(sk, length(sk) - 3) AS pair, {_alias('edge_key')} AS ckey, edge_type FROM edges2)",
    "lists1 AS (SELECT key, string_agg('' || ok, ',' ORDER BY pos) AS cols FROM (SELECT key, ok, ix_col.pos FROM ix_col JOIN col USING (ckey) UNION ALL SELECT key, ok, con_col.pos FROM con_col JOIN col USING (ckey)) GROUP BY key)",
    "lists2 AS (SELECT key, string_agg('' || ok, ',' ORDER BY pos) AS cols FROM (SELECT key, ok, ix_col2.pos FROM ix_col2 JOIN col2 USING (ckey) UNION ALL SELECT key, ok, con_col2.pos FROM con_col2 JOIN col2 USING (ckey)) GROUP BY key)",
    f"changed AS (SELECT n2.pair, n2.ckey, n2.node_key, n2.label FROM n2 WHERE ckey IN (SELECT {_alias('l1.key')} FROM lists1 l1 JOIN lists2 l2 ON {_alias('l1.key')} = {_alias('l2.key')} WHERE l1.cols <> l2.cols) OR node_key IN (SELECT ckey FROM col2 WHERE dtype = 'CHANGED'))",
    "dn AS (SELECT pair, 'removed' AS change, ckey, node_key, label FROM n1 WHERE NOT EXISTS (SELECT 1 FROM n2 WHERE n2.pair = n1.pair AND n2.ckey = n1.ckey) UNION ALL SELECT pair, 'added', ckey, node_key, label FROM n2 WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n2.pair = n1.pair AND n2.ckey = n1.ckey))",
    "de AS (SELECT pair, 'removed' AS change, ckey, edge_type FROM e1 WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.pair = e1.pair AND e2.ckey = e1.ckey) UNION ALL SELECT pair, 'added', ckey, edge_type FROM e2 WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e2.pair = e1.pair AND e2.ckey = e1.ckey))",
]
_PAIR = "replace(pair, 'tpch:', '') AS pair"
_q("d1_diff_nodes", lambda s, d: D.diff_nodes(_two(s, d), _pairs(s, d)), over_both(f"SELECT {_PAIR}, change, ckey, node_key, label FROM dn", *_DIFF))
_q("d2_changed_nodes", lambda s, d: D.changed_nodes(_two(s, d), _pairs(s, d)), over_both(f"SELECT {_PAIR}, 'changed' AS change, ckey, node_key, label FROM changed", *_DIFF))
_q("d3_diff_edges", lambda s, d: D.diff_edges(_two(s, d), _pairs(s, d)).drop("edge_key"), over_both(f"SELECT {_PAIR}, change, ckey, edge_type FROM de", *_DIFF))


def _all_nodes(g, pairs):
    return D.node_changes(g, pairs)


_q("d4_impact_seeds", lambda s, d: (lambda g, p: D.impact_seeds(_all_nodes(g, p), p))(_two(s, d), _pairs(s, d)), over_both(f"SELECT DISTINCT {_PAIR}, CASE change WHEN 'removed' THEN pair ELSE pair || '_v2' END AS snapshot_key, node_key AS seed FROM (SELECT pair, change, node_key FROM dn UNION ALL SELECT pair, 'changed', node_key FROM changed)", *_DIFF))
_CHANGES = "SELECT DISTINCT CASE change WHEN 'removed' THEN pair ELSE pair || '_v2' END AS sk, node_key AS seed FROM (SELECT pair, change, node_key FROM dn UNION ALL SELECT pair, 'changed', node_key FROM changed)"


def d5_diff_impact(s, d):
    g, p = _two(s, d), _pairs(s, d)
    return D.diff_impact(g, D.impact_seeds(_all_nodes(g, p), p)).groupBy("snapshot_key", "edge_type", "label", "depth").agg(F.count("*").alias("n"), F.min("node_key").alias("first_key"))


_q("d5_diff_impact", d5_diff_impact, over_both(f"SELECT h.sk AS snapshot_key, edge_type, label, depth::INTEGER AS depth, count(*) AS n, min(node) AS first_key FROM ({_hops(D.IMPACT_DEPTH)}) h JOIN (SELECT node_key, label FROM nodes UNION ALL SELECT node_key, label FROM nodes2) n ON n.node_key = h.node GROUP BY ALL", *_DIFF, "alle AS (SELECT * FROM edges UNION ALL SELECT * FROM edges2)", *levels(_CHANGES, D.IMPACT_DEPTH, edges="alle")))
_SEEDED = [  # the first 20 seeds of a pair, their walks, and what each leaves of one budget to the next
    "alle AS (SELECT * FROM edges UNION ALL SELECT * FROM edges2)",
    "dseeds AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY sk, seed) AS k FROM (SELECT DISTINCT pair, CASE change WHEN 'removed' THEN pair ELSE pair || '_v2' END AS sk, node_key AS seed FROM (SELECT pair, change, node_key FROM dn UNION ALL SELECT pair, 'changed', node_key FROM changed))) WHERE k <= 20)",
    *bounded_levels("SELECT sk, seed FROM dseeds", D.IMPACT_DEPTH, 20, "alle"),
    f"hits AS MATERIALIZED (SELECT pair, k, seed, node, depth, position FROM ({' UNION ALL '.join(f'SELECT sk, seed, node, depth, position FROM hop{k}' for k in range(1, D.IMPACT_DEPTH + 1))}) JOIN dseeds USING (sk, seed))",
    "budgets AS (SELECT pair, 1::BIGINT AS k, 20::BIGINT AS budget FROM dseeds WHERE k = 1 UNION ALL SELECT b.pair, b.k + 1, b.budget - count(h.node) FROM budgets b LEFT JOIN hits h ON h.pair = b.pair AND h.k = b.k AND h.position <= b.budget WHERE b.k < 20 GROUP BY b.pair, b.k, b.budget)",
]
_q("d6_schema_diff", lambda s, d: D.schema_diff(_two(s, d), _pairs(s, d), 20)["impact"].select("pair", "seed", "node_key", "depth", "budget"), over_both(f"SELECT {_PAIR}, seed, node AS node_key, depth::INTEGER AS depth, budget FROM hits JOIN budgets USING (pair, k) WHERE position <= budget", *_DIFF, *_SEEDED).replace("WITH", "WITH RECURSIVE", 1))
_q("d6_counts", lambda s, d: (lambda g, p: D.change_counts(D.node_changes(g, p), D.diff_edges(g, p)))(_two(s, d), _pairs(s, d)), over_both(f"SELECT {_PAIR}, what, count(*) AS n FROM (SELECT pair, 'nodes_' || change AS what FROM dn UNION ALL SELECT pair, 'nodes_changed' FROM changed UNION ALL SELECT pair, 'edges_' || change FROM de) GROUP BY ALL", *_DIFF))
_CUTS = f"cuts AS (SELECT s.pair, bool_or(coalesce(e.truncated OR e.used > b.budget, false)) AS cut FROM dseeds s JOIN budgets b USING (pair, k) LEFT JOIN end{D.IMPACT_DEPTH} e ON e.sk = s.sk AND e.seed = s.seed GROUP BY s.pair)"
_q("d7_diff_envelope", lambda s, d: D.diff_envelope(_two(s, d), _pairs(s, d), 20), over_both("SELECT replace(reg.sk, 'tpch:', '') AS pair, count(*) FILTER (what = 'nodes_added') AS nodes_added, count(*) FILTER (what = 'nodes_removed') AS nodes_removed, count(*) FILTER (what = 'nodes_changed') AS nodes_changed, count(*) FILTER (what = 'edges_added') AS edges_added, count(*) FILTER (what = 'edges_removed') AS edges_removed, count(*) FILTER (what LIKE 'nodes%') AS impacted_seeds, 20::INTEGER AS limit_applied, greatest(count(*) FILTER (what LIKE 'nodes%'), count(*) FILTER (what = 'nodes_added'), count(*) FILTER (what = 'nodes_removed'), count(*) FILTER (what = 'nodes_changed'), count(*) FILTER (what = 'edges_added'), count(*) FILTER (what = 'edges_removed')) > 20 OR coalesce(any_value(cuts.cut), false) AS truncated, coalesce(any_value(cuts.cut), false) AS impact_truncated FROM reg LEFT JOIN (SELECT pair, 'nodes_' || change AS what FROM dn UNION ALL SELECT pair, 'nodes_changed' FROM changed UNION ALL SELECT pair, 'edges_' || change FROM de) x ON x.pair = reg.sk LEFT JOIN cuts ON cuts.pair = reg.sk GROUP BY reg.sk", *_DIFF, *_SEEDED, _CUTS).replace("WITH", "WITH RECURSIVE", 1))

# Descriptions


def t1_describe_tables(s, d):
    t = T.describe_tables(catalog(s, d))
    text = lambda c, f: F.concat_ws(";", F.transform(c, f))
    return t.select("table_key", "name", text("columns", lambda x: F.concat_ws(" ", x["name"], x["data_type"])).alias("columns"), F.concat_ws(",", "primary_key").alias("primary_key"), text("constraints", lambda x: F.concat_ws(" ", x["_o"], F.concat_ws(",", x["columns"]))).alias("constraints"), text("foreign_keys", lambda x: x["referenced_table_key"]).alias("to_tables"), text("referenced_by", lambda x: x["constraint_key"]).alias("referenced_by"), text("indexes", lambda x: F.concat_ws(" ", x["_o"], F.concat_ws(",", x["columns"]))).alias("indexes"))


_T1 = "SELECT tkey AS table_key, 'c' || ck AS name, coalesce((SELECT string_agg('o' || ok || ' ' || prio, ';' ORDER BY pos) FROM col x WHERE x.ck = cust.ck), '') AS columns, coalesce((SELECT 'o' || min_by(ok, pos) FROM col x WHERE x.ck = cust.ck GROUP BY x.ck), '') AS primary_key, coalesce((SELECT string_agg(name || ' ' || cs, ';' ORDER BY name) FROM con JOIN (SELECT key, string_agg('o' || ok, ',' ORDER BY con_col.pos) AS cs FROM con_col JOIN col USING (ckey) GROUP BY key) USING (key) WHERE con.ck = cust.ck), '') AS constraints, coalesce((SELECT next_t FROM chain x WHERE x.ck = cust.ck), '') AS to_tables, coalesce((SELECT con.key FROM con JOIN chain USING (ck) WHERE kind = 'foreign_key' AND next_t = cust.tkey), '') AS referenced_by, coalesce((SELECT string_agg('ix_' || prio || ' ' || cs, ';' ORDER BY prio) FROM (SELECT ck, ix_col.prio, string_agg('o' || ok, ',' ORDER BY ix_col.pos) AS cs FROM ix_col JOIN (SELECT ckey, ok FROM col) y USING (ckey) GROUP BY ALL) z WHERE z.ck = cust.ck), '') AS indexes FROM cust"
_q("t1_describe_tables", t1_describe_tables, over_fleet(_T1))
_DEPS = "deps AS (SELECT dep AS table_key, key AS dependent_key, 'view' AS kind, NULL AS c FROM vdep WHERE dkind = 'TABLE' UNION ALL SELECT dep, key, 'routine', NULL FROM rdep WHERE dkind = 'TABLE' UNION ALL SELECT tkey, key, 'routine', ckey FROM rdep JOIN col ON dep = ckey WHERE dkind = 'COLUMN' UNION ALL SELECT tkey, key, 'trigger', NULL FROM tr)"
_q("t2_dependents", lambda s, d: T.dependents(graph(s, d)).select("table_key", "dependent_key", "kind", "relation", F.concat_ws("|", "column_keys").alias("column_keys")), over_fleet("SELECT table_key, dependent_key, kind, CASE kind WHEN 'trigger' THEN 'table_has_trigger' ELSE kind || '_depends_on' END AS relation, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS column_keys FROM deps GROUP BY ALL", _DEPS))
_q("t3_inventory", lambda s, d: T.inventory(catalog(s, d), graph(s, d)).select("table_key", F.coalesce(F.size("columns"), F.lit(0)).alias("columns"), F.coalesce(F.size("constraints"), F.lit(0)).alias("constraints"), F.coalesce(F.size("indexes"), F.lit(0)).alias("indexes"), F.coalesce(F.size("dependents"), F.lit(0)).alias("dependents")), over_fleet("SELECT cust.tkey AS table_key, (SELECT count(*) FROM col x WHERE x.ck = cust.ck)::INTEGER AS columns, (SELECT count(*) FROM con x WHERE x.ck = cust.ck)::INTEGER AS constraints, (SELECT count(*) FROM ix x WHERE x.ck = cust.ck)::INTEGER AS indexes, (SELECT count(DISTINCT dependent_key) FROM deps WHERE table_key = cust.tkey)::INTEGER AS dependents FROM cust", _DEPS))
_q("t3_inventory_page", lambda s, d: (lambda got: got[0].select("table_key", F.size("dependents").alias("dependents"), F.lit(got[1]["next_offset"]).cast("long").alias("next_offset")))(T.inventory_page(catalog(s, d), graph(s, d), ASIA, 5, 10)), over_fleet("SELECT tkey AS table_key, (SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT dependent_key) END FROM deps WHERE table_key = tkey)::INTEGER AS dependents, CASE WHEN 15 < (SELECT count(*) FROM cust WHERE sk = 'tpch:ASIA') THEN 15 END::BIGINT AS next_offset FROM (SELECT * FROM cust WHERE sk = 'tpch:ASIA' ORDER BY tkey LIMIT 10 OFFSET 5)", _DEPS))
_q("t4_list_tables", lambda s, d: T.list_tables(graph(s, d), ASIA, "C1", 3, 20)[0].select("schema", "table", "key"), over_fleet("SELECT nn AS \"schema\", 'c' || ck AS \"table\", tkey AS key FROM cust WHERE sk = 'tpch:ASIA' AND ck::VARCHAR LIKE '1%' ORDER BY nn, 'c' || ck, tkey LIMIT 20 OFFSET 3"))
_q("t5_find_tables", lambda s, d: T.find_tables(graph(s, d), "C12").select("snapshot_key", "schema", "table", "key"), over_fleet("SELECT sk AS snapshot_key, nn AS \"schema\", 'c' || ck AS \"table\", tkey AS key FROM cust WHERE ck::VARCHAR LIKE '12%'"))
_q("t6_find_columns", lambda s, d: T.find_columns(graph(s, d), "O7").select("schema", "table", "column", "key", "table_key", "data_type", "is_nullable"), over_fleet("SELECT nn AS \"schema\", 'c' || ck AS \"table\", 'o' || ok AS \"column\", ckey AS key, tkey AS table_key, prio AS data_type, CASE WHEN st <> 'F' THEN 'true' ELSE 'false' END AS is_nullable FROM col WHERE ok::VARCHAR LIKE '7%'"))


def t7_resolve_tables(s, d):
    c = catalog(s, d)
    by_name = c.tables.select("snapshot_key", F.col("name").alias("selector"))
    by_key = c.tables.select("snapshot_key", F.col("key").alias("selector")).unionByName(c.views.select("snapshot_key", F.col("key").alias("selector")))
    lost = c.tables.select("snapshot_key", F.concat(F.lit("no "), F.col("name")).alias("selector"))
    return T.resolve_tables(graph(s, d), by_name.unionByName(by_key).unionByName(lost)).select("selector", "status", "table_key")


_q("t7_resolve_tables", t7_resolve_tables, over_fleet("SELECT 'c' || ck AS selector, 'found' AS status, tkey AS table_key FROM cust UNION ALL SELECT tkey, 'found', tkey FROM cust UNION ALL SELECT key, 'not_a_table', NULL FROM vw UNION ALL SELECT 'no c' || ck, 'not_found', NULL FROM cust"))
