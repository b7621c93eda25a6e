"""The retail fleet's catalog and graph in plain SQL, for holding queries against another engine."""

from __future__ import annotations

# Names that end in @ take a suffix for the generation.
FLEET = r"""
reg@ AS (SELECT r_regionkey AS rk, r_name || '{v}' AS alias, 'tpch:' || r_name || '{v}' AS sk FROM region),
nat@ AS (SELECT n_nationkey AS nk, n_name AS nn, rk, alias, sk, 'tpch:' || alias || ':w:' || n_name || ':' AS pre, 'tpch:' || alias || ':w:' || n_name || ':schema:' || n_name AS skey FROM nation JOIN reg@ ON n_regionkey = rk),
db@ AS (SELECT sk, 'tpch:' || alias || ':w:w:database:w' AS dkey FROM reg@),
cust@ AS (SELECT c_custkey AS ck, c_acctbal AS bal, nk, nn, rk, alias, sk, pre, skey, pre || 'table:c' || c_custkey AS tkey FROM customer JOIN nat@ ON c_nationkey = nk),
ord@ AS (SELECT o_orderkey AS ok, o_custkey AS ck, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS cols, o_orderstatus AS st, o_orderpriority AS prio FROM orders),
col@ AS (SELECT ok, ck, pos, st, prio, {type} AS dtype, bal, nn, rk, sk, pre, tkey, pre || 'column:c' || ck || ':o' || ok AS ckey FROM ord@ JOIN cust@ USING (ck) WHERE {keep}),
keyed@ AS (SELECT ck, rk, sk, pre, tkey, bal, min_by(ckey, pos) AS first_c, max_by(ckey, pos) AS last_c FROM col@ GROUP BY ALL),
chain@ AS (SELECT *, lead(tkey) OVER (PARTITION BY rk ORDER BY ck) AS next_t, lead(first_c) OVER (PARTITION BY rk ORDER BY ck) AS next_c FROM keyed@),
con@ AS (
  SELECT sk, ck, pre || 'primary_key:c' || ck || ':pk' AS key, tkey, 'pk' AS name, 'primary_key' AS kind FROM chain@
  UNION ALL SELECT sk, ck, pre || 'foreign_key:c' || ck || ':fk', tkey, 'fk', 'foreign_key' FROM chain@ WHERE next_t IS NOT NULL
  UNION ALL SELECT sk, ck, pre || 'unique_constraint:c' || ck || ':uq', tkey, 'uq', 'unique' FROM chain@ WHERE bal > 9000
  UNION ALL SELECT sk, ck, pre || 'check_constraint:c' || ck || ':ck', tkey, 'ck', 'check' FROM chain@ WHERE bal < 0
),
con_col@ AS (
  SELECT con@.sk, key, kind, first_c AS ckey, 1 AS pos FROM con@ JOIN chain@ USING (ck) WHERE kind = 'primary_key'
  UNION ALL SELECT con@.sk, key, kind, last_c, 1 FROM con@ JOIN chain@ USING (ck) WHERE kind = 'foreign_key'
  UNION ALL SELECT con@.sk, key, kind, ckey, pos FROM con@ JOIN col@ USING (ck) WHERE (kind = 'unique' AND pos <= 2) OR (kind = 'check' AND pos <= 3)
),
ix_col@ AS (SELECT sk, ck, tkey, prio, pre || 'index:c' || ck || ':ix_' || prio AS key, ckey, pos FROM col@),
ix@ AS (SELECT sk, ck, tkey, prio, key, count(*) AS n FROM ix_col@ GROUP BY ALL),
vw@ AS (SELECT s_suppkey AS vk, s_nationkey AS nk, rk, sk, skey, pre || 'view:s' || s_suppkey AS key, lead(pre || 'view:s' || s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next_v FROM supplier JOIN nat@ ON s_nationkey = nk),
bought@ AS (SELECT l_suppkey, l_partkey, l_linenumber, ck, rk AS crk, tkey, pre || 'column:c' || ck || ':o' || o_orderkey AS ckey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust@ ON o_custkey = ck),
vdep@ AS (
  SELECT DISTINCT sk, key, tkey AS dep, 'TABLE' AS dkind FROM vw@ JOIN bought@ ON l_suppkey = vk AND crk = rk
  UNION ALL SELECT sk, key, next_v, 'VIEW' FROM vw@ WHERE next_v IS NOT NULL
),
rt@ AS (SELECT p_partkey AS pk, nk, rk, sk, skey, pre || 'routine:p' || p_partkey AS key FROM part JOIN nat@ ON p_partkey % 25 = nk WHERE p_size <= 2),
rdep@ AS (
  SELECT DISTINCT sk, key, tkey AS dep, 'TABLE' AS dkind FROM rt@ JOIN bought@ ON l_partkey = pk AND crk = rk AND l_linenumber = 1
  UNION ALL SELECT DISTINCT sk, key, ckey, 'COLUMN' FROM rt@ JOIN bought@ ON l_partkey = pk AND crk = rk AND l_linenumber = 1
),
tr@ AS (SELECT sk, ck, tkey, pre || 'trigger:c' || ck || ':t' AS key, (SELECT min(key) FROM rt@ WHERE rt@.nk = cust@.nk) AS rkey FROM cust@ WHERE ck IN (SELECT user_id FROM events)),
nodes@ AS (
  SELECT sk, dkey AS node_key, 'Database' AS label, 'w' AS display_name FROM db@
  UNION ALL SELECT sk, skey, 'Schema', nn FROM nat@
  UNION ALL SELECT sk, tkey, 'Table', 'c' || ck FROM cust@
  UNION ALL SELECT sk, ckey, 'Column', 'o' || ok FROM col@
  UNION ALL SELECT sk, key, CASE kind WHEN 'primary_key' THEN 'PrimaryKey' WHEN 'foreign_key' THEN 'ForeignKey' WHEN 'unique' THEN 'UniqueConstraint' ELSE 'CheckConstraint' END, name FROM con@
  UNION ALL SELECT sk, key, 'Index', 'ix_' || prio FROM ix@
  UNION ALL SELECT sk, key, 'View', 's' || vk FROM vw@
  UNION ALL SELECT sk, key, 'Routine', 'p' || pk FROM rt@
  UNION ALL SELECT sk, key, 'Trigger', 't' FROM tr@
),
links@ AS (
  SELECT nat@.sk, dkey AS edge_from, skey AS edge_to, 'DATABASE_HAS_SCHEMA' AS edge_type FROM nat@ JOIN db@ USING (sk)
  UNION ALL SELECT sk, skey, tkey, 'SCHEMA_HAS_TABLE' FROM cust@
  UNION ALL SELECT sk, tkey, ckey, 'TABLE_HAS_COLUMN' FROM col@
  UNION ALL SELECT sk, tkey, key, 'TABLE_HAS_CONSTRAINT' FROM con@
  UNION ALL SELECT sk, tkey, key, 'TABLE_HAS_INDEX' FROM ix@
  UNION ALL SELECT sk, skey, key, 'SCHEMA_HAS_VIEW' FROM vw@
  UNION ALL SELECT sk, skey, key, 'SCHEMA_HAS_ROUTINE' FROM rt@
  UNION ALL SELECT sk, tkey, key, 'TABLE_HAS_TRIGGER' FROM tr@
  UNION ALL SELECT sk, ckey, key, CASE kind WHEN 'primary_key' THEN 'COLUMN_IN_PRIMARY_KEY' WHEN 'foreign_key' THEN 'FK_FROM_COLUMN' WHEN 'unique' THEN 'COLUMN_IN_UNIQUE' ELSE 'COLUMN_IN_CHECK' END FROM con_col@
  UNION ALL SELECT con@.sk, key, next_c, 'FK_TO_COLUMN' FROM con@ JOIN chain@ USING (ck) WHERE kind = 'foreign_key'
  UNION ALL SELECT sk, ckey, key, 'COLUMN_IN_INDEX' FROM ix_col@
  UNION ALL SELECT sk, key, dep, 'VIEW_DEPENDS_ON_' || dkind FROM vdep@
  UNION ALL SELECT sk, key, dep, 'ROUTINE_DEPENDS_ON_' || dkind FROM rdep@
  UNION ALL SELECT sk, key, tkey, 'TRIGGER_ON_TABLE' FROM tr@
  UNION ALL SELECT sk, key, rkey, 'TRIGGER_EXECUTES_ROUTINE' FROM tr@ WHERE rkey IS NOT NULL
),
edges@ AS (SELECT sk, edge_type || ':' || edge_from || '->' || edge_to AS edge_key, edge_from, edge_to, edge_type FROM links@)
"""

PRIORITY = "CASE WHEN edge_type IN ('DATABASE_HAS_SCHEMA', 'SCHEMA_HAS_TABLE', 'SCHEMA_HAS_VIEW', 'SCHEMA_HAS_ROUTINE', 'TABLE_HAS_COLUMN') THEN 2 WHEN edge_type = 'TABLE_HAS_INDEX' THEN 1 ELSE 0 END"


def fleet(generation: int = 1, suffix: str = "") -> str:
    first = {"v": "", "type": "prio", "keep": "true"}
    later = {"v": f"_v{generation}", "type": "CASE WHEN ok % 100 = 0 THEN 'CHANGED' ELSE prio END", "keep": "NOT (ok % 97 = 0 AND pos > 1 AND pos < cols)"}
    return FLEET.format(**(first if generation == 1 else later)).replace("@", suffix)


def over_fleet(select: str, *ctes: str) -> str:
    """A query over the fleet's first generation, with further CTEs."""
    return "WITH " + ",\n".join([fleet().strip(), *ctes]) + "\n" + select


def over_both(select: str, *ctes: str) -> str:
    """A query over both generations; the second's names end in 2."""
    return "WITH " + ",\n".join([fleet().strip(), fleet(2, "2").strip(), *ctes]) + "\n" + select


def levels(seeds: str, depth: int, direction: str = "both", edges: str = "edges") -> list[str]:
    """CTEs hop0 .. hopN of an unbounded walk: (sk, seed, node, ord, edge_key, edge_type, depth), each node at its first level by its first edge in queue order."""
    sides = []
    if direction in ("outbound", "both"):
        sides.append(f"SELECT sk, edge_from AS at, edge_to AS nxt, 0 AS rank, edge_key, edge_type FROM {edges}")
    if direction in ("inbound", "both"):
        sides.append(f"SELECT sk, edge_to AS at, edge_from AS nxt, {1 if direction == 'both' else 0} AS rank, edge_key, edge_type FROM {edges}")
    out = [f"steps AS ({' UNION ALL '.join(sides)})", f"hop0 AS (SELECT sk, seed, seed AS node, []::VARCHAR[] AS ord, NULL::VARCHAR AS edge_key, NULL::VARCHAR AS edge_type, 0 AS depth FROM ({seeds}) s)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT sk, seed, node FROM hop{i}" for i in range(k))
        out.append(f"seen{k} AS ({seen})")
        out.append(f"""hop{k} AS (
  SELECT sk, seed, node, ord, edge_key, edge_type, {k} AS depth FROM (
    SELECT h.sk, h.seed, s.nxt AS node, list_append(h.ord, s.rank || s.edge_key) AS ord, s.edge_key, s.edge_type, row_number() OVER (PARTITION BY h.sk, h.seed, s.nxt ORDER BY list_append(h.ord, s.rank || s.edge_key)) AS k
    FROM hop{k - 1} h JOIN steps s ON s.sk = h.sk AND s.at = h.node
    WHERE NOT EXISTS (SELECT 1 FROM seen{k} v WHERE v.sk = h.sk AND v.seed = h.seed AND v.node = s.nxt)
  ) WHERE k = 1)""")
    return out


def _bounded(seeds: str, more: str = "", edges: str = "edges") -> list[str]:
    """CTEs of a walk both ways with budgets: its steps by priority (a self-loop once), hop0 and end0 (sk, seed, used, truncated)."""
    own = f"SELECT sk, edge_from AS at, edge_to AS nxt, {PRIORITY} AS rank, edge_key, edge_type, edge_from, edge_to FROM {edges}"
    other = f"SELECT sk, edge_to, edge_from, {PRIORITY}, edge_key, edge_type, edge_from, edge_to FROM {edges} WHERE edge_from <> edge_to"
    none = ", ".join(f"NULL::VARCHAR AS {x}" for x in ("edge_key", "edge_type", "edge_from", "edge_to"))
    return [f"steps AS ({own} UNION ALL {other})", f"hop0 AS (SELECT sk, seed, seed AS node, []::VARCHAR[] AS ord, {none}, 0::BIGINT AS position, 0 AS depth{more} FROM ({seeds}) s)", "end0 AS (SELECT sk, seed, 0::BIGINT AS used, false AS truncated FROM hop0)"]


_STEP = "h.sk, h.seed, s.nxt AS node, h.ord AS parent, list_append(h.ord, s.rank || s.edge_key) AS ord, s.edge_key, s.edge_type, s.edge_from, s.edge_to, e.used"


def _level(k: int, more: str = "") -> str:
    """All edges that level k may fetch, by seeds that aren't cut yet."""
    return f"SELECT {_STEP}{more} FROM hop{k - 1} h JOIN end{k - 1} e ON e.sk = h.sk AND e.seed = h.seed AND NOT e.truncated JOIN steps s ON s.sk = h.sk AND s.at = h.node"


def _seen(k: int) -> str:
    return " UNION ALL ".join(f"SELECT sk, seed, node FROM hop{i}" for i in range(k))


def _fetched(k: int, limit: int) -> str:
    """Edges used up after level k, where every fetched edge counts."""
    return f"end{k} AS (SELECT e.sk, e.seed, least({limit}, used + coalesce(n, 0)) AS used, truncated OR used + coalesce(n, 0) > {limit} AS truncated FROM end{k - 1} e LEFT JOIN (SELECT sk, seed, max(place) AS n FROM level{k} GROUP BY ALL) USING (sk, seed))"


_PLACED = "row_number() OVER (PARTITION BY sk, seed ORDER BY ord) AS place"


def bounded_levels(seeds: str, depth: int, limit: int, edges: str = "edges") -> list[str]:
    """CTEs hop1 .. hopN (each new node by its first fetched edge, with that edge's position) and end0 .. endN of a walk that may fetch limit edges for a seed."""
    out = _bounded(seeds, edges=edges)
    for k in range(1, depth + 1):
        out.append(f"level{k} AS MATERIALIZED (SELECT *, {_PLACED} FROM ({_level(k)}))")
        out.append(f"seen{k} AS ({_seen(k)})")
        out.append(f"hop{k} AS MATERIALIZED (SELECT sk, seed, node, ord, edge_key, edge_type, edge_from, edge_to, position, {k} AS depth FROM (SELECT *, used + place AS position, row_number() OVER (PARTITION BY sk, seed, node ORDER BY ord) AS nth FROM level{k} WHERE used + place <= {limit}) l WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM seen{k} v WHERE v.sk = l.sk AND v.seed = l.seed AND v.node = l.node))")
        out.append(_fetched(k, limit))
    return out


def bounded_paths(seeds: str, depth: int, limit: int) -> list[str]:
    """As bounded_levels for simple paths: hops carry path, and edges to nodes on the path are fetched too."""
    out = _bounded(seeds, ", [seed] AS path")
    for k in range(1, depth + 1):
        out.append(f"level{k} AS MATERIALIZED (SELECT *, {_PLACED} FROM ({_level(k, ', h.path')}))")
        out.append(f"hop{k} AS MATERIALIZED (SELECT sk, seed, node, ord, list_append(path, node) AS path, used + place AS position, {k} AS depth FROM level{k} WHERE used + place <= {limit} AND NOT list_contains(path, node))")
        out.append(_fetched(k, limit))
    return out


def budget_of_hits(seeds: str, depth: int, limit: int) -> list[str]:
    """As bounded_levels, but new nodes use up the budget: the first parent with more edges than are left, or with none left, ends its seed's walk."""
    out = _bounded(seeds)
    for k in range(1, depth + 1):
        out.append(f"level{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sk, seed, parent ORDER BY ord) AS place FROM ({_level(k)}))")
        out.append(f"seen{k} AS ({_seen(k)})")
        out.append(f"fresh{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sk, seed, node ORDER BY ord) AS nth FROM level{k} l WHERE NOT EXISTS (SELECT 1 FROM seen{k} v WHERE v.sk = l.sk AND v.seed = l.seed AND v.node = l.node)) WHERE nth = 1)")
        sizes = f"SELECT h.sk, h.seed, h.ord AS parent, e.used, coalesce(n_edges, 0) AS n_edges, coalesce(n_new, 0) AS n_new FROM hop{k - 1} h JOIN end{k - 1} e ON e.sk = h.sk AND e.seed = h.seed AND NOT e.truncated LEFT JOIN (SELECT sk, seed, parent, count(*) AS n_edges FROM level{k} GROUP BY ALL) a ON a.sk = h.sk AND a.seed = h.seed AND a.parent = h.ord LEFT JOIN (SELECT sk, seed, parent, count(*) AS n_new FROM fresh{k} GROUP BY ALL) b ON b.sk = h.sk AND b.seed = h.seed AND b.parent = h.ord"
        out.append(f"parents{k} AS (SELECT *, {limit} - used - coalesce(sum(n_new) OVER (PARTITION BY sk, seed ORDER BY parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM ({sizes}))")
        out.append(f"cut{k} AS (SELECT sk, seed, min(parent) AS last, arg_min(rem, parent) AS rem FROM parents{k} WHERE rem <= 0 OR n_edges > rem GROUP BY ALL)")
        out.append(f"hop{k} AS MATERIALIZED (SELECT f.sk, f.seed, node, ord, edge_key, edge_type, edge_from, edge_to, {k} AS depth FROM fresh{k} f LEFT JOIN cut{k} c ON c.sk = f.sk AND c.seed = f.seed WHERE c.sk IS NULL OR parent < last OR (parent = last AND place <= rem))")
        out.append(f"end{k} AS (SELECT e.sk, e.seed, used + coalesce(n, 0) AS used, truncated OR c.sk IS NOT NULL AS truncated FROM end{k - 1} e LEFT JOIN (SELECT sk, seed, count(*) AS n FROM hop{k} GROUP BY ALL) h ON h.sk = e.sk AND h.seed = e.seed LEFT JOIN cut{k} c ON c.sk = e.sk AND c.seed = e.seed)")
    return out
