"""Traversals against plain queues, over tiny graphs and random multigraphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from metaloom.functions.keys import BROAD
from metaloom.operators import diff as D
from metaloom.operators import traverse as T
from metaloom.plans.model import Graph

TYPES = ["TABLE_HAS_COLUMN", "TABLE_HAS_INDEX", "COLUMN_IN_INDEX", "VIEW_DEPENDS_ON_TABLE"]


def rank(t):
    return 2 if t in BROAD else 1 if t == "TABLE_HAS_INDEX" else 0


def steps(edges, node, direction, bounded, edge_type=None):
    out = []
    for d in ("outbound", "inbound") if direction == "both" else (direction,):
        for key, a, b, t in sorted(edges):
            if edge_type is None or t == edge_type:
                if (a if d == "outbound" else b) == node:
                    out.append((key, b if d == "outbound" else a, t))
    if bounded:
        out = sorted(set(out), key=lambda e: (rank(e[2]), e[0]))
    return out


def queue_impact(edges, start, direction, depth, limit=None):
    seen, queue, found, left, cut = {start}, deque([(start, 0)]), [], limit, False
    while queue:
        node, k = queue.popleft()
        if k == depth:
            continue
        es = steps(edges, node, direction, limit is not None)
        more = limit is not None and len(es) > left
        if limit is not None:
            es = es[:left]
            left -= len(es)
            cut |= more
        for key, nxt, _ in es:
            if nxt not in seen:
                seen.add(nxt)
                queue.append((nxt, k + 1))
                found.append((nxt, k + 1, key))
        if more:
            break
    return found, cut


def queue_trace(edges, start, direction, depth, limit=None):
    queue, found, left, cut = deque([[start]]), [], limit, False
    while queue:
        path = queue.popleft()
        if len(path) - 1 == depth:
            continue
        es = steps(edges, path[-1], direction, limit is not None)
        more = limit is not None and len(es) > left
        if limit is not None:
            es = es[:left]
            left -= len(es)
            cut |= more
        for _, nxt, _ in es:
            if nxt not in path:
                queue.append(path + [nxt])
                found.append("|".join(path + [nxt]))
        if more:
            break
    return found, cut


def queue_filtered(edges, start, direction, depth, limit, edge_type):
    seen, queue, found, cut = {start}, deque([(start, 0)]), [], False
    if depth == 0:
        return found, cut
    while queue:
        node, k = queue.popleft()
        if k == depth:
            continue
        if len(found) == limit:
            return found, True
        es = steps(edges, node, direction, True, edge_type)
        room = limit - len(found)
        more = len(es) > room
        cut |= more
        for key, nxt, _ in es[:room]:
            if nxt not in seen:
                seen.add(nxt)
                found.append((nxt, k + 1, key))
                if k + 1 < depth:
                    queue.append((nxt, k + 1))
        if more:
            break
    return found, cut


def graphs(n, seed):
    """n random multigraphs, each a snapshot, with self-loops."""
    r, out = random.Random(seed), {}
    for g in range(n):
        size = r.randint(1, 7)
        out[f"s{g}"] = [(f"e{i:02d}", f"n{r.randrange(size)}", f"n{r.randrange(size)}", r.choice(TYPES)) for i in range(r.randint(0, 14))]
    return out


def frames(spark, all_edges):
    rows = [(s, k, a, b, t, "{}") for s, es in all_edges.items() for k, a, b, t in es]
    edges = spark.createDataFrame(rows, "snapshot_key string, edge_key string, edge_from string, edge_to string, edge_type string, payload_json string")
    nodes = spark.createDataFrame([(s, f"n{i}", "Table", f"n{i}", "{}") for s in all_edges for i in range(7)], "snapshot_key string, node_key string, label string, display_name string, payload_json string")
    snapshots = spark.createDataFrame([(s, "x", 0, "{}") for s in all_edges], "snapshot_key string, source string, captured_at_unix_ms long, payload_json string")
    seeds = spark.createDataFrame([(s, "n0") for s in all_edges], "snapshot_key string, seed string")
    return Graph(snapshots, nodes.cache(), edges.cache()), seeds


@pytest.fixture(scope="module")
def random_graphs(spark):
    all_edges = graphs(80, 7)
    return (all_edges, *frames(spark, all_edges))


@pytest.mark.parametrize("direction", ["outbound", "inbound", "both"])
def test_impact(random_graphs, direction):
    all_edges, g, seeds = random_graphs
    got = T.impact_many(g, seeds, direction, 3).collect()
    for s, es in all_edges.items():
        mine = [(r.node_key, r.depth, r.edge_key) for r in sorted((r for r in got if r.snapshot_key == s), key=lambda r: (r.depth, r.ord))]
        assert mine == queue_impact(es, "n0", direction, 3)[0], (s, es)


@pytest.mark.parametrize("limit", [0, 3, 8])
def test_impact_bounded(random_graphs, limit):
    all_edges, g, seeds = random_graphs
    got = T.impact_bounded(g, seeds, "both", 3, limit)
    hits, ends = got.hits.collect(), {r.snapshot_key: r.truncated for r in got.ends.collect()}
    for s, es in all_edges.items():
        mine = [(r.node_key, r.depth) for r in sorted((r for r in hits if r.snapshot_key == s), key=lambda r: r.position)]
        want, cut = queue_impact(es, "n0", "both", 3, limit)
        assert (mine, ends[s]) == ([w[:2] for w in want], cut), (s, es)


@pytest.mark.parametrize("limit", [None, 6])
def test_trace(random_graphs, limit):
    all_edges, g, seeds = random_graphs
    nodes = F.concat_ws("|", F.transform("path", lambda h: h.node)).alias("nodes")
    if limit is None:
        got, ends = T.trace_many(g, seeds, "both", 3).select("snapshot_key", nodes).collect(), None
    else:
        b = T.trace_bounded(g, seeds, "both", 3, limit)
        got, ends = b.hits.select("snapshot_key", nodes).collect(), {r.snapshot_key: r.truncated for r in b.ends.collect()}
    for s, es in all_edges.items():
        want, cut = queue_trace(es, "n0", "both", 3, limit)
        assert sorted(r.nodes for r in got if r.snapshot_key == s) == sorted(want), (s, es)
        assert ends is None or ends[s] == cut


@pytest.mark.parametrize("limit,edge_type", [(0, None), (2, None), (4, None), (3, "TABLE_HAS_COLUMN")])
def test_filtered_traversal(random_graphs, limit, edge_type):
    all_edges, g, seeds = random_graphs
    got = T.filtered_traversal(g, seeds, "both", 3, limit, edge_type)
    hits, ends = got.hits.collect(), {r.snapshot_key: r.truncated for r in got.ends.collect()}
    for s, es in all_edges.items():
        mine = [(r.node_key, r.depth, r.edge_key) for r in sorted((r for r in hits if r.snapshot_key == s), key=lambda r: (r.depth, r.ord))]
        want, cut = queue_filtered(es, "n0", "both", 3, limit, edge_type)
        assert (mine, ends[s]) == (want, cut), (s, es)


def test_edge_cases(spark):
    g, seeds = frames(spark, {"s": [("e1", "n0", "n1", TYPES[0]), ("e2", "n1", "n0", TYPES[0])]})
    assert [r.node_key for r in T.impact_many(g, seeds, "outbound", 8).collect()] == ["n1"]
    lost = spark.createDataFrame([("s", "nobody")], "snapshot_key string, seed string")
    assert T.impact_bounded(g, lost, "both", 3, 5).ends.count() == 0
    assert T.trace_many(g, seeds, "both", 0).count() == 0
    with pytest.raises(ValueError):
        T.impact_many(g, seeds, "sideways", 1)


def test_diff_budget_is_shared_in_order(spark):
    """D6's fold against walking the seeds one by one with what is left."""
    edges = graphs(1, 99)["s0"] + [(f"f{i}", "n0", f"n{i}", TYPES[i % 4]) for i in range(1, 7)]
    g, _ = frames(spark, {"p:a": [], "p:b": edges})
    g.nodes = g.nodes.where("snapshot_key = 'p:b' or node_key = 'none'")
    pairs = spark.createDataFrame([("x", "p:a", "p:b")], "pair string, a string, b string")
    got = D.schema_diff(g, pairs, 5)
    budgets = {r.seed: r.budget for r in got["seeds"].collect()}
    left = 5
    for seed in sorted(f"n{i}" for i in range(7))[:5]:
        assert budgets[seed] == left, seed
        left -= len(queue_impact(edges, seed, "both", 2, left)[0])
