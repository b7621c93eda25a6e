"""Traversals (G1 to G9): breadth-first impact, simple-path traces and graph queries, for any number of seeds at once.

A queue visits a level's nodes in the order in which they were found, and a level is a few joins and an aggregation; levels are at most MAX_DEPTH and each is written. What is walked is narrow: seeds and edges are numbers, edges in order of their keys, and nodes are digests of their keys; names are joined to what is found in the end. A walk with a budget adds up its nodes' numbers of edges first, so that only edges that it fetches become rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import contains_ci, edge_priority, parse_key, payload_array_len_ge
from ..plans.model import MAX_DEPTH, MAX_QUERY, MAX_RESULTS, Graph
from ..plans.shared import written

SEED = ["snapshot_key", "seed"]
BOTH = {"outbound": ["outbound"], "inbound": ["inbound"], "both": ["outbound", "inbound"]}


def directions(direction: str) -> list[str]:
    if direction not in BOTH:
        raise ValueError(f"unknown direction {direction}")
    return BOTH[direction]


def _kept(df: DataFrame) -> DataFrame:
    """A level as a written table: plans stay small, and no lost executor takes a level along."""
    return written(df, "level")


def _steps(edges: DataFrame, direction: str, bounded: bool) -> DataFrame:
    """(snapshot_key, at, next, rank, edge_key, edge_type, edge_from, edge_to): what leads on from each node. The rank is the edge's priority if bounded, else its direction; a self-loop counts once if bounded."""
    parts = []
    for k, d in enumerate(directions(direction)):
        own, other = ("edge_from", "edge_to") if d == "outbound" else ("edge_to", "edge_from")
        rank = edge_priority(F.col("edge_type")) if bounded else F.lit(k)
        rows = edges if not (bounded and k) else edges.where("edge_from <> edge_to")
        parts.append(rows.select("snapshot_key", F.col(own).alias("at"), F.col(other).alias("next"), rank.alias("rank"), "edge_key", "edge_type", "edge_from", "edge_to"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


EDGE = ["snapshot_key", "edge_key", "edge_type", "edge_from", "edge_to"]


def _id(key: str) -> Column:
    """16 bytes that stand for a snapshot's node."""
    return F.unhex(F.md5(F.concat_ws(":", F.length("snapshot_key").cast("string"), "snapshot_key", key).cast("binary")))


def _numbered(edges: DataFrame) -> DataFrame:
    """A written table of edges, each with its place in order of keys as a number, edge."""
    return written(edges.select(*EDGE).orderBy("edge_key", "snapshot_key").withColumn("edge", F.monotonically_increasing_id()), "edges")


def _narrow(numbered: DataFrame, direction: str, bounded: bool) -> DataFrame:
    """As _steps over numbered edges: (at, next, rank, edge, out, next_key, edge_type); out: at is the edge's start."""
    parts = []
    for k, d in enumerate(directions(direction)):
        own, other = ("edge_from", "edge_to") if d == "outbound" else ("edge_to", "edge_from")
        rank = edge_priority(F.col("edge_type")) if bounded else F.lit(k)
        rows = numbered if not (bounded and k) else numbered.where("edge_from <> edge_to")
        parts.append(rows.select(_id(own).alias("at"), _id(other).alias("next"), rank.alias("rank"), "edge", F.lit(d == "outbound").alias("out"), F.col(other).alias("next_key"), "edge_type"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


#: As many seeds at most are walked from over the edges near them alone.
FEW = 10_000


def _near(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, limit: int) -> DataFrame:
    """The edges that walks of few seeds can fetch with that budget: of each node that they can come to the first limit + 1 by (priority, edge_key). So the other edges are neither sorted nor shuffled."""
    at, near = seeds.select("snapshot_key", F.col("seed").alias("at")), []
    for _ in range(depth):
        steps = _steps(edges, direction, bounded=True).join(at.distinct(), ["snapshot_key", "at"], "left_semi")
        place = F.row_number().over(W.partitionBy("snapshot_key", "at").orderBy("rank", "edge_key"))
        near.append(_kept(steps.withColumn("place", place).where(F.col("place") <= limit + 1)))
        at = near[-1].select("snapshot_key", F.col("next").alias("at"))
    return reduce(DataFrame.unionByName, near).select(*EDGE).distinct() if near else edges.where("false")


@dataclass
class _Walk:
    """What bounded walks share: seeds (sid, snapshot_key, seed, node), numbered edges, of each node the first limit + 1 steps (at, place, next, edge, out and more), and how many those are (node, n)."""

    seeds: DataFrame
    edges: DataFrame
    steps: DataFrame
    sizes: DataFrame


def _seeds(g: Graph, seeds: DataFrame) -> DataFrame:
    return written(existing(g, seeds).withColumn("sid", F.monotonically_increasing_id()).withColumn("node", _id("seed")), "seeds")


def _walk(g: Graph, seeds: DataFrame, edges: DataFrame, direction: str, depth: int, limit: int, *more: str) -> _Walk:
    """No walk with that budget gets further into a node than its first limit + 1 steps by (priority, edge_key), so that a hub costs no more."""
    seeds = _seeds(g, seeds)
    if seeds.limit(FEW + 1).count() <= FEW:
        edges = _near(edges, seeds, direction, depth, limit)
    edges = _numbered(edges)
    place = F.row_number().over(W.partitionBy("at").orderBy("rank", "edge"))
    steps = _narrow(edges, direction, bounded=True).select("at", "next", "rank", "edge", "out", *more)
    steps = written(steps.withColumn("place", place).where(F.col("place") <= limit + 1).drop("rank"), "steps")
    sizes = written(steps.groupBy(F.col("at").alias("node")).agg(F.max("place").alias("n")), "sizes")
    return _Walk(seeds, edges, steps, sizes)


def existing(g: Graph, seeds: DataFrame) -> DataFrame:
    """seeds(snapshot_key, seed) that are nodes."""
    return seeds.select(*SEED).distinct().join(g.nodes.select("snapshot_key", F.col("node_key").alias("seed")), SEED, "left_semi")


def _first_level(g: Graph, seeds: DataFrame) -> DataFrame:
    return existing(g, seeds).select(*SEED, F.col("seed").alias("node"), F.array().cast("array<struct<rank:int,edge_key:string>>").alias("ord"))


def _expanded(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    got = frontier.withColumnRenamed("node", "at").join(steps, ["snapshot_key", "at"])
    return got.withColumn("ord", F.concat("ord", F.array(F.struct(F.col("rank").cast("int").alias("rank"), "edge_key"))))


VIA = ["edge_key", "edge_type", "edge_from", "edge_to"]


def _new(rows: DataFrame, visited: DataFrame, *order: str) -> DataFrame:
    """(sid, node, d): of each node that isn't in visited(sid, node) the first of its rows."""
    fields = [F.col(c) for c in order]
    seen = visited.select("sid", "node", F.lit(None).cast(rows.select(F.struct(*fields)).schema[0].dataType).alias("d"))
    both = rows.select("sid", "node", F.struct(*fields).alias("d")).unionByName(seen)
    return both.groupBy("sid", "node").agg(F.min("d").alias("d"), F.bool_or(F.col("d").isNull()).alias("seen")).where("not seen").drop("seen")


@dataclass
class Bounded:
    """hits, and (snapshot_key, seed, used, truncated) for each seed that exists."""

    hits: DataFrame
    ends: DataFrame


def impact_many(g: Graph, seeds: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """(snapshot_key, seed, node_key, label, display_name, depth, edge_type, edge_from, edge_to, ord) of all nodes within depth, each once, by the edge that a queue would find it by; ord sorts as the queue. Seeds that are no nodes give nothing; a seed is no result of its own."""
    directions(direction)
    starts, edges = _seeds(g, seeds), _numbered(g.edges)
    # An edge's place at a node is its direction and number as one, and a node's place in the queue is those of the edges that lead to it.
    steps = _narrow(edges, direction, bounded=False).select("at", "next", (F.shiftleft(F.col("rank").cast("long"), 60) + F.col("edge")).alias("step"))
    frontier = starts.select("sid", "node", F.array().cast("array<bigint>").alias("ord"))
    visited, levels = frontier.select("sid", "node"), []
    for k in range(1, min(depth, MAX_DEPTH) + 1):
        rows = frontier.join(steps, frontier["node"] == steps["at"]).select("sid", F.col("next").alias("node"), F.concat("ord", F.array("step")).alias("ord"))
        frontier = _kept(_new(rows, visited, "ord").select("sid", "node", "d.ord"))
        visited = visited.unionByName(frontier.select("sid", "node"))
        step = F.element_at("ord", -1)
        out = F.lit(direction == "outbound") if direction != "both" else F.shiftright(step, 60) == 0
        levels.append(frontier.select("sid", "node", "ord", F.lit(k).alias("depth"), step.bitwiseAND(F.lit((1 << 60) - 1)).alias("edge"), out.alias("out")))
    found = reduce(DataFrame.unionByName, levels) if levels else frontier.where("false").select("sid", "node", "ord", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("edge"), F.lit(True).alias("out"))
    return _named(g, starts, edges, found).select(*HIT, "edge_key", "edge_type", "edge_from", "edge_to", "ord")


HIT = [*SEED, "node_key", "label", "display_name", "depth"]


def _named(g: Graph, seeds: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """found(sid, node, edge, out, ...) with the names of seeds, nodes and edges; narrow tables are joined first."""
    nodes = g.nodes.select(_id("node_key").alias("node"), "label", "display_name")
    got = found.join(nodes, "node").drop("node").join(seeds.select("sid", *SEED), "sid").drop("sid").join(edges.drop("snapshot_key"), "edge")
    return got.withColumn("node_key", F.when(F.col("out"), F.col("edge_to")).otherwise(F.col("edge_from")))


def _placed(w: _Walk, frontier: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """The nodes of a level from which edges are fetched, and the first from which none are any more: frontier with n (edges, at most limit + 1) and before, how many its seed's walk has fetched before them."""
    live = frontier.join(ends.where("not truncated"), "sid").join(w.sizes, "node")
    behind = F.sum("n").over(W.partitionBy("sid").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    return _kept(live.withColumn("before", F.col("used") + F.coalesce(behind, F.lit(0))).where(F.col("before") <= limit).drop("used", "truncated"))


def _fetched(live: DataFrame, steps: DataFrame, limit: int) -> DataFrame:
    return live.join(steps, (live["node"] == steps["at"]) & (live["before"] + steps["place"] <= limit)).withColumn("position", F.col("before") + F.col("place")).drop("node", "at", "place", "before", "n")


def _ends(ends: DataFrame, live: DataFrame, limit: int) -> DataFrame:
    sums = live.groupBy("sid").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    total = F.coalesce("total", "used")
    return _kept(ends.join(sums, "sid", "left").select("sid", F.least(F.lit(limit), total).cast("long").alias("used"), (F.col("truncated") | (total > limit)).alias("truncated")))


def _begun(seeds: DataFrame) -> DataFrame:
    return seeds.select("sid", F.lit(0).cast("long").alias("used"), F.lit(False).alias("truncated"))


def _ended(w: _Walk, ends: DataFrame) -> DataFrame:
    return w.seeds.select("sid", *SEED).join(ends, "sid").drop("sid")


def impact_bounded(g: Graph, seeds: DataFrame, direction: str = "both", depth: int = 3, limit: int = MAX_RESULTS) -> Bounded:
    """As impact_many, but a seed has a budget of limit fetched edges: a level's edges count in order of (parent, priority, edge_key), those to visited nodes too; where they exceed what is left, the rest is cut and the walk ends. position counts a hit's edge among all fetched."""
    limit, depth = min(limit, MAX_RESULTS), min(depth, MAX_DEPTH)
    w = _walk(g, seeds, g.edges, direction, depth, limit)
    frontier = w.seeds.select("sid", "node", F.lit(0).cast("long").alias("position"))
    visited, ends, levels = frontier.select("sid", "node"), _begun(w.seeds), []
    for k in range(1, depth + 1):
        live = _placed(w, frontier, ends, limit)
        rows = _fetched(live, w.steps, limit).withColumnRenamed("next", "node")
        first = _kept(_new(rows, visited, "position", "edge", "out").select("sid", "node", "d.*"))
        ends = _ends(ends, live, limit)
        visited, frontier = visited.unionByName(first.select("sid", "node")), first.select("sid", "node", "position")
        levels.append(first.withColumn("depth", F.lit(k)))
    found = reduce(DataFrame.unionByName, levels) if levels else _none(w)
    return Bounded(_named(g, w.seeds, w.edges, found).select(*HIT, "edge_type", "edge_from", "edge_to", "position"), _ended(w, ends))


def _none(w: _Walk) -> DataFrame:
    return w.seeds.where("false").select("sid", "node", F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("edge"), F.lit(True).alias("out"), F.lit(0).alias("depth"))


HOP = "array<struct<node:string,edge_type:string,edge_from:string,edge_to:string>>"


def _paths(g: Graph, seeds: DataFrame) -> DataFrame:
    start = F.array(F.struct(F.col("seed").alias("node"), *[F.lit(None).cast("string").alias(x) for x in VIA[1:]])).cast(HOP)
    return _first_level(g, seeds).withColumn("path", start)


def _longer(rows: DataFrame) -> DataFrame:
    """Paths one hop on, none through a node twice."""
    free = rows.where(~F.array_contains(F.transform("path", lambda h: h.node), F.col("next")))
    hop = F.struct(F.col("next").alias("node"), *VIA[1:])
    return free.withColumn("path", F.concat("path", F.array(hop)).cast(HOP)).withColumn("node", F.col("next"))


def trace_many(g: Graph, seeds: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """(snapshot_key, seed, depth, path, ord): every simple path of 1 to depth hops; a hop is a node with the edge that leads to it, the first hop (the seed) has none; ord sorts as the queue. Depth 0 gives nothing."""
    steps, frontier = _steps(g.edges, direction, bounded=False), _kept(_paths(g, seeds))
    found = frontier.where("false").select(*SEED, F.lit(0).alias("depth"), "path", "ord")
    for k in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = _kept(_longer(_expanded(frontier.select(*SEED, "node", "ord", "path"), steps)))
        found = found.unionByName(frontier.select(*SEED, F.lit(k).alias("depth"), "path", "ord"))
    return found


def trace_bounded(g: Graph, seeds: DataFrame, direction: str = "both", depth: int = 3, limit: int = MAX_RESULTS) -> Bounded:
    """As trace_many, with the budget of impact_bounded; edges to nodes on the path use it up too. While it is walked, a hop is its node, its edge's type and direction: the edge's ends are nodes of the path."""
    limit, depth = min(limit, MAX_RESULTS), min(depth, MAX_DEPTH)
    w = _walk(g, seeds, g.edges, direction, depth, limit, "next_key", "edge_type")
    hop = lambda node, kind, out: F.array(F.struct(node.alias("node"), kind.alias("edge_type"), out.alias("out")))
    start = hop(F.col("seed"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    frontier = w.seeds.select("sid", "node", F.lit(0).cast("long").alias("position"), start.alias("path"))
    found, ends = frontier.where("false").select("sid", F.lit(0).alias("depth"), "path", "position"), _begun(w.seeds)
    for k in range(1, depth + 1):
        live = _placed(w, frontier, ends, limit)
        free = _fetched(live, w.steps, limit).where(~F.array_contains(F.transform("path", lambda h: h.node), F.col("next_key")))
        longer = F.concat("path", hop(F.col("next_key"), F.col("edge_type"), F.col("out")))
        frontier = _kept(free.select("sid", F.col("next").alias("node"), "position", longer.alias("path")))
        ends = _ends(ends, live, limit)
        found = found.unionByName(frontier.select("sid", F.lit(k).alias("depth"), "path", "position"))
    before = lambda i: F.get(F.col("path"), i - 1)["node"]
    full = F.transform("path", lambda h, i: F.struct(h.node.alias("node"), h.edge_type.alias("edge_type"), F.when(h.out, before(i)).when(~h.out, h.node).alias("edge_from"), F.when(h.out, h.node).when(~h.out, before(i)).alias("edge_to")))
    return Bounded(found.join(w.seeds.select("sid", *SEED), "sid").select(*SEED, "depth", full.cast(HOP).alias("path"), "position"), _ended(w, ends))


def filtered_traversal(g: Graph, seeds: DataFrame, direction: str = "both", depth: int = 3, limit: int = MAX_QUERY, edge_type: str | None = None) -> Bounded:
    """A seed's budget counts hits, not edges. Parents are taken in order; the first that has more edges than hits are left, or that comes up when none is left, ends the walk: its first edges up to what is left still count. The type is filtered before anything is bounded."""
    limit, depth = min(limit, MAX_QUERY), min(depth, MAX_DEPTH)
    edges = g.edges if edge_type is None else g.edges.where(F.col("edge_type") == edge_type)
    w = _walk(g, seeds, edges, direction, depth, limit)
    frontier = w.seeds.select("sid", "node", F.lit(0).cast("long").alias("parent"))
    visited, ends, levels = frontier.select("sid", "node"), _begun(w.seeds), []
    for k in range(1, depth + 1):
        live = frontier.join(ends.where("not truncated").drop("truncated"), "sid").join(w.sizes, "node", "left").na.fill(0, ["n"])
        # A parent with more edges than any can have left at this level ends the walk for sure: what comes behind it isn't expanded.
        last = F.min(F.when(F.col("n") > F.lit(limit) - F.col("used"), F.col("parent"))).over(W.partitionBy("sid"))
        live = _kept(live.withColumn("last", last).where("last is null or parent <= last").drop("last"))
        rows = live.join(w.steps, (live["node"] == w.steps["at"]) & (w.steps["place"] <= F.lit(limit) - live["used"])).select("sid", "parent", "place", F.col("next").alias("node"), "edge", "out")
        fresh = _kept(_new(rows, visited, "parent", "place", "edge", "out").select("sid", "node", "d.*"))
        new = fresh.groupBy("sid", "parent").agg(F.count("*").alias("n_new"))
        parents = live.select("sid", "parent", "used", "n").join(new, ["sid", "parent"], "left").na.fill(0, ["n_new"])
        before = F.coalesce(F.sum("n_new").over(W.partitionBy("sid").orderBy("parent").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        parents = parents.withColumn("rem", F.lit(limit) - F.col("used") - before)
        cuts = _kept(parents.where("rem <= 0 or n > rem").groupBy("sid").agg(F.min(F.struct("parent", "rem")).alias("c")))
        hits = fresh.join(cuts, "sid", "left").where("c is null or parent < c.parent or (parent = c.parent and place <= c.rem)")
        order = F.row_number().over(W.partitionBy("sid").orderBy("parent", "place")).cast("long")
        hits = _kept(hits.select("sid", "node", "edge", "out", order.alias("ord")))
        got = hits.groupBy("sid").agg(F.count("*").alias("n"))
        ends = _kept(ends.join(got, "sid", "left").join(cuts.select("sid", F.lit(True).alias("now")), "sid", "left").select("sid", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used"), (F.col("truncated") | F.coalesce("now", F.lit(False))).alias("truncated")))
        visited, frontier = visited.unionByName(hits.select("sid", "node")), hits.select("sid", "node", F.col("ord").alias("parent"))
        levels.append(hits.withColumn("depth", F.lit(k)))
    found = reduce(DataFrame.unionByName, levels) if levels else _none(w).withColumn("ord", F.lit(0).cast("long"))
    return Bounded(_named(g, w.seeds, w.edges, found).select(*HIT, "edge_key", "edge_type", "edge_from", "edge_to", "ord"), _ended(w, ends))


@dataclass
class Query:
    """What query_graph is asked for; every filter may be left out."""

    label: str | None = None
    key_contains: str | None = None
    name_contains: str | None = None
    array_field: str | None = None
    array_min: int | None = None
    edge_type: str | None = None
    start: str | None = None
    direction: str = "both"
    depth: int = 3
    limit: int = 100


def query_graph(g: Graph, snapshot_key: str, q: Query) -> tuple[DataFrame, dict]:
    """Nodes, then edges of a type (where nothing is traversed), then a traversal's hits, within one limit: (part, key, kind, depth) and the envelope."""
    limit = remaining = min(q.limit, MAX_QUERY)
    truncated, parts = False, []
    here = lambda df: df.where(F.col("snapshot_key") == snapshot_key)
    filters: list[Column] = []
    if q.label is not None:
        filters.append(F.col("label") == q.label)
    if q.key_contains is not None:
        filters.append(contains_ci(F.col("node_key"), q.key_contains))
    if q.name_contains is not None:
        filters.append(contains_ci(F.col("display_name"), q.name_contains))
    if q.array_field is not None:
        filters.append(payload_array_len_ge(F.col("payload_json"), q.array_field, q.array_min or 0))

    def take(df: DataFrame, order: str, remaining: int) -> tuple[DataFrame, int, bool]:
        got = _kept(df.orderBy(order).limit(remaining + 1))
        n = got.count()
        return got.orderBy(order).limit(remaining), min(n, remaining), n > remaining

    if filters or (q.edge_type is None and q.start is None):
        rows = here(g.nodes)
        for f in filters:
            rows = rows.where(f)
        page, n, more = take(rows, "node_key", remaining)
        parts.append(page.select(F.lit("node").alias("part"), F.col("node_key").alias("key"), F.col("label").alias("kind"), F.lit(None).cast("int").alias("depth")))
        truncated, remaining = truncated or more, remaining - n
    if q.start is None and q.edge_type is not None:
        page, n, more = take(here(g.edges).where(F.col("edge_type") == q.edge_type), "edge_key", remaining)
        parts.append(page.select(F.lit("edge").alias("part"), F.col("edge_key").alias("key"), F.col("edge_type").alias("kind"), F.lit(None).cast("int").alias("depth")))
        truncated, remaining = truncated or more, remaining - n
    if q.start is not None:
        seeds = g.nodes.sparkSession.createDataFrame([(snapshot_key, q.start)], "snapshot_key string, seed string")
        got = filtered_traversal(g, seeds, q.direction, q.depth, remaining, q.edge_type)
        parts.append(got.hits.select(F.lit("hit").alias("part"), F.col("node_key").alias("key"), F.col("label").alias("kind"), "depth"))
        truncated = truncated or bool((got.ends.first() or {"truncated": False})["truncated"])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, {"limit_requested": q.limit, "limit_applied": limit, "limit_clamped": q.limit != limit, "depth_applied": min(q.depth, MAX_DEPTH) if q.start else None, "truncated": truncated}


def resolve_starts(g: Graph, requests: DataFrame) -> DataFrame:
    """requests(snapshot_key, object_key, table_name, column_name) -> the same with status and start: an object's key, or a table by name, or a column of it, or a column name that is unique; else missing, not_found or ambiguous. A request that is made twice is answered twice, each alike."""
    at = ["snapshot_key", "object_key", "table_name", "column_name"]
    r = requests.select(*at).distinct()
    obj = g.nodes.select("snapshot_key", F.col("node_key").alias("object_key"), F.col("node_key").alias("hit"))
    tables = g.nodes.where("label = 'Table'").select("snapshot_key", F.col("display_name").alias("table_name"), F.col("node_key").alias("hit"))
    cols = g.nodes.where("label = 'Column'").select("snapshot_key", F.col("display_name").alias("column_name"), parse_key(F.col("node_key"))["object_name"].alias("table_name"), F.col("node_key").alias("hit"))
    named = r.where("object_key is null")
    by_key = r.where("object_key is not null").join(obj, ["snapshot_key", "object_key"])
    by_table = named.where("table_name is not null and column_name is null").join(tables, ["snapshot_key", "table_name"])
    by_both = named.where("table_name is not null and column_name is not null").join(cols, ["snapshot_key", "table_name", "column_name"])
    by_column = named.where("table_name is null and column_name is not null").join(cols.drop("table_name"), ["snapshot_key", "column_name"])
    found = reduce(DataFrame.unionByName, [x.select(*at, "hit") for x in (by_key, by_table, by_both, by_column)]).groupBy(*at).agg(F.count("*").alias("n"), F.min("hit").alias("hit"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in at], "n", "hit")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at])
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").when(F.coalesce("object_key", "table_name", "column_name").isNull(), "missing").otherwise("not_found")
    return requests.join(found, same, "left").select(*requests.columns, status.alias("status"), F.when(F.col("n") == 1, F.col("hit")).alias("start"))
