"""Snapshot diffs (D1 to D7) by alias-neutral keys, for any number of pairs(pair, a, b) of snapshots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import comparable_edge_key, comparable_key, comparable_payload
from ..plans.model import MAX_RESULTS, Graph
from ..plans.shared import written
from .traverse import impact_bounded, impact_many

IMPACT_DEPTH = 2


def _sides(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of either snapshot of each pair, with pair and side."""
    ends = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("snapshot_key")), F.struct(F.lit("b").alias("side"), F.col("b").alias("snapshot_key")))).alias("e")).select("pair", "e.*")
    return df.join(ends, "snapshot_key")


def _last(side: str, *fields: str) -> Column:
    """Of the rows of a side the last by the first field."""
    return F.max(F.when(F.col("side") == side, F.struct(*fields))).alias(side)


def node_changes(g: Graph, pairs: DataFrame) -> DataFrame:
    """(pair, change, ckey, node_key, label) of nodes that were added, removed or changed (label, name or alias-neutral payload); node_key is of b, of removed nodes of a.

    One aggregation of both sides by their alias-neutral key; payloads go in as hashes of what is left without aliases. Only where those alone differ are payloads fetched and compared in canonical order.
    """
    plain = F.md5(F.regexp_replace("payload_json", '"connection_alias":"[^"\\\\]*",?', "").cast("binary"))
    rows = _sides(g.nodes, pairs).select("pair", "side", comparable_key(F.col("node_key")).alias("ckey"), "snapshot_key", "node_key", "label", "display_name", plain.alias("payload"))
    fields = ["node_key", "snapshot_key", "label", "display_name", "payload"]
    both = rows.groupBy("pair", "ckey").agg(_last("a", *fields), _last("b", *fields))
    differ = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~(F.col("a.label").eqNullSafe(F.col("b.label")) & F.col("a.display_name").eqNullSafe(F.col("b.display_name"))), "changed").when(~F.col("a.payload").eqNullSafe(F.col("b.payload")), "unsure")
    found = written(both.withColumn("change", differ).where("change is not null"), "node_changes")
    # A payload is brought to canonical order only behind the join, where plain texts differ: that costs many times the join.
    unsure = found.where("change = 'unsure'").select("pair", "ckey", F.explode(F.array(*[F.struct(F.col(f"{x}.snapshot_key").alias("snapshot_key"), F.col(f"{x}.node_key").alias("node_key")) for x in ("a", "b")])).alias("e")).select("pair", "ckey", "e.*")
    texts = unsure.join(g.nodes.select("snapshot_key", "node_key", "payload_json"), ["snapshot_key", "node_key"]).select("pair", "ckey", F.coalesce(F.md5(comparable_payload(F.col("payload_json")).cast("binary")), F.lit("")).alias("payload"))
    apart = texts.groupBy("pair", "ckey").agg(F.min("payload").alias("least"), F.max("payload").alias("most")).where("least <> most").select("pair", "ckey")
    changed = found.where("change = 'unsure'").join(apart, ["pair", "ckey"], "left_semi").select("pair", F.lit("changed").alias("change"), "ckey", "a", "b")
    end = F.coalesce("b", "a")
    return found.where("change <> 'unsure'").select("pair", "change", "ckey", "a", "b").unionByName(changed).select("pair", "change", "ckey", end["node_key"].alias("node_key"), end["label"].alias("label"))


def diff_nodes(g: Graph, pairs: DataFrame) -> DataFrame:
    """Added and removed nodes."""
    return node_changes(g, pairs).where("change <> 'changed'")


def changed_nodes(g: Graph, pairs: DataFrame) -> DataFrame:
    """D2."""
    return node_changes(g, pairs).where("change = 'changed'")


def diff_edges(g: Graph, pairs: DataFrame) -> DataFrame:
    """D3: (pair, change, ckey, edge_key, edge_type); payloads and ordinals don't count, edges that only differ in those are one, the last by key."""
    rows = _sides(g.edges, pairs).select("pair", "side", comparable_edge_key(F.col("edge_type"), F.col("edge_from"), F.col("edge_to")).alias("ckey"), "edge_type", "edge_key")
    both = rows.groupBy("pair", "ckey", "edge_type").agg(*[F.max(F.when(F.col("side") == x, F.col("edge_key"))).alias(x) for x in ("a", "b")])
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
    return both.select("pair", change.alias("change"), "ckey", F.coalesce("b", "a").alias("edge_key"), "edge_type").where("change is not null")


def impact_seeds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, snapshot_key, seed): added and changed nodes in b, removed ones in a."""
    own = nodes.join(pairs, "pair")
    return own.select("pair", F.when(F.col("change") == "removed", F.col("a")).otherwise(F.col("b")).alias("snapshot_key"), F.col("node_key").alias("seed")).distinct()


def diff_impact(g: Graph, seeds: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """The nodes within depth of every seed, both ways."""
    return impact_many(g, seeds.select("snapshot_key", "seed"), "both", depth)


def _cut(df: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("pair", "change").orderBy("ckey"))
    return df.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def change_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of D6 the exact counts, (pair, what, n), of changes as node_changes and diff_edges give them."""
    return nodes.select("pair", F.concat(F.lit("nodes_"), "change").alias("what")).unionByName(edges.select("pair", F.concat(F.lit("edges_"), "change").alias("what"))).groupBy("pair", "what").agg(F.count("*").alias("n"))


def schema_diff(g: Graph, pairs: DataFrame, limit: int = MAX_RESULTS) -> dict[str, DataFrame]:
    """Nodes and edges cut to limit for each change, exact counts, and the impact of the first limit seeds in order of (snapshot, key), which share one budget of limit fetched edges in that order.

    A walk with a smaller budget finds a prefix of what one with a larger budget finds. So one bounded walk of all seeds gives each hit's position; then, a pair's seeds in order, each leaves the next what its hits have not used. The fold runs over the sorted list of at most limit seeds of a pair, in one aggregate expression.
    """
    nodes, edges = written(node_changes(g, pairs), "node_changes"), written(diff_edges(g, pairs), "edge_changes")
    counts = change_counts(nodes, edges)
    seeds = impact_seeds(nodes, pairs)
    n_seeds = seeds.groupBy("pair").agg(F.count("*").alias("impacted_seeds"))
    seeds = seeds.withColumn("k", F.row_number().over(W.partitionBy("pair").orderBy("snapshot_key", "seed"))).where(F.col("k") <= limit)
    walk = impact_bounded(g, seeds.select("snapshot_key", "seed"), "both", IMPACT_DEPTH, limit)
    at = walk.hits.groupBy("snapshot_key", "seed").agg(F.collect_list("position").alias("positions"))
    of_seed = seeds.join(at, ["snapshot_key", "seed"], "left").join(walk.ends, ["snapshot_key", "seed"], "left")
    row = F.struct("k", "snapshot_key", "seed", F.coalesce("positions", F.array().cast("array<bigint>")).alias("positions"))
    start = F.struct(F.lit(limit).cast("bigint").alias("r"), F.array().cast("array<struct<k:int,budget:bigint>>").alias("out"))

    def step(acc, x):
        used = F.size(F.filter(x.positions, lambda p: p <= acc.r)).cast("bigint")
        return F.struct((acc.r - used).alias("r"), F.concat(acc.out, F.array(F.struct(x.k.cast("int").alias("k"), acc.r.alias("budget")))).alias("out"))

    folded = of_seed.groupBy("pair").agg(F.array_sort(F.collect_list(row)).alias("s")).select("pair", F.explode(F.aggregate("s", start, step).out).alias("f"))
    budgets = folded.select("pair", "f.k", "f.budget")
    impact = seeds.join(budgets, ["pair", "k"]).join(walk.hits, ["snapshot_key", "seed"]).where("position <= budget")
    cut = F.coalesce(F.col("truncated") | (F.col("used") > F.col("budget")), F.lit(False))
    seeds = seeds.join(budgets, ["pair", "k"]).join(walk.ends, ["snapshot_key", "seed"], "left").select("pair", "k", "snapshot_key", "seed", "budget", cut.alias("truncated"))
    return {"nodes": _cut(nodes, limit), "edges": _cut(edges, limit), "counts": counts, "impact": impact, "seeds": seeds, "n_seeds": n_seeds}


COUNTS = ["nodes_added", "nodes_removed", "nodes_changed", "edges_added", "edges_removed"]


def diff_envelope(g: Graph, pairs: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """A row for each pair: six counts (impacted_seeds: the nodes whose impact is asked for), the limit, and whether a list or the seeds are cut, or the impact of a seed that is walked from, which impact_truncated tells apart."""
    parts = schema_diff(g, pairs, limit)
    found = parts["counts"].groupBy("pair").agg(*[F.sum(F.when(F.col("what") == n, F.col("n")).otherwise(0)).alias(n) for n in COUNTS])
    cut = parts["seeds"].groupBy("pair").agg(F.bool_or("truncated").alias("impact_truncated"))
    out = pairs.select("pair").join(found, "pair", "left").join(parts["n_seeds"], "pair", "left").na.fill(0).join(cut, "pair", "left").na.fill(False)
    return out.withColumn("limit_applied", F.lit(limit)).withColumn("truncated", (F.greatest(*COUNTS, "impacted_seeds") > limit) | F.col("impact_truncated"))
