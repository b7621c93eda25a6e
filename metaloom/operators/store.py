"""The graph store: snapshot sinks (S9 to S12), lookups, search and pages (L1 to L17) over snapshots, nodes and edges."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions.keys import alias_of, contains_ascii_ci, edge_priority, kind_label, parse_key
from ..plans.model import LABELS, OTHER_LABEL, Graph
from .proof import Proof, authority, completeness

PAGE, MOST = 100, 500


# Sinks


#: Folders of a generation that snapshots are spread over by their hash: few, however many snapshots there are.
BUCKETS = 16


# The tables of a stored graph: the column that they are sorted by within a snapshot, and their columns.
STORED = {
    "snapshots": ("snapshot_key", "snapshot_key string, source string, captured_at_unix_ms long, payload_json string"),
    "nodes": ("node_key", "snapshot_key string, node_key string, label string, display_name string, payload_json string"),
    "edges": ("edge_from", "snapshot_key string, edge_key string, edge_from string, edge_to string, edge_type string, payload_json string"),
    "proof_heads": ("adapter", "snapshot_key string, contract_version int, adapter string, adapter_version string, server string, server_version string, catalogs array<string>, schemas array<string>"),
    "proof_counts": ("position", "snapshot_key string, domain string, position long, category string, discovered long, emitted long, evidence string"),
    "proof_checks": ("position", "snapshot_key string, position int, name string, evidence string"),
}
MANIFEST = "snapshot_key string, generation string, number long, writer string"


def _tables(g: Graph) -> dict[str, DataFrame]:
    own = {"snapshots": g.snapshots, "nodes": g.nodes, "edges": g.edges}
    return own if g.proof is None else own | {"proof_heads": g.proof.heads, "proof_counts": g.proof.counts, "proof_checks": g.proof.checks}


def _found(read, *, otherwise):
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return otherwise


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")


def write_snapshot(g: Graph, path: str, generation: str, accepted: DataFrame | None = None) -> None:
    """Whole snapshots, with their proofs if g has them, replace those of the same key. accepted: P6's verdicts; snapshots that it refuses aren't written.

    Each table goes to a folder of its own for this write, in buckets of snapshots and sorted by snapshot, so that readers prune by statistics. A manifest row for each snapshot, written last and as one file, is what readers go by: a failed write leaves the generation before in force. Nothing is ever overwritten, neither by a generation name that is used again nor by a writer at the same time: a write's folder and manifest have a unique name, its number is above all it has seen, and of writers with the same number the one with the greater name counts as the later.
    """
    spark, writer = g.nodes.sparkSession, uuid.uuid4().hex
    unique = f"{generation}-{writer}"
    keep = None if accepted is None else accepted.where("accepted").select("snapshot_key")
    kept = lambda df: df if keep is None else df.join(keep, "snapshot_key", "left_semi")
    for name, df in _tables(g).items():
        within, columns = STORED[name]
        df = kept(df).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(columns)], F.pmod(F.xxhash64("snapshot_key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        order = ["bucket", "snapshot_key", within]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/{name}/generation={unique}")
    number = _found(lambda: _manifest(spark, path).agg(F.max("number")).first()[0] or 0, otherwise=0) + 1
    rows = kept(g.snapshots).select("snapshot_key", F.lit(unique).alias("generation"), F.lit(number).cast("long").alias("number"), F.lit(writer).alias("writer"))
    rows.coalesce(1).write.parquet(f"{path}/manifest/at={number}-{writer}")


def in_force(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_key, generation): the latest write of each snapshot."""
    return _manifest(spark, path).groupBy("snapshot_key").agg(F.max_by("generation", F.struct("number", "writer")).alias("generation"))


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of the latest write of each snapshot, with its proofs where any write has them. The manifest is joined by generation, which the folders are partitioned by, so that Spark prunes them; no list of generations passes through the driver."""
    manifest = in_force(spark, path)

    def read(name: str) -> DataFrame | None:
        columns = f"{STORED[name][1]}, generation string, bucket int"
        rows = _found(lambda: spark.read.schema(columns).parquet(f"{path}/{name}"), otherwise=None)
        return rows and rows.join(manifest, ["snapshot_key", "generation"], "left_semi").drop("generation", "bucket")

    got = {name: read(name) for name in STORED}
    proof = None if got["proof_heads"] is None else Proof(got["proof_heads"], got["proof_counts"], got["proof_checks"])
    return Graph(got["snapshots"], got["nodes"], got["edges"], proof)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """What is in force under path, as one write under to: a store that was written snapshot by snapshot gets few folders again."""
    write_snapshot(read_graph(spark, path), to, "compact")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; of rows of new with the same keys the last by order stays (without order, the largest row)."""
    rest = [c for c in new.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)) if order else F.max(F.struct(*rest))
    newest = new.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*new.columns)
    newest = newest.select(*old.columns)
    return old.join(newest, keys, "left_anti").select(*old.columns).unionByName(newest)


def delete_snapshot(g: Graph, keys: DataFrame) -> Graph:
    """Snapshots of keys(snapshot_key) with all of their nodes and edges, and their proofs."""
    without = lambda df: df.join(keys, "snapshot_key", "left_anti")
    proof = g.proof and Proof(*[without(df) for df in (g.proof.heads, g.proof.counts, g.proof.checks)])
    return Graph(*[without(df) for df in (g.snapshots, g.nodes, g.edges)], proof)


def delete_nodes(g: Graph, keys: DataFrame) -> Graph:
    """Nodes of keys(snapshot_key, node_key), and the edges at them."""
    at = lambda end: keys.select("snapshot_key", F.col("node_key").alias(end))
    edges = g.edges.join(at("edge_from"), ["snapshot_key", "edge_from"], "left_anti").join(at("edge_to"), ["snapshot_key", "edge_to"], "left_anti").select(*g.edges.columns)
    return replace(g, nodes=g.nodes.join(keys, ["snapshot_key", "node_key"], "left_anti"), edges=edges)


def delete_edges(g: Graph, keys: DataFrame) -> Graph:
    return replace(g, edges=g.edges.join(keys, ["snapshot_key", "edge_key"], "left_anti"))


def to_json_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Each row as a JSON text, nulls included; keep: columns that also stay as they are."""
    return df.select(*keep, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


# Lookups


def node(g: Graph, snapshot_key: str, key: str) -> DataFrame:
    """L1."""
    return g.nodes.where((F.col("snapshot_key") == snapshot_key) & (F.col("node_key") == key))


def edge(g: Graph, snapshot_key: str, key: str) -> DataFrame:
    return g.edges.where((F.col("snapshot_key") == snapshot_key) & (F.col("edge_key") == key))


def nodes(g: Graph, snapshot_key: str, label: str | None = None) -> DataFrame:
    """L2."""
    got = g.nodes.where(F.col("snapshot_key") == snapshot_key)
    return (got if label is None else got.where(F.col("label") == label)).orderBy("node_key")


def edges(g: Graph, snapshot_key: str, from_: str | None = None, to: str | None = None, edge_type: str | None = None) -> DataFrame:
    """L3."""
    got = g.edges.where(F.col("snapshot_key") == snapshot_key)
    for name, value in (("edge_from", from_), ("edge_to", to), ("edge_type", edge_type)):
        got = got if value is None else got.where(F.col(name) == value)
    return got.orderBy("edge_key")


def adjacent(g: Graph, keys: DataFrame, direction: str, n: int, edge_type: str | None = None) -> DataFrame:
    """Of each of keys(snapshot_key, node_key) the first n edges of one direction by (priority, edge_key), or of one type by edge_key; the type is filtered before the bound. place counts from 1."""
    end = {"outbound": "edge_from", "inbound": "edge_to"}[direction]
    got = g.edges if edge_type is None else g.edges.where(F.col("edge_type") == edge_type)
    got = got.join(keys.select("snapshot_key", F.col("node_key").alias(end)), ["snapshot_key", end])
    order = ([edge_priority(F.col("edge_type"))] if edge_type is None else []) + [F.col("edge_key")]
    return got.withColumn("place", F.row_number().over(W.partitionBy("snapshot_key", end).orderBy(*order))).where(F.col("place") <= n)


def counts(g: Graph) -> DataFrame:
    """Nodes and edges of each snapshot."""
    n = g.nodes.groupBy("snapshot_key").agg(F.count("*").alias("nodes"))
    e = g.edges.groupBy("snapshot_key").agg(F.count("*").alias("edges"))
    return g.snapshots.select("snapshot_key").join(n, "snapshot_key", "left").join(e, "snapshot_key", "left").na.fill(0)


def paginate(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page by order, and its envelope. A limit of 0 is an error, one over the most is clamped."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    applied, total = min(limit, MOST), df.count()
    more = offset + applied < total
    return df.orderBy(*order).offset(offset).limit(applied), {"total": total, "offset": offset, "limit_requested": limit, "limit_applied": applied, "clamped": applied != limit, "has_more": more, "next_offset": offset + applied if more else None}


def matching_objects(g: Graph, snapshot_key: str, kind: str | None = None, query: str | None = None) -> DataFrame:
    got = g.nodes.where(F.col("snapshot_key") == snapshot_key)
    if kind is not None:
        got = got.where(F.col("label") == LABELS[kind])
    if query and query.strip():
        got = got.where(contains_ascii_ci(F.col("node_key"), query) | contains_ascii_ci(F.col("display_name"), query))
    return got


def list_objects(g: Graph, snapshot_key: str, kind: str | None = None, query: str | None = None, offset: int = 0, limit: int = PAGE) -> tuple[DataFrame, dict]:
    """A page of objects by (label, node_key), or by node_key where a kind is given."""
    order = ["label", "node_key"] if kind is None else ["node_key"]
    return paginate(matching_objects(g, snapshot_key, kind, query), order, offset, limit)


def find_objects(g: Graph, query: str) -> DataFrame:
    """L8 over all snapshots at once."""
    return g.nodes.where(contains_ascii_ci(F.col("node_key"), query) | contains_ascii_ci(F.col("display_name"), query))


def object_summary(nodes_: DataFrame) -> DataFrame:
    """The key's parts beside each node; status is invalid_metadata where the key can't be parsed or the label isn't its kind's."""
    p = parse_key(F.col("node_key"))
    fits = (F.col("label") == kind_label(p["object_kind"])) | (F.col("label") == OTHER_LABEL)
    return nodes_.select("snapshot_key", "node_key", "label", "display_name", p["object_kind"].alias("kind"), p["schema"].alias("schema"), p["object_name"].alias("object_name"), p["sub_object"].alias("sub_object"), F.when(F.coalesce(fits, F.lit(False)), "ok").otherwise("invalid_metadata").alias("status"))


def describe_objects(g: Graph, keys: DataFrame, n: int = PAGE) -> DataFrame:
    """Of each of keys(snapshot_key, node_key) its first n incoming and outgoing relations with the object at the other end, and whether there were more. n is at most 200."""
    n = min(n, 200)
    parts = []
    for direction, own, other in (("outbound", "edge_from", "edge_to"), ("inbound", "edge_to", "edge_from")):
        got = adjacent(g, keys, direction, n + 1)
        cut = F.max("place").over(W.partitionBy("snapshot_key", own)) > n
        parts.append(got.withColumn("truncated", cut).where(F.col("place") <= n).select("snapshot_key", F.col(own).alias("node_key"), F.lit(direction).alias("direction"), "place", "edge_type", F.col(other).alias("related_key"), "truncated"))
    related = g.nodes.select("snapshot_key", F.col("node_key").alias("related_key"), F.col("label").alias("related_label"), F.col("display_name").alias("related_name"))
    return parts[0].unionByName(parts[1]).join(related, ["snapshot_key", "related_key"], "left")


def list_snapshots(g: Graph) -> DataFrame:
    """Snapshots by key with authority (L14), counts, and the identity that a proof has verified."""
    rows = g.snapshots.select("snapshot_key", "source", "captured_at_unix_ms").join(authority(g).drop("issues"), "snapshot_key").join(counts(g), "snapshot_key")
    identity = ["adapter", "server", "server_version"]
    if g.proof is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(x) for x in identity])
    else:
        proven = F.col("authority") == "complete"
        rows = rows.join(g.proof.heads.select("snapshot_key", *identity), "snapshot_key", "left").select(*rows.columns, *[F.when(proven, F.col(x)).alias(x) for x in identity])
    alias = alias_of(F.col("snapshot_key"))
    return rows.select("snapshot_key", "contract_version", "authority", F.split("snapshot_key", ":")[0].alias("entrypoint_source"), "source", alias.alias("alias"), "captured_at_unix_ms", F.col("nodes").alias("objects"), F.col("edges").alias("relationships"), *identity).orderBy("snapshot_key")


def describe_snapshots(g: Graph, selectors: DataFrame) -> DataFrame:
    """selectors(selector) -> (selector, status, the columns of L11, completeness, issues): the proof as JSON where the snapshot is complete by it, and why not where it can't be verified."""
    found = resolve_snapshots(g, selectors).drop("candidates")
    rows = found.join(list_snapshots(g), "snapshot_key", "left").join(authority(g).select("snapshot_key", "issues"), "snapshot_key", "left")
    if g.proof is None:
        return rows.withColumn("completeness", F.lit(None).cast("string"))
    return rows.join(completeness(g), "snapshot_key", "left").withColumn("completeness", F.when(F.col("authority") == "complete", F.col("completeness")))


def resolve_snapshots(g: Graph, selectors: DataFrame) -> DataFrame:
    """selectors(selector) -> (selector, status, snapshot_key, candidates): an exact key, else the one snapshot of that alias; not_found, or ambiguous with the sorted candidates."""
    keys = g.snapshots.select("snapshot_key", alias_of(F.col("snapshot_key")).alias("alias"))
    exact = selectors.join(keys.select("snapshot_key"), F.col("selector") == F.col("snapshot_key"), "left")
    by_alias = exact.join(keys.groupBy("alias").agg(F.array_sort(F.collect_list("snapshot_key")).alias("found")), F.col("selector") == F.col("alias"), "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    status = F.when(F.col("snapshot_key").isNotNull() | (n == 1), "found").when(n > 1, "ambiguous").otherwise("not_found")
    return by_alias.select("selector", status.alias("status"), F.coalesce("snapshot_key", F.when(n == 1, F.get("found", F.lit(0)))).alias("snapshot_key"), F.when(status == "ambiguous", F.concat_ws(",", "found")).alias("candidates"))


def graph_stats(g: Graph) -> DataFrame:
    """One row of totals, zeros for an empty store."""
    return counts(g).agg(F.count("*").alias("snapshots"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def stored_capabilities(snapshots: DataFrame, schema: str) -> DataFrame:
    """The capabilities that a snapshot's JSON holds, by a DDL schema."""
    got = F.from_json(F.get_json_object("payload_json", "$.capabilities"), schema)
    return snapshots.select("snapshot_key", got.alias("c")).select("snapshot_key", "c.*")

