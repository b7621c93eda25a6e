"""Graph projection (P1 to P7): canonical tables to nodes and edges, of all snapshots at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import kind_label, metadata_label, parse_key, rel_edge_type
from ..plans.model import CONSTRAINTS, Canonical, Graph

NODE, EDGE = ["snapshot_key", "node_key", "label", "display_name", "payload_json"], ["snapshot_key", "edge_key", "edge_from", "edge_to", "edge_type", "payload_json"]
# Fields that payloads leave out when empty.
SPARSE = {"extension_kind", "definition", "properties"}


def _constraint_kind(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONSTRAINTS.items() for x in kv]), kind)


def _payload(df: DataFrame, sparse: bool = False) -> Column:
    """The row as JSON in the order of its columns; keys become objects of their parts, nulls are kept but for the sparse fields of metadata objects."""
    fields = []
    for name, kind in df.dtypes:
        if name in ("snapshot_key", "annotation") or (name == "source_kind" or name == "connection_alias"):
            continue
        c = F.col(name)
        if name == "key" or name.endswith("_key"):
            c = parse_key(c)
        elif kind == "array<string>" and name in ("columns", "referenced_columns", "depends_on"):
            c = F.transform(c, parse_key)
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true" if sparse else "false"})


def project_nodes(c: Canonical) -> DataFrame:
    """A node for each object of the typed tables and of metadata_objects; an annotation joins its object's payload as canonical_annotation."""
    labels = {"databases": "Database", "schemas": "Schema", "tables": "Table", "columns": "Column", "indexes": "Index", "views": "View", "triggers": "Trigger", "routines": "Routine"}
    parts = []
    for name, df in c.t.items():
        if name == "constraints":
            label = kind_label(_constraint_kind(F.col("kind")))
        elif name == "metadata_objects":
            label = metadata_label(parse_key(F.col("key"))["object_kind"])
        elif name in labels:
            label = F.lit(labels[name])
        else:
            continue
        parts.append(df.select("snapshot_key", F.col("key").alias("node_key"), label.alias("label"), F.col("name").alias("display_name"), _payload(df, name == "metadata_objects").alias("payload_json")))
    nodes = reduce(DataFrame.unionByName, parts)
    if c.annotations.isEmpty():
        return nodes
    notes = c.annotations.select("snapshot_key", F.col("object_key").alias("node_key"), F.to_json(F.struct(parse_key(F.col("object_key")).alias("object_key"), "definition", "properties")).alias("note"))
    # The note goes in before the payload's closing brace.
    with_note = F.when(F.col("note").isNull(), F.col("payload_json")).otherwise(F.concat(F.expr("left(payload_json, length(payload_json) - 1)"), F.lit(',"canonical_annotation":'), F.col("note"), F.lit("}")))
    return nodes.join(notes, ["snapshot_key", "node_key"], "left").select("snapshot_key", "node_key", "label", "display_name", with_note.alias("payload_json"))


def _edges(df: DataFrame, edge_type: Column | str, from_: str, to: str) -> DataFrame:
    t = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    rows = df.select("snapshot_key", F.col(from_).alias("edge_from"), F.col(to).alias("edge_to"), t.alias("edge_type")).where("edge_type is not null and edge_from is not null and edge_to is not null")
    return rows.select("snapshot_key", F.concat_ws("", "edge_type", F.lit(":"), "edge_from", F.lit("->"), "edge_to").alias("edge_key"), "edge_from", "edge_to", "edge_type", F.to_json(F.struct("edge_type")).alias("payload_json"))


def _kind(c: str) -> Column:
    return parse_key(F.col(c))["object_kind"]


def _by_kind(c: str, **types: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), _kind(c))


def ownership_edges(c: Canonical) -> DataFrame:
    """P2."""
    return reduce(
        DataFrame.unionByName,
        [
            _edges(c.schemas, "DATABASE_HAS_SCHEMA", "database_key", "key"),
            _edges(c.tables, "SCHEMA_HAS_TABLE", "schema_key", "key"),
            _edges(c.columns, "TABLE_HAS_COLUMN", "table_key", "key"),
            _edges(c.constraints, "TABLE_HAS_CONSTRAINT", "table_key", "key"),
            _edges(c.indexes, "TABLE_HAS_INDEX", "table_key", "key"),
            _edges(c.views, "SCHEMA_HAS_VIEW", "schema_key", "key"),
            _edges(c.routines, "SCHEMA_HAS_ROUTINE", "schema_key", "key"),
            _edges(c.triggers, _by_kind("table_key", table="TABLE_HAS_TRIGGER", view="VIEW_HAS_TRIGGER"), "table_key", "key"),
            _edges(c.metadata_objects, "METADATA_PARENT", "parent_key", "key"),
        ],
    )


def membership_edges(c: Canonical) -> DataFrame:
    """Columns in keys, checks and indexes, and the pairs of foreign keys by their place in both lists."""
    # Edge types by constraint kind.
    types = {"primary_key": "COLUMN_IN_PRIMARY_KEY", "unique": "COLUMN_IN_UNIQUE", "check": "COLUMN_IN_CHECK", "foreign_key": "FK_FROM_COLUMN"}
    member = c.constraints.select("snapshot_key", "key", "kind", F.explode("columns").alias("column"))
    target = c.constraints.where("kind = 'foreign_key'").select("snapshot_key", "key", F.explode("referenced_columns").alias("column"))
    in_index = c.indexes.select("snapshot_key", "key", F.explode("columns").alias("column"))
    edge_type = F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.col("kind"))
    return _edges(member, edge_type, "column", "key").unionByName(_edges(target, "FK_TO_COLUMN", "key", "column")).unionByName(_edges(in_index, "COLUMN_IN_INDEX", "column", "key"))


def dependency_edges(c: Canonical) -> DataFrame:
    """Dependencies of views, routines and triggers; other kinds of targets give no edge."""
    views = c.views.select("snapshot_key", "key", F.explode("depends_on").alias("dep"))
    routines = c.routines.select("snapshot_key", "key", F.explode("depends_on").alias("dep"))
    return reduce(
        DataFrame.unionByName,
        [
            _edges(views, _by_kind("dep", table="VIEW_DEPENDS_ON_TABLE", column="VIEW_DEPENDS_ON_COLUMN", view="VIEW_DEPENDS_ON_VIEW"), "key", "dep"),
            _edges(routines, _by_kind("dep", table="ROUTINE_DEPENDS_ON_TABLE", column="ROUTINE_DEPENDS_ON_COLUMN"), "key", "dep"),
            _edges(c.triggers, _by_kind("table_key", table="TRIGGER_ON_TABLE", view="TRIGGER_ON_VIEW"), "key", "table_key"),
            _edges(c.triggers, "TRIGGER_EXECUTES_ROUTINE", "key", "executes_routine_key"),
        ],
    )


def relationship_edges(c: Canonical) -> DataFrame:
    """P5: the edge key ends in the ordinal, or in nothing."""
    r = c.relationships.withColumn("edge_type", rel_edge_type(F.col("kind"), F.col("extension_name")))
    key = F.concat(F.col("edge_type"), F.lit(":"), F.col("from_key"), F.lit("->"), F.col("to_key"), F.lit(":"), F.coalesce(F.col("ordinal").cast("string"), F.lit("")))
    payload = F.to_json(F.struct("kind", "extension_name", parse_key(F.col("from_key")).alias("from_key"), parse_key(F.col("to_key")).alias("to_key"), "ordinal", "properties"))
    return r.select("snapshot_key", key.alias("edge_key"), F.col("from_key").alias("edge_from"), F.col("to_key").alias("edge_to"), "edge_type", payload.alias("payload_json"))


def dedupe_edges(e: DataFrame) -> DataFrame:
    """One row for each (snapshot_key, edge_key): of several the last, in order of payloads, as an upsert of sorted edges leaves it."""
    return e.groupBy("snapshot_key", "edge_key").agg(F.max(F.struct("payload_json", "edge_from", "edge_to", "edge_type")).alias("e")).select(*[F.col(f"e.{x}").alias(x) if x not in ("snapshot_key", "edge_key") else F.col(x) for x in EDGE])


def project(c: Canonical, captured_at_unix_ms: int = 0) -> Graph:
    """The whole graph. The payloads of edges of the typed tables follow from their keys, so that those are made single without them; P7 is applied to the others, whose keys are of another form."""
    typed = reduce(DataFrame.unionByName, [ownership_edges(c), membership_edges(c), dependency_edges(c)]).drop("payload_json").distinct()
    edges = typed.withColumn("payload_json", F.to_json(F.struct("edge_type"))).select(*EDGE).unionByName(dedupe_edges(relationship_edges(c)).select(*EDGE))
    snapshots = c.databases.select("snapshot_key", F.col("source_kind").alias("source"), F.lit(captured_at_unix_ms).cast("long").alias("captured_at_unix_ms")).join(c.capabilities.select("snapshot_key", F.to_json(F.struct(F.struct(*[x for x in c.capabilities.columns if x != "snapshot_key"]).alias("capabilities"))).alias("payload_json")), "snapshot_key", "left")
    return Graph(snapshots, project_nodes(c), edges)


def check_projection(g: Graph, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Per snapshot the nodes and edges that the counts of C1 and C2 ask for, those that there are, and whether both agree. A foreign-key pair and a trigger make two edges each. Dependencies of kinds that P4 drops are counted, so that such a snapshot fails."""
    want_nodes = objects.groupBy("snapshot_key").agg(F.sum("emitted").alias("want_nodes"))
    twice = F.when(F.col("category").isin("foreign_key_column_pair", "trigger_target"), 2).otherwise(1)
    want_edges = relations.groupBy("snapshot_key").agg(F.sum(F.col("emitted") * twice).alias("want_edges"))
    nodes = g.nodes.groupBy("snapshot_key").agg(F.count("*").alias("nodes"))
    edges = g.edges.groupBy("snapshot_key").agg(F.count("*").alias("edges"))
    got = want_nodes.join(want_edges, "snapshot_key", "full").join(nodes, "snapshot_key", "full").join(edges, "snapshot_key", "full")
    return got.na.fill(0).withColumn("accepted", (F.col("want_nodes") == F.col("nodes")) & (F.col("want_edges") == F.col("edges")))
