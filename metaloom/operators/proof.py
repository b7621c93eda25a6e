"""Stored proofs (C6, L12, L14): what certified a snapshot is kept beside it and verified anew against the stored graph whenever its authority is asked for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parse_key
from ..plans.model import OBJECT_CATEGORIES, RELATION_CATEGORIES, Graph
from .certify import VERSION, check_proof, verify_stored

# The relation category that each edge type of the typed tables counts for; all types not named are relationships, and those with none are the second edge of a relation.
EDGE_CATEGORIES = {
    "DATABASE_HAS_SCHEMA": "database_has_schema",
    "SCHEMA_HAS_TABLE": "schema_has_table",
    "TABLE_HAS_COLUMN": "table_has_column",
    "TABLE_HAS_CONSTRAINT": "table_has_constraint",
    "COLUMN_IN_PRIMARY_KEY": "constraint_column",
    "COLUMN_IN_UNIQUE": "constraint_column",
    "COLUMN_IN_CHECK": "constraint_column",
    "FK_FROM_COLUMN": "foreign_key_column_pair",
    "FK_TO_COLUMN": None,
    "TABLE_HAS_INDEX": "table_has_index",
    "COLUMN_IN_INDEX": "index_column",
    "SCHEMA_HAS_VIEW": "schema_has_view",
    "VIEW_DEPENDS_ON_TABLE": "view_dependency",
    "VIEW_DEPENDS_ON_COLUMN": "view_dependency",
    "VIEW_DEPENDS_ON_VIEW": "view_dependency",
    "TRIGGER_ON_TABLE": "trigger_target",
    "TRIGGER_ON_VIEW": "trigger_target",
    "TABLE_HAS_TRIGGER": None,
    "VIEW_HAS_TRIGGER": None,
    "TRIGGER_EXECUTES_ROUTINE": "trigger_routine",
    "SCHEMA_HAS_ROUTINE": "schema_has_routine",
    "ROUTINE_DEPENDS_ON_TABLE": "routine_dependency",
    "ROUTINE_DEPENDS_ON_COLUMN": "routine_dependency",
    "METADATA_PARENT": "metadata_parent",
}
HEAD = ["contract_version", "adapter", "adapter_version", "server", "server_version", "catalogs", "schemas"]


@dataclass
class Proof:
    """heads(snapshot_key, contract_version, adapter, adapter_version, server, server_version, catalogs, schemas), counts(snapshot_key, domain, position, category, discovered, emitted, evidence), checks(snapshot_key, position, name, evidence)."""

    heads: DataFrame
    counts: DataFrame
    checks: DataFrame


def _placed(counts: DataFrame, domain: str, categories: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(x) for x in categories]), F.col("category"))
    return counts.select("snapshot_key", F.lit(domain).alias("domain"), place.cast("long").alias("position"), "category", "discovered", "emitted", "evidence")


def make_proof(heads: DataFrame, checks: DataFrame, discovered: tuple[DataFrame, DataFrame], emitted: tuple[DataFrame, DataFrame]) -> Proof:
    """The proof of snapshots from heads (without contract_version), capability checks, and the discovered (B30) and emitted (C1, C2) counts of objects and of relations; a category without a discovered count stands with null, so that it doesn't verify."""
    parts = [_placed(e.join(d, ["snapshot_key", "category"], "left"), domain, names) for d, e, domain, names in zip(discovered, emitted, ("object", "relationship"), (OBJECT_CATEGORIES, RELATION_CATEGORIES), strict=True)]
    return Proof(heads.select("snapshot_key", F.lit(VERSION).alias("contract_version"), *HEAD[1:]), parts[0].unionByName(parts[1]), checks.select("snapshot_key", "position", "name", "evidence"))


def stored_counts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The emitted counts of objects and relations as the stored nodes and edges have them: one aggregation of each, nodes by the kind in their key, edges by type."""
    every = lambda names: g.snapshots.select("snapshot_key").distinct().select("snapshot_key", F.explode(F.array(*[F.lit(x) for x in names])).alias("category"))
    kinds = g.nodes.groupBy("snapshot_key", parse_key(F.col("node_key"))["object_kind"].alias("category")).agg(F.count("*").alias("n"))
    named = F.create_map(*[F.lit(x) for t, c in EDGE_CATEGORIES.items() for x in (t, c or "")])
    category = F.coalesce(F.try_element_at(named, F.col("edge_type")), F.lit("metadata_relationship"))
    types = g.edges.groupBy("snapshot_key", category.alias("category")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long").alias("emitted")
    return tuple(every(names).join(got, ["snapshot_key", "category"], "left").select("snapshot_key", "category", n) for got, names in ((kinds, OBJECT_CATEGORIES), (types, RELATION_CATEGORIES)))


def proof_issues(g: Graph) -> DataFrame:
    """C6 over a stored graph: (snapshot_key, code, subject, message) of each proof that the stored nodes and edges, its own order or its texts don't bear out; and of snapshots whose payload claims a contract without a proof."""
    p = g.proof
    flat = p.counts.join(p.heads.select("snapshot_key", "contract_version"), "snapshot_key", "left")
    claimed = g.snapshots.where(F.get_json_object("payload_json", "$.contract_version").isNotNull()).join(p.heads, "snapshot_key", "left_anti")
    lost = claimed.select("snapshot_key", F.lit("proof_missing").alias("code"), F.lit("completeness").alias("subject"), F.lit("a contract is claimed without a proof").alias("message"))
    headless = p.counts.select("snapshot_key").distinct().join(p.heads, "snapshot_key", "left_anti").select("snapshot_key", F.lit("proof_missing").alias("code"), F.lit("completeness").alias("subject"), F.lit("counts without a proof's head").alias("message"))
    bare = p.heads.join(p.counts.select("snapshot_key").distinct(), "snapshot_key", "left_anti").select("snapshot_key", F.lit("object_count_missing").alias("code"), F.lit("object_counts").alias("subject"), F.lit("the proof has no counts").alias("message"))
    return reduce(DataFrame.unionByName, [verify_stored(flat, *stored_counts(g)), check_proof(p.heads, p.checks), lost, headless, bare])


def authority(g: Graph) -> DataFrame:
    """(snapshot_key, contract_version, authority, issues): complete where a proof is stored and verifies, legacy_non_authoritative where neither a proof nor a claim to one is, else unverifiable, with the sorted codes and subjects of what doesn't hold."""
    if g.proof is None:
        version = F.get_json_object("payload_json", "$.contract_version")
        return g.snapshots.select("snapshot_key", version.cast("int").alias("contract_version"), F.when(version.isNull(), "legacy_non_authoritative").otherwise("unverifiable").alias("authority"), F.when(version.isNull(), F.array()).otherwise(F.array(F.lit("proof_missing:completeness"))).cast("array<string>").alias("issues"))
    found = proof_issues(g).groupBy("snapshot_key").agg(F.array_sort(F.collect_set(F.concat_ws(":", "code", "subject"))).alias("issues"))
    got = g.snapshots.select("snapshot_key").join(g.proof.heads.select("snapshot_key", "contract_version"), "snapshot_key", "left").join(found, "snapshot_key", "left")
    state = F.when(F.col("issues").isNotNull(), "unverifiable").when(F.col("contract_version").isNull(), "legacy_non_authoritative").otherwise("complete")
    return got.select("snapshot_key", "contract_version", state.alias("authority"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def completeness(g: Graph) -> DataFrame:
    """(snapshot_key, completeness): each proof as one JSON text, its counts and checks in their order. What is gathered is bounded by the numbers of categories and checks."""
    p = g.proof
    listed = lambda df, *fields: F.transform(F.array_sort(F.collect_list(F.struct("position", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    of = lambda domain: p.counts.where(F.col("domain") == domain).groupBy("snapshot_key").agg(listed(p.counts, "category", "discovered", "emitted", "evidence").alias(f"{domain}_counts"))
    checks = p.checks.groupBy("snapshot_key").agg(listed(p.checks, "name", "evidence").alias("capability_checks"))
    rows = p.heads.join(of("object"), "snapshot_key", "left").join(of("relationship"), "snapshot_key", "left").join(checks, "snapshot_key", "left")
    named = lambda a, b: F.struct(F.col(a).alias("name"), F.col(b).alias("version"))
    text: Column = F.to_json(F.struct("contract_version", named("adapter", "adapter_version").alias("adapter"), named("server", "server_version").alias("server"), F.struct("catalogs", "schemas").alias("scope"), "object_counts", "relationship_counts", "capability_checks"))
    return rows.select("snapshot_key", text.alias("completeness"))
