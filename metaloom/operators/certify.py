"""Certification (C1 to C8): emitted counts, their reconciliation with independent ones, proofs, capabilities and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import parse_key
from ..functions.redact import redact
from ..plans.model import CONSTRAINTS, OBJECT_CATEGORIES, RELATION_CATEGORIES, Canonical

# Bytes that a proof's texts and a scope's values may have; the version of a stored proof.
MAX_PROOF, MAX_SCOPE, VERSION, MAX_ALIAS, MAX_TIMEOUT_MS = 4096, 1024, 2, 1024, 86_400_000


def _all(counts: DataFrame, snapshots: DataFrame, categories: list[str]) -> DataFrame:
    """Counts with zeros for what a snapshot has none of; the categories are a literal of fixed size."""
    every = snapshots.select("snapshot_key").distinct().select("snapshot_key", F.explode(F.array(*[F.lit(x) for x in categories])).alias("category"))
    return every.join(counts, ["snapshot_key", "category"], "left").select("snapshot_key", "category", F.coalesce("emitted", F.lit(0)).cast("long").alias("emitted"))


def emitted_objects(c: Canonical) -> DataFrame:
    """(snapshot_key, category, emitted) over all 26 categories."""
    fixed = {"databases": "database", "schemas": "schema", "tables": "table", "columns": "column", "indexes": "index", "views": "view", "triggers": "trigger", "routines": "routine"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in CONSTRAINTS.items() for x in kv]), F.col("kind"))
    parts = [c.t[n].select("snapshot_key", F.lit(v).alias("category")) for n, v in fixed.items()]
    parts.append(c.constraints.select("snapshot_key", kind.alias("category")))
    parts.append(c.metadata_objects.select("snapshot_key", parse_key(F.col("key"))["object_kind"].alias("category")))
    counts = reduce(DataFrame.unionByName, parts).groupBy("snapshot_key", "category").agg(F.count("*").alias("emitted"))
    return _all(counts, c.databases, OBJECT_CATEGORIES)


def emitted_relations(c: Canonical) -> DataFrame:
    """(snapshot_key, category, emitted) over all 16 categories."""
    n = lambda c_: F.coalesce(F.size(F.col(c_)), F.lit(0))
    one, fk = F.lit(1), F.col("kind") == "foreign_key"
    terms = [
        (c.schemas, "database_has_schema", one), (c.tables, "schema_has_table", one), (c.columns, "table_has_column", one), (c.constraints, "table_has_constraint", one),
        (c.constraints, "constraint_column", F.when(fk, 0).otherwise(n("columns"))), (c.constraints, "foreign_key_column_pair", F.when(fk, n("columns")).otherwise(0)),
        (c.indexes, "table_has_index", one), (c.indexes, "index_column", n("columns")), (c.views, "schema_has_view", one), (c.views, "view_dependency", n("depends_on")),
        (c.triggers, "trigger_target", one), (c.triggers, "trigger_routine", F.col("executes_routine_key").isNotNull().cast("int")), (c.routines, "schema_has_routine", one), (c.routines, "routine_dependency", n("depends_on")),
        (c.metadata_objects, "metadata_parent", F.col("parent_key").isNotNull().cast("int")), (c.relationships, "metadata_relationship", one),
    ]
    rows = reduce(DataFrame.unionByName, [df.select("snapshot_key", F.lit(name).alias("category"), x.cast("long").alias("n")) for df, name, x in terms])
    return _all(rows.groupBy("snapshot_key", "category").agg(F.sum("n").alias("emitted")), c.databases, RELATION_CATEGORIES)


def _bad_text(c: Column, most: int) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.octet_length(c) > most) | c.rlike(r"\p{Cntrl}")


def _issues(df: DataFrame, code: Column | str, subject: Column, message: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("snapshot_key", lit(code).alias("code"), subject.alias("subject"), lit(message).alias("message"))


def reconcile(discovered: DataFrame, emitted: DataFrame, domain: str = "object") -> DataFrame:
    """discovered(snapshot_key, category, discovered, evidence) against emitted counts: (snapshot_key, code, subject, message)."""
    both = emitted.join(discovered, ["snapshot_key", "category"], "left")
    subject = F.concat(F.lit(f"{domain}_counts."), F.col("category"))
    missing = "discovered_count_missing" if domain == "object" else "discovered_relationship_count_missing"
    known = both.where("discovered is not null")
    return reduce(
        DataFrame.unionByName,
        [
            _issues(known.where("discovered <> emitted"), f"{domain}_count_mismatch", subject, F.format_string("discovered %d, emitted %d", "discovered", "emitted")),
            _issues(both.where("discovered is null"), missing, subject, "no discovered count for this category"),
            _issues(known.where(_bad_text(F.col("evidence"), MAX_PROOF)), "discovery_evidence_missing", subject, "a discovered count needs evidence"),
        ],
    )


def check_proof(proofs: DataFrame, checks: DataFrame) -> DataFrame:
    """C4: proofs(snapshot_key, adapter, adapter_version, server, server_version, catalogs, schemas) and checks(snapshot_key, position, name, evidence)."""
    out = [_issues(proofs.where(_bad_text(F.col(x), MAX_PROOF)), "proof_value_missing", F.lit(x), "a proof value must be short, not empty and without controls") for x in ("adapter", "adapter_version", "server", "server_version")]
    for x in ("catalogs", "schemas"):
        values, subject = F.col(x), F.lit(f"scope.{x}")
        out.append(_issues(proofs.where(values.isNull() | (F.size(values) == 0)), "scope_missing", subject, "the scope names nothing"))
        out.append(_issues(proofs.where(F.exists(values, lambda v: _bad_text(v, MAX_SCOPE))), "scope_value_missing", subject, "scope values must be short, not empty and without controls"))
        out.append(_issues(proofs.where(F.array_sort(F.array_distinct(values)) != values), "scope_not_canonical", subject, "scope values must be sorted and unique"))
    out.append(_issues(proofs.join(checks.select("snapshot_key").distinct(), "snapshot_key", "left_anti"), "capability_proof_missing", F.lit("capability_checks"), "no capability check"))
    for x in ("name", "evidence"):
        out.append(_issues(checks.where(_bad_text(F.col(x), MAX_PROOF)), "proof_value_missing", F.lit(f"capability.{x}"), "a proof value must be short, not empty and without controls"))
    repeated = checks.where(F.trim("name") != "").withColumn("k", F.row_number().over(W.partitionBy("snapshot_key", "name").orderBy("position"))).where("k > 1")
    out.append(_issues(repeated, "duplicate_capability_check", F.concat(F.lit("capability_checks."), F.col("name")), "check names must be unique"))
    unsorted = checks.withColumn("before", F.lag("name").over(W.partitionBy("snapshot_key").orderBy("position"))).where("before > name").select("snapshot_key").distinct()
    out.append(_issues(unsorted, "capability_checks_not_canonical", F.lit("capability_checks"), "checks must be sorted by name"))
    return reduce(DataFrame.unionByName, out)


def check_capabilities(caps: DataFrame, databases: DataFrame) -> DataFrame:
    """C5."""
    caps = caps.join(databases.select("snapshot_key", F.col("source_kind").alias("own_source")), "snapshot_key")
    subject = lambda x: F.lit(f"capabilities.{x}")
    out = [_issues(caps.where("source_kind is distinct from own_source"), "capability_source_mismatch", subject("source_kind"), "capabilities are of another source"), _issues(caps.where("not coalesce(metadata_only, false)"), "metadata_only_required", subject("metadata_only"), "only metadata may be read")]
    out += [_issues(caps.where(f"not coalesce({x}, false)"), "required_capability_missing", subject(x), "this category must be covered") for x in ("schemas", "tables", "columns", "constraints", "indexes")]
    out += [_issues(caps.where(f"{x} is distinct from 'supported'"), "required_capability_incomplete", subject(x), "this category must be fully supported") for x in ("views", "triggers", "routines", "dependencies")]
    out.append(_issues(caps.where("size(limitations) > 0"), "adapter_limitations_present", subject("limitations"), "a complete snapshot has no limitations"))
    return reduce(DataFrame.unionByName, out)


def verify_stored(proof: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """A stored proof(snapshot_key, contract_version, domain, position, category, discovered, emitted) against the counts now."""
    versions = proof.where(F.col("contract_version") != VERSION).select("snapshot_key").distinct()
    out = [_issues(versions, "unsupported_contract_version", F.lit("contract_version"), f"the version must be {VERSION}")]
    for domain, counts, order in (("object", objects, OBJECT_CATEGORIES), ("relationship", relations, RELATION_CATEGORIES)):
        own = proof.where(F.col("domain") == domain)
        subject = F.concat(F.lit(f"{domain}_counts."), F.col("category"))
        times = own.groupBy("snapshot_key", "category").agg(F.count("*").alias("n"), F.min("discovered").alias("lo"), F.max("discovered").alias("hi"), F.min("emitted").alias("elo"), F.max("emitted").alias("ehi"))
        known = proof.select("snapshot_key").distinct()
        both = counts.withColumnRenamed("emitted", "now").join(known, "snapshot_key", "left_semi").join(times, ["snapshot_key", "category"], "left")
        out.append(_issues(both.where("n is null"), f"{domain}_count_missing", subject, "the proof lacks this category"))
        out.append(_issues(both.where("n > 1"), f"duplicate_{domain}_count", subject, "the proof has this category more than once"))
        out.append(_issues(both.where("lo <> now or hi <> now or elo <> now or ehi <> now"), f"{domain}_count_mismatch", subject, "declared and actual counts differ"))
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("category"))
        jumps = own.withColumn("place", place).withColumn("before", F.lag(place).over(W.partitionBy("snapshot_key").orderBy("position"))).where("before > place").select("snapshot_key").distinct()
        out.append(_issues(jumps, "snapshot_not_canonical", F.lit(f"{domain}_counts"), "categories aren't in canonical order"))
    return reduce(DataFrame.unionByName, out)


# Codes that make a failure one of completeness.
COUNT_CODES = ["object_count_mismatch", "relationship_count_mismatch", "discovered_count_missing", "discovered_relationship_count_missing"]


def verdict(snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_key, status, code, issues): complete without issues, else failed with completeness_mismatch if any is of counts, or validation_failed."""
    found = issues.groupBy("snapshot_key").agg(F.count("*").alias("n"), F.max(F.col("code").isin(*COUNT_CODES)).alias("of_counts"))
    got = snapshots.select("snapshot_key").distinct().join(found, "snapshot_key", "left")
    code = F.when(F.col("of_counts"), "completeness_mismatch").when(F.col("n") > 0, "validation_failed")
    return got.select("snapshot_key", F.when(F.col("n") > 0, "failed").otherwise("complete").alias("status"), code.alias("code"), F.coalesce("n", F.lit(0)).cast("long").alias("issues"))


def check_requests(requests: DataFrame) -> DataFrame:
    """requests(request_id, alias, scopes, timeout_ms, requested, product) with reason: the first thing wrong with each, or null."""
    alias, scopes = F.col("alias"), F.col("scopes")
    reason = (
        F.when(alias.isNull() | (F.trim(alias) == ""), "alias_missing")
        .when(F.octet_length(alias) > MAX_ALIAS, "alias_too_long")
        .when(alias.rlike(r"\p{Cntrl}"), "alias_has_controls")
        .when(redact(alias) != alias, "alias_has_secret")
        .when(F.exists(scopes, lambda s: s.isNull() | (F.trim(s) == "")), "scope_empty")
        .when(F.size(F.array_distinct(scopes)) < F.size(scopes), "scope_repeated")
        .when(~F.col("timeout_ms").between(1, MAX_TIMEOUT_MS), "timeout_out_of_range")
        .when(F.col("requested").isin("mysql", "mariadb") & (F.col("requested") != F.col("product")), "product_mismatch")
    )
    return requests.withColumn("reason", reason)
