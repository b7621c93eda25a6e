"""Stores with several writers, stored proofs, envelopes, hubs and sources, on a few rows."""

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from metaloom.operators import certify as C
from metaloom.operators import discover as B
from metaloom.operators import envelopes as E
from metaloom.operators import inventory as INV
from metaloom.operators import mapping as M
from metaloom.operators import proof as P
from metaloom.operators import sqlserver as MS
from metaloom.operators import store as S
from metaloom.operators import traverse as G
from metaloom.plans.model import Graph
from metaloom.sources import catalog_source as CS

KEY = "s:{a}:d:d:database:d"


def graph_of(spark, *snapshots, label="Database"):
    rows = [(s, KEY.format(a=s.split(":")[1]), label, "d", "{}") for s in snapshots]
    nodes = spark.createDataFrame(rows, "snapshot_key string, node_key string, label string, display_name string, payload_json string")
    edges = spark.createDataFrame([], "snapshot_key string, edge_key string, edge_from string, edge_to string, edge_type string, payload_json string")
    return Graph(spark.createDataFrame([(s, "s", 0, "{}") for s in snapshots], "snapshot_key string, source string, captured_at_unix_ms long, payload_json string"), nodes, edges)


def proven(spark, *snapshots):
    g = graph_of(spark, *snapshots)
    heads = spark.createDataFrame([(s, "a", "1", "srv", "2", ["d"], ["d"]) for s in snapshots], "snapshot_key string, adapter string, adapter_version string, server string, server_version string, catalogs array<string>, schemas array<string>")
    checks = spark.createDataFrame([(s, 0, "tables", "read") for s in snapshots], "snapshot_key string, position int, name string, evidence string")
    emitted = P.stored_counts(g)
    seen = [e.select("snapshot_key", "category", F.col("emitted").alias("discovered"), F.lit("counted").alias("evidence")) for e in emitted]
    return Graph(g.snapshots, g.nodes, g.edges, P.make_proof(heads, checks, seen, emitted))


def states(g):
    return {r.snapshot_key: (r.authority, r.issues) for r in P.authority(g).collect()}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Writers that start together, and one that uses a generation's name again."""
    path = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: S.write_snapshot(graph_of(spark, f"s:{k}", "s:all", label="Database"), path, "same"), range(4)))
    got = S.read_graph(spark, path)
    assert sorted(r.snapshot_key for r in got.nodes.collect()) == ["s:0", "s:1", "s:2", "s:3", "s:all"]
    assert got.proof is None and [*states(got).values()] == [("legacy_non_authoritative", [])] * 5
    S.write_snapshot(graph_of(spark, "s:all", label="Other"), path, "same")
    assert {r.label for r in S.read_graph(spark, path).nodes.where("snapshot_key = 's:all'").collect()} == {"Other"}
    S.compact(spark, path, f"{path}/small")
    assert S.read_graph(spark, f"{path}/small").nodes.count() == 5 and S.in_force(spark, f"{path}/small").select("generation").distinct().count() == 1


def test_authority_follows_the_stored_proof(spark, tmp_path):
    path = str(tmp_path)
    S.write_snapshot(proven(spark, "s:a", "s:b"), path, "g")
    assert [*states(S.read_graph(spark, path)).values()] == [("complete", [])] * 2
    # without a proof the same snapshot is a legacy one again, and what is deleted from the store breaks the proof
    S.write_snapshot(graph_of(spark, "s:b"), path, "h")
    got = S.read_graph(spark, path)
    assert states(got) == {"s:a": ("complete", []), "s:b": ("legacy_non_authoritative", [])}
    less = S.delete_nodes(got, spark.createDataFrame([("s:a", KEY.format(a="a"))], "snapshot_key string, node_key string"))
    assert states(less)["s:a"] == ("unverifiable", ["object_count_mismatch:object_counts.database"])
    assert states(S.delete_snapshot(got, spark.createDataFrame([("s:a",)], "snapshot_key string"))) == {"s:b": ("legacy_non_authoritative", [])}
    asked = spark.createDataFrame([("a",), ("s:b",), ("none",)], "selector string")
    told = {r.selector: r for r in S.describe_snapshots(got, asked).collect()}
    proof = json.loads(told["a"].completeness)
    assert proof["adapter"] == {"name": "a", "version": "1"} and [x["category"] for x in proof["object_counts"]][:2] == ["database", "schema"] and len(proof["relationship_counts"]) == 16
    assert told["s:b"].completeness is None and told["none"].status == "not_found"


def test_proofs_need_all_of_their_parts(spark):
    g = proven(spark, "s:a", "s:b", "s:c")
    p = g.proof
    not_a = p.counts.where("snapshot_key <> 's:a'")
    broken = P.Proof(p.heads.where("snapshot_key <> 's:b'"), not_a, p.checks.where("snapshot_key <> 's:c'"))
    got = states(Graph(g.snapshots, g.nodes, g.edges, broken))
    assert "object_count_missing:object_counts" in got["s:a"][1] and got["s:b"] == ("unverifiable", ["proof_missing:completeness"])
    assert got["s:c"] == ("unverifiable", ["capability_proof_missing:capability_checks"])


def test_discovered_counts_of_an_empty_extract(spark, sf):
    x = {n: df.where("false") if n != "databases" else df for n, df in M.as_information_schema(_catalog(spark, sf)).items()}
    objects, relations = B.discovered(x)
    assert {r.category: r.discovered for r in objects.where("snapshot_key = 'tpch:ASIA'").collect() if r.discovered} == {"database": 1}
    assert relations.where("discovered > 0").isEmpty() and relations.count() == 16 * 5
    with pytest.raises(ValueError, match="oracle"):
        B.discovered(x, "oracle")


def _catalog(spark, sf):
    from metaloom.plans import fleet

    return fleet.catalog(spark, sf)


def test_name_parts(spark):
    names = {"t": (None, None, None, "t"), "s.t": (None, None, "s", "t"), "d..t": (None, "d", None, "t"), "[a.b].[c]]d].[e].f": ("a.b", "c]d", "e", "f"), "a.b.c.d.e": (None, None, None, None), "[]": (None, None, None, None), "": (None, None, None, None)}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", MS.name_parts(F.col("n")).alias("p")).collect()
    assert {r.n: tuple(r.p) for r in rows} == names


def test_sqlserver_catalog_as_a_whole(spark, sf):
    """The typed tables come back as they were, but for what triggers execute."""
    c = _catalog(spark, sf)
    got, issues = MS.map_catalog(MS.as_sys(c))
    assert issues.isEmpty()
    for name in ("schemas", "tables", "constraints", "indexes", "views", "routines"):
        assert c.t[name].exceptAll(got.t[name]).isEmpty() and got.t[name].exceptAll(c.t[name]).isEmpty(), name
    assert INV.inventory({n: df for n, df in MS.as_sys(c).items() if n != "schemas"}, "sqlserver").where("code = 'duplicate_id'").isEmpty()
    assert C.emitted_objects(got).where("category = 'trigger'").agg(F.sum("emitted")).first()[0] == c.triggers.count()


def test_hub_takes_seconds(spark):
    """20 000 seeds at a hub of 20 000 edges: each walk takes the hub's first limit + 1 edges, not all."""
    n = 20_000
    rows = spark.range(n).select(F.lit("s").alias("snapshot_key"), F.format_string("e%05d", "id").alias("edge_key"), F.lit("hub").alias("edge_from"), F.format_string("n%05d", "id").alias("edge_to"), F.lit("DEPENDS_ON").alias("edge_type"), F.lit("{}").alias("payload_json"))
    nodes = rows.select("snapshot_key", F.col("edge_to").alias("node_key"), F.lit("Table").alias("label"), F.col("edge_to").alias("display_name"), F.lit("{}").alias("payload_json"))
    hub = spark.createDataFrame([("s", "hub", "Table", "hub", "{}")], nodes.schema)
    g = Graph(None, nodes.unionByName(hub), rows)
    seeds = nodes.select("snapshot_key", F.col("node_key").alias("seed"))
    began = time.time()
    for walk, n_hits in ((G.impact_bounded(g, seeds, "both", 2, 3), 3), (G.filtered_traversal(g, seeds, "both", 2, 3), 3), (G.trace_bounded(g, seeds, "both", 2, 3), 3)):
        counts = walk.hits.groupBy("seed").count().groupBy("count").agg(F.count("*").alias("seeds")).collect()
        assert sum(r.seeds for r in counts) == n and max(r["count"] for r in counts) <= n_hits
        assert walk.ends.where("truncated").count() == n
    assert time.time() - began < 240


def test_clamps():
    assert E.clamped(None, None)[2] == {"depth_requested": 3, "depth_applied": 3, "depth_clamped": False, "result_limit_requested": 100, "result_limit_applied": 100, "result_limit_clamped": False}
    assert E.clamped(99, 9999)[:2] == (8, 200) and E.clamped(99, 9999)[2]["result_limit_clamped"] and E.clamped(0, 1)[:2] == (0, 1)
    for bad in ((-1, 5), (3, 0)):
        with pytest.raises(ValueError, match="at least"):
            E.clamped(*bad)


def test_catalog_source_prunes_and_gives_back(spark, tmp_path):
    df = spark.createDataFrame([(f"s:{k}", f"t{i}", i, None if i == 2 else f"x{i}") for k in "ab" for i in range(4)], "snapshot_key string, TABLE_NAME string, n long, note string")
    CS.write_extract({"TABLES": df}, str(tmp_path))
    source = CS.CatalogExtract({"path": str(tmp_path), "table": "TABLES", "vendor": "mysql"})
    assert {f.snapshot_key for f in source._files()} == {"s:a", "s:b"}
    read = CS.read_catalog(spark, str(tmp_path), "TABLES", "mysql")
    assert sorted(map(tuple, read.select(*df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [tuple(r) for r in read.where("snapshot_key = 's:b' and n in (1, 2) and note is null").select("snapshot_key", "n").collect()] == [("s:b", 2)]
    assert read.where("snapshot_key = 's:none'").count() == 0
    with pytest.raises(ValueError, match="no catalog table"):
        CS.CatalogExtract({"path": str(tmp_path), "table": "NOTHING", "vendor": "mysql"})._folder()
