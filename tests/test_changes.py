"""Counts of changes, without the walks that other parts of a diff need."""

from pyspark.sql import functions as F

from metaloom.operators import diff as D

from .test_traverse import TYPES, frames


def test_counts_of_changes_walk_nowhere(spark, monkeypatch):
    g, _ = frames(spark, {"p:a": [("e", "n0", "n1", TYPES[0])], "p:b": []})
    payload = F.when((F.col("snapshot_key") == "p:b") & (F.col("node_key") == "n1"), '{"b": 2, "a": 1}').when((F.col("snapshot_key") == "p:b") & (F.col("node_key") == "n2"), '{"a": 2}').otherwise('{"a": 1, "b": 2}')
    g.nodes = g.nodes.withColumn("payload_json", payload).where("not (snapshot_key = 'p:b' and node_key = 'n3')")
    pairs = spark.createDataFrame([("x", "p:a", "p:b")], "pair string, a string, b string")
    monkeypatch.setattr(D, "impact_bounded", None)
    counts = D.change_counts(D.node_changes(g, pairs), D.diff_edges(g, pairs))
    assert {r.what: r.n for r in counts.collect()} == {"nodes_changed": 1, "nodes_removed": 1, "edges_removed": 1}
