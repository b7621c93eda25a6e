"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["g3_impact_many", "g1_grouped", "d7_diff_envelope", "t1_describe_tables", "t3_inventory", "l8_find_objects", "l7_list_objects", "c2_emitted_relations", "b4_map_constraints", "p6_check_projection"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from metaloom.operators.certify import emitted_objects, emitted_relations
    from metaloom.operators.project import check_projection, project
    from metaloom.operators.validate import validate
    from metaloom.plans import fleet, queries_graph, queries_store
    from metaloom.plans.model import Canonical, Graph
    from metaloom.plans.shared import written_all
    from metaloom.sources.synth import synth_catalog

    took: dict[str, float] = {}

    def timed(name: str, f) -> None:
        began = time.time()
        f()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    # The retail fleet is made first and timed on its own; the queries then read its written tables.
    timed("catalog", lambda: fleet.catalog(spark, sf_dir))
    timed("graph", lambda: fleet.graph(spark, sf_dir))
    timed("second_generation", lambda: fleet.graph(spark, sf_dir, 2))
    every = queries_graph.Q | queries_store.Q
    for name in HEADLINE:
        timed(name, lambda name=name: every[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    # As the published scale audit: a chain of 8 334 tables of 8 columns, 100 009 objects (83 334 for a million): validated, projected, counted and stored.
    tables = int(os.environ.get("BENCH_SYNTH_TABLES", "8334"))
    def index() -> Graph:
        c = synth_catalog(spark, tables, 8, partitions=int(cpus) * 2)
        c = Canonical(c.t | written_all({n: c.t[n] for n in ("tables", "columns", "constraints", "indexes")}))
        g = project(c)
        stored = Graph(g.snapshots, **written_all({"nodes": g.nodes, "edges": g.edges}))
        assert validate(c).isEmpty()
        assert check_projection(stored, emitted_objects(c), emitted_relations(c)).first()["accepted"]
        return stored

    held: list[Graph] = []
    timed("synth_index", lambda: held.append(index()))
    from metaloom.operators import store, traverse

    g, key = held[0], "synthetic:bench"
    timed("synth_page", lambda: store.list_objects(g, key, "table", limit=100)[0].collect())
    timed("synth_search", lambda: store.find_objects(g, "table_4242").limit(100).collect())
    seed = spark.createDataFrame([(key, "synthetic:bench:main:main:table:table_0042")], "snapshot_key string, seed string")
    timed("synth_impact", lambda: traverse.impact_bounded(g, seed, "both", 3, 200).hits.collect())
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
