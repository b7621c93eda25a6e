"""The retail catalog fleet and its graph as written tables, made once for each session and state of the input files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.project import project
from ..sources.retail import retail_catalog
from .model import Canonical, Graph
from .shared import written_all

_made: dict[tuple, object] = {}


def _once(key: tuple, make):
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files, as Spark's own file system layer tells them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def catalog(spark: SparkSession, sf_dir: str, generation: int = 1) -> Canonical:
    def make() -> Canonical:
        c = retail_catalog(spark, sf_dir, generation)
        of_size = ("tables", "columns", "constraints", "indexes", "views", "triggers", "routines")
        return Canonical(c.t | written_all({n: c.t[n] for n in of_size}))

    return _once((spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), generation, "catalog"), make)


def graph(spark: SparkSession, sf_dir: str, generation: int = 1) -> Graph:
    def make() -> Graph:
        g = project(catalog(spark, sf_dir, generation))
        return Graph(g.snapshots, **written_all({"nodes": g.nodes, "edges": g.edges}))

    return _once((spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), generation, "graph"), make)
