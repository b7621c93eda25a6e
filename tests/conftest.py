import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    # A session of hundreds of queries would keep every plan's text and every job's figures for a web page that nobody looks at.
    conf |= {"spark.sql.ui.retainedExecutions": "5", "spark.ui.retainedJobs": "20", "spark.ui.retainedStages": "20", "spark.ui.retainedTasks": "200", "spark.sql.maxPlanStringLength": "20000"}
    # Every table that is broadcast takes a page of its own on the heap; by default that is some 32 MB, however few its rows, and a query of a hundred small joins fills the heap.
    conf["spark.buffer.pageSize"] = "1m"
    conf["spark.checkpoint.dir"] = str(tmp_path_factory.mktemp("shared"))
    conf["spark.sql.warehouse.dir"] = str(tmp_path_factory.mktemp("warehouse"))
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
