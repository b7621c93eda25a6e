"""How often an error text is redacted, and in how many tasks."""

from pyspark.sql import functions as F

from metaloom.functions import redact as R
from metaloom.plans import queries_keys

from .conftest import SF


def test_errors_are_redacted_once(spark):
    df = spark.createDataFrame([("no x://u:p@h; " + "é" * 5000, "x://u:p@h")], "m string, c string")
    out = df.select(R.redact_error(F.col("m"), F.col("c")).alias("x"))
    # Three for the connection and three for the message.
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 6
    assert len(out.first().x.encode()) == 8192
    assert queries_keys.Q["k15_redact_error"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
