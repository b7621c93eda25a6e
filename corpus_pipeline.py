"""A corpus-cleaning pipeline over documents: reject low quality, drop recurring lines, keep one of each near-duplicate group, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its rows are written and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import written
from metaloom.llm.line_dedup import drop_lines
from metaloom.llm.mixing import mix
from metaloom.llm.pieces import encode
from metaloom.llm.quality import keep_good, labels_of
from metaloom.llm.shingles import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from the labelled rows among them, doesn't reject; texts that are null or empty are scored as any other. An empty table gives no rows."""
    return keep_good(docs, labels_of(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only; n_chars follows the text. Null texts stay null, rows that repeat are rows of their own, and an empty table gives no rows."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id. SimHash links those within its radius, a join over prefixes of shingles those beyond; either's links hold where five-word shingles have a Jaccard similarity of at least 0.8."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a document taken twice gives two rows, told apart by mix_copy."""
    return mix(docs.drop("mix_copy"), copy="mix_copy")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each row's text (none for null); each copy of a document is cut by draws of its own."""
    ids = encode(docs.select("doc_id", "lang", "source", "text", "mix_copy"), copy="mix_copy")
    return ids.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.col("ids"))


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixture", mixture), ("pieces", pieces)]

#: The classifier, the near-duplicates by shingles and the encoding can't be put in DuckDB's SQL; tests/llm holds the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, name.replace(" ", "_"))
    return docs
