"""Mixing sources to target weights: how often each document is repeated so that every source comes near its target of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, columns, fresh, table, written

#: More sources than this are joined by shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Adds rank (from 0) by order without one task for all rows: ranges, their counts, and positions within each."""
    parts = written(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()), name)
    before = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = parts.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return own.join(F.broadcast(before.drop("count")), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) rows -> (source, source_size, target): share of all sizes, split by weights that repeat over the sources in code-point order (null last); no target exceeds cap times its source's size, and what is cut goes to the others by weight until none is above.

    The common level of target per weight rises with each round, as capped sources leave; each round is one aggregation to three numbers. Null sources are one source, last in order; ties are none, as each source has one row. An empty table gives no rows, sources without words get 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = ranked(by_source, F.col("source").asc_nulls_last(), "sources").withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    s = written(s.drop("rank"), "weights")
    total, level, capped = None, 0.0, -1
    while True:
        at = F.col("most") <= F.lit(level) * F.col("w")
        got = s.agg(F.sum("source_size"), F.count_if(at), F.coalesce(F.sum(F.when(at, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at, F.col("w"))), F.lit(0.0))).first()
        total = share * (got[0] or 0)
        if got[1] == capped or not got[3]:
            break
        capped, level = got[1], (total - got[2]) / got[3]
    return s.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("w")).alias("target"))


def _rated(docs: DataFrame, names: list[str], seed: str = "mix", **how) -> DataFrame:
    """docs with four more columns, of names that docs mustn't have: size, source_size, target, copies."""
    size, source_size, target, copies = names
    sized = docs.withColumn(size, n_words(F.col("text")))
    targets = source_targets(sized.select("source", F.col(size).alias("size")), **how)
    of, *_ = fresh(sized, "of_source")
    targets = targets.select(F.col("source").alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    return joined.withColumn(copies, F.floor(rate).cast("long") + (draw < rate - F.floor(rate)).cast("long"))


def with_copies(docs: DataFrame, **how) -> DataFrame:
    """Adds size, source_size, target and copies to docs(doc_id, text, source, ...): floor(rate) copies, and one more where a hash of seed and doc_id, as a number in [0, 1), is under the rate's fraction; rate is target / source_size.

    A null, empty or blank text has size 0; it follows its source's rate as any other, and a source without any words takes none. Rows that share a doc_id share their draw; repeated rows are each of their own. Null sources are one source. An empty table gives no rows. Other columns pass through; columns of the added names are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    names = fresh(docs, *added)
    kept = [c for n, c in zip(docs.columns, columns(docs), strict=True) if n.lower() not in added]
    return _rated(docs, names, **how).select(*kept, *(F.col(n).alias(a) for n, a in zip(names, added, strict=True)))


def mix(docs: DataFrame, copy: str | None = None, **how) -> DataFrame:
    """docs with each row emitted as often as the mix takes it, by the rules of with_copies; a column named copy, if asked for, numbers a row's copies from 0 (one of docs by that name is replaced). All other columns, of any names, pass through."""
    names = fresh(docs, "size", "source_size", "target", "copies", "number", "none")
    kept = [c for n, c in zip(docs.columns, columns(docs), strict=True) if not copy or n.lower() != copy.lower()]
    got = _rated(docs, names[:4], **how).select("*", F.posexplode(F.array_repeat(F.lit(0), F.col(names[3]).cast("int"))).alias(*names[4:]))
    return got.select(*kept, *([F.col(names[4]).alias(copy)] if copy else []))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM s
), bars AS (
  SELECT -1.0::DOUBLE AS bar UNION SELECT most / w FROM w
), levels AS (
  SELECT bar, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(most) FILTER (most <= bar * w), 0)) / sum(w) FILTER (most > bar * w) AS level
  FROM bars, w GROUP BY bar
), level AS (
  SELECT min_by(level, bar) AS level FROM levels
  WHERE level IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE most > bar * w AND most <= level * w)
), t AS (
  SELECT source, source_size, least(most, level * w) AS target FROM w, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size AS taken FROM rated
"""
