"""Line dedup: lines that recur across documents go, but for one holder; per-document bitmaps say which lines stay. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, ascii_lower, columns, fresh, table

#: Rows that one hash can have after counting.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """Of each line of at least min_chars after stripping: two independently seeded 64-bit hashes and its position."""
    lines = F.transform(_lines(ascii_lower(text)), lambda x, i: F.struct(F.trim(x, F.lit(SPACE)).alias("k"), i.alias("pos")))
    long = F.filter(lines, lambda x: F.length(x.k) >= min_chars)
    return F.transform(long, lambda x: F.struct(F.xxhash64(x.k).alias("h"), F.xxhash64(F.lit(7), x.k).alias("g"), x.pos.alias("pos")))


def _text_id(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text)


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_id, dropped): the lines to drop as a sparse bitmap, word position -> 64 bits, for the texts that lose any; text_id tells apart the texts of rows that share a doc_id.

    A key recurs if min_docs different doc_ids hold it, however many rows or lines of each do; its holder is the largest of them, and all rows of the holder keep it. Rows with a null doc_id hold nothing and keep their lines. Null, empty and short texts have no keys; an empty table gives no rows. Each pair of document and key is made single in a shuffle by both, so that no key is hot there, then counted, combined before the shuffle, to a row for each hash and each of SALTS shares of the documents. Those rows are range-partitioned by hash with a secondary sort by document, and the first of each hash is streamed off as the line's holder. The lines of a hash that a third of the rows hold are dealt out by the join's adaptive split. Within a text, the bitmap keeps the order of positions.
    """
    keys = docs.where("doc_id is not null").select("doc_id", _text_id(F.col("text")).alias("text_id"), _keys(F.col("text"), min_chars).alias("keys"))
    once = keys.select("doc_id", F.explode(F.array_distinct(F.transform("keys", lambda x: F.struct(x.h.alias("h"), x.g.alias("g"))))).alias("k")).select("doc_id", "k.h", "k.g").distinct()
    counted = once.groupBy("h", "g", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    of_key = W.partitionBy("h", "g")
    streamed = counted.repartitionByRange("h", "g").select("h", "g", "last", F.row_number().over(of_key.orderBy(F.desc("last"))).alias("at"), F.sum("n").over(of_key).alias("n"))
    repeated = streamed.where((F.col("at") == 1) & (F.col("n") >= min_docs)).drop("at", "n")
    at = keys.select("doc_id", "text_id", F.explode("keys").alias("k")).select("doc_id", "text_id", "k.h", "k.g", "k.pos")
    drop = at.join(repeated, ["h", "g"]).where("doc_id <> last")
    words = drop.groupBy("doc_id", "text_id", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, lines: str = "lines", kept: str = "kept") -> DataFrame:
    """docs(doc_id, text, ...) with two more columns, of names that docs mustn't have: all lines (array) and those that its row's bitmap keeps. Other columns pass through."""
    doc, text, dropped, own = fresh(docs, "of_doc", "of_text", "dropped", "text_id")
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_id").alias(text), F.col("dropped").alias(dropped))
    rows = docs.select(*columns(docs), _text_id(F.col("text")).alias(own))
    joined = rows.join(marks, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(text)), "left").withColumn(lines, _lines(F.col("text")))
    hit = lambda i: F.coalesce(F.col(dropped)[F.floor(i / 64).cast("long")], F.lit(0).cast("long"))
    keep = F.filter(lines, lambda x, i: F.getbit(hit(i), i % 64) == 0)
    return joined.select(*columns(docs), lines, F.when(F.col(dropped).isNull(), F.col(lines)).otherwise(keep).alias(kept))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) with text rewritten to the lines that stay, joined by newlines, by the rules of line_bitmaps. One row for each row of docs, repeats included; a null text stays null; other columns, of any names, pass through."""
    lines, kept = fresh(docs, "lines", "kept")
    out = apply_bitmaps(docs, line_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs), lines, kept)
    text = F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))
    return out.select(*(text.alias(n) if n.lower() == "text" else c for n, c in zip(docs.columns, columns(docs), strict=True)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = apply_bitmaps(docs, line_bitmaps(docs))
    n = F.size("lines").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT r, doc_id, i, line, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
