"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import columns, fresh, id_crc, in_arrow, table

BITS = 18
SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3
#: The odd multipliers of the hash families.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Bytes of a text taken at a time; what is cut there is put together again, so that it bears on memory alone.
PIECE = 1 << 22
BASE, WRAP = 0x100000001B3, 1 << 64

KIND = np.full(256, MARK, np.uint8)
KIND[[32, 9, 10, 11, 12, 13]] = SPACE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[128:] = LETTER
LOWERED = np.arange(256).astype(np.uint64)
LOWERED[65:91] += 32


@cache
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full((1 << bits) - 1, BASE)]).astype(np.uint64), dtype=np.uint64)


def _runs(b: np.ndarray) -> list[np.ndarray]:
    """Runs of one kind of byte: hash, size, upper-case letters, kind, whether the first is upper-case."""
    kind = KIND[b]
    starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(b)]]))
    at = np.arange(len(b)) - np.repeat(starts, sizes)
    words = np.add.reduceat((LOWERED[b] + np.uint64(1)) * _powers(int(sizes.max() - 1).bit_length())[at], starts)
    upper = np.add.reduceat(((b >= 65) & (b <= 90)).astype(np.int64), starts)
    return [words, sizes, upper, kind[starts].astype(np.int64), (b[starts] >= 65) & (b[starts] <= 90)]


def _joined(a: list, runs: list[np.ndarray]) -> None:
    """Puts run a in front of the first of runs, which goes on with it."""
    words, sizes, upper, _, first = runs
    words[0] = (int(a[0]) + pow(BASE, int(a[1]), WRAP) * int(words[0])) % WRAP
    sizes[0] += a[1]
    upper[0] += a[2]
    first[0] = a[4]


def gram_pieces(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text, repeats included, a piece of it at a time: words (runs of letters, of digits or of other marks), pairs of words, and triples of word shapes; a shape also says whether the word equals one of the two before it. A text of one or two words has its shapes alone instead of triples."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    open_: list | None = None  # the run that may go on in the next piece
    word, shape, seen = np.empty(0, np.uint64), np.empty(0, np.uint64), 0  # the last two words, and how many there were
    for i in range(0, len(raw), PIECE):
        runs = _runs(raw[i : i + PIECE])
        if open_ is not None:
            if open_[3] == runs[3][0]:
                _joined(open_, runs)
            else:
                runs = [np.concatenate([[a], r]).astype(r.dtype) for a, r in zip(open_, runs, strict=True)]
        open_ = None
        if i + PIECE < len(raw):
            open_, runs = [r[-1] for r in runs], [r[:-1] for r in runs]
        words, sizes, upper, of, first = runs
        own = of != SPACE
        if not own.any():
            continue
        shapes = (of * 4 + np.where(upper == 0, 0, np.where(upper == sizes, 2, np.where((upper == 1) & first, 1, 3))))[own].astype(np.uint64)
        k = len(word)
        word, shape = np.concatenate([word, words[own]]), np.concatenate([shape, shapes])
        shape[max(k, 1) :] += np.uint64(16) * (word[max(k, 1) :] == word[max(k, 1) - 1 : -1])
        shape[max(k, 2) :] += np.uint64(32) * (word[max(k, 2) :] == word[max(k, 2) - 2 : -2])
        seen += len(word) - k
        pairs = word[:-1] * ODD[1] + word[1:]
        pairs, triples = pairs[max(k - 1, 0) :], (shape[:-2] * np.uint64(256) + shape[1:-1]) * np.uint64(256) + shape[2:]
        yield (np.concatenate([word[k:] * ODD[0], pairs * ODD[2], (triples + np.uint64(1)) * ODD[3]]) >> np.uint64(64 - BITS)).astype(np.int64)
        word, shape = word[-2:], shape[-2:]
    if 0 < seen <= 2:
        yield ((shape + np.uint64(1)) * ODD[3] >> np.uint64(64 - BITS)).astype(np.int64)


def grams(text: str | None) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *gram_pieces(text)])


def train_ftrl(texts: list, labels: list, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights by FTRL-proximal over the rows in order; the last weight is the constant's. A text's values are SCALE times its buckets' shares."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    weights = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
    rows = []
    for t in texts:
        i, c = np.unique(grams(t), return_counts=True)
        rows.append((np.append(i, 1 << BITS), np.append(SCALE * c / max(1, c.sum()), 1.0)))
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None))


SCALE = 30.0


def train(labelled: DataFrame, shards: int = 4, **how) -> np.ndarray:
    """labelled(doc_id, text, label) -> weights: each shard of the rows is trained on in an order of hashes, and the shards' weights are averaged. What reaches the driver is at most 2^18 + 1 weights for each shard.

    Rows of a shard that tie by hash go by doc_id, then text; repeated rows are learnt from again. Null and empty texts bear on the constant alone. Without rows all weights are 0, so every score is 0.5. labelled is read once and must be bounded, as sample_labelled's is: a shard is one task's. Other columns are not read.
    """

    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "text"])
        w = train_ftrl(rows.text.tolist(), rows.label.tolist(), **how)
        (i,) = np.nonzero(w)
        return pd.DataFrame({"i": np.append(i, -1), "w": np.append(w[i], 1.0)})

    h = F.xxhash64(F.lit("shard"), F.col("doc_id"))
    rows = labelled.select("doc_id", "text", F.col("label").cast("double"), h.alias("order"), F.pmod(h, F.lit(shards)).alias("shard"))
    got = rows.groupBy("shard").applyInPandas(shard, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros((1 << BITS) + 2)  # the last counts the shards with rows
    out[got.i.to_numpy(np.int64)] = got.w.to_numpy(float)
    return out[:-1] / max(1.0, out[-1])


def sample_labelled(docs: DataFrame, labels: DataFrame, bound: int = 2500) -> DataFrame:
    """(doc_id, text, label) of about bound rows of each label, drawn by a hash of doc_id; labels(doc_id, label) without nulls, its label a number of few values (0 and 1). Only the labels are counted and drawn; what is broadcast is the drawn ids, bounded by bound. Where labels or docs repeat an id, each pair of rows is one of the sample; ids of only one table, and empty tables, give no rows. Other columns are not read; texts are taken whole, however long."""
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    u = (F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0).alias("u")
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, min(1.0, bound / n)).otherwise(share)
    drawn = labels.where(u < share)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Adds a score (0 to 1) of docs' text by the name given to docs, one row for each row; null, empty and blank texts get the constant's score, long texts are taken whole. Other columns, of any names, pass through; one of docs by that name is replaced. An empty table gives no rows."""
    w32 = weights.astype(np.float32)
    text, got = fresh(docs, "text_", "score_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for k, t in enumerate(b.column(b.num_columns - 1)):
                total, n = 0.0, 0
                for i in gram_pieces(t.as_py()):
                    total += w32[i].sum(dtype=np.float64)
                    n += len(i)
                out[k] = SCALE * total / max(1, n) + w32[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], [*b.schema.names[:-1], got])

    kept = [c for n, c in zip(docs.columns, columns(docs), strict=True) if n.lower() != name.lower()]
    own = docs.select(*kept, F.col("text").cast("string").alias(text))
    return in_arrow(own, run, StructType([*own.schema.fields[:-1], StructField(got, DoubleType())])).withColumnRenamed(got, name)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality is not null and doc_id is not null")
    return labels.where(id_crc(F.col("doc_id")) % 3 != 1).select("doc_id", F.col("quality").alias("label"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    weights = train(sample_labelled(docs, labels_of(spark, sf_dir)))
    out = score(docs, weights)
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject (score 0.5 or more), learnt from those of docs that labels(doc_id, label) covers; without any, all stay. Rows are judged each on its own text, so repeated rows stay or go together, and null or empty texts by the constant; all columns, of any names, pass through."""
    (name,) = fresh(docs, "score")
    got = score(docs, train(sample_labelled(docs, labels)), name)
    return got.where(F.col(name) >= 0.5).select(*columns(docs))
