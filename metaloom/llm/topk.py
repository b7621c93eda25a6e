"""Exact top-k search by inner product in three phases of a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_path, open_folder, table

#: Queries of a block; scores, and components of candidates, held at once by a task.
BLOCK, HELD, SLAB = 16_384, 1 << 21, 1 << 24
#: Phase 1 scores one candidate in HEAD, those of the greatest norms. Bounds are enlarged by more than they can be rounded.
HEAD, SLACK = 4, 1 + 1e-12


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v): components floor(scale * x) as long, x as double. Rows whose id or vector is null, or whose vector holds a null or non-finite component, are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with 0, longer ones meet no query component there."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width), np.int64), 0
    for k, n in enumerate(sizes):
        out[k, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


class Slab:
    """A task's share of the candidates, heaviest vectors first. Scores are of the first half of the components, then of all."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.greatest = float(np.abs(vectors).max(initial=0))

    def chunks(self, asks: Asks, low: np.ndarray | None = None, most: int | None = None) -> Iterator[tuple]:
        """Of the first most candidates, in chunks whose scores fit HELD: which queries are still asked, ids of the candidates, first halves' scores, bounds of the scores (-inf for a query's own id) and the other half. A query is asked while its norm and the chunk's heaviest allow its cutoff low."""
        width, half = asks.width, asks.width // 2
        exact = asks.greatest * self.greatest * max(1, width) < 2**53
        step = max(16, HELD // max(1, len(asks.ids)))
        for i in range(0, len(self.ids) if most is None else most, step):
            rows = slice(i, i + step if most is None else min(i + step, most))
            reach = asks.norms * self.norms[i]
            on = np.arange(len(asks.ids)) if low is None else np.flatnonzero(reach * SLACK + 0.5 >= low)
            if not len(on):
                return
            own, c = self.ids[rows], _width(self.vectors[rows], width)
            if exact:
                f = c.astype(np.float64)
                part, tail = asks.floats[on, :half] @ f[:, :half].T, f[:, half:]
                upper = (part + asks.rest[on][:, None] * np.sqrt((tail**2).sum(1))[None, :]) + (1 - 1 / SLACK) * reach[on][:, None]
            else:
                part, tail = asks.ints[on] @ c.T, None
                upper = part.astype(np.float64)
            yield on, own, part, np.where(asks.ids[on][:, None] == own[None, :], -np.inf, upper), tail

    @staticmethod
    def resolve(asks: Asks, on: np.ndarray, part: np.ndarray, tail: np.ndarray | None, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a candidate, exact."""
        if tail is None:
            return part[q, c]
        out, half = np.empty(len(q), np.int64), asks.width // 2
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
            out[i : i + len(a)] = part[a, b] + np.einsum("ij,ij->i", asks.floats[on[a], half:], tail[b])
        return out


class Asks:
    """A block of queries and their cutoffs, where they have one."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, low: np.ndarray):
        self.ids, self.ints, self.low, self.width = ids, ints, low, ints.shape[1]
        self.floats = ints.astype(np.float64)
        self.norms, self.rest = np.sqrt((self.floats**2).sum(1)), np.sqrt((self.floats[:, self.width // 2 :] ** 2).sum(1))
        self.greatest = float(np.abs(ints).max(initial=0))


def _width(v: np.ndarray, width: int) -> np.ndarray:
    return v[:, :width] if v.shape[1] >= width else np.hstack([v, np.zeros((len(v), width - v.shape[1]), v.dtype)])


def asked(folder: str) -> Iterator[Asks]:
    """The queries of a written table (id, v, low), a block of at most BLOCK at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, root = open_folder(folder)
    for f in sorted(fs.get_file_info(FileSelector(root)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                for b in pq.ParquetFile(source).iter_batches(BLOCK, columns=["id", "v", "low"]):
                    v = b.column(1)
                    if b.num_rows:
                        yield Asks(b.column(0).to_numpy(), _matrix(v, max(1, int(np.diff(v.offsets.to_numpy()).max()))), b.column(2).to_numpy())


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    """Candidates (id, v), SLAB components at a time, so that a task holds no more however large its partition."""
    held, size = [], 0
    for b in batches:
        v = b.column(1)
        wide = int(np.diff(v.offsets.to_numpy()).max(initial=0))
        held.append((b.column(0).to_numpy(), _matrix(v, max(1, wide))))
        size += held[-1][1].size
        if size >= SLAB:
            yield _slab(held)
            held, size = [], 0
    if held:
        yield _slab(held)


def _slab(held: list) -> Slab:
    wide = max(v.shape[1] for _, v in held)
    return Slab(np.concatenate([i for i, _ in held]), np.concatenate([_width(v, wide) for _, v in held]))


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each q by score downwards, then id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
    own = rank < k
    return q[own], ids[own], scores[own]


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest integer inner product, ties to the smaller id; all, if there are fewer.

    Queries are the rows that is_query (over the column id) holds for. They are a written table, which tasks read a block at a time; the driver sees neither queries nor cutoffs. A query's own id is no candidate. Repeated rows are candidates each; a repeated query id asks once, with its smallest vector. Of vectors of unequal length the common components count. Rows with null ids or vectors, or null or non-finite components, take no part. An empty table gives no rows. Other columns are not read.
    """
    rows = whole_vectors(df, id_col, vec_col)
    asks = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    folder = new_path(df.sparkSession, "queries")
    asks.withColumn("low", F.lit(-(1 << 63))).write.parquet(folder)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            for asks in asked(folder):
                best = (np.empty(0, np.int64),) * 3
                for on, own, part, upper, tail in slab.chunks(asks, most=-(-len(slab.ids) // HEAD)):
                    take = min(k, upper.shape[1])
                    c = np.argpartition(-upper, take - 1, axis=1)[:, :take].ravel()
                    q = np.repeat(np.arange(len(on)), take)
                    q, c = (x[np.isfinite(upper[q, c])] for x in (q, c))
                    best = _best(*(np.concatenate(x) for x in zip(best, (q, own[c], slab.resolve(asks, on, part, tail, q, c)), strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(asks.ids[best[0]]), pa.array(best[2])], ["id", "score"])

    # Phase 1: the best few scores of each node's heaviest vectors, and of all of them each query's k-th: at least k candidates score as much, so nothing below it can be a result.
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score")))
    cut = rows.mapInArrow(lists, "id long, score long").withColumn("at", place).where(F.col("at") == k).select("id", F.col("score").alias("low"))
    known = df.sparkSession.read.schema("id long, v array<long>").parquet(folder)
    cutoffs = new_path(df.sparkSession, "cutoffs")
    known.join(cut, "id", "left").select("id", "v", F.coalesce("low", F.lit(-(1 << 63))).alias("low")).write.parquet(cutoffs)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            for asks in asked(cutoffs):
                best = (np.empty(0, np.int64),) * 3
                for on, own, part, upper, tail in slab.chunks(asks, asks.low):
                    q, c = np.nonzero((upper + 0.5 >= asks.low[on][:, None]) & np.isfinite(upper))
                    scores = slab.resolve(asks, on, part, tail, q, c)
                    enough = scores >= asks.low[on[q]]
                    best = _best(*(np.concatenate(x) for x in zip(best, (on[q[enough]], own[c[enough]], scores[enough]), strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(asks.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

    # Phases 2 and 3: what can reach the cutoff by the bound on its other half is resolved exactly; each node sends its first k of those that do reach it.
    got = rows.mapInArrow(entries, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
