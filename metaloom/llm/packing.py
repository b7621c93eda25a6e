"""Best-fit packing of documents into sequences of tokens, by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import in_arrow, table, written
from .units import blocks, byte_bpe, lookup, natural, split_units

SIZE, END = 2048, 0
#: Pieces that one task packs.
SHARD = 8000
NEVER = 1 << 40


def sum_of_squares(sizes: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Sequences as lists of places in sizes, which are at most size: each piece goes, in turn, where the sum over gaps of the squared number of open sequences with that gap becomes smallest. A sequence that is full is open no more; of equal sums the smallest gap wins, and an open sequence over a new one."""
    n, of_gap, out = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)], []
    for place, s in enumerate(sizes.tolist()):
        gap = size
        if s < size:
            now = n[s:size]
            more = n[: size - s] - now
            more *= 2
            more += 2
            more[0] -= 1  # it becomes full
            more[now == 0] = NEVER
            at = int(more.argmin())
            if more[at] <= 2 * n[size - s] + 1:
                gap = s + at
        if gap == size:
            k = len(out)
            out.append([])
        else:
            k = of_gap[gap].pop()
            n[gap] -= 1
        out[k].append(place)
        if s < gap:
            of_gap[gap - s].append(k)
            n[gap - s] += 1
    return out


def best_fit(sizes: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """The same by the smallest gap that holds a piece."""
    n, of_gap, out = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)], []
    for place, s in enumerate(sizes.tolist()):
        fits = n[s:size] > 0
        at = int(fits.argmax()) if s < size else 0
        if s < size and fits[at]:
            gap = s + at
            k = of_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, k = size, len(out)
            out.append([])
        out[k].append(place)
        if s < gap:
            of_gap[gap - s].append(k)
            n[gap - s] += 1
    return out


def pack_some(sizes: np.ndarray, size: int, last: bool) -> tuple[list[list[int]], list[int]]:
    """Sequences of pieces in decreasing order, by the sum of squares, and the places of pieces that aren't in any: those of sequences with a gap, or none if last: then these are packed again by best fit, and all pieces are if that takes fewer sequences."""
    packed = sum_of_squares(sizes, size)
    full = [x for x in packed if sizes[x].sum() == size]
    rest = np.sort(np.array([i for x in packed if sizes[x].sum() < size for i in x], np.int64))
    if not last:
        return full, rest.tolist()
    again = full + [rest[x].tolist() for x in best_fit(sizes[rest], size)]
    return min(packed, again, best_fit(sizes, size), key=len), []


def cut_pieces(docs: DataFrame, name: str = "byte_bpe_50k.json", size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> a written table (uid, doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id as pieces of at most size; only longer ones are cut, and then the first piece is what is over. uid tells pieces of all rows apart.

    Null and empty texts have the end id alone. Rows that repeat are documents of their own; null ids stay; an empty table gives no rows; other columns aren't read. Texts are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, known, uid = byte_bpe(name, True), {}, TaskContext.get().partitionId() << 36
        cut = lambda units: [np.array(bpe.cut(u), "<u4").tobytes() for u in units]
        ending = np.array([end], "<u4").tobytes()
        for block in blocks(batches, 1):
            rows, ends, at, keys = split_units(block.column(1).combine_chunks().fill_null(""))
            tokens, places = lookup(keys, known, cut), at.tolist()
            doc_ids = block.column(0).take(pa.array(rows)).to_pylist()
            out: list[list] = [[] for _ in range(7 if ids else 6)]
            for doc, i, j in zip(doc_ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                first = natural(keys[places[i]])[1:]  # without the space that was put before the text
                raw = b"".join([*cut([first] if first else []), *map(tokens.__getitem__, places[i + 1 : j]), ending])
                n = len(raw) // 4
                starts = [0, *range(n % size or size, n, size)] if n > size else [0]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    own = raw[4 * a : 4 * b]
                    for column, v in zip(out, (uid, doc, k, a, b - a, zlib.crc32(own), own), strict=False):
                        column.append(v)
                    uid += 1
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, pa.int64()) for c in out[:6]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in out[6:]], names=names + ["ids"] * ids)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(in_arrow(own, run, "uid long, doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids binary" * ids), "pieces")


def pack_pieces(pieces: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """pieces(uid, length, ...) -> the same rows with sequence_id (the uid of the first piece in it) and offset.

    Pieces of the full size are sequences by themselves. The others are dealt by hash into shards of about so many, whatever documents they are of, and each shard is packed by the sum of squares. Its sequences with gaps are opened, and their pieces packed again with those of other shards, in rounds, until one shard holds them all or a round leaves most pieces open; then all are kept. Each round is a written table. Ties in length go by uid; an empty table gives no rows; a length over size is an error.
    """
    added = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    placed = StructType([*pieces.schema.fields, *added, StructField("_closed", BooleanType())])

    def packer(last: bool):
        def run(t: pa.Table) -> pa.Table:
            t = t.drop_columns(["_shard"])
            lengths, uids = np.asarray(t.column("length")), np.asarray(t.column("uid"))
            if lengths.max() > size:
                raise ValueError(f"a piece is longer than {size}")
            order = np.lexsort((uids, -lengths))
            sequence, offset, closed = np.zeros(len(uids), np.int64), np.zeros(len(uids), np.int64), np.zeros(len(uids), bool)
            for x in pack_some(lengths[order], size, last)[0]:
                at = order[x]
                sequence[at], offset[at], closed[at] = uids[at[0]], np.cumsum(lengths[at]) - lengths[at], True
            for name, v in (("sequence_id", pa.array(sequence, mask=~closed)), ("offset", pa.array(offset, mask=~closed)), ("_closed", pa.array(closed))):
                t = t.append_column(name, v)
            return t

        return run

    alone = pieces.where(F.col("length") == size).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    todo, out, last, n = pieces.where(F.col("length") != size), [alone], False, None
    n = todo.count()
    while n:
        shards = math.ceil(n / shard)
        last = last or shards == 1
        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64("uid", F.lit(len(out))), F.lit(shards)))
        got = written(dealt.groupBy("_shard").applyInArrow(packer(last), placed), "packed")
        out.append(got.where("_closed").drop("_closed"))
        todo, before = got.where("not _closed").select(*pieces.columns), n
        n = 0 if last else todo.count()
        last = n > before / 2
    packed = out[0]
    for x in out[1:]:
        packed = packed.unionByName(x)
    return packed


def sequences(placed: DataFrame) -> DataFrame:
    """Pieces with ids and places -> (sequence_id, n_tokens, uids, ids): each sequence's ids in order, as little-endian 32-bit integers, and the pieces in it."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "uid", "ids")))
    return placed.groupBy("sequence_id").agg(held.alias("x")).select("sequence_id", F.aggregate("x", F.lit(0).cast("long"), lambda n, p: n + p.length).alias("n_tokens"), F.transform("x", lambda p: p.uid).alias("uids"), F.aggregate("x", F.lit(b""), lambda raw, p: F.concat(raw, p.ids)).alias("ids"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_pieces(cut_pieces(table(spark, sf_dir, "documents", "doc_id", "text")))
    return placed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
