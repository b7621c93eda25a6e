"""Cross-tokenizer alignment: token-byte incidence matrices in compressed sparse rows, and their products, link the tokens of two vocabularies.

With A and B the incidences of tokens and bytes, A·Bᵀ holds for each pair of tokens the bytes they share: its entries are the overlap links. With tokens and groups (what lies between two byte offsets where tokens of both end) the same product gives the shared-group links.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table, written
from .units import ByteBpe, Pieces, blocks, byte_bpe, lookup, piece_model, split_units

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of the texts that are aligned together, and distinct units whose ids a worker remembers.
BLOCK_BYTES, REMEMBERED = 1 << 20, 200_000
#: Entries that a product expands at once.
SLAB = 1 << 18


@dataclass
class Csr:
    """A matrix in compressed sparse rows: row i has columns indices[indptr[i]:indptr[i+1]], with their values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    n_cols: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.n_cols))])
        return Csr(indptr, self.rows[order], self.values[order], len(self.indptr) - 1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] of them, for each i."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def incidence(sizes: np.ndarray) -> Csr:
    """Tokens that follow one another, of so many bytes each, by bytes."""
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int64), n)


def membership(of: np.ndarray, n: int) -> Csr:
    """Tokens by groups: each token is in one."""
    return Csr(np.arange(len(of) + 1), of, np.ones(len(of), np.int64), n)


def product(a: Csr, b: Csr, slab: int = SLAB) -> Csr:
    """a·b row by row (Gustavson): each entry (i, k) of a row of a brings row k of b, and entries of row i that meet in a column are added up. Rows are taken in slabs of bounded size; an entry is never held for more than its slab."""
    widths = np.diff(b.indptr)[a.indices]
    work = np.concatenate([[0], np.cumsum(widths)])[a.indptr]
    cuts = [0]
    while cuts[-1] < len(a.indptr) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(work, work[cuts[-1]] + slab, side="right")) - 1))
    counts, indices, values = [np.zeros(1, np.int64)], [], []
    a_rows = a.rows
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        s = slice(a.indptr[lo], a.indptr[hi])
        w = widths[s]
        at = ragged(b.indptr[a.indices[s]], w)
        key = np.repeat(a_rows[s], w) * b.n_cols + b.indices[at]
        value = np.repeat(a.values[s], w) * b.values[at]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, value = key[first], np.add.reduceat(value, first) if len(first) else value
        counts.append(np.bincount(key // b.n_cols - lo, minlength=hi - lo))
        indices.append(key % b.n_cols)
        values.append(value)
    none = np.zeros(0, np.int64)
    return Csr(np.cumsum(np.concatenate(counts)), np.concatenate([none, *indices]), np.concatenate([none, *values]), b.n_cols)


@dataclass
class Aligned:
    """Units aligned one behind the other. Ids and ends (byte offsets) of the tokens of both, where the tokens of each unit end, the group of each token, and the groups' ends by unit."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray
    good: np.ndarray

    def links(self) -> Csr:
        """A's tokens by B's: how many bytes they share."""
        return product(incidence(np.diff(self.a_ends, prepend=0)), incidence(np.diff(self.b_ends, prepend=0)).transposed())

    def shared(self) -> Csr:
        """A's tokens by B's: whether they are in one group."""
        n = int(self.group_at[-1]) if len(self.group_at) else 0
        return product(membership(self.a_group, n), membership(self.b_group, n).transposed())


class Aligner:
    def __init__(self, a: ByteBpe, b: Pieces):
        if max(a.size, b.size) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.a, self.b, self.known = a, b, {}
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v.bytes], np.int64) for v in (a, b))
        texts = [f"{i}{end}".encode() for end in ",|" for i in range(a.size)] + [f"{i}{end}".encode() for end in ",;" for i in range(b.size)]
        self.widths = np.array([len(x) for x in texts], np.int64)
        self.texts = np.zeros((len(texts), int(self.widths.max())), np.uint8)
        for i, x in enumerate(texts):
            self.texts[i, : len(x)] = np.frombuffer(x, np.uint8)

    def _cut(self, units: list[str]) -> list[bytes]:
        """Of each unit, as 16-bit integers, the number of A's ids, these, and B's; none of either where their joined bytes aren't the unit."""
        both = list(zip([self.a.cut(u) for u in units], self.b.cut_all(units), strict=True))
        joined = lambda v, ids: b"".join(map(v.bytes.__getitem__, ids))
        raw = "".join(units).encode()
        if any(joined(v, chain.from_iterable(x[k] for x in both)) != raw for k, v in enumerate((self.a, self.b))):
            both = [x if joined(self.a, x[0]) == joined(self.b, x[1]) == u.encode() else ((), ()) for u, x in zip(units, both, strict=True)]
        return [array("H", (len(a), *a, *b)).tobytes() for a, b in both]

    def align(self, keys: list[str]) -> Aligned:
        """Units by their keys. good: where the joined tokens are the unit; others have no tokens."""
        cut = lookup(keys, self.known, self._cut, REMEMBERED)
        flat, sizes = np.frombuffer(b"".join(cut), np.uint16), np.array([len(x) // 2 for x in cut], np.int64)
        starts = np.cumsum(sizes) - sizes
        a_n = flat[starts].astype(np.int64)
        b_n = sizes - 1 - a_n
        a, b = flat[ragged(starts + 1, a_n)].astype(np.int64), flat[ragged(starts + 1 + a_n, b_n)].astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_at, b_at = np.cumsum(a_n), np.cumsum(b_n)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        ends = np.concatenate([[0], a_ends])[a_at]
        return Aligned(a, b, a_ends, b_ends, a_at, b_at, np.searchsorted(common, a_ends), np.searchsorted(common, b_ends), np.searchsorted(common, ends, side="right"), a_n > 0)

    def group_texts(self, x: Aligned) -> list[bytes]:
        """Each unit's groups as `a1,a2|b1`, with ; behind each."""
        a_last = np.diff(x.a_group, append=-1) != 0
        b_last = np.diff(x.b_group, append=-1) != 0
        n = int(x.group_at[-1]) if len(x.group_at) else 0
        a_n, b_n = np.bincount(x.a_group, minlength=n), np.bincount(x.b_group, minlength=n)
        codes = np.zeros(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + np.concatenate([[0], np.cumsum(b_n)])[x.a_group]] = x.a + self.a.size * a_last
        codes[np.arange(len(x.b)) + np.cumsum(a_n)[x.b_group]] = 2 * self.a.size + x.b + self.b.size * b_last
        widths = self.widths[codes]
        raw = self.texts[codes][np.arange(self.texts.shape[1]) < widths[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(widths)])[x.a_at + x.b_at].tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str = A_NAME, b: str = B_NAME) -> Aligner:
    """A worker's aligner of two vocabularies."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(byte_bpe(a, False), piece_model(b))
    return _aligners[a, b]


def _places(n: int) -> str:
    """The type of places among n."""
    return "<u2" if n <= 1 << 16 else "<u4"


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x up to each end, from the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)


def token_links(docs: DataFrame, kind: str = "overlap", a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, a_ids, a_ends, b_ids, b_ends, links): the tokens of both vocabularies with the byte offsets at which they end in the text with a space before it, and the links (a, b, weight) between token places: by overlap, weighed by the bytes shared, or kind "group", between all tokens of a group.

    Null and empty texts, and texts that joined tokens don't give back, have empty arrays. One row for each row of docs, repeats included; an empty table gives no rows; other columns aren't read. Texts of any length are taken whole, a long one by itself.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        lists = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("weight", pa.int32())]))
        for block in blocks(batches, 1, BLOCK_BYTES):
            out: dict[str, list] = {n: [] for n in ("doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "links")}
            for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                rows, ends, at, keys = split_units(pa.array([text or ""]))
                x = al.align([keys[i] for i in at.tolist()])
                links = x.links() if kind == "overlap" else x.shared()
                if not text or not x.good.all():
                    x, links = al.align([]), None
                out["doc_id"].append(doc)
                for n, v in (("a_ids", x.a), ("a_ends", x.a_ends), ("b_ids", x.b), ("b_ends", x.b_ends)):
                    out[n].append(v)
                out["links"].append([] if links is None else [{"a": i, "b": j, "weight": w} for i, j, w in zip(links.rows.tolist(), links.indices.tolist(), links.values.tolist(), strict=True)])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), *(pa.array(out[n], ints) for n in ("a_ids", "a_ends", "b_ids", "b_ends")), pa.array(out["links"], lists)], names=list(out))

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(own, run, "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, links array<struct<a:int,b:int,weight:int>>")


def aligned_blocks(docs: DataFrame, a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """docs(doc_id, text) as a written table of blocks of documents. A row for each document: block, doc_id, its counts, the hash of its groups, and its units as places among the block's distinct ones. A row for each block besides: its distinct pairs of linked ids with their counts in the block, and the pairs of each distinct unit as places among them. Units are aligned once in a block, so that links aren't worked out again for each of their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, part = aligner(a, b), TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, 1, BLOCK_BYTES)):
            texts = block.column(1).combine_chunks().fill_null("")
            rows, ends, at, keys = split_units(texts)
            x = al.align(keys)
            links, none = x.links(), np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            blank = np.asarray(pa.compute.equal(pa.compute.binary_length(texts), 0))[rows]
            bad = (_sums(~x.good[at], ends) > 0) | blank
            of_unit = {"n_a": np.diff(x.a_at, prepend=0), "n_b": np.diff(x.b_at, prepend=0), "n_groups": np.diff(x.group_at, prepend=0), "n_links": np.diff(links.indptr[np.concatenate([[0], x.a_at])])}
            own = {n: np.where(bad, 0, _sums(v[at], ends)) for n, v in of_unit.items()}
            written_groups, hashes, held = al.group_texts(x), [], []
            places = at.tolist()
            for i, j, gone in zip(starts.tolist(), ends.tolist(), bad.tolist(), strict=True):
                hashes.append("" if gone else hashlib.sha256(b"".join(map(written_groups.__getitem__, places[i:j]))[:-1]).hexdigest())
                held.append(b"" if gone else at[i:j].astype(_places(len(keys))).tobytes())
            pair = x.a[links.rows] << 32 | x.b[links.indices]
            pairs, place = np.unique(pair, return_inverse=True)
            used = np.bincount(at[np.repeat(~bad, np.diff(ends, prepend=0))], minlength=len(keys))
            counts = np.bincount(place, weights=np.repeat(used, of_unit["n_links"]), minlength=len(pairs)).astype(np.int64) if len(pairs) else none
            ids = block.column(0).combine_chunks().take(pa.array(rows))
            nulls = lambda n, t: pa.nulls(n, t)
            ints, n = pa.list_(pa.int64()), len(rows)
            number = part << 32 | k
            names = ["block", "doc_id", *own, "groups_sha256", "units", "pairs", "counts", "unit_links", "unit_pairs"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), ids, *(pa.array(v) for v in own.values()), pa.array(hashes), pa.array(held, pa.binary()), nulls(n, ints), nulls(n, ints), nulls(n, pa.binary()), nulls(n, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(nulls(1, pa.int64()) for _ in range(5)), nulls(1, pa.string()), nulls(1, pa.binary()), pa.array([pairs], ints), pa.array([counts], ints), pa.array([of_unit["n_links"].astype("<i4").tobytes()]), pa.array([place.astype("<i4").tobytes()])], names=names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(in_arrow(own, run, "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, counts array<long>, unit_links binary, unit_pairs binary"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all blocks: how many links hold the ids pair >> 32 and pair & 0xffffffff linked, and whether no other pair of that second id has more."""
    own = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = written(own.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"), "pair_counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a: str = A_NAME, b: str = B_NAME) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how the tokens of two vocabularies overlap in each text, and how often the linked ids are linked in all texts.

    Null and empty texts, and texts that joined tokens don't give back, have zeros and an empty hash, and count nowhere. One row for each row of docs, repeats included; texts that occur again count again; pairs that share an id's highest count are all its best. An empty table gives no rows; other columns aren't read. Texts are taken whole, in blocks of bounded size or one long text each. Counts are summed over blocks, joined back to each block's distinct pairs, and brought to its documents: what is shuffled grows with the blocks, not with the links.
    """
    aligned = aligned_blocks(docs, a, b)
    pairs = aligned.where("pairs is not null").select("block", F.posexplode("pairs").alias("pos", "pair"))
    found = pairs.join(pair_counts(aligned), "pair").select(F.col("block").alias("of_block"), "pos", "n", "best")

    def run(key, own: pa.Table, looked_up: pa.Table) -> pa.Table:
        whole = own.filter(pa.compute.is_valid(own.column("unit_links")))
        docs_ = own.filter(pa.compute.is_null(own.column("unit_links")))
        widths = np.frombuffer(whole.column("unit_links")[0].as_py(), "<i4")
        places = np.frombuffer(whole.column("unit_pairs")[0].as_py(), "<i4")
        n = np.zeros(int(places.max(initial=-1)) + 1, np.int64)
        best = n.copy()
        pos = np.asarray(looked_up.column("pos"))
        n[pos], best[pos] = np.asarray(looked_up.column("n")), np.asarray(looked_up.column("best"))
        ends = np.cumsum(widths)
        held = [np.frombuffer(x, _places(len(widths))) for x in docs_.column("units").to_pylist()]
        units, of_doc = np.concatenate([np.zeros(0, np.uint16), *held]), np.cumsum([len(x) for x in held])
        sums = [pa.array(_sums(_sums(x[places], ends)[units], of_doc).astype(np.int64)) if len(held) else pa.array([], pa.int64()) for x in (best, n)]
        return pa.Table.from_arrays([*(docs_.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, docs_.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    left = aligned.drop("pairs", "counts")
    return left.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents", "doc_id", "text"))
