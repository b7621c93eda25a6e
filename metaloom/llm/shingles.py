"""Near-duplicates by SimHash of whole texts' word shingles, each link checked by exact Jaccard similarity; similar sets whose fingerprints lie further apart are linked by a join over prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, connected_components, in_arrow, written
from .simhash import STEP, majority, near_links

WIDTH = 5
#: Jaccard similarity of at least 4 / 5, in whole numbers: 5 * both >= 4 * (a + b - both).
NUM, DEN = 4, 5
#: Shingles put last in the order of prefixes, at most, and how often the sample (a SAMPLE-th of the sets) has them at least. They bear on speed alone: any order gives the same links.
COMMON, SAMPLE, OFTEN = 500_000, 16, 4
#: Marks of the texts that candidates are made of, by the low bits of their hash: a fixed size, and a text marked by chance is dropped by a join.
SLOTS = 1 << 24
#: How many members of a bucket are paired with its others, round by round, before all that are still apart are paired. They bear on speed alone.
HUBS = (4, 16)
#: Members of a bucket compared at a time.
BLOCK = 1000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one of all words where there are fewer than width, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(width, n) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(starts, ends, strict=False)]), "<i8"))


def _sets(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts' shingles, and a hash of each set, alike for equal sets."""
    sets = [shingles(t) for t in texts]
    return sets, np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in sets), np.uint64, len(sets)).view(np.int64)


def _slot(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) & SLOTS - 1


def set_ids(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, s, slot, fp): the hash of the text's set, the text's own mark, and the set's SimHash (0 without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sets, s = _sets(texts)
            fp = np.fromiter((majority(h[i : i + STEP].tobytes() for i in range(0, len(h), STEP)) for h in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array([_slot(t) for t in texts], pa.int32()), pa.array(fp)], ["doc_id", "s", "slot", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, s long, slot int, fp long")


def shingle_sets(docs: DataFrame, marks: np.ndarray | None = None) -> DataFrame:
    """docs(text) -> (s, hs), hs being a text's shingles; with marks (packed bits), only of texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marks is None else np.unpackbits(marks).view(bool)
        for b in batches:
            sets, s = _sets([t for t in b.column(0).to_pylist() if bits is None or bits[_slot(t)]])
            at = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
            hs = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(s), hs], ["s", "hs"])

    return in_arrow(docs.select(F.col("text").cast("string")), run, "s long, hs array<long>")


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Rows (h, s, n, p): shingle h stands at place p of the n of set s, in an order with the common ones last. Of the first n - ceil(0.8 n) + 1 two similar sets share at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out: list = [[], [], [], []]
            for h, s in zip(*_sets(b.column(0).to_pylist()), strict=True):
                n = len(h)
                if not n or s in seen:
                    continue
                seen.add(s)
                k = n - (NUM * n + DEN - 1) // DEN + 1
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    h = np.concatenate([h[~last], h[last]])
                for c, v in zip(out, (h[:k], np.full(k, s), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "s", "n", "p"])

    return in_arrow(docs.select(F.col("text").cast("string")), run, "h long, s long, n int, p int")


def _room(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that share the shingle at their places p and q can be similar."""
    return (NUM + DEN) * np.minimum(n - p, m - q) >= NUM * (n + m)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns that begin with (h, s), in order of these -> the same without repeats, no bucket being torn."""

    def single(cols: list) -> list:
        new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        return [c[new] for c in cols]

    waiting: list = []
    for batch in batches:
        cols = [np.asarray(c).astype(np.int64, copy=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        cut = np.searchsorted(cols[0], cols[0][-1])  # the last bucket may go on
        if cut or waiting and waiting[0][0][0] != cols[0][0]:
            held = [np.concatenate(x) for x in zip(*waiting, [c[:cut] for c in cols], strict=True)]
            if len(held[0]):
                yield single(held)
            waiting = []
        waiting.append([c[cut:] for c in cols])
    if waiting:
        yield single([np.concatenate(x) for x in zip(*waiting, strict=True)])


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, s, n, p) in order of (h, s) -> pairs (a, b) of each bucket's first member and any other that may be similar; the members of buckets of three or more come as (s, null, h, n, p, size of the bucket) too, for these hold other pairs."""
    names = ["a", "b", "h", "n", "p", "size"]
    for h, s, n, p in buckets(batches):
        cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        size = np.diff(np.append(cuts, len(h)))
        first, size = np.repeat(cuts, size), np.repeat(size, size)
        rest = np.flatnonzero((first != np.arange(len(h))) & _room(n[first], p[first], n, p))
        more = np.flatnonzero(size > 2)
        none = pa.nulls(len(rest), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(s[first[rest]]), pa.array(s[rest]), none, none, none, none], names)
        yield pa.RecordBatch.from_arrays([pa.array(s[more]), pa.nulls(len(more), pa.int64()), *(pa.array(c[more]) for c in (h, n, p, size))], names)


def across(batches: Iterator[pa.RecordBatch], hubs: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (h, s, n, p, c), buckets h in one piece each -> pairs (a, b), a < b, of a bucket's members of different components c that may be similar: of its first hubs members and all others, or of all."""
    for h, s, n, p, c in buckets(batches):
        cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        apart = np.add.reduceat(c != np.repeat(c[cuts[:-1]], np.diff(cuts)), cuts[:-1]) > 0
        for i, j in zip(cuts[:-1][apart], cuts[1:][apart], strict=True):
            for k in range(i, j if hubs is None else min(i + hubs, j), BLOCK):
                x = slice(k, min(k + BLOCK, j if hubs is None else min(i + hubs, j)))
                for m in range(k, j, BLOCK):
                    y = slice(m, min(m + BLOCK, j))
                    ok = (c[x][:, None] != c[y][None, :]) & (np.arange(x.start, x.stop)[:, None] < np.arange(m, y.stop)[None, :])
                    ok &= _room(n[x][:, None], p[x][:, None], n[y][None, :], p[y][None, :])
                    at, to = np.nonzero(ok)
                    a, b = s[x][at], s[y][to]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def verified(docs: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a written table, whose whole sets have a similarity of at least 0.8; a written table. Sets are made anew, from the texts marked for it: held, they'd be larger than the texts."""
    ends = written(pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct(), "ends")
    marks = np.zeros(SLOTS, bool)
    marks[ids.join(ends, "s", "left_semi").select("slot").distinct().toArrow().column(0).to_numpy()] = True
    held = shingle_sets(docs, np.packbits(marks)).join(ends, "s", "left_semi").groupBy("s").agg(F.first("hs").alias("hs"))
    both = pairs.join(held.select(F.col("s").alias("a"), F.col("hs").alias("x")), "a").join(held.select(F.col("s").alias("b"), F.col("hs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where((NUM + DEN) * shared >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), "similar")


def simhash_pairs(ids: DataFrame) -> DataFrame:
    """set_ids -> pairs (a, b), a < b, of sets, whose components are those of all pairs of fingerprints within 4 bits; a written table."""
    sets = ids.groupBy("s").agg(F.first("fp").alias("fp"))
    nodes = written(sets.groupBy("fp").agg(F.min("s").alias("rep")), "nodes")
    same = sets.join(nodes, "fp").where("s <> rep").select(F.col("rep").alias("a"), F.col("s").alias("b"))
    pairs = near_links(nodes).unionByName(same)
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash_pairs")


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that links leave in different components."""
    of = connected_components(links)
    for x in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def similar_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(text) and its set_ids -> links (a, b) between the hashes of sets, whose components are those of all pairs with a similarity of at least 0.8, each link verified on the whole sets.

    SimHash links come first. Similar sets may have fingerprints further apart than its radius, so the sets that share a prefix's shingle are looked through for what it has left apart: in each bucket of them the first member is paired with the others; in buckets of three or more, the members with most company are then paired with those that are still in other components, and at last all that are still apart: sets that share prefixes but no chain of similar ones. So a group of copies makes pairs about in proportion to its members.
    """
    links = verified(docs, ids, simhash_pairs(ids))
    sample = docs.select("text").where(F.xxhash64("text") % SAMPLE == 0).distinct()
    often = shingle_sets(sample).select(F.explode("hs").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    common = np.sort(np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(COMMON).select("h").collect()], np.int64))
    sent = prefixes(docs, common).repartition("h").sortWithinPartitions("h", "s")
    found = written(sent.mapInArrow(stars, "a long, b long, h long, n long, p long, size long"), "candidates")
    pairs = written(apart(found.where("b is not null").select("a", "b").distinct(), links), "pairs")
    links = links.unionByName(verified(docs, ids, pairs))
    members = found.where("b is null").select("h", F.col("a").alias("s"), "n", "p", "size")
    members = written(members.join(members.groupBy("s").agg(F.sum("size").alias("company")), "s").drop("size"), "members")
    for hubs in (*HUBS, None):
        of = members.join(connected_components(links), F.col("s") == F.col("node"), "left").select("h", "s", "n", "p", F.coalesce("root", "s").alias("c"), "company")
        dealt = of.repartition("h").sortWithinPartitions("h", F.desc("company"), "s").drop("company")
        pairs = written(dealt.mapInArrow(lambda it, hubs=hubs: across(it, hubs), "a long, b long").distinct(), "pairs")
        if not pairs.isEmpty():
            links = links.unionByName(verified(docs, ids, pairs))
    return links


def similar_groups(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id): the smallest doc_id reachable over pairs of texts whose five-word shingles have a Jaccard similarity of at least 0.8.

    Texts without words are alike. Rows that share a doc_id are one document; a row with a null doc_id takes the component of its links.
    """
    ids = written(set_ids(docs), "set_ids")
    links = similar_sets(docs, ids)
    first = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a < z").select("doc_id", "a")
    links = links.unionByName(ids.join(first, "doc_id").where("s <> a").select("a", F.col("s").alias("b")))
    of = ids.join(connected_components(links), F.col("s") == F.col("node"), "left").select("doc_id", F.coalesce("root", "s").alias("c"))
    return of.join(of.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents whose group has a smaller doc_id; rows without a doc_id stay, and so do all rows of a doc_id that stays. Of texts without words one document stays. An empty table gives no rows; all columns, of any names, pass through."""
    gone = similar_groups(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
