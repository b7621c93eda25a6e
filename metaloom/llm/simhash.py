"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, connected_components, in_arrow, table, written

STEP = 1 << 15


def majority(parts: Iterable[bytes]) -> int:
    """Unsigned 64-bit word of the bits set in over half of the 8-byte hashes that parts hold; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h) // 8
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(width, n) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(line[a:b], seed) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=False)]) for i in range(0, len(ends), STEP))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def covering_masks(radius: int, within: int = 0) -> list[int]:
    """Masks (signed) such that any two words that agree in the bits of within and differ in at most radius bits agree under at least one of them; all hold the bits of within.

    The i-th of the other bits has the vector i mod 2^(radius+1); the mask of a vector v != 0 holds the bits whose vector has an odd inner product with v. The vectors of radius differing bits span at most radius of radius+1 dimensions, so some v is orthogonal to all of them.
    """
    open_, masks = [b for b in range(64) if not within >> b & 1], []
    for v in range(1, 1 << (radius + 1)):
        m = within & (1 << 64) - 1 | sum(1 << b for i, b in enumerate(open_) if ((i % (1 << (radius + 1))) & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _span(fp: np.ndarray, ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one bucket, without listing its pairs."""
    rest, fp = np.arange(len(fp)), fp.view(np.uint64)  # bitwise_count takes a signed word's absolute value
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            c = stack.pop()
            near = np.bitwise_count(fp[rest] ^ fp[c]) <= radius
            if near.any():
                hits, rest = rest[near], rest[~near]
                yield np.full(len(hits), ids[c]), ids[hits]
                stack.extend(hits)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, dense: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (m, key, fp, id) in order of (m, key) -> links (a, b); the members of a bucket of over dense rows come as (a, null, fp, m) instead."""

    def out(pairs: list, fp=None, m=None) -> pa.RecordBatch:
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1)) if pairs else (np.empty(0, np.int64),) * 2
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none, pa.array(fp), pa.array(m.astype(np.int64))] if fp is not None else [pa.array(a), pa.array(b), none, none], ["a", "b", "fp", "m"])

    most = 1 << 62 if dense is None else dense
    held, over = None, None  # rows of the run that may go on; (m, key) of a run that is known to be dense
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        m, key, fp, ids = cols
        if not len(m):
            continue
        cuts = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1])) + 1, [len(m)]])
        held, pairs = None, []
        for i, j in zip(cuts[:-1][np.diff(cuts) > 1], cuts[1:][np.diff(cuts) > 1], strict=True):
            if j == len(m):
                break
            if j - i > most or over == (m[i], key[i]):
                yield out([(ids[i:j], ids[i:j])], fp[i:j], m[i:j])
            else:
                pairs.extend(_span(fp[i:j], ids[i:j], radius))
        i = cuts[-2]
        if cuts[-2] > 0:
            if cuts[1] == 1 and over == (m[0], key[0]):
                yield out([(ids[:1], ids[:1])], fp[:1], m[:1])
            over = None
        if len(m) - i > most or over == (m[i], key[i]):
            yield out([(ids[i:], ids[i:])], fp[i:], m[i:])
            over = (m[i], key[i])
        else:
            held = [c[i:] for c in cols]
        if pairs:
            yield out(pairs)
    if held is not None and len(held[0]) > 1:
        yield out(list(_span(held[2], held[3], radius)))


def near_links(nodes: DataFrame, radius: int = 4, dense: int = 4096) -> DataFrame:
    """nodes(fp, rep), fp distinct -> links (a, b) between reps whose components are those of all pairs within radius bits.

    Each fingerprint goes to one bucket for each covering mask. Within a bucket of up to dense members a spanning forest is built in place. The members of a larger one agree in their mask's 32 bits, so they are dealt out again by covering masks of the other 32, of which each holds 16; a bucket of that second kind leaves 16 bits open and so has at most 2^16 members, whatever the input.
    """
    first = covering_masks(radius)
    second = np.array([covering_masks(radius, m) for m in first], np.int64)
    masks = F.array(*[F.lit(x) for x in first])
    sent = nodes.where("rep is not null").select("fp", "rep", F.posexplode(masks).alias("m", "mask")).select(F.col("m").cast("long"), F.expr("fp & mask").alias("key"), "fp", F.col("rep").alias("id"))
    kind = "a long, b long, fp long, m long"
    found = sent.repartition("key", "m").sortWithinPartitions("m", "key").mapInArrow(lambda it: bucket_links(it, radius, dense), kind)
    found = written(found, "links")
    links, crowd = found.where("m is null").select("a", "b"), found.where("m is not null").select("a", "fp", "m")
    if crowd.isEmpty():
        return links

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = second.shape[1]
        for b in batches:
            a, fp, m = (np.asarray(c) for c in b.columns)
            cols = (m[:, None] * k + np.arange(k)).ravel(), (fp[:, None] & second[m]).ravel(), np.repeat(fp, k), np.repeat(a, k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["m", "key", "fp", "id"])

    dealt = crowd.mapInArrow(again, "m long, key long, fp long, id long").repartition("key", "m").sortWithinPartitions("m", "key")
    return links.unionByName(dealt.mapInArrow(lambda it: bucket_links(it, radius, None), kind).select("a", "b"))


def near_groups(docs: DataFrame, radius: int = 4, width: int = 4, dense: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id): the smallest doc_id reachable over links of at most radius differing bits, chains included.

    Equal fingerprints collapse before anything is compared. Null, empty and blank texts have fingerprint 0 and are linked like any other. A row with a null doc_id keeps its fingerprint and has no id to link by; it takes the component of the rows of its fingerprint that have one, else null. Rows that share a doc_id are one document, repeated rows one member. An empty table gives no rows; long texts are hashed whole. Other columns are not read.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    shared = fps.join(nodes, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")) if _repeats(fps) else None
    links = near_links(nodes, radius, dense)
    roots = connected_components(links if shared is None else links.unionByName(shared))
    of = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def _repeats(fps: DataFrame) -> bool:
    """Whether a doc_id stands for rows of different fingerprints, which then join groups through it."""
    got = fps.where("doc_id is not null").groupBy("doc_id").agg((F.min("fp") < F.max("fp")).alias("x"))
    return not got.where("x").isEmpty()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents whose group has a smaller doc_id; rows without a doc_id stay, and so do all rows of a doc_id that stays. All columns, of any names, pass through."""
    gone = near_groups(docs.select("doc_id", "text"), **how).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
