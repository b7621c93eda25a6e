"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import xxhash
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicates
from metaloom.llm import shingles

from .test_ops import TEXTS, groups


def slow_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(rows):
    sets = [(d, slow_set(t)) for d, t in rows if d is not None]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9]
    return groups(pairs, {d for d, _ in sets})


def test_near_copies(spark, monkeypatch):
    """Copies with some words changed, of similarities on both sides of 0.8, and a passage that many texts share."""
    monkeypatch.setattr(shingles, "BLOCK", 3)
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "no id"), (3, "one")]
    for k in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 300))]
        rows.append((1000 + 10 * k, f"{passage} {' '.join(words)}"))
        for c in range(1, 5):
            copy = list(words)
            for i in r.sample(range(len(copy)), r.randrange(1, max(2, len(copy) // 20))):
                copy[i] = f"c{r.randrange(10**6)}"
            rows.append((1000 + 10 * k + c, f"{passage} {' '.join(copy)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_groups(rows)
    assert {x.doc_id: x.component_id for x in shingles.similar_groups(docs).collect() if x.doc_id is not None} == want
    kept = [x.doc_id for x in near_duplicates(spark, docs, "").collect()]
    assert {d for d in kept if d is not None} == set(want.values()) and None in kept
    assert 40 < len([d for d in set(want.values()) if d >= 1000]) < 200


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = slow_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near_duplicates(spark, docs, sf).collect()} == set(want.values())


def test_no_rows(spark):
    assert near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_simhash_links_before_prefixes(spark, monkeypatch):
    """What fingerprints link within 4 bits is linked without the join over prefixes, if whole sets are similar; fingerprints of sets are as brute force makes them."""
    r = random.Random(2)
    text = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    near = text[:1000] + ["changed"] + text[1001:]
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(text[::-1])), (4, None), (5, "a b c d e f"), (6, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {x.doc_id: x.fp % (1 << 64) for x in shingles.set_ids(docs).collect()}
    for d, t in rows:
        hashes = [xxhash.xxh64_intdigest(x.encode()) for x in slow_set(t)]
        assert fp[d] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert (fp[1] ^ fp[2]).bit_count() <= 4

    def none(batches, *_):
        for _ in batches:
            pass
        yield from ()

    monkeypatch.setattr(shingles, "stars", none)
    monkeypatch.setattr(shingles, "across", none)
    assert {x.doc_id: x.component_id for x in shingles.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_simhash_links_are_verified(spark):
    """Sets whose fingerprints are equal, but which aren't similar, stay apart; a chain through one that is similar to both is kept."""
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60))), (3, " ".join(f"a{i}" for i in range(58))), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = shingles.set_ids(docs).withColumn("fp", F.lit(7).cast("long"))
    s = {x.doc_id: x.s for x in ids.collect()}
    links = {frozenset(x) for x in shingles.similar_sets(docs, shingles.written(ids, "ids")).collect()}
    assert links == {frozenset((s[1], s[3]))}
