"""Merge-dropout: draws of their own for each document, copy and place, and cutting in bulk against one unit at a time."""

import re

import numpy as np
import pytest
import xxhash

from metaloom.llm import pieces

from .test_ops import TEXTS


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.model_path())


def slow_ids(m, text, dropout, seed, doc_id):
    out, base = [], xxhash.xxh64_intdigest(str(doc_id).encode(), seed)
    for u in re.finditer(r" *[^ \n]+|\n| +", " " + text) if text else ():
        key = int(pieces.mixed(np.array([base + u.start() * pieces.GOLDEN & pieces.MASK], np.uint64))[0])
        for p in m.segment(u[0], pieces.skips(key, dropout)):
            out.extend([m.ids[p]] if p in m.ids else (m.byte[x] for x in p.encode()))
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_in_bulk(model, dropout):
    texts = [t for t in TEXTS if t is not None] + ["", " a  b \n\n c", "unbelievable internationalisation " * 30, "x" * 40 + " 日本語日本語 " + "ab" * 16, "\n"]
    got = list(model.encode_all(texts, dropout, 7, list(range(len(texts)))))
    for k, (t, ids) in enumerate(zip(texts, got, strict=True)):
        assert ids.tolist() == slow_ids(model, t, dropout, 7, k)
        assert model.decode(ids) == t


def test_each_occurrence_has_its_draws(model):
    one = ["international"] * 200
    cuts = {tuple(model.encode(" ".join(one[: k + 1]), 0.1, 1, 5).tolist()[len(model.encode(" ".join(one[:k]), 0.1, 1, 5)) :]) for k in range(1, 100)}
    assert len(cuts) > 5
    assert len({tuple(model.encode("international", 0.1, 1, d).tolist()) for d in range(200)}) > 5
    n = [len(model.encode("international " * 500, 0.1, 1, d)) for d in range(20)]
    assert len(set(n)) > 5


def test_share_of_skipped_steps():
    got = [s for k in range(300) for s in iter_under(pieces.skips(k * 977, 0.1), 200)]
    assert 0.09 < len(got) / 60_000 < 0.11


def iter_under(it, most):
    for s in it:
        if s >= most:
            return
        yield s


def test_copies_are_cut_differently(spark):
    from corpus_pipeline import pieces as stage

    docs = spark.createDataFrame([(1, "en", "a", "international words " * 50, k) for k in range(3)], "doc_id long, lang string, source string, text string, mix_copy int")
    assert len({tuple(r.ids) for r in stage(spark, docs, "").collect()}) == 3


def test_last_stages(spark, sf):
    """Mixture and pieces on documents as they are: so many rows as copies, each read back whole."""
    import corpus_pipeline as cp
    from metaloom.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = cp.written(cp.mixture(spark, docs, sf), "test_mixture")
    copies = {r.doc_id: r.copies for r in mixing.with_copies(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: k for d, k in copies.items() if k}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in pieces.decode(cp.pieces(spark, mixed, sf)).collect())
