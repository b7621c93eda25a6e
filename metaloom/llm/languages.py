"""Language ID by mixtures: expectation-maximisation finds each document's shares of languages from n-gram likelihoods; languages join the mixture while the likelihood gains more than a penalty."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, in_arrow, table, written

BITS = 14
#: Characters of a text taken at a time; it bears on memory alone.
PIECE = 1 << 20
#: Counts that a model holds at most: more languages share the same number of counts among them, in fewer buckets each, but 16 at least.
CELLS, FEWEST = 1 << 24, 4


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> np.ndarray | None:
    """Counts by bucket of a whole text's trigrams, lower-cased, all but letters as single spaces; None without a letter."""
    counts, letter, any_letter = np.zeros(1 << BITS, np.int64), _letters(), False
    text = text.lower() + " "
    last = np.array([32], np.uint32)  # what goes before this piece: two characters, or at first a space
    for i in range(0, len(text), PIECE):
        x = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = letter[x]
        any_letter = any_letter or bool(own.any())
        x = np.concatenate([last, np.where(own, x, 32)]).astype(np.uint32)
        fresh = np.concatenate([[True] * len(last), own])
        fresh[len(last) :] |= x[len(last) - 1 : -1] != 32  # a space after a letter stays
        x = x[fresh]
        h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1]) * np.uint32(0x85EBCA77) + x[2:]
        counts += np.bincount((h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        last = x[-2:]
    return counts if any_letter else None


def bits_for(languages: int) -> int:
    """Bits of the buckets that so many languages are told apart by."""
    return max(FEWEST, min(BITS, (CELLS // max(1, languages)).bit_length() - 1))


def folded(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts by bucket as counts by fewer buckets: a bucket's number begins with the fewer bits."""
    return counts if bits == BITS else counts.reshape(1 << bits, -1).sum(1)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: a row of trigram counts for each language."""
        self.bits = counts.shape[1].bit_length() - 1
        p = counts + 0.5
        self.languages, self.p = languages, p / p.sum(1, keepdims=True) if len(languages) else p
        self.log = np.log(self.p)

    def mixture(self, counts: np.ndarray, penalty: float = 4.0, rounds: int = 25) -> tuple[list[int], np.ndarray]:
        """The languages and their shares. From the best single language on, the one whose entry promises most is taken in if the fitted likelihood gains over penalty * log(trigrams). The log-likelihood is concave in the shares, so sum(c * p_l / q) - n bounds the gain of language l, and no fit is made where the bound is under the penalty."""
        u = np.flatnonzero(counts)
        c, p = counts[u].astype(float), self.p[:, u]
        n, bar = c.sum(), penalty * np.log(c.sum() + 1)
        own = [int(np.argmax(self.log[:, u] @ c))]
        share = np.ones(1)
        q = p[own[0]]
        while len(own) < len(self.languages):
            ratio = c / q
            gain = p @ ratio - n
            gain[own] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= bar:
                break
            among, ps = own + [best], p[own + [best]]
            w = np.append(share * 0.7, 0.3)
            for _ in range(rounds):
                before, w = w, w * (ps @ (c / (w @ ps))) / n
                if np.abs(w - before).max() < 1e-3:
                    break
            new = w @ ps
            if c @ np.log(new / q) <= bar:
                break
            own, share, q = among, w, new
        return own, share

    def predict(self, text: str | None) -> tuple[str, float, str]:
        counts = trigrams(text) if text else None
        if counts is None or not self.languages:
            return "und", 0.0, ""
        own, share = self.mixture(folded(counts, self.bits))
        order = sorted(range(len(own)), key=lambda k: (-share[k], self.languages[own[k]]))
        return self.languages[own[order[0]]], float(min(1.0, share[order[0]])), " ".join(f"{self.languages[own[k]]}:{share[k]:.3f}" for k in order)


def fit(labelled: DataFrame, bound: int = 3000) -> Model:
    """labelled(doc_id, text, lang) -> model, from about bound documents of each language, drawn by a hash of doc_id. The driver gets the model alone: CELLS counts at most, as long as there are no more than 2^20 languages.

    Rows with a null text or language teach nothing, nor do texts without a letter; repeated rows teach again, and rows that share a doc_id are drawn together. Long texts are taken whole. An empty table gives a model without languages, by which all is und. Other columns are not read.
    """
    known = labelled.where("lang is not null and text is not null")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    shares = sizes.select(F.col("lang").alias("of_lang"), F.least(F.lit(1.0), bound / F.col("n")).alias("share"))
    bits = bits_for(sizes.count())
    rows = known.select("doc_id", "text", "lang").join(shares, F.col("lang") == F.col("of_lang"))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0 < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, got in total.items():
                (i,) = np.nonzero(got)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(i)), "i": pa.array(i), "n": pa.array(got[i])})
            total.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (got := trigrams(text.as_py())) is not None:
                    total[lang] = total.get(lang, 0) + folded(got, bits)
                if len(total) << bits > CELLS // 8:
                    yield from out()
        yield from out()

    got = in_arrow(drawn.select("lang", "text"), count, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got.lang.unique())
    counts = np.zeros((len(languages), 1 << bits))
    counts[np.searchsorted(languages, got.lang.to_numpy(str)) if languages else [], got.i.to_numpy(np.int64)] = got.n.to_numpy(float)
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of docs(doc_id, text): the language of the largest share, that share, and all shares as text; equal shares go by the language's name. score is a share, not a probability: a text in which no second language gains enough likelihood scores 1 however short it is. A text that is null, empty or without a letter is und, score 0, as is all where the model has no languages. Long texts are taken whole; repeated rows give repeated results, an empty table none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "lang_pred", "score", "mixture"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double, mixture string")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    got = identify(docs, fit(docs.where(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")
