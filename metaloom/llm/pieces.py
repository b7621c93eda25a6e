"""SentencePiece encoding and decoding with seeded merge-dropout, for models of the merge (BPE) type with byte fallback."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import columns, in_arrow, table

MODEL = "piece_bpe_32k.model"
#: Merges don't reach over units (a newline, or a word with the spaces before it): a piece has its spaces in front, and none holds a newline. Units of up to as many characters are cut together, longer ones one by one.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32)
#: Characters of the texts that are cut together.
CHUNK = 400_000
NONE, FAR = (1 << 31) - 1, 1 << 60
MASK, GOLDEN, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Which symbols merge into which and how early, as a hash table from pairs of symbols: a symbol is a piece's id, or a number from size on for a character that is only part of pieces, or -1 for any other."""

    BITS = 20

    def __init__(self, ids: dict[str, int], scores: dict[str, float], size: int):
        chars = {c for p in ids for c in p}
        symbol = ids | {c: size + k for k, c in enumerate(sorted(chars - ids.keys()))}
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = symbol[c]
        rank = {v: k for k, v in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(symbol[p[:k]] << 32 | symbol[p[k:]], rank[scores[p]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, ranks, to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.rank, self.to = np.full(1 << self.BITS, NONE, np.int32), np.zeros(1 << self.BITS, np.int32)
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] == -1)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.rank[at[won]], self.to[at[won]] = left[won], ranks[won], to[won]
            left, ranks, to, at = (np.delete(x, won) for x in (left, ranks, to, at))
            at = at + 1 & (1 << self.BITS) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(GOLDEN) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where nothing is made) and what is made of neighbours a, b."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        got = self.keys[at]
        rank, to = np.where(got == keys, self.rank[at], NONE), self.to[at]
        on = np.flatnonzero((got != keys) & (got != -1))
        while len(on):
            at[on] = at[on] + 1 & (1 << self.BITS) - 1
            got = self.keys[at[on]]
            hit = on[got == keys[on]]
            rank[hit], to[hit] = self.rank[at[hit]], self.to[at[hit]]
            on = on[(got != keys[on]) & (got != -1)]
        return rank, to


def gaps(x: np.ndarray, dropout: float) -> np.ndarray:
    """Steps that go well before the next skipped one, drawn by random words x: geometric, as each step is skipped with probability dropout."""
    if not 0 < dropout < 1:
        return np.full(len(x), 0 if dropout > 0 else FAR)
    return np.floor(np.log(((x >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / math.log1p(-dropout)).astype(np.int64)


def skips(key: int, dropout: float) -> Iterator[int]:
    """The skipped steps of the unit with this key, one after the other."""
    at = -1
    for n in count():
        at += 1 + int(gaps(mixed(np.array([key + n * GOLDEN & MASK], np.uint64)), dropout)[0])
        yield at


class Model:
    """A model file's pieces: scores by text, ids by text, and the bytes that each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.texts, self.byte = {}, {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.texts.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.texts.append(b"")
            else:
                p = p.replace("▁", " ")
                self.ids[p], self.scores[p] = i, sp.get_score(i)
                self.texts.append(p.encode())
        self.merges = Merges(self.ids, self.scores, len(self.texts))

    def segment(self, unit: str, skips: Iterator[int]) -> list[str]:
        """The agenda: candidate merges of neighbours, best score first and leftmost among equals; skips are the steps, in order, whose candidate is dropped."""
        scores, n = self.scores, len(unit)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := scores.get(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        step, skip = -1, next(skips, -1)
        while agenda:
            _, i, m, e = heapq.heappop(agenda)
            if end[i] != m or end[m] != e:
                continue
            step += 1
            if step == skip:
                skip = next(skips, -1)
                continue
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (s := scores.get(unit[i : end[e]])) is not None:
                    heapq.heappush(agenda, (-s, i, e, end[e]))
            if i and (s := scores.get(unit[(j := before[i]) : e])) is not None:
                heapq.heappush(agenda, (-s, j, i, e))
        out, i = [], 0
        while i < n:
            out.append(unit[i : end[i]])
            i = end[i]
        return out

    def encode(self, text: str, dropout: float, seed: int, doc_id: object = None) -> np.ndarray:
        return next(self.encode_all([text], dropout, seed, [doc_id]))

    def encode_all(self, texts: list[str], dropout: float, seed: int, doc_ids: list) -> Iterator[np.ndarray]:
        """Ids of whole texts; a space is put in front of each, as the model was made with. Each candidate of each unit is skipped or not by draws keyed by seed, doc_id and the unit's offset in its text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                size += len(texts[end])
                end += 1
            yield from self._chunk(texts[at:end], dropout, seed, doc_ids[at:end])
            at = end

    def _chunk(self, texts: list[str], dropout: float, seed: int, doc_ids: list) -> list[np.ndarray]:
        spaced = [" " + t if t else "" for t in texts]
        whole = "".join(spaced)
        if not whole:
            return [np.empty(0, "<u2") for _ in texts]
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        begins = np.cumsum(sizes) - sizes
        # Units: a newline, or spaces with what follows up to the next space or newline.
        line, space = chars == 10, chars == 32
        new = line.copy()
        new[1:] |= line[:-1] | space[1:] & ~space[:-1]
        new[begins[sizes > 0]] = True
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(chars))
        base = np.array([xxhash.xxh64_intdigest(str(d).encode("utf-8", "surrogatepass"), seed & MASK) for d in doc_ids], np.uint64)
        doc = np.repeat(np.arange(len(texts)), sizes)[start]
        keys = mixed(base[doc] + (start - begins[doc]).astype(np.uint64) * np.uint64(GOLDEN))
        symbols = self.merges.of_char[chars]
        alive = np.ones(len(chars), bool)
        least = 1
        for most in WIDTHS:
            of = np.flatnonzero((size > least) & (size <= most))
            least = most
            if len(of):
                self._merge(symbols, alive, start[of], size[of], most, keys[of], dropout)
        for k in np.flatnonzero(size > least).tolist():
            i = int(start[k])
            alive[i : i + size[k]] = False
            for p in self.segment(whole[i : i + int(size[k])], skips(int(keys[k]), dropout)):
                alive[i] = True
                symbols[i] = self.ids.get(p, -1)
                i += len(p)
        left = np.flatnonzero(alive)
        ids, counts = symbols[left], None
        if len(odd := np.flatnonzero((ids < 0) | (ids >= len(self.texts)))):
            raw = [[self.byte[x] for x in chr(chars[left[k]]).encode("utf-8", "surrogatepass")] for k in odd.tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[odd] = list(map(len, raw))
            ids = np.repeat(ids, counts)
            ids[np.repeat(np.isin(np.arange(len(left)), odd), counts)] = np.concatenate(raw)
        at = np.searchsorted(left if counts is None else np.repeat(left, counts), begins[1:])
        return np.split(ids.astype("<u2"), at)

    def _merge(self, symbols: np.ndarray, alive: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, keys: np.ndarray, dropout: float) -> None:
        """segment() of many units of up to most characters at once, each row a unit; symbols and alive (whether a piece begins there) are changed in place."""
        find, rows, cols = self.merges.find, len(start), np.arange(most)
        inside = cols < size[:, None]
        place = np.where(inside, start[:, None] + cols, 0)
        sym = np.where(inside, symbols[place], -1)
        rank, to = (x.reshape(rows, most - 1) for x in find(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        sym, rank, to = (np.hstack([x, np.full((rows, 1), fill, np.int32)]).ravel() for x, fill in ((sym, -1), (rank, NONE), (to, 0)))
        # A row has most + 1 symbols, of which the last is none, and most ranks of pairs by their left symbol.
        wide = most + 1
        after, before = np.tile(np.arange(1, wide + 1), rows), np.tile(np.arange(-1, most), rows)
        live, rank2 = inside.copy(), rank.reshape(rows, most)
        row, skip, drawn = np.arange(rows), gaps(mixed(keys), dropout), np.zeros(rows, np.uint64)
        step = 0
        while True:
            j = rank2[row].argmin(1)
            on = rank2[row, j] < NONE
            row, j = row[on], j[on]
            if not len(row):
                break
            if len(gone := np.flatnonzero(skip[row] == step)):
                r = row[gone]
                rank2[r, j[gone]] = NONE
                drawn[r] += np.uint64(1)
                skip[r] += 1 + gaps(mixed(keys[r] + drawn[r] * np.uint64(GOLDEN)), dropout)
                ok = np.ones(len(row), bool)
                ok[gone] = False
                r, j = row[ok], j[ok]
            else:
                r = row
            s0, p0 = r * wide, r * most
            e = after[s0 + j]
            f, b = np.minimum(after[s0 + e], most), before[s0 + j]
            sym[s0 + j] = made = to[p0 + j]
            live[r, e] = False
            rank2[r, e] = NONE
            after[s0 + j], before[s0 + f] = f, j
            rank[p0 + j], to[p0 + j] = find(made, sym[s0 + f])
            h = np.flatnonzero(b >= 0)
            k = p0[h] + b[h]
            rank[k], to[k] = find(sym[s0[h] + b[h]], made[h])
            step += 1
        symbols[place[inside]], alive[place[inside]] = sym.reshape(rows, wide)[:, :most][inside], live[inside]

    def decode(self, ids: np.ndarray) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 1, path: str | None = None, copy: str | None = None) -> DataFrame:
    """Adds ids (array of int) to docs(doc_id, text, ...). Null text gives null, empty text no ids; long texts are cut whole. The draws are keyed by seed, doc_id, the number in the column named copy (if one is given) and a unit's offset in its text, so that each occurrence of a unit (a word with its spaces) is segmented by draws of its own; repeated rows are cut alike. With dropout 0 the ids are the model's own. Candidates that tie go leftmost first. Other columns pass through; an ids column of docs is replaced. An empty table gives no rows."""
    path = path or model_path()
    kept = [(f, c) for f, c in zip(docs.schema, columns(docs), strict=True) if f.name.lower() != "ids"]
    own = docs.select(*(c for _, c in kept), F.col("doc_id").alias("_1"), (F.col(copy) if copy else F.lit(0)).alias("_2"), F.col("text").cast("string").alias("_3"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            docs, copies, texts = (c.to_pylist() for c in b.columns[-3:])
            found = m.encode_all([t or "" for t in texts], dropout, seed, [f"{d}/{c}" if c else d for d, c in zip(docs, copies, strict=True)])
            ids = [None if t is None else x.astype(np.int32) for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-3], "ids"])

    return in_arrow(own, run, StructType([*(f for f, _ in kept), StructField("ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded to rows with ids: the text that they came from. Null ids give null, no ids the empty text. Other columns pass through; a decoded column of rows is replaced. An empty table gives no rows."""
    path = path or model_path()
    kept = [(f, c) for f, c in zip(rows.schema, columns(rows), strict=True) if f.name.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [m.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "decoded"])

    own = rows.select(*(c for _, c in kept), F.col("ids").alias("_1"))
    return in_arrow(own, run, StructType([*(f for f, _ in kept), StructField("decoded", StringType())]))


def digests(docs: DataFrame, dropout: float = 0.1, seed: int = 1, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, lossless) of docs(doc_id, text): each whole text is encoded and decoded again; a null text counts as empty, repeated rows give repeated results, an empty table none. Other columns are not read. ids_crc32 is over little-endian unsigned 32-bit ids."""
    import hashlib

    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out: list = [[], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for text, ids in zip(texts, m.encode_all(texts, dropout, seed, b.column(0).to_pylist()), strict=True):
                back = m.decode(ids)
                for k, v in enumerate((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
