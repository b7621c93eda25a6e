"""Token-id files: ids under an adaptive context-mixing range coder, in blocks that are reset and checksummed each on its own.

Each id is coded under a mixture of three predictions that learn within the block: order 2 and order 1 name the id that followed their context last time (hashed tables), with shares by how often they have come true at their confidence; where both name one id their shares add up. Order 0 takes the rest: ids are in classes by how frequent they are in the file, the classes' shares adapt with each id, and within a class ids share by the file's counts. Blocks step together, LANES of them, one id of each at a time, so that every step is a few vector operations.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import in_arrow, new_path, open_folder, table, written

U = np.uint64
MAGIC, VOCABULARY, END = b"MLTOK002", 1 << 16, 1
#: The mixture has 2^5 units; what is left of them to order 0 is split into 2^9 among classes, and each class into 2^16 among its ids.
UNITS, SHARES, WITHIN = 5, 9, 16
TOTAL = UNITS + SHARES + WITHIN
#: Classes, bits of their adaptive shares, their least share in those, and how fast they adapt.
CLASSES, FINE, LEAST, RATE = 4, 18, 640, 6
CACHED = 2_000_000
H1, H2, LEVELS = 8, 9, 16
BLOCK, FILE_IDS, LANES = 2048, 1 << 23, 2048
#: Bytes of text that a task writes: its blocks are coded in step, so few of them take as many operations as many do.
TASK_BYTES = 1 << 25
ROW = (1 << H1) + (1 << H2)


class Counts:
    """What order 0 takes from the file: each id's class (16-fold steps of frequency) and its share of it, and the classes' shares at the start of a block."""

    def __init__(self, classes: np.ndarray, freq: np.ndarray, shares: np.ndarray):
        self.classes, self.freq, self.shares = classes.astype(np.int64), freq.astype(np.uint32), shares.astype(np.int32)
        self.cum, self.by_share = np.zeros(VOCABULARY, np.uint32), np.zeros(CLASSES << WITHIN, np.uint32)
        for c in range(CLASSES):
            own = np.flatnonzero((self.classes == c) & (self.freq > 0))
            if len(own):
                self.cum[own] = np.cumsum(self.freq[own]) - self.freq[own]
                self.by_share[c << WITHIN : (c + 1) << WITHIN] = np.repeat(own, self.freq[own])

    @staticmethod
    def of(ids: np.ndarray) -> Counts:
        n = np.bincount(ids, minlength=VOCABULARY).astype(np.int64)
        classes = np.clip((np.log2(n.sum() / np.maximum(n, 1)).astype(np.int64) - 2) // 4, 0, CLASSES - 1)
        freq, sums = np.zeros(VOCABULARY, np.int64), np.zeros(CLASSES, np.int64)
        for c in range(CLASSES):
            own = np.flatnonzero((classes == c) & (n > 0))
            if len(own):
                sums[c] = n[own].sum()
                freq[own] = 1 + n[own] * ((1 << WITHIN) - len(own)) // sums[c]
                freq[own[np.argmax(n[own])]] += (1 << WITHIN) - freq[own].sum()
        free = (1 << FINE) - CLASSES * LEAST
        return Counts(classes, freq, np.cumsum(LEAST + sums * free // n.sum())[:-1])

    def packed(self) -> bytes:
        return zlib.compress(self.classes.astype("<u1").tobytes() + self.freq.astype("<u4").tobytes() + self.shares.astype("<i4").tobytes(), 6)

    @staticmethod
    def unpacked(raw: bytes) -> Counts:
        b = zlib.decompress(raw)
        return Counts(np.frombuffer(b, "<u1", VOCABULARY), np.frombuffer(b, "<u4", VOCABULARY, VOCABULARY), np.frombuffer(b, "<i4", CLASSES - 1, 5 * VOCABULARY))


FOUR, FIFTEEN, SHIFT, SIXTEEN, HIT = (np.uint32(x) for x in (4, 15, SHARES + WITHIN, 16, 1 << 12))
#: Greatest shares of order 2 and order 1, in units.
MOST = np.array([[20], [10]], np.uint32)


class Mixer:
    """The predictions' state in all blocks, one lane each. Coder and decoder go through the same steps. Of arrays of two rows, the first is order 2's."""

    def __init__(self, lanes: int, counts: Counts):
        self.counts, self.lanes, lane = counts, lanes, np.arange(lanes)
        self.row = np.array([lane * ROW + (1 << H1), lane * ROW])
        self.level = np.array([lane * 2 * LEVELS, lane * 2 * LEVELS + LEVELS])
        self.table, self.right = np.zeros(lanes * ROW, np.uint32), np.full(lanes * 2 * LEVELS, 1 << 13, np.uint32)
        # Of each class where its share ends, but of the first where it begins, too.
        self.ends = np.zeros((CLASSES + 1, lanes), np.int32)
        self.ends[1:-1], self.ends[-1] = counts.shares[:, None], 1 << FINE
        self.lane, self.flat = lane, self.ends.reshape(-1)
        self.p, self.pp = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.at = np.empty((2, lanes), np.int64)

    def predict(self) -> None:
        """The two predicted ids and the ends of their shares, which come first; then order 0, in rest units."""
        np.add(self.row[0], (((self.p * np.uint32(0x85EBCA77)) ^ self.pp) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - H2), out=self.at[0])
        np.add(self.row[1], (self.p * np.uint32(0x9E3779B1)) >> np.uint32(32 - H1), out=self.at[1])
        e = self.table.take(self.at)
        self.sure = e & FIFTEEN
        self.k = self.level + self.sure
        self.w = self.right.take(self.k)
        self.guess = g = e >> FOUR
        u = (self.w * MOST) >> SIXTEEN
        end1 = u[0] + u[1]
        self.end2 = (u[0] + u[1] * (g[0] == g[1])) << SHIFT
        self.rest = np.uint32(1 << UNITS) - end1
        self.end1 = end1 << SHIFT

    def interval(self, ids: np.ndarray, which: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ids (which: the same as an index): the share of what predicts them, else their place in order 0."""
        at = classes * self.lanes
        at += self.lane
        low = self.flat.take(at) >> (FINE - SHARES)
        at += self.lanes
        wide = ((self.flat.take(at) >> (FINE - SHARES)) - low).view(np.uint32)
        wide *= self.rest
        start = self.counts.cum.take(which)
        start *= wide
        start += self.end1
        low = low.view(np.uint32) << SIXTEEN
        low *= self.rest
        start += low
        wide *= self.counts.freq.take(which)
        self.hit = self.guess == ids
        own = self.end1 - self.end2
        hit = self.hit[1] & (own > 0)
        np.copyto(start, self.end2, where=hit)
        np.copyto(wide, own, where=hit)
        hit = self.hit[0] & (self.end2 > 0)
        np.copyto(start, np.uint32(0), where=hit)
        np.copyto(wide, self.end2, where=hit)
        return start, wide

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids at v, places out of 2^TOTAL."""
        inner = (np.maximum(v, self.end1) - self.end1) // self.rest
        place = (inner >> SIXTEEN).view(np.int32)
        bounds = self.ends >> (FINE - SHARES)
        classes = np.zeros(self.lanes, np.int64)
        for end in bounds[1:-1]:
            classes += end <= place
        at = classes * self.lanes + self.lane
        bounds = bounds.reshape(-1)
        low = bounds.take(at)
        wide = (bounds.take(at + self.lanes) - low).view(np.uint32)
        out = self.counts.by_share.take((classes << WITHIN) + (inner - (low.view(np.uint32) << SIXTEEN)) // wide)
        np.copyto(out, self.guess[1], where=v < self.end1)
        np.copyto(out, self.guess[0], where=v < self.end2)
        return out

    def update(self, ids: np.ndarray, classes: np.ndarray) -> None:
        w, hit, sure = self.w, self.hit, self.sure
        sure += sure < FIFTEEN
        sure *= hit
        sure += ids << FOUR
        self.table[self.at] = sure
        self.right[self.k] = w - (w >> FOUR) + hit * HIT
        for i in range(1, CLASSES):
            end = self.ends[i]
            end -= end >> RATE
            end += (i * LEAST) >> RATE
            end += (classes < i) * np.int32(((1 << FINE) - CLASSES * LEAST) >> RATE)
        self.pp, self.p = self.p, ids


LOW32, FULL = U(0xFFFFFFFF), U(0xFFFFFFFFFFFFFFFF)


def _encode_lanes(grid: np.ndarray, counts: Counts) -> list[np.ndarray]:
    """Words (uint32) of each column of grid (uint32)."""
    steps, lanes = grid.shape
    m, low, rng = Mixer(lanes, counts), np.zeros(lanes, U), np.full(lanes, FULL)
    words, n = np.zeros((lanes, steps + 3), np.uint32), np.zeros(lanes, np.int64)
    for x in grid:
        which = x.astype(np.int64)
        classes = counts.classes.take(which)
        m.predict()
        start, size = m.interval(x, which, classes)
        r = rng >> U(TOTAL)
        add = r * start
        low += add
        if len(over := np.flatnonzero(low < add)):
            _carry(words, over, n[over] - 1)
        rng = r * size
        if len(at := np.flatnonzero(rng <= LOW32)):
            own = low[at]
            words[at, n[at]] = own >> U(32)
            low[at], rng[at] = own << U(32), rng[at] << U(32)
            n[at] += 1
        m.update(x, classes)
    for _ in range(2):
        words[m.lane, n] = low >> U(32)
        low <<= U(32)
        n += 1
    return [w[:k] for w, k in zip(words, n.tolist(), strict=True)]


def _carry(words: np.ndarray, lane: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the words at places at, and to those before them where it overflows."""
    while len(lane):
        words[lane, at] += np.uint32(1)
        on = words[lane, at] == 0
        lane, at = lane[on], at[on] - 1


def _decode_lanes(words: np.ndarray, at: np.ndarray, counts: Counts, steps: int) -> np.ndarray:
    """(steps, lanes) of ids, from words (as uint64) of which each lane's begin at at."""
    lanes = len(at)
    m, rng = Mixer(lanes, counts), np.full(lanes, FULL)
    code = (words[at] << U(32)) | words[at + 1]
    at = at + 2
    out = np.empty((steps, lanes), np.uint16)
    top = U((1 << TOTAL) - 1)
    for t in range(steps):
        m.predict()
        r = rng >> U(TOTAL)
        x = m.find(np.minimum(code // r, top).astype(np.uint32))
        which = x.astype(np.int64)
        classes = counts.classes.take(which)
        start, size = m.interval(x, which, classes)
        code -= r * start
        rng = r * size
        if len(i := np.flatnonzero(rng <= LOW32)):
            rng[i] <<= U(32)
            code[i] = (code[i] << U(32)) | words[np.minimum(at[i], len(words) - 1)]
            at[i] += 1
        m.update(x, classes)
        out[t] = x
    return out


def encode_blocks(ids: np.ndarray, counts: Counts, block: int) -> list[np.ndarray]:
    """Words (uint32) of each block of ids; what the last block lacks is filled up with its last id."""
    out: list[np.ndarray] = []
    for i in range(0, len(ids), block * LANES):
        own = ids[i : i + block * LANES]
        lanes = -(-len(own) // block)
        grid = np.concatenate([own, np.full(lanes * block - len(own), own[-1], own.dtype)]).reshape(lanes, block).T.astype(np.uint32, order="C")
        out.extend(_encode_lanes(grid, counts))
    return out


def decode_blocks(words: np.ndarray, sizes: np.ndarray, counts: Counts, block: int, n: int) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(U)
    return np.concatenate([np.empty(0, np.uint16), *(_decode_lanes(words, at[i : i + LANES], counts, block).T.reshape(-1) for i in range(0, len(sizes), LANES))])[:n]


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file: header, index of documents, order-0 counts, block table (words and crc32 of the ids of each), words."""
    block = max(1, min(block, len(ids)))
    own = Counts.of(ids)
    blocks = encode_blocks(ids, own, block)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 6)
    counts = own.packed()
    crcs = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    heads = np.array([[len(b), c] for b, c in zip(blocks, crcs, strict=True)], "<u4")
    body = index + counts + heads.tobytes()
    header = MAGIC + struct.pack("<QQIIII", len(doc_ids), len(ids), block, len(blocks), len(index), len(counts))
    return header + struct.pack("<I", zlib.crc32(header + body)) + body + np.concatenate(blocks).astype("<u4").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents, their sizes, and all ids; raises ValueError if any checksum differs."""
    docs, n, block, blocks, index, counts = struct.unpack_from("<QQIIII", raw, 8)
    at = 8 + 32
    (crc,) = struct.unpack_from("<I", raw, at)
    end = at + 4 + index + counts + 8 * blocks
    if raw[:8] != MAGIC or zlib.crc32(raw[:at] + raw[at + 4 : end]) != crc:
        raise ValueError("not a token file, or its head is damaged")
    at += 4
    head = zlib.decompress(raw[at : at + index])
    own = Counts.unpacked(raw[at + index : at + index + counts])
    heads = np.frombuffer(raw, "<u4", 2 * blocks, at + index + counts).reshape(-1, 2)
    ids = decode_blocks(np.frombuffer(raw, "<u4", offset=end), heads[:, 0].astype(np.int64), own, block, n)
    for k, i in enumerate(range(0, n, block)):
        if zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) != heads[k, 1]:
            raise ValueError(f"block {k} is damaged")
    return np.frombuffer(head, "<i8", docs), np.frombuffer(head, "<u4", docs, 8 * docs).astype(np.int64), ids


class Known(dict):
    """Ids of parts of texts as bytes, encoded when first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, part: str) -> bytes:
        self[part] = out = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u2").tobytes()
        return out


LETTERS = "a-zªµºß-öø-ÿ"
PARTS = re.compile(f"[{LETTERS}]+|[^ \n{LETTERS}]+")
LETTER = re.compile(f"[{LETTERS}]+")
#: Of Latin-1 in lower case: spaces and newlines, letters, others, and what ends a text.
GAP, WORD, OTHER, LAST = 0, 1, 2, 3
KIND = np.array([LAST if i == 0 else GAP if chr(i) in " \n" else WORD if LETTER.match(chr(i)) else OTHER for i in range(256)], np.uint8)
LOWER = bytes(ord(chr(i).lower()) for i in range(256))
#: The first so many bytes of a word of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Characters of texts taken together.
CHUNK = 500_000


def parts(text: str) -> list[str]:
    """Pieces of a text that this kind of vocabulary (lower case, tokens of letters, of single digits or of other marks) encodes each on its own: runs of letters and of other characters in lower case; where there are characters outside Latin-1, quotes (for their own endings) or what may be a special token, whatever stands between spaces and newlines."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    if "'" in text or "<|" in text:
        return text.replace("\n", " ").split(" ")
    return PARTS.findall(text.lower())


class Tokens:
    """A tokenizers file and the ids of parts that have come before: those of up to 16 bytes in a hash table by their bytes, looked up many at once."""

    BITS = 22

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer)
        self.closing = np.zeros(VOCABULARY, bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # Entries, the first of which is the id that ends a document: bytes (zeros for none and for long parts), where their ids start and how many they are.
        self.bytes, self.start, self.size, self.ids, self.n, self.used = np.zeros((1 << 16, 2), np.uint64), np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), np.full(1 << 18, END, "<u2"), 1, 1
        self.long: dict[str, int] = {}
        self.slots = np.full(1 << self.BITS, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys[:, 0] * U(0x9E3779B97F4A7C15) ^ keys[:, 1] * U(0xC2B2AE3D27D4EB4F)) * U(0xBF58476D1CE4E5B9) >> U(64 - self.BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys, or -1."""
        at = self._slot(keys)
        out = self.slots.take(at)
        on = np.flatnonzero((out >= 0) & (self.bytes[out] != keys).any(1))
        while len(on):
            at[on] = at[on] + 1 & (1 << self.BITS) - 1
            out[on] = self.slots[at[on]]
            on = on[(out[on] >= 0) & (self.bytes[out[on]] != keys[on]).any(1)]
        return out

    def _seat(self, entries: np.ndarray) -> None:
        at = self._slot(self.bytes[entries])
        while len(entries):
            free = np.flatnonzero(self.slots[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[won]] = entries[won]
            entries, at = np.delete(entries, won), np.delete(at, won)
            at = at + 1 & (1 << self.BITS) - 1

    def _add(self, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """New entries."""
        n, used = self.n + len(sizes), self.used + len(ids)
        if n > len(self.size):
            more = max(n, 2 * len(self.size)) - len(self.size)
            self.bytes = np.concatenate([self.bytes, np.zeros((more, 2), np.uint64)])
            self.start, self.size = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.size))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(used, 2 * len(self.ids)) - len(self.ids), "<u2")])
        self.bytes[self.n : n], self.size[self.n : n], self.start[self.n : n] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = ids
        out = np.arange(self.n, n)
        self.n, self.used = n, used
        return out

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, each of which is one word to the tokenizer, or of others, and how many each has."""
        if words and KIND[ord(words[0][0])] == WORD:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int64), np.fromiter(map(len, got), np.int64, len(got))

    def _latin(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids, with the end's, of texts in lower case and without quotes or zero bytes."""
        raw = b"\0".join([*texts, b"\0" * 16])
        b = np.frombuffer(raw, np.uint8)[: len(raw) - 16]
        kind = KIND[b]
        new = kind == LAST
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(b))
        kind = kind[start]
        own = kind != GAP
        start, size, kind = start[own], size[own], kind[own]
        keys = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 16)[start].view(np.uint64)
        keys &= FIRST[np.stack([np.minimum(size, 8), np.clip(size - 8, 0, 8)], 1)]
        last, long = kind == LAST, size > 16
        entry = self._find(keys)
        entry[last] = 0
        if len(at := np.flatnonzero(long | ((entry < 0) & ~last))):
            text = raw.decode("latin-1")
            words = [text[i : i + n] for i, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
            new_at = [k for k, w in enumerate(words) if len(w) <= 16 or w not in self.long]
            first = {words[k]: at[k] for k in new_at}
            numbers: dict[str, int] = {}
            for which in (WORD, OTHER):
                some = [w for w, k in first.items() if kind[k] == which]
                for i in range(0, len(some), 500):
                    now = some[i : i + 500]
                    longs = np.array([len(w) > 16 for w in now])
                    got = self._add(*self._encoded(now), np.where(longs[:, None], U(0), keys[[first[w] for w in now]]))
                    self._seat(got[~longs])
                    numbers.update(zip(now, got.tolist(), strict=True))
            self.long |= {w: k for w, k in numbers.items() if len(w) > 16}
            entry[at] = [numbers[w] if w in numbers else self.long[w] for w in words]
        sizes = self.size[entry]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[entry] - ends + sizes, sizes) + np.arange(ends[-1])]
        return np.split(ids, ends[last][:-1])

    def _keep_first(self) -> None:
        """A full cache keeps what came first, which is what is frequent."""
        if self.n > CACHED:
            self.n = CACHED // 3
            self.used = int(self.start[self.n - 1] + self.size[self.n - 1])
            self.long = {w: k for w, k in self.long.items() if k < self.n}
            self.slots[:] = -1
            self._seat(1 + np.flatnonzero(self.bytes[1 : self.n].any(1)))
        if len(self.known) > CACHED // 3:
            self.known.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the id that ends it."""
        out: list = [None] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (k, _), ids in zip(held, self._latin([t for _, t in held]), strict=True):
                out[k] = ids
            held.clear()
            self._keep_first()

        for k, t in enumerate(texts):
            try:
                raw = t.encode("latin-1").translate(LOWER)
            except UnicodeEncodeError:
                raw = None
            if raw is None or b"'" in raw or b"<|" in raw or b"\0" in raw:
                out[k] = np.frombuffer(b"".join(map(self.known.__getitem__, parts(t))) + ENDING, "<u2")
                continue
            held.append((k, raw))
            size += len(raw)
            if size >= CHUNK:
                flush()
                size = 0
        if held:
            flush()
        return out


ENDING = np.array([END], "<u2").tobytes()


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write_tokens(docs: DataFrame, folder: str, path: str, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs(doc_id, text) as token files in ascending order of doc_id (ties by text, null ids first, stored as -2^63) into folder; returns (part, seq, n_tokens) of the files, a written table. Each document ends with id 1; null text counts as empty, long texts are encoded whole, and each row of an id that repeats is a document. An empty table writes no files. Other columns are not read. A task that runs again writes the same bytes under the same names, by renaming a finished file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        t, (fs, root) = tokens(path), open_folder(folder)
        held: list = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, seq
            sizes = np.array([len(x) for _, x in held])
            raw = pack(np.array([d for d, _ in held], np.int64), sizes, np.concatenate([x for _, x in held]), block)
            name = f"{root}/part-{part:06d}-{seq:05d}.tok"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{name}.{attempt}.new") as f:
                f.write(raw)
            fs.move(f"{name}.{attempt}.new", name)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part]), "seq": pa.array([seq]), "n_tokens": pa.array([int(sizes.sum())]), "n_bytes": pa.array([len(raw)])})
            held.clear()
            size, seq = 0, seq + 1
            return out

        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                for d, ids in zip(c.column(0).to_pylist(), t.encode([x or "" for x in c.column(1).to_pylist()]), strict=True):
                    held.append((-(1 << 63) if d is None else d, ids))
                    size += len(ids)
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tasks = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // TASK_BYTES)
    return written(in_arrow(own.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text"), run, "part long, seq long, n_tokens long, n_bytes long"), "token_files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts all ids of documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = p.rsplit("/", 1)[-1]
                docs, sizes, ids = unpack(raw.as_py())
                ends = np.cumsum(sizes)
                all_ids = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(all_ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                part, seq = int(name[5:11]), int(name[12:17])
                none = docs == -(1 << 63)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(docs), part)), "seq": pa.array(np.full(len(docs), seq)), "doc_id": pa.array(docs, mask=none), "own": pa.array(ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crcs, pa.int64())})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    got = in_arrow(raw, run, "part long, seq long, doc_id long, own long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before(W.orderBy("part")).alias("of_part"))
    starts = files.select("part", "seq", F.col("n_tokens").alias("n")).withColumn("of_file", before(W.partitionBy("part").orderBy("seq"))).join(parts, "part")
    return got.join(starts, ["part", "seq"]).select("doc_id", (F.col("of_part") + F.col("of_file") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_file(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path(name))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, files)
