"""Media columns: Aho-Corasick finds magic bytes, validators confirm structure and lengths; declared types are corrected and embedded media carved out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import columns, in_arrow, table

WAV, UNKNOWN = "audio/wav", "application/octet-stream"
PAYLOAD = 576


def _u32(b: bytes, i: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", b, i)[0]


def _riff(b: bytes, o: int) -> tuple[str, int] | None:
    end = o + 8 + _u32(b, o + 4)
    kind = {b"WAVE": WAV, b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[o + 8 : o + 12])
    if not kind or end > len(b):
        return None
    at, seen = o + 12, set()
    while at + 8 <= end:
        seen.add(b[at : at + 4])
        at += 8 + _u32(b, at + 4)
        at += (at - o) % 2
    return (kind, end) if at in (end, end + 1) and (kind != WAV or {b"fmt ", b"data"} <= seen) else None


def _png(b: bytes, o: int) -> tuple[str, int] | None:
    at = o + 8
    while at + 12 <= len(b):
        n, kind = _u32(b, at, ">"), b[at + 4 : at + 8]
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != _u32(b, at + 8 + n, ">") or (at == o + 8 and kind != b"IHDR"):
            return None
        at += 12 + n
        if kind == b"IEND":
            return "image/png", at
    return None


def _jpeg(b: bytes, o: int) -> tuple[str, int] | None:
    at = o + 2
    while b[at] == 0xFF:
        kind = b[at + 1]
        if kind == 0xD9:
            return "image/jpeg", at + 2
        if kind in (0x00, 0xFF, 0xD8) or 0xD0 <= kind <= 0xD7:
            return None
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        at += 2 + n
        if kind == 0xDA:
            while (at := b.find(b"\xff", at)) >= 0 and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
    return None


def _bmp(b: bytes, o: int) -> tuple[str, int] | None:
    size, reserved, start, header = struct.unpack_from("<IIII", b, o + 2)
    good = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= size and o + size <= len(b)
    return ("image/bmp", o + size) if good else None


class Marks(dict):
    """Where in some bytes the marks lie that formats end or go on with, found in one pass; what follows from them is worked out once for all starts."""

    def __init__(self, b: bytes, found: dict[bytes, list[int]]):
        super().__init__(found)
        self.b = b

    def after(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or the end of the bytes."""
        own = self[mark]
        k = bisect_left(own, at)
        return own[k] if k < len(own) else len(self.b)

    @cached_property
    def pdf_ends(self) -> list[int]:
        """Of each %%EOF the last one that no other document's start lies before."""
        ends = list(self[b"%%EOF"])
        for k in range(len(ends) - 2, -1, -1):
            if self.after(b"%PDF-", ends[k]) > ends[k + 1]:
                ends[k] = ends[k + 1]
        return ends

    @cached_property
    def zips(self) -> dict[int, int]:
        """Start -> end of the archives that an end record names."""
        out = {}
        for at in self[b"PK\x05\x06"]:
            if at + 22 <= len(self.b):
                size, start, note = struct.unpack_from("<IIH", self.b, at + 12)
                o = at - start - size
                if o >= 0 and self.b[o + start : o + start + 4] == b"PK\x01\x02" and at + 22 + note <= len(self.b):
                    out[o] = at + 22 + note
        return out

    @cached_property
    def oggs(self) -> dict[int, int]:
        """Start -> end of runs of whole pages up to one that is marked as last."""
        out: dict[int, int] = {}
        for at in reversed(self[b"OggS"]):
            if at + 27 <= len(self.b):
                n = self.b[at + 26]
                end = at + 27 + n + sum(self.b[at + 27 : at + 27 + n])
                if end <= len(self.b) and (end if self.b[at + 5] & 4 else end in out):
                    out[at] = end if self.b[at + 5] & 4 else out[end]
        return out


    def gif_end(self, at: int) -> int | None:
        """The end of the GIF whose blocks go on at a place, or None; each place of a block or a sub-block is walked through once, whatever start it is reached from."""
        known, path, inside, end = self.gif_known, [], False, None
        b = self.b
        while (at, inside) not in known:
            path.append((at, inside))
            if at >= len(b):
                break
            mark = b[at]
            if inside:
                inside, at = mark > 0, at + mark + 1
            elif mark == 0x3B:
                end = at + 1
                break
            elif mark == 0x21:
                inside, at = True, at + 2
            elif mark == 0x2C and at + 9 < len(b):
                inside, at = True, at + 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 128 else 0)
            else:
                break
        else:
            end = known[at, inside]
        known.update(dict.fromkeys(path, end))
        return end

    @cached_property
    def gif_known(self) -> dict[tuple[int, bool], int | None]:
        return {}


def _gif(b: bytes, o: int, marks: Marks) -> tuple[str, int] | None:
    flags = b[o + 10]
    end = marks.gif_end(o + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
    return ("image/gif", end) if end else None


def _pdf(b: bytes, o: int, marks: Marks) -> tuple[str, int] | None:
    if not b[o + 5 : o + 6].isdigit() or b[o + 6 : o + 7] != b".":
        return None
    ends = marks[b"%%EOF"]
    k = bisect_left(ends, o)
    if k == len(ends) or marks.after(b" obj", o) > ends[k] or marks.after(b"startxref", o) > ends[k]:
        return None
    return "application/pdf", marks.pdf_ends[k] + 5


def _zip(b: bytes, o: int, marks: Marks) -> tuple[str, int] | None:
    return ("application/zip", marks.zips[o]) if o in marks.zips else None


def _gzip(b: bytes, o: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        at = o
        while not d.eof and at < len(b):
            step = d.unconsumed_tail or b[at : at + 65536]
            at += 0 if d.unconsumed_tail else len(step)
            d.decompress(step, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", at - len(d.unused_data)) if d.eof else None


def _ogg(b: bytes, o: int, marks: Marks) -> tuple[str, int] | None:
    return ("audio/ogg", marks.oggs[o]) if o in marks.oggs else None


def _mp4(b: bytes, o: int) -> tuple[str, int] | None:
    at, seen = o, set()
    while at + 8 <= len(b) and b[at + 4 : at + 8].isalnum():
        n, head = _u32(b, at, ">"), 8
        if n == 1:  # the size follows, in 64 bits
            n, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        elif n == 0:  # up to the end
            n = len(b) - at
        if n < head or at + n > len(b) or (at > o and b[at + 4 : at + 8] == b"ftyp"):
            break
        seen.add(b[at + 4 : at + 8])
        at += n
    return ("video/mp4", at) if b"moov" in seen else None


#: Magic bytes, how far they lie from the start, and the validator: (bytes, start), and the marks if it asks for them -> (type, end), or None.
FORMATS: list[tuple[bytes, int, Callable]] = [
    (b"RIFF", 0, _riff), (b"\x89PNG\r\n\x1a\n", 0, _png), (b"GIF87a", 0, _gif), (b"GIF89a", 0, _gif), (b"\xff\xd8\xff", 0, _jpeg), (b"BM", 0, _bmp),
    (b"%PDF-", 0, _pdf), (b"PK\x03\x04", 0, _zip), (b"\x1f\x8b\x08", 0, _gzip), (b"OggS", 0, _ogg), (b"ftyp", 4, _mp4),
]
ASK_MARKS = {_gif, _pdf, _zip, _ogg}
MARKS = [b"%PDF-", b"%%EOF", b" obj", b"startxref", b"PK\x05\x06", b"OggS"]


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = [m for m, _, _ in FORMATS]
    for w in dict.fromkeys(words + MARKS):
        a.add_word(w.decode("latin-1"), (w, words.index(w) if w in words else -1, w in MARKS))
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of all media confirmed in b, in order of start; those inside others too. Of several starts of one type that share an end, the first is the medium's."""
    starts, marks = [], Marks(b, {m: [] for m in MARKS})
    for last, (word, k, mark) in _automaton().iter(b.decode("latin-1")):
        if mark:
            marks[word].append(last + 1 - len(word))
        if k >= 0:
            starts.append((last + 1 - len(word) - FORMATS[k][1], k))
    found: dict[tuple[str, int], int] = {}
    for o, k in starts:
        check = FORMATS[k][2]
        try:
            got = (check(b, o, marks) if check in ASK_MARKS else check(b, o)) if o >= 0 else None
        except (IndexError, struct.error):
            got = None
        if got:
            found[got] = min(o, found.get(got, o))
    return sorted(((kind, o, end) for (kind, end), o in found.items()), key=lambda x: (x[1], -x[2], x[0]))


def sniffed(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """Adds true_type, corrected (it isn't the declared type) and embedded (array of type, start, content) to df, one row for each row. true_type is of media that starts the bytes, else (and for empty bytes) application/octet-stream; null bytes give null, not corrected and nothing embedded; a null declared type is corrected. Each embedded item is carved out whole. Other columns pass through; columns of the added names are replaced; an empty table gives no rows."""
    added = ("true_type", "corrected", "embedded")
    kept = [f for f in df.schema if f.name.lower() not in added]
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("content", pa.binary())])
    own = df.select(*(c for f, c in zip(df.schema, columns(df), strict=True) if f in kept), F.col(media_col).alias("_1"), F.col(declared_col).alias("_2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types, fixed, inner = [], [], []
            for m, d in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                raw = m.as_py()
                got = sniff(raw) if raw is not None else []
                first = got[0] if got and got[0][1] == 0 else None
                types.append(None if raw is None else first[0] if first else UNKNOWN)
                fixed.append(types[-1] is not None and types[-1] != d.as_py())
                inner.append([{"type": t, "start": i, "content": raw[i:j]} for t, i, j in got if (t, i, j) != first])
            cols = [pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(inner, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], [*b.schema.names[:-2], *added])

    inside = StructType().add("type", "string").add("start", "long").add("content", "binary")
    return in_arrow(own, run, StructType([*kept, *StructType().add("true_type", "string").add("corrected", "boolean").add("embedded", ArrayType(inside))]))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples as a RIFF file."""
    odd = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def samples(b: bytes) -> bytes:
    """The data chunk of a RIFF WAVE file."""
    at = 12
    while b[at : at + 4] != b"data":
        at += 8 + _u32(b, at + 4)
        at += at % 2
    return b[at + 8 : at + 8 + _u32(b, at + 4)]


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each whole text (null: empty) as the samples of a WAV file, filled up with 255 to a positive multiple of 576; it is declared without a type. One row for each row, repeats and null ids included; an empty table gives none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
            media = [wav(x + b"\xff" * (-len(x) % PAYLOAD or PAYLOAD * (not x))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, declared string, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """What op3 returns of each stored file, read back; feature: true type, sample count, mean, deviation, level crossings, and what is embedded. Equal media give equal values; one row for each row, none for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "media", "true_type", "embedded"]
        for b in batches:
            out: list = [[] for _ in range(6)]
            doc, n, media, kind, inner = (b.column(b.schema.get_field_index(x)) for x in names)
            for m, t, e in zip(media, kind, inner, strict=True):
                whole = m.as_py()
                got = samples(whole)
                x = np.frombuffer(got, np.uint8)
                feature = f"{t.as_py()} n={len(x)} mean={x.mean():.4f} sd={x.std():.4f} crossings={np.count_nonzero(np.diff(x > 96))} embedded={','.join(sorted(i['type'] for i in e.as_py())) or 'none'}"
                for k, v in enumerate((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([doc, n, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return in_arrow(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sniffed(stored_texts(table(spark, sf_dir, "documents", "doc_id", "text"))))
