"""Texts as units that tokenizers cut independently: a word with the white space before it. The distinct units of many texts are cut once.

A unit starts before a space or newline that follows a character that isn't white space. Pre-tokenizers of the byte-level kind always cut there, for none of their patterns reaches from other characters into white space, and no piece of the sentence-piece models holds a newline, or a space behind another character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are worked on together; a longer text is worked on alone.
BLOCK_BYTES = 12 << 20
#: Distinct units whose ids a worker remembers; when there are more, it starts anew.
REMEMBERED = 500_000
# White space besides space and newline, in any of the tokenizers' views.
OTHER_SPACE = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts in which white space meets white space, which are split by BOUNDARY; all others at single spaces and newlines.
ODD = rf"\A[ \n]|[ \n][ \n]|[{OTHER_SPACE}]"
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
SPECIAL = "<|endoftext|>"


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of the batches again, in tables of at most size bytes of text each, or of one row."""
    held, n = [], 0
    for b in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0))
        at = 0
        while at < b.num_rows:
            ends = np.cumsum(lengths[at:])
            k = int(np.searchsorted(ends, size - n, side="right"))
            if k == 0 and not held:
                k = 1
            if k:
                held.append(b.slice(at, k))
                n += int(ends[k - 1])
                at += k
            if at < b.num_rows or n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def natural(key: str) -> str:
    """A unit as it stands in the text: keys leave out a single space in front."""
    return key if key[:1] in ("\n", " ") else " " + key


def _key(unit: str) -> str:
    return unit[1:] if unit[0] == " " and unit[1:2] not in ("\n", " ") else unit


def split_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of texts without nulls, each with a space put before it: (rows, ends, indices, keys): the texts' order here, where the units of each end, each unit as an index, and the distinct units' keys."""
    odd = np.asarray(pc.match_substring_regex(texts, ODD))
    rows = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    even = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    slow = [[_key(u) for u in BOUNDARY.split(" " + t)] for t in texts.filter(pa.array(odd)).to_pylist()]
    sizes = np.concatenate([np.asarray(pc.list_value_length(even), np.int64), np.array([len(s) for s in slow], np.int64)])
    values = [even.flatten(), *([pa.array([k for s in slow for k in s], pa.string())] if slow else [])]
    coded = pa.chunked_array(values).combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
    return rows, np.cumsum(sizes), np.asarray(coded.indices), coded.dictionary.to_pylist()


class ByteBpe:
    """A tokenizer's byte-level vocabulary. Units without special strings or rare scripts are cut by the same vocabulary as ranks; others by the tokenizer itself."""

    def __init__(self, name: str, special: bool):
        """special: whether strings of special tokens in texts are those tokens."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = not special
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.bytes = [b""] * self.size
        for raw, i in ranks.items():
            self.bytes[i] = raw
        self.bytes[self.size - 1] = SPECIAL.encode()
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def cut(self, unit: str) -> list[int]:
        if SPECIAL not in unit and (unit.isascii() or max(unit) < "\u0500"):
            return self.fast.encode_ordinary(unit)
        return self.tokenizer.encode(unit, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece model with byte fallback, which puts a space before each text."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size, self.space = self.model.get_piece_size(), self.model.piece_to_id("▁")
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("\n" in n or re.search("[^▁]▁", n) for n in names):
            raise ValueError(f"{name} has pieces that reach over units")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def cut_all(self, units: list[str]) -> list[list[int]]:
        """A unit that begins with a space is given without it; before a newline the model's own space is a piece by itself. The model puts none before an empty text."""
        got = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.space] if u == " " else x if u[0] == " " else x[1:] for u, x in zip(units, got, strict=True)]


@cache
def byte_bpe(name: str, special: bool) -> ByteBpe:
    return ByteBpe(name, special)


@cache
def piece_model(name: str) -> Pieces:
    return Pieces(name)


def lookup(keys: list[str], known: dict, cut, most: int = REMEMBERED) -> list:
    """What is known of each key, or else what cut gives for the list of those that aren't."""
    new = [k for k in keys if k not in known]
    if new:
        if len(known) + len(new) > most:
            known.clear()
            new = keys
        known.update(zip(new, cut([natural(k) for k in new]), strict=True))
    return [known[k] for k in keys]
