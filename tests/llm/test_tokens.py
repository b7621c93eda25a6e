"""Token alignment and packing against plain versions over each whole text."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaloom.llm import alignment, packing, units

TEXTS = [
    None, "", " ", "\n", "one", " one", "\nOne two  three\n\n four \n five\tsix\x0b\x0cseven\r\neight ", "it's We'LL <|endoftext|> <s></s> <0x41>", "x<|endoftext|>y \n<|endoftext|>", "▁ has ▁ marks", "é É ß 日本語 😀  wide space　x \x1c! \x1f ?",
    "word " * 3000, "x" * 9000, "Ўзбек мова ελληνικά " * 50, " ".join(f"w{i}" for i in range(1500)), "end \n \n", "a\x00b", "tab\t\n x", "one", "word,word.word;(word)\n" * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "k") for i, t in enumerate(TEXTS * 2)] + [(None, "no id", 0, None), (4, "one", 0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, block long, pairs string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(alignment.A_NAME))


@pytest.fixture(scope="module")
def plain(tokenizer):
    """Of a text: its tokens of both vocabularies and their bytes, over the whole text; None where they don't give it back."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_NAME))
    a_bytes, b_bytes = units.byte_bpe(alignment.A_NAME, False).bytes, units.piece_model(alignment.B_NAME).bytes

    def run(text):
        if not text:
            return None
        tokenizer.encode_special_tokens = True
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        got = [[a_bytes[i] for i in a], [b_bytes[i] for i in b]]
        return (a, b, *got) if all(b"".join(x) == (" " + text).encode() for x in got) else None

    return run


def spans(raw):
    ends = np.cumsum([len(x) for x in raw]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def overlaps(a, b):
    return [(i, j, min(t, v) - max(s, u)) for i, (s, t) in enumerate(a) for j, (u, v) in enumerate(b) if min(t, v) > max(s, u)]


def test_alignment(docs, empty, plain):
    counts, want = Counter(), []
    for r in docs.collect():
        x = plain(r.text)
        if x is None:
            want.append((r.doc_id, 0, 0, 0, [], ""))
            continue
        a, b, sa, sb = x[0], x[1], spans(x[2]), spans(x[3])
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([i for i, (_, e) in zip(a, sa, strict=True) if lo < e <= hi], [i for i, (_, e) in zip(b, sb, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)] if len(ends) < 500 else None
        links, at = [], [0, 0]
        while at[0] < len(a) and at[1] < len(b):  # overlapping tokens in step, as a pair of fingers
            links.append((a[at[0]], b[at[1]]))
            ea, eb = sa[at[0]][1], sb[at[1]][1]
            at = [at[0] + (ea <= eb), at[1] + (eb <= ea)]
        counts.update(links)
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups) if groups else None
        want.append((r.doc_id, len(a), len(b), len(ends), links, text))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    key = lambda r: tuple(map(str, r))
    full = sorted(((d, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), None if t is None else hashlib.sha256(t.encode()).hexdigest() if t else "") for d, na, nb, ng, ls, t in want), key=lambda r: key(r[:7]))
    got = sorted((tuple(r) for r in alignment.alignments(docs).collect()), key=lambda r: key(r[:7]))
    assert [r[:7] for r in got] == [r[:7] for r in full]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, full, strict=True))
    assert sum(r[1] == 0 for r in got) > 4 and alignment.alignments(empty).count() == 0


def test_links_are_overlaps_and_groups(docs, empty, plain):
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 400)
    for kind in ("overlap", "group"):
        for r, text in ((r, TEXTS[r.doc_id % len(TEXTS)]) for r in alignment.token_links(few.where("doc_id <> 4"), kind).collect()):
            x = plain(text)
            if x is None:
                assert not r.links and not r.a_ids
                continue
            sa, sb = spans(x[2]), spans(x[3])
            assert (r.a_ids, r.b_ids, r.a_ends, r.b_ends) == (x[0], x[1], [e for _, e in sa], [e for _, e in sb])
            cuts = sorted({e for _, e in sa} & {e for _, e in sb})
            group = lambda e, cuts=cuts: next(k for k, c in enumerate(cuts) if e <= c)
            want = overlaps(sa, sb) if kind == "overlap" else [(i, j, 1) for i, (_, e) in enumerate(sa) for j, (_, f) in enumerate(sb) if group(e) == group(f)]
            assert sorted((x.a, x.b, x.weight) for x in r.links) == want
    assert alignment.token_links(empty).count() == 0
    with pytest.raises(ValueError, match="kind"):
        alignment.token_links(empty, "other")


def test_product_is_the_matrix_product():
    draw = np.random.default_rng(3)
    for slab in (1, 7, 1 << 20):
        for n, k, m in ((1, 1, 1), (5, 4, 6), (30, 40, 20), (0, 3, 2), (3, 2, 0)):
            dense = [(draw.random(s) < 0.3) * draw.integers(1, 4, s) for s in ((n, k), (k, m))]
            a, b = (alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(1))]), np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense)
            c = alignment.product(a, b, slab)
            got = np.zeros((n, m), int)
            got[c.rows, c.indices] = c.values
            assert (got == dense[0] @ dense[1]).all()
            back = a.transposed().transposed()
            assert all((x == y).all() for x, y in ((a.indptr, back.indptr), (a.indices, back.indices), (a.values, back.values)))


def test_blocks_keep_rows_and_size():
    b = pa.RecordBatch.from_pydict({"k": pa.array(range(6)), "t": pa.array(["a" * n if n is not None else None for n in (3, None, 9, 2, 30, 1)])})
    got = list(units.blocks(iter([b, b]), 1, 10))
    assert [x for t in got for x in t.column(0).to_pylist()] == [*range(6)] * 2
    assert all(sum(len(x or "") for x in t.column(1).to_pylist()) <= 10 or t.num_rows == 1 for t in got)


def test_cut_pieces(docs, empty, tokenizer):
    want = []
    for r in docs.collect():
        tokenizer.encode_special_tokens = False
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        starts = [0, *range(len(ids) % 64 or 64, len(ids), 64)] if len(ids) > 64 else [0]
        want += [(str(r.doc_id), k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    got = packing.cut_pieces(docs, size=64).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.uid for r in got}) == len(got) and packing.cut_pieces(empty).count() == 0


def check_places(rows, size):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        ends = np.cumsum([n for _, n in sorted(places)]).tolist()
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= size
    return len(at)


@pytest.mark.parametrize("shard", [60, 10_000])
def test_pack(docs, empty, shard):
    pieces = packing.cut_pieces(docs, size=256, ids=True)
    placed = packing.pack_pieces(pieces, 256, shard)
    rows = placed.collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted(tuple(r) for r in pieces.collect())
    n, least = check_places(rows, 256), -(-sum(r.length for r in rows) // 256)
    assert n <= least + (1 if shard > 60 else 6)
    by_uid = {r.uid: bytes(r.ids) for r in rows}
    for s in packing.sequences(placed).collect():
        assert bytes(s.ids) == b"".join(by_uid[u] for u in s.uids) and len(s.ids) == 4 * s.n_tokens
    assert packing.pack_pieces(packing.cut_pieces(empty)).count() == 0


def test_pack_in_rounds_comes_near_the_least(spark):
    draw = np.random.default_rng(5)
    lengths = draw.integers(1, 2049, 3000).tolist() + [700] * 1500
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long")
    rows = packing.pack_pieces(pieces, shard=600).collect()
    assert sorted(r.uid for r in rows) == list(range(4500))
    assert check_places(rows, 2048) <= 1.02 * len(packing.best_fit(np.sort(lengths)[::-1], 2048))


def test_sum_of_squares_takes_the_smallest_sum():
    """Each step of the rule against all places that a piece could go to."""
    draw = np.random.default_rng(7)
    for _ in range(20):
        size = int(draw.integers(2, 40))
        sizes = draw.integers(1, size + 1, 60)
        where = {i: k for k, x in enumerate(packing.sum_of_squares(sizes, size)) for i in x}
        gaps: dict[int, int] = {}
        score = lambda g: sum(n * n for x, n in Counter(g.values()).items() if x)
        for i, s in enumerate(sizes.tolist()):
            could = [score({**gaps, k: g - s}) for k, g in [*gaps.items(), (-1, size)] if g >= s]
            gaps[where[i]] = gaps.get(where[i], size) - s
            assert gaps[where[i]] >= 0 and score(gaps) == min(could)
