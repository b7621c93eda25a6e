"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metaloom.llm import html, languages, line_dedup, media, mixing, pieces, quality, simhash, tokenfile, topk
from metaloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line is long enough to be a key of its own."
TEXTS = [
    None, "", " ", "one", "One  TWO\tthree", LINE, f"a\n{LINE}\nb", f"{LINE.upper()} \nshort\nshort", f"  {LINE}\n{LINE}\n\n", "é É ß 日本語 😀", "<s> ▁ </s> it's <|endoftext|>",
    "word " * 4000, "x" * 20000, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(299)) + " changed", "RIFF BM GIF89a %PDF-1.4 PK\x03\x04", "No. No. No. No. No.", "tab\x0bvt\x0cff\r\n cr",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows + [(None, "no id", None, "a", 5), (3, "one", "en", "b", 3)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    got = [r for r in simhash.near_groups(docs).collect() if r.doc_id is not None]
    fp = {(r.doc_id, r.fp % (1 << 64)) for r in got}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    assert fp == {(d, slow_fingerprint(t)) for d, t in rows}
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    want = groups([(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 4], {d for d, _ in prints})
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_groups(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert {d for d in kept if d is not None} == set(want.values()) and None in kept


def test_covering_masks_cover_every_pair():
    r = np.random.default_rng(1)
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    for _ in range(3000):
        diff = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(m & diff == 0 for m in masks)


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_of_crowded_buckets(spark, dense):
    """A small limit deals most buckets out again; the components are the same."""
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 12)
    fps = {int(c) ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 4), replace=False)) for c in centres for _ in range(15)}
    nodes = [(f, i) for i, f in enumerate(sorted(fps))]
    links = simhash.near_links(spark.createDataFrame(nodes, "fp long, rep long"), dense=dense)
    got = {x.node: x.root for x in connected_components(links).collect()}
    want = groups([(j, i) for f, i in nodes for g, j in nodes if i > j and (f ^ g).bit_count() <= 4], [i for _, i in nodes])
    assert {i: got.get(i, i) for _, i in nodes} == want


def test_components_of_a_long_chain(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def slow_lines(rows):
    holders, key = defaultdict(set), lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20 and d is not None:
                holders[k].add(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return [(d, [x for x in (t or "").split("\n") if d is None or last.get(key(x), d) == d], len((t or "").split("\n"))) for d, t in rows]


def test_line_dedup(docs, empty, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = line_dedup.apply_bitmaps(docs, line_bitmaps := line_dedup.line_bitmaps(docs)).select("doc_id", "kept", F.size("lines").alias("n")).collect()
    assert sorted((str(r.doc_id), tuple(r.kept), r.n) for r in got) == sorted((str(d), tuple(k), n) for d, k, n in slow_lines(rows))
    assert line_bitmaps.where("doc_id is null").isEmpty()
    assert line_dedup.drop_lines(empty).count() == 0 and line_dedup.drop_lines(docs).columns == docs.columns
    assert {r.text for r in line_dedup.drop_lines(docs).where("doc_id is null").collect()} == {"no id"}


def test_lines_of_rows_that_share_an_id(spark, tmp_path):
    """Rows of one doc_id are one holder and keep the lines of their own text; the SQL agrees."""
    rows = [(1, f"{LINE}\nkeep a"), (1, "A unique first line only here.\nkeep b"), (1, f"{LINE}\nkeep a"), (2, LINE), (3, LINE), (3, LINE), (4, "twice in one document alone"), (4, "twice in one document alone"), (5, "twice in one document alone"), (None, LINE), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in line_dedup.drop_lines(docs).collect())
    assert got == sorted((str(d), "\n".join(k)) for d, k, _ in slow_lines(rows))
    assert ("1", "A unique first line only here.\nkeep b") in got and got.count(("1", "keep a")) == 2 and got.count(("4", rows[6][1])) == 2
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().sql(line_dedup.OP10_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect())


def test_mixing(docs, empty, spark):
    got = mixing.with_copies(docs).collect()
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    total = defaultdict(int)
    for r in got:
        assert r["size"] == size(r.text) and 0 <= r.copies <= 2
        total[r.source] += r["size"]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    assert {r.source: pytest.approx(r.target) for r in got} == target
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    for r in mixing.with_copies(many).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.15 * r.target
    assert mixing.mix(many).count() == mixing.with_copies(many).agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0


def test_quality(spark, docs, empty):
    texts = [("good words in a calm plain sentence number %d." % i, 1) if i % 2 else ("bad*** wor$$$ ds### num%%%%d &&&", 0) for i in range(400)]
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    w = quality.train(labelled)
    got = quality.score(labelled, w).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in got) > 390
    scored = quality.score(docs, w)
    assert scored.columns == [*docs.columns, "score"] and scored.where("score between 0 and 1").count() == docs.count()
    assert quality.score(empty, w).count() == 0
    none = quality.train(labelled.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_on_held_out_rows(spark, sf):
    got = quality.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_language_on_held_out_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    got = languages.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = languages.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[0].score == 0
    assert languages.identify(empty, model).count() == 0
    nothing = languages.fit(empty)
    assert {r.lang_pred for r in languages.identify(docs, nothing).collect()} == {"und"}
    a, b = (spark.read.parquet(f"{sf}/documents.parquet").where(f"lang = '{x}' and n_chars > 3000").first().text[:3000] for x in ("en", "de"))
    own, share = model.mixture(languages.trigrams(a + " " + b))
    assert {model.languages[k] for k in own} == {"en", "de"} and abs(share[0] - 0.5) < 0.1


def test_media_round_trip(docs, empty):
    for r in media.digests(media.sniffed(media.stored_texts(docs))).join(docs, "doc_id").where("doc_id <> 3").collect():
        raw = (r.text or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.feature.startswith("audio/wav")
    assert media.digests(media.sniffed(media.stored_texts(empty))).count() == 0


def test_sniffing(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02\x02\x4c\x01\x00\x3b"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    whole = {"image/png": png, "image/gif": gif, "image/bmp": bmp, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "audio/wav": media.wav(b"abc")}
    for kind, b in whole.items():
        assert media.sniff(b)[0] == (kind, 0, len(b)), kind
        assert (kind, 3, 3 + len(b)) in media.sniff(b"..." + b + b"!!"), kind
        assert not [x for x in media.sniff(b[:-3]) if x[0] == kind and kind != "application/gzip"], kind
    df = spark.createDataFrame([(1, "image/gif", bytearray(png)), (2, "text/plain", None), (3, "x", bytearray(media.wav(png)))], "id long, declared string, media binary")
    got = {r.id: r for r in media.sniffed(df).collect()}
    assert got[1].true_type == "image/png" and got[1].corrected and got[2].true_type is None
    assert [(e.type, bytes(e.content)) for e in got[3].embedded] == [("image/png", png)]


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = docs.where("doc_id is not null and doc_id <> 3")
    folder = f"file://{tmp_path}/tokens"
    files = tokenfile.write_tokens(own, folder, path, block=64, file_ids=500)
    assert files.count() > 3
    got, t, start = sorted(tokenfile.read_tokens(spark, folder, files).collect()), Tokenizer.from_file(path), 0
    for r, d in zip(got, sorted(own.collect(), key=lambda d: d.doc_id), strict=True):
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [1]
        assert r == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.write_tokens(empty, f"file://{tmp_path}/none", path).count() == 0


def test_tasks_of_token_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    """However many partitions the session makes, a task writes TASK_BYTES of text; the cut doesn't change what is read."""
    import public_tokenizers

    path, got = public_tokenizers.path("word_bpe_49k.json"), []
    own = spark.createDataFrame([(i, f"word{i} " * 200) for i in range(100)] + [(None, None)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size, least, most in ((tokenfile.TASK_BYTES, 1, 1), (20_000, 5, 8)):
            monkeypatch.setattr(tokenfile, "TASK_BYTES", size)
            files = tokenfile.write_tokens(own, f"file://{tmp_path}/{size}", path)
            assert least <= files.count() <= most
            got.append(sorted(tokenfile.read_tokens(spark, f"file://{tmp_path}/{size}", files).collect(), key=lambda r: r.start))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] and len(got[0]) == 101 and got[0][0].doc_id is None


def test_coder():
    r = np.random.default_rng(0)
    for x in (np.zeros(3000, np.uint16), r.integers(0, 1 << 16, 5000).astype(np.uint16), (r.zipf(1.3, 40_000) % 49_000).astype(np.uint16), np.array([7], np.uint16), np.tile(np.arange(50, dtype=np.uint16), 100)):
        raw = tokenfile.pack(np.array([5, 9]), np.array([len(x), 0]), x, 256)
        ids, sizes, back = tokenfile.unpack(raw)
        assert (back == x).all() and ids.tolist() == [5, 9] and sizes.tolist() == [len(x), 0]
    broken = bytearray(tokenfile.pack(np.array([1]), np.array([5000]), r.integers(0, 1 << 16, 5000).astype(np.uint16), 256))
    broken[len(broken) * 2 // 3] ^= 64
    with pytest.raises(ValueError):
        tokenfile.unpack(bytes(broken))
    words = np.array([[7, (1 << 32) - 1, (1 << 32) - 1, 0]], np.uint32)
    tokenfile._carry(words, np.array([0]), np.array([2]))
    assert words.tolist() == [[8, 0, 0, 0]]


def test_tokens_of_parts(monkeypatch):
    """Parts from the table, those too long or of other alphabets, and a cache that is full, against the tokenizer on whole texts."""
    import public_tokenizers

    monkeypatch.setattr(tokenfile, "CACHED", 300)
    monkeypatch.setattr(tokenfile, "CHUNK", 2000)
    t, r = tokenfile.Tokens(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(4)
    marks = "abcABC '’.,!12\t\n\r \x0b\xa0\x85éÉßµªº×÷ÿ<|>sx日本́\x00"
    for _ in range(40):
        texts = ["".join(a[i] for i in r.integers(0, len(a), r.integers(0, 60))) for a in (marks, marks[:-8].replace("'", "")) for _ in range(30)] + ["", "a" * 16, "a" * 17 + "." * 20, "\n"]
        for x, ids in zip(texts, t.encode(texts), strict=True):
            assert ids.tolist() == [*t.tokenizer.encode(x, add_special_tokens=False).ids, 1]


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(300)] + [(400 + i, [0.5] * 8) for i in range(40)]
    bad = [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("id") % 50 == 0).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    for q in (i for i in v if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q))[:5]
        assert sorted(got.pop(q)) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert not got
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert sorted(x.vec_id for x in few) == [1, 2]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_pieces():
    import sentencepiece

    path = pieces.model_path()
    m, sp = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in [x for x in TEXTS if x is not None] + ["  lead", "tail  ", "a▁b", "\n\n"]:
        if "▁" not in t:
            assert m.encode(t, 0.0, 1).tolist() == sp.encode(t)
        for seed in (1, 2):
            assert m.decode(m.encode(t, 0.3, seed)) == t
    long = " ".join(f"international{i}" for i in range(50))
    assert m.encode(long, 0.3, 1).tolist() == m.encode(long, 0.3, 1).tolist() != m.encode(long, 0.3, 2).tolist()


def test_pieces_in_frames(docs, empty):
    got = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.decoded == r.text for r in got) and len(got) == docs.count()
    assert pieces.encode(empty).count() == 0 and pieces.digests(docs).where("lossless").count() == docs.count()


PAGE = "<html><head><title>x</title><script>var a='<p>';</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>f</footer></body>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        (PAGE.format("<article><h1>T &amp; t</h1><p>One <b>bo</b>ld\n line<p>short<div class='ad'>buy</div><p>last</article><aside>side</aside>"), "T & t\nOne bold line\nshort\nlast"),
        (PAGE.format(f"<div class=cookie-notice>{'we use cookies ' * 20}</div><div><h2>Head</h2><p>{'real text here ' * 10}</p><p>brief</p></div><div id='comments'><p>{'nice post ' * 30}</p></div>"), "Head\n" + " ".join(["real text here"] * 10) + "\nbrief"),
        ("just text &lt;3 <!-- no --> more", "just text <3 more"),
        ("<p>a < b and c</p>", "a < b and c"),
        ("<article><header><h1>Title</h1></header><p>Body</p><form><input><p>form</p></form><article class=comment><p>reader</p></article></article>", "Title\nBody"),
    ],
)
def test_html(page, want):
    assert html.extract(page) == want


def test_html_frames(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>é", "x"), (2, None, "<article><p>é", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html.main_text(pages).collect()) == ["", "é", "é"]
    assert html.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage against what the operators' brute force says of its own input."""
    import corpus_pipeline as cp

    from .test_shingles import slow_groups as similar

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.written(stage(spark, docs, sf), "test_stage")
        kept[name] = (before, docs)
    a, b = kept["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    left = b.join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in left}
    of = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert n.get(0, 0) < 0.05 * of[0] and n[1] > 0.95 * of[1]
    a, b = kept["line dedup"]
    want = {(d, "\n".join(k)) for d, k, _ in slow_lines([(r.doc_id, r.text) for r in a.collect()])}
    assert {(r.doc_id, r.text) for r in b.collect()} == want
    a, b = kept["near duplicates"]
    want = similar([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == set(want.values())
    a, b = kept["mixture"]
    copies = {r.doc_id: r.copies for r in mixing.with_copies(a).collect()}
    n = {r.doc_id: r["count"] for r in b.groupBy("doc_id").count().collect()}
    assert {d: k for d, k in copies.items() if k} == n
    a, b = kept["pieces"]
    texts = {r.doc_id: r.text for r in a.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in pieces.decode(b).collect())
