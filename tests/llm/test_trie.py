"""The prefix trie against a plain one, on small tables with nulls, ties, repeats, gaps and long conversations."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import trie
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, k long, depth string"


def table_of(seed, n, spark):
    """Conversations of a few roles and texts, so that many share beginnings; some ids are missing, one conversation is long and so are its copies."""
    draw = np.random.default_rng(seed)
    rows = []
    for c in draw.choice(np.arange(-6, 3 * n), n, replace=False).tolist():
        for t in range(int(draw.integers(1, 14))):
            rows.append((c, [t, None, t // 2][int(draw.integers(0, 3))] if draw.random() < 0.1 else t, ["user", "assistant", None][int(draw.integers(0, 3))] if draw.random() < 0.2 else ["user", "assistant"][t % 2], [None, "", "é" * 3, "a"][int(draw.integers(0, 4))] if t > 2 else ["hi", "ho", ""][int(draw.integers(0, 3)) % (t + 1)], t, "x"))
    rows += [(c, t, "user", f"turn {t}", 0, None) for c in (1000, 1001, 1002, 1005) for t in range(60)]
    rows += [(2000 + c, 0, "user", "same", 0, None) for c in range(40)] + [(None, 0, "user", "lost", 0, None), *rows[:5]]
    return spark.createDataFrame(rows, TURNS).repartition(3)


def plain(rows, group=5, most=9):
    convs: dict = {}
    for r in rows:
        if r.conv_id is not None:
            convs.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = int(c - np.fmod(c, group))
        paths[c] = turns.get(base, [])[:h] + own[h:]
    nodes: dict = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    children: dict = {}
    for x in nodes:
        if x:
            children.setdefault(x[:-1], []).append(x)
    sums: dict = {}
    for x in sorted(nodes, key=len, reverse=True):
        below = [sums[y] for y in children.get(x, [])]
        sums[x] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + ((len(nodes[x]) - 1) * len(x[-1][1].encode()) if x else 0))
    ends = lambda x: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[x] if len(paths[c]) == len(x)))).encode()).hexdigest()
    return sorted((min(m), len(x), min(nodes[x[:-1]]) if x else None, len(m), len(children.get(x, [])), *sums[x], ends(x)) for x, m in nodes.items())


def trie_of(df):
    return trie.prefix_trie(*trie.rebuilt(trie.ranked_turns(df)))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    df = table_of(seed, 60 * seed, spark)
    got = trie_of(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain(df.collect())


def test_small_tables(spark):
    assert trie_of(spark.createDataFrame([], TURNS)).count() == 0
    # 7 has no base and hides its own turn behind the shared ones: a turnless conversation, the root's only member
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    one = spark.createDataFrame([(c, 0, "user", "x", 0, "")], TURNS)
    assert [tuple(r) for r in trie_of(one).collect()] == plain(one.collect()) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_running_splits_groups_over_ranges(spark):
    df = spark.createDataFrame([(i % 2 if i > 900 else 0, i) for i in range(1000)], "g long, i long")
    got = trie.running(df.repartition(5), "g", [F.col("i")], [F.col("i")], n=(F.lit(1), "sum"), x=(F.col("i"), "bit_xor")).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: r.i):
        n, x = seen.get(r.g, (0, 0))
        seen[r.g] = (n + 1, x ^ r.i)
        assert (r.n, r.x) == seen[r.g]
    assert len(got) == 1000


def test_long_id_lists_are_hashed_in_chunks(spark, monkeypatch):
    ends = spark.range(0, 30000).select(F.lit(2).cast("long").alias("depth"), (F.col("id") % 3 % 2).alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("id").alias("conv_id"))
    for r in trie._hashed_ends(ends).collect():
        assert r.ends_sha256 == hashlib.sha256(",".join(str(i) for i in range(30000) if i % 3 % 2 == r.hi).encode()).hexdigest()


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = c.sql(trie.OP12_SQL)
    got = trie.op12_prefix_trie(spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[n] for n in rel.columns) for r in got.collect()), key=key) == sorted(rel.fetchall(), key=key)
