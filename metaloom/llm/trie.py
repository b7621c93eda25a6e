"""Conversation prefix trie: conversations are grouped by digests of blocks of turns first, and turn by turn only inside blocks where siblings diverge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_crc, in_arrow, table, written

#: Turns of a block.
BLOCK = 4
#: Characters of ids that are joined before they are hashed.
CHUNK = 1 << 16
NODE = ["depth", "hi", "lo"]
ENDS = ["k", "start_hi", "start_lo", "hi", "lo", "depth"]


def running(df: DataFrame, group: str, order: list[Column], near: list[Column], **totals: tuple[Column, str]) -> DataFrame:
    """Adds, for each name, what its column comes to (sum or bit_xor) over the rows of the group up to and with this one, by order. Rows are dealt by ranges of group and near, a prefix of order: each range adds up its own, and starts from what the ranges before it come to, so that no group is one task's."""
    parts = written(df.repartitionByRange(F.col(group), *near).withColumn("_part", F.spark_partition_id()), "ranges")
    own, over = W.partitionBy("_part", group), W.partitionBy("_group").orderBy("_of")
    total = {"sum": F.sum, "bit_xor": F.bit_xor}
    sums = parts.groupBy("_part", group).agg(*[total[how](c).alias(n) for n, (c, how) in totals.items()])
    sums = sums.select(F.col("_part").alias("_of"), F.col(group).alias("_group"), *totals)
    before = sums.select("_of", "_group", *[F.coalesce(total[how](n).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}") for n, (_, how) in totals.items()])
    upto = own.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = parts.select("*", *[total[how](c).over(upto).alias(n) for n, (c, how) in totals.items()])
    joined = rows.join(before, (F.col("_part") == F.col("_of")) & (F.col(group) == F.col("_group")))
    add = lambda n, how: F.col(n) + F.col(f"_{n}") if how == "sum" else F.col(n).bitwiseXOR(F.col(f"_{n}"))
    return joined.select(*df.columns, *[add(n, how).alias(n) for n, (_, how) in totals.items()])


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, rank, a, b, bytes): turns numbered from 1 by (turn, role, text), nulls first, null roles and texts as empty ones; a and b are independent hashes of role and text, bytes the text's UTF-8 length. Rows without a conv_id are no turns."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    got = running(rows, "conv_id", order, [order[0], F.substring("role", 1, 16), F.substring("text", 1, 64)], rank=(F.lit(1), "sum"))
    hashed = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    return got.select("conv_id", "rank", hashed(1).alias("a"), hashed(2).alias("b"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Ranked turns with beginnings shared between conversations, and (conv_id, length) of each conversation, turnless ones included: conversation c gets the first h turns of c - c % group for its own first h, where h is the crc32 of c's decimal digits modulo most."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (id_crc(F.col("conv_id")) % most).alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = own.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = written(own.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    kept = turns.join(own.select("conv_id", "h", "m", "length"), "conv_id").where("rank > h").withColumn("depth", F.col("m") + F.col("rank") - F.col("h"))
    heads = turns.where(F.col("rank") < most).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "a", "b", "bytes")
    heads = own.where("m > 0").select("conv_id", "base", "h", "length").join(heads, "base").where("depth <= h")
    cols = ["conv_id", "depth", "length", "a", "b", "bytes"]
    return kept.select(*cols).unionByName(heads.select(*cols)), own.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Of each turn the digest (hi, lo) of all turns up to it, and (from_hi, from_lo) of those before it; bytes_to and its own bytes; its block k. A digest is the xor of hashes of (depth, role, text), so that ranges of turns are digested on their own."""
    keyed = turns.select("*", *[F.xxhash64(F.lit(seed), "depth", "a", "b").alias(n) for seed, n in ((3, "g"), (4, "f"))]).drop("a", "b")
    got = running(keyed, "conv_id", [F.col("depth")], [F.col("depth")], hi=(F.col("g"), "bit_xor"), lo=(F.col("f"), "bit_xor"), bytes_to=(F.col("bytes"), "sum"))
    return got.select("conv_id", "depth", "length", "bytes", "bytes_to", "hi", "lo", F.col("hi").bitwiseXOR(F.col("g")).alias("from_hi"), F.col("lo").bitwiseXOR(F.col("f")).alias("from_lo"), F.expr(f"(depth - 1) div {BLOCK}").alias("k"))


def _refined(turns: DataFrame, **values: str) -> DataFrame:
    """Nodes of block members' turns: as they are where a block has no sibling, else grouped by digest; values: how each column is put together."""
    fixed = ["from_hi", "from_lo", "bytes", "bytes_to"]
    how = {"sum": F.sum, "min": F.min}
    alone = turns.where("not diverges").select(*NODE, *fixed, *values)
    grouped = turns.where("diverges").groupBy(*NODE).agg(*[F.min(c).alias(c) for c in fixed], *[how[v](c).alias(c) for c, v in values.items()])
    return alone.unionByName(grouped)


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, conv_id) -> (depth, hi, lo, ends_sha256) of the ids in ascending order, joined by commas. Ids are sorted by ranges and joined into chunks; a node's chunks stream through one hash, as the hash's nature wants, and nothing is held but its state."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, n = None, None, [], 0
        rows: list[tuple] = []
        for b in batches:
            for *key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != node or n > CHUNK:
                    if held:
                        rows.append((*node, first, ",".join(held)))
                    node, first, held, n = key, conv, [], 0
                held.append(str(conv))
                n += len(held[-1]) + 1
            if rows:
                yield batch(rows, ["depth", "hi", "lo", "first", "ids"])
                rows = []
        if held:
            yield batch([(*node, first, ",".join(held))], ["depth", "hi", "lo", "first", "ids"])

    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        rows: list[tuple] = []
        for b in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    rows.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if rows:
                yield batch(rows, [*NODE, "ends_sha256"])
                rows = []
        if state:
            yield batch([(*node, state.hexdigest())], [*NODE, "ends_sha256"])

    by_id = [*NODE, "conv_id"]
    joined = in_arrow(ends.select(*by_id).repartitionByRange(*by_id).sortWithinPartitions(*by_id), chunks, "depth long, hi long, lo long, first long, ids string")
    return in_arrow(joined.repartition(*NODE).sortWithinPartitions(*NODE, "first"), hashes, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns(conv_id, depth, length, a, b, bytes), depths from 1 to the conversation's length, and conversations(conv_id, length) -> the trie's nodes: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turnless conversations are members of the root alone, conversations with the same turns are members of the same nodes, and without any conversation there is no node. A member of many nodes owns those whose smallest member it is, which are the last of its path. What a subtree saves is what its members hold that they don't own: so each conversation brings to each node of its path the bytes between that depth and the first node it owns, and nothing is passed from node to node. These sums, as the counts, are made by blocks, whose members are added up before the shuffle, and brought to turns from one member of each distinct block. Digests have 128 bits.
    """
    prefixes = written(_prefixes(turns), "prefixes")
    at = F.struct("hi", "lo", "depth")
    of_block = prefixes.groupBy("conv_id", "k").agg(F.max_by(at, "depth").alias("end"), F.min_by(F.struct("from_hi", "from_lo"), "depth").alias("start"))
    of_block = written(of_block.select("conv_id", "k", F.col("start.from_hi").alias("start_hi"), F.col("start.from_lo").alias("start_lo"), "end.*"), "blocks")
    members = of_block.groupBy(*ENDS).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"))
    members = written(members, "block_members")
    siblings = members.groupBy("k", "start_hi", "start_lo").agg((F.count("*") > 1).alias("diverges"))
    inside = prefixes.select(F.col("conv_id").alias("owner"), "k", *NODE, "from_hi", "from_lo", "bytes", "bytes_to")
    ends = {"hi": "end_hi", "lo": "end_lo", "depth": "end_depth"}
    split = written(members.join(siblings, ["k", "start_hi", "start_lo"]).withColumnsRenamed(ends).join(inside, ["owner", "k"]), "members_turns")

    owned = written(_refined(split, n_convs="sum", owner="min"), "owned")
    first_owned = owned.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("owns_from"), F.min_by(F.col("bytes_to") - F.col("bytes"), "depth").alias("shares"))
    parents = owned.select((F.col("depth") - 1).alias("depth"), F.col("from_hi").alias("hi"), F.col("from_lo").alias("lo"))
    children = parents.where("depth > 0").groupBy(*NODE).agg(F.count("*").alias("n_children"))
    leaves = owned.join(children, NODE, "left_anti").select(F.col("owner").alias("conv_id"), F.lit(1).alias("leaf"))
    last = prefixes.where("depth = length").select("conv_id", "hi", "lo", "bytes_to")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    each = conversations.join(last, "conv_id", "left").join(first_owned, "conv_id", "left").join(leaves, "conv_id", "left")
    each = written(each.select("conv_id", F.col("length").alias("depth"), zero(F.col("hi")).alias("hi"), zero(F.col("lo")).alias("lo"), F.coalesce("owns_from", F.col("length") + 1).alias("owns_from"), zero(F.coalesce("shares", "bytes_to")).alias("shares"), zero(F.col("leaf")).alias("leaf")), "each")

    outside = F.col("owns_from") > F.col("depth")
    part = of_block.join(each.select("conv_id", "owns_from", "shares", "leaf"), "conv_id").groupBy(*ENDS).agg(F.count_if(outside).alias("sharers"), zero(F.sum(F.when(outside, F.col("shares")))).alias("shared"), F.sum("leaf").alias("n_leaves"), F.max(F.when(~outside, F.col("owns_from"))).alias("owns_from"), F.max(F.when(~outside, F.col("shares"))).alias("shares"))
    before = F.col("bytes_to") - F.col("bytes")
    saved = F.col("shared") - F.col("sharers") * before + F.when(F.col("owns_from") > F.col("depth"), F.col("shares") - before).otherwise(F.lit(0))
    brought = split.join(part.withColumnsRenamed(ends), ["k", "start_hi", "start_lo", "end_hi", "end_lo", "end_depth"]).withColumn("saved_tokens", saved)
    nodes = _refined(brought, n_convs="sum", owner="min", saved_tokens="sum", n_leaves="sum").join(children, NODE, "left")
    hashed = written(_hashed_ends(each), "hashed_ends")
    nodes = nodes.join(hashed, NODE, "left")
    nodes = written(nodes.select(*NODE, "from_hi", "from_lo", "owner", "n_convs", zero(F.col("n_children")).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"), "nodes")

    n, least, n_leaves, shares = each.agg(F.count("*"), F.min("conv_id"), F.sum("leaf"), F.sum("shares")).first()
    n_first = nodes.where("depth = 1").count()
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("from_hi"), F.col("lo").alias("from_lo"), F.col("owner").alias("parent_conv_id"))
    deeper = nodes.where("depth > 1").join(above, ["depth", "from_hi", "from_lo"])
    one = lambda v, n: F.lit(v).cast("long").alias(n)
    root = each.sparkSession.range(1 if n else 0).select(one(least, "owner"), one(0, "depth"), one(None, "parent_conv_id"), one(n, "n_convs"), one(n_first, "n_children"), one(max(1, n_leaves or 0), "n_leaves"), one(shares or 0, "saved_tokens"))
    root = root.join(hashed.where("depth = 0").select("depth", "ends_sha256"), "depth", "left")
    out = ["owner", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = reduce(DataFrame.unionByName, [x.select(*out) for x in (top, deeper, root)])
    return every.withColumnRenamed("owner", "conv_id").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(written(ranked_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), "turns"))
    return prefix_trie(turns, conversations)


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS i, 0 AS n, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) % 9 AS h
  FROM sizes, crc
), starts AS (
  SELECT hashed.*, least(h, coalesce(n, 0)) AS m FROM hashed LEFT JOIN sizes ON sizes.conv_id = base
), built AS (
  SELECT s.conv_id, r AS d, role, text FROM starts s JOIN turns ON turns.conv_id = base AND r <= h
  UNION ALL SELECT s.conv_id, m + r - h, role, text FROM starts s JOIN turns ON turns.conv_id = s.conv_id AND r > h
), paths AS (
  SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY d) FILTER (d IS NOT NULL), []) AS p FROM sizes LEFT JOIN built USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, d, p[1:d] AS node, len(p) AS length, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(p[d].text)) END AS bytes FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
  FROM members GROUP BY d, node
), edges AS (
  SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN edges ON edges.d = nodes.d AND edges.node = nodes.node
), below AS (
  SELECT a.d, a.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM known a JOIN known b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY a.d, a.node
)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN below b ON b.d = k.d AND b.node = k.node LEFT JOIN nodes p ON p.d = k.d - 1 AND p.node = k.node[1:k.d - 1]
"""
