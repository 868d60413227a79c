"""Prefix trie of conversations by fixed-length block hashing.

Turns are gathered in blocks of ``BLOCK``. A turn's hash covers its depth, role
and text; a block's digest is its turns' hashes combined, and the digest of all
blocks so far names the group of conversations that agree up to there.
Conversations are grouped by these digests, block after block, without looking at
single turns. Where all of a group go on with the same block, its turns are nodes
with the same members. Only blocks that have siblings in their group are cut at
their turns, one copy of each different block however many conversations hold it.

A hash has two halves of 64 bits. Conversations meet in aggregates with partial
sums, so a first turn or a whole conversation that a third of the log shares is
one partial row per task. Sums over subtrees double their reach round by round;
an ancestor is looked up in the own path of the node's least member, which no
other conversation reads, so no node is a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recuento.llm.common import CRC32_SQL, CRC_TABLE_SQL
from recuento.session import materialize

BLOCK = 4

ENDS_ROW = 4096
"""Conversations that end in one node are listed in pieces by their id; a piece spans so many numbers."""

HEAVY = 1000
"""Parents with over this fraction of all children are looked up apart; there are at most so many."""

_KEY = ["depth", "p", "q"]


def original_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, place, role, text``: the turns of each conversation, numbered from 1."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("place"), "role", "text")


def shared_openings(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the opening of the first of their family, as a log of branching conversations.

    ``turns`` has ``conv, place, role, text``. A conversation c begins with the
    first h turns of c - c % ``family`` (all if there are fewer) and goes on with
    its own turns after its first h; h is crc32 of c as text modulo ``most``.
    Returns the rebuilt turns ``conv, depth, role, text`` and all ``conv``.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    first = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")).join(first, "base", "left")
    plan = plan.select("conv", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long").alias("taken"))
    plan = materialize(plan, "families")
    own = turns.join(plan, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    opening = turns.where(F.col("place") < most).withColumnRenamed("conv", "base").join(plan, "base").where("place <= taken")
    return own.unionByName(opening.select("conv", F.col("place").alias("depth"), "role", "text")), plan.select("conv")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """``conv, b, p, q, turns, before_p, before_q``: each block's digest, its turns and the digest of the blocks before it."""
    hashed = turns.select(
        "conv",
        "depth",
        F.xxhash64("depth", "role", "text").alias("p"),
        F.xxhash64(F.lit("q"), "depth", "role", "text").alias("q"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    hashed = hashed.repartition("conv").withColumn("b", F.floor((F.col("depth") - 1) / block))
    blocks = hashed.groupBy("conv", "b").agg(
        F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"), F.array_sort(F.collect_list(F.struct("depth", "p", "q", "bytes"))).alias("turns")
    )
    earlier = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({f"before_{x}": F.coalesce(F.bit_xor(x).over(earlier), F.lit(0).cast("long")) for x in "pq"})


def _cut(blocks: DataFrame) -> DataFrame:
    """The turns of ``blocks`` as nodes: ``depth, p, q, bytes``, the parent's ``up_p, up_q``, and what else the rows have.

    Blocks are short, so each turn combines the hashes before it anew.
    """

    def upto(half: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("turns")),
            lambda n: F.aggregate(F.slice("turns", F.lit(1), n), F.col(f"before_{half}"), lambda x, t: x.bitwiseXOR(t[half])),
        )

    rows = blocks.withColumns({"ps": upto("p"), "qs": upto("q")}).select("*", F.posexplode("turns").alias("at", "t"))
    return rows.select(
        "conv", "n_convs", F.col("t.depth").alias("depth"), F.get("ps", F.col("at") + 1).alias("p"), F.get("qs", F.col("at") + 1).alias("q"),
        F.col("t.bytes").alias("bytes"), F.get("ps", "at").alias("up_p"), F.get("qs", "at").alias("up_q"),
    )


def _nodes(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``depth, p, q, conv, n_convs, bytes, up_p, up_q`` of each node, the root included."""
    group, digest = ["b", "before_p", "before_q"], ["p", "q"]
    distinct = blocks.groupBy(*group, *digest).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.any_value("turns").alias("turns"))
    distinct = materialize(distinct, "blocks")
    # a group that goes on with one block alone has it as its least one
    going_on = distinct.groupBy(*group).agg(F.count("*").alias("ways"), F.min(F.struct(*digest)).alias("least"))
    alone = going_on.where("ways = 1").select(*group, F.col("least.p").alias("p"), F.col("least.q").alias("q"))
    straight = _cut(distinct.join(alone, [*group, *digest], "left_semi"))
    apart = _cut(distinct.join(alone, [*group, *digest], "left_anti"))
    apart = apart.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("up_p").alias("up_p"), F.min("up_q").alias("up_q")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("p"), zero.alias("q"), "conv", "n_convs", zero.alias("bytes"), F.lit(None).cast("long").alias("up_p"), F.lit(None).cast("long").alias("up_q"),
    )
    names = [*_KEY, "conv", "n_convs", "bytes", "up_p", "up_q"]
    return materialize(straight.select(*names).unionByName(apart.select(*names)).unionByName(root), "nodes")


def _subtree_sums(nodes: DataFrame, paths: DataFrame, names: list[str]) -> DataFrame:
    """``nodes`` with the columns ``names`` summed over the subtree of each node.

    After a round a node has the sums over all nodes less than ``reach`` below
    it: those of itself and of the nodes exactly half as far below. ``paths``
    has the ``conv, depth, p, q`` of whole conversations; the ancestor of a node
    is a place in the path of its least member.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        above = paths.select(F.col("conv").alias("c"), F.col("depth").alias("up"), F.col("p").alias("a_p"), F.col("q").alias("a_q"))
        given = nodes.where(F.col("depth") >= reach).join(above, (F.col("conv") == F.col("c")) & (F.col("depth") - reach == F.col("up")))
        given = given.groupBy("up", "a_p", "a_q").agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        same = (F.col("depth") == F.col("up")) & (F.col("p") == F.col("a_p")) & (F.col("q") == F.col("a_q"))
        summed = nodes.join(given, same, "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in names})
        nodes = materialize(summed.select(*nodes.columns), "sums")
        reach *= 2
    return nodes


def _paths(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, depth, p, q``: the node of each conversation at each depth, the root included."""
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("p"), zero.alias("q"))
    return _cut(blocks.withColumn("n_convs", F.lit(1))).select("conv", *_KEY).unionByName(root)


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Add ``parent_conv_id`` and ``n_children``.

    Parents with very many children, of which there can only be few, are looked
    up by a broadcast, so that their children do not meet in one task.
    """
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(up, F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialize(counted, "counted")
    total = counted.count()
    parents = counted.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv").alias("parent_conv_id"), (F.col("n_children") * HEAVY > total).alias("heavy")
    )
    key = ["depth", "up_p", "up_q"]
    heavy = counted.join(F.broadcast(parents.where("heavy").drop("heavy")), key, "left")
    others = heavy.where("parent_conv_id is null").drop("parent_conv_id").join(parents.where("not heavy").drop("heavy"), key, "left")
    return heavy.where("parent_conv_id is not null").unionByName(others)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, joined by commas; one running hash at a time."""
    key, running = None, None
    names = [*_KEY, "ends_sha256"]
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            now = (row["depth"], row["p"], row["q"])
            if now != key:
                if running:
                    done.append((*key, running.hexdigest()))
                key, running = now, hashlib.sha256(row["ids"].encode())
            else:
                running.update(b"," + row["ids"].encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done])
    if running:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, running.hexdigest())))])


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, p, q, ends_sha256``: SHA-256 of each node's ``conv`` numbers, ascending and joined by commas.

    The numbers of a node are joined in pieces of a bounded span, in many tasks;
    a task then streams the pieces of a node, in order, through the hash.
    """
    piece = F.floor(F.col("conv") / ENDS_ROW).alias("piece")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*_KEY, piece).agg(ids.alias("ids"))
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece")
    return pieces.mapInArrow(_hash_lists, "depth long, p long, q long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and at which node each conversation ends.

    ``turns`` has ``conv, depth, role, text`` with depths from 1 without gaps and
    no NULL, ``convs`` each ``conv`` once, also those without turns. Nodes are
    named by ``depth, p, q`` and have ``conv_id`` (their least member),
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens``: over the subtree, the bytes of a node's text for each
    member but one. The second table has ``depth, p, q, conv``. Two empty tables
    give none.
    """
    blocks = materialize(_blocks(turns, block), "block_digests")
    nodes = _nodes(blocks, convs)
    nodes = _with_parent(nodes)
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": saved})
    paths = materialize(_paths(blocks, convs), "paths")
    nodes = _subtree_sums(materialize(nodes, "valued"), paths, ["n_leaves", "saved_tokens"])
    last = paths.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("end"))
    ends = last.select("end.*", "conv")
    return nodes.select(*_KEY, F.col("conv").alias("conv_id"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def branching_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``prefix_trie`` of the conversations rebuilt by ``shared_openings``.

    Turns are ordered by number, NULL first, then role and text; repeated rows
    are turns of their own. NULL roles and texts are empty. Rows with a NULL
    ``conv_id`` belong to no conversation and are left out. Other columns are
    not carried, whatever their names.
    """
    turns = materialize(original_turns(conversations, conv_id, turn, role, text), "turns")
    return prefix_trie(*shared_openings(turns), block)


TRIE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
original AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
named AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, count(*) AS n FROM original GROUP BY conv_id),
plan AS (
  SELECT c.conv_id, {CRC32_SQL.format(x="c.name")} % 9 AS h, c.conv_id - c.conv_id % 5 AS base, b.n AS n_base
  FROM named c CROSS JOIN crc_table LEFT JOIN named b ON b.conv_id = c.conv_id - c.conv_id % 5
),
rebuilt AS (
  SELECT p.conv_id, o.place AS depth, role, text FROM plan p JOIN original o ON o.conv_id = p.base AND o.place <= p.h
  UNION ALL
  SELECT p.conv_id, o.place - p.h + least(p.h, coalesce(p.n_base, 0)), role, text
  FROM plan p JOIN original o ON o.conv_id = p.conv_id AND o.place > p.h
),
paths AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY prefix, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND starts_with(n.prefix, p.prefix)),
kids AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
sums AS (
  SELECT a.prefix, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n LEFT JOIN kids k ON k.parent_conv_id = n.conv_id AND k.depth = n.depth
  JOIN paths w ON w.conv_id = n.conv_id AND w.depth <= n.depth JOIN nodes a ON a.prefix = w.prefix
  GROUP BY a.prefix
),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (
  SELECT prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths JOIN last USING (conv_id, depth) GROUP BY prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked n JOIN sums s USING (prefix) LEFT JOIN kids k ON k.parent_conv_id = n.conv_id AND k.depth = n.depth LEFT JOIN ends e ON e.prefix = n.prefix
"""
