"""Merkle manifest of a dataset, stored in van Emde Boas layout.

Documents of a source, in order, are the leaves of a tree of ``FANOUT``; the roots
of all sources are the leaves of one more. A tree is stored as aligned subtrees of
at most ``HEIGHT`` levels, one row each. Inside a subtree the nodes lie in van Emde
Boas order: the upper half of its levels first, then each lower subtree from left
to right, every one of them split at half its height again. A node's address
follows from its depth and number alone (``address``); building a subtree and
finding the siblings on the way from a leaf to its root go by that arithmetic. The
roots of subtrees are the leaves of the next round's, up to the root.

Only digests move. A subtree is one group of at most ``FANOUT ** HEIGHT`` digests,
so a source of any size is spread over many tasks; its leaves are numbered in
ranges of the whole order. Proofs are made from the top down: each subtree gets
the steps above its root once and adds its own for each leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.llm.common import CRC32_SQL, CRC_TABLE_SQL
from recuento.operators.ranking import number_rows
from recuento.session import materialize

FANOUT = 3
HEIGHT = 4
WIDTH = FANOUT**HEIGHT

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PIECE = 1 << 16


def _div(x: int | Column, n: int) -> int | Column:
    return F.floor(x / n).cast("int") if isinstance(x, Column) else x // n


def tree_size(levels: int) -> int:
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: int | Column) -> int | Column:
    """The place of node ``index`` of ``depth``, both from 0, in a tree of so many levels in van Emde Boas order.

    ``index`` is a number or a column; the recursion over the halves is on plain numbers.
    """
    if levels == 1:
        return 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = levels - top, depth - top
    width = FANOUT**below
    return _div(index, width) * tree_size(bottom) + (tree_size(top) + address(bottom, below, index % width))


def hashed(*digests: Column) -> Column:
    """SHA-256, in lowercase hexadecimal, of the inputs one after another."""
    return F.sha2(F.concat(*digests), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that fields cannot run into each other; ``-`` for NULL."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return hashed(*[field(v) for v in values])


def rank_in_trees(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``rank``, from 0, within ``tree``, and ``n``, the size of the tree; ``rows`` should be a stored table.

    Rows are numbered over the whole order. The first number of a tree reaches
    its rows by pieces of the order, so a large tree does not meet in one task.
    """
    numbered, _ = number_rows(rows, [F.asc("tree"), *order], "__place")
    numbered = numbered.withColumn("__piece", F.floor(F.col("__place") / _PIECE))
    pieces = materialize(numbered.groupBy("tree", "__piece").agg(F.min("__place").alias("low"), F.count("*").alias("rows")), "pieces")
    trees = pieces.groupBy("tree").agg(F.min("low").alias("__start"), F.sum("rows").alias("n"))
    starts = pieces.select("tree", "__piece").join(trees, "tree")
    ranked = numbered.join(starts, ["tree", "__piece"]).withColumn("rank", F.col("__place") - F.col("__start"))
    return ranked.drop("__place", "__piece", "__start")


def _layout(height: int) -> Column:
    """``level, index`` of the nodes of a subtree in stored order; level 0 holds the leaves."""
    places = {address(height + 1, height - level, i): (level, i) for level in range(height + 1) for i in range(FANOUT ** (height - level))}
    return F.array(*[F.struct(F.lit(places[a][0]).alias("level"), F.lit(places[a][1]).alias("index")) for a in sorted(places)])


def _above(below: str) -> Column:
    """The digests of the runs of ``below``."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))


def subtrees(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """``tree, block, n, height, entries, nodes``: one row for each aligned subtree over ``tree, rank, n, digest``.

    ``entries`` are the leaves in order, structs of ``rank`` and the columns
    ``payload``; ``nodes`` the digests in van Emde Boas order, NULL where the
    last subtree of a tree has no node. A tree that one subtree holds ends where
    one node is left; in larger ones every subtree has the full height.
    """
    height = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(HEIGHT)), F.lit(0))
    leaf = F.struct("rank", "digest", *payload)
    rows = nodes.groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("block"), "n").agg(F.array_sort(F.collect_list(leaf)).alias("entries"))
    rows = rows.withColumns({"height": height, "level0": F.transform("entries", lambda e: e["digest"])})
    for level in range(1, HEIGHT + 1):
        rows = rows.withColumn(f"level{level}", F.when(F.col("height") >= level, _above(f"level{level - 1}")))
    levels = F.array(*[F.col(f"level{level}") for level in range(HEIGHT + 1)])
    layout = F.element_at(F.array(*[_layout(h) for h in range(HEIGHT + 1)]), F.col("height") + 1)
    rows = rows.withColumns({"levels": levels, "layout": layout})
    stored = F.transform("layout", lambda a: F.get(F.get("levels", a["level"]), a["index"]))
    entries = F.transform("entries", lambda e: F.struct(e["rank"].alias("rank"), *[e[c].alias(c) for c in payload]))
    return rows.select("tree", "block", "n", "height", entries.alias("entries"), stored.alias("nodes"))


def _tree_rounds(nodes: DataFrame, payload: Sequence[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored subtrees, round by round over the roots of the round before, and ``tree, digest`` of the trees' roots."""
    rounds, roots = [], None
    while True:
        blocks = materialize(subtrees(nodes, payload if not rounds else ()), f"{name}_subtrees")
        rounds.append(blocks)
        ended = blocks.where(F.col("n") <= WIDTH).select("tree", F.get("nodes", F.lit(0)).alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
        larger = blocks.where(F.col("n") > WIDTH)
        if not larger.limit(1).count():
            return rounds, roots
        nodes = larger.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / WIDTH).alias("n"), F.get("nodes", F.lit(0)).alias("digest"))


def _steps(height: str, index: Column) -> Column:
    """The way of leaf ``index`` to its subtree's root: at each level its place in the run and the others' digests."""
    steps = []
    for level in range(HEIGHT):
        own = _div(index, FANOUT**level)
        place = own % FANOUT
        others = []
        for k in range(FANOUT):
            at = F.lit(None).cast("int")
            for h in range(level + 1, HEIGHT + 1):
                at = F.when(F.col(height) == h, address(h + 1, h - level, own - place + k)).otherwise(at)
            others.append(F.when(place != k, F.get("nodes", at)))
        step = F.struct(place.alias("place"), F.array_compact(F.array(*others)).alias("siblings"))
        steps.append(F.when(F.col(height) > level, step))
    return F.array_compact(F.array(*steps))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, entry, steps`` and the further columns of ``above`` (``tree, steps`` of the trees' roots) for each leaf."""
    further = [c for c in above.columns if c not in ("tree", "steps")]
    given = None
    for k, blocks in reversed(list(enumerate(rounds))):
        rows = blocks.where(F.col("n") <= WIDTH).join(above, "tree")
        if given is not None:
            rows = rows.unionByName(blocks.where(F.col("n") > WIDTH).join(given, ["tree", "block"]))
        leaves = rows.select("tree", "height", "nodes", "steps", *further, F.explode("entries").alias("entry"))
        own = _steps("height", (F.col("entry.rank") % WIDTH).cast("int"))
        leaves = leaves.select("tree", "entry", F.concat(own, "steps").alias("steps"), *further)
        if not k:
            return leaves
        given = materialize(leaves.select("tree", F.col("entry.rank").alias("block"), "steps", *further), "steps")


def fold(leaf: Column, steps: str) -> Column:
    """The root that follows from a leaf and its proof."""

    def run(h: Column, step: Column) -> Column:
        before, after = F.slice(step["siblings"], F.lit(1), step["place"]), F.slice(step["siblings"], step["place"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(F.array_join(before, ""), h, F.array_join(after, "")), 256)

    return F.aggregate(steps, leaf, run)


def proof_digest(steps: str) -> Column:
    """SHA-256 of the siblings of all steps, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: s["siblings"])), ""), 256)


@dataclass
class Manifest:
    """Stored subtrees over the documents, those over the sources, and the columns each document's entry has."""

    documents: list[DataFrame]
    sources: list[DataFrame]
    payload: list[str]

    def proofs(self) -> DataFrame:
        """The entry's columns, ``subroot, root`` and ``steps`` for each document.

        ``steps`` lead from the leaf through the source's root to the root, each
        with the ``place`` in its run and the ``siblings`` there.
        """
        last = self.sources[-1]
        root = last.select("tree", F.get("nodes", F.lit(0)).alias("root"))
        steps = F.array().cast("array<struct<place: int, siblings: array<string>>>")
        sources = _descend(self.sources, root.withColumn("steps", steps))
        above = sources.select(F.col("entry.source").alias("tree"), "steps", F.col("entry.subroot").alias("subroot"), "root")
        leaves = _descend(self.documents, materialize(above, "source_steps"))
        return leaves.select(*[F.col(f"entry.{c}").alias(c) for c in self.payload], "subroot", "root", "steps")


def build_manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, other: dict[str, Column] | None = None
) -> Manifest:
    """Build and store the tree over ``docs``.

    A leaf is the digest of ``fields``, numbers as decimal text; NULL and empty
    values differ. Leaves of a source are ordered by ``doc_id``, NULL first, then
    digest, so repeated rows are leaves of their own next to each other; sources
    are ordered bytewise, NULL first, and NULL is one of them. Entries have
    ``doc_id``, ``leaf`` and the columns ``other``. An empty table has no
    subtrees. Other columns are not looked at, whatever their names.
    """
    key = F.col(source).cast("string")
    tree = F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), key))
    leaf = leaf_digest([F.col(c) for c in fields])
    leaves = docs.select(tree.alias("tree"), F.col(doc_id).alias("doc_id"), leaf.alias("leaf"), *[v.alias(k) for k, v in (other or {}).items()])
    ranked = rank_in_trees(materialize(leaves, "leaves"), [F.asc_nulls_first("doc_id"), F.asc("leaf")])
    payload = ["doc_id", "leaf", *(other or {})]
    documents, subroots = _tree_rounds(ranked.withColumn("digest", F.col("leaf")), payload, "document")
    named = materialize(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("digest").alias("subroot")), "subroots")
    top = rank_in_trees(named, [F.asc("source")])
    sources, _ = _tree_rounds(top.withColumn("digest", F.col("subroot")), ["source", "subroot"], "source")
    return Manifest(documents, sources, payload)


def _leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {CRC32_SQL.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql("text")} END AS given
  FROM documents, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
),
tree AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, level, idx // 3, n
),
subroots AS (
  SELECT source, level, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
),
top AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 3, n
),
nearby AS (
  SELECT d.r, t.level AS step, t.digest, t.idx < d.idx // CAST(3 ** t.level AS BIGINT) AS before, t.idx
  FROM ranked d JOIN tree t ON t.source IS NOT DISTINCT FROM d.source AND t.n > 1
       AND t.idx // 3 = d.idx // CAST(3 ** (t.level + 1) AS BIGINT) AND t.idx <> d.idx // CAST(3 ** t.level AS BIGINT)
  UNION ALL
  SELECT d.r, s.level + t.level, t.digest, t.idx < s.idx // CAST(3 ** t.level AS BIGINT), t.idx
  FROM ranked d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  JOIN top t ON t.n > 1 AND t.idx // 3 = s.idx // CAST(3 ** (t.level + 1) AS BIGINT) AND t.idx <> s.idx // CAST(3 ** t.level AS BIGINT)
),
steps AS (
  SELECT r, step, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (before), '') AS pre,
         coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT before), '') AS post
  FROM nearby GROUP BY r, step
),
folded AS (
  SELECT d.r, 0 AS step, d.given AS h, s.level + (SELECT max(level) FROM top) AS steps
  FROM ranked d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  UNION ALL
  SELECT f.r, f.step + 1, sha256(coalesce(s.pre, '') || f.h || coalesce(s.post, '')), f.steps
  FROM folded f LEFT JOIN steps s ON s.r = f.r AND s.step = f.step WHERE f.step < f.steps
),
proofs AS (SELECT r, string_agg(digest, '' ORDER BY step, idx) AS siblings FROM nearby GROUP BY r),
root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT d.doc_id, d.leaf, s.digest AS subroot, root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM ranked d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
JOIN folded f ON f.r = d.r AND f.step = f.steps LEFT JOIN proofs p ON p.r = d.r, root
"""
