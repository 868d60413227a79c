"""Near-duplicate vectors by NN-descent.

Every vector keeps a list of its nearest known neighbours. The lists start from
random-projection leaves and are refined by local joins: the neighbours of a
vector, and the vectors it is a neighbour of, are compared with each other, since
a neighbour's neighbour is likely a neighbour. Every pair found at or above the
threshold is a link, whether or not it has a place in a list. Links make
components. A list that is full of links may hide further ones: such vectors are
searched again with lists of vectors outside their component, until no list is
full of links or they all are in one component. Within a component all pairs are
compared in blocks. A sample compared with all vectors audits the recall; more
leaves and joins follow while it is too low, and an error if it stays so.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recuento.llm.graph import components
from recuento.session import materialize

THRESHOLD = 0.95
NEIGHBOURS = 8
LEAF = 128
TREES = 8
ROUNDS = 6
SETTLED = 0.005
"""Joins end when fewer than this share of the list entries are new."""

AUDIT = 1000
"""So many vectors, those of the least hash, are compared with all to measure recall; their links are not used otherwise."""

LEAST_RECALL = 0.98
ATTEMPTS = 3
BLOCK = 512

_log = logging.getLogger(__name__)

_EDGES = "a long, b long, sim double"
_FOUND = f"{_EDGES}, link boolean"
"""Candidates for the lists and, marked ``link``, pairs that are linked directly or through others compared in the same call."""


def _lengths(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision, one row each; shorter ones are filled up with zeros."""
    offsets, lengths = column.offsets.to_numpy(), _lengths(column)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    rows = np.zeros((len(column), int(lengths.max())))
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = values
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of the keys in them, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy()
        start = int(np.searchsorted(column, column[-1], "left"))
        if held and (start or held[-1].column(key)[-1].as_py() != column[0]):
            first = int(np.searchsorted(column, held[-1].column(key)[-1].as_py(), "right"))
            yield pa.Table.from_batches([*held, batch.slice(0, max(first, start))]).combine_chunks()
            held = [batch.slice(max(first, start))] if max(first, start) < batch.num_rows else []
        elif start and not held:
            yield pa.Table.from_batches([batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray, link: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim), pa.array(np.full(len(a), link))], names=["a", "b", "sim", "link"])


def _joined(linked: np.ndarray) -> np.ndarray:
    """For square tables of links the least row that each row reaches."""
    size = linked.shape[-1]
    least = np.broadcast_to(np.arange(size), linked.shape[:-1])
    while True:
        lower = np.minimum(least, np.where(linked, least[..., None, :], size).min(-1))
        if (lower == least).all():
            return least
        least = lower


def _leaves(vectors: DataFrame, trees: range, nodes: int, size: int, k: int, threshold: float) -> DataFrame:
    """For each of ``node, vector, component`` its ``k`` best of other components within its leaf of each tree, and the leaf's links.

    A leaf is the signs of random projections; more vectors than fit a leaf are
    dealt out by a hash, so copies and clusters do not make one large leaf.
    """
    bits = max(0, (max(nodes, 1) // LEAF).bit_length())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("vector"))
            for tree in trees:
                planes = np.random.default_rng(tree).standard_normal((unit.shape[1], max(bits, 1)))
                signs = (unit @ planes > 0)[:, :bits]
                code = (signs @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(unit), np.int64)
                leaf = (code * 64 + tree) * 65536 + _lengths(batch.column("vector"))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(leaf)], names=["node", "leaf"])

    codes = materialize(vectors.select("node", "vector").mapInArrow(coded, "node long, leaf long"), "leaves")
    sizes = codes.groupBy(F.col("leaf").alias("l")).agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("node", "leaf"), F.ceil(F.col("members") / size))
    dealt = codes.join(sizes, F.col("leaf") == F.col("l")).select("node", F.xxhash64("leaf", part).alias("part"))
    dealt = dealt.join(vectors.select(F.col("node").alias("n"), "vector", "component"), F.col("node") == F.col("n"))
    dealt = dealt.select("part", "node", "component", "vector").repartition("part").sortWithinPartitions("part")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "part"):
            part, node, component = (table.column(c).to_numpy() for c in ("part", "node", "component"))
            unit = _matrix(table.column("vector").combine_chunks())
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for i, j in zip(at, np.append(at[1:], len(part))):
                if j - i < 2:
                    continue
                sims = unit[i:j] @ unit[i:j].T
                sims[component[i:j, None] == component[i:j]] = -2.0
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best_sims = np.take_along_axis(sims, top, 1).reshape(-1)
                apart = best_sims > -1.5
                yield _edges(np.repeat(node[i:j], top.shape[1])[apart], node[i:j][top].reshape(-1)[apart], best_sims[apart])
                least = _joined(sims >= threshold)
                moved = np.flatnonzero(least != np.arange(j - i))
                yield _edges(node[i:j][least[moved]], node[i:j][moved], np.ones(len(moved)), True)

    return dealt.mapInArrow(best, _FOUND)


def _nearest(lists: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the lists so far and of what was found; ``new`` marks entries that were not there before."""
    every = lists.select("a", "b", "sim", F.lit(False).alias("new")).unionByName(found.select("a", "b", "sim", F.lit(True).alias("new")))
    every = every.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return every.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _local_join(lists: DataFrame, inner: DataFrame | None, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs of different components that meet at a common neighbour and improve the list of ``a``, and all links met.

    At each vector its neighbours, those of ``inner`` (found before components
    were set apart) and at most ``k`` of those whose neighbour it is, new ones
    first, are compared, if one of the two is new to the list.
    """
    back = lists.select(F.col("b").alias("u"), F.col("a").alias("m"), "sim", "new")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), F.desc("sim"), "m"))
    back = back.withColumn("place", place).where(F.col("place") <= k).select("u", "m", "new")
    around = lists.select(F.col("a").alias("u"), F.col("b").alias("m"), "new").unionByName(back)
    if inner is not None:
        around = around.unionByName(inner.select(F.col("a").alias("u"), F.col("b").alias("m"), F.lit(False).alias("new")))
    around = around.groupBy("u", "m").agg(F.max("new").alias("new"))
    live = around.withColumn("live", F.max("new").over(Window.partitionBy("u"))).where("live").drop("live")
    worst = lists.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    known = vectors.join(worst, F.col("node") == F.col("a"), "left").select("node", "vector", "component", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rows = live.join(known, F.col("m") == F.col("node")).select("u", "m", "new", "worst", "component", "vector")
    rows = rows.repartition("u").sortWithinPartitions("u")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "u"):
            u, m, new, worst, component = (table.column(c).to_numpy() for c in ("u", "m", "new", "worst", "component"))
            unit = _matrix(table.column("vector").combine_chunks())
            at = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            sizes = np.diff(np.append(at, len(u)))
            for first in range(0, len(at), 1000):
                starts, n = at[first : first + 1000], sizes[first : first + 1000]
                places = np.arange(n.max())
                held = places < n[:, None]
                index = np.where(held, starts[:, None] + places, 0)
                sims = unit[index] @ unit[index].transpose(0, 2, 1)
                fresh = new[index] & held
                pair = held[:, :, None] & held[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
                pair &= component[index][:, :, None] != component[index][:, None, :]
                g, i, j = np.nonzero(pair & (sims > worst[index][:, :, None]))
                yield _edges(m[index[g, i]], m[index[g, j]], sims[g, i, j])
                least = _joined(pair & (sims >= threshold))
                g, i = np.nonzero(least != places)
                yield _edges(m[index[g, least[g, i]]], m[index[g, i]], np.ones(len(g)), True)

    return rows.mapInArrow(joined, _FOUND)


def _search(vectors: DataFrame, inner: DataFrame | None, trees: range, nodes: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Lists of the nearest vectors outside the own component, and the links ``a, b`` found on the way."""
    k, empty = NEIGHBOURS, vectors.sparkSession.createDataFrame([], _EDGES)
    found = materialize(_leaves(vectors, trees, nodes, LEAF, k, threshold), "found")
    links = found.where("link")
    lists = materialize(_nearest(empty, found.where("not link"), k), "lists")
    for _ in range(ROUNDS):
        found = materialize(_local_join(lists, inner, vectors, k, threshold), "found")
        links = links.unionByName(found.where("link"))
        lists = materialize(_nearest(lists, found.where("not link"), k), "lists")
        state = lists.agg(F.sum(F.col("new").cast("int")).alias("new"), F.count("*").alias("all")).first()
        if (state["new"] or 0) <= SETTLED * state["all"]:
            break
    return lists, links.select("a", "b")


def _hidden(vectors: DataFrame, lists: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """``node, vector, component`` of the vectors whose whole list is links, so that it may hide others."""
    full = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("worst"))
    full = full.where((F.col("n") >= NEIGHBOURS) & (F.col("worst") >= threshold)).select("a")
    rows = vectors.join(full, F.col("node") == F.col("a")).join(linked, F.col("node") == F.col("id"))
    return materialize(rows.select("node", "vector", "component"), "hidden")


def _audit(vectors: DataFrame, threshold: float, most: int) -> DataFrame:
    """``a, b`` of all links of the ``most`` vectors with the least hash: a bounded set against all rows, in blocks."""
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "vector").toPandas()
    nodes = sample["node"].to_numpy()
    by_size = {}
    for size in {len(v) for v in sample["vector"]}:
        chosen = [i for i, v in enumerate(sample["vector"]) if len(v) == size]
        rows = np.stack([sample["vector"].iloc[i] for i in chosen]).astype(np.float64)
        by_size[size] = (nodes[chosen], rows / np.linalg.norm(rows, axis=1, keepdims=True))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                unit, own, lengths = _matrix(part.column("vector")), part.column("node").to_numpy(), _lengths(part.column("vector"))
                for size, (other, rows) in shared.value.items():
                    same = lengths == size
                    i, j = np.nonzero(unit[same][:, :size] @ rows.T >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(other[j]), pa.array(own[same][i])], names=["a", "b"])

    return vectors.select("node", "vector").mapInArrow(linked, "a long, b long").where("a <> b")


def _links_within(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links``: for ``node, component, copies, vector`` the copies of the linked vectors of the component.

    A component is cut into blocks by a hash, and each pair of blocks is compared
    in one call; a call returns a sum for each vector, never pairs.
    """
    sizes = members.groupBy(F.col("component").alias("c")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, F.col("component") == F.col("c"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", "node", "copies", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(rows["vector"].to_list()).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            own = rows["own"].to_numpy()
            linked &= own[:, None] != own
        return pd.DataFrame({"node": rows["node"], "links": linked @ rows["copies"].to_numpy()})

    parts = rows.groupBy("component", "i", "j").applyInPandas(counted, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row in.

    Vectors with a cosine of at least ``threshold`` in double precision are
    linked: ``n_links`` other rows directly; ``component_id`` is the least
    ``vec_id`` reachable. Equal vectors are one node with a number of copies.
    Vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing, nor do vectors of different lengths; a NULL ``vec_id``
    counts as a row but names no component unless alone. Rows with one ``vec_id``
    are rows of their own. Other columns are not looked at.
    """
    rows = table.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("wide"), F.col(embedding).alias("vector"))
    finite = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("wide", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.select("id", F.when(sound, F.xxhash64("vector")).alias("node"), F.when(sound, F.col("vector")).alias("vector")), "vectors")
    vectors = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")
    )
    vectors = materialize(vectors, "nodes")
    nodes = vectors.count()
    audited = materialize(_audit(vectors, threshold, AUDIT), "audit") if nodes else vectors.sparkSession.createDataFrame([], "a long, b long")
    active, searched = vectors.select("node", "vector", F.col("node").alias("component")), nodes
    links, inner, attempt, turn = None, None, 1, 0
    while True:
        lists, found = _search(active, inner, range(turn * TREES, (turn + 1) * TREES), searched, threshold)
        links, inner, turn = found if links is None else links.unionByName(found), lists if inner is None else inner, turn + 1
        linked = materialize(components(links), "linked")
        active = _hidden(vectors, lists, linked, threshold)
        hidden = active.agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts")).first()
        searched = hidden["n"]
        if hidden["parts"] > 1:
            continue
        a, b = (linked.select(F.col("id").alias(f"{s}2"), F.col("component").alias(f"c{s}")) for s in ("a", "b"))
        held = audited.join(a, F.col("a") == F.col("a2"), "left").join(b, F.col("b") == F.col("b2"), "left")
        recall = held.agg(F.avg(F.coalesce((F.col("ca") == F.col("cb")).cast("int"), F.lit(0))).alias("r")).first()["r"]
        if recall is not None:
            _log.info("recall of %.4f on %d vectors after %d attempts", recall, AUDIT, attempt)
        if recall is None or recall >= LEAST_RECALL:
            break
        if attempt == ATTEMPTS:
            raise RuntimeError(f"recall of {recall:.4f} on {AUDIT} vectors is under {LEAST_RECALL} after {ATTEMPTS} attempts")
        parts = vectors.join(linked, F.col("node") == F.col("id"), "left")
        active, searched = materialize(parts.select("node", "vector", F.coalesce("component", "node").alias("component")), "parts"), nodes
        attempt += 1

    members = vectors.join(linked, F.col("node") == F.col("id")).select("node", "component", "copies", "least", "vector")
    counts = _links_within(members.drop("least"), threshold)
    names = members.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("name"))
    groups = members.select("node", "component").join(names, F.col("component") == F.col("c")).join(counts, "node")
    groups = groups.select(F.col("node").alias("n"), "name", "links")
    known = vectors.join(groups, F.col("node") == F.col("n"), "left").select(
        F.col("node").alias("n"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("name", "least").alias("name"),
    )
    known = materialize(known, "known")
    out = rows.select("id", "node").join(known, F.col("node") == F.col("n"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
