"""Connected components of links, given as a table or found within buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for each end of a link ``a, b``; the component is the least id reachable.

    Each round every node takes the least label among its neighbours' and then
    the label of its label, so labels travel over ever longer ways; rounds end
    when nothing moves. Labels are a stored table after each round; only the
    number of moves reaches the driver.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(both.where("src <> dst").distinct(), "links")
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("src")).select("id", "label", F.least("label", "near").alias("low"))
        parents = labels.select(F.col("id").alias("parent"), F.col("label").alias("above"))
        jumped = lower.join(parents, F.col("low") == F.col("parent"))
        jumped = jumped.select("id", F.least("low", "above").alias("new"), (F.least("low", "above") < F.col("label")).alias("moved"))
        stored = materialize(jumped, "labels")
        labels = stored.select("id", F.col("new").alias("label"))
        if not stored.where("moved").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))


_CROWD = 8


def components_within(
    buckets: DataFrame,
    test: Callable[[DataFrame], DataFrame],
    test_crowd: Callable[[DataFrame], DataFrame] | None = None,
    hints: tuple[DataFrame, Callable[[str, str], Column]] | None = None,
) -> DataFrame | None:
    """Components of the links between nodes that share a bucket; None where there is no link.

    ``buckets`` is a stored table of distinct ``bucket, node, anchor``; a pair may
    be linked if it shares a bucket in which one of the two is an anchor.
    ``test`` turns distinct pairs ``a < b`` into ``a, b, linked``. ``test_crowd``
    gets the members ``bucket, node, anchor, component`` of buckets with very many pairs
    left and returns links ``a, b, linked`` that join all it can join, without
    making the pairs; without it they are compared pair by pair like the others.
    ``hints`` are a table of node and a small description, and a condition on two
    columns of descriptions that holds for all linked nodes: pair by pair, the join makes
    only those that meet it.

    Members of a bucket are first compared with one anchor, round after round
    with another, which costs as much as the buckets are large; pairs that are
    in one component by then need no test. When a round leaves over half of the
    pairs, or little is left, the rest between components is compared pair by
    pair. So no link between components is lost, and a bucket of copies, which
    are one component by then, never makes all its pairs. A bucket of many nodes
    that are not linked is compared pair by pair; ``test_crowd`` keeps its pairs
    from becoming rows.
    """
    tested, found, before, turn = None, None, float("inf"), 0
    while True:
        if found is None:
            members = buckets.withColumn("component", F.col("node"))
        else:
            members = buckets.join(found.withColumnRenamed("id", "node"), "node", "left")
            members = members.withColumn("component", F.coalesce("component", "node"))
        sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max("anchor").alias("anchor"))
        sizes = sizes.groupBy(F.col("bucket").alias("open")).agg(
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
            F.sum("n").alias("n"),
            F.count("*").alias("parts"),
            F.max("anchor").alias("anchor"),
        )
        sizes = materialize(sizes.where("parts > 1 and anchor"), "open")
        left = sizes.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if not left["n"]:
            return found
        last = left["pairs"] <= 4 * left["n"] or left["pairs"] > before / 2
        before = left["pairs"]
        if last or found is not None:
            # stored, as several joins read them; before any link all buckets are open but those that make no pairs
            crowd = F.col("pairs") > _CROWD * F.col("n")
            members = members.join(sizes.select("open", crowd.alias("crowd")), F.col("bucket") == F.col("open"))
            members = materialize(members.drop("open"), "members")
        if last:
            if test_crowd:
                crowded = materialize(test_crowd(members.where("crowd").select("bucket", "node", "anchor", "component")), "crowded")
                members = members.where("not crowd")
            columns = ["bucket", "node", "anchor", "component"]
            if hints:
                described = hints[0].toDF("described", "hint")
                members = members.join(described, F.col("node") == F.col("described"))
                columns.append("hint")
            other = members.select(*[F.col(c).alias(f"{c}2") for c in columns])
            apart = (F.col("bucket") == F.col("bucket2")) & (F.col("node") < F.col("node2")) & (F.col("component") != F.col("component2"))
            if hints:
                apart = apart & hints[1]("hint", "hint2")
            pairs = members.join(other, apart & (F.col("anchor") | F.col("anchor2"))).select(F.col("node").alias("a"), F.col("node2").alias("b"))
        else:
            draw = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "component")
            pivots = members.where("anchor").groupBy("bucket").agg(F.min(draw).alias("pivot"))
            pairs = members.join(pivots, "bucket").where(F.col("component") != F.col("pivot.component"))
            pairs = pairs.select(F.least("node", F.col("pivot.node")).alias("a"), F.greatest("node", F.col("pivot.node")).alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = materialize(test(pairs), "tested")
        if last and test_crowd:
            new = new.unionByName(crowded)
        tested = new if tested is None else tested.unionByName(new)
        turn += 1
        if new.where("linked").limit(1).count():
            found = components(tested.where("linked"))
        if last:
            return found
