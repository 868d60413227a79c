"""Label points of polygons, from a vertex table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERTICES_PER_STRETCH = 65_536


def polygon_centroid(
    vertices: DataFrame,
    region: Sequence[str],
    ring: str = "ring_id",
    pos: str = "pos",
    x: str = "x",
    y: str = "y",
    stretch: int = VERTICES_PER_STRETCH,
) -> DataFrame:
    """Planar area centroid ``(X, Y)`` and signed ``area2`` (twice the area) per region.

    Signed sums over the edges of all rings, so holes count against the ring
    around them when they run the other way. Rings may be closed or open. A
    region without area gets NULL.

    A ring is worked in stretches of positions, so that one huge ring does not
    end up in a single task: edges inside a stretch are summed with the stretch,
    and only its first and last vertex go on to close the ring.
    """
    pieces = [*region, ring, "__stretch"]
    inside = Window.partitionBy(*pieces).orderBy(pos)
    here = vertices.withColumn("__stretch", F.floor(F.col(pos) / stretch)).select(
        *pieces,
        F.col(pos),
        F.col(x).alias("__x"),
        F.col(y).alias("__y"),
        F.lead(x).over(inside).alias("__nx"),
        F.lead(y).over(inside).alias("__ny"),
    )
    cross = F.col("__x") * F.col("__ny") - F.col("__nx") * F.col("__y")
    zero = F.lit(0)
    point = F.struct("__x", "__y")
    sums = here.groupBy(*pieces).agg(
        F.coalesce(F.sum(cross), zero).alias("__a"),
        F.coalesce(F.sum((F.col("__x") + F.col("__nx")) * cross), zero).alias("__sx"),
        F.coalesce(F.sum((F.col("__y") + F.col("__ny")) * cross), zero).alias("__sy"),
        F.min_by(point, pos).alias("__first"),
        F.max_by(point, pos).alias("__last"),
    )
    along = Window.partitionBy(*region, ring).orderBy("__stretch")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joint = sums.withColumn("__next", F.coalesce(F.lead("__first").over(along), F.first("__first").over(whole)))
    lx, ly, nx, ny = F.col("__last.__x"), F.col("__last.__y"), F.col("__next.__x"), F.col("__next.__y")
    bridge = lx * ny - nx * ly
    totals = (
        joint.withColumn("__bridge", bridge)
        .groupBy(*region)
        .agg(
            F.sum(F.col("__a") + F.col("__bridge")).alias("area2"),
            F.sum(F.col("__sx") + (lx + nx) * F.col("__bridge")).alias("__sx"),
            F.sum(F.col("__sy") + (ly + ny) * F.col("__bridge")).alias("__sy"),
        )
    )
    area = F.col("area2").cast("double")
    return totals.select(
        *region,
        F.try_divide(F.col("__sx").cast("double"), area * 3).alias("X"),
        F.try_divide(F.col("__sy").cast("double"), area * 3).alias("Y"),
        F.col("area2"),
    )


def array_vertices(
    df: DataFrame, region: Sequence[str], points: str, ring: str = "ring_id", pos: str = "pos"
) -> DataFrame:
    """Vertex table of polygons stored as ``ARRAY<STRUCT<x, y>>``, one ring per row."""
    exploded = df.select(*region, F.posexplode(points).alias(pos, "__p"))
    return exploded.select(*region, F.lit(0).alias(ring), pos, F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))
