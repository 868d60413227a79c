"""Municipal counts, the map table and its label points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.numbers import scaled_rate
from recuento.functions.predicates import equals
from recuento.functions.text import repair_mojibake
from recuento.operators.columns import mutate
from recuento.operators.counting import group_count
from recuento.operators.joins import lookup_join
from recuento.operators.ranking import quantile_class
from recuento.operators.spatial import polygon_centroid


def cases_per_municipality(
    registry: DataFrame, code: str = "cv_mun_desp", state_column: str = "cve_ent_desp", state: str | None = None
) -> DataFrame:
    """Cases per municipality code, NULL code included.

    The code alone does not tell states apart: equal codes of several states add
    up unless ``state`` keeps one of them.
    """
    cases = registry if state is None else registry.where(equals(F.col(state_column), state))
    return group_count(cases, [code], "n")


def region_rates(regions: DataFrame, population: DataFrame, cases: DataFrame, code: str = "cv_mun_desp") -> DataFrame:
    """Every region with its population, cases and rate; regions without cases stay."""
    with_people = lookup_join(regions, population, {"CVEGEO": "CVEGEO"})
    with_cases = lookup_join(with_people, cases, {"CVE_MUN": code})
    return with_cases.withColumn("tasa_desp", scaled_rate(F.col("n"), F.col("total_poblacion")))


def label_points(vertices: DataFrame) -> DataFrame:
    """Label point of each region: ``CVEGEO, CVE_MUN, X, Y``."""
    return polygon_centroid(vertices, ["CVEGEO", "CVE_MUN"]).select("CVEGEO", "CVE_MUN", "X", "Y")


def map_table(vertices: DataFrame, population: DataFrame, cases: DataFrame, code: str = "cv_mun_desp") -> DataFrame:
    """Region, population, cases, rate, quartile with its range, and label point."""
    rates = region_rates(label_points(vertices), population, cases, code)
    classed = quantile_class(rates, "tasa_desp", ["CVEGEO"], 4, "tasa_quart", "quart_rangos")
    return mutate(
        classed,
        {"tasa_quart": F.col("tasa_quart").cast("string"), "MUN": repair_mojibake(F.col("MUN"))},
    )
