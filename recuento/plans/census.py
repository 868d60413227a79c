"""Weighted census tables and the population projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.categories import band, recode, restrict_levels
from recuento.functions.numbers import percent, round_even
from recuento.functions.predicates import differs, equals
from recuento.functions.text import category_label, repair_mojibake
from recuento.operators.columns import mutate
from recuento.operators.counting import sum_strict, weighted_sum
from recuento.operators.dictionary import lookup_code
from recuento.operators.shares import add_scope_total
from recuento.plans import settings as S


def census_ages(persons: DataFrame, state: str | None = None) -> DataFrame:
    """Population by sex and age band: ``SEXO, grupo_edad, EDAD, pob, fuente``.

    ``EDAD`` is the expanded population of the row, ``pob`` that of the sex.
    """
    known = persons.where(differs(F.col("EDAD"), S.AGE_NOT_SPECIFIED))
    if state is not None:
        known = known.where(equals(F.col("ENT"), state))
    labelled = known.select(
        recode(F.col("SEXO"), S.CENSUS_SEX, default=S.NOT_SPECIFIED).alias("SEXO"),
        restrict_levels(band(F.col("EDAD"), S.AGE_BANDS), S.AGE_LEVELS).alias("grupo_edad"),
        "FACTOR",
    )
    sums = weighted_sum(labelled, ["SEXO", "grupo_edad"], "FACTOR", "EDAD")
    return add_scope_total(sums, ["SEXO"], "EDAD", "pob").withColumn("fuente", F.lit(S.CENSUS_SOURCE))


def census_schooling(persons: DataFrame, state: str = S.STATE_CODE) -> DataFrame:
    """Population by schooling in one state: ``NIVACAD, total, pob, fuente``."""
    level = recode(F.col("NIVACAD"), S.CENSUS_SCHOOLING, default=S.NOT_SPECIFIED, missing=S.NOT_APPLICABLE)
    levels = (
        persons.where(equals(F.col("ENT"), state))
        .select(level.alias("NIVACAD"), "FACTOR")
        .where(differs(F.col("NIVACAD"), S.NOT_APPLICABLE))
    )
    sums = weighted_sum(levels, ["NIVACAD"], "FACTOR")
    return add_scope_total(sums, [], "total", "pob").withColumn("fuente", F.lit(S.CENSUS_SOURCE))


def census_schooling_share(schooling: DataFrame) -> DataFrame:
    """Share of each level in whole percent, with its display label."""
    return mutate(
        schooling,
        {"per": percent(F.col("total"), F.col("pob"))},
        {"per": round_even(F.col("per"), 0)},
        {"label": category_label(F.col("NIVACAD"), F.col("per"), F.col("total"))},
    )


def population_strata(ages: DataFrame) -> DataFrame:
    """Census ages under the names that the registry tables join on."""
    return ages.withColumnsRenamed({"EDAD": "total_poblacion", "pob": "pob_censo", "SEXO": "sexo"})


def population_share(ages: DataFrame) -> DataFrame:
    """Share of each age band in the population of its sex, unrounded."""
    strata = population_strata(ages)
    return strata.withColumn("prop", percent(F.col("total_poblacion"), F.col("pob_censo")))


def population_by_municipality(
    projection: DataFrame, state: str = S.STATE_NAME, year: int = S.PROJECTION_YEAR
) -> DataFrame:
    """Projected population per municipality of one state and year, with its code.

    Names arrive with broken accents. They stay as delivered in ``MUN``; the
    state and the codes are looked up by the repaired name.
    """
    chosen = projection.where(equals(repair_mojibake(F.col("NOM_ENT")), state)).where(
        equals(F.col("`A—O`"), year)
    )
    sums = chosen.groupBy("CLAVE_ENT", "MUN", "A—O").agg(sum_strict(F.col("POB")).alias("total_poblacion"))
    named = sums.withColumn("__name", repair_mojibake(F.col("MUN")))
    return lookup_code(named, "__name", S.MUNICIPALITY_CODES, "CVEGEO").drop("__name")
