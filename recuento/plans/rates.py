"""Rates per 100,000 inhabitants by sex, age band and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.categories import replace_values, restrict_levels
from recuento.functions.numbers import rate_per, round_even
from recuento.operators.counting import group_count, regroup_sum, sum_or_zero
from recuento.operators.joins import natural_left_join
from recuento.operators.reshape import drop_null_rows, wide_to_long
from recuento.operators.shares import add_scope_total
from recuento.plans import settings as S
from recuento.plans.census import population_strata
from recuento.plans.descriptives import STATUS, with_age_band, with_age_order, with_status_levels

NATIONAL_STATUS = "condicion_actual_de_las_personas"


def _plural_sex(df: DataFrame) -> DataFrame:
    return df.withColumn("sexo", replace_values(F.col("sexo"), S.SEX_PLURAL))


def _rates(counts: DataFrame, scope: list[str], census: DataFrame) -> DataFrame:
    """Scope total, then complete rows only, then the rate of each stratum.

    The cases are counted first; only the counts meet the census strata.
    """
    complete = drop_null_rows(add_scope_total(counts, scope))
    strata = natural_left_join(complete, population_strata(census))
    exact = strata.withColumn("tasa", rate_per(F.col("total"), F.col("total_poblacion")))
    return with_age_order(exact.withColumn("tasa", round_even(F.col("tasa"), 2)))


def city_rates(registry: DataFrame, census: DataFrame, by_status: bool = False) -> DataFrame:
    """Registry cases per 100,000 inhabitants by sex (and status) and age band."""
    cases = with_age_band(_plural_sex(registry))
    if by_status:
        counts = group_count(with_status_levels(cases), ["sexo", STATUS, "grupo_edad"])
        return _rates(counts, ["sexo", STATUS], census)
    return _rates(group_count(cases, ["sexo", "grupo_edad"]), ["sexo"], census)


def national_long(national: DataFrame) -> DataFrame:
    """National counts by status, age band and sex, one row per sex.

    Men and women are summed before they become rows, so the reshaped table is
    as small as its groups. Sums compose, so no step by single age is needed.
    """
    wide = (
        with_age_band(national)
        .groupBy(NATIONAL_STATUS, "grupo_edad")
        .agg(sum_or_zero(F.col("hombres")).alias(S.MAN), sum_or_zero(F.col("mujeres")).alias(S.WOMAN))
    )
    return wide_to_long(wide, [NATIONAL_STATUS, "grupo_edad"], "sexo", "total")


def national_rates(national: DataFrame, census: DataFrame, by_status: bool = False) -> DataFrame:
    """National cases per 100,000 inhabitants by sex (and status) and age band."""
    long = _plural_sex(national_long(national))
    if not by_status:
        return _rates(regroup_sum(long, ["sexo", "grupo_edad"]), ["sexo"], census)
    status = restrict_levels(replace_values(F.col(NATIONAL_STATUS), S.NATIONAL_STATUS), S.STATUS_LEVELS)
    counts = regroup_sum(long.withColumn(NATIONAL_STATUS, status), ["sexo", NATIONAL_STATUS, "grupo_edad"])
    return _rates(counts, ["sexo", NATIONAL_STATUS], census)
