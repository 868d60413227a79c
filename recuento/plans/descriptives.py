"""Tables behind the descriptive figures of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.categories import band, level_position, restrict_levels, year_bucket
from recuento.functions.dates import days_between
from recuento.functions.predicates import differs, equals
from recuento.functions.text import category_label, share_label
from recuento.operators.counting import group_count, mean_known
from recuento.operators.ranking import order_by_value
from recuento.operators.reshape import drop_null_rows, sort_descending
from recuento.operators.shares import share_table
from recuento.plans import settings as S

STATUS = "condicion_localizacion"
PLACE = "tipo_de_lugar_de_la_localizacion"


def with_age_band(df: DataFrame, age: str = "edad") -> DataFrame:
    return df.withColumn("grupo_edad", restrict_levels(band(F.col(age), S.AGE_BANDS), S.AGE_LEVELS))


def with_status_levels(df: DataFrame, status: str = STATUS) -> DataFrame:
    return df.withColumn(status, restrict_levels(F.col(status), S.STATUS_LEVELS))


def with_age_order(df: DataFrame) -> DataFrame:
    return df.withColumn("order_edad", level_position(F.col("grupo_edad"), S.AGE_LEVELS))


def cases_per_year(registry: DataFrame) -> DataFrame:
    """Cases per year, the early years in one bucket; other years are left out."""
    bucket = year_bucket(F.col("year_desaparicion"), *S.EARLY_YEARS, S.EARLY_LABEL, S.SINGLE_YEARS)
    bucketed = registry.select(bucket.alias("year_desaparicion"))
    return drop_null_rows(group_count(bucketed, ["year_desaparicion"]))


def profile_by_age(registry: DataFrame, by_status: bool = False) -> DataFrame:
    """Cases by sex (and status) and age band, with the share in sex (and status).

    Cases without a band count in the denominator and are then left out.
    """
    banded = with_age_band(registry)
    keys = ["sexo", "grupo_edad"]
    if by_status:
        banded = with_status_levels(banded)
        keys.insert(1, STATUS)
    shares = with_age_order(share_table(banded, keys, nulls="after", digits=1))
    return shares.withColumn("label", share_label(F.col("per")))


def _composition(registry: DataFrame, keys: list[str], with_total: bool) -> DataFrame:
    """Whole percents of the known values, largest first, with a display label."""
    shares = share_table(registry, keys, nulls="before", digits=0)
    total = F.col("total") if with_total else None
    labelled = shares.withColumn("label", category_label(F.col(keys[-1]), F.col("per"), total))
    return sort_descending(labelled, "per", keys)


def schooling_shares(registry: DataFrame, by_status: bool = False) -> DataFrame:
    if not by_status:
        return _composition(registry, ["escolaridad"], with_total=True)
    return _composition(with_status_levels(registry), [STATUS, "escolaridad"], with_total=True)


def marital_shares(registry: DataFrame) -> DataFrame:
    return _composition(registry, ["sexo", "estado_civil"], with_total=False)


def mean_days_to_location(registry: DataFrame) -> DataFrame:
    """Mean of disappearance minus location date, in days, for closed cases."""
    closed = registry.where(differs(F.col(STATUS), S.MISSING))
    days = days_between(F.col("fecha_de_desaparicion"), F.col("fecha_de_localizacion"))
    return closed.groupBy("sexo", STATUS).agg(mean_known(days).alias("mean"))


def place_found(registry: DataFrame, status: str) -> DataFrame:
    """Where persons of one status were found: share of each known place."""
    found = registry.where(equals(F.col(STATUS), status))
    shares = share_table(found, [PLACE], nulls="before", digits=2)
    ordered = order_by_value(shares, PLACE, "per")
    return ordered.withColumn("label", share_label(F.col("per")))
