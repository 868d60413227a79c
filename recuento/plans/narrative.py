"""The figures quoted in the report text, as one table ``(name, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.categories import replace_values
from recuento.functions.numbers import round_even
from recuento.functions.predicates import differs, equals
from recuento.operators.counting import distinct_count
from recuento.operators.dictionary import small_table
from recuento.operators.joins import lookup_join
from recuento.operators.shares import add_share, top_share
from recuento.plans import settings as S
from recuento.plans.descriptives import STATUS, with_age_band, with_status_levels
from recuento.plans.rates import NATIONAL_STATUS, national_long
from recuento.session import materialize

SOURCE, ORIGIN, BY_STATUS, YEAR, MUNICIPALITY = "source", "origin", "status", "year", "municipality"
CITY, CITY_STATUS, NATION, NATION_STATUS, SCHOOLING = (
    "city age",
    "city status age",
    "nation age",
    "nation status age",
    "schooling",
)

BAND_12, BAND_18, BAND_24, BAND_30, BAND_45, BAND_60 = S.AGE_LEVELS[1:]

# The quoted shares as (name, table, sex, status, categories added up).
QUOTED_SHARES = (
    ("report_source_news", SOURCE, None, None, ["noticia"]),
    ("report_source_report", SOURCE, None, None, ["reporte"]),
    ("origin_portal", ORIGIN, None, None, ["portal comision búsqueda cdmx"]),
    ("origin_authorities", ORIGIN, None, None, ["autoridades en general"]),
    ("origin_family_groups", ORIGIN, None, None, ["colectivos de familiares"]),
    ("origin_civil_society", ORIGIN, None, None, ["sociedad civil y organismos internacionales"]),
    ("status_alive", BY_STATUS, None, None, [S.ALIVE]),
    ("status_dead", BY_STATUS, None, None, [S.DEAD]),
    ("status_missing", BY_STATUS, None, None, [S.MISSING]),
    ("year_2020", YEAR, None, None, ["2020"]),
    ("year_2021", YEAR, None, None, ["2021"]),
    ("nation_men_30_44", NATION, S.MAN, None, [BAND_30]),
    ("nation_men_18_44", NATION, S.MAN, None, [BAND_18, BAND_24, BAND_30]),
    ("nation_women_12_17", NATION, S.WOMAN, None, [BAND_12]),
    ("nation_women_12_23", NATION, S.WOMAN, None, [BAND_12, BAND_18]),
    ("city_men_30_44", CITY, S.MAN, None, [BAND_30]),
    ("city_men_30_up", CITY, S.MAN, None, [BAND_30, BAND_45, BAND_60]),
    ("city_women_12_17", CITY, S.WOMAN, None, [BAND_12]),
    ("city_women_12_23_30_44", CITY, S.WOMAN, None, [BAND_12, BAND_18, BAND_30]),
    ("nation_women_dead_18_44", NATION_STATUS, S.WOMAN, S.DEAD, [BAND_18, BAND_24, BAND_30]),
    ("nation_women_missing_12_17", NATION_STATUS, S.WOMAN, S.MISSING, [BAND_12]),
    ("city_women_dead_18_23_30_up", CITY_STATUS, S.WOMAN, S.DEAD, [BAND_18, BAND_30, BAND_45, BAND_60]),
    ("city_women_missing_18_23", CITY_STATUS, S.WOMAN, S.MISSING, [BAND_18]),
    ("schooling_men_alive_secondary", SCHOOLING, S.MAN, S.ALIVE, ["secundaria"]),
    ("schooling_men_alive_high_school", SCHOOLING, S.MAN, S.ALIVE, ["preparatoria"]),
    ("schooling_women_alive_high_school", SCHOOLING, S.WOMAN, S.ALIVE, ["preparatoria"]),
    ("schooling_women_alive_secondary", SCHOOLING, S.WOMAN, S.ALIVE, ["secundaria"]),
    ("schooling_men_dead_secondary", SCHOOLING, S.MAN, S.DEAD, ["secundaria"]),
    ("schooling_men_dead_degree", SCHOOLING, S.MAN, S.DEAD, ["licenciatura"]),
    ("schooling_women_dead_degree", SCHOOLING, S.WOMAN, S.DEAD, ["licenciatura"]),
    ("schooling_women_dead_high_school", SCHOOLING, S.WOMAN, S.DEAD, ["preparatoria"]),
    ("schooling_men_missing_secondary", SCHOOLING, S.MAN, S.MISSING, ["secundaria"]),
    ("schooling_men_missing_primary", SCHOOLING, S.MAN, S.MISSING, ["primaria"]),
    ("schooling_women_missing_high_school", SCHOOLING, S.WOMAN, S.MISSING, ["preparatoria"]),
    ("schooling_women_missing_secondary", SCHOOLING, S.WOMAN, S.MISSING, ["secundaria"]),
)

SCOPE = ["table", "sex", "status"]


def _registry_counts(registry: DataFrame, code: str) -> DataFrame:
    """Counts of every quoted table, ``(table, sex, status, category, total)``.

    All groupings come from one scan by grouping sets; each is small, so the
    partial counts leave little to shuffle.
    """
    cases = registry.select(
        F.col("fuente_de_reporte").alias("source"),
        F.col("origen_de_la_noticia").alias("origin"),
        F.col(STATUS).alias("any_status"),
        F.col("año_desaparicion").cast("string").alias("year"),
        F.col(code).alias("municipality"),
        F.col("sexo").alias("sex"),
        F.col("edad"),
        F.col(STATUS),
        F.col("escolaridad").alias("schooling"),
    )
    cases = with_status_levels(with_age_band(cases))
    columns = ["source", "origin", "any_status", "year", "municipality", "sex", STATUS, "schooling", "grupo_edad"]
    tables = {
        SOURCE: ["source"],
        ORIGIN: ["origin"],
        BY_STATUS: ["any_status"],
        YEAR: ["year"],
        MUNICIPALITY: ["municipality"],
        CITY: ["sex", "grupo_edad"],
        CITY_STATUS: ["sex", STATUS, "grupo_edad"],
        SCHOOLING: ["sex", STATUS, "schooling"],
    }
    counts = cases.groupingSets([[F.col(k) for k in keys] for keys in tables.values()], *columns).agg(
        F.grouping_id().alias("__set"), F.count("*").alias("total")
    )
    table = F.lit(None).cast("string")
    category = F.lit(None).cast("string")
    for name, keys in tables.items():
        # A bit of the grouping id is set for each column that is not grouped by.
        number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        table = F.when(F.col("__set") == number, F.lit(name)).otherwise(table)
        category = F.when(F.col("__set") == number, F.col(keys[-1])).otherwise(category)
    return counts.select(
        table.alias("table"), "sex", F.col(STATUS).alias("status"), category.alias("category"), "total"
    )


def _national_counts(national: DataFrame) -> DataFrame:
    """The national tables in the same form, ``(table, sex, status, category, total)``."""
    status = replace_values(F.col(NATIONAL_STATUS), S.NATIONAL_STATUS)
    long = with_status_levels(national_long(national).withColumn(STATUS, status))
    overall = long.select(
        F.lit(NATION).alias("table"),
        F.col("sexo").alias("sex"),
        F.lit(None).cast("string").alias("status"),
        F.col("grupo_edad").alias("category"),
        "total",
    )
    by_status = long.select(
        F.lit(NATION_STATUS).alias("table"),
        F.col("sexo").alias("sex"),
        F.col(STATUS).alias("status"),
        F.col("grupo_edad").alias("category"),
        "total",
    )
    return overall.unionByName(by_status).groupBy(*SCOPE, "category").agg(F.sum("total").alias("total"))


def _quoted(counts: DataFrame) -> DataFrame:
    """The quoted shares: rounded per category, then added up."""
    complete = F.col("sex").isNotNull() & F.col("status").isNotNull() & F.col("category").isNotNull()
    countable = counts.where((F.col("table") != SCHOOLING) | complete)
    shares = add_share(countable, SCOPE, nulls="keep", digits=None)
    whole = F.when(F.col("table") == SCHOOLING, round_even(F.col("per"), 0)).otherwise(round_even(F.col("per"), 1))
    shares = shares.select(*SCOPE, "category", whole.cast("decimal(18,2)").alias("per"))
    wanted = small_table(
        counts.sparkSession,
        [(name, table, sex, status, c) for name, table, sex, status, cats in QUOTED_SHARES for c in cats],
        ["name", *SCOPE, "category"],
    )
    matched = lookup_join(wanted, shares, [*SCOPE, "category"])
    return matched.groupBy("name").agg(F.sum("per").cast("double").alias("value"))


def narrative_metrics(registry: DataFrame, national: DataFrame, code: str = "clave_municipio_desp") -> DataFrame:
    """All quoted figures; one without any matching rows is NULL.

    ``registry`` is the clean July table. The counts are stored once and every
    figure is read from them; only the distinct cases need a second scan.
    """
    counts = materialize(
        _registry_counts(registry, code).unionByName(_national_counts(national)), "narrative"
    )
    cases = distinct_count(registry, "id", "value").select(
        F.lit("distinct_cases").alias("name"), F.col("value").cast("double").alias("value")
    )
    located = (
        counts.where(equals(F.col("table"), BY_STATUS) & differs(F.col("category"), S.MISSING))
        .agg(F.sum("total").cast("double").alias("value"))
        .select(F.lit("located_total").alias("name"), "value")
    )
    municipalities = counts.where(equals(F.col("table"), MUNICIPALITY)).select("category", "total")
    top = top_share(municipalities, "total", 3).select(
        F.lit("top_3_municipalities").alias("name"), F.col("pct").alias("value")
    )
    return cases.unionByName(located).unionByName(_quoted(counts)).unionByName(top)
