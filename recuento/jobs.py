"""The stages of the analysis as jobs that read and write tables.

Each stage reads the snapshots of the one before, so a stage can run again on
its own. ``out`` is a folder that all executors can reach; every table is a
Parquet folder in it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recuento.operators.joins import assert_unique
from recuento.operators.profiling import profile_columns
from recuento.plans import census, descriptives, narrative, rates, regions, registry
from recuento.plans import settings as S
from recuento.session import materialize, stored_tables
from recuento.sources import files, schemas

DECEMBER, JULY, PUBLISHED, PROFILE = "registry_december", "registry_july", "registry_published", "registry_profile"
PERSONS = "census_persons"
AGES_NATION, AGES_STATE, SCHOOLING = "census_ages_national", "census_ages_state", "census_schooling_state"


def _write(tables: Mapping[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        files.write_snapshot(df, f"{out}/{name}")


def _landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str, name: str) -> DataFrame:
    """A delivery; text is parsed once and stored, as a file of quoted text is read by one task."""
    df = files.read_delivery(spark, path, schema, fmt=fmt)
    return materialize(df, name) if fmt == "csv" else df


def stage(run: Callable) -> Callable:
    """A job that leaves nothing behind but its tables."""

    @wraps(run)
    def call(spark: SparkSession, *args, **options) -> None:
        with stored_tables(spark):
            run(spark, *args, **options)

    return call


@stage
def profile_delivery(spark: SparkSession, delivery: str, out: str, *, fmt: str = "parquet") -> None:
    """Data profile of a delivery before it is cleaned."""
    _write({PROFILE: profile_columns(_landed(spark, delivery, schemas.REGISTRY_RAW, fmt, "delivery"))}, out)


@stage
def import_december(
    spark: SparkSession, delivery: str, vocabulary: str, catalog: str, out: str, *, fmt: str = "parquet"
) -> None:
    """Clean the delivery with text dates; write the snapshot and the public CSV.

    The CSV is written from the snapshot, so the registry is cleaned once.
    """
    raw = _landed(spark, delivery, schemas.REGISTRY_RAW, fmt, "delivery")
    geo = files.read_csv(spark, catalog, schemas.GEO_CATALOG)
    assert_unique(registry.prepare_catalog(geo), ["name_ent", "name_mun"], "geo catalog")
    _write({DECEMBER: registry.clean_december(raw, files.read_vocabulary(spark, vocabulary), geo)}, out)
    files.write_published_csv(files.read_snapshot(spark, f"{out}/{DECEMBER}"), f"{out}/{PUBLISHED}")


@stage
def import_july(
    spark: SparkSession, delivery: str, vocabulary: str, out: str, *, fmt: str = "parquet"
) -> None:
    """Clean the delivery with typed dates."""
    raw = _landed(spark, delivery, schemas.REGISTRY_RAW_TYPED, fmt, "delivery")
    _write({JULY: registry.clean_july(raw, files.read_vocabulary(spark, vocabulary))}, out)


@stage
def census_tables(spark: SparkSession, folder: str, out: str, *, name_pattern: str = "*Personas*") -> None:
    """Census aggregates from the Latin-1 person files of a folder.

    The seven columns are landed as Parquet by state first, so the text is
    parsed once and the state tables read one partition.
    """
    columns = {f.name: f.dataType for f in schemas.CENSUS_PERSONS.fields}
    persons = files.read_csv_columns(spark, folder, columns, encoding="ISO-8859-1", name_pattern=name_pattern)
    files.write_snapshot(persons, f"{out}/{PERSONS}", partition_by=["ENT"])
    landed = spark.read.schema(schemas.CENSUS_PERSONS).parquet(f"{out}/{PERSONS}")
    _write(
        {
            AGES_NATION: census.census_ages(landed),
            AGES_STATE: census.census_ages(landed, S.STATE_CODE),
            SCHOOLING: census.census_schooling(landed),
        },
        out,
    )


@stage
def descriptive_tables(spark: SparkSession, out: str) -> None:
    """Tables of the descriptive figures, from the December snapshot."""
    cases = files.read_snapshot(spark, f"{out}/{DECEMBER}")
    schooling = files.read_snapshot(spark, f"{out}/{SCHOOLING}")
    _write(
        {
            "cases_per_year": descriptives.cases_per_year(cases),
            "profile_sex_age": descriptives.profile_by_age(cases),
            "profile_sex_status_age": descriptives.profile_by_age(cases, by_status=True),
            "census_schooling_share": census.census_schooling_share(schooling),
            "schooling_share": descriptives.schooling_shares(cases),
            "schooling_share_by_status": descriptives.schooling_shares(cases, by_status=True),
            "marital_share_by_sex": descriptives.marital_shares(cases),
            "mean_days_to_location": descriptives.mean_days_to_location(cases),
            "place_found_alive": descriptives.place_found(cases, S.ALIVE),
            "place_found_dead": descriptives.place_found(cases, S.DEAD),
        },
        out,
    )


@stage
def rate_tables(spark: SparkSession, national: str, out: str, *, fmt: str = "parquet") -> None:
    """City and national rates, with and without status, and the population shares."""
    cases = files.read_snapshot(spark, f"{out}/{DECEMBER}")
    state = files.read_snapshot(spark, f"{out}/{AGES_STATE}")
    nation = files.read_snapshot(spark, f"{out}/{AGES_NATION}")
    counts = files.read_delivery(spark, national, schemas.NATIONAL_COUNTS, fmt=fmt)
    _write(
        {
            "population_share": census.population_share(state),
            "city_rates": rates.city_rates(cases, state),
            "city_rates_by_status": rates.city_rates(cases, state, by_status=True),
            "national_rates": rates.national_rates(counts, nation),
            "national_rates_by_status": rates.national_rates(counts, nation, by_status=True),
        },
        out,
    )


@stage
def region_tables(
    spark: SparkSession, projection: str, vertices: str, out: str, *, vertices_fmt: str = "parquet"
) -> None:
    """Municipal population, cases and the map table, from the December snapshot."""
    cases = files.read_snapshot(spark, f"{out}/{DECEMBER}")
    people = files.read_csv(spark, projection, schemas.POPULATION_PROJECTION)
    _write(
        {
            "population_by_municipality": census.population_by_municipality(people),
            "cases_per_municipality": regions.cases_per_municipality(cases),
        },
        out,
    )
    _write(
        {
            "municipal_map": regions.map_table(
                files.read_vertices(spark, vertices, fmt=vertices_fmt),
                files.read_snapshot(spark, f"{out}/population_by_municipality"),
                files.read_snapshot(spark, f"{out}/cases_per_municipality"),
            )
        },
        out,
    )


@stage
def report_figures(spark: SparkSession, national: str, out: str, *, fmt: str = "parquet") -> None:
    """The figures quoted in the report, from the July snapshot."""
    cases = files.read_snapshot(spark, f"{out}/{JULY}")
    counts = files.read_delivery(spark, national, schemas.NATIONAL_COUNTS, fmt=fmt)
    _write({"report_figures": narrative.narrative_metrics(cases, counts)}, out)
