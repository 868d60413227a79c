"""Clean registries from the two kinds of delivery.

Vocabularies come as a table ``(field, raw, canonical, priority)``. All steps
work row by row, with the terms as one small row of maps and one lookup of the
geo catalog, so cleaning needs no shuffle of the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.categories import KEEP, fill_missing, replace_values
from recuento.functions.dates import parse_dmy, year_of
from recuento.functions.text import pad_left, paste
from recuento.operators.columns import (
    cast_text,
    clean_names,
    drop_strict,
    lower_text_columns,
    mutate,
    rename,
    select_strict,
)
from recuento.operators.dictionary import recode_terms
from recuento.operators.joins import lookup_join
from recuento.plans import settings as S

DECEMBER_VOCABULARY_FIELDS = {
    "origen_de_la_noticia": KEEP,
    "escolaridad": KEEP,
    "estado_civil": KEEP,
    "parentesco_reportante": KEEP,
    "estado_de_salud": KEEP,
    "tipo_de_lugar_de_la_localizacion": KEEP,
}

JULY_VOCABULARY_FIELDS = {
    "origen_de_la_noticia": None,
    "escolaridad": KEEP,
    "parentesco_reportante": None,
    "tipo_de_lugar_de_la_localizacion": KEEP,
    "delito_del_que_fue_victima": KEEP,
}


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Geo catalog with lower-case names and today's name of the state."""
    lowered = mutate(
        catalog,
        {"name_mun": F.lower("name_mun"), "name_ent": F.lower("name_ent")},
        {"name_ent": replace_values(F.col("name_ent"), S.CATALOG_STATE_NAMES)},
    )
    return drop_strict(lowered, ["name_ent_short"])


def _parse_dates(df: DataFrame) -> DataFrame:
    """Dates and years. The parser takes slashes as well as dashes."""
    dates = ("fecha_de_inicio_de_reporte_en_la_cbpcdmx", "fecha_de_desaparicion", "fecha_de_localizacion")
    return mutate(
        df,
        {name: parse_dmy(F.col(name)) for name in dates},
        {
            "year_desaparicion": year_of(F.col("fecha_de_desaparicion")),
            "year_localizacion": year_of(F.col("fecha_de_localizacion")),
        },
    )


def clean_december(raw: DataFrame, vocabulary: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registry with text dates: 29 columns, with state and municipality codes.

    ``catalog`` is the geo catalog as delivered; it should hold one row per
    state and municipality (``assert_unique``).
    """
    df = lower_text_columns(_parse_dates(cast_text(clean_names(raw), ["id"])))
    df = mutate(
        df,
        {
            "condicion_localizacion": fill_missing(F.col("condicion_localizacion"), S.MISSING),
            "municipio_alcadia_de_la_desaparicion": replace_values(
                F.col("municipio_alcadia_de_la_desaparicion"), S.DECEMBER_MUNICIPALITIES
            ),
            "entidad_de_desaparicion": replace_values(F.col("entidad_de_desaparicion"), S.DECEMBER_STATES),
        },
    )
    df = recode_terms(df, vocabulary, DECEMBER_VOCABULARY_FIELDS)
    df = lookup_join(
        df,
        prepare_catalog(catalog).select("name_ent", "name_mun", "id_ent", "id_mun"),
        {"entidad_de_desaparicion": "name_ent", "municipio_alcadia_de_la_desaparicion": "name_mun"},
    )
    df = rename(df, {"cve_ent_desp": "id_ent", "cv_mun_desp": "id_mun"})
    df = df.withColumn("inegi", paste([F.col("cve_ent_desp"), F.col("cv_mun_desp")]))
    return select_strict(df, S.DECEMBER_COLUMNS)


def clean_july(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Registry with typed dates and delivered codes: 29 columns.

    The origin of the report and the kinship become NULL when the vocabulary
    does not list them; other values stay.
    """
    df = clean_names(raw)
    df = rename(df, {"clave_municipio_desp": "clave_municipio", "clave_colonia_desp": "clave_colonia"})
    df = mutate(
        df,
        {
            "año_desaparicion": year_of(F.col("fecha_de_desaparicion")),
            "año_localizacion": year_of(F.col("fecha_de_localizacion")),
            "clave_municipio_desp": pad_left(F.col("clave_municipio_desp"), 3),
            "condicion_localizacion": fill_missing(F.col("condicion_localizacion"), S.MISSING),
            **{name: replace_values(F.col(name), pairs) for name, pairs in S.JULY_REPLACEMENTS.items()},
        },
    )
    df = recode_terms(df, vocabulary, JULY_VOCABULARY_FIELDS)
    return select_strict(df, S.JULY_COLUMNS)
