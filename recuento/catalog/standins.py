"""Registry, census, projection and polygon tables derived from the given tables.

The given tables hold no registry, so each role is played by whole tables: the
orders are the cases, the customers the census persons and the projection, the
lines the national counts, the embeddings the polygons. The expressions below
only make *input*; they are plain SQL that both engines read the same way. The
category terms are invented.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from recuento.catalog.base import literal, table, values_sql
from recuento.operators.dictionary import small_table
from recuento.plans import settings as S

_DAY = "(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 7200 END)"
_FOUND = f"({_DAY} + CAST(o_orderkey % 60 AS INT))"
_PLACE = "(o_custkey % 27)"

# Every spelling that is replaced occurs; two of them are in the catalog, see GEO_CATALOG.
_OTHER_MUNICIPALITIES = "".join(
    f"WHEN {place} THEN {literal(raw)} "
    for place, raw in enumerate(
        [raw for raw, _ in S.DECEMBER_MUNICIPALITIES if raw not in ("alvaro obregon", "coyoacan")], 12
    )
)


def _replaced(column: str) -> list[str]:
    return [raw for raw, _ in S.JULY_REPLACEMENTS[column]]


@dataclass(frozen=True)
class Dialect:
    """How one engine formats a date and takes the n-th of a few texts."""

    dates: dict[str, str]
    format_date: str
    pick_one: str

    def dmy(self, day: str, shape: str) -> str:
        return self.format_date.format(day=day, shape=self.dates[shape])

    def pick(self, x: str, *values: str | None) -> str:
        listed = ", ".join(literal(v) for v in values)
        return self.pick_one.format(values=listed, place=f"CAST(({x}) % {len(values)} AS INT) + 1")


SPARK = Dialect(
    {"d/m/y": "d/M/yyyy", "dd/mm/yyyy": "dd/MM/yyyy", "dd-mm-yy": "dd-MM-yy"},
    "date_format({day}, '{shape}')",
    "element_at(array({values}), {place})",
)
DUCKDB = Dialect(
    {"d/m/y": "%-d/%-m/%Y", "dd/mm/yyyy": "%d/%m/%Y", "dd-mm-yy": "%d-%m-%y"},
    "strftime({day}, '{shape}')",
    "[{values}][{place}]",
)


def december_columns(sql: Dialect) -> tuple:
    """(header as delivered, clean name, expression)"""
    return (
        ("ID", "id", "o_orderkey"),
        (
            "Fecha de inicio de reporte en la CBPCDMX",
            "fecha_de_inicio_de_reporte_en_la_cbpcdmx",
            sql.dmy(f"({_DAY} + 2)", "d/m/y"),
        ),
        ("Fuente de Reporte", "fuente_de_reporte", sql.pick("o_orderkey", "Noticia", "Reporte", "REPORTE", None)),
        (
            "Origen de la Noticia",
            "origen_de_la_noticia",
            sql.pick(
                "o_orderkey",
                "Portal Web",
                "oficina central",
                "Oficina Distrital",
                "colectivo norte",
                "Asociación Vecinal",
                "PENDIENTE",
                "radio local",
                None,
                "portal web",
            ),
        ),
        ("Sexo", "sexo", "CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Hombre' ELSE 'MUJER' END"),
        ("Edad", "edad", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 95 AS INT) END"),
        ("Lugar de Nacimiento", "lugar_de_nacimiento", sql.pick("o_custkey", "Puebla", "Ciudad de Mexico", None)),
        ("Nacionalidad", "nacionalidad", "'Mexicana'"),
        (
            "Escolaridad",
            "escolaridad",
            sql.pick(
                "o_custkey",
                "Primaria",
                "SECUNDARIA",
                "bachiller",
                "Prepa",
                "Licenciatura",
                "Maestro",
                "taller",
                "s/d",
                None,
                "Ninguna",
            ),
        ),
        ("Estado Civil", "estado_civil", sql.pick("o_orderkey", "Casada", "soltera", "Reservado", "viuda", None, "unido")),
        (
            "Parentesco (reportante)",
            "parentesco_reportante",
            sql.pick("o_custkey", "Mamá", "TIO", "esposo", "colega", "s/d", "sin relación", None),
        ),
        (
            "Fecha de desaparición",
            "fecha_de_desaparicion",
            f"CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 97 = 1 THEN '31/02/2019' "
            f"WHEN o_orderkey % 7 = 0 THEN {sql.dmy(_DAY, 'dd-mm-yy')} ELSE {sql.dmy(_DAY, 'dd/mm/yyyy')} END",
        ),
        (
            "Entidad de desaparición",
            "entidad_de_desaparicion",
            f"CASE {_PLACE} WHEN 26 THEN NULL WHEN 25 THEN 'Veracruz' ELSE "
            + sql.pick(_PLACE, "Africa", "America", "Ciudad de Mexico", "Mexico", "Middle East")
            + " END",
        ),
        (
            "Municipio/alcadía de la desaparición",
            "municipio_alcadia_de_la_desaparicion",
            f"CASE {_PLACE} WHEN 26 THEN NULL WHEN 2 THEN 'Alvaro Obregon' WHEN 7 THEN 'COYOACAN' {_OTHER_MUNICIPALITIES}"
            f"ELSE 'Nation_' || CAST({_PLACE} AS STRING) END",
        ),
        ("Colonia de la desaparición", "colonia_de_la_desaparicion", "'Colonia ' || CAST(o_custkey % 50 AS STRING)"),
        ("Circunstancias de la desaparición", "circunstancias_de_la_desaparicion", "o_orderpriority"),
        ("Estatus de localización", "estatus_de_localizacion", "o_orderstatus"),
        (
            "Condición localización",
            "condicion_localizacion",
            "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Sin Vida' ELSE 'Con vida' END",
        ),
        (
            "Fecha de localización",
            "fecha_de_localizacion",
            f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {sql.dmy(_FOUND, 'dd/mm/yyyy')} END",
        ),
        ("Estado de salud", "estado_de_salud", sql.pick("o_orderkey", "Bueno", "enferma", "con lesiones", None)),
        ("Constancia de localización", "constancia_de_localizacion", sql.pick("o_custkey", "Sí", "No")),
        (
            "Municipio/alcaldía de la localización",
            "municipio_alcaldia_de_la_localizacion",
            sql.pick("o_custkey", "Norte", "Sur", None),
        ),
        (
            "Tipo de lugar de la localización",
            "tipo_de_lugar_de_la_localizacion",
            sql.pick(
                "o_custkey",
                "Su Casa",
                "casa de amiga",
                "Clinica",
                "servicio forense",
                "vía pública",
                None,
                "camión",
                "mp",
            ),
        ),
        ("Motivo referido de desaparición", "motivo_referido_de_desaparicion", sql.pick("o_orderkey", "Ausencia", "Otro")),
    )

DECEMBER_NAMES = tuple(name for _, name, _ in december_columns(SPARK))

DECEMBER_VOCABULARY = (
    ("origen_de_la_noticia", "oficina central", "autoridades en general", 1),
    ("origen_de_la_noticia", "oficina distrital", "autoridades en general", 1),
    ("origen_de_la_noticia", "asociación vecinal", "sociedad civil y organismos internacionales", 2),
    ("origen_de_la_noticia", "colectivo norte", "colectivos de familiares", 3),
    ("origen_de_la_noticia", "portal web", "portal CNB", 8),
    ("origen_de_la_noticia", "portal web", "portal CNB", 8),
    ("origen_de_la_noticia", "pendiente", "no especificado", 9),
    ("origen_de_la_noticia", "RADIO LOCAL", "nunca coincide", 9),
    ("escolaridad", "bachiller", "preparatoria", 1),
    ("escolaridad", "prepa", "preparatoria", 1),
    ("escolaridad", "taller", "profesional tecnico", 3),
    ("escolaridad", "taller", "otra", 2),
    ("escolaridad", "maestro", "posgrado", 4),
    ("escolaridad", "s/d", "no especificado", 5),
    ("estado_civil", "casada", "casado/a", 1),
    ("estado_civil", "soltera", "soltero/a", 3),
    ("estado_civil", "unido", "concubino/a", 4),
    ("estado_civil", "viuda", "viudo/a", 6),
    ("parentesco_reportante", "mamá", "familiar", 1),
    ("parentesco_reportante", "tio", "familiar", 1),
    ("parentesco_reportante", "esposo", "pareja o expareja", 2),
    ("parentesco_reportante", "colega", "otros", 3),
    ("parentesco_reportante", "s/d", "no especificado", 4),
    ("estado_de_salud", "bueno", "buen estado de salud", 1),
    ("estado_de_salud", "enferma", "mal estado sin violencia", 2),
    ("tipo_de_lugar_de_la_localizacion", "camión", "a bordo de un vehículo", 1),
    ("tipo_de_lugar_de_la_localizacion", "casa de amiga", "en casa de amigo o familiar", 2),
    ("tipo_de_lugar_de_la_localizacion", "su casa", "domicilio de la persona", 3),
    ("tipo_de_lugar_de_la_localizacion", "mp", "agencia del ministerio público", 4),
    ("tipo_de_lugar_de_la_localizacion", "clinica", "en centro de salud u hospital", 6),
)

def july_columns(sql: Dialect) -> tuple:
    """(name, expression)"""
    return (
        ("id", "CAST(CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey END AS STRING)"),
        ("fecha_de_inicio_de_reporte_en_la_cbpcdmx", "o_orderdate + INTERVAL 20 YEAR"),
        ("fuente_de_reporte", sql.pick("o_orderkey", "noticia", "reporte", "reporte", None)),
        (
            "origen_de_la_noticia",
            sql.pick(
                "o_orderkey",
                "portal web",
                "oficina central",
                "oficina distrital",
                "colectivo norte",
                "asociación vecinal",
                "radio local",
                None,
            ),
        ),
        ("sexo", "CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'hombre' ELSE 'mujer' END"),
        ("edad", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 95 AS INT) END"),
        ("lugar_de_nacimiento", sql.pick("o_custkey", *_replaced("lugar_de_nacimiento"), None, "oaxaca")),
        ("nacionalidad", "'mexicana'"),
        (
            "escolaridad",
            sql.pick("o_custkey", "primaria", "secundaria", "bachiller", "prepa", "licenciatura", "maestro", None),
        ),
        ("estado_civil", sql.pick("o_orderkey", "divorciado", "soltero(a)", None)),
        ("parentesco_reportante", sql.pick("o_custkey", "mamá", "tio", "esposo", "colega", "sin relación", None)),
        (
            "fecha_de_desaparicion",
            "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate + INTERVAL 20 YEAR END",
        ),
        (
            "entidad_de_desaparicion",
            sql.pick("o_custkey", "ciudad de mexico", "estado de mexico", "veracruz de ignacio de la llave", None),
        ),
        ("municipio_alcadia_de_la_desaparicion", sql.pick("o_custkey", "alvaro obregon", "tlalpan", "azcapotzalco")),
        ("colonia_de_la_desaparicion", "'colonia ' || CAST(o_custkey % 50 AS STRING)"),
        ("circunstancias_de_la_desaparicion", "o_orderpriority"),
        ("estatus_de_localizacion", "o_orderstatus"),
        (
            "condicion_localizacion",
            "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'sin vida' ELSE 'con vida' END",
        ),
        (
            "fecha_de_localizacion",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 21 YEAR END",
        ),
        ("estado_de_salud", sql.pick("o_orderkey", "buen estado general", "con lesiones", None)),
        ("constancia_de_localizacion", sql.pick("o_custkey", "sí", "no")),
        ("municipio_alcaldia_de_la_localizacion", sql.pick("o_custkey", "ecatepec", "tlalnepantla", "norte", None)),
        (
            "tipo_de_lugar_de_la_localizacion",
            sql.pick("o_custkey", "su casa", "casa de amiga", "vía pública", None, "camión"),
        ),
        ("motivo_referido_de_desaparicion", sql.pick("o_orderkey", "ausencia", "otro")),
        (
            "clave_municipio",
            f"CASE WHEN {_PLACE} = 26 THEN NULL WHEN {_PLACE} = 25 THEN '12345' "
            f"ELSE CAST({_PLACE} + 1 AS STRING) END",
        ),
        ("clave_colonia", "CAST(o_custkey % 50 AS STRING)"),
        ("delito_del_que_fue_victima", sql.pick("o_orderkey", "NINGUNO", "robo simple", "hurto", None, "otro delito")),
    )

JULY_VOCABULARY = (
    ("origen_de_la_noticia", "oficina central", "autoridades en general", 1),
    ("origen_de_la_noticia", "oficina distrital", "autoridades en general", 1),
    ("origen_de_la_noticia", "asociación vecinal", "sociedad civil y organismos internacionales", 2),
    ("origen_de_la_noticia", "colectivo norte", "colectivos de familiares", 3),
    ("origen_de_la_noticia", "portal web", "portal comision búsqueda cdmx", 8),
    ("escolaridad", "bachiller", "preparatoria", 1),
    ("escolaridad", "prepa", "preparatoria", 1),
    ("escolaridad", "maestro", "posgrado", 4),
    ("parentesco_reportante", "mamá", "familiar", 1),
    ("parentesco_reportante", "tio", "familiar", 1),
    ("parentesco_reportante", "esposo", "pareja o expareja", 2),
    ("parentesco_reportante", "colega", "otros", 3),
    ("tipo_de_lugar_de_la_localizacion", "camión", "a bordo de un vehículo", 1),
    ("tipo_de_lugar_de_la_localizacion", "casa de amiga", "en casa de amigo o familiar", 2),
    ("tipo_de_lugar_de_la_localizacion", "su casa", "domicilio de la persona", 3),
    ("delito_del_que_fue_victima", "NINGUNO", "ninguno", 1),
    ("delito_del_que_fue_victima", "robo simple", "robo", 2),
    ("delito_del_que_fue_victima", "hurto", "robo", 2),
)

VOCABULARY_COLUMNS = ("field", "raw", "canonical", "priority")

# Geo catalog from nation and region; one row without names.
GEO_CATALOG = (
    ("id_ent", "lpad(CAST(r_regionkey + 7 AS STRING), 2, '0')"),
    (
        "name_ent",
        "CASE WHEN n_nationkey = 24 THEN NULL WHEN r_name = 'ASIA' THEN 'Distrito Federal' "
        "WHEN r_name = 'EUROPE' THEN 'México' ELSE r_name END",
    ),
    ("name_ent_short", "substr(r_name, 1, 3)"),
    ("id_mun", "lpad(CAST(n_nationkey + 1 AS STRING), 3, '0')"),
    (
        "name_mun",
        "CASE n_nationkey WHEN 24 THEN NULL WHEN 2 THEN 'Álvaro Obregón' WHEN 7 THEN 'Coyoacán' ELSE n_name END",
    ),
)

CENSUS_PERSONS = (
    ("ENT", "lpad(CAST(c_nationkey % 5 + 7 AS STRING), 2, '0')"),
    ("ID_PERSONA", "CAST(c_custkey AS STRING)"),
    ("FACTOR", "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_custkey % 7 + 1 AS INT) END"),
    ("NUMPER", "CAST(c_custkey % 6 + 1 AS INT)"),
    ("SEXO", "CASE WHEN c_custkey % 17 = 0 THEN 9 WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END"),
    ("EDAD", "CASE WHEN c_custkey % 31 = 0 THEN 9999 ELSE CAST(c_custkey * 3 % 100 AS INT) END"),
    (
        "NIVACAD",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 16 AS STRING), 2, '0') END",
    ),
)

def projection_columns(sql: Dialect) -> tuple:
    return (
        ("NOM_ENT", "CASE WHEN c_nationkey % 3 = 0 THEN 'Otro Estado' ELSE 'Ciudad de MÈxico' END"),
        ("A—O", "CAST(2019 + (c_custkey % 7) % 4 AS INT)"),
        ("CLAVE_ENT", "9"),
        (
            "MUN",
            sql.pick(
                "c_custkey",
                "¡lvaro ObregÛn",
                "Azcapotzalco",
                "Benito Ju·rez",
                "Coyoac·n",
                "Cuajimalpa de Morelos",
                "CuauhtÈmoc",
                "Gustavo A. Madero",
                "Iztacalco",
                "Iztapalapa",
                "La Magdalena Contreras",
                "Miguel Hidalgo",
                "Milpa Alta",
                "Tlalpan",
                "Tl·huac",
                "Venustiano Carranza",
                "Xochimilco",
                "Otro Municipio",
            ),
        ),
        (
            "POB",
            "CASE WHEN c_custkey % 17 = 5 AND c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 1000 + 5000 AS INT) END",
        ),
    )

NATIONAL_COUNTS = (
    (
        "condicion_actual_de_las_personas",
        "CASE l_returnflag WHEN 'A' THEN 'LOCALIZADAS CON VIDA' WHEN 'R' THEN 'LOCALIZADAS SIN VIDA' "
        "ELSE 'DESAPARECIDAS Y NO LOCALIZADAS' END",
    ),
    ("edad", "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(l_quantity AS INT) * 2 - 5 END"),
    ("hombres", "l_linenumber"),
    ("mujeres", "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 4 AS INT) END"),
)

_REGION = "CASE WHEN vec_id < 999 THEN lpad(CAST(vec_id + 1 AS STRING), 3, '0') ELSE CAST(vec_id + 1 AS STRING) END"


def december_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS `{header}`" for header, _, e in december_columns(SPARK)])


def july_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS `{name}`" for name, e in july_columns(SPARK)])


def vocabulary(spark: SparkSession, rows: tuple) -> DataFrame:
    return small_table(spark, rows, VOCABULARY_COLUMNS)


def geo_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return both.selectExpr(*[f"{e} AS {name}" for name, e in GEO_CATALOG])


def census_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {name}" for name, e in CENSUS_PERSONS])


def population_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS `{name}`" for name, e in projection_columns(SPARK)])


def national_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {name}" for name, e in NATIONAL_COUNTS])


def region_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a ring with whole coordinates, a point for each two numbers."""
    rings = table(spark, sf_dir, "embeddings").selectExpr(
        f"'09' || {_REGION} AS CVEGEO",
        f"{_REGION} AS CVE_MUN",
        "posexplode(transform(if(size(embedding) > 1, sequence(0, size(embedding) div 2 - 1), array()), i -> struct("
        "cast(floor(cast(embedding[2 * i] as double) * 1000) as bigint) AS x, "
        "cast(floor(cast(embedding[2 * i + 1] as double) * 1000) as bigint) AS y))) AS (pos, p)",
    )
    return rings.selectExpr("CVEGEO", "CVE_MUN", "0 AS ring_id", "pos", "p.x AS x", "p.y AS y")


def _select(columns, source: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{name}"' for name, e in columns) + f" FROM {source}"


def vocabulary_sql(rows: tuple) -> str:
    """Terms with the winning category, as ``(field, raw, canonical)``."""
    return (
        "SELECT field, raw, canonical FROM (SELECT *, row_number() OVER (PARTITION BY field, raw "
        f"ORDER BY priority, canonical) AS place FROM {values_sql(rows, VOCABULARY_COLUMNS)}) WHERE place = 1"
    )


DECEMBER_RAW_SQL = _select([(name, e) for _, name, e in december_columns(DUCKDB)], "orders")
JULY_RAW_SQL = _select(july_columns(DUCKDB), "orders")
GEO_CATALOG_SQL = _select(GEO_CATALOG, "nation JOIN region ON n_regionkey = r_regionkey")
CENSUS_SQL = _select(CENSUS_PERSONS, "customer")
PROJECTION_SQL = _select(projection_columns(DUCKDB), "customer")
NATIONAL_SQL = _select(NATIONAL_COUNTS, "lineitem")
VERTICES_SQL = (
    f"SELECT '09' || {_REGION} AS CVEGEO, {_REGION} AS CVE_MUN, i AS pos, "
    "CAST(floor(CAST(embedding[2 * i + 1] AS DOUBLE) * 1000) AS BIGINT) AS x, "
    "CAST(floor(CAST(embedding[2 * i + 2] AS DOUBLE) * 1000) AS BIGINT) AS y "
    "FROM (SELECT *, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)"
)
