"""The data products on the stand-in registry, census, projection and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from recuento.catalog import standins
from recuento.catalog.base import Query, band_sql, case_sql, literal, nearest_sql, position_sql, table
from recuento.operators import increments, profiling
from recuento.plans import census, descriptives, narrative, rates, regions, registry
from recuento.plans import settings as S
from recuento.session import materialize

QUERIES: list[Query] = []


def registered(sql: str | None):
    def keep(run):
        QUERIES.append(Query(run.__name__, run, sql))
        return run

    return keep


# --- comparison SQL of the stand-in tables ----------------------------------


def _recoded(raw: str, defaults: dict[str, str]) -> tuple[str, str]:
    """Select expressions and joins that recode columns of ``raw`` by vocabulary."""
    joined = " ".join(
        f"LEFT JOIN vocabulary v{i} ON v{i}.field = '{name}' AND v{i}.raw = {raw}.{name}"
        for i, name in enumerate(defaults)
    )
    columns = ", ".join(
        f"coalesce(v{i}.canonical, {default.format(raw=raw, name=name)}) AS {name}"
        for i, (name, default) in enumerate(defaults.items())
    )
    return columns, joined


_KEPT = "{raw}.{name}"
_DEC_COLUMNS, _DEC_JOINS = _recoded(
    "lowered",
    dict.fromkeys(
        [
            "origen_de_la_noticia",
            "escolaridad",
            "estado_civil",
            "parentesco_reportante",
            "estado_de_salud",
            "tipo_de_lugar_de_la_localizacion",
        ],
        _KEPT,
    ),
)
_DEC_TEXT = [name for name in standins.DECEMBER_NAMES if name not in ("id", "edad")]


def _date_sql(x: str) -> str:
    return f"CAST(try_strptime(replace({x}, '/', '-'), ['%d-%m-%y', '%d-%m-%Y']) AS DATE)"


DECEMBER = f"""
WITH raw AS ({standins.DECEMBER_RAW_SQL}),
lowered AS (SELECT CAST(id AS VARCHAR) AS id, edad, {", ".join(f"lower({n}) AS {n}" for n in _DEC_TEXT)} FROM raw),
vocabulary AS ({standins.vocabulary_sql(standins.DECEMBER_VOCABULARY)}),
catalog AS (SELECT id_ent, id_mun, lower(name_mun) AS name_mun,
  CASE lower(name_ent) WHEN 'distrito federal' THEN 'ciudad de méxico' ELSE lower(name_ent) END AS name_ent
  FROM ({standins.GEO_CATALOG_SQL})),
recoded AS (SELECT lowered.* REPLACE ({_DEC_COLUMNS},
  {_date_sql("fecha_de_inicio_de_reporte_en_la_cbpcdmx")} AS fecha_de_inicio_de_reporte_en_la_cbpcdmx,
  {_date_sql("fecha_de_desaparicion")} AS fecha_de_desaparicion,
  {_date_sql("fecha_de_localizacion")} AS fecha_de_localizacion,
  coalesce(condicion_localizacion, 'sigue desaparecida') AS condicion_localizacion,
  {case_sql("entidad_de_desaparicion", S.DECEMBER_STATES)} AS entidad_de_desaparicion,
  {case_sql("municipio_alcadia_de_la_desaparicion", S.DECEMBER_MUNICIPALITIES)} AS municipio_alcadia_de_la_desaparicion)
  FROM lowered {_DEC_JOINS}),
registry AS (SELECT recoded.*, id_ent AS cve_ent_desp, id_mun AS cv_mun_desp,
  coalesce(id_ent, 'NA') || coalesce(id_mun, 'NA') AS inegi,
  CAST(year(fecha_de_desaparicion) AS INTEGER) AS year_desaparicion,
  CAST(year(fecha_de_localizacion) AS INTEGER) AS year_localizacion
  FROM recoded LEFT JOIN catalog ON name_ent IS NOT DISTINCT FROM entidad_de_desaparicion
  AND name_mun IS NOT DISTINCT FROM municipio_alcadia_de_la_desaparicion)
"""

_JULY_COLUMNS, _JULY_JOINS = _recoded(
    "raw",
    {
        "origen_de_la_noticia": "NULL",
        "escolaridad": _KEPT,
        "parentesco_reportante": "NULL",
        "tipo_de_lugar_de_la_localizacion": _KEPT,
        "delito_del_que_fue_victima": _KEPT,
    },
)

JULY = f"""
WITH raw AS ({standins.JULY_RAW_SQL}),
vocabulary AS ({standins.vocabulary_sql(standins.JULY_VOCABULARY)}),
recoded AS (SELECT raw.* REPLACE ({_JULY_COLUMNS},
  coalesce(condicion_localizacion, 'sigue desaparecida') AS condicion_localizacion,
  {", ".join(f"{case_sql(name, pairs)} AS {name}" for name, pairs in S.JULY_REPLACEMENTS.items())}) FROM raw {_JULY_JOINS}),
registry AS (SELECT recoded.* EXCLUDE (clave_municipio, clave_colonia),
  CASE WHEN length(clave_municipio) < 3 THEN lpad(clave_municipio, 3, '0') ELSE clave_municipio END
    AS clave_municipio_desp, clave_colonia AS clave_colonia_desp,
  CAST(year(fecha_de_desaparicion) AS INTEGER) AS "año_desaparicion",
  CAST(year(fecha_de_localizacion) AS INTEGER) AS "año_localizacion" FROM recoded)
"""


def _columns(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _census_ages_sql(where: str = "") -> str:
    sex = "CASE SEXO WHEN 1 THEN 'Hombres' WHEN 3 THEN 'Mujeres' ELSE 'No especificado' END"
    return (
        f'SELECT "SEXO", grupo_edad, "EDAD", CAST(sum("EDAD") OVER (PARTITION BY "SEXO") AS BIGINT) AS pob, '
        "'Censo' AS fuente FROM (SELECT sx AS \"SEXO\", grupo_edad, CAST(coalesce(sum(FACTOR), 0) AS BIGINT) AS \"EDAD\" "
        f"FROM (SELECT {sex} AS sx, {band_sql('EDAD', S.AGE_BANDS)} AS grupo_edad, FACTOR FROM "
        f"({standins.CENSUS_SQL}) WHERE EDAD <> 9999 {where}) GROUP BY sx, grupo_edad)"
    )


CENSUS_NATION = _census_ages_sql()
CENSUS_STATE = _census_ages_sql("AND ENT = '09'")
_LEVELS = {code: level for level, codes in S.CENSUS_SCHOOLING.items() for code in codes}
SCHOOLING = (
    'SELECT level AS "NIVACAD", total, CAST(sum(total) OVER () AS BIGINT) AS pob, \'Censo\' AS fuente FROM ('
    "SELECT level, CAST(coalesce(sum(FACTOR), 0) AS BIGINT) AS total FROM (SELECT FACTOR, CASE WHEN NIVACAD IS NULL "
    f"THEN 'No aplica' ELSE {case_sql('NIVACAD', list(_LEVELS.items()), literal('No especificado'))} END AS level "
    f"FROM ({standins.CENSUS_SQL}) WHERE ENT = '09') WHERE level <> 'No aplica' GROUP BY level)"
)
_CODES = {
    name.encode("latin-1").decode("mac_roman"): code for name, code in S.MUNICIPALITY_CODES.items()
}
POPULATION = (
    'SELECT CLAVE_ENT AS "CLAVE_ENT", MUN AS "MUN", "A—O", CASE WHEN count(POB) = count(*) THEN '
    f'CAST(sum(POB) AS BIGINT) END AS total_poblacion, {case_sql("MUN", list(_CODES.items()), "NULL")} AS "CVEGEO" '
    f"FROM ({standins.PROJECTION_SQL}) WHERE NOM_ENT = 'Ciudad de MÈxico' AND \"A—O\" = 2021 "
    'GROUP BY CLAVE_ENT, MUN, "A—O"'
)


def _share(keys: list[str], nulls: str, digits: int, source: str = "registry", where: str = "") -> str:
    """Counts, scope total and rounded share of all keys but the last."""
    scope, names = ", ".join(keys[:-1]), ", ".join(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    conditions = [c for c in (where, known if nulls == "before" else "") if c]
    inner = f"WHERE {' AND '.join(conditions)}" if conditions else ""
    outer = f"WHERE {known}" if nulls == "after" else ""
    over = f"PARTITION BY {scope}" if scope else ""
    return (
        f"SELECT {names}, total, den, {nearest_sql('x', digits)} AS per FROM (SELECT *, "
        f"CAST(total AS DOUBLE) / CAST(den AS DOUBLE) * 100 AS x FROM (SELECT {names}, count(*) AS total, "
        f"CAST(sum(count(*)) OVER ({over}) AS BIGINT) AS den FROM {source} {inner} GROUP BY {names})) {outer}"
    )


BANDED = f"(SELECT *, {band_sql('edad', S.AGE_BANDS)} AS grupo_edad FROM registry)"
_AGE_ORDER = position_sql("grupo_edad", S.AGE_LEVELS)
_WHOLE = "CAST(CAST(per AS BIGINT) AS VARCHAR)"
_DECIMAL = "regexp_replace(CAST(per AS VARCHAR), '\\.0$', '')"


# --- registry ---------------------------------------------------------------


def december_registry(spark, sf_dir):
    return registry.clean_december(
        standins.december_raw(spark, sf_dir),
        standins.vocabulary(spark, standins.DECEMBER_VOCABULARY),
        standins.geo_catalog(spark, sf_dir),
    )


def july_registry(spark, sf_dir):
    return registry.clean_july(
        standins.july_raw(spark, sf_dir), standins.vocabulary(spark, standins.JULY_VOCABULARY)
    )


@registered(DECEMBER + f"SELECT {_columns(S.DECEMBER_COLUMNS)} FROM registry")
def registry_clean_december(spark, sf_dir):
    return december_registry(spark, sf_dir)


@registered(JULY + f"SELECT {_columns(S.JULY_COLUMNS)} FROM registry")
def registry_clean_july(spark, sf_dir):
    return july_registry(spark, sf_dir)


# --- census -----------------------------------------------------------------


@registered(CENSUS_NATION)
def census_ages_national(spark, sf_dir):
    return census.census_ages(standins.census_persons(spark, sf_dir))


@registered(CENSUS_STATE)
def census_ages_state(spark, sf_dir):
    return census.census_ages(standins.census_persons(spark, sf_dir), S.STATE_CODE)


@registered(SCHOOLING)
def census_schooling_state(spark, sf_dir):
    return census.census_schooling(standins.census_persons(spark, sf_dir))


@registered(
    f'SELECT *, "NIVACAD" || chr(10) || {_WHOLE} || \'% (\' || CAST(total AS VARCHAR) || \')\' AS label FROM ('
    f"SELECT *, {nearest_sql('CAST(total AS DOUBLE) / CAST(pob AS DOUBLE) * 100', 0)} AS per FROM ({SCHOOLING}))"
)
def census_schooling_share(spark, sf_dir):
    return census.census_schooling_share(census_schooling_state(spark, sf_dir))


@registered(
    'SELECT "SEXO" AS sexo, grupo_edad, "EDAD" AS total_poblacion, pob AS pob_censo, fuente, '
    f'CAST("EDAD" AS DOUBLE) / CAST(pob AS DOUBLE) * 100 AS prop FROM ({CENSUS_STATE})'
)
def census_population_share(spark, sf_dir):
    return census.population_share(census_ages_state(spark, sf_dir))


@registered(POPULATION)
def population_by_municipality(spark, sf_dir):
    return census.population_by_municipality(standins.population_projection(spark, sf_dir))


# --- descriptive tables -----------------------------------------------------


@registered(
    DECEMBER
    + "SELECT year_desaparicion, count(*) AS total FROM (SELECT CASE WHEN year_desaparicion BETWEEN 1966 AND 2013 "
    "THEN 'previo a 2013' WHEN year_desaparicion BETWEEN 2014 AND 2021 THEN CAST(year_desaparicion AS VARCHAR) END "
    "AS year_desaparicion FROM registry) WHERE year_desaparicion IS NOT NULL GROUP BY year_desaparicion"
)
def cases_per_year(spark, sf_dir):
    return descriptives.cases_per_year(december_registry(spark, sf_dir))


@registered(
    DECEMBER
    + f"SELECT *, {_AGE_ORDER} AS order_edad, {_DECIMAL} || '%' AS label FROM "
    + f"({_share(['sexo', 'grupo_edad'], 'after', 1, BANDED)})"
)
def profile_sex_age(spark, sf_dir):
    return descriptives.profile_by_age(december_registry(spark, sf_dir))


@registered(
    DECEMBER
    + f"SELECT *, {_AGE_ORDER} AS order_edad, {_DECIMAL} || '%' AS label FROM "
    + f"({_share(['sexo', 'condicion_localizacion', 'grupo_edad'], 'after', 1, BANDED)})"
)
def profile_sex_status_age(spark, sf_dir):
    return descriptives.profile_by_age(december_registry(spark, sf_dir), by_status=True)


def _labelled(keys: list[str], with_total: bool) -> str:
    tail = " || '% (' || CAST(total AS VARCHAR) || ')'" if with_total else " || '%'"
    return f"SELECT *, {keys[-1]} || chr(10) || {_WHOLE}{tail} AS label FROM ({_share(keys, 'before', 0)})"


@registered(DECEMBER + _labelled(["escolaridad"], True))
def schooling_share(spark, sf_dir):
    return descriptives.schooling_shares(december_registry(spark, sf_dir))


@registered(DECEMBER + _labelled(["condicion_localizacion", "escolaridad"], True))
def schooling_share_by_status(spark, sf_dir):
    return descriptives.schooling_shares(december_registry(spark, sf_dir), by_status=True)


@registered(DECEMBER + _labelled(["sexo", "estado_civil"], False))
def marital_share_by_sex(spark, sf_dir):
    return descriptives.marital_shares(december_registry(spark, sf_dir))


@registered(
    DECEMBER
    + "SELECT sexo, condicion_localizacion, CAST(sum(d) AS DOUBLE) / count(d) AS mean FROM (SELECT *, "
    "date_diff('day', fecha_de_localizacion, fecha_de_desaparicion) AS d FROM registry) "
    "WHERE condicion_localizacion <> 'sigue desaparecida' GROUP BY sexo, condicion_localizacion"
)
def mean_days_to_location(spark, sf_dir):
    return descriptives.mean_days_to_location(december_registry(spark, sf_dir))


def _place_sql(status: str) -> str:
    place = "tipo_de_lugar_de_la_localizacion"
    shares = _share([place], "before", 2, where=f"condicion_localizacion = {literal(status)}")
    return (
        f"{DECEMBER} SELECT *, dense_rank() OVER (ORDER BY per, {place}) AS cat_order, "
        f"{_DECIMAL} || '%' AS label FROM ({shares})"
    )


@registered(_place_sql(S.ALIVE))
def place_found_alive(spark, sf_dir):
    return descriptives.place_found(december_registry(spark, sf_dir), S.ALIVE)


@registered(_place_sql(S.DEAD))
def place_found_dead(spark, sf_dir):
    return descriptives.place_found(december_registry(spark, sf_dir), S.DEAD)


# --- rates ------------------------------------------------------------------


def _rate_sql(counts: str, keys: list[str], people: str) -> str:
    """Scope total over the counts, complete rows, census stratum, rate."""
    scope, names = ", ".join(keys[:-1]), ", ".join(keys)
    known = " AND ".join(f"c.{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT {names}, total, den, total_poblacion, pob_censo, fuente, {nearest_sql('x', 2)} AS tasa, "
        f"{_AGE_ORDER} AS order_edad FROM (SELECT c.*, p.* EXCLUDE (sexo, grupo_edad), CAST(total AS DOUBLE) / "
        f"nullif(CAST(total_poblacion AS DOUBLE), 0) * 100000 AS x FROM (SELECT *, CAST(sum(total) OVER (PARTITION BY "
        f"{scope}) AS BIGINT) AS den FROM ({counts})) c LEFT JOIN (SELECT \"SEXO\" AS sexo, grupo_edad, "
        f'"EDAD" AS total_poblacion, pob AS pob_censo, fuente FROM ({people})) p '
        f"ON c.sexo = p.sexo AND c.grupo_edad = p.grupo_edad WHERE {known})"
    )


_CITY = (
    "(SELECT CASE sexo WHEN 'hombre' THEN 'Hombres' WHEN 'mujer' THEN 'Mujeres' ELSE sexo END AS sexo, "
    f"condicion_localizacion, {band_sql('edad', S.AGE_BANDS)} AS grupo_edad FROM registry)"
)
_NATION = (
    "(SELECT sexo, grupo_edad, condicion_actual_de_las_personas, v FROM (SELECT 'Hombres' AS sexo, "
    f"{band_sql('edad', S.AGE_BANDS)} AS grupo_edad, CASE condicion_actual_de_las_personas WHEN 'LOCALIZADAS CON VIDA' "
    "THEN 'con vida' WHEN 'LOCALIZADAS SIN VIDA' THEN 'sin vida' ELSE 'sigue desaparecida' END "
    f"AS condicion_actual_de_las_personas, hombres AS v FROM ({standins.NATIONAL_SQL}) UNION ALL SELECT 'Mujeres', "
    f"{band_sql('edad', S.AGE_BANDS)}, CASE condicion_actual_de_las_personas WHEN 'LOCALIZADAS CON VIDA' "
    "THEN 'con vida' WHEN 'LOCALIZADAS SIN VIDA' THEN 'sin vida' ELSE 'sigue desaparecida' END, "
    f"mujeres FROM ({standins.NATIONAL_SQL})))"
)


def _counted(source: str, keys: list[str], measure: str) -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, {measure} AS total FROM {source} GROUP BY {names}"


_N = "count(*)"
_V = "CAST(coalesce(sum(v), 0) AS BIGINT)"
_SA = ["sexo", "grupo_edad"]


@registered(DECEMBER + _rate_sql(_counted(_CITY, _SA, _N), _SA, CENSUS_STATE))
def city_rates(spark, sf_dir):
    return rates.city_rates(december_registry(spark, sf_dir), census_ages_state(spark, sf_dir))


_SCA = ["sexo", "condicion_localizacion", "grupo_edad"]


@registered(DECEMBER + _rate_sql(_counted(_CITY, _SCA, _N), _SCA, CENSUS_STATE))
def city_rates_by_status(spark, sf_dir):
    return rates.city_rates(december_registry(spark, sf_dir), census_ages_state(spark, sf_dir), by_status=True)


@registered(_rate_sql(_counted(_NATION, _SA, _V), _SA, CENSUS_NATION))
def national_rates(spark, sf_dir):
    return rates.national_rates(standins.national_counts(spark, sf_dir), census_ages_national(spark, sf_dir))


_SNA = ["sexo", "condicion_actual_de_las_personas", "grupo_edad"]


@registered(_rate_sql(_counted(_NATION, _SNA, _V), _SNA, CENSUS_NATION))
def national_rates_by_status(spark, sf_dir):
    return rates.national_rates(
        standins.national_counts(spark, sf_dir), census_ages_national(spark, sf_dir), by_status=True
    )


# --- regions ----------------------------------------------------------------


@registered(DECEMBER + "SELECT cv_mun_desp, count(*) AS n FROM registry GROUP BY cv_mun_desp")
def cases_per_municipality(spark, sf_dir):
    return regions.cases_per_municipality(december_registry(spark, sf_dir))


_POINTS = (
    'SELECT CVEGEO, CVE_MUN, CAST(sx AS DOUBLE) / (nullif(CAST(a AS DOUBLE), 0) * 3) AS "X", '
    'CAST(sy AS DOUBLE) / (nullif(CAST(a AS DOUBLE), 0) * 3) AS "Y" FROM (SELECT CVEGEO, CVE_MUN, '
    "CAST(sum(x * ny - nx * y) AS BIGINT) AS a, CAST(sum((x + nx) * (x * ny - nx * y)) AS BIGINT) AS sx, "
    "CAST(sum((y + ny) * (x * ny - nx * y)) AS BIGINT) AS sy FROM (SELECT *, "
    "coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny "
    f"FROM ({standins.VERTICES_SQL}) WINDOW w AS (PARTITION BY CVEGEO ORDER BY pos)) GROUP BY CVEGEO, CVE_MUN)"
)


@registered(_POINTS)
def region_label_points(spark, sf_dir):
    return regions.label_points(standins.region_vertices(spark, sf_dir))


_MAP = (
    f'(SELECT r.*, CLAVE_ENT AS "CLAVE_ENT", MUN AS "MUN", "A—O", total_poblacion, n, '
    f"CAST(n AS DOUBLE) * (100000 / CAST(total_poblacion AS DOUBLE)) AS tasa_desp FROM ({_POINTS}) r "
    f"LEFT JOIN ({POPULATION}) p ON p.CVEGEO = r.CVEGEO LEFT JOIN (SELECT cv_mun_desp, count(*) AS n FROM registry "
    "GROUP BY cv_mun_desp) c ON c.cv_mun_desp = r.CVE_MUN)"
)
_BROKEN = "".join(c.encode("latin-1").decode("mac_roman") for c in "áéíóúñüÁÉÍÓÚÑÜ")


@registered(
    DECEMBER
    + f"SELECT * EXCLUDE (q, low, high) REPLACE (translate(MUN, '{_BROKEN}', 'áéíóúñüÁÉÍÓÚÑÜ') AS \"MUN\"), "
    "CAST(q AS VARCHAR) AS tasa_quart, CASE WHEN q IS NOT NULL THEN printf('%.2f-%.2f', "
    f"{nearest_sql('low', 2)}, {nearest_sql('high', 2)}) END AS quart_rangos FROM (SELECT *, "
    "min(tasa_desp) OVER (PARTITION BY q) AS low, max(tasa_desp) OVER (PARTITION BY q) AS high FROM (SELECT *, "
    "CASE WHEN tasa_desp IS NOT NULL THEN ntile(4) OVER (PARTITION BY tasa_desp IS NULL "
    f"ORDER BY tasa_desp, CVEGEO) END AS q FROM {_MAP}))"
)
def municipal_map(spark, sf_dir):
    return regions.map_table(
        standins.region_vertices(spark, sf_dir),
        population_by_municipality(spark, sf_dir),
        cases_per_municipality(spark, sf_dir),
    )


# --- profile and narrative --------------------------------------------------


def _profile_sql() -> str:
    parts = []
    for i, name in enumerate(standins.DECEMBER_NAMES, 1):
        kind = {"id": "bigint", "edad": "int"}.get(name, "string")
        parts.append(
            f"SELECT {i} AS position, '{name}' AS \"column\", '{kind}' AS type, count(*) AS rows, "
            f"count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS \"distinct\", "
            f"CAST(min({name}) AS VARCHAR) AS min, CAST(max({name}) AS VARCHAR) AS max FROM raw"
        )
    return f"WITH raw AS ({standins.DECEMBER_RAW_SQL}) " + " UNION ALL ".join(parts)


@registered(_profile_sql())
def raw_registry_profile(spark, sf_dir):
    """Profile of the delivery, under its clean column names."""
    raw = standins.december_raw(spark, sf_dir).toDF(*standins.DECEMBER_NAMES)
    return profiling.profile_columns(raw)


GROUPINGS = {"all": [], "status": ["status"], "status_priority": ["status", "priority"], "year": ["year"], "year_status": ["year", "status"]}

_NEXT_CUT = (
    "SELECT o_orderkey AS id, o_orderstatus AS status, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, year(o_orderdate) AS year FROM orders"
)


@registered(
    f"WITH cases AS ({_NEXT_CUT}) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"grouping\", concat_ws('|', " + ", ".join(["''", *[f"coalesce(CAST({c} AS VARCHAR), '-')" for c in keys]]) + ") AS keys, "
        "count(*) AS n FROM cases" + (f" GROUP BY {', '.join(keys)}" if keys else "")
        for name, keys in GROUPINGS.items()
    )
)
def counts_of_new_cut(spark, sf_dir):
    """Counts of a first cut, brought to the whole table: cases before a date, some of whose status was then another."""
    after = spark.sql(_NEXT_CUT.replace("FROM orders", "FROM {cases}"), cases=table(spark, sf_dir, "orders"))
    before = after.where("year < 1997").withColumn("status", F.when(F.col("year") == 1996, F.lit("O")).otherwise(F.col("status")))
    first = materialize(increments.count_state(before, GROUPINGS), "counts")
    counts = increments.update_counts(first, before, after, "id", GROUPINGS)
    keys = F.transform("keys", lambda k: F.coalesce(k, F.lit("-")))
    return counts.select("grouping", F.concat_ws("|", F.concat(F.array(F.lit("")), keys)).alias("keys"), "n")


#: Bounds that the estimates of a merged profile keep: shares of the distinct values and of the rows.
DISTINCT_OFF, RANK_OFF = 0.06, 0.025


@registered(
    f'SELECT position, "column", type, rows, nulls, min, max, true AS distinct_within, '
    "CASE WHEN type IN ('bigint', 'int') THEN true END AS median_within "
    f'FROM (SELECT CASE WHEN position > 3 THEN position - 1 ELSE position END AS position, "column", type, rows, nulls, min, max '
    f"FROM ({_profile_sql()}) WHERE \"column\" <> 'fuente_de_reporte')"
)
def profile_merged(spark, sf_dir):
    """The raw registry's profile from stored states, one for each source of reports, held against exact figures."""
    raw = standins.december_raw(spark, sf_dir).toDF(*standins.DECEMBER_NAMES)
    states = materialize(profiling.profile_state(raw, ["fuente_de_reporte"]), "states")
    merged = profiling.read_state(profiling.merge_states(states), [0.5])
    exact = profiling.profile_columns(raw).select("column", F.col("distinct").alias("__exact"))
    numbers = [f.name for f in raw.schema.fields if f.dataType.typeName() in ("long", "integer")]
    medians = {r["column"]: r["quantiles"][0] for r in merged.where(F.col("column").isin(numbers)).collect()}
    sides = [
        F.struct(F.lit(c).alias("__numeric"), F.count_if(F.col(c) < m).alias("__below"), F.count_if(F.col(c) <= m).alias("__upto"), F.count(c).alias("__known"))
        for c, m in medians.items()
    ]
    ranks = raw.agg(F.array(*sides).alias("s")).select(F.inline("s"))
    found = merged.join(exact, "column").join(ranks, F.col("column") == F.col("__numeric"), "left")
    near = (F.col("__below") <= (0.5 + RANK_OFF) * F.col("__known")) & (F.col("__upto") >= (0.5 - RANK_OFF) * F.col("__known"))
    off = F.abs(F.col("distinct") - F.col("__exact")) <= DISTINCT_OFF * F.col("__exact")
    return found.select("position", "column", "type", "rows", "nulls", "min", "max", off.alias("distinct_within"), near.alias("median_within"))


def _narrative_sql() -> str:
    def long(name: str, keys: list[str], source: str, n: str) -> str:
        """One share table in long form, NULL rows of schooling left out."""
        sex = "sexo" if "sexo" in keys else "NULL"
        status = "condicion_localizacion" if len(keys) == 3 else "NULL"
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys) if name == narrative.SCHOOLING else "true"
        return (
            f"SELECT {literal(name)} AS t, CAST({sex} AS VARCHAR) AS sex, CAST({status} AS VARCHAR) AS status, "
            f"CAST({keys[-1]} AS VARCHAR) AS category, {n} AS total FROM {source} WHERE {known} "
            f"GROUP BY {', '.join(keys)}"
        )

    nation = (
        "(SELECT CASE sexo WHEN 'Hombres' THEN 'hombre' ELSE 'mujer' END AS sexo, grupo_edad, "
        f"condicion_actual_de_las_personas AS condicion_localizacion, v FROM {_NATION})"
    )
    status = "condicion_localizacion"
    tables = [
        long(narrative.SOURCE, ["fuente_de_reporte"], "registry", _N),
        long(narrative.ORIGIN, ["origen_de_la_noticia"], "registry", _N),
        long(narrative.BY_STATUS, [status], "registry", _N),
        long(narrative.YEAR, ['"año_desaparicion"'], "registry", _N),
        long(narrative.CITY, ["sexo", "grupo_edad"], BANDED, _N),
        long(narrative.CITY_STATUS, ["sexo", status, "grupo_edad"], BANDED, _N),
        long(narrative.SCHOOLING, ["sexo", status, "escolaridad"], "registry", _N),
        long(narrative.NATION, ["sexo", "grupo_edad"], nation, _V),
        long(narrative.NATION_STATUS, ["sexo", status, "grupo_edad"], nation, _V),
    ]
    wanted = ", ".join(
        "(" + ", ".join(literal(v) for v in (name, t, sex, st, c)) + ")"
        for name, t, sex, st, cats in narrative.QUOTED_SHARES
        for c in cats
    )
    per = (
        f"CASE WHEN t = {literal(narrative.SCHOOLING)} THEN {nearest_sql('x', 0)} ELSE {nearest_sql('x', 1)} END"
    )
    return (
        f"{JULY}, counts AS ({' UNION ALL '.join(tables)}), shares AS (SELECT t, sex, status, category, "
        f"CAST({per} AS DECIMAL(18, 2)) AS per FROM (SELECT *, CAST(total AS DOUBLE) / CAST(sum(total) OVER "
        "(PARTITION BY t, sex, status) AS DOUBLE) * 100 AS x FROM counts)), "
        f"wanted AS (SELECT * FROM (VALUES {wanted}) AS w(name, t, sex, status, category)), "
        "munis AS (SELECT clave_municipio_desp, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place "
        "FROM registry WHERE clave_municipio_desp IS NOT NULL GROUP BY clave_municipio_desp) "
        "SELECT 'distinct_cases' AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT id FROM registry) "
        "UNION ALL SELECT 'located_total', CAST(count(*) AS DOUBLE) FROM registry "
        "WHERE condicion_localizacion <> 'sigue desaparecida' "
        "UNION ALL SELECT w.name, CAST(sum(per) AS DOUBLE) FROM wanted w LEFT JOIN shares s ON w.t = s.t "
        "AND w.sex IS NOT DISTINCT FROM s.sex AND w.status IS NOT DISTINCT FROM s.status AND w.category = s.category "
        "GROUP BY w.name "
        f"UNION ALL SELECT 'top_3_municipalities', {nearest_sql('x', 1)} FROM (SELECT "
        "CAST(sum(n) FILTER (WHERE place <= 3) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100 AS x FROM munis)"
    )


@registered(_narrative_sql())
def narrative_metrics(spark, sf_dir):
    return narrative.narrative_metrics(july_registry(spark, sf_dir), standins.national_counts(spark, sf_dir))
