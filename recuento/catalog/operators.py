"""One query per operator, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.catalog import standins
from recuento.catalog.base import Query, band_sql, literal, nearest_sql, position_sql, table, values_sql
from recuento.functions import categories, dates, numbers, predicates, text
from recuento.functions.projection import ROUNDS, Lambert, to_degrees
from recuento.operators import columns, counting, dictionary, intervals, joins, profiling, ranking, reshape, shares, spatial
from recuento.plans.registry import prepare_catalog
from recuento.plans.settings import AGE_BANDS, AGE_LEVELS

UNKNOWN = "4-NOT SPECIFIED"
QUERIES: list[Query] = []


def registered(sql: str):
    def keep(run):
        QUERIES.append(Query(run.__name__, run, sql))
        return run

    return keep


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose unknown priority is NULL."""
    priority = F.nullif(F.col("o_orderpriority"), F.lit(UNKNOWN))
    return table(spark, sf_dir, "orders").withColumn("o_orderpriority", priority)


ORDERS = f"(SELECT * REPLACE (nullif(o_orderpriority, '{UNKNOWN}') AS o_orderpriority) FROM orders)"
AGE = "l_quantity * 1.5"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an age that is not always a whole number."""
    return table(spark, sf_dir, "lineitem").withColumn("age", F.col("l_quantity") * 1.5)


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("age_band", categories.band(F.col("age"), AGE_BANDS))


BANDED = f"(SELECT *, {band_sql(AGE, AGE_BANDS)} AS age_band FROM lineitem)"


# --- projections and schema -------------------------------------------------


@registered("SELECT o_orderdate, o_orderkey, o_orderstatus FROM orders")
def project_strict(spark, sf_dir):
    return columns.select_strict(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey", "o_orderstatus"])


@registered("SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_cols(spark, sf_dir):
    return columns.drop_strict(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"])


@registered("SELECT c_custkey AS id, c_name AS nombre, c_nationkey AS entidad FROM customer")
def rename_cols(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return columns.rename(people, {"id": "c_custkey", "nombre": "c_name", "entidad": "c_nationkey"})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_text(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return columns.cast_text(keys, ["o_orderkey", "o_custkey"])


@registered(
    "SELECT c_custkey AS id_persona, c_name AS nombre_de_la_persona, c_nationkey AS clave_entidad, "
    "c_acctbal AS saldo_percent, c_mktsegment AS saldo_percent_2 FROM customer"
)
def clean_names(spark, sf_dir):
    messy = ["ID Persona", "Nombre  de la (persona)", "claveEntidad", "Saldo %", "saldo_percent"]
    return columns.clean_names(table(spark, sf_dir, "customer").toDF(*messy))


@registered(
    "SELECT o_orderkey, d, CAST(year(d) AS INTEGER) AS y FROM (SELECT o_orderkey, "
    "CAST(try_strptime(replace(t, '/', '-'), '%d-%m-%Y') AS DATE) AS d FROM ("
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS t FROM orders))"
)
def mutate_sequential(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")
    )
    return columns.mutate(
        orders,
        {"d": text.replace_all(F.col("d"), "/", "-")},
        {"d": dates.parse_dmy(F.col("d"))},
        {"y": dates.year_of(F.col("d"))},
    )


@registered(
    "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer"
)
def lower_all_strings(spark, sf_dir):
    return columns.lower_text_columns(table(spark, sf_dir, "customer"))


# --- filters ----------------------------------------------------------------


@registered(f"SELECT o_orderkey, o_orderpriority FROM {ORDERS} WHERE o_orderpriority = '1-URGENT'")
def filter_eq(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return orders.where(predicates.equals(F.col("o_orderpriority"), "1-URGENT"))


@registered(f"SELECT o_orderkey, o_orderpriority FROM {ORDERS} WHERE o_orderpriority <> '1-URGENT'")
def filter_ne(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return orders.where(predicates.differs(F.col("o_orderpriority"), "1-URGENT"))


@registered(
    f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {ORDERS} "
    "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"
)
def filter_and(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    urgent = predicates.equals(F.col("o_orderpriority"), "1-URGENT")
    return orders.where(urgent & predicates.equals(F.col("o_orderstatus"), "F"))


@registered("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'r(ed|ing)')")
def filter_regex(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.where(predicates.matches(F.col("p_name"), "r(ed|ing)"))


@registered(
    f"SELECT o_orderkey, o_orderpriority, status FROM (SELECT o_orderkey, o_orderpriority, "
    f"nullif(o_orderstatus, 'P') AS status FROM {ORDERS}) WHERE o_orderpriority IS NOT NULL AND status IS NOT NULL"
)
def drop_null_rows(spark, sf_dir):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    return reshape.drop_null_rows(_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", status))


# --- recodes and bands ------------------------------------------------------


@registered(
    "SELECT category, count(*) AS total FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'alta' "
    f"WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN 'baja' ELSE o_orderpriority END AS category FROM {ORDERS}) "
    "GROUP BY category"
)
def recode_case(spark, sf_dir):
    groups = {"alta": ["1-URGENT", "2-HIGH"], "baja": ["5-LOW", "2-HIGH"]}
    category = categories.recode(F.col("o_orderpriority"), groups).alias("category")
    return counting.group_count(_orders(spark, sf_dir).select(category), ["category"])


@registered(
    "SELECT category, listed, count(*) AS total FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') "
    "THEN 'alta' WHEN o_orderpriority = '5-LOW' THEN 'baja' END AS category, "
    f"coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'), false) AS listed FROM {ORDERS}) "
    "GROUP BY category, listed"
)
def recode_no_default(spark, sf_dir):
    priority = F.col("o_orderpriority")
    groups = {"alta": ["1-URGENT", "2-HIGH"], "baja": ["5-LOW"]}
    listed = predicates.is_member(priority, ["1-URGENT", "2-HIGH", "5-LOW"]).alias("listed")
    recoded = _orders(spark, sf_dir).select(
        categories.recode(priority, groups, default=None).alias("category"), listed
    )
    return counting.group_count(recoded, ["category", "listed"])


@registered(
    "SELECT category, count(*) AS total FROM (SELECT CASE o_orderpriority WHEN '5-LOW' THEN '1-URGENT' "
    f"WHEN '3-MEDIUM' THEN '1-URGENT' ELSE o_orderpriority END AS category FROM {ORDERS}) GROUP BY category"
)
def replace_values(spark, sf_dir):
    pairs = [("5-LOW", "3-MEDIUM"), ("3-MEDIUM", "1-URGENT")]
    category = categories.replace_values(F.col("o_orderpriority"), pairs).alias("category")
    return counting.group_count(_orders(spark, sf_dir).select(category), ["category"])


@registered(
    "SELECT category, count(*) AS total FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'alta' "
    f"WHEN o_orderpriority IS NULL THEN 'no aplica' ELSE 'no especificado' END AS category FROM {ORDERS}) "
    "GROUP BY category"
)
def recode_code(spark, sf_dir):
    category = categories.recode(
        F.col("o_orderpriority"),
        {"alta": ["1-URGENT", "2-HIGH"]},
        default="no especificado",
        missing="no aplica",
    )
    return counting.group_count(_orders(spark, sf_dir).select(category.alias("category")), ["category"])


@registered(
    f"SELECT coalesce(o_orderpriority, 'sin dato') AS category, count(*) AS total FROM {ORDERS} GROUP BY category"
)
def fill_null(spark, sf_dir):
    filled = categories.fill_missing(F.col("o_orderpriority"), "sin dato").alias("category")
    return counting.group_count(_orders(spark, sf_dir).select(filled), ["category"])


EVENT_TERMS = (
    ("event_type", "click", "interacción", 1),
    ("event_type", "click", "otra", 2),
    ("event_type", "view", "visita", 2),
    ("event_type", "view", "visita", 2),
    ("event_type", "PURCHASE", "nunca coincide", 1),
    ("otro_campo", "error", "otro", 1),
)


@registered(
    "SELECT event_type, count(*) AS total FROM (SELECT CASE event_type WHEN 'click' THEN 'interacción' "
    "WHEN 'view' THEN 'visita' ELSE event_type END AS event_type FROM events) GROUP BY event_type"
)
def recode_dictionary(spark, sf_dir):
    terms = standins.vocabulary(spark, EVENT_TERMS)
    events = table(spark, sf_dir, "events").select("event_type")
    return counting.group_count(dictionary.recode_dictionary(events, terms, ["event_type"]), ["event_type"])


NATION_CODES = {f"NATION_{i}": f"{9000 + i:05d}" for i in range(16)}


@registered(
    "SELECT c_custkey, n_name, code FROM customer JOIN nation ON c_nationkey = n_nationkey "
    f"LEFT JOIN {values_sql(list(NATION_CODES.items()), ['name', 'code'])} ON name = n_name"
)
def lookup_code(spark, sf_dir):
    people, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = people.join(nation, people.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    return dictionary.lookup_code(placed, "n_name", NATION_CODES, "code")


@registered(f"SELECT age_band, count(*) AS total FROM {BANDED} GROUP BY age_band")
def band_numeric(spark, sf_dir):
    return counting.group_count(_banded(spark, sf_dir).select("age_band"), ["age_band"])


LEVELS = ("1-URGENT", "3-MEDIUM", "5-LOW")


@registered(
    f"SELECT level, {position_sql('level', LEVELS)} AS place, -({position_sql('level', LEVELS)}) AS reverse_order, "
    f"count(*) AS total FROM (SELECT CASE WHEN o_orderpriority IN {LEVELS} THEN o_orderpriority END AS level "
    f"FROM {ORDERS}) GROUP BY level"
)
def factor_levels(spark, sf_dir):
    level = categories.restrict_levels(F.col("o_orderpriority"), LEVELS).alias("level")
    counts = counting.group_count(_orders(spark, sf_dir).select(level), ["level"])
    place = categories.level_position(F.col("level"), LEVELS)
    return counts.withColumn("place", place).withColumn("reverse_order", -F.col("place"))


# --- text and dates ---------------------------------------------------------


@registered(
    "SELECT c_custkey, CASE WHEN length(s) < 3 THEN lpad(s, 3, '0') ELSE s END AS code "
    "FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS s FROM customer)"
)
def pad_code(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.pad_left(F.col("c_custkey"), 3).alias("code")
    )


@registered(
    "SELECT o_orderkey, coalesce(o_orderpriority, 'NA') || coalesce(nullif(o_orderstatus, 'P'), 'NA') AS key, "
    f"o_orderpriority || nullif(o_orderstatus, 'P') AS strict_key FROM {ORDERS}"
)
def compose_key(spark, sf_dir):
    parts = [F.col("o_orderpriority"), F.nullif(F.col("o_orderstatus"), F.lit("P"))]
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        text.paste(parts).alias("key"),
        text.paste(parts, null_as=None).alias("strict_key"),
    )


@registered(
    "SELECT p_type, CAST(CAST(per AS BIGINT) AS VARCHAR) || '%' AS label, p_type || chr(10) || "
    "CAST(CAST(per AS BIGINT) AS VARCHAR) || '% (' || CAST(total AS VARCHAR) || ')' AS long_label FROM ("
    f"SELECT p_type, total, {nearest_sql('x', 0)} AS per FROM (SELECT p_type, count(*) AS total, "
    "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100 AS x FROM part GROUP BY p_type))"
)
def share_label(spark, sf_dir):
    per = shares.share_table(table(spark, sf_dir, "part"), ["p_type"], nulls="before", digits=0)
    return per.select(
        "p_type",
        text.share_label(F.col("per")).alias("label"),
        text.category_label(F.col("p_type"), F.col("per"), F.col("total")).alias("long_label"),
    )


@registered(
    "SELECT doc_id, translate(text, 'ÈÛ·¡—', 'éóáÁÑ') AS text, "
    "translate(text, 'éóáÁÑ', 'ÈÛ·¡—') = text AS has_none FROM documents"
)
def repair_mojibake(spark, sf_dir):
    """Break the accents of every text as a wrong decoding would, then repair them."""
    letters = "éóáÁÑ"
    broken, proper = text.mojibake_pairs(letters)
    damaged = F.translate(F.col("text"), proper, broken)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.repair_mojibake(damaged, letters).alias("text"),
        (damaged == F.col("text")).alias("has_none"),
    )


@registered(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 97 <> 1 THEN CAST(o_orderdate AS DATE) END AS d "
    "FROM orders"
)
def parse_dmy(spark, sf_dir):
    """Text dates in five spellings, plain words and a day that does not exist."""
    spelled = F.expr(
        "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 97 = 1 THEN '31/02/1999' "
        "WHEN o_orderkey % 5 = 0 THEN date_format(o_orderdate, 'd-M-yyyy') "
        "WHEN o_orderkey % 5 = 1 THEN date_format(o_orderdate, 'dd-MM-yy') "
        "WHEN o_orderkey % 5 = 2 THEN date_format(o_orderdate, 'dd.MM.yyyy') "
        "WHEN o_orderkey % 5 = 3 THEN date_format(o_orderdate, 'ddMMyyyy') "
        "ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_dmy(spelled).alias("d"))


@registered(
    "SELECT bucket, count(*) AS total FROM (SELECT CASE WHEN y BETWEEN 1990 AND 1996 THEN 'previo a 1996' "
    "WHEN y BETWEEN 1997 AND 2000 THEN CAST(y AS VARCHAR) END AS bucket FROM (SELECT year(o_orderdate) AS y FROM orders)) "
    "WHERE bucket IS NOT NULL GROUP BY bucket"
)
def year_bucket_count(spark, sf_dir):
    year = dates.year_of(F.col("o_orderdate"))
    bucket = categories.year_bucket(year, 1990, 1996, "previo a 1996", range(1997, 2001)).alias("bucket")
    bucketed = table(spark, sf_dir, "orders").select(bucket)
    return reshape.drop_null_rows(counting.group_count(bucketed, ["bucket"]))


DATED = (
    "(SELECT l_orderkey, l_linenumber, l_returnflag, o_orderstatus, "
    "CAST(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS days "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


@registered(f"SELECT l_orderkey, l_linenumber, days FROM {DATED}")
def days_between(spark, sf_dir):
    """Every line next to its order, whose key is unique on the order side."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    days = dates.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days")
    return joined.select("l_orderkey", "l_linenumber", days)


@registered(
    f"SELECT o_orderstatus, l_returnflag, CAST(sum(days) AS DOUBLE) / count(days) AS mean FROM {DATED} "
    "WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus, l_returnflag"
)
def mean_days(spark, sf_dir):
    """Lines are counted per order and date first, so that an order with very
    many lines joins as a few rows; the mean weighs the days by these counts."""
    lines = table(spark, sf_dir, "lineitem").withColumn("shipped", F.col("l_shipdate").cast("date"))
    counts = counting.group_count(lines, ["l_orderkey", "l_returnflag", "shipped"], "n")
    orders = table(spark, sf_dir, "orders").where(predicates.differs(F.col("o_orderstatus"), "P"))
    joined = counts.join(orders, counts.l_orderkey == orders.o_orderkey)
    days = dates.days_between(F.col("o_orderdate"), F.col("shipped"))
    mean = F.try_divide(F.sum(days * F.col("n")).cast("double"), F.sum("n").cast("double"))
    return joined.groupBy("o_orderstatus", "l_returnflag").agg(mean.alias("mean"))


# --- counts, sums, shares ---------------------------------------------------


@registered(f"SELECT o_orderpriority, count(*) AS total FROM {ORDERS} GROUP BY o_orderpriority")
def group_count(spark, sf_dir):
    return counting.group_count(_orders(spark, sf_dir), ["o_orderpriority"])


WEIGHT = "CASE WHEN l_returnflag = 'N' OR l_linenumber = 1 THEN NULL ELSE l_linenumber END"


@registered(
    f"SELECT l_returnflag, CAST(coalesce(sum({WEIGHT}), 0) AS BIGINT) AS weight FROM lineitem GROUP BY l_returnflag"
)
def sum_null_zero(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(WEIGHT).alias("weight"))
    return lines.groupBy("l_returnflag").agg(counting.sum_or_zero(F.col("weight")).alias("weight"))


PARTLY = "CASE WHEN o_orderpriority IS NULL AND o_orderstatus = 'P' THEN NULL ELSE o_custkey END"


@registered(
    f"SELECT o_orderstatus, CASE WHEN count(x) = count(*) THEN CAST(sum(x) AS BIGINT) END AS s FROM "
    f"(SELECT o_orderstatus, {PARTLY} AS x FROM {ORDERS}) GROUP BY o_orderstatus"
)
def sum_strict(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_orderstatus", F.expr(PARTLY).alias("x"))
    return orders.groupBy("o_orderstatus").agg(counting.sum_strict(F.col("x")).alias("s"))


@registered(
    "SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey END AS k "
    "FROM lineitem)"
)
def distinct_count(spark, sf_dir):
    key = F.expr("CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey END").alias("k")
    return counting.distinct_count(table(spark, sf_dir, "lineitem").select(key), "k")


PERSON_AGE = "CAST(c_custkey % 90 AS INT)"
PERSON_WEIGHT = "c_custkey % 7 + 1"


def _population(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        "c_mktsegment",
        categories.band(F.expr(PERSON_AGE), AGE_BANDS).alias("age_band"),
        F.expr(PERSON_WEIGHT).alias("weight"),
    )
    sums = counting.weighted_sum(people, ["c_mktsegment", "age_band"], "weight")
    return shares.add_scope_total(sums, ["c_mktsegment"], "total", "pob")


POPULATION = (
    "(SELECT c_mktsegment, age_band, CAST(sum(w) AS BIGINT) AS total, "
    "CAST(sum(sum(w)) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS pob FROM "
    f"(SELECT c_mktsegment, {band_sql(PERSON_AGE, AGE_BANDS)} AS age_band, {PERSON_WEIGHT} AS w FROM customer) "
    "GROUP BY c_mktsegment, age_band)"
)


@registered(f"SELECT *, 'Censo' AS fuente FROM {POPULATION}")
def weighted_population(spark, sf_dir):
    return _population(spark, sf_dir).withColumn("fuente", F.lit("Censo"))


@registered(f"SELECT *, CAST(total AS DOUBLE) / CAST(pob AS DOUBLE) * 100 AS prop FROM {POPULATION}")
def population_share(spark, sf_dir):
    return _population(spark, sf_dir).withColumn("prop", numbers.percent(F.col("total"), F.col("pob")))


def _share_sql(source: str, keys: str, scope: str, digits: int) -> str:
    over = f"PARTITION BY {scope}" if scope else ""
    return (
        f"SELECT {keys}, total, den, {nearest_sql('x', digits)} AS per FROM (SELECT *, "
        f"CAST(total AS DOUBLE) / CAST(den AS DOUBLE) * 100 AS x FROM (SELECT {keys}, count(*) AS total, "
        f"CAST(sum(count(*)) OVER ({over}) AS BIGINT) AS den FROM {source} GROUP BY {keys}))"
    )


SHARE_PCT = (
    _share_sql(BANDED, "l_linestatus, l_returnflag, age_band", "l_linestatus, l_returnflag", 1)
    + " WHERE age_band IS NOT NULL"
)


@registered(SHARE_PCT)
def share_pct(spark, sf_dir):
    return shares.share_table(
        _banded(spark, sf_dir), ["l_linestatus", "l_returnflag", "age_band"], nulls="after", digits=1
    )


@registered(_share_sql(f"{ORDERS} WHERE o_orderpriority IS NOT NULL", "o_orderpriority", "", 1))
def share_global(spark, sf_dir):
    return shares.share_table(_orders(spark, sf_dir), ["o_orderpriority"], nulls="before", digits=1)


YOUNG = AGE_LEVELS[1:4]


@registered(
    f"SELECT l_linestatus, l_returnflag, CAST(sum(CAST(per AS DECIMAL(18, 2))) AS DOUBLE) AS per_sum FROM ({SHARE_PCT}) "
    f"WHERE age_band IN ({', '.join(literal(b) for b in YOUNG)}) GROUP BY l_linestatus, l_returnflag"
)
def share_band_sum(spark, sf_dir):
    """Sum of shares that were rounded first."""
    return shares.sum_of_shares(
        share_pct(spark, sf_dir), "age_band", YOUNG, ["l_linestatus", "l_returnflag"]
    )


@registered("SELECT count(*) AS total FROM orders WHERE o_orderstatus <> 'P'")
def total_resolved(spark, sf_dir):
    counts = counting.group_count(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    return counts.where(predicates.differs(F.col("o_orderstatus"), "P")).agg(F.sum("total").alias("total"))


RATE_PEOPLE = (
    "(SELECT CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, "
    f"{band_sql(PERSON_AGE, AGE_BANDS)} AS age_band, CAST(sum({PERSON_WEIGHT}) AS BIGINT) AS pob "
    "FROM customer GROUP BY ALL)"
)


@registered(
    f"SELECT l_linestatus, age_band, total, pob, {nearest_sql('x', 2)} AS rate FROM (SELECT c.*, pob, "
    "CAST(total AS DOUBLE) / nullif(CAST(pob AS DOUBLE), 0) * 100000 AS x FROM (SELECT l_linestatus, age_band, "
    f"count(*) AS total FROM {BANDED} GROUP BY l_linestatus, age_band) c LEFT JOIN {RATE_PEOPLE} p "
    "ON c.l_linestatus IS NOT DISTINCT FROM p.l_linestatus AND c.age_band IS NOT DISTINCT FROM p.age_band)"
)
def rate_per_100k(spark, sf_dir):
    """Cases by sex and band over the weighted population of the same stratum."""
    people = table(spark, sf_dir, "customer").select(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END").alias("l_linestatus"),
        categories.band(F.expr(PERSON_AGE), AGE_BANDS).alias("age_band"),
        F.expr(PERSON_WEIGHT).alias("weight"),
    )
    strata = counting.weighted_sum(people, ["l_linestatus", "age_band"], "weight", "pob")
    cases = counting.group_count(_banded(spark, sf_dir), ["l_linestatus", "age_band"])
    joined = joins.lookup_join(cases, strata, ["l_linestatus", "age_band"])
    exact = joined.withColumn("rate", numbers.rate_per(F.col("total"), F.col("pob")))
    return exact.withColumn("rate", numbers.round_even(F.col("rate"), 2))


# --- joins, regions, ranks --------------------------------------------------


def _named_orders(spark, sf_dir):
    """Orders with a state and municipality name, sometimes NULL or unlisted."""
    by_header = {clean: e for _, clean, e in standins.december_columns(standins.SPARK)}
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"CASE lower({by_header['entidad_de_desaparicion']}) WHEN 'ciudad de mexico' THEN 'ciudad de méxico' "
        f"ELSE lower({by_header['entidad_de_desaparicion']}) END AS name_ent",
        f"lower({by_header['municipio_alcadia_de_la_desaparicion']}) AS name_mun",
    )


def _named_orders_sql() -> str:
    by_header = {clean: e for _, clean, e in standins.december_columns(standins.DUCKDB)}
    return (
        f"(SELECT o_orderkey, CASE lower({by_header['entidad_de_desaparicion']}) WHEN 'ciudad de mexico' "
        f"THEN 'ciudad de méxico' ELSE lower({by_header['entidad_de_desaparicion']}) END AS name_ent, "
        f"lower({by_header['municipio_alcadia_de_la_desaparicion']}) AS name_mun FROM orders)"
    )


CATALOG = (
    "(SELECT id_ent, CASE lower(name_ent) WHEN 'distrito federal' THEN 'ciudad de méxico' ELSE lower(name_ent) END "
    f"AS name_ent, id_mun, lower(name_mun) AS name_mun FROM ({standins.GEO_CATALOG_SQL}))"
)
GEO_JOIN = (
    f"SELECT o.*, c.id_ent, c.id_mun FROM {_named_orders_sql()} o LEFT JOIN {CATALOG} c "
    "ON o.name_ent IS NOT DISTINCT FROM c.name_ent AND o.name_mun IS NOT DISTINCT FROM c.name_mun"
)


@registered(GEO_JOIN)
def geo_lookup_join(spark, sf_dir):
    catalog = joins.assert_unique(prepare_catalog(standins.geo_catalog(spark, sf_dir)), ["name_ent", "name_mun"])
    return joins.lookup_join(_named_orders(spark, sf_dir), catalog, ["name_ent", "name_mun"])


@registered(GEO_JOIN)
def natural_left_join(spark, sf_dir):
    catalog = prepare_catalog(standins.geo_catalog(spark, sf_dir))
    return joins.natural_left_join(_named_orders(spark, sf_dir), catalog)


def _regions(spark, sf_dir):
    """Documents as regions, their length as population, their labels as cases.

    Only some documents have labels; the others stay, without a count.
    """
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    population = counting.weighted_sum(documents, ["doc_id"], "n_chars", "pob")
    cases = counting.group_count(labels, ["doc_id"], "n")
    regions = joins.lookup_join(documents.select("doc_id", "lang"), population, ["doc_id"])
    return joins.lookup_join(regions, cases.withColumnRenamed("doc_id", "labelled"), {"doc_id": "labelled"})


REGIONS = (
    "(SELECT d.doc_id, d.lang, pob, n FROM documents d LEFT JOIN (SELECT doc_id AS a, "
    "CAST(sum(n_chars) AS BIGINT) AS pob FROM documents GROUP BY a) ON a = d.doc_id "
    "LEFT JOIN (SELECT doc_id AS b, count(*) AS n FROM labels GROUP BY b) ON b = d.doc_id)"
)


@registered(f"SELECT * FROM {REGIONS}")
def region_measures(spark, sf_dir):
    return _regions(spark, sf_dir)


CLASSED = (
    "(SELECT *, CASE WHEN rate IS NOT NULL THEN ntile(4) OVER (PARTITION BY rate IS NULL ORDER BY rate, doc_id) "
    f"END AS q FROM (SELECT *, CAST(n AS DOUBLE) * (100000 / CAST(pob AS DOUBLE)) AS rate FROM {REGIONS}))"
)


@registered(
    f"SELECT doc_id, n, pob, rate, CAST(q AS VARCHAR) AS quartile, CASE WHEN q IS NOT NULL THEN printf('%.2f-%.2f', "
    f"{nearest_sql('low', 2)}, {nearest_sql('high', 2)}) END AS range FROM (SELECT *, "
    f"min(rate) OVER (PARTITION BY q) AS low, max(rate) OVER (PARTITION BY q) AS high FROM {CLASSED})"
)
def quartile_class(spark, sf_dir):
    rates = _regions(spark, sf_dir).withColumn("rate", numbers.scaled_rate(F.col("n"), F.col("pob")))
    classed = ranking.quantile_class(rates.drop("lang"), "rate", ["doc_id"], 4, "quartile", "range")
    return classed.withColumn("quartile", F.col("quartile").cast("string"))


@registered(
    f"SELECT total, tot_denom, {nearest_sql('x', 1)} AS pct FROM (SELECT total, tot_denom, "
    "CAST(total AS DOUBLE) / CAST(tot_denom AS DOUBLE) * 100 AS x FROM (SELECT "
    "CAST(sum(total) FILTER (WHERE place <= 3) AS BIGINT) AS total, CAST(sum(total) AS BIGINT) AS tot_denom FROM ("
    "SELECT p_brand, count(*) AS total, rank() OVER (ORDER BY count(*) DESC) AS place FROM "
    "(SELECT nullif(p_brand, 'Brand#1') AS p_brand FROM part) WHERE p_brand IS NOT NULL GROUP BY p_brand)))"
)
def topk_share(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("p_brand"))
    return shares.top_share(counting.group_count(brands, ["p_brand"]), "total", 3)


@registered(
    "SELECT measure, CAST(sum(v) AS BIGINT) AS total FROM (SELECT l_returnflag, 'items' AS measure, "
    "sum(l_linenumber) AS v FROM lineitem GROUP BY l_returnflag UNION ALL SELECT l_returnflag, 'parts', "
    "coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN l_partkey % 5 END), 0) FROM lineitem GROUP BY l_returnflag) "
    "GROUP BY measure"
)
def wide_to_long_sum(spark, sf_dir):
    """Two measures per flag, made rows, then summed again without the flag."""
    parts = F.expr("CASE WHEN l_returnflag <> 'N' THEN l_partkey % 5 END")
    wide = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(counting.sum_or_zero(F.col("l_linenumber")).alias("items"), counting.sum_or_zero(parts).alias("parts"))
    )
    long = reshape.wide_to_long(wide, ["l_returnflag"], "measure", "total")
    return counting.regroup_sum(long, ["measure"])


@registered(
    "SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price "
    "FROM orders) ORDER BY price DESC NULLS LAST, o_orderkey"
)
def sort_desc(spark, sf_dir):
    price = F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END").alias("price")
    return reshape.sort_descending(table(spark, sf_dir, "orders").select("o_orderkey", price), "price", ["o_orderkey"])


@registered(
    "SELECT p_brand, p_type, total, dense_rank() OVER (ORDER BY m, p_brand) AS cat_order FROM (SELECT *, "
    "CAST(sum(total) OVER (PARTITION BY p_brand) AS DOUBLE) / count(*) OVER (PARTITION BY p_brand) AS m FROM "
    "(SELECT p_brand, p_type, count(*) AS total FROM part GROUP BY p_brand, p_type))"
)
def order_by_value(spark, sf_dir):
    counts = counting.group_count(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    return ranking.order_by_value(counts, "p_brand", "total")


# --- profile and polygons ---------------------------------------------------


def _profile_sql(source: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS \"column\", '{kind}' AS type, count(*) AS rows, "
        f"count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS \"distinct\", "
        f"CAST(min({name}) AS VARCHAR) AS min, CAST(max({name}) AS VARCHAR) AS max FROM {source}"
        for i, (name, kind) in enumerate(names.items(), 1)
    )


@registered(
    _profile_sql(
        ORDERS,
        {
            "o_orderkey": "bigint",
            "o_custkey": "bigint",
            "o_orderstatus": "string",
            "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz",
            "o_orderpriority": "string",
        },
    )
)
def profile_columns(spark, sf_dir):
    return profiling.profile_columns(_orders(spark, sf_dir))


EDGES_SQL = (
    "SELECT CVEGEO, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, "
    f"coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ({standins.VERTICES_SQL}) "
    "WINDOW w AS (PARTITION BY CVEGEO ORDER BY pos)"
)


@registered(
    'SELECT CVEGEO, CAST(sx AS DOUBLE) / (nullif(CAST(area2 AS DOUBLE), 0) * 3) AS "X", '
    'CAST(sy AS DOUBLE) / (nullif(CAST(area2 AS DOUBLE), 0) * 3) AS "Y", area2 FROM (SELECT CVEGEO, '
    "CAST(sum(x * ny - nx * y) AS BIGINT) AS area2, CAST(sum((x + nx) * (x * ny - nx * y)) AS BIGINT) AS sx, "
    f"CAST(sum((y + ny) * (x * ny - nx * y)) AS BIGINT) AS sy FROM ({EDGES_SQL}) GROUP BY CVEGEO)"
)
def polygon_centroid(spark, sf_dir):
    """Vertices in stretches of 10, so that every ring crosses several."""
    return spatial.polygon_centroid(standins.region_vertices(spark, sf_dir), ["CVEGEO"], stretch=10)


@registered(
    "SELECT o_orderkey, entidad, municipio, coalesce(e.id_ent, n.id_ent) AS id_ent, coalesce(e.id_mun, n.id_mun) AS id_mun, "
    "CASE WHEN e.spelled THEN 'spelling' WHEN n.near THEN 'collation' END AS found FROM "
    f"(SELECT id AS o_orderkey, entidad_de_desaparicion AS entidad, municipio_alcadia_de_la_desaparicion AS municipio FROM ({standins.DECEMBER_RAW_SQL})) "
    f"LEFT JOIN (SELECT *, true AS spelled FROM {CATALOG}) e ON e.name_ent IS NOT DISTINCT FROM entidad AND e.name_mun IS NOT DISTINCT FROM municipio "
    "LEFT JOIN (SELECT strip_accents(name_ent) AS a, strip_accents(name_mun) AS b, any_value(id_ent) AS id_ent, any_value(id_mun) AS id_mun, "
    f"true AS near FROM {CATALOG} GROUP BY a, b HAVING count(*) = 1) n "
    "ON strip_accents(lower(entidad)) = a AND strip_accents(lower(municipio)) = b"
)
def geo_lookup_insensitive(spark, sf_dir):
    """Places as delivered, without any replaced spelling, against the catalog."""
    raw = standins.december_raw(spark, sf_dir).toDF(*standins.DECEMBER_NAMES)
    places = raw.select(
        F.col("id").alias("o_orderkey"), F.col("entidad_de_desaparicion").alias("entidad"), F.col("municipio_alcadia_de_la_desaparicion").alias("municipio")
    )
    catalog = prepare_catalog(standins.geo_catalog(spark, sf_dir))
    return joins.insensitive_lookup_join(places, catalog, {"entidad": "name_ent", "municipio": "name_mun"}, found="found")


@registered(f"SELECT l_orderkey, l_linenumber, {AGE} AS age, {band_sql(AGE, AGE_BANDS)} AS age_band FROM lineitem")
def band_from_table(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "age")
    return intervals.band_lookup(lines, "age", intervals.band_table(spark, AGE_BANDS), "age_band")


#: Invented layer: a conic of the size of a country.
LAYER = Lambert(6378137.0, 298.257222101, 17.5, 29.5, 12.0, -102.0, 2500000.0, 0.0)


def _degrees_sql() -> str:
    cone, scale, origin = LAYER.constants()
    e = LAYER.eccentricity
    source = "SELECT *, pi() / 2 - 2 * atan(t) AS lat FROM cone"
    for _ in range(ROUNDS):
        source = f"SELECT * REPLACE (pi() / 2 - 2 * atan(t * pow((1 - {e!r} * sin(lat)) / (1 + {e!r} * sin(lat)), {e / 2!r})) AS lat) FROM ({source})"
    return (
        f"WITH planar AS (SELECT CVEGEO, CAST(pos AS INTEGER) AS pos, CAST(x AS DOUBLE) * 100 AS east, {origin!r} - (CAST(y AS DOUBLE) * 100 + 800000) AS south "
        f"FROM ({standins.VERTICES_SQL})), cone AS (SELECT *, pow(sqrt(east * east + south * south) / {LAYER.semi_major * scale!r}, {1 / cone!r}) AS t FROM planar) "
        f"SELECT CVEGEO, pos, round(degrees(atan2(east, south) / {cone!r}) + {LAYER.origin_longitude!r}, 7) AS lon, round(degrees(lat), 7) AS lat FROM ({source})"
    )


@registered(_degrees_sql())
def map_degrees(spark, sf_dir):
    """Vertices of all polygons, spread over the layer, in degrees."""
    vertices = standins.region_vertices(spark, sf_dir)
    x = F.col("x").cast("double") * 100 + LAYER.false_easting
    y = F.col("y").cast("double") * 100 + 800000
    lon, lat = to_degrees(x, y, LAYER)
    return vertices.select("CVEGEO", F.col("pos").cast("int").alias("pos"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))
