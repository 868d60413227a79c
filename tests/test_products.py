"""Products on small hand-made tables, checked against values worked out by hand."""

import datetime as dt

import pytest

from recuento.operators.joins import assert_unique
from recuento.plans import census, descriptives, narrative, rates, regions, registry
from recuento.plans import settings as S
from recuento.sources import schemas

VOCABULARY = [
    ("origen_de_la_noticia", "oficina", "autoridades en general", 1),
    ("escolaridad", "prepa", "preparatoria", 1),
    ("parentesco_reportante", "mamá", "familiar", 1),
    ("delito_del_que_fue_victima", "hurto", "robo", 1),
]


@pytest.fixture
def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, schemas.VOCABULARY)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(
        [
            ("09", "Distrito Federal", "DF", "010", "Álvaro Obregón"),
            ("15", "México", "Mex", "033", "Ecatepec"),
            ("99", None, None, "999", None),
        ],
        schemas.GEO_CATALOG,
    )


def filled(schema, **values):
    return tuple(values.get(f.name) for f in schema.fields)


def test_december_registry(spark, vocabulary, catalog):
    raw = spark.createDataFrame(
        [
            filled(
                schemas.REGISTRY_RAW,
                id="A1",
                fecha_de_inicio_de_reporte_en_la_cbpcdmx="2/1/2021",
                fecha_de_desaparicion="31-12-99",
                fecha_de_localizacion="31/02/2021",
                origen_de_la_noticia="OFICINA",
                escolaridad="Prepa",
                parentesco_reportante="Vecina",
                entidad_de_desaparicion="Ciudad de Mexico",
                municipio_alcadia_de_la_desaparicion="ALVARO OBREGON",
                condicion_localizacion="Con Vida",
                edad=15,
            ),
            filled(schemas.REGISTRY_RAW, id="a2"),
            filled(
                schemas.REGISTRY_RAW,
                id="a3",
                entidad_de_desaparicion="Jalisco",
                municipio_alcadia_de_la_desaparicion="Otro",
            ),
        ],
        schemas.REGISTRY_RAW,
    )
    clean = registry.clean_december(raw, vocabulary, catalog)
    assert clean.columns == list(S.DECEMBER_COLUMNS) and len(clean.columns) == 29
    one, two, three = clean.orderBy("id").collect()
    assert one.id == "a1"
    assert one.fecha_de_inicio_de_reporte_en_la_cbpcdmx == dt.date(2021, 1, 2)
    assert (one.fecha_de_desaparicion, one.year_desaparicion) == (dt.date(1999, 12, 31), 1999)
    assert (one.fecha_de_localizacion, one.year_localizacion) == (None, None)
    assert (one.origen_de_la_noticia, one.escolaridad) == ("autoridades en general", "preparatoria")
    assert one.parentesco_reportante == "vecina"
    assert (one.entidad_de_desaparicion, one.municipio_alcadia_de_la_desaparicion) == (
        "ciudad de méxico",
        "álvaro obregón",
    )
    assert (one.cve_ent_desp, one.cv_mun_desp, one.inegi) == ("09", "010", "09010")
    assert one.condicion_localizacion == "con vida"
    assert two.condicion_localizacion == "sigue desaparecida"
    assert two.inegi == "99999"  # the nameless catalog row matches missing names
    assert (three.cve_ent_desp, three.inegi) == (None, "NANA")


def test_july_registry(spark, vocabulary):
    raw = spark.createDataFrame(
        [
            filled(
                schemas.REGISTRY_RAW_TYPED,
                id="1",
                fecha_de_desaparicion=dt.datetime(2020, 5, 1, 13, 0),
                origen_de_la_noticia="oficina",
                parentesco_reportante="vecina",
                escolaridad="kínder",
                lugar_de_nacimiento="tampico",
                clave_municipio="7",
                clave_colonia="55",
                delito_del_que_fue_victima="hurto",
            ),
            filled(schemas.REGISTRY_RAW_TYPED, id="2", origen_de_la_noticia="Oficina", clave_municipio="12345"),
        ],
        schemas.REGISTRY_RAW_TYPED,
    )
    clean = registry.clean_july(raw, vocabulary)
    assert clean.columns == list(S.JULY_COLUMNS) and len(clean.columns) == 29
    one, two = clean.orderBy("id").collect()
    assert (one["año_desaparicion"], one["año_localizacion"]) == (2020, None)
    assert (one.origen_de_la_noticia, one.parentesco_reportante, one.escolaridad) == (
        "autoridades en general",
        None,
        "kínder",
    )
    assert (one.lugar_de_nacimiento, one.clave_municipio_desp, one.clave_colonia_desp) == ("tamaulipas", "007", "55")
    assert one.delito_del_que_fue_victima == "robo"
    assert (two.origen_de_la_noticia, two.clave_municipio_desp) == (None, "12345")
    assert two.condicion_localizacion == "sigue desaparecida"


def test_catalog_with_a_repeated_municipality_is_refused(catalog):
    twice = registry.prepare_catalog(catalog.unionByName(catalog))
    with pytest.raises(ValueError, match="geo catalog"):
        assert_unique(twice, ["name_ent", "name_mun"], "geo catalog")


@pytest.fixture
def persons(spark):
    people = [
        # ENT, FACTOR, SEXO, EDAD, NIVACAD
        ("09", 10, 1, 11, "00"),
        ("09", 30, 1, 12, "04"),
        ("09", 5, 3, 60, "09"),
        ("09", None, 3, 20, "99"),
        ("09", 7, 9, 30, None),
        ("09", 100, 1, 9999, "06"),
        ("15", 50, 1, 11, "02"),
    ]
    rows = [(e, str(i), f, 1, s, a, n) for i, (e, f, s, a, n) in enumerate(people)]
    return spark.createDataFrame(rows, schemas.CENSUS_PERSONS)


def test_census_ages(persons, rows):
    state = census.census_ages(persons, "09")
    young, teen, early, _, adult, _, old = S.AGE_LEVELS
    assert rows(state) == sorted(
        [
            ("Hombres", young, 10, 40, "Censo"),
            ("Hombres", teen, 30, 40, "Censo"),
            ("Mujeres", old, 5, 5, "Censo"),
            ("Mujeres", early, 0, 5, "Censo"),
            ("No especificado", adult, 7, 7, "Censo"),
        ],
        key=str,
    )
    national = {(r.SEXO, r.grupo_edad): (r.EDAD, r.pob) for r in census.census_ages(persons).collect()}
    assert national["Hombres", young] == (60, 90)
    prop = {(r.sexo, r.grupo_edad): r.prop for r in census.population_share(state).collect()}
    assert prop["Hombres", teen] == 75.0


def test_census_schooling(persons, rows):
    schooling = census.census_schooling(persons)
    assert rows(schooling) == [
        ("No especificado", 0, 145, "Censo"),
        ("ninguno", 10, 145, "Censo"),
        ("preparatoria", 35, 145, "Censo"),
        ("profesional técnico", 100, 145, "Censo"),
    ]
    labels = {r.NIVACAD: r.label for r in census.census_schooling_share(schooling).collect()}
    assert labels["preparatoria"] == "preparatoria\n24% (35)"


@pytest.fixture
def population(spark):
    projection = [
        ("Ciudad de MÈxico", 2021, 9, "¡lvaro ObregÛn", 400),
        ("Ciudad de MÈxico", 2021, 9, "¡lvaro ObregÛn", 100),
        ("Ciudad de MÈxico", 2020, 9, "¡lvaro ObregÛn", 999),
        ("Ciudad de MÈxico", 2021, 9, "Tlalpan", 1000),
        ("Ciudad de MÈxico", 2021, 9, "Tlalpan", None),
        ("Ciudad de MÈxico", 2021, 9, "Iztacalco", 200),
        ("Ciudad de MÈxico", 2021, 9, "Desconocido", 5),
        ("MÈxico", 2021, 15, "Toluca", 7),
    ]
    return census.population_by_municipality(spark.createDataFrame(projection, schemas.POPULATION_PROJECTION))


def test_population_by_municipality(population):
    found = {r.MUN: (r.total_poblacion, r.CVEGEO) for r in population.collect()}
    assert found == {
        "¡lvaro ObregÛn": (500, "09010"),
        "Tlalpan": (None, "09012"),
        "Iztacalco": (200, "09006"),
        "Desconocido": (5, None),
    }


def cases(spark, *rows):
    """Registry rows with the columns the descriptive tables use."""
    names = (
        "sexo string, edad int, condicion_localizacion string, escolaridad string, estado_civil string, "
        "tipo_de_lugar_de_la_localizacion string, year_desaparicion int, fecha_de_desaparicion date, "
        "fecha_de_localizacion date, cve_ent_desp string, cv_mun_desp string"
    )
    keys = [part.split()[0] for part in names.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], names)


def test_profile_counts_missing_bands_in_the_denominator(spark):
    df = cases(
        spark,
        *[{"sexo": "hombre", "edad": 15, "condicion_localizacion": "con vida"}] * 3,
        {"sexo": "hombre", "condicion_localizacion": "otra"},
        {"edad": 15, "condicion_localizacion": "con vida"},
    )
    (row,) = descriptives.profile_by_age(df).collect()
    assert (row.total, row.den, row.per, row.label, row.order_edad) == (3, 4, 75.0, "75%", 2)
    (row,) = descriptives.profile_by_age(df, by_status=True).collect()
    assert (row.condicion_localizacion, row.total, row.den, row.per) == ("con vida", 3, 3, 100.0)


def test_composition_leaves_missing_values_out_of_the_denominator(spark):
    df = cases(
        spark,
        {"sexo": "mujer", "escolaridad": "primaria", "estado_civil": "soltero/a", "condicion_localizacion": "con vida"},
        {"sexo": "mujer", "escolaridad": "primaria", "condicion_localizacion": "rara"},
        {"sexo": "mujer", "escolaridad": "otra", "condicion_localizacion": "con vida"},
        {"sexo": "mujer", "condicion_localizacion": "con vida"},
    )
    shares = descriptives.schooling_shares(df).collect()
    assert [(r.escolaridad, r.per, r.label) for r in shares] == [
        ("primaria", 67.0, "primaria\n67% (2)"),
        ("otra", 33.0, "otra\n33% (1)"),
    ]
    by_status = descriptives.schooling_shares(df, by_status=True).collect()
    assert [(r.condicion_localizacion, r.escolaridad, r.per) for r in by_status] == [
        ("con vida", "otra", 50.0),
        ("con vida", "primaria", 50.0),
    ]
    (marital,) = descriptives.marital_shares(df).collect()
    assert (marital.per, marital.label) == (100.0, "soltero/a\n100%")


def test_years_days_and_places(spark, rows):
    df = cases(
        spark,
        {
            "sexo": "mujer",
            "condicion_localizacion": "con vida",
            "year_desaparicion": 1970,
            "fecha_de_desaparicion": dt.date(2021, 1, 1),
            "fecha_de_localizacion": dt.date(2021, 1, 5),
            "tipo_de_lugar_de_la_localizacion": "casa",
        },
        {
            "sexo": "mujer",
            "condicion_localizacion": "con vida",
            "year_desaparicion": 2013,
            "fecha_de_desaparicion": dt.date(2021, 1, 1),
            "tipo_de_lugar_de_la_localizacion": "casa",
        },
        {"sexo": "mujer", "condicion_localizacion": "con vida", "tipo_de_lugar_de_la_localizacion": "calle"},
        {"sexo": "mujer", "condicion_localizacion": "sigue desaparecida", "year_desaparicion": 2021},
        {"condicion_localizacion": "con vida", "year_desaparicion": 2022},
    )
    assert rows(descriptives.cases_per_year(df)) == [("2021", 1), ("previo a 2013", 2)]
    assert rows(descriptives.mean_days_to_location(df)) == [(None, "con vida", None), ("mujer", "con vida", -4.0)]
    places = {r[0]: (r.per, r.cat_order, r.label) for r in descriptives.place_found(df, "con vida").collect()}
    assert places == {"casa": (66.67, 2, "66.67%"), "calle": (33.33, 1, "33.33%")}


def test_city_and_national_rates(spark, persons):
    df = cases(
        spark,
        *[{"sexo": "hombre", "edad": 11, "condicion_localizacion": "con vida"}] * 2,
        {"sexo": "hombre", "edad": 50, "condicion_localizacion": "sin vida"},
        {"sexo": "hombre", "condicion_localizacion": "con vida"},
    )
    state = census.census_ages(persons, "09")
    found = {r.grupo_edad: r for r in rates.city_rates(df, state).collect()}
    young, middle = found[S.AGE_LEVELS[0]], found[S.AGE_LEVELS[5]]
    assert (young.sexo, young.total, young.den, young.total_poblacion, young.pob_censo) == ("Hombres", 2, 4, 10, 40)
    assert (young.tasa, young.order_edad) == (20000.0, 1)
    assert (middle.total_poblacion, middle.tasa, middle.order_edad) == (None, None, 6)
    by_status = {(r.condicion_localizacion, r.order_edad): r.den for r in rates.city_rates(df, state, True).collect()}
    assert by_status == {("con vida", 1): 3, ("sin vida", 6): 1}

    national = spark.createDataFrame(
        [
            ("LOCALIZADAS CON VIDA", 11, 2, None),
            ("LOCALIZADAS CON VIDA", 10, 1, 4),
            ("DESAPARECIDAS Y NO LOCALIZADAS", 60, 1, 1),
            ("DESAPARECIDAS Y NO LOCALIZADAS", None, 6, 5),
            ("OTRA", 60, 1, 0),
        ],
        schemas.NATIONAL_COUNTS,
    )
    nation = census.census_ages(persons)
    overall = {(r.sexo, r.order_edad): (r.total, r.den, r.tasa) for r in rates.national_rates(national, nation).collect()}
    assert overall["Hombres", 1] == (3, 11, 5000.0)
    assert overall["Mujeres", 7] == (1, 10, 20000.0)
    split = {
        (r.sexo, r.condicion_actual_de_las_personas, r.order_edad): (r.total, r.den)
        for r in rates.national_rates(national, nation, by_status=True).collect()
    }
    assert split == {
        ("Hombres", "con vida", 1): (3, 3),
        ("Mujeres", "con vida", 1): (4, 4),
        ("Hombres", "sigue desaparecida", 7): (1, 7),
        ("Mujeres", "sigue desaparecida", 7): (1, 6),
    }


def test_map_table(spark, population):
    df = cases(
        spark,
        *[{"cve_ent_desp": "09", "cv_mun_desp": "010"}] * 2,
        {"cve_ent_desp": "15", "cv_mun_desp": "010"},
        {"cve_ent_desp": "09", "cv_mun_desp": "006"},
        {"cve_ent_desp": "09"},
    )
    counts = regions.cases_per_municipality(df)
    assert {r.cv_mun_desp: r.n for r in counts.collect()} == {"010": 3, "006": 1, None: 1}
    one_state = regions.cases_per_municipality(df, state="09")
    assert {r.cv_mun_desp: r.n for r in one_state.collect()} == {"010": 2, "006": 1, None: 1}

    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    vertices = spark.createDataFrame(
        [(f"09{m}", m, 0, i, x + k, y) for k, m in enumerate(["006", "010", "012", "017"]) for i, (x, y) in enumerate(square)],
        schemas.REGION_VERTICES,
    )
    table = {r.CVE_MUN: r for r in regions.map_table(vertices, population, counts).collect()}
    assert len(table) == 4
    assert (table["010"].MUN, table["010"].tasa_desp, table["010"].tasa_quart) == ("Álvaro Obregón", 600.0, "2")
    assert (table["006"].tasa_desp, table["006"].tasa_quart, table["006"].quart_rangos) == (500.0, "1", "500.00-500.00")
    assert (table["012"].n, table["012"].tasa_desp, table["012"].tasa_quart) == (None, None, None)
    assert (table["017"].MUN, table["017"].X, table["017"].Y) == (None, 4.0, 1.0)


def test_narrative(spark):
    names = (
        "id string, fuente_de_reporte string, origen_de_la_noticia string, condicion_localizacion string, "
        "`año_desaparicion` int, clave_municipio_desp string, sexo string, edad int, escolaridad string"
    )
    df = spark.createDataFrame(
        [
            ("1", "noticia", "autoridades en general", "con vida", 2020, "001", "mujer", 15, "secundaria"),
            ("1", "reporte", None, "con vida", 2021, "001", "mujer", 20, "preparatoria"),
            ("2", None, None, "sin vida", 2021, "002", "mujer", 70, None),
            (None, "reporte", None, "sigue desaparecida", None, None, "hombre", None, "primaria"),
        ],
        names,
    )
    national = spark.createDataFrame(
        [("LOCALIZADAS SIN VIDA", 20, 1, 2), ("LOCALIZADAS SIN VIDA", 15, 2, 1), ("LOCALIZADAS SIN VIDA", None, 0, 3)],
        schemas.NATIONAL_COUNTS,
    )
    found = {r.name: r.value for r in narrative.narrative_metrics(df, national).collect()}
    assert len(found) == 38
    expected = {
        "distinct_cases": 3.0,
        "report_source_news": 25.0,
        "report_source_report": 50.0,
        "origin_authorities": 25.0,
        "origin_portal": None,
        "status_alive": 50.0,
        "located_total": 3.0,
        "year_2021": 50.0,
        "city_women_12_17": 33.3,
        "city_women_12_23_30_44": 66.6,
        "city_women_dead_18_23_30_up": 100.0,
        "schooling_women_alive_secondary": 50.0,
        "schooling_men_missing_primary": 100.0,
        "nation_women_12_23": 50.0,
        "nation_women_dead_18_44": 33.3,
        "top_3_municipalities": 100.0,
    }
    assert {name: found[name] for name in expected} == expected
