"""All stages one after the other, from files to tables."""

import datetime as dt

from recuento import jobs
from recuento.plans import settings as S
from recuento.sources import schemas


def filled(schema, **values):
    return tuple(values.get(f.name) for f in schema.fields)


def test_all_stages(spark, tmp_path):
    out = str(tmp_path / "out")
    (tmp_path / "vocabulary.csv").write_text(
        "field,raw,canonical,priority\n"
        "escolaridad,prepa,preparatoria,1\n"
        "tipo_de_lugar_de_la_localizacion,su casa,domicilio de la persona,1\n",
        "utf-8",
    )
    (tmp_path / "geo.csv").write_text(
        "id_ent,name_ent,name_ent_short,id_mun,name_mun\n09,Distrito Federal,DF,010,Álvaro Obregón\n", "utf-8"
    )
    december = [
        filled(
            schemas.REGISTRY_RAW,
            id=str(i),
            sexo="Hombre" if i % 2 else "Mujer",
            edad=15 + i,
            escolaridad="Prepa",
            estado_civil="soltero",
            fecha_de_desaparicion="01/02/2020",
            fecha_de_localizacion="05/02/2020",
            condicion_localizacion="Con vida" if i % 3 else "Sin vida",
            tipo_de_lugar_de_la_localizacion="Su casa",
            entidad_de_desaparicion="Ciudad de Mexico",
            municipio_alcadia_de_la_desaparicion="Alvaro Obregon",
        )
        for i in range(12)
    ]
    spark.createDataFrame(december, schemas.REGISTRY_RAW).write.parquet(str(tmp_path / "december"))
    july = [
        filled(
            schemas.REGISTRY_RAW_TYPED,
            id="x",
            sexo="mujer",
            edad=20,
            condicion_localizacion="con vida",
            clave_municipio="10",
            fecha_de_desaparicion=dt.datetime(2021, 3, 1),
        )
    ]
    spark.createDataFrame(july, schemas.REGISTRY_RAW_TYPED).write.parquet(str(tmp_path / "july"))
    census = tmp_path / "census"
    census.mkdir()
    (census / "Personas_09.csv").write_bytes(
        "ENT,NOMBRE,ID_PERSONA,FACTOR,NUMPER,SEXO,EDAD,NIVACAD\n09,Peña,1,10,1,1,16,03\n15,Núñez,2,20,1,3,20,10\n".encode(
            "latin-1"
        )
    )
    (census / "Viviendas_09.csv").write_text("otra,cosa\n1,2\n")
    (tmp_path / "projection.csv").write_text(
        "NOM_ENT,A—O,CLAVE_ENT,MUN,POB\nCiudad de MÈxico,2021,9,¡lvaro ObregÛn,1200\n", "utf-8"
    )
    national = spark.createDataFrame([("LOCALIZADAS CON VIDA", 20, 3, 4)], schemas.NATIONAL_COUNTS)
    national.write.parquet(str(tmp_path / "national"))
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    ring = [("09010", "010", 0, i, x, y) for i, (x, y) in enumerate(square)]
    spark.createDataFrame(ring, schemas.REGION_VERTICES).write.parquet(str(tmp_path / "vertices"))

    jobs.profile_delivery(spark, str(tmp_path / "december"), out)
    jobs.import_december(
        spark, str(tmp_path / "december"), str(tmp_path / "vocabulary.csv"), str(tmp_path / "geo.csv"), out
    )
    jobs.import_july(spark, str(tmp_path / "july"), str(tmp_path / "vocabulary.csv"), out)
    jobs.census_tables(spark, str(census), out)
    jobs.descriptive_tables(spark, out)
    jobs.rate_tables(spark, str(tmp_path / "national"), out)
    jobs.region_tables(spark, str(tmp_path / "projection.csv"), str(tmp_path / "vertices"), out)
    jobs.report_figures(spark, str(tmp_path / "national"), out)

    def table(name):
        return spark.read.parquet(f"{out}/{name}")

    assert table(jobs.DECEMBER).columns == list(S.DECEMBER_COLUMNS)
    assert spark.read.option("header", True).csv(f"{out}/{jobs.PUBLISHED}").count() == 12
    assert table(jobs.PROFILE).where("column = 'sexo'").first().distinct == 2
    assert {(r.SEXO, r.EDAD) for r in table(jobs.AGES_NATION).collect()} == {("Hombres", 10), ("Mujeres", 20)}
    assert {(r.SEXO, r.EDAD) for r in table(jobs.AGES_STATE).collect()} == {("Hombres", 10)}
    assert table("cases_per_year").first().total == 12
    assert {r["mean"] for r in table("mean_days_to_location").collect()} == {-4.0}
    assert table("place_found_alive").first().per == 100.0
    rate = table("city_rates").where("sexo = 'Hombres' and grupo_edad = 'De 12 a 17 años'").first()
    assert (rate.total, rate.tasa) == (1, 10000.0)
    mapped = table("municipal_map").first()
    assert (mapped.MUN, mapped.n, mapped.tasa_desp, mapped.X) == ("Álvaro Obregón", 12, 1000.0, 1.0)
    assert mapped.quart_rangos == "1000.00-1000.00"
    figures = {r.name: r.value for r in table("report_figures").collect()}
    assert (figures["distinct_cases"], figures["top_3_municipalities"], len(figures)) == (1.0, 100.0, 38)
