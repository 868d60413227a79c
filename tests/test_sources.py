import pytest
from pyspark.sql import types as T

from recuento import session
from recuento.sources import files, schemas


def test_codes_stay_text_and_missing_cells_are_null(spark, rows, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text('id_ent,name_ent,name_ent_short,id_mun,name_mun\n09, Ciudad ,NA,"",uno\n00,,x,015,"a,b"\n', "utf-8")
    df = files.read_csv(spark, str(path), schemas.GEO_CATALOG)
    assert rows(df) == [("00", None, "x", "015", "a,b"), ("09", "Ciudad", None, None, "uno")]


def test_wide_latin1_file_by_column_name(spark, rows, tmp_path):
    header = "EXTRA,NIVACAD,ENT,ID_PERSONA,NUMPER,FACTOR,EDAD,SEXO,OTRA"
    lines = [header, "Muñoz,04,09,p1,1,12,33,1,x", "Peña,,09,p2,2,,9999,3,y"]
    (tmp_path / "c_Personas09.CSV").write_bytes("\n".join(lines).encode("latin-1"))
    wanted = {f.name: f.dataType for f in schemas.CENSUS_PERSONS.fields}
    df = files.read_csv_columns(spark, str(tmp_path), wanted, encoding="ISO-8859-1")
    assert df.schema == schemas.CENSUS_PERSONS
    assert rows(df) == [("09", "p1", 12, 1, 1, 33, "04"), ("09", "p2", None, 2, 3, 9999, None)]
    names = files.read_csv_columns(spark, str(tmp_path), {"EXTRA": T.StringType()}, encoding="ISO-8859-1")
    assert rows(names) == [("Muñoz",), ("Peña",)]
    with pytest.raises(ValueError, match="AUSENTE"):
        files.read_csv_columns(spark, str(tmp_path), {"AUSENTE": T.StringType()})


def test_files_by_name(spark, rows, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    (tmp_path / "Viviendas00.csv").write_text("id\nv\n")
    (tmp_path / "Personas00.csv").write_text("id\np\n")
    assert rows(files.read_csv(spark, str(tmp_path), schema, name_pattern="*Personas*")) == [("p",)]


def test_header_must_fit_the_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), schema).collect()


def test_published_csv_and_snapshot(spark, rows, tmp_path):
    df = spark.createDataFrame([("09", "x"), ("10", None)], "ENT string, t string")
    files.write_published_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "10,NA" in text
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    for frame in (df.limit(1), df):
        files.write_snapshot(frame, str(tmp_path / "snapshot"), partition_by=["ENT"])
    back = files.read_snapshot(spark, str(tmp_path / "snapshot"))
    assert back.count() == 2
    plan = back.where("ENT = '09'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ENT" in plan


def test_delivery_formats(spark, rows, tmp_path):
    df = spark.createDataFrame([("c", "m", 0, 0, 1.0, 2.0)], schemas.REGION_VERTICES)
    files.write_snapshot(df, str(tmp_path / "p"))
    files.write_published_csv(df, str(tmp_path / "c"))
    assert rows(files.read_vertices(spark, str(tmp_path / "p"))) == rows(df)
    assert rows(files.read_vertices(spark, str(tmp_path / "c"), fmt="csv")) == rows(df)


class Settings:
    """The parts of a session that decide on the folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})
        self.conf = {session.CHECKPOINT_KEY: folder} if folder else {}


def test_shared_folder_comes_from_the_session():
    cluster = Settings("spark://host:7077", "/mnt/shared/")
    assert session.fresh_path(cluster, "t").startswith("/mnt/shared/recuento/t-")
    assert session.fresh_path(cluster, "t") != session.fresh_path(cluster, "t")
    unset = Settings("spark://host:7077")
    unset.conf["spark.sql.warehouse.dir"] = "hdfs://x/warehouse"
    assert session.shared_dir(unset) == "hdfs://x/warehouse/_stored"


def test_materialized_rows(spark, rows):
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    stored = session.materialize(df)
    assert rows(stored) == rows(df)
    assert stored.dtypes == df.dtypes


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path, rows):
    schema = T.StructType().add("id", T.IntegerType()).add("text", T.StringType()).add("n", T.IntegerType())
    df = spark.createDataFrame([(1, 'a\r\nb, "c"', 5), (2, " x ", None), (3, '"', 7)], schema)
    files.write_published_csv(df, str(tmp_path / "c"), rows_per_file=1)
    assert rows(files.read_csv(spark, str(tmp_path / "c"), schema, trim=False)) == rows(df)


def test_cells_that_do_not_fit(spark, tmp_path):
    schema = T.StructType().add("id", T.IntegerType()).add("n", T.IntegerType())
    (tmp_path / "f.csv").write_text("id,n\n1,7.0\n2,abc\n3,abc\n4,\n5,7.5\n")
    path = str(tmp_path / "f.csv")
    with pytest.raises(Exception, match="cell of n is not int"):
        files.read_csv(spark, path, schema).collect()
    known = {r.id: r.n for r in files.read_csv(spark, path, schema, bad="null").collect()}
    assert known == {1: 7, 2: None, 3: None, 4: None, 5: None}
    found = {(r.column, r.value): r.rows for r in files.bad_cells(spark, path, schema).collect()}
    assert found == {("n", "abc"): 2, ("n", "7.5"): 1}


def test_rows_of_another_width(spark, tmp_path):
    schema = T.StructType().add("id", T.IntegerType()).add("n", T.IntegerType())
    (tmp_path / "f.csv").write_text("id,n\n1,2\n3\n")
    with pytest.raises(Exception, match="does not match the header"):
        files.read_csv(spark, str(tmp_path / "f.csv"), schema).count()
    assert [(r.column, r.value, r.rows) for r in files.bad_cells(spark, str(tmp_path / "f.csv"), schema).collect()] == [(None, "3", 1)]


def test_vocabulary_terms_as_written(spark, tmp_path):
    (tmp_path / "v.csv").write_bytes(b'field,raw,canonical,priority\nf,"comision x\r\n",c,1\nf,"colectivo, ""hasta"" uno",d,2\n')
    found = [(r.raw, r.canonical) for r in files.read_vocabulary(spark, str(tmp_path / "v.csv")).orderBy("priority").collect()]
    assert found == [("comision x\r\n", "c"), ('colectivo, "hasta" uno', "d")]


def test_stored_tables_are_deleted(spark):
    with session.stored_tables(spark):
        path = session.fresh_path(spark, "gone")
        spark.range(3).write.parquet(path)
    kept = session.materialize(spark.range(3))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert kept.count() == 3
