"""Schemas of the known tables. Codes are text; ages and weights are whole numbers."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_text, _int, _long, _double, _time = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)

# Column names of the registry deliveries.
REGISTRY_RAW = _schema(
    id=_text,
    fecha_de_inicio_de_reporte_en_la_cbpcdmx=_text,
    fuente_de_reporte=_text,
    origen_de_la_noticia=_text,
    sexo=_text,
    edad=_int,
    lugar_de_nacimiento=_text,
    nacionalidad=_text,
    escolaridad=_text,
    estado_civil=_text,
    parentesco_reportante=_text,
    fecha_de_desaparicion=_text,
    entidad_de_desaparicion=_text,
    municipio_alcadia_de_la_desaparicion=_text,
    colonia_de_la_desaparicion=_text,
    circunstancias_de_la_desaparicion=_text,
    estatus_de_localizacion=_text,
    condicion_localizacion=_text,
    fecha_de_localizacion=_text,
    estado_de_salud=_text,
    constancia_de_localizacion=_text,
    municipio_alcaldia_de_la_localizacion=_text,
    tipo_de_lugar_de_la_localizacion=_text,
    motivo_referido_de_desaparicion=_text,
)

REGISTRY_RAW_TYPED = T.StructType(
    [
        T.StructField(f.name, _time if f.name.startswith("fecha_") else f.dataType)
        for f in REGISTRY_RAW.fields
    ]
    + [
        T.StructField("clave_municipio", _text),
        T.StructField("clave_colonia", _text),
        T.StructField("delito_del_que_fue_victima", _text),
    ]
)

GEO_CATALOG = _schema(id_ent=_text, name_ent=_text, name_ent_short=_text, id_mun=_text, name_mun=_text)

CENSUS_PERSONS = _schema(
    ENT=_text,
    ID_PERSONA=_text,
    FACTOR=_int,
    NUMPER=_int,
    SEXO=_int,
    EDAD=_int,
    NIVACAD=_text,
)

POPULATION_PROJECTION = T.StructType(
    [
        T.StructField("NOM_ENT", _text),
        T.StructField("A—O", _int),
        T.StructField("CLAVE_ENT", _int),
        T.StructField("MUN", _text),
        T.StructField("POB", _int),
    ]
)

NATIONAL_COUNTS = _schema(
    condicion_actual_de_las_personas=_text,
    edad=_int,
    hombres=_int,
    mujeres=_int,
)

REGION_VERTICES = _schema(CVEGEO=_text, CVE_MUN=_text, ring_id=_int, pos=_int, x=_double, y=_double)

VOCABULARY = _schema(field=_text, raw=_text, canonical=_text, priority=_int)
