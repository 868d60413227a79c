"""Fixed values of the data products: labels, codes, levels and column lists."""

from __future__ import annotations

from recuento.functions.categories import Band

# Age bands, in order.
AGE_BANDS = (
    Band("Menores de 12 años", below=12),
    Band("De 12 a 17 años", 12, 17),
    Band("De 18 a 23 años", 18, 23),
    Band("De 24 a 29 años", 24, 29),
    Band("De 30 a 44 años", 30, 44),
    Band("De 45 a 59 años", 45, 59),
    Band("60 años o más", 60),
)
AGE_LEVELS = tuple(b.label for b in AGE_BANDS)

# Location status, in order.
ALIVE = "con vida"
DEAD = "sin vida"
MISSING = "sigue desaparecida"
STATUS_LEVELS = (ALIVE, DEAD, MISSING)

# Status labels of the national counts.
NATIONAL_STATUS = (
    ("LOCALIZADAS CON VIDA", ALIVE),
    ("LOCALIZADAS SIN VIDA", DEAD),
    ("DESAPARECIDAS Y NO LOCALIZADAS", MISSING),
)

# Sex labels.
MAN = "hombre"
WOMAN = "mujer"
SEX_PLURAL = ((MAN, "Hombres"), (WOMAN, "Mujeres"))
CENSUS_SEX = {"Hombres": [1], "Mujeres": [3]}

# Census schooling levels by code.
CENSUS_SCHOOLING = {
    "ninguno": ["00"],
    "otra": ["01"],
    "primaria": ["02"],
    "secundaria": ["03"],
    "preparatoria": ["04", "05", "09"],
    "licenciatura": ["10", "11"],
    "posgrado": ["12", "13", "14"],
    "profesional técnico": ["06", "07", "08"],
}
NOT_APPLICABLE = "No aplica"
NOT_SPECIFIED = "No especificado"
CENSUS_SOURCE = "Censo"
AGE_NOT_SPECIFIED = 9999
STATE_CODE = "09"

# State and year of the population projection.
STATE_NAME = "Ciudad de México"
PROJECTION_YEAR = 2021

# Municipality codes by name.
MUNICIPALITY_CODES = {
    "Álvaro Obregón": "09010",
    "Azcapotzalco": "09002",
    "Benito Juárez": "09014",
    "Coyoacán": "09003",
    "Cuajimalpa de Morelos": "09004",
    "Cuauhtémoc": "09015",
    "Gustavo A. Madero": "09005",
    "Iztacalco": "09006",
    "Iztapalapa": "09007",
    "La Magdalena Contreras": "09008",
    "Miguel Hidalgo": "09016",
    "Milpa Alta": "09009",
    "Tlalpan": "09012",
    "Tláhuac": "09011",
    "Venustiano Carranza": "09017",
    "Xochimilco": "09013",
}

# Years counted one by one, and the bucket before them.
EARLY_YEARS = (1966, 2013)
EARLY_LABEL = "previo a 2013"
SINGLE_YEARS = tuple(range(2014, 2022))

# Columns of the clean registry, December delivery.
DECEMBER_COLUMNS = (
    "id",
    "inegi",
    "fecha_de_inicio_de_reporte_en_la_cbpcdmx",
    "fuente_de_reporte",
    "origen_de_la_noticia",
    "sexo",
    "edad",
    "lugar_de_nacimiento",
    "nacionalidad",
    "escolaridad",
    "estado_civil",
    "parentesco_reportante",
    "fecha_de_desaparicion",
    "year_desaparicion",
    "cve_ent_desp",
    "entidad_de_desaparicion",
    "cv_mun_desp",
    "municipio_alcadia_de_la_desaparicion",
    "colonia_de_la_desaparicion",
    "circunstancias_de_la_desaparicion",
    "estatus_de_localizacion",
    "condicion_localizacion",
    "fecha_de_localizacion",
    "year_localizacion",
    "estado_de_salud",
    "constancia_de_localizacion",
    "municipio_alcaldia_de_la_localizacion",
    "tipo_de_lugar_de_la_localizacion",
    "motivo_referido_de_desaparicion",
)

# Columns of the clean registry, July delivery.
JULY_COLUMNS = (
    "id",
    "fecha_de_inicio_de_reporte_en_la_cbpcdmx",
    "fuente_de_reporte",
    "origen_de_la_noticia",
    "sexo",
    "edad",
    "lugar_de_nacimiento",
    "nacionalidad",
    "escolaridad",
    "estado_civil",
    "parentesco_reportante",
    "fecha_de_desaparicion",
    "año_desaparicion",
    "entidad_de_desaparicion",
    "clave_municipio_desp",
    "municipio_alcadia_de_la_desaparicion",
    "clave_colonia_desp",
    "colonia_de_la_desaparicion",
    "circunstancias_de_la_desaparicion",
    "estatus_de_localizacion",
    "condicion_localizacion",
    "fecha_de_localizacion",
    "año_localizacion",
    "estado_de_salud",
    "constancia_de_localizacion",
    "municipio_alcaldia_de_la_localizacion",
    "tipo_de_lugar_de_la_localizacion",
    "motivo_referido_de_desaparicion",
    "delito_del_que_fue_victima",
)

# Spellings of states and municipalities that the catalog joins on.
CATALOG_STATE_NAMES = (("distrito federal", "ciudad de méxico"),)
DECEMBER_STATES = (
    ("ciudad de mexico", "ciudad de méxico"),
    ("mexico", "méxico"),
    ("veracruz", "veracruz de ignacio de la llave"),
)
DECEMBER_MUNICIPALITIES = (
    ("acapulco de juarez", "acapulco de juárez"),
    ("alvaro obregon", "álvaro obregón"),
    ("benito juarez", "benito juárez"),
    ("chimalhuacan", "chimalhuacán"),
    ("coyoacan", "coyoacán"),
    ("cuauhtemoc", "cuauhtémoc"),
    ("tlahuac", "tláhuac"),
    ("tultitlan", "tultitlán"),
    ("atizapan de zaragoza", "atizapán de zaragoza"),
    ("naucalpan de juarez", "naucalpan de juárez"),
)

# One-value replacements of the July delivery, by column.
JULY_REPLACEMENTS = {
    "lugar_de_nacimiento": (
        ("ciudad de mexico", " ciudad de méxico"),
        ("estado de mexico", "méxico"),
        ("michoacán de ocampo", "michoacán"),
        ("michoacan", "michoacán"),
        ("Puebla", "puebla"),
        ("tampico", "tamaulipas"),
        ("veracruz de ignacio de la llave", "veracruz"),
    ),
    "estado_civil": (("divorciado", "divorciado(a)"),),
    "entidad_de_desaparicion": (
        ("ciudad de mexico", "ciudad de méxico"),
        ("estado de mexico", "méxico"),
        ("veracruz de ignacio de la llave", "veracruz"),
    ),
    "municipio_alcadia_de_la_desaparicion": (("alvaro obregon", "alvaro obregón"),),
    "estado_de_salud": (("buen estado general", "buen estado"),),
    "municipio_alcaldia_de_la_localizacion": (
        ("ecatepec", "ecatepec de morelos"),
        ("tlalnepantla", "tlalnepantla de baz"),
    ),
}
