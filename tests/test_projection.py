import math

import pytest
from pyspark.sql import functions as F

from recuento.functions.projection import Lambert, to_degrees

LAYER = (
    'PROJCS["X",GEOGCS["G",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0]],'
    'PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",2500000.0],PARAMETER["False_Northing",0.0],'
    'PARAMETER["Central_Meridian",-102.0],PARAMETER["Standard_Parallel_1",17.5],PARAMETER["Standard_Parallel_2",29.5],'
    'PARAMETER["Latitude_Of_Origin",12.0],UNIT["Meter",1.0]]'
)


def forward(lon, lat, layer):
    """Planar coordinates of degrees, from the definition."""
    cone, scale, origin = layer.constants()
    e, s = layer.eccentricity, math.sin(math.radians(lat))
    t = math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    radius, angle = layer.semi_major * scale * t**cone, cone * math.radians(lon - layer.origin_longitude)
    return layer.false_easting + radius * math.sin(angle), layer.false_northing + origin - radius * math.cos(angle)


SOUTH = Lambert(6378137.0, 298.257222101, -5.0, -42.0, -32.0, -60.0, 1000.0, -5000.0)
SPHERE = Lambert(6371000.0, 0.0, 45.0, 45.0, 45.0, 3.0, 0.0, 0.0)


@pytest.mark.parametrize("layer", [Lambert.from_layer(LAYER), SOUTH, SPHERE], ids=["layer", "south", "sphere"])
def test_there_and_back(spark, layer):
    points = [(float(lon), float(lat)) for lon in range(-117, -85, 4) for lat in (14, 19.4, 23, 32.7)]
    points = [(layer.origin_longitude + lon + 102, math.copysign(lat, layer.parallel_1)) for lon, lat in points]
    df = spark.createDataFrame([(*p, *forward(*p, layer)) for p in points], "lon double, lat double, x double, y double")
    lon, lat = to_degrees(F.col("x"), F.col("y"), layer)
    worst = df.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-9


def test_nulls_and_other_projections(spark):
    lon, lat = to_degrees(F.lit(None).cast("double"), F.lit(0.0), Lambert.from_layer(LAYER))
    assert tuple(spark.range(1).select(lon, lat).first()) == (None, None)
    with pytest.raises(ValueError):
        Lambert.from_layer(LAYER.replace("Lambert_Conformal_Conic", "Mercator"))
    with pytest.raises(ValueError):
        Lambert.from_layer(LAYER.replace("Central_Meridian", "Other"))
