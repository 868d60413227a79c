"""From a conic layer's coordinates to degrees."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 7
"""Each round shrinks the error of the latitude about 150 times; the first one is below 0.004."""


@dataclass(frozen=True)
class Lambert:
    """A Lambert conformal conic projection with two standard parallels; angles in degrees."""

    semi_major: float
    inverse_flattening: float
    parallel_1: float
    parallel_2: float
    origin_latitude: float
    origin_longitude: float
    false_easting: float
    false_northing: float

    @classmethod
    def from_layer(cls, text: str) -> Lambert:
        """The parameters as a layer's projection file names them."""

        def parameter(name: str) -> float:
            found = re.search(rf'"{name}"\s*,\s*([-+0-9.eE]+)', text, re.IGNORECASE)
            if not found:
                raise ValueError(f"no {name} in the projection file")
            return float(found[1])

        spheroid = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)', text, re.IGNORECASE)
        if not spheroid or not re.search(r'PROJECTION\s*\[\s*"Lambert_Conformal_Conic', text, re.IGNORECASE):
            raise ValueError("not a Lambert conformal conic projection")
        names = ("Standard_Parallel_1", "Standard_Parallel_2", "Latitude_Of_Origin", "Central_Meridian", "False_Easting", "False_Northing")
        return cls(float(spheroid[1]), float(spheroid[2]), *map(parameter, names))

    @property
    def eccentricity(self) -> float:
        flattening = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return math.sqrt(flattening * (2 - flattening))

    def constants(self) -> tuple[float, float, float]:
        """The cone's constant, its scale and the radius of the origin's parallel."""
        e = self.eccentricity

        def m(degrees: float) -> float:
            return math.cos(math.radians(degrees)) / math.sqrt(1 - (e * math.sin(math.radians(degrees))) ** 2)

        def t(degrees: float) -> float:
            s = math.sin(math.radians(degrees))
            return math.tan(math.pi / 4 - math.radians(degrees) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

        one, two = self.parallel_1, self.parallel_2
        cone = math.sin(math.radians(one)) if one == two else math.log(m(one) / m(two)) / math.log(t(one) / t(two))
        scale = m(one) / (cone * t(one) ** cone)
        return cone, scale, self.semi_major * scale * t(self.origin_latitude) ** cone


def to_degrees(x: Column, y: Column, layer: Lambert) -> tuple[Column, Column]:
    """Longitude and latitude of planar coordinates; NULL where one of them is.

    The latitude has no closed form: from that of a sphere it is improved in a
    fixed number of rounds, so every row costs the same.
    """
    cone, scale, origin = layer.constants()
    e = layer.eccentricity
    east, south = x - layer.false_easting, F.lit(origin) - (y - layer.false_northing)
    side = math.copysign(1.0, cone)
    radius = F.sqrt(east * east + south * south) * side
    angle = F.atan2(east * side, south * side)
    t = F.pow(radius / (layer.semi_major * scale), F.lit(1 / cone))
    latitude = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(ROUNDS):
        sine = F.sin(latitude) * e
        latitude = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - sine) / (1 + sine), F.lit(e / 2)))
    return F.degrees(angle / cone) + layer.origin_longitude, F.degrees(latitude)
