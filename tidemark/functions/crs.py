"""Reference systems: what a code or a description says, and positions carried from one to another.

A system is longitude and latitude in degrees, a transverse Mercator plane
(any meridian, either hemisphere), a polar stereographic plane (either pole,
by scale or latitude of true scale) or the spherical Mercator plane of web
maps.  ``parse`` reads EPSG codes, URNs and both generations of well-known
text; what it does not know is refused, never guessed.  Datums on one another's
ellipsoid or nearly so (WGS 84, NAD83, ETRS89) count as one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.functions.geodesy import WGS84, Ellipsoid


class UnknownSystem(ValueError):
    """A description that names no system known here."""


@dataclass(frozen=True)
class System:
    """``kind``: geographic, transverse, polar or web; the numbers are degrees, metres and ratios."""

    kind: str
    central: float = 0.0
    origin: float = 0.0
    scale: float = 1.0
    true_scale: float | None = None
    easting: float = 0.0
    northing: float = 0.0
    south: bool = False
    metre: float = 1.0  # metres in a unit of the plane
    ellipsoid: Ellipsoid = WGS84


def zone(number: int, south: bool = False, ellipsoid: Ellipsoid = WGS84) -> System:
    """A UTM zone."""
    return System("transverse", central=6.0 * number - 183.0, scale=0.9996, easting=500_000.0, northing=1e7 if south else 0.0, ellipsoid=ellipsoid)


GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
DEGREES = System("geographic")
#: Codes that are no rule's: polar planes by pole, meridian and latitude of true scale, or by scale.
POLAR = {
    3413: System("polar", central=-45.0, true_scale=70.0),
    3995: System("polar", central=0.0, true_scale=71.0),
    3031: System("polar", central=0.0, true_scale=-71.0, south=True),
    3976: System("polar", central=0.0, true_scale=-70.0, south=True),
    32661: System("polar", scale=0.994, easting=2e6, northing=2e6),
    32761: System("polar", scale=0.994, easting=2e6, northing=2e6, south=True),
}


def from_code(code: int) -> System:
    """The system of an EPSG code."""
    base, number = divmod(code, 100)
    if code in (4326, 4979, 4269, 4258):
        return DEGREES
    if code in POLAR:
        return POLAR[code]
    if code == 3857:
        return System("web")
    if base in (326, 327) and 1 <= number <= 60:
        return zone(number, south=base == 327)
    if (base == 269 and 1 <= number <= 23) or (base == 258 and 28 <= number <= 38):
        return zone(number, ellipsoid=GRS80)
    raise UnknownSystem(f"EPSG:{code}")


# Well-known text: KEYWORD["name", number, KEYWORD[...], ...].
TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z_0-9]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')


def tree(text: str) -> list:
    """Well-known text as nested lists: keyword first, then names, numbers and lists."""
    stack: list[list] = [[]]
    at, text = 0, text.strip().lstrip("\ufeff")
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise UnknownSystem(f"not well-known text at {at}: {text[at : at + 20]!r}")
        at = found.end()
        name, word, number, mark = found.groups()
        if name is not None:
            stack[-1].append(name)
        elif word:
            stack[-1].append([word.upper()])
        elif number:
            stack[-1].append(float(number))
        elif mark in "[(":
            if not stack[-1] or not isinstance(stack[-1][-1], list):
                raise UnknownSystem("bracket without a keyword")
            stack.append(stack[-1][-1])
        elif mark in "])":
            if len(stack) == 1:
                raise UnknownSystem("bracket closed twice")
            stack.pop()
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise UnknownSystem("unfinished well-known text")
    return stack[0][0]


def _all(node: list, *keys: str) -> list[list]:
    """Every node below with one of the keywords, in order."""
    out = []
    for x in node[1:]:
        if isinstance(x, list):
            out += ([x] if x[0] in keys else []) + _all(x, *keys)
    return out


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


#: Parameters by what they mean; fixed names of the two generations and of common writers.
MEANING = {
    "central_meridian": "central", "longitude_of_center": "central", "longitude_of_natural_origin": "central", "straight_vertical_longitude_from_pole": "central", "longitude_of_origin": "central",
    "latitude_of_origin": "origin", "latitude_of_natural_origin": "origin", "latitude_of_center": "origin",
    "standard_parallel_1": "true_scale", "latitude_of_standard_parallel": "true_scale",
    "scale_factor": "scale", "scale_factor_at_natural_origin": "scale",
    "false_easting": "easting", "false_northing": "northing", "easting_at_false_origin": "easting", "northing_at_false_origin": "northing",
}


DEGREE = math.pi / 180


def _number(node: list, at: int, what: str) -> float:
    if len(node) <= at or not isinstance(node[at], float):
        raise UnknownSystem(f"{what} without a number")
    return node[at]


def from_text(text: str) -> System:
    """The system of well-known text of either generation."""
    root = tree(text)
    if root[0] in ("BOUNDCRS", "COMPOUNDCRS", "COMPD_CS"):
        inner = _all(root, "PROJCS", "PROJCRS", "PROJECTEDCRS", "GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS")
        if not inner:
            raise UnknownSystem(f"no horizontal system in {root[0]}")
        root = inner[0]
    shapes = _all(root, "SPHEROID", "ELLIPSOID")
    if not shapes:
        raise UnknownSystem("no ellipsoid")
    inverse = _number(shapes[0], 3, "ellipsoid")
    ellipsoid = Ellipsoid(_number(shapes[0], 2, "ellipsoid"), 1 / inverse if inverse else 0.0)
    if any(abs(_number(m, 2, "prime meridian")) > 1e-9 for m in _all(root, "PRIMEM", "PRIMEMERIDIAN")[:1]):
        raise UnknownSystem("prime meridian other than Greenwich")
    if root[0] in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS", "GEODETICCRS"):
        return System("geographic", ellipsoid=ellipsoid)
    if root[0] not in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        raise UnknownSystem(root[0])
    method = _all(root, "PROJECTION", "METHOD")
    if not method:
        raise UnknownSystem("no projection")
    held = {}
    for node in _all(root, "PARAMETER"):
        meaning = MEANING.get(_plain(str(node[1])))
        if meaning:
            value = _number(node, 2, "parameter")
            unit = [n for n in node[3:] if isinstance(n, list) and n[0] in ("ANGLEUNIT", "LENGTHUNIT", "UNIT", "SCALEUNIT")]
            if unit and unit[0][0] == "ANGLEUNIT":
                value *= _number(unit[0], 2, "unit") / DEGREE if abs(_number(unit[0], 2, "unit") - DEGREE) > 1e-12 else 1.0
            elif unit and unit[0][0] == "LENGTHUNIT":
                value *= _number(unit[0], 2, "unit")
            held[meaning] = value
    # First generation: one unit, which false easting and northing are in as well.  Second: the unit of the axes.
    own = [n for n in root[1:] if isinstance(n, list) and n[0] == "UNIT"]
    axes = own or [n for n in root[1:] if isinstance(n, list) and n[0] == "LENGTHUNIT"] or [u for n in root[1:] if isinstance(n, list) and n[0] == "AXIS" for u in _all(n, "LENGTHUNIT")]
    metre = _number(axes[-1], 2, "unit") if axes else 1.0
    if own:
        held = {k: v * metre if k in ("easting", "northing") else v for k, v in held.items()}
    name = _plain(str(method[0][1]))
    held |= {"metre": metre, "ellipsoid": ellipsoid}
    if name in ("transverse_mercator", "gauss_kruger"):
        held.pop("true_scale", None)
        return System("transverse", **held)
    if "stereographic" in name and ("polar" in name or "pole" in name):
        origin = held.pop("origin", None)
        # A latitude of origin short of the pole is that of true scale (the first generation's way to say it).
        if "true_scale" not in held and origin is not None and abs(origin) < 90 - 1e-9:
            held["true_scale"] = origin
        side = held.get("true_scale", origin)
        if side is None and "south" not in name and "north" not in name:
            raise UnknownSystem(f"{name} without a pole")
        return System("polar", south="south" in name or (side or 0.0) < 0, **held)
    if name in ("mercator_auxiliary_sphere", "popular_visualisation_pseudo_mercator"):
        return System("web")
    raise UnknownSystem(name)


def parse(given: int | str | System) -> System:
    """The system that a code, ``EPSG:n``, a URN, ``CRS84`` or well-known text names."""
    if isinstance(given, System):
        return given
    text = str(given).strip()
    if re.fullmatch("[0-9]+", text):
        return from_code(int(text))
    coded = re.fullmatch(r"(?:urn:ogc:def:crs:)?EPSG:(?:[0-9.]*:)?([0-9]+)", text, re.IGNORECASE)
    if coded:
        return from_code(int(coded.group(1)))
    if re.fullmatch(r"(?:urn:ogc:def:crs:)?OGC:(?:[0-9.]*:)?CRS84h?", text, re.IGNORECASE):
        return DEGREES
    return from_text(text)


def forward(system: System, lat: Column, lon: Column) -> Column:
    """struct(x, y) of a position in degrees; x is the longitude where the system has no plane."""
    s, far = system, system.ellipsoid
    if s.kind == "geographic":
        return F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    if s.kind == "web":
        half = F.lit(math.pi / 4) + F.radians(lat) / 2
        return F.struct((F.lit(geodesy.A) * F.radians(lon)).alias("x"), (F.lit(geodesy.A) * F.ln(F.tan(half))).alias("y"))
    if s.kind == "transverse":
        plane = geodesy.utm(lat, lon, s.central, s.scale, 0.0, far)
        rise = geodesy.meridian_m(s.origin, far) * s.scale
        return geodesy._let(plane, lambda p: F.struct(((p.x + F.lit(s.easting)) / F.lit(s.metre)).alias("x"), ((p.y - F.lit(rise) + F.lit(s.northing)) / F.lit(s.metre)).alias("y")))
    rho = geodesy.polar_radius(s.true_scale, s.scale, far)
    sign = -1.0 if s.south else 1.0
    plane = geodesy.polar_plane(F.lit(sign) * lat, F.radians(lon - F.lit(s.central)), rho, far)
    return geodesy._let(plane, lambda p: F.struct(((p.x + F.lit(s.easting)) / F.lit(s.metre)).alias("x"), ((F.lit(sign) * p.y + F.lit(s.northing)) / F.lit(s.metre)).alias("y")))


def inverse(system: System, x: Column, y: Column) -> Column:
    """struct(lat, lon) in degrees of a position in the plane."""
    s, far = system, system.ellipsoid
    if s.kind == "geographic":
        return F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    if s.kind == "web":
        lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(geodesy.A))) - F.lit(math.pi / 2))
        return F.struct(lat.alias("lat"), F.degrees(x / F.lit(geodesy.A)).alias("lon"))
    east, north = x * F.lit(s.metre) - F.lit(s.easting), y * F.lit(s.metre) - F.lit(s.northing)
    if s.kind == "transverse":
        place = geodesy.utm_inverse(east, north + F.lit(geodesy.meridian_m(s.origin, far) * s.scale), s.central, s.scale, 0.0, far)
        return geodesy._let(place, lambda p: F.struct(p.lat.alias("lat"), geodesy.wrapped_longitude(p.lon).alias("lon")))
    rho = geodesy.polar_radius(s.true_scale, s.scale, far)
    sign = -1.0 if s.south else 1.0
    place = geodesy.polar_inverse(east, F.lit(sign) * north, s.central, rho, far)
    return geodesy._let(place, lambda p: F.struct((F.lit(sign) * p.lat).alias("lat"), geodesy.wrapped_longitude(p.lon).alias("lon")))


def transform(source: System, target: System, x: Column, y: Column) -> Column:
    """struct(x, y) in ``target`` of a position in ``source``; as it is where both are one."""
    if source == target:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return geodesy._let(inverse(source, x, y), lambda p: forward(target, p.lat, p.lon))
