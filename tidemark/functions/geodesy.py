"""Spherical, ellipsoidal and projected distances and positions, as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    flat: float

    @property
    def e2(self) -> float:
        return self.flat * (2 - self.flat)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def n(self) -> float:
        return self.flat / (2 - self.flat)

    @property
    def radius(self) -> float:
        """Of the circle as long as a meridian."""
        return self.a / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)


WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
A, FLAT = WGS84.a, WGS84.flat


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def wrapped_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def _alphas(n: float) -> tuple[float, ...]:
    return (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )


def _betas(n: float) -> tuple[float, ...]:
    return (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )


def _deltas(n: float) -> tuple[float, ...]:
    return (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the expression stays linear in size."""
    return F.element_at(F.transform(F.array(value), use), 1)


def utm(lat: Column, lon: Column, central: float = -147.0, scale: float = 0.9996, easting: float = 500_000.0, on: Ellipsoid = WGS84) -> Column:
    """struct(x, y) of a transverse Mercator zone (north), by the Krüger series."""
    size, series = scale * on.radius, _alphas(on.n)
    lam = F.radians(lon - F.lit(central))
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - F.lit(on.e) * F.atanh(F.lit(on.e) * sine))
    return _let(
        F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t)).alias("eta")),
        lambda p: F.struct(
            (F.lit(easting) + F.lit(size) * sum((F.lit(a) * F.cos(F.lit(2.0 * j) * p.xi) * F.sinh(F.lit(2.0 * j) * p.eta) for j, a in enumerate(series, 1)), p.eta)).alias("x"),
            (F.lit(size) * sum((F.lit(a) * F.sin(F.lit(2.0 * j) * p.xi) * F.cosh(F.lit(2.0 * j) * p.eta) for j, a in enumerate(series, 1)), p.xi)).alias("y"),
        ),
    )


def utm_inverse(x: Column, y: Column, central: float = -147.0, scale: float = 0.9996, easting: float = 500_000.0, on: Ellipsoid = WGS84) -> Column:
    """struct(lat, lon) of a position in the zone."""
    size = scale * on.radius
    raw = F.struct((y / F.lit(size)).alias("xi"), ((x - F.lit(easting)) / F.lit(size)).alias("eta"))

    def plane(p):
        xi = sum((-F.lit(b) * F.sin(F.lit(2.0 * j) * p.xi) * F.cosh(F.lit(2.0 * j) * p.eta) for j, b in enumerate(_betas(on.n), 1)), p.xi)
        eta = sum((-F.lit(b) * F.cos(F.lit(2.0 * j) * p.xi) * F.sinh(F.lit(2.0 * j) * p.eta) for j, b in enumerate(_betas(on.n), 1)), p.eta)
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def sphere(p):
        chi = F.asin(F.sin(p.xi) / F.cosh(p.eta))
        return F.struct(chi.alias("chi"), F.atan2(F.sinh(p.eta), F.cos(p.xi)).alias("lam"))

    def degrees(p):
        lat = sum((F.lit(d) * F.sin(F.lit(2.0 * j) * p.chi) for j, d in enumerate(_deltas(on.n), 1)), p.chi)
        return F.struct(F.degrees(lat).alias("lat"), (F.lit(central) + F.degrees(p.lam)).alias("lon"))

    return _let(_let(_let(raw, plane), sphere), degrees)


def meridian_m(lat: float, on: Ellipsoid = WGS84) -> float:
    """Metres along a meridian from the equator to a latitude."""
    if not lat:
        return 0.0
    sine = math.sin(math.radians(lat))
    xi = math.atan(math.sinh(math.atanh(sine) - on.e * math.atanh(on.e * sine)))
    return on.radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_alphas(on.n), 1)))


def _conformal(sine: float, on: Ellipsoid) -> float:
    return math.tan(math.pi / 4 - math.asin(sine) / 2) / ((1 - on.e * sine) / (1 + on.e * sine)) ** (on.e / 2)


def polar_radius(true_scale: float | None, scale: float = 1.0, on: Ellipsoid = WGS84) -> float:
    """Metres from the pole for each unit of the conformal half-angle's tangent: by latitude of true scale, or by scale at the pole."""
    if true_scale is None or abs(true_scale) > 90 - 1e-9:
        return 2 * on.a * scale / math.sqrt((1 + on.e) ** (1 + on.e) * (1 - on.e) ** (1 - on.e))
    s = math.sin(math.radians(abs(true_scale)))
    return scale * on.a * (math.cos(math.radians(true_scale)) / math.sqrt(1 - on.e2 * s * s)) / _conformal(s, on)


def polar_plane(lat: Column, lam: Column, rho: float, on: Ellipsoid = WGS84) -> Column:
    """struct(x, y) seen from the north pole; ``lam``: radians from the central meridian."""
    sine = F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((F.lit(1.0) - F.lit(on.e) * sine) / (F.lit(1.0) + F.lit(on.e) * sine), F.lit(on.e / 2))
    return _let(F.lit(rho) * t, lambda r: F.struct((r * F.sin(lam)).alias("x"), (-r * F.cos(lam)).alias("y")))


def polar_inverse(x: Column, y: Column, meridian: float, rho: float, on: Ellipsoid = WGS84) -> Column:
    """struct(lat, lon) of a position in the north polar plane, by the series of the conformal latitude."""
    chi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(F.hypot(x, y) / F.lit(rho))
    lon = F.lit(meridian) + F.degrees(F.atan2(x, -y))

    def degrees(p):
        lat = sum((F.lit(d) * F.sin(F.lit(2.0 * j) * p.chi) for j, d in enumerate(_deltas(on.n), 1)), p.chi)
        return F.struct(F.degrees(lat).alias("lat"), p.lon.alias("lon"))

    return _let(F.struct(chi.alias("chi"), lon.alias("lon")), degrees)


def polar(lat: Column, lon: Column, true_scale: float = 70.0, meridian: float = -45.0) -> Column:
    """struct(x, y) of the north polar stereographic plane."""
    return polar_plane(lat, F.radians(lon - F.lit(meridian)), polar_radius(true_scale))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 8) -> Column:
    """Length on the ellipsoid by a fixed number of Vincenty's rounds; meant for neighbouring points."""
    b = A * (1 - FLAT)
    reduced = lambda lat: F.atan(F.lit(1 - FLAT) * F.tan(F.radians(lat)))
    base = F.struct(reduced(lat1).alias("u"), reduced(lat2).alias("v"), F.radians(lon2 - lon1).alias("l"))

    def solve(p):
        def step(acc, _):
            lam = acc.lam
            ss = F.sqrt(F.pow(F.cos(p.v) * F.sin(lam), F.lit(2.0)) + F.pow(F.cos(p.u) * F.sin(p.v) - F.sin(p.u) * F.cos(p.v) * F.cos(lam), F.lit(2.0)))
            cs = F.sin(p.u) * F.sin(p.v) + F.cos(p.u) * F.cos(p.v) * F.cos(lam)

            def next_lam(q):
                sa = F.when(q.ss > 0, F.cos(p.u) * F.cos(p.v) * F.sin(lam) / q.ss).otherwise(F.lit(0.0))
                c2 = F.lit(1.0) - sa * sa
                cm = F.when(c2 > 1e-12, q.cs - F.lit(2.0) * F.sin(p.u) * F.sin(p.v) / c2).otherwise(F.lit(0.0))
                c = F.lit(FLAT / 16) * c2 * (F.lit(4.0) + F.lit(FLAT) * (F.lit(4.0) - F.lit(3.0) * c2))
                sigma = F.atan2(q.ss, q.cs)
                lam2 = p.l + (F.lit(1.0) - c) * F.lit(FLAT) * sa * (sigma + c * q.ss * (cm + c * q.cs * (F.lit(-1.0) + F.lit(2.0) * cm * cm)))
                return F.struct(lam2.alias("lam"), q.ss.alias("ss"), q.cs.alias("cs"), c2.alias("c2"), cm.alias("cm"))

            return _let(F.struct(ss.alias("ss"), cs.alias("cs")), next_lam)

        zero = F.lit(0.0)
        start = F.struct(p.l.alias("lam"), zero.alias("ss"), zero.alias("cs"), zero.alias("c2"), zero.alias("cm"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)

    def length(q):
        u2 = q.c2 * F.lit((A * A - b * b) / (b * b))
        big = F.lit(1.0) + u2 / 16384 * (F.lit(4096.0) + u2 * (F.lit(-768.0) + u2 * (F.lit(320.0) - F.lit(175.0) * u2)))
        small = u2 / 1024 * (F.lit(256.0) + u2 * (F.lit(-128.0) + u2 * (F.lit(74.0) - F.lit(47.0) * u2)))
        turn = small * q.ss * (q.cm + small / 4 * (q.cs * (F.lit(-1.0) + F.lit(2.0) * q.cm * q.cm) - small / 6 * q.cm * (F.lit(-3.0) + F.lit(4.0) * q.ss * q.ss) * (F.lit(-3.0) + F.lit(4.0) * q.cm * q.cm)))
        return F.lit(b) * big * (F.atan2(q.ss, q.cs) - turn)

    return _let(_let(base, solve), length)


def acute_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions, folded to at most 90; null for a zero vector."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    cosine = F.greatest(F.least((ax * bx + ay * by) / F.nullif(size, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    return _let(F.when(size > 0, F.degrees(F.acos(cosine))), lambda a: F.when(a > 90, F.lit(180.0) - a).otherwise(a))
