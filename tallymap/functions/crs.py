"""Map projections as Column builders, and the repair of wrongly projected geometries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymap.functions.geometry import bind, first_position, map_positions

# GRS80 ellipsoid and Lambert-93 (parallels 44 and 49, origin 46.5 N 3 E).
MAJOR_AXIS = 6378137.0
FLATTENING = 1 / 298.257222101
ECCENTRICITY = 0.08181919104281579
LAMBERT_N = 0.7256077650532686
LAMBERT_C = 1.842897922402107
LAMBERT_R0 = 6055612.049875991
LAMBERT_X0 = 700000.0
LAMBERT_Y0 = 6600000.0
LAMBERT_LON0 = 3.0

# UTM zone 40 south.
UTM_SCALE = 0.9996
UTM_LON0 = 57.0
UTM_X0 = 500000.0
UTM_Y0 = 10000000.0

# Fixed values of the repair rule: ordinates above 100 are metres; north of 53 degrees
# lies outside the territory, so the coordinates were zone 40 south.
PROJECTED_ABOVE = 100.0
OUTSIDE_ABOVE = 53.0

REPAIR_ITERATIONS = 5


def _lonlat(lon: Column, lat: Column) -> Column:
    return F.struct(F.degrees(lon).alias("x"), F.degrees(lat).alias("y"))


def lambert93_to_lonlat(p: Column) -> Column:
    dx = p["x"] - LAMBERT_X0
    dy = F.lit(LAMBERT_Y0 + LAMBERT_R0) - p["y"]

    def inverse(iso: Column) -> Column:
        sine = F.tanh(iso)  # of the latitude: only its sine is iterated
        for _ in range(REPAIR_ITERATIONS):
            sine = F.tanh(iso + ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
        return F.asin(sine)

    radius = F.sqrt(dx * dx + dy * dy)
    iso = F.ln(radius / (MAJOR_AXIS * LAMBERT_C)) / (-LAMBERT_N)
    lon = F.atan2(dx, dy) / LAMBERT_N + math.radians(LAMBERT_LON0)
    return _lonlat(lon, bind(iso, inverse))


def lonlat_to_lambert93(p: Column) -> Column:
    lat = F.radians(p["y"])
    iso = F.atanh(F.sin(lat)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(lat))
    turn = (F.radians(p["x"]) - math.radians(LAMBERT_LON0)) * LAMBERT_N
    return bind(
        F.exp(iso * -LAMBERT_N) * (MAJOR_AXIS * LAMBERT_C),
        lambda r: F.struct(
            (r * F.sin(turn) + LAMBERT_X0).alias("x"),
            (F.lit(LAMBERT_Y0 + LAMBERT_R0) - r * F.cos(turn)).alias("y"),
        ),
    )


def transverse_series() -> dict[str, object]:
    """Krueger series of the ellipsoid: rectifying radius, beta (inverse) and delta (latitude)."""
    n = FLATTENING / (2 - FLATTENING)
    return {
        "radius": MAJOR_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    }


def utm40s_to_lonlat(p: Column) -> Column:
    series = transverse_series()
    scale = UTM_SCALE * series["radius"]

    def inverse(s: Column) -> Column:
        xi, eta = s["xi"], s["eta"]
        xi1, eta1 = xi, eta
        for j, b in enumerate(series["beta"], start=1):
            xi1 = xi1 - b * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
            eta1 = eta1 - b * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        return bind(F.struct(xi1.alias("xi"), eta1.alias("eta")), spherical)

    def spherical(s: Column) -> Column:
        lon = F.atan2(F.sinh(s["eta"]), F.cos(s["xi"])) + math.radians(UTM_LON0)
        return bind(
            F.asin(F.sin(s["xi"]) / F.cosh(s["eta"])),
            lambda chi: _lonlat(
                lon,
                chi
                + sum(
                    (d * F.sin(chi * (2 * j)) for j, d in enumerate(series["delta"], start=1)),
                    F.lit(0.0),
                ),
            ),
        )

    return bind(
        F.struct(((p["y"] - UTM_Y0) / scale).alias("xi"), ((p["x"] - UTM_X0) / scale).alias("eta")), inverse
    )


def web_mercator_to_lonlat(p: Column) -> Column:
    return _lonlat(p["x"] / MAJOR_AXIS, F.atan(F.exp(p["y"] / MAJOR_AXIS)) * 2 - math.pi / 2)


def repair_case(geom: Column) -> Column:
    """Which repair a geometry needs, decided on its first position."""

    def decide(p: Column) -> Column:
        return F.when(
            p["y"] > PROJECTED_ABOVE,
            F.when(lambert93_to_lonlat(p)["y"] > OUTSIDE_ABOVE, "utm40s").otherwise("lambert93"),
        ).otherwise(F.when(p["y"] > OUTSIDE_ABOVE, "utm40s_as_lambert93").otherwise("lonlat"))

    return bind(first_position(geom), lambda p: F.when(p["y"].isNotNull(), decide(p)))


def repair_projection(geom: Column, case: Column) -> Column:
    """The geometry in longitude and latitude, by the case found for it."""
    return (
        F.when(case == "lambert93", map_positions(geom, lambert93_to_lonlat))
        .when(case == "utm40s", map_positions(geom, utm40s_to_lonlat))
        .when(
            case == "utm40s_as_lambert93",
            map_positions(geom, lambda p: bind(lonlat_to_lambert93(p), utm40s_to_lonlat)),
        )
        .otherwise(geom)
    )
