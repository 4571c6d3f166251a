"""Area, length, convex hull and ring checks over the canonical geometry column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymap.functions.crs import ECCENTRICITY, FLATTENING, MAJOR_AXIS
from tallymap.functions.geometry import bind, positions, total
from tallymap.schema import POSITION

_RING = f"array<{POSITION.simpleString()}>"


def segments(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(from, to)`` for each segment of a ring; no segments when it is too short."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), f)


def _over_parts(geom: Column, kind: str, f: Callable[[Column], Column]) -> Column:
    """Sum of ``f(rings)`` over the parts of one kind."""
    chosen = F.filter(geom["parts"], lambda p: p["kind"] == kind)
    return total(F.transform(chosen, lambda p: f(p["rings"])))


def _less_holes(ring_area: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def area(rings: Column) -> Column:
        return total(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))))

    return area


def signed_ring_area(ring: Column) -> Column:
    """Shoelace area relative to the first position; negative for clockwise rings."""

    def twice(a: Column, b: Column) -> Column:
        o = ring[0]
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

    return total(segments(ring, twice)) / 2


def planar_area(geom: Column) -> Column:
    """Square units of the coordinates; holes are taken off; 0 for points and lines."""
    return _over_parts(geom, "A", _less_holes(lambda r: F.abs(signed_ring_area(r))))


def winding_area(geom: Column) -> Column:
    """Signed area of the outer rings: negative where a ring runs clockwise."""
    return _over_parts(geom, "A", lambda rings: signed_ring_area(F.get(rings, F.lit(0))))


def planar_length(geom: Column) -> Column:
    """Length of the lines; 0 for points and polygons."""

    def step(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.sqrt(dx * dx + dy * dy)

    return _over_parts(geom, "L", lambda rings: total(segments(rings[0], step)))


# ---- on the ellipsoid -------------------------------------------------------------------


def _authalic_q(sin_lat: Column | float) -> Column:
    """Area function of latitude; proportional to the sine of the authalic latitude."""
    e = ECCENTRICITY
    s = sin_lat if isinstance(sin_lat, Column) else F.lit(sin_lat)
    return (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)


def geodesic_area(geom: Column) -> Column:
    """Square metres on the ellipsoid of longitude/latitude rings (equal-area sphere)."""
    q_pole = _authalic_q(1.0)
    radius2 = MAJOR_AXIS * MAJOR_AXIS * q_pole / 2

    def ring_area(ring: Column) -> Column:
        bands = F.transform(
            ring,
            lambda p: F.struct(
                F.radians(p["x"]).alias("lon"), (_authalic_q(F.sin(F.radians(p["y"]))) / q_pole).alias("s")
            ),
        )
        # Heights are taken from the first position: the longitudes of a ring add up to nothing, so
        # the sum is the same and small rings do not drown in the distance to the equator.
        strips = bind(
            bands,
            lambda b: total(
                segments(
                    b, lambda u, v: (v["lon"] - u["lon"]) * ((u["s"] - b[0]["s"]) + (v["s"] - b[0]["s"]))
                )
            ),
        )
        return F.abs(strips) / 2 * radius2

    return _over_parts(geom, "A", _less_holes(ring_area))


def geodesic_length(geom: Column) -> Column:
    """Metres along longitude/latitude lines (Andoyer-Lambert)."""

    def reduced(lat: Column) -> Column:
        return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))

    def step(a: Column, b: Column) -> Column:
        return bind(
            F.struct(
                reduced(a["y"]).alias("u"),
                reduced(b["y"]).alias("v"),
                F.radians(b["x"] - a["x"]).alias("d"),
            ),
            lambda s: bind(
                F.struct(
                    ((s["u"] + s["v"]) / 2).alias("p"),
                    ((s["v"] - s["u"]) / 2).alias("q"),
                    _central_angle(s["u"], s["v"], s["d"]).alias("sigma"),
                ),
                corrected,
            ),
        )

    def corrected(t: Column) -> Column:
        sigma = t["sigma"]
        half_cos, half_sin = F.cos(sigma / 2), F.sin(sigma / 2)
        x = (sigma - F.sin(sigma)) * F.pow(F.sin(t["p"]) * F.cos(t["q"]) / half_cos, 2)
        y = (sigma + F.sin(sigma)) * F.pow(F.cos(t["p"]) * F.sin(t["q"]) / half_sin, 2)
        return F.when(sigma == 0, F.lit(0.0)).otherwise(
            MAJOR_AXIS * (sigma - (x + y) * (FLATTENING / 2))
        )

    return _over_parts(geom, "L", lambda rings: total(segments(rings[0], step)))


def _central_angle(u: Column, v: Column, d: Column) -> Column:
    """Angle between two directions, by the half-chord so that short steps stay exact."""
    h = F.pow(F.sin((v - u) / 2), 2) + F.cos(u) * F.cos(v) * F.pow(F.sin(d / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2


# ---- hull -------------------------------------------------------------------------------


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Positive when a, b, c turn left."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _half_hull(sorted_positions: Column) -> Column:
    """One chain of the hull. The chain so far is convex, so the positions a new one
    removes are a suffix: the chain is cut at the first bend that fails."""

    def add(chain: Column, p: Column) -> Column:
        bends = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(chain) - 1, F.lit(1))),
            lambda i: (i < F.size(chain)) & (_turn(F.get(chain, i - 1), F.get(chain, i), p) <= 0),
        )
        keep = F.coalesce(F.get(bends, F.lit(0)), F.size(chain))
        return F.concat(F.slice(chain, F.lit(1), keep), F.array(p))

    return F.aggregate(sorted_positions, F.array().cast(_RING), add)


def convex_hull(geom: Column) -> Column:
    """Hull positions counter-clockwise from the lowest x, each once."""

    def closed(points: Column) -> Column:
        def joined(chains: Column) -> Column:
            lower, upper = chains["lower"], chains["upper"]
            return F.concat(
                F.slice(lower, F.lit(1), F.size(lower) - 1), F.slice(upper, F.lit(1), F.size(upper) - 1)
            )

        chains = F.struct(
            _half_hull(points).alias("lower"), _half_hull(F.reverse(points)).alias("upper")
        )
        return F.when(F.size(points) <= 2, points).otherwise(bind(chains, joined))

    return bind(F.array_sort(F.array_distinct(positions(geom))), closed)


def ring_area_of_hull(hull: Column) -> Column:
    return F.when(
        F.size(hull) >= 3, F.abs(signed_ring_area(F.concat(hull, F.slice(hull, 1, 1))))
    ).otherwise(F.lit(0.0))


# ---- validity ---------------------------------------------------------------------------


def without_repeats(ring: Column) -> Column:
    """The ring without positions equal to the one before."""
    return F.filter(
        ring,
        lambda p, i: (i == 0) | (p["x"] != F.get(ring, i - 1)["x"]) | (p["y"] != F.get(ring, i - 1)["y"]),
    )


def ring_is_open(ring: Column) -> Column:
    last = F.get(ring, F.size(ring) - 1)
    first = F.get(ring, F.lit(0))
    return (first["x"] != last["x"]) | (first["y"] != last["y"])


def shape_faults(geom: Column) -> Column:
    """Booleans: open ring, ring under four positions, line under two, repeated position."""

    def any_ring(kind: str, test: Callable[[Column], Column]) -> Column:
        return F.exists(geom["parts"], lambda p: (p["kind"] == kind) & F.exists(p["rings"], test))

    def repeats(ring: Column) -> Column:
        return F.size(without_repeats(ring)) < F.size(ring)

    return F.struct(
        any_ring("A", ring_is_open).alias("open_ring"),
        any_ring("A", lambda r: F.size(r) < 4).alias("short_ring"),
        any_ring("L", lambda r: F.size(r) < 2).alias("short_line"),
        (any_ring("A", repeats) | any_ring("L", repeats)).alias("repeated_position"),
    )


def repair_shape(geom: Column) -> Column:
    """Safe repairs: drop repeated positions, close rings, drop rings and lines that are left
    too short and parts that are left without a ring. Crossing rings are not touched."""

    def closed(ring: Column) -> Column:
        return F.when(ring_is_open(ring), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)

    def rings(p: Column) -> Column:
        clean = F.transform(p["rings"], without_repeats)
        areas = F.filter(F.transform(clean, closed), lambda r: F.size(r) >= 4)
        lines = F.filter(clean, lambda r: F.size(r) >= 2)
        # A polygon whose outer ring is lost is dropped with its holes.
        outer = F.size(closed(F.get(clean, F.lit(0)))) >= 4
        return (
            F.when((p["kind"] == "A") & outer, areas)
            .when(p["kind"] == "L", lines)
            .when(p["kind"] == "P", p["rings"])
        )

    parts = F.transform(geom["parts"], lambda p: p.withField("rings", rings(p)))
    kept = F.filter(parts, lambda p: F.size(F.coalesce(p["rings"], F.array().cast(f"array<{_RING}>"))) > 0)
    return F.when(F.size(kept) > 0, geom.withField("parts", kept))
