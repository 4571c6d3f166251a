"""Geometry column, measures, projections: golden vectors and brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallymap.functions import crs
from tallymap.functions import geometry as g
from tallymap.functions import measures as m
from tallymap.operators import generalise as gen
from tallymap.plans import load

HOLED = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [2, 4], [4, 4], [4, 2], [2, 2]]]
SAMPLES = {
    "Point": ([1, 2], 0, 0, 1),
    "MultiPoint": ([[1, 2], [3, 4]], 0, 0, 2),
    "LineString": ([[0, 0], [3, 4], [3, 5]], 0, 6, 3),
    "MultiLineString": ([[[0, 0], [3, 4]], [[0, 0], [0, 1], [1, 1]]], 0, 7, 5),
    "Polygon": (HOLED, 96, 0, 10),
    "MultiPolygon": ([HOLED, [[[20, 0], [21, 0], [21, 1], [20, 0]]]], 96.5, 0, 14),
}


def rows(spark, geometries):
    texts = [(i, None if t is None else t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(geometries)]
    return load.with_geometry(spark.createDataFrame(texts, "id int, geometry string"))


def collection(*kinds):
    return {
        "geometries": [{"coordinates": SAMPLES[k][0], "type": k} for k in kinds],
        "type": "GeometryCollection",
    }


@pytest.mark.parametrize("kind", SAMPLES)
def test_measures_of_each_type(spark, kind):
    coordinates, area, length, n = SAMPLES[kind]
    r = rows(spark, [{"type": kind, "coordinates": coordinates}]).select(
        m.planar_area(F.col("geom")).alias("a"), m.planar_length(F.col("geom")).alias("l"),
        g.count_positions(F.col("geom")).alias("n"), g.to_geojson(F.col("geom")).alias("t"),
    ).first()
    assert (r["a"], r["l"], r["n"]) == (area, length, n)
    assert json.loads(r["t"]) == {"type": kind, "coordinates": coordinates}


def test_collection(spark):
    whole = collection("Point", "MultiPoint", "Polygon", "LineString", "Point")
    df = rows(spark, [whole])
    r = df.select(
        m.planar_area(F.col("geom")).alias("a"), m.planar_length(F.col("geom")).alias("l"),
        g.member_signature(F.col("geom")).alias("s"), g.count_points(F.col("geom")).alias("p"),
        g.to_geojson(F.col("geom")).alias("t"),
    ).first()
    assert (r["a"], r["l"], r["s"], r["p"]) == (96, 6, "LineStringMultiPointPointPolygon", 4)
    assert json.loads(r["t"]) == whole
    members = gen.dissolve_collections(df).orderBy("member").select("member", "geom.type").collect()
    assert [tuple(x) for x in members] == list(enumerate(["Point", "MultiPoint", "Polygon", "LineString", "Point"]))


def test_heights_are_dropped_and_junk_is_null(spark):
    df = rows(
        spark,
        [
            {"type": "Point", "coordinates": [1, 2, 3]},
            None,
            "not json",
            {"type": "Circle", "coordinates": [1, 2]},
            {"type": "LineString", "coordinates": "x"},
            {"type": "Polygon", "coordinates": []},
        ],
    )
    got = [tuple(r) for r in df.orderBy("id").select(F.col("geom").isNull(), g.count_positions(F.col("geom"))).collect()]
    assert got == [(False, 1), (True, None), (True, None), (True, None), (False, 0), (False, 0)]
    boxes = [r[0] for r in df.orderBy("id").select(g.geometry_box(F.col("geom"))).collect()]
    assert tuple(boxes[0]) == (1, 2, 1, 2) and boxes[1:] == [None] * 5


def place(spark, move, *points):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    return [tuple(r[0]) for r in df.select(move(F.struct("x", "y"))).collect()]


def test_lambert_golden(spark):
    (town, _) = place(spark, crs.lambert93_to_lonlat, (612157.8384617675, 6889019.421), (3e5, 6e6))
    assert town == pytest.approx((1.7972624, 49.0949848), abs=2e-7)


def test_zone_40_read_as_lambert_lies_in_scotland(spark):
    assert place(spark, crs.lambert93_to_lonlat, (340000, 7650000))[0] == pytest.approx((-2.669, 55.788), abs=1e-3)
    assert place(spark, crs.utm40s_to_lonlat, (340000, 7650000))[0] == pytest.approx((55.458, -21.245), abs=1e-3)


def test_projection_there_and_back(spark):
    rng = random.Random(3)
    points = [(rng.uniform(1e5, 1.2e6), rng.uniform(6.05e6, 7.1e6)) for _ in range(500)]
    df = spark.createDataFrame(points, "x double, y double").select(
        F.struct("x", "y").alias("p"),
        crs.lonlat_to_lambert93(crs.lambert93_to_lonlat(F.struct("x", "y"))).alias("q"),
    )
    assert df.select(F.max(F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")))).first()[0] < 1e-5


def test_repair_cases(spark):
    points = [(612157.8, 6889019.4), (340000, 7650000), (1.8, 49.1), (-2.6691627, 55.7882395)]
    df = load.with_repaired_projection(rows(spark, [{"type": "Point", "coordinates": list(p)} for p in points]))
    got = df.orderBy("id").select("repair_case", g.first_position(F.col("geom")).alias("p")).collect()
    assert [r["repair_case"] for r in got] == ["lambert93", "utm40s", "lonlat", "utm40s_as_lambert93"]
    assert tuple(got[1]["p"]) == pytest.approx(tuple(got[3]["p"]), abs=1e-6)
    assert tuple(got[2]["p"]) == (1.8, 49.1)


def test_ellipsoid_measures(spark):
    """One square degree at the equator and one degree along a meridian, from published tables."""
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    meridian = {"type": "LineString", "coordinates": [[0, 0], [0, 1], [0, 1]]}
    r = rows(spark, [square, meridian]).agg(
        F.sum(m.geodesic_area(F.col("geom"))).alias("a"), F.sum(m.geodesic_length(F.col("geom"))).alias("l")
    ).first()
    assert r["a"] == pytest.approx(12308778361.469, rel=1e-4)
    assert r["l"] == pytest.approx(110574.39, rel=1e-5)


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def brute_hull(points):
    """Corners: points that are not inside the hull, by the edges that keep all on one side."""
    pts = sorted(set(points))
    corners = set()
    for a in pts:
        for b in pts:
            if a != b and all(turn(a, b, c) > 0 or c in (a, b) or (turn(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in pts):
                corners |= {a, b}
    return corners


def test_hull_against_brute_force(spark):
    rng = random.Random(5)
    sets = [[(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(1, 25))] for _ in range(120)]
    df = rows(spark, [{"type": "MultiPoint", "coordinates": [list(p) for p in s]} for s in sets])
    got = df.select("id", m.convex_hull(F.col("geom")).alias("h")).collect()
    for r in got:
        hull = [(p["x"], p["y"]) for p in r["h"]]
        pts = set(sets[r["id"]])
        assert len(hull) == len(set(hull))
        assert set(hull) == (brute_hull(sets[r["id"]]) if len(pts) > 1 else pts)


def test_repair_shape(spark):
    bad = [
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]},
        {"type": "LineString", "coordinates": [[0, 0], [0, 0]]},
        {"type": "MultiPoint", "coordinates": [[0, 0], [0, 0]]},
        {"type": "Polygon", "coordinates": [HOLED[0], [[2, 2], [3, 3], [2, 2]]]},
    ]
    got = [
        None if r[0] is None else json.loads(r[0])["coordinates"]
        for r in rows(spark, bad).orderBy("id").select(g.to_geojson(m.repair_shape(F.col("geom")))).collect()
    ]
    closed = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    assert got == [closed, None, None, [[0, 0], [0, 0]], [HOLED[0]]]


@pytest.mark.parametrize("size, zoom", [(0.0, 18), (360.0, 0), (400.0, 0), (1.0, 8), (1e-9, 18)])
def test_viewport_zoom(spark, size, zoom):
    assert spark.range(1).select(g.viewport_zoom(F.lit(size))).first()[0] == zoom


def test_angle_is_exact_for_whole_turns():
    assert math.isclose(m.MAJOR_AXIS * math.pi / 180, 111319.49079327358)


def brute_hull(points):
    """Corners: positions that some line through them has all others on one side of, but not between two others."""
    points = sorted(set(points))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if len(points) <= 2:
        return set(points)
    found = set()
    for p in points:
        for q in points:
            if p != q and all(turn(p, q, r) >= 0 for r in points):
                line = sorted(r for r in points if turn(p, q, r) == 0)
                found |= {line[0], line[-1]}
    return found


def test_hull_of_many_geometries(spark):
    import random

    from tallymap.operators import hulls

    rng = random.Random(4)
    rows, expected = [], {}
    for key, n, wide in (("a", 300, 12), ("b", 40, 2000), (None, 60, 5), ("line", 30, 0), ("one", 1, 9), ("ring", 90, -1)):
        points = [(float(rng.randint(0, abs(wide))), float(rng.randint(0, abs(wide)))) for _ in range(n)]
        if key == "line":
            points = [(float(k % 7), float(2 * (k % 7))) for k in range(n)]
        if key == "ring":
            points = [(float(k - 45), float((k - 45) ** 2)) for k in range(n)]
        rows += [(key, f'{{"type":"MultiPoint","coordinates":{[list(p) for p in points[i : i + 4]]}}}') for i in range(0, n, 4)]
        expected[key] = brute_hull(points)
    rows += [("empty", None), ("a", None), ("empty", '{"type":"MultiPoint","coordinates":[]}')]
    df = load.with_geometry(spark.createDataFrame(rows, "key string, geometry string").repartition(5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["key"]: [tuple(p) for p in r["hull"]] for r in hulls.hull_per_key(df, ["key"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: set(v) for k, v in got.items()} == expected
    assert all(len(v) == len(set(v)) and v[0] == min(v) for v in got.values())
    assert hulls.hull_per_key(df.where("false"), ["key"]).count() == 0
