"""Spatial pairs, joins with hot keys, NOT IN, running numbers: brute force and crowded inputs."""

import json
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallymap.operators import audit, diff, spatial
from tallymap.operators.numbering import _ordered_places, _written, assign_num, dense_number, running_total
from tallymap.operators.skew import join_per_key, null_aware_anti
from tallymap.plans import load
from tallymap.session import shared_folder


def boxes(seed, n, crowded):
    """Boxes of very different sizes; a third of them in one small place."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        spot = crowded and i % 3 == 0
        x, y = (rng.uniform(0, 2), rng.uniform(0, 2)) if spot else (rng.uniform(-500, 500), rng.uniform(-500, 500))
        size = 0.5 if spot else rng.choice([0, 1, 5, 30, 200])
        out.append((i, x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, xmin double, ymin double, xmax double, ymax double")


def meets(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


@pytest.mark.parametrize("base", [0.5, 10.0, 10000.0])
@pytest.mark.parametrize("block", [20_000, 7])
def test_meeting_pairs_against_brute_force(spark, base, block):
    a, b = boxes(1, 240, True), boxes(2, 200, True)
    pairs = spatial.meeting_pairs(frame(spark, a), frame(spark, b), base, keep=["k"], block=block)
    got = [(r["a_k"], r["b_k"]) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(p[0], q[0]) for p, q in itertools.product(a, b) if meets(p, q)}


@pytest.mark.parametrize("sides", ["left", "right", "both"])
def test_one_crowded_cell(spark, sides):
    many, few = boxes(5, 300, False), boxes(6, 40, False)
    many = [(k, x / 1000, y / 1000, x / 1000 + 0.05, y / 1000 + 0.05) for k, x, y, _, _ in many]
    few = [(k, x / 1000, y / 1000, x / 1000 + 0.05, y / 1000 + 0.05) for k, x, y, _, _ in few]
    a, b = {"left": (many, few), "right": (few, many), "both": (many, many)}[sides]
    pairs = spatial.meeting_pairs(frame(spark, a), frame(spark, b), 10.0, keep=["k"], block=25)
    got = [(r["a_k"], r["b_k"]) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(p[0], q[0]) for p, q in itertools.product(a, b) if meets(p, q)}


def test_from_pairs_to_measures(spark):
    rows = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0)), (2, (0.0, 0.0, 1.0, 1.0)), (3, None)], "num int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    assert sorted(r["num"] for r in spatial.box_members(rows).collect()) == [1, 2]


def test_pairs_of_one_side(spark):
    a = boxes(3, 150, True)
    pairs = spatial.meeting_pairs(frame(spark, a), None, 4.0, keep=["k"], a_before_b="k")
    got = sorted((r["a_k"], r["b_k"]) for r in pairs.collect())
    assert got == sorted((p[0], q[0]) for p, q in itertools.combinations(a, 2) if meets(p, q))


def test_touching_boxes_meet_and_cell_borders_do_not_double(spark):
    a = [(0, 0.0, 0.0, 10.0, 10.0)]
    b = [(0, 10.0, 10.0, 20.0, 20.0), (1, 10.1, 0.0, 11.0, 1.0), (2, -10.0, -10.0, 0.0, 0.0), (3, 5.0, 5.0, 5.0, 5.0)]
    pairs = spatial.meeting_pairs(frame(spark, a), frame(spark, b), 5.0, keep=["k"])
    assert sorted(r["b_k"] for r in pairs.collect()) == [0, 2, 3]


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_join_per_key_with_a_hot_key(spark, how):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("k") % 5 == 0)
    got = join_per_key(rows, counts, ["k"], "n", how, share=0.01)
    plain = rows.join(counts, "k", how)
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_join_per_key_refuses_outer(spark):
    with pytest.raises(ValueError):
        join_per_key(spark.range(1), spark.range(1), ["id"], "id", "left")


@pytest.mark.parametrize(
    "right, left_kept",
    [([2, 3], [1]), ([2, None], []), ([], [1, 2, None]), ([None], [])],
)
def test_not_in(spark, right, left_kept):
    left = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    links = spark.createDataFrame([(v,) for v in right], "mesure_id int")
    got = [r["id"] for r in null_aware_anti(left, links, "id", "mesure_id").collect()]
    assert sorted(got, key=str) == sorted(left_kept, key=str)
    left.createOrReplaceTempView("l_not_in")
    links.createOrReplaceTempView("r_not_in")
    sql = spark.sql("SELECT id FROM l_not_in WHERE id NOT IN (SELECT mesure_id FROM r_not_in)")
    assert sorted(got, key=str) == sorted((r["id"] for r in sql.collect()), key=str)


def test_dense_number_with_many_copies(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("v"), "id")
    got = [(r["v"], r["n"]) for r in dense_number(df, ["v", "id"], "n").collect()]
    assert sorted(n for _, n in got) == list(range(1, 5001))
    assert [v for v, _ in sorted(got, key=lambda t: t[1])] == sorted(v for v, _ in got)


def test_running_total(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("w"))
    got = {r["id"]: r["before"] for r in running_total(df, ["id"], "w", "before").collect()}
    assert all(got[i] == sum(j % 7 for j in range(i)) for i in range(300))


def test_assign_num_keeps_known_numbers(spark):
    df = spark.createDataFrame([(50, "a"), (None, "b"), (None, "c"), (9, "d")], "mesure_id long, projet string")
    got = {r["projet"]: r["num"] for r in assign_num(df, ["projet"]).collect()}
    assert got == {"a": 50, "b": 2, "c": 3, "d": 9}


# ---- differences ------------------------------------------------------------------------


def totals(spark, *rows):
    return spark.createDataFrame(rows, "projet string, area_ha double, length_km double")


def test_threshold_is_two_percent_of_the_sum(spark):
    a = totals(spark, ("edge", 51.0, 0.0), ("over", 51.01, 0.0), ("zero", 0.0, 0.0), ("null", None, 0.0), ("opposite", -1.0, 0.0))
    b = totals(spark, ("edge", 49.0, 0.0), ("over", 48.99, 0.0), ("zero", 0.0, 0.0), ("null", 1.0, 0.0), ("opposite", 1.0, 0.0))
    assert [r["projet"] for r in diff.diff_totals(a, b, "area_ha").collect()] == ["over"]


def test_missing_also_when_the_measure_is_null(spark):
    a = totals(spark, ("x", 1.0, 0.0), ("y", 1.0, 0.0), (None, 1.0, 0.0))
    b = totals(spark, ("x", None, None), ("y", 2.0, 0.0), (None, 2.0, 0.0))
    got = {r["projet"] for r in diff.missing_totals_of(a, b).collect()}
    assert got == {"x", None}


def test_null_towns_match(spark):
    schema = "projet string, communes array<string>, area_ha double, length_km double"
    a = spark.createDataFrame([("p", [None], 1.0, 0.0), ("p", ["A", None], 1.0, 0.0)], schema)
    b = spark.createDataFrame([("p", [None], 9.0, 0.0), ("p", [None, "A"], 9.0, 0.0)], schema)
    got = diff.diff_totals(a, b, "area_ha", ("projet", "communes")).collect()
    assert [r["communes"] for r in got] == [[None]]


def test_reconcile_with_itself_and_mirrored(spark):
    a = totals(spark, ("p", 1.0, 0.0), ("q", 2.0, 5.0), ("r", 0.0, 3.0))
    b = totals(spark, ("p", 9.0, 0.0), ("q", 2.0, 9.0), ("s", 0.0, 3.0))
    assert {r["status"] for r in diff.reconcile(a, a).collect()} == {"same"}
    forth = {r["projet"]: r["status"] for r in diff.reconcile(a, b).collect()}
    back = {r["projet"]: r["status"] for r in diff.reconcile(b, a).collect()}
    assert forth == {"p": "changed_area", "q": "changed_length", "r": "only_a", "s": "only_b"}
    swap = {"only_a": "only_b", "only_b": "only_a"}
    assert {k: swap.get(v, v) for k, v in back.items()} == forth


def test_fingerprints_are_compared_as_multisets(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "md5 string")
    b = spark.createDataFrame([("x",), ("y",), ("w",)], "md5 string")
    got = {(r["md5"], r["a_nbre"], r["b_nbre"]) for r in diff.diff_fingerprints(a, b).collect()}
    assert got == {("x", 2, 1), ("z", 1, None)}


# ---- audits -----------------------------------------------------------------------------

KEYED = "projet string, mo string, communes string, procedure string, type string, geom_md5 string, duree string"


def test_conflicts_count_the_pairs_a_self_join_would_give(spark):
    rng = random.Random(4)
    rows = [
        ("p", "m", "c", "s", "t", rng.choice(["g1", "g2", None]) if i % 3 else "g1", rng.choice(["1", "2", "3", None]))
        for i in range(300)
    ]
    got = audit.dependency_conflicts(spark.createDataFrame(rows, KEYED), "duree").collect()
    pairs = sum(1 for a in rows for b in rows if a[5] and a[5] == b[5] and a[6] and b[6] and a[6] != b[6])
    assert sum(r["n_pairs"] for r in got) == pairs
    assert len(got) == 6


def test_null_is_a_value_when_dependencies_are_checked(spark):
    rows = [("p", "m", "c", "s", "t", "g", "1"), ("p", "m", "c", "s", "t", "g", None)]
    df = spark.createDataFrame(rows, KEYED)
    r = audit.check_dependencies(df, attributes=("duree",)).first()
    assert (r["n_keys"], r["n_with_attribute"], r["determined"]) == (1, 2, False)
    assert audit.dependency_conflicts(df, "duree").count() == 0


def test_self_crossing_shapes(spark):
    rings = {
        "bow": [[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]],
        "square": [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]],
        "spike": [[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]],
        "open": [[0, 0], [2, 0], [2, 2], [0, 2]],
        "star": [[0, 3], [2, -3], [-3, 1], [3, 1], [-2, -3], [0, 3]],
        "comb": [[x / 2, (x % 2) * 5] for x in range(40)] + [[19.5, -1], [0, -1], [0, 0]],
    }
    rows = [(k, f'{{"type":"Polygon","coordinates":[{v}]}}') for k, v in rings.items()] * 2
    df = load.with_geometry(spark.createDataFrame(rows, "geom_md5 string, geometry string"))
    got = {r["geom_md5"] for r in audit.self_crossing_shapes(audit.ring_edges(df, "geom_md5")).collect()}
    assert got == {"bow", "spike", "star"}
    counted = {r["rule"]: r["violations"] for r in audit.audit_validity(df).collect()}
    assert counted["self_crossing"] == 6 and counted["open_ring"] == 2


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


RINGS = {
    "hole": ([[square(0, 0, 10), square(2, 2, 3)]], set()),
    "hole_far": ([[square(0, 0, 10), square(20, 0, 3)]], {"hole_outside"}),
    "hole_left": ([[square(0, 0, 10), square(-20, 4, 3)]], {"hole_outside"}),
    "hole_through": ([[square(0, 0, 10), square(8, 4, 5)]], {"crossing_rings", "hole_outside"}),
    "hole_touching": ([[square(0, 0, 10), [[0, 5], [3, 4], [3, 6], [0, 5]]]], set()),
    "hole_along": ([[square(0, 0, 10), square(0, 4, 3)]], {"crossing_rings"}),
    "hole_in_hole": ([[square(0, 0, 20), square(2, 2, 10), square(4, 4, 3)]], {"nested_holes"}),
    "two_holes": ([[square(0, 0, 20), square(2, 2, 3), square(8, 2, 3)]], set()),
    "apart": ([[square(0, 0, 4)], [square(8, 0, 4)]], set()),
    "corner": ([[square(0, 0, 4)], [square(4, 4, 4)]], set()),
    "nested": ([[square(0, 0, 10)], [square(3, 3, 2)]], {"nested_polygons"}),
    "island": ([[square(0, 0, 20), square(4, 4, 10)], [square(6, 6, 3)]], set()),
    "overlap": ([[square(0, 0, 6)], [square(3, 3, 6)]], {"crossing_rings", "nested_polygons"}),
    "many": ([[square(0, 0, 1000), *(square(10 * i + 5, 10 * j + 5, 3) for i in range(30) for j in range(20))]], set()),
    "one_bad": ([[square(0, 0, 1000), *(square(10 * i + 5, 10 * j + 5, 3) for i in range(30) for j in range(20)), square(16, 16, 1)]], {"nested_holes"}),
}


def test_rings_against_each_other(spark):
    rows = [(k, json.dumps({"type": "MultiPolygon", "coordinates": c})) for k, (c, _) in RINGS.items()] * 2
    df = load.with_geometry(spark.createDataFrame(rows, "geom_md5 string, geometry string"))
    several = audit.several_rings(audit.ring_edges(df, "geom_md5"))
    got = {(k, "crossing_rings") for k, in audit.crossing_rings(several).collect()}
    got |= {(r["geom_md5"], r["rule"]) for r in audit.misplaced_rings(several).collect()}
    assert got == {(k, rule) for k, (_, rules) in RINGS.items() for rule in rules}
    counted = {r["rule"]: r["violations"] for r in audit.audit_validity(df).collect()}
    assert [counted[r] for r in audit.RING_RULES] == [0, 6, 6, 4, 4]
    none = audit.audit_validity(df.where("false")).collect()
    assert {r["rule"]: r["violations"] for r in none}["hole_outside"] == 0


def test_copies_are_numbered_once_each_and_spread(spark):
    df = spark.range(20_000).select(F.lit("same").alias("v"), F.lit("x" * 50).alias("w"))
    got = dense_number(df, ["v", "w"], "n")
    assert tuple(got.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()) == (20_000, 1, 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _ordered_places(_written(df), ["v", "w"]).select("_file").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_columns_behind_the_first_decide_where_these_are_equal(spark):
    import random

    from tallymap.operators import numbering

    rng = random.Random(4)
    some = [None, "a", "b"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(some), rng.choice(some), rng.choice(some), i) for i in range(400)]
    rows += [(1000 + i, f"x{i}", "long" * 50, "y", i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c string, d string, id int").repartition(5)
    got = [tuple(r)[:5] for r in dense_number(df, ["a", "b", "c", "d", "id"], "n").orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: [(x is not None, x) for x in r])
    keyed = numbering._apart(df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate("abcd")), "id"), ["_o0", "_o1", "_o2", "_o3"])
    left = {r["id"]: r["_rest"] for r in keyed.where("_o0 >= 1000").collect()}
    assert set(left.values()) == {None} and len(left) == 400
    numbered, groups = numbering.number_by_group(df, "b", ["a", "c", "d", "id"], "n")
    for r in groups.where("b IS NULL OR b < 'c'").collect():
        own = [x["n"] for x in numbered.where(F.col("b").eqNullSafe(F.lit(r["b"]))).collect()]
        assert (min(own), max(own), len(own)) == (r["_shift"] + 1, r["_shift"] + r["_total"], r["_total"])


def test_rows_are_written_once_when_numbered(spark):
    import os
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(50), "".join(rng.choices("abcdefghijklmnop", k=400))) for _ in range(5000)]
    df = spark.createDataFrame(rows, "v int, w string").repartition(4)
    before = {d for d, _, _ in os.walk(shared_folder(spark))}
    got = dense_number(df, ["v", "w"], "n")
    size = lambda d: sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d) if f.startswith("part-"))
    new = sorted(size(d) for d, _, _ in os.walk(shared_folder(spark)) if d not in before and os.path.basename(d).startswith(("rows", "places")))
    assert len(new) == 2 and sum(new) <= 1.2 * new[-1]
    assert [(r["v"], r["w"]) for r in got.orderBy("n").collect()] == sorted(rows)


def test_dependencies_against_plain_counts(spark):
    import random

    rng = random.Random(8)
    rows = [tuple(f"k{rng.randrange(40)}" if i == 0 else "x" for i in range(6)) + (rng.choice(["1", "2", None]), "same", None) for _ in range(400)]
    df = spark.createDataFrame(rows, "projet string, mo string, communes string, procedure string, type string, geom_md5 string, duree string, cat string, sscat string")
    got = {r["attribute"]: r for r in audit.check_dependencies(df, attributes=("duree", "cat", "sscat")).collect()}
    for place, name in ((6, "duree"), (7, "cat"), (8, "sscat")):
        values = {}
        for r in rows:
            values.setdefault(r[0], set()).add(r[place])
        expected = (len(values), sum(map(len, values.values())), sum(len(v) > 1 for v in values.values()))
        assert (got[name]["n_keys"], got[name]["n_with_attribute"], got[name]["n_broken"]) == expected


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def shaped(spark, rings_by_id):
    from tallymap.schema import GEOM

    rows = [(k, {"type": "MultiPolygon", "parts": [{"member": 0, "member_type": "MultiPolygon", "kind": "A", "rings": r} for r in parts]}) for k, parts in rings_by_id.items()]
    return spark.createDataFrame(rows, f"geom_md5 string, geom {GEOM.simpleString()}")


def test_short_rings_are_compared_in_their_row(spark):
    import random

    rng = random.Random(5)
    shapes = {}
    for i in range(150):
        corners = [(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(3, 9))]
        shapes[f"s{i}"] = [[ring(*corners, *([corners[0]] if i % 3 else []))]]
    df = shaped(spark, shapes)
    by_grid = {r[0] for r in audit.self_crossing_shapes(audit.ring_edges(df, "geom_md5")).collect()}
    in_row = {r[0] for r in df.where(audit.crosses_within(F.col("geom"))).select("geom_md5").collect()}
    assert in_row == by_grid and 0 < len(in_row) < len(shapes)


def test_long_rings_and_copies_are_counted(spark):
    n = audit.FEW_EDGES + 8
    round_ = [(i, i * i) for i in range(n)]
    crossed = [*round_[:5], (n, -5), (n + 1, n * n), *round_[5:]]
    shapes = {"long": [[ring(*round_, round_[0])]], "crossed": [[ring(*crossed, crossed[0])]], "both": [[ring(*crossed, crossed[0])], [ring((-9, -9), (-5, -5), (-5, -9), (-9, -5), (-9, -9))]]}
    df = shaped(spark, shapes)
    by_grid = audit.self_crossing_shapes(audit.ring_edges(df, "geom_md5")).count()
    counted = {r["rule"]: r["violations"] for r in audit.audit_validity(df.unionByName(df)).collect()}
    assert counted["self_crossing"] == 2 * by_grid == 4


def test_short_rings_apart_are_not_shuffled(spark):
    import glob

    folder = shared_folder(spark)
    squares = {f"q{i}": [[ring((i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0))], [ring((i, 9), (i + 1, 9), (i, 8), (i, 9))]] for i in range(20)}
    before = set(glob.glob(f"{folder}/tallymap/*/*"))
    counted = {r["rule"]: r["violations"] for r in audit.audit_validity(shaped(spark, squares)).collect()}
    new = [d for d in set(glob.glob(f"{folder}/tallymap/*/*")) - before if "/edges-" in d or "/several-rings-" in d]
    assert new and sum(spark.read.parquet(d).count() for d in new) == 0
    assert set(counted.values()) == {0}


def test_thin_cells_are_not_cut(spark):
    """Without a crowded cell boxes are shuffled once, to their cells."""
    df = frame(spark, boxes(4, 200, False))
    thin = spatial.meeting_pairs(df, df, 10.0, keep=["k"])
    cut = spatial.meeting_pairs(df, df, 10.0, keep=["k"], block=1)
    plan = lambda pairs: pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_blocks_" not in plan(thin) and "_blocks_" in plan(cut)
    found = sorted((r["a_k"], r["b_k"]) for r in thin.collect())
    assert found == sorted((r["a_k"], r["b_k"]) for r in cut.collect()) and found
