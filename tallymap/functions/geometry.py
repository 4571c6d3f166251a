"""The canonical geometry column: GeoJSON text in and out, positions, boxes, members.

All functions build Column expressions; nothing leaves the JVM. The column is
``struct<type, parts: array<struct<member, member_type, kind, rings>>>`` for all seven
geometry types, see ``schema.GEOM``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymap.schema import GEOMETRY_TYPES, PART

_DOC = "type string, coordinates string, geometries array<struct<type:string, coordinates:string>>"
_PARTS = f"array<{PART.simpleString()}>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def position(item: Column) -> Column:
    """First two numbers of a GeoJSON position; a height is dropped."""
    return F.struct(F.get(item, F.lit(0)).alias("x"), F.get(item, F.lit(1)).alias("y"))


def _part(member: Column, member_type: Column, kind: str, rings: Column) -> Column:
    return F.struct(
        member.cast("int").alias("member"),
        member_type.alias("member_type"),
        F.lit(kind).alias("kind"),
        rings.alias("rings"),
    )


def _member_parts(m: Column, index: Column) -> Column:
    def nested(depth: int) -> Column:
        return F.from_json(m["coordinates"], "array<" * depth + "double" + ">" * depth)

    def line(items: Column) -> Column:
        return F.transform(items, position)

    def part(kind: str, rings: Column) -> Column:
        return _part(index, m["type"], kind, rings)

    kind = m["type"]
    parts = (
        F.when(
            kind == "Point",
            bind(nested(1), lambda c: F.when(c.isNotNull(), F.array(part("P", F.array(F.array(position(c))))))),
        )
        .when(kind == "MultiPoint", F.transform(nested(2), lambda c: part("P", F.array(F.array(position(c))))))
        .when(
            kind == "LineString",
            bind(nested(2), lambda c: F.when(c.isNotNull(), F.array(part("L", F.array(line(c)))))),
        )
        .when(kind == "MultiLineString", F.transform(nested(3), lambda c: part("L", F.array(line(c)))))
        .when(
            kind == "Polygon",
            bind(nested(3), lambda c: F.when(c.isNotNull(), F.array(part("A", F.transform(c, line))))),
        )
        .when(kind == "MultiPolygon", F.transform(nested(4), lambda c: part("A", F.transform(c, line))))
    )
    return F.coalesce(parts, F.array().cast(_PARTS))


def parse_geojson(text: Column) -> Column:
    """GeoJSON geometry text to the canonical column; null when there is no geometry object."""

    def build(doc: Column) -> Column:
        collection = doc["type"] == "GeometryCollection"
        single = F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")))
        members = F.when(collection, F.coalesce(doc["geometries"], F.filter(single, lambda m: F.lit(False)))).otherwise(single)
        return F.when(
            doc["type"].isin(*GEOMETRY_TYPES),
            F.struct(doc["type"].alias("type"), F.flatten(F.transform(members, _member_parts)).alias("parts")),
        )

    return bind(F.from_json(text, _DOC), build)


# ---- back to text -----------------------------------------------------------------------


def to_geojson(geom: Column, digits: int | None = None) -> Column:
    """The geometry as GeoJSON text, coordinates rounded when ``digits`` is given."""

    def number(c: Column) -> Column:
        return (c if digits is None else F.round(c, digits)).cast("string")

    def pos(p: Column) -> Column:
        return F.concat(F.lit("["), number(p["x"]), F.lit(","), number(p["y"]), F.lit("]"))

    def listed(items: Column, f: Callable[[Column], Column]) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(items, f), ","), F.lit("]"))

    def ring(r: Column) -> Column:
        return listed(r, pos)

    def coordinates(kind: Column, parts: Column) -> Column:
        return (
            F.when(kind == "Point", pos(parts[0]["rings"][0][0]))
            .when(kind == "MultiPoint", listed(parts, lambda p: pos(p["rings"][0][0])))
            .when(kind == "LineString", ring(parts[0]["rings"][0]))
            .when(kind == "MultiLineString", listed(parts, lambda p: ring(p["rings"][0])))
            .when(kind == "Polygon", listed(parts[0]["rings"], ring))
            .when(kind == "MultiPolygon", listed(parts, lambda p: listed(p["rings"], ring)))
        )

    def plain(kind: Column, parts: Column) -> Column:
        return F.concat(
            F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates(kind, parts), F.lit("}")
        )

    def member(m: Column) -> Column:
        return bind(
            F.filter(geom["parts"], lambda p: p["member"] == m),
            lambda parts: plain(parts[0]["member_type"], parts),
        )

    numbers = F.array_distinct(F.transform(geom["parts"], lambda p: p["member"]))
    collection = F.concat(
        F.lit('{"type":"GeometryCollection","geometries":'), listed(numbers, member), F.lit("}")
    )
    return (
        F.when(geom["type"] == "GeometryCollection", collection)
        .when(F.size(geom["parts"]) > 0, plain(geom["type"], geom["parts"]))
    )


# ---- positions --------------------------------------------------------------------------


def map_positions(geom: Column, f: Callable[[Column], Column]) -> Column:
    """The geometry with ``f`` applied to each position."""

    def part(p: Column) -> Column:
        return F.struct(
            *(p[c].alias(c) for c in ("member", "member_type", "kind")),
            F.transform(p["rings"], lambda r: F.transform(r, f)).alias("rings"),
        )

    moved = F.struct(geom["type"].alias("type"), F.transform(geom["parts"], part).alias("parts"))
    return F.when(geom.isNotNull(), moved)


def round_positions(geom: Column, digits: int) -> Column:
    return map_positions(
        geom, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))
    )


def positions(geom: Column) -> Column:
    """All positions in order, as one array."""
    return F.flatten(F.flatten(F.transform(geom["parts"], lambda p: p["rings"])))


def first_position(geom: Column) -> Column:
    return F.get(F.get(F.get(geom["parts"], F.lit(0))["rings"], F.lit(0)), F.lit(0))


def count_positions(geom: Column) -> Column:
    sizes = F.transform(
        geom["parts"],
        lambda p: F.aggregate(p["rings"], F.lit(0).cast("bigint"), lambda acc, r: acc + F.size(r)),
    )
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def count_points(geom: Column) -> Column:
    """Points of Point and MultiPoint geometries, also as members of a collection."""
    return F.size(F.filter(geom["parts"], lambda p: p["kind"] == "P")).cast("bigint")


def member_signature(geom: Column) -> Column:
    """Sorted distinct member types of a collection, joined; null for other types."""
    kinds = F.array_sort(F.array_distinct(F.transform(geom["parts"], lambda p: p["member_type"])))
    return F.when(geom["type"] == "GeometryCollection", F.array_join(kinds, ""))


def element_kinds(geom: Column) -> Column:
    return F.array_distinct(F.transform(geom["parts"], lambda p: p["kind"]))


def shape_digest(geom: Column) -> Column:
    """Identity of a shape: digest of its type and coordinates."""
    return F.when(geom.isNotNull(), F.md5(F.to_json(geom)))


# ---- boxes ------------------------------------------------------------------------------


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def box_of_positions(items: Column) -> Column:
    """Box around an array of positions, in one pass; null when no coordinate is known along an axis."""
    start = box(*(F.lit(v) for v in (float("inf"), float("inf"), float("-inf"), float("-inf"))))
    folded = F.aggregate(
        items,
        start,
        lambda acc, p: box(
            F.least(acc["xmin"], p["x"]),
            F.least(acc["ymin"], p["y"]),
            F.greatest(acc["xmax"], p["x"]),
            F.greatest(acc["ymax"], p["y"]),
        ),
    )
    return bind(folded, lambda b: F.when((b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"]), b))


def geometry_box(geom: Column) -> Column:
    return bind(positions(geom), box_of_positions)


def box_center(b: Column) -> Column:
    return F.struct(
        ((b["xmin"] + b["xmax"]) / 2).alias("x"), ((b["ymin"] + b["ymax"]) / 2).alias("y")
    )


def box_size(b: Column) -> Column:
    """Larger side."""
    return F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])


def box_distance(a: Column, b: Column) -> Column:
    """Larger of the gaps along the two axes; 0 when the boxes touch."""
    return F.greatest(
        F.lit(0.0),
        a["xmin"] - b["xmax"],
        b["xmin"] - a["xmax"],
        a["ymin"] - b["ymax"],
        b["ymin"] - a["ymax"],
    )


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed boxes sharing at least one point."""
    return (
        (a["xmin"] <= b["xmax"])
        & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"])
        & (b["ymin"] <= a["ymax"])
    )


def viewport_zoom(size: Column) -> Column:
    """Largest zoom whose 360/2^z degrees still hold the box, within 0..18."""
    level = F.floor(F.log2(F.lit(360.0) / F.nullif(size, F.lit(0.0))))
    return F.when(size == 0, F.lit(18)).otherwise(F.greatest(F.lit(0), F.least(F.lit(18), level))).cast("bigint")
