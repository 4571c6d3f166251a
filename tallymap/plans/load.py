"""The load job: delivered rows to the standard measure table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions import crs
from tallymap.functions import geometry as g
from tallymap.functions import measures as m
from tallymap.functions import text
from tallymap.operators.numbering import dense_number
from tallymap.schema import ARRAY_ATTRIBUTES, MEASURE_TABLE, TEXT_ATTRIBUTES
from tallymap.session import built_once

METHODS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "planar": (m.planar_area, m.planar_length),
    "geodesic": (m.geodesic_area, m.geodesic_length),
}


# Columns that are built in their final type: casting would copy them for a nullability flag.
NESTED = ("communes", "geom", "bbox")


@built_once
def _geometry(column: str) -> Column:
    return g.parse_geojson(F.col(column))


@built_once
def _shape_columns() -> dict[str, Column]:
    geom = F.col("geom")
    return {
        "geom_type": geom["type"],
        "geom_md5": g.shape_digest(geom),
        "signature": g.member_signature(geom),
        "n_positions": g.count_positions(geom),
        "n_points": g.count_points(geom),
    }


@built_once
def _measure_columns(method: str) -> dict[str, Column]:
    area, length = METHODS[method]
    return {"area_m2": area(F.col("geom")), "length_m": length(F.col("geom"))}


@built_once
def _repair_columns() -> tuple[Column, Column]:
    return crs.repair_case(F.col("geom")), crs.repair_projection(F.col("geom"), F.col("repair_case"))


@built_once
def _pair_columns() -> tuple[Column, dict[str, Column]]:
    pairs = text.unique_pairs(F.col("si_metier"), F.col("numero_dossier"))
    return pairs, {c: F.col(f"_pairs.{c}") for c in ("si_metier", "numero_dossier")}


@built_once
def _standard_values() -> dict[str, Column]:
    values = {c: text.blank_to_null(F.col(c)) for c in TEXT_ATTRIBUTES}
    values["communes"] = text.parse_array(values["communes"])
    values["date_decision"] = F.to_date(values["date_decision"])
    values["bbox"] = g.geometry_box(F.col("geom"))
    return values


def with_geometry(rows: DataFrame, column: str = "geometry") -> DataFrame:
    """Add the canonical geometry ``geom`` of a GeoJSON text column."""
    return rows.withColumn("geom", _geometry(column))


def with_shape(rows: DataFrame) -> DataFrame:
    """Add what is known of a shape without its projection: type, digest, counts, members."""
    return rows.withColumns(_shape_columns())


def with_measures(rows: DataFrame, method: str = "planar") -> DataFrame:
    return rows.withColumns(_measure_columns(method))


def with_repaired_projection(rows: DataFrame) -> DataFrame:
    """Geometry in longitude and latitude, with the case that was found."""
    case, repaired = _repair_columns()
    return rows.withColumn("repair_case", case).withColumn("geom", repaired)


def with_unique_pairs(rows: DataFrame) -> DataFrame:
    pairs, columns = _pair_columns()
    return rows.withColumn("_pairs", pairs).withColumns(columns).drop("_pairs")


def with_feed_syntax(features: DataFrame) -> DataFrame:
    """Feed arrays as literals, and the original name of the type attribute."""
    literals = {c: text.plus_to_literal(F.col(c)) for c in ARRAY_ATTRIBUTES}
    return features.withColumns(literals).withColumnRenamed("type_mesure", "type")


def standard_rows(rows: DataFrame, source: str, date: str, georef: str, method: str, crs_of: str) -> DataFrame:
    """Standard columns of rows that have ``num``, ``mesure_id``, the 13 texts and ``geometry``.

    Planar measures are taken in the projection as delivered, geodesic ones after the repair.
    """
    dated = rows.withColumn("date_decision", F.col("date_decision").cast("string"))
    digested = dated.withColumn("md5", text.fingerprint())
    shaped = with_shape(with_geometry(digested)).drop("geometry")
    if method == "planar":
        shaped = with_measures(shaped, "planar")
    if crs_of == "webmercator":
        placed = shaped.withColumn("repair_case", F.lit("webmercator")).withColumn(
            "geom", g.map_positions(F.col("geom"), crs.web_mercator_to_lonlat)
        )
    else:
        placed = with_repaired_projection(shaped)
    if method == "geodesic":
        placed = with_measures(placed, "geodesic")
    named = {"source": F.lit(source), "delivery_date": F.lit(date), "georef": F.lit(georef)}
    standard = placed.withColumns({**_standard_values(), **named})
    return standard.select(
        *(F.col(f.name) if f.name in NESTED else F.col(f.name).cast(f.dataType) for f in MEASURE_TABLE.fields)
    )


def load_table(
    rows: DataFrame, source: str, date: str, georef: str,
    order_by: list[str] | None = None, method: str = "geodesic", dedupe: bool = True,
) -> DataFrame:
    """A delivered table. ``order_by`` numbers the rows without ``mesure_id``; leave it out when
    every row has one."""
    if order_by:
        rows = dense_number(rows, order_by, "_running")
        rows = rows.withColumn("num", F.coalesce("mesure_id", "_running")).drop("_running")
    else:
        rows = rows.withColumn("num", F.col("mesure_id"))
    if dedupe:
        rows = with_unique_pairs(rows)
    return standard_rows(rows, source, date, georef, method, "legal")


def load_feed(
    features: DataFrame, source: str, date: str, georef: str,
    method: str = "geodesic", crs_of: str = "webmercator",
) -> DataFrame:
    """Features of a feed, numbered (``num``) in reading order. Pairs are left as they come."""
    return standard_rows(with_feed_syntax(features), source, date, georef, method, crs_of)
