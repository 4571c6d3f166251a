"""The standard measure table and the canonical geometry column."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

PART = T.StructType(
    [
        T.StructField("member", T.IntegerType()),
        T.StructField("member_type", T.StringType()),
        T.StructField("kind", T.StringType()),  # P point, L line, A area
        T.StructField("rings", T.ArrayType(T.ArrayType(POSITION))),
    ]
)

GEOM = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART))]
)

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])

GEOMETRY_TYPES = (
    "Point",
    "LineString",
    "Polygon",
    "MultiPoint",
    "MultiLineString",
    "MultiPolygon",
    "GeometryCollection",
)

# Attributes of a measure as they are delivered, all text, in table order.
TEXT_ATTRIBUTES = (
    "projet",
    "categorie",
    "mo",
    "communes",
    "procedure",
    "date_decision",
    "classe",
    "type",
    "cat",
    "sscat",
    "duree",
    "si_metier",
    "numero_dossier",
)

ARRAY_ATTRIBUTES = ("communes", "si_metier", "numero_dossier")

PARTITION_COLUMNS = ("source", "delivery_date", "georef")

MEASURE_TABLE = T.StructType(
    [T.StructField("num", T.LongType()), T.StructField("mesure_id", T.LongType())]
    + [
        T.StructField(
            c,
            T.ArrayType(T.StringType())
            if c == "communes"
            else T.DateType()
            if c == "date_decision"
            else T.StringType(),
        )
        for c in TEXT_ATTRIBUTES
    ]
    + [
        T.StructField("md5", T.StringType()),
        T.StructField("repair_case", T.StringType()),
        T.StructField("geom", GEOM),
        T.StructField("bbox", BOX),
        T.StructField("geom_md5", T.StringType()),
        T.StructField("geom_type", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("n_positions", T.LongType()),
        T.StructField("n_points", T.LongType()),
        T.StructField("area_m2", T.DoubleType()),
        T.StructField("length_m", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("delivery_date", T.StringType()),
        T.StructField("georef", T.StringType()),
    ]
)
