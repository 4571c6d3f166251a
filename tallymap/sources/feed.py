"""Feature feeds: pages of at most a thousand features per layer, as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymap.operators.numbering import number_by_group, running_total
from tallymap.session import write_stage

# Features per page, and the layers of a feed in reading order.
PAGE_SIZE = 1000
LAYERS = {
    "direct": ("emprises_polygones", "emprises_lineaires", "emprises_ponctuelles"),
    "commune": ("emprises_commune",),
}

PROPERTIES = (
    "projet", "categorie", "mo", "communes", "procedure", "date_decision", "classe",
    "type_mesure", "cat", "sscat", "duree", "si_metier", "numero_dossier",
)

_FEATURE = T.StructType(
    [
        T.StructField(
            "properties",
            T.StructType(
                [T.StructField("mesure_id", T.LongType())]
                + [T.StructField(n, T.StringType()) for n in PROPERTIES]
            ),
        ),
        T.StructField("geometry", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("startIndex", T.LongType()),
        T.StructField("totalFeatures", T.LongType()),
        T.StructField("features", T.ArrayType(_FEATURE)),
    ]
)


def read_pages(spark: SparkSession, path: str, one_document_per_file: bool = False) -> DataFrame:
    """Pages below ``path/layer=<name>/``: one document per line, or one per file.

    Pages come in order of ``startIndex``, and of their place in the files where they do not tell it."""
    return (
        spark.read.schema(PAGE)
        .option("multiLine", one_document_per_file)
        .json(path)
        .withColumn("page_file", F.col("_metadata.file_path"))
        .withColumn("startIndex", F.coalesce("startIndex", F.lit(0)))
    )


def layer_rank(layer: Column) -> Column:
    order = [n for names in LAYERS.values() for n in names]
    return F.array_position(F.array(*(F.lit(n) for n in order)), layer)


def _feature_columns() -> list[Column]:
    return [F.col(f"f.properties.{n}").alias(n) for n in ("mesure_id", *PROPERTIES)] + [
        F.col("f.geometry").alias("geometry")
    ]


def page_features(pages: DataFrame) -> DataFrame:
    """One row per feature, numbered through all pages and layers in reading order.

    Only the page headers are ordered and summed up; a feature's number is the number of
    features on earlier pages plus its place on its own page. Pages are taken apart where they are read, so that
    nothing behind holds more than one of them.
    """
    # written once, so that a page keeps the key it is given
    features = pages.withColumn("page", F.monotonically_increasing_id()).select(
        "layer", "startIndex", "page_file", "page", F.posexplode("features").alias("place", "f")
    )
    features = write_stage(features.select("layer", "startIndex", "page_file", "page", "place", *_feature_columns()), "feed-features")
    header = [layer_rank(F.col("layer")).alias("rank"), "startIndex", "page_file", "page"]
    headers = features.groupBy(*header).agg(F.count(F.lit(1)).alias("n"))
    before = running_total(headers, ["rank", "startIndex", "page_file", "page"], "n", "before").select("page", "before")
    # written, so that its size is known: where it is small it goes to the features, which then need no shuffle
    numbered = features.join(write_stage(before, "feed-places"), "page")
    return numbered.select((F.col("before") + F.col("place") + 1).alias("num"), "layer", "mesure_id", *PROPERTIES, "geometry")


def audit_pages(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per layer: features announced and found, pages needed and found, complete or not.
    A total that is a multiple of the page size may be followed by one empty page."""
    n = F.size("features")
    found = pages.groupBy("layer").agg(
        F.max("totalFeatures").alias("announced"),
        F.sum(n).alias("features"),
        F.count_if(n > 0).alias("pages"),
        F.count_if(n == 0).alias("empty_pages"),
    )
    needed = F.ceil(F.col("announced") / page_size)
    return found.withColumn("pages_needed", needed).withColumn(
        "complete", (F.col("features") == F.col("announced")) & (F.col("pages") == needed)
    )


def write_pages(
    features: DataFrame, path: str, order_by: list[str], page_size: int = PAGE_SIZE, empty_last: bool = True,
    compression: str = "none",
) -> None:
    """Write features (with ``layer`` and ``geometry`` text) as pages, one document per line.

    No page holds more than ``page_size`` features. With ``empty_last`` a layer whose size is a
    multiple of the page size ends with an empty page, as a feed read to its end does."""
    numbered, layers = number_by_group(features, "layer", order_by, "_n")
    # As many rows as there are layers, four at most.
    placed = numbered.join(F.broadcast(layers), "layer").withColumn("_at", F.col("_n") - F.col("_shift") - 1)
    properties = F.to_json(F.struct(*(F.col(n).cast("string").alias(n) if n != "mesure_id" else F.col(n) for n in ("mesure_id", *PROPERTIES))))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), properties,
        F.lit(',"geometry":'), F.coalesce(F.col("geometry"), F.lit("null")), F.lit("}"),
    )
    start = F.floor(F.col("_at") / page_size) * page_size
    pages = (
        placed.select("layer", "_total", start.alias("_start"), "_at", feature.alias("_feature"))
        .groupBy("layer", "_total", "_start")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_feature"))).alias("_features"))
        .select("layer", "_total", "_start", F.array_join(F.col("_features._feature"), ",").alias("_list"))
    )
    if empty_last:
        last = layers.where(F.col("_total") % page_size == 0).select(
            "layer", "_total", F.col("_total").alias("_start"), F.lit("").alias("_list")
        )
        pages = pages.unionByName(last)
    document = F.concat(
        F.lit('{"type":"FeatureCollection","totalFeatures":'), F.col("_total"),
        F.lit(',"startIndex":'), F.col("_start"), F.lit(',"features":['), F.col("_list"), F.lit("]}"),
    )
    pages.select("layer", document.alias("value")).write.mode("overwrite").option("compression", compression).partitionBy("layer").text(path)
