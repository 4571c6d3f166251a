"""The delivery table: one Parquet dataset partitioned by source, date and kind of placing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.functions.geometry import boxes_meet
from tallymap.schema import MEASURE_TABLE, PARTITION_COLUMNS

# How the table name of a delivery is built, and the known publishers.
TABLE_NAME = r"^mce(cpii|igngp|cerema)(\d+)"
PRECISE = "direct"
BY_TOWN = "commune"


def table_name(source: Column, date: Column, georef: Column) -> Column:
    return F.concat(F.lit("mce"), source, date, georef)


def read_table_name(name: Column) -> list[Column]:
    """Source, date and kind of a table name; no source and date when it is no delivery."""
    known = name.rlike(TABLE_NAME)
    return [
        F.when(known, F.regexp_extract(name, TABLE_NAME, 1)).alias("source"),
        F.when(known, F.regexp_extract(name, TABLE_NAME, 2)).alias("delivery_date"),
        F.when(name.endswith(PRECISE), PRECISE).otherwise(BY_TOWN).alias("georef"),
    ]


def _place_cell() -> Column:
    """Z-order number of the box center on a 2^15 grid; places near each other get near numbers."""
    x = F.col("bbox.xmin") + F.col("bbox.xmax")
    y = F.col("bbox.ymin") + F.col("bbox.ymax")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    def grid(v: Column, extent: float) -> Column:
        cell = F.floor((v / 2 + extent) / (2 * extent) * 32768)
        return F.greatest(F.lit(0), F.least(F.lit(32767), cell)).cast("bigint")

    return spread(grid(x, 180.0)).bitwiseOR(F.shiftleft(spread(grid(y, 90.0)), 1))


# A number stands anywhere in a table ordered by place: Bloom filters on it let a look-up skip row groups.
_NUMBER_FILTERS = {
    "parquet.bloom.filter.enabled#num": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": str(1 << 20),
}


def write_deliveries(measures: DataFrame, root: str) -> None:
    """Replace the deliveries that ``measures`` holds and leave all others as they are.

    Rows are written where they are, without a shuffle, sorted by place inside each task: the
    box statistics of row groups and pages can then be used to skip them. Some of the columns may be missing; without
    box or number the rows of a task stay in their order."""
    cell = "_cell"
    if {"bbox", "num"} <= set(measures.columns):
        placed = measures.withColumn(cell, F.coalesce(_place_cell(), F.lit(-1)))
        measures = placed.sortWithinPartitions(*PARTITION_COLUMNS, cell, "num").drop(cell)
    (
        measures.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .options(**_NUMBER_FILTERS)
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(root)
    )


def cluster_deliveries(table: DataFrame, root: str) -> None:
    """Rewrite deliveries to another root so that whole files hold one region each. Rows are
    ranged by place; the number breaks ties, so a crowded place is split over files."""
    cell = "_cell"
    order = [*PARTITION_COLUMNS, cell, "num", "md5"]
    (
        table.withColumn(cell, F.coalesce(_place_cell(), F.lit(-1)))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop(cell)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**_NUMBER_FILTERS)
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(root)
    )


def read_deliveries(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MEASURE_TABLE).parquet(root)


def list_deliveries(table: DataFrame) -> DataFrame:
    listed = table.select(*PARTITION_COLUMNS).distinct()
    return listed.withColumn("table_name", table_name(*(F.col(c) for c in PARTITION_COLUMNS)))


def one_delivery(table: DataFrame, source: str, date: str, georef: str) -> DataFrame:
    return table.where(
        (F.col("source") == source) & (F.col("delivery_date") == date) & (F.col("georef") == georef)
    )


def scan_delivery(table: DataFrame, source: str, date: str, georef: str) -> DataFrame:
    """All attributes, the geometry and its two measures."""
    return (
        one_delivery(table, source, date, georef)
        .withColumn("area_ha", F.col("area_m2") / 10000)
        .withColumn("length_km", F.col("length_m") / 1000)
    )


def bbox_filter(measures: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Measures whose box meets the given one; those without geometry are left out."""
    xmin, ymin, xmax, ymax = (F.lit(float(v)) for v in box)
    asked = {"xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax}
    own = {c: F.col(f"bbox.{c}") for c in asked}
    return measures.where(boxes_meet(own, asked))


def lookup_measure(measures: DataFrame, num: int) -> DataFrame:
    return measures.where(F.col("num") == num)
