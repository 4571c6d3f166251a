"""Compare two deliveries: totals per project, missing projects, fingerprints, attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.operators.skew import join_per_key

# Fixed value: the threshold on |a-b| / (a+b) / 2.
THRESHOLD = 0.01


def project_totals(measures: DataFrame, keys: Sequence[str] = ("projet",)) -> DataFrame:
    """Hectares and kilometres per key; null where every geometry of the key is null."""
    return measures.groupBy(*keys).agg(
        (F.sum("area_m2") / 10000).alias("area_ha"), (F.sum("length_m") / 1000).alias("length_km")
    )


def differs(a: Column, b: Column) -> Column:
    """Whether two totals differ; false when one is null or both are zero."""
    return F.coalesce(F.abs(F.try_divide(a - b, a + b) / 2) > THRESHOLD, F.lit(False))


def _sided(totals: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return totals.select(
        *keys,
        F.col("area_ha").alias(f"{side}_area_ha"),
        F.col("length_km").alias(f"{side}_length_km"),
    )


def diff_totals(a: DataFrame, b: DataFrame, measure: str, keys: Sequence[str] = ("projet",)) -> DataFrame:
    """Keys on both sides whose ``measure`` (area_ha or length_km) differs."""
    left, right = f"a_{measure}", f"b_{measure}"
    return (
        _sided(a, "a", keys)
        .join(_sided(b, "b", keys), list(keys))
        .where(differs(F.col(left), F.col(right)))
        .select(*keys, left, right)
    )


def missing_totals_of(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("projet",), sides: str = "ab"
) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks, or for which ``b`` has no measure."""
    x, y = sides
    return (
        _sided(a, x, keys)
        .join(_sided(b, y, keys), list(keys), "left")
        .where(F.col(f"{y}_area_ha").isNull() | F.col(f"{y}_length_km").isNull())
    )


def sum_of_missing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return missing_totals_of(a, b, keys).agg(
        F.sum("a_area_ha").alias("area_ha"), F.sum("a_length_km").alias("length_km")
    )


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("projet",)) -> DataFrame:
    """One row per key of either side with what happened to it."""
    left = _sided(a, "a", keys).withColumn("in_a", F.lit(True))
    right = _sided(b, "b", keys).withColumn("in_b", F.lit(True))
    status = (
        F.when(F.col("in_b").isNull(), "only_a")
        .when(F.col("in_a").isNull(), "only_b")
        .when(differs(F.col("a_area_ha"), F.col("b_area_ha")), "changed_area")
        .when(differs(F.col("a_length_km"), F.col("b_length_km")), "changed_length")
        .otherwise("same")
    )
    return (
        left.join(right, list(keys), "full")
        .select(*keys, "a_area_ha", "b_area_ha", "a_length_km", "b_length_km", status.alias("status"))
    )


# ---- fingerprints -----------------------------------------------------------------------


def fingerprint_counts(measures: DataFrame, name: str = "nbre") -> DataFrame:
    return measures.groupBy("md5").agg(F.count(F.lit(1)).alias(name))


def diff_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fingerprints of ``a`` that ``b`` lacks or has another number of times."""
    return (
        fingerprint_counts(a, "a_nbre")
        .join(fingerprint_counts(b, "b_nbre"), "md5", "left")
        .where(F.col("b_nbre").isNull() | (F.col("a_nbre") != F.col("b_nbre")))
    )


def rows_of_fingerprints(a: DataFrame, differing: DataFrame) -> DataFrame:
    """The rows of ``a`` behind differing fingerprints."""
    return join_per_key(a, differing.select("md5", "a_nbre"), ["md5"], "a_nbre", "left_semi")


# ---- attribute syntax -------------------------------------------------------------------


def attribute_values(
    measures: DataFrame, attributes: dict[str, Column], key: str, side: int
) -> DataFrame:
    """The distinct (key, attribute, value), with the side they stand on. The cells of a row are
    folded in the task that reads them, so only distinct ones are shuffled."""
    cells = F.explode(
        F.array(
            *(F.struct(F.lit(n).alias("attribute"), c.cast("string").alias("value")) for n, c in attributes.items())
        )
    )
    return (
        measures.select(key, cells.alias("c"))
        .select(key, "c.attribute", "c.value")
        .distinct()
        .withColumn("side", F.lit(side))
    )


def compare_attributes(
    a: DataFrame, b: DataFrame, a_columns: dict[str, Column], b_columns: dict[str, Column], key: str = "projet"
) -> DataFrame:
    """Per attribute: in how many projects of both sides the sets of values differ, and how many
    values stand on one side only. One aggregation instead of a pairing of rows."""
    sides = attribute_values(a, a_columns, key, 1).unionByName(attribute_values(b, b_columns, key, 2))
    values = sides.groupBy(key, "attribute", "value").agg(F.sum("side").alias("sides"))
    projects = values.groupBy(key, "attribute").agg(
        F.count_if(F.col("sides") == 1).alias("only_a"),
        F.count_if(F.col("sides") == 2).alias("only_b"),
        F.count_if(F.col("sides") != 2).alias("in_a"),
        F.count_if(F.col("sides") != 1).alias("in_b"),
    )
    return (
        projects.where((F.col("in_a") > 0) & (F.col("in_b") > 0) & F.col(key).isNotNull())
        .groupBy("attribute")
        .agg(
            F.count(F.lit(1)).alias("projects"),
            F.count_if((F.col("only_a") > 0) | (F.col("only_b") > 0)).alias("projects_differing"),
            F.sum("only_a").alias("values_only_a"),
            F.sum("only_b").alias("values_only_b"),
        )
    )
