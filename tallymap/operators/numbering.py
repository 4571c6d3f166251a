"""Running numbers and running sums over a whole table without a one-task window.

The rows are written once to the shared folder, so that each has a fixed place (file and row, as one number). Only the order
columns and the place are range-partitioned and sorted, of the order columns behind the first LEAD only those of rows that these don't
tell apart; of these the places alone are written, in order. A number is
the offset of the file of places plus the row in it, and is joined back to the row by its place; only one row per file goes
through an ordered window. Rows that are equal in the given order are told apart by their place, so a group of copies,
however large, is spread over as many ranges as it fills, and a task that is run again routes its rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymap.session import new_path, write_stage

_FILE, _ROW, _SHIFT, _PLACE = "_file", "_row", "_shift", "_place"
#: Rows of a file, as a power of two.
ROW_BITS = 40
#: Order columns that are sorted for every row; those behind them only where these are equal.
LEAD = 2


def _lying(rows: DataFrame) -> DataFrame:
    """Rows of a table with one file for each task, with the number of their file and their row in it."""
    number = F.substring_index(F.substring(F.col("_metadata.file_name"), 6, 20), "-", 1)  # part-NNNNN-...
    return rows.select("*", number.cast("bigint").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))


def _apart(keyed: DataFrame, names: list[str]) -> DataFrame:
    """The rows with order columns behind the first LEAD in one (``_rest``), and only where these don't tell a row from all others."""
    lead, rest = names[:LEAD], names[LEAD:]
    tied = keyed.groupBy(*(F.col(c).alias(f"{c}t") for c in lead)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # written, so that its size is known: where it is small it goes to the rows, which then need no shuffle
    tied = write_stage(tied, "ties")
    same = [F.col(c).eqNullSafe(F.col(f"{c}t")) for c in lead]
    joined = keyed.join(tied, same, "left").withColumn("_rest", F.when(F.col("_n").isNotNull(), F.struct(*rest)))
    return joined.select(*(c for c in keyed.columns if c not in rest), "_rest")


def _ordered_places(written: DataFrame, order_by: Sequence[Column | str], weight: str | None = None) -> DataFrame:
    """The places of the written rows (and a weight) in order, with their file and row in that order."""
    spark = written.sparkSession
    order = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    names = [f"_o{i}" for i in range(len(order))]
    kept = [F.col(weight).alias("_weight")] if weight else []
    path = new_path(spark, "places")
    keyed = written.select(*order, _PLACE, *kept)
    if len(names) > LEAD:
        keyed, names = _apart(keyed, names), [*names[:LEAD], "_rest"]
    names.append(_PLACE)
    sorted_rows = keyed.repartitionByRange(*names).sortWithinPartitions(*names)
    places = sorted_rows.select(_PLACE, *(["_weight"] if weight else []))
    # not compressed: the size of a table of numbers tells Spark whether it can be broadcast
    places.write.option("compression", "none").option("maxRecordsPerFile", 0).parquet(path)
    return _lying(spark.read.schema(places.schema).parquet(path))


def _written(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    rows = _lying(spark.read.schema(df.schema).parquet(path))
    return rows.withColumn(_PLACE, F.shiftleft(_FILE, ROW_BITS).bitwiseOR(F.col(_ROW))).drop(_FILE, _ROW)


def _joined(written: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """Rows with what was found for their place; no place has more than one row on either side."""
    return written.join(numbers.select(_PLACE, name), _PLACE).drop(_PLACE)


def _file_offsets(per_file: DataFrame, amount: str) -> DataFrame:
    before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select(_FILE, F.coalesce(F.sum(amount).over(before), F.lit(0)).alias(_SHIFT))


def _numbered(written: DataFrame, order_by: Sequence[Column | str], name: str) -> DataFrame:
    places = _ordered_places(written, order_by)
    offsets = _file_offsets(places.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_n")), "_n")
    # One row per file written, at most spark.sql.shuffle.partitions of them.
    numbered = places.join(F.broadcast(offsets), _FILE).withColumn(name, F.col(_SHIFT) + F.col(_ROW) + 1)
    return _joined(written, numbered, name)


def dense_number(df: DataFrame, order_by: Sequence[Column | str], name: str = "num") -> DataFrame:
    """``df`` with 1..n in the given order."""
    return _numbered(_written(df), order_by, name)


def number_by_group(df: DataFrame, group: str, order_by: Sequence[Column | str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with 1..n in order of ``group``, then of ``order_by``; and of each group, of which there are few, the number of
    rows (_total) and of those in groups before it (_shift), which need no numbers."""
    written = _written(df)
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = written.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    groups = groups.withColumn(_SHIFT, F.coalesce(F.sum("_total").over(before), F.lit(0)))
    return _numbered(written, [group, *order_by], name), groups


def running_total(
    df: DataFrame, order_by: Sequence[Column | str], weight: str, name: str
) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before this one."""
    written = _written(df)
    places = _ordered_places(written, order_by, weight)
    offsets = _file_offsets(places.groupBy(_FILE).agg(F.sum("_weight").alias("_n")), "_n")
    before = Window.partitionBy(_FILE).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        places.withColumn("_before", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .join(F.broadcast(offsets), _FILE)
        .withColumn(name, F.col(_SHIFT) + F.col("_before"))
    )
    return _joined(written, summed, name)


def assign_num(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """``num`` = ``mesure_id``, or the running number where it is missing."""
    return dense_number(df, order_by, "_running").withColumn(
        "num", F.coalesce(F.col("mesure_id"), F.col("_running"))
    ).drop("_running")
