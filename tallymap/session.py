"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallymap", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session given."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TALLYMAP_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: a local
    temporary folder on a cluster would not be seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallymap-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tallymap/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` returns per running context and arguments. Large expressions take
    thousands of calls into the JVM to build and can be used again in any plan."""
    kept: dict[tuple, object] = {}

    @functools.wraps(build)
    def wrapper(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper
