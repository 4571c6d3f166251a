"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these: space, and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of text worked on at once inside a task, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20


#: Bytes of one Arrow batch, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would.

    Spark itself hands the archive from the driver to the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if spark.conf.get(_BATCH_CONF, None) in (None, "67108864b"):  # not set, or as Spark has it
        # whole texts pass through Python; batches counted in rows alone can hold hundreds of megabytes
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def parts(spark: SparkSession) -> int:
    """How many partitions the session wants after a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; an id of null is taken as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def map_rows(df: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """Map Arrow batches: ``rows(batch)`` gives tuples in the order of ``schema``, put out in small batches."""
    spark_schema = _schema(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in batches:
            out = []
            for row in rows(batch):
                out.append(row)
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, spark_schema)


def _schema(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """(first, last) index of runs of texts that hold about ``most`` bytes, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of some texts (in UTF-8), and where each text's words begin.

    All texts are hashed at once: a word's hash is the difference of two running sums of
    bytes times powers of an odd base, brought to one scale and mixed. Words are runs without
    the separators above; ``lower`` folds A-Z only. The second array has one entry more than
    there are texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    gap = _SEPARATOR[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    hashes = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


def sorted_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))
