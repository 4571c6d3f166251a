"""Best-fit packing with certified bin counts.

Documents are encoded once; a document longer than a sequence is cut into pieces. Pieces are
dealt to groups by hash and each group is packed by best-fit decreasing. Lower bounds from
dual-feasible functions over the group's lengths say how many sequences any packing needs:

* the sum of lengths over the capacity;
* for each threshold e, lengths above C - e count as C, below e as nothing;
* for k = 1, 2, ..., a length x counts as floor((k+1) x / C) / k of a sequence, or as x where
  (k+1) x / C is whole.

A group whose count equals its bound can't be packed better by itself. What remains is space
that groups leave unfilled: the documents of loosely filled sequences (in a group with a gap:
of all that aren't full) are exchanged: those of up to MERGED groups, as far as ``GROUP`` pieces
allow, are put together by hash and packed anew, and the new packing counts where it needs fewer sequences. A sequence of one piece that no
other open piece fits beside is closed: no packing does better. This ends when the number of open
sequences meets the bound over all open lengths, which is taken from their histogram, after a round with
one group, or when PATIENCE rounds one after the other have saved no sequence. Every other round saves one at least,
so it ends. What is left above the bound is logged as the gap.

A group is bounded by ``GROUP`` pieces on average in every round, so no task holds more than that.

A null text is taken as empty: it has the end id alone. Repeated rows are packed each for
itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.llm.encode import encoder
from tallymap.llm.tables import map_rows
from tallymap.session import write_stage

_log = logging.getLogger(__name__)

CAPACITY = 4096
#: Pieces of a group, on average.
GROUP = 100_000
#: Groups whose open sequences are packed together, at most.
MERGED = 32
#: Rounds of exchange without a saved sequence, one after the other, at which it ends.
PATIENCE = 2
#: The round's number has 12 bits in that of a sequence.
LAST_TURN = (1 << 12) - 1
#: A sequence with at least this share of free space is open to exchange, in a certified group too.
LOOSE = 1 / 16


def piece_table(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def rows(batch):
        enc = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = enc.ids(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                yield doc, piece, at // 4, len(own) // 4, zlib.crc32(own)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), text.alias("text")),
        rows,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the order given, and the fill of each bin.

    Bins stand in stacks by free space; one large number marks the stacks that aren't empty, so
    the tightest bin that fits is its lowest mark at or above the length.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = 0
    fill: list[int] = []
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = marks >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                marks ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += length
        free -= length
        if free:
            stacks[free].append(b)
            marks |= 1 << free
    return bins, offsets, np.array(fill, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of these lengths needs, from dual-feasible functions."""
    if not len(lengths):
        return 0
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length, 0 to ``capacity``."""
    size = np.arange(capacity + 1, dtype=np.int64)
    mass = np.append(0, np.cumsum(count * size))  # mass[x]: of lengths below x
    number = np.append(0, np.cumsum(count))
    total = int(mass[-1])
    best = -(-total // capacity)
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    between = mass[capacity - e + 1] - mass[e]
    best = max(best, int((-(-(whole * capacity + between) // capacity)).max()))
    for k in range(1, 33):
        parts, rest = np.divmod((k + 1) * size, capacity)
        # in units of 1 / (k * capacity), so that all stays in whole numbers
        value = np.where(rest == 0, k * size, parts * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packed(capacity: int, first_round: bool):
    """Pack one group's pieces; what was packed before stays unless fewer sequences are needed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if first_round or len(fill) < rows["bin"].nunique():
            rows = rows.assign(bin=bins, offset=offsets, fill=fill[bins], fresh=True)
        else:
            rows = rows.assign(fresh=False)
        number = rows["bin"].nunique()
        free = 1 - rows["fill"] / capacity
        return rows.assign(open=(free >= LOOSE) | ((number > bound) & (free > 0)), gap=number - bound)

    return run


def pack_documents(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset: gapless in each sequence, which holds at most ``capacity``."""
    spark = pieces.sparkSession
    # pandas would turn ids next to nulls into floating point
    pieces = pieces.withColumn("known", F.col("doc_id").isNotNull()).fillna(0, ["doc_id"])
    keep = "doc_id long, piece int, start long, length long, ids_crc32 long, known boolean"
    schema = f"{keep}, grp long, bin long, offset long, fill long, sequence_id long, fresh boolean, open boolean, gap long"
    groups = max(1, -(-pieces.count() // group))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    zero = [F.lit(0).cast("long").alias(c) for c in ("bin", "offset", "fill", "sequence_id")]
    rows = pieces.select(*(c.split()[0] for c in keep.split(", ")), key.alias("grp"), *zero, F.lit(True).alias("fresh"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("gap"))
    done: list[DataFrame] = []
    turn, idle, before = 0, 0, None
    while True:
        packed = rows.groupBy("grp").applyInPandas(_packed(capacity, turn == 0), schema)
        # the round, the group and the bin number a sequence; a packing that stays keeps its number
        number = F.lit(turn << 51) + F.col("grp") * (1 << 27) + F.col("bin")
        packed = packed.withColumn("sequence_id", F.when(F.col("fresh"), number).otherwise(F.col("sequence_id")))
        packed = write_stage(packed, f"packed-{turn}")
        if groups == 1:
            done.append(packed)
            break
        # every sequence has one piece at offset 0; the round worked on what the last one left open
        least, now = packed.agg(F.min(F.when(F.col("open"), F.col("length"))), F.count(F.when(F.col("offset") == 0, True))).first()
        idle = idle + 1 if before is not None and now >= before else 0
        # a piece that no other open one fits beside is alone in any packing
        alone = (F.col("fill") == F.col("length")) & (F.col("length") + F.lit(least) > capacity)
        still = F.col("open") & ~alone
        counted = packed.where(still).groupBy("length").agg(F.count("*").alias("n"), F.sum((F.col("offset") == 0).cast("long")).alias("sequences")).toPandas()
        histogram = np.zeros(capacity + 1, dtype=np.int64)
        histogram[counted["length"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        before = int(counted["sequences"].sum())
        gap = before - histogram_bound(histogram, capacity)
        if gap <= 0 or idle == PATIENCE or turn == LAST_TURN:
            if gap > 0:
                _log.info("packing: %d of %d open sequences are not certified", gap, before)
            done.append(packed)
            break
        done.append(packed.where(~still))
        groups = max(-(-groups // MERGED), -(-int(histogram.sum()) // group))
        turn += 1
        # numbers of bins start anew in a group, so the sequence stands for the bin
        rows = packed.where(still).select(
            *(c.split()[0] for c in keep.split(", ")),
            F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)).alias("grp"),
            F.col("sequence_id").alias("bin"), "offset", "fill", "sequence_id", "fresh", "open", "gap",
        )
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    doc = F.when(F.col("known"), F.col("doc_id")).alias("doc_id")
    return whole.select(doc, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_texts(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack whole documents."""
    return pack_documents(write_stage(piece_table(docs, path, end_id, capacity), "pieces"), capacity)
