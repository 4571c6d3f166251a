"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (3 to 8 characters of the lower-cased text,
hashed). Its naive Bayes ratio is

    r = log((p + a) / (P + 2 a)) - log((q + a) / (Q + 2 a))

with p of P toxic and q of Q other training documents having it. A document's features are
the ratios of what it has; logistic regression on those gives the score. Only the ``features``
n-grams that tell the labels apart best (by likelihood ratio) take part.

Training rows are those with a label whose crc32(doc_id as text) modulo 5 isn't 0; of these the
``most`` with the lowest hash of doc_id are used. Both numbers bound what is broadcast and
what comes to the driver: ids, labels and selected features of the training rows, never texts.
Counting and scoring are distributed, and scoring reads every whole text.

A null text is taken as empty: it has no feature and gets the score of none. A label of null is no
label; where doc_id has several labels the highest counts. Repeated rows are scored each for
itself. Without training rows of both kinds every score is the share of toxic ones (0 if there
are none). An empty table gives no rows. lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import crc_mod, map_rows
from tallymap.session import write_stage

ORDERS = (3, 4, 5, 6, 7, 8)
#: Buckets of hashed n-grams, as a power of two.
BITS = 22
CHUNKS = 64
#: Labelled rows that the classifier is fitted on, at most.
TRAINING_ROWS = 20_000
#: n-grams that take part.
FEATURES = 8_192
#: Training documents in which an n-gram occurs at least.
LEAST_DOCS = 3
SMOOTHING = 1.0
PENALTY = 1e-4
#: Steps of the fit, at most.
STEPS = 80
#: Characters worked on at once.
SLICE_CHARS = 1 << 18
_FACTORS = np.array(
    [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint32
)


@dataclass(frozen=True)
class Model:
    """Selected buckets in order, the weight of each, and the weight of none."""

    buckets: np.ndarray
    weights: np.ndarray
    base: float

    @property
    def name(self) -> str:
        return hashlib.sha1(self.buckets.tobytes() + self.weights.tobytes() + repr(self.base).encode()).hexdigest()


def _grams(texts: list[str]):
    """Buckets of all n-grams, one order after the other, with the text of each.

    Texts stand behind each other with blank places between them, as many as the longest n-gram. One that begins
    with the last blank place before a text marks its beginning, one that ends with blank places its end; those
    that begin behind a text's end stand for nothing and get one bucket.
    """
    gap = "\0" * max(ORDERS)
    joined = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + len(gap) for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = len(gap) - 1  # one blank place before the first character counts
    codes = joined[begin:]
    n = len(owner)
    behind = (np.cumsum(lengths)[:, None] - np.arange(1, len(gap))).ravel()
    hashed = np.zeros(n, dtype=np.uint32)
    for k in range(max(ORDERS)):
        part = codes[k : k + n]
        if len(part) < n:
            part = np.concatenate([part, np.zeros(n - len(part), dtype=np.uint32)])
        hashed = hashed + (part + np.uint32(1)) * _FACTORS[k]
        if k + 1 in ORDERS:
            spread = hashed ^ (hashed >> np.uint32(15))
            spread = (spread * np.uint32(0x2C1B3C6D) + np.uint32(k)) * np.uint32(0x297A2D39)
            spread >>= np.uint32(32 - BITS)
            spread[behind] = 0
            yield spread, owner


def _slices(texts: list[str]):
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _lower(texts: list) -> list[str]:
    return [(t or "").lower() for t in texts]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """text and label (0 or 1) of the training rows: at most ``most`` different texts of as many doc_ids, repeated rows once."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.withColumn("digest", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    # a doc_id may stand with many texts, so the bound holds for what the join gives, by key only
    chosen = texts.select("doc_id", "digest").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(most)
    rows = texts.join(F.broadcast(chosen), ["doc_id", "digest"])
    return rows.dropDuplicates(["doc_id", "digest"]).select("text", "label")


def _count_features(rows: DataFrame, smoothing: float, least: int, features: int) -> tuple[int, int, pd.DataFrame]:
    """Training rows by label, and the selected buckets with their ratio."""

    def count(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.int32)
        numbers = [0, 0]
        for batch in batches:
            labels = batch.column(1).to_pylist()
            at = 0
            for part in _slices(_lower(batch.column(0).to_pylist())):
                own = np.array(labels[at : at + len(part)])
                at += len(part)
                pairs = [(owner.astype(np.int64) << BITS) | bucket for bucket, owner in _grams(part)]
                pairs = np.sort(np.concatenate(pairs))
                pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
                label, bucket = own[pairs >> BITS], pairs & ((1 << BITS) - 1)
                for k in (0, 1):
                    np.add.at(counts[k], bucket[label == k], np.int32(1))  # in place: no second table
                    numbers[k] += int((own == k).sum())
        if sum(numbers):
            width = (1 << BITS) // CHUNKS
            for chunk in range(CHUNKS):
                piece = counts[:, chunk * width : (chunk + 1) * width]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([chunk], pa.int32()), "n0": pa.array([numbers[0]], pa.int64()),
                     "n1": pa.array([numbers[1]], pa.int64()), "counts": pa.array([piece.tobytes()], pa.binary())}
                )

    def select(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int32).astype(np.int64) for c in group["counts"]).reshape(2, -1)
        n0, n1 = int(group["n0"].sum()), int(group["n1"].sum())
        bucket = np.flatnonzero(total.sum(axis=0) >= least)
        q, p = total[0, bucket], total[1, bucket]
        ratio = np.log((p + smoothing) / (n1 + 2 * smoothing)) - np.log((q + smoothing) / (n0 + 2 * smoothing))

        def part(seen, expected):
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

        n, both = n0 + n1, p + q
        told = sum(
            part(a, b)
            for a, b in ((p, both * n1 / n), (q, both * n0 / n), (n1 - p, (n - both) * n1 / n), (n0 - q, (n - both) * n0 / n))
        )
        offered = pd.DataFrame({"bucket": bucket + int(group["chunk"].iloc[0]) * total.shape[1], "ratio": ratio, "told": told, "n0": n0, "n1": n1})
        return offered.nlargest(features, "told", keep="all")

    counted = rows.mapInArrow(count, "chunk int, n0 long, n1 long, counts binary")
    found = counted.groupBy("chunk").applyInPandas(select, "bucket long, ratio double, told double, n0 long, n1 long")
    # written first, so that executors and not the driver merge what the chunks offer
    best = write_stage(found.orderBy(F.desc("told"), "bucket").limit(features), "features").toPandas().sort_values("bucket")
    if best.empty:
        numbers = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        return numbers.get(0, 0), numbers.get(1, 0), best
    return int(best["n0"].iloc[0]), int(best["n1"].iloc[0]), best


_tables: dict[str, np.ndarray] = {}


def _slots(buckets: np.ndarray) -> np.ndarray:
    """Place of each bucket among the selected ones, or -1; kept by a worker for one selection."""
    key = hashlib.sha1(buckets.tobytes()).hexdigest()
    if key not in _tables:
        _tables.clear()
        slots = np.full(1 << BITS, -1, dtype=np.int16)
        slots[buckets] = np.arange(len(buckets), dtype=np.int16)
        _tables[key] = slots
    return _tables[key]


def _present(texts: list[str], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, selected feature) pairs, each once, in order."""
    slots = _slots(buckets)
    found = []
    for bucket, owner in _grams(texts):
        slot = slots[bucket]
        at = np.flatnonzero(slot >= 0)
        found.append((owner[at].astype(np.int64) << 16) | slot[at])
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return pairs >> 16, pairs & 0xFFFF


def fit_logistic(lists: list[np.ndarray], values: np.ndarray, labels: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of the features, and of the constant behind them, by limited-memory BFGS.

    ``lists``: the features that each row has, ``values``: the value of a feature where it is there. Rows are gone
    through in blocks, so the largest array besides the lists is one block's.
    """
    n, m = len(values), len(labels)
    blocks = []
    for a in range(0, m, 1000):
        part = lists[a : a + 1000]
        blocks.append((slice(a, a + len(part)), np.repeat(np.arange(len(part)), [len(x) for x in part]).astype(np.int16), np.concatenate(part)))

    def loss(w):
        scaled = w[:n] * values
        slope, cost, total = np.zeros(n), 0.0, 0.0
        for place, row, column in blocks:
            label = labels[place]
            z = w[n] + np.bincount(row, weights=scaled[column], minlength=len(label))
            cost += (np.logaddexp(0, z) - label * z).sum()
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / m
            slope += np.bincount(column, weights=error[row], minlength=n)
            total += error.sum()
        return cost / m + penalty / 2 * (w[:n] ** 2).sum(), np.append(slope * values + penalty * w[:n], total)

    w = np.zeros(n + 1)
    w[n] = math.log(max(labels.sum(), 0.5) / max(m - labels.sum(), 0.5))
    cost, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() < 1e-6:
            break
        way, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        size = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum())
        while size > 1e-10:
            new = w + size * way
            new_cost, new_slope = loss(new)
            if new_cost <= cost + 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        if (new - w) @ (new_slope - slope) > 1e-14:
            steps = [*steps[-9:], (new - w, new_slope - slope)]
        small = cost - new_cost < 1e-9
        w, cost, slope = new, new_cost, new_slope
        if small:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, features: int = FEATURES) -> Model:
    """Fit on the training rows of the documents."""
    # read twice, and a small part of the documents
    rows = write_stage(training_rows(docs, labels, most), "training-rows")
    n0, n1, best = _count_features(rows, SMOOTHING, LEAST_DOCS, min(features, 1 << 15))
    buckets = best["bucket"].to_numpy(np.int64)
    if not n0 or not n1 or not len(buckets):
        share = (n1 / (n0 + n1)) if n0 + n1 else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)) if 0 < share < 1 else (-50.0, 50.0)[share == 1])

    def featured(batch):
        labels, at = batch.column(1).to_pylist(), 0
        for part in _slices(_lower(batch.column(0).to_pylist())):
            owner, slot = _present(part, buckets)
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            for i in range(len(part)):
                yield labels[at + i], slot[ends[i] : ends[i + 1]].astype("<u2").tobytes()
            at += len(part)

    seen = sorted(map(tuple, map_rows(rows, featured, "label int, slots binary").toPandas()[["slots", "label"]].itertuples(index=False)))
    ratio = best["ratio"].to_numpy()
    w = fit_logistic([np.frombuffer(s, dtype="<u2") for s, _ in seen], ratio, np.array([label for _, label in seen], dtype=float))
    return Model(buckets, w[:-1] * ratio, float(w[-1]))


def score_texts(texts: list, model: Model) -> np.ndarray:
    """Score of each text, 0 to 1."""
    out = []
    for part in _slices(_lower(texts)):
        z = np.full(len(part), model.base)
        if len(model.buckets):
            owner, slot = _present(part, model.buckets)
            z += np.bincount(owner, weights=model.weights[slot], minlength=len(part))
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        scores = score_texts(batch.column(2).to_pylist(), held.value).tolist()
        for doc, out, score in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scores, strict=True):
            yield doc, out, score, int(score >= 0.5)

    doc = F.col("doc_id").cast("long")
    given = docs.select(doc.alias("doc_id"), (crc_mod(doc, 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(given, rows, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a score below ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = score_texts(batch.column(at).to_pylist(), held.value)
            yield batch.filter(pa.array(scores < least))

    return docs.mapInArrow(run, docs.schema)
