import math
import random

import pytest
from pyspark.sql import functions as F

from tallymap.llm import mixing
from tallymap.llm.tables import table

from .helpers import odd_documents, odd_rows, words


def plain_targets(sizes: dict, weights=(5.0, 2.0, 1.0), most=3.0) -> dict:
    """Share by weight, cut at the limit, share the excess anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, [] if s is None else [ord(c) for c in s]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: most * sizes[s] for s in order}
    target, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(limit[s] for s in fixed)
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        target = {s: limit[s] if s in fixed else rest * weight[s] / total for s in order}
        above = {s for s in free if target[s] > limit[s]}
        if not above:
            return target
        fixed |= above


def test_targets(spark):
    draw = random.Random(7)
    for trial in range(6):
        sizes = {s: draw.choice((0, 1, 10, 500, 5000)) for s in draw.sample([None, "", "a", "B", "é", "z", "aa", "日", "😀", "src10", "src2"], 7)}
        if not sum(sizes.values()):
            continue
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.target_words(rows).collect()}
        expected = plain_targets(sizes)
        assert got.keys() == expected.keys()
        assert all(math.isclose(got[s], expected[s], abs_tol=1e-6) for s in got), (trial, got, expected)


@pytest.fixture(scope="module")
def mixed(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return docs, [r.asDict() for r in mixing.mixture(docs).collect()]


def test_rates_meet_the_targets_and_copies_stay_near(mixed):
    docs, rows = mixed
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and all(r["size"] == len(words(texts[r["doc_id"]])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    expected = plain_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r["source"] == source]
        assert all(r["source_size"] == size and math.isclose(r["target"], expected[source], rel_tol=1e-9) for r in own)
        assert math.isclose(sum(r["size"] * r["rate"] for r in own), expected[source], rel_tol=1e-6)
        assert abs(sum(r["taken"] for r in own) - expected[source]) <= 0.02 * expected[source]
        tilt = [math.log(r["rate"]) / r["size"] for r in own if r["size"] and 0 < r["rate"] < 3]
        assert max(tilt) - min(tilt) < 1e-6  # one multiplier for a source
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and abs(r["copies"] - r["rate"]) < 2 for r in rows)


def test_reruns_agree(spark, mixed):
    docs, rows = mixed
    again = mixing.mixture(docs.repartition(7, "text")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_a_hot_cell_is_parted(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"))
    rows = mixing.mixture(docs).collect()
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(odd_rows()) and all(r["taken"] <= 3 * r["size"] for r in rows)
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    count = {}
    for r in applied.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    copies = {}
    for r in rows:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert count == {k: v for k, v in copies.items() if v}
    none = odd_documents(spark, empty=True)
    assert mixing.mixture(none).count() == 0 and mixing.apply_mix(none).count() == 0
    blank = docs.withColumn("text", F.lit(""))
    assert {(r["taken"], r["copies"]) for r in mixing.mixture(blank).collect()} == {(0, 1)}
