import zlib

import numpy as np

from tallymap.llm import toxicity
from tallymap.llm.tables import table

from .helpers import odd_documents, odd_rows


def test_held_out_labels_are_found_again(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.92
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(clean) <= 0.02


def test_scores_against_a_plain_version(spark):
    """Counts, selection, fit and scores from one text at a time, on one machine."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.repartition(3), labels, features=300)
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = docs.collect()
    learned = [(label[r["doc_id"]], r["text"] or "") for r in rows if r["doc_id"] in label]

    def buckets(text):
        found, size = set(), 1 << 16
        for a in range(0, max(len(text), 1), size):
            assert len(text) <= size
            for bucket, _ in toxicity._grams([text[a : a + size].lower()]):
                found |= set(bucket.tolist())
        return found

    sets = [(y, buckets(t)) for y, t in learned]
    n = [sum(y == k for y, _ in sets) for k in (0, 1)]
    counts = {}
    for y, found in sets:
        for b in found:
            counts.setdefault(b, [0, 0])[y] += 1

    def told(c):
        total = 0.0
        for k in (0, 1):
            both, rest = sum(c), sum(n) - sum(c)
            for got, expected in ((c[k], both * n[k] / sum(n)), (n[k] - c[k], rest * n[k] / sum(n))):
                total += got * np.log(got / expected) if got else 0.0
        return total

    offered = {b: told(c) for b, c in counts.items() if sum(c) >= toxicity.LEAST_DOCS}
    chosen = model.buckets.tolist()
    assert len(chosen) == 300
    least = min(offered[b] for b in chosen)
    assert all(v <= least + 1e-9 for b, v in offered.items() if b not in set(chosen))
    ratio = np.array([np.log((counts[b][1] + 1) / (n[1] + 2)) - np.log((counts[b][0] + 1) / (n[0] + 2)) for b in chosen])
    lists = [np.array([k for k, b in enumerate(chosen) if b in found], dtype=np.int64) for _, found in sets]
    w = toxicity.fit_logistic(lists, ratio, np.array([float(y) for y, _ in sets]))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    for r in rows:
        found = buckets(r["text"] or "")
        z = w[-1] + sum(w[k] * ratio[k] for k, b in enumerate(chosen) if b in found)
        assert abs(scored[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-3


def test_n_grams_do_not_cross_texts():
    both = list(toxicity._grams(["abc", "xyz"]))
    for k, (buckets, owner) in enumerate(both):
        for i, t in enumerate(("abc", "xyz")):
            single, _ = list(toxicity._grams([t]))[k]
            assert set(buckets[owner == i].tolist()) == set(single.tolist())


def test_fit_separates_what_can_be_separated():
    lists = [np.array([0, 2], np.uint16)] * 30 + [np.array([1, 2], np.uint16)] * 30 + [np.zeros(0, np.uint16)]
    labels = np.array([1.0] * 30 + [0.0] * 31)
    w = toxicity.fit_logistic(lists, np.array([1.0, -1.0, 0.5]), labels)
    assert w[0] > 1 and w[1] > 0.5
    z = [w[3] + sum(w[i] * v for i, v in enumerate((1.0, -1.0, 0.5)) if i in x) for x in lists]
    assert all((v > 0) == (y == 1) for v, y in zip(z, labels, strict=True))


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = labelled(spark, [(1, 1, 0), (6, None, 1), (6, 1, 0), (5, 0, None), (None, 1, 1), (8, 1, 1), (7, 0, 0)])
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["score"] == by_id[3]["score"]
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = odd_documents(spark, empty=True)
    assert toxicity.score_documents(none, toxicity.train(none, labels)).count() == 0


def test_without_both_labels_all_scores_are_the_share(spark):
    docs = odd_documents(spark)
    for pairs, share in (([], 0.0), ([(1, 1, 0)], 0.0), ([(i, 1, 1) for i in range(1, 9)], 1.0)):
        scores = {round(r["score"], 6) for r in toxicity.score_documents(docs, toxicity.train(docs, labelled(spark, pairs))).collect()}
        assert scores == {share}


def test_training_rows_are_bounded_after_the_join(spark):
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(300)] + [(i, "same") for i in range(4, 40)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 5).count() <= 5
    rows = toxicity.training_rows(docs, labels).collect()
    kept = [i for i in range(4, 40) if zlib.crc32(str(i).encode()) % 5]
    assert sum(r["text"] == "same" for r in rows) == len(kept)
