import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.llm import quality

from .helpers import WORD, odd_documents, odd_rows, words


def plain_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(spark):
    from tallymap.llm.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.quality_verdicts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def plain_verdicts(rows):
    """kept of each (text, lang), from references and distances worked out one by one."""
    seen = []
    for text, lang in rows:
        text = text or ""
        counts = plain_counts(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        of_class = [sum(map(len, re.findall(runs, text))) for runs in quality.CLASSES.values()]
        blank = len(text) - counts[1]
        chars = np.array([*of_class, blank, len(text) - blank - sum(of_class)]) / max(len(text), 1)
        times = Counter(w.lower() for w in words(text))
        common = [times[w] for w in quality.WORDS]
        shares = np.array([*common, counts[0] - sum(common)]) / max(counts[0], 1)
        seen.append((lang, failed, len(text), counts[0], chars, shares))
    means = {}
    for lang in quality.COMMON_WORDS:
        own = [x for x in seen if x[0] == lang and not x[1]]
        c, w = [x[4] for x in own if x[2] >= quality.LEAST_CHARS], [x[5] for x in own if x[3] >= quality.LEAST_COMMON]
        means[lang] = np.mean(c, axis=0) if c else None, np.mean(w, axis=0) if w else None

    def distance(p, q):
        m = (p + q) / 2
        return np.sqrt(max(0, sum(sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0) for x in (p, q)) / 2))

    out = []
    for lang, failed, chars, n, c, w in seen:
        near = []
        for own, k in ((c, 0), (w, 1)):
            known = {x: m[k] for x, m in means.items() if m[k] is not None}
            near.append(distance(own, known[lang]) if lang in known else min((distance(own, m) for m in known.values()), default=0))
        limit = quality.WORD_LIMIT + quality.WORD_NOISE / np.sqrt(max(n, 1))
        far = (chars >= quality.LEAST_CHARS and near[0] > quality.CHAR_LIMIT) or (n >= quality.LEAST_COMMON and near[1] > limit)
        out.append((not failed and not far, *near))
    return out


def test_kept_against_a_plain_version(spark):
    from tallymap.llm.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    # languages that no reference has, and none
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, F.lit("xx")).when(F.col("doc_id") % 13 != 0, F.col("lang")))
    rows = docs.collect()
    expected = dict(zip([r["doc_id"] for r in rows], plain_verdicts([(r["text"], r["lang"]) for r in rows]), strict=True))
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows) and {True, False} == {r["kept"] for r in got if not r["base_failed"]}
    for r in got:
        kept, of_chars, of_words = expected[r["doc_id"]]
        assert r["kept"] == kept and abs(r["char_distance"] - of_chars) < 1e-9 and abs(r["word_distance"] - of_words) < 1e-9


def test_repeats_and_lines(spark):
    eight = " ".join("abcdefgh")
    texts = [eight, f"{eight} {eight}", "a " * 20, f"x {eight} y {eight} z", "a\n a\na\n\n \na", "é x y z", "😀 #*$%&|<> \x1c \x0b\x0c"]
    rows = quality.quality_verdicts(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    for r in rows.collect():
        assert tuple(r[c] for c in BASE) == plain_counts(texts[r["doc_id"]]), r


def test_distance(spark):
    draw = np.random.default_rng(1)
    pairs = [(draw.dirichlet(np.ones(6)), draw.dirichlet(np.ones(6))) for _ in range(20)] + [(np.eye(6)[0], np.eye(6)[1])] + [(np.eye(6)[2],) * 2]
    rows = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in pairs], "p array<double>, q array<double>")
    got = [r[0] for r in rows.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]

    def half(x, y):
        return sum(a * np.log2(2 * a / (a + b)) for a, b in zip(x, y, strict=True) if a > 0)

    for d, (p, q) in zip(got, pairs, strict=True):
        assert abs(d - np.sqrt(max(0, (half(p, q) + half(q, p)) / 2))) < 1e-9
    assert abs(got[-2] - 1) < 1e-12 and abs(got[-1]) < 1e-9


@pytest.fixture(scope="module")
def judged(spark):
    from tallymap.llm.tables import table

    sf_dir = "/root/testdata/sf0.01"
    rows = quality.quality_verdicts(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.where("NOT base_failed").collect()


def test_verdicts_follow_the_quality_labels(judged):
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0 and r["n_words"] >= 150]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_main_path_is_native(spark):
    plan = quality.text_counts(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    rows = quality.quality_verdicts(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_words"] == 0 and by_id[2]["base_failed"] and not by_id[2]["kept"]
    assert tuple(by_id[5][c] for c in BASE) == plain_counts(odd_rows()[4][1])
    assert quality.quality_verdicts(odd_documents(spark, empty=True)).count() == 0
    unknown = odd_documents(spark).withColumn("lang", F.lit("xx"))
    assert all(r["kept"] == (not r["base_failed"]) and r["char_distance"] is None for r in quality.quality_verdicts(unknown).collect())
