import hashlib
import random
import zlib

import numpy as np

from tallymap.llm import runs

from .helpers import odd_documents, odd_rows, words


def plain_runs(text, shortest=24, times=3):
    """All maximal stretches of each period, by comparing words."""
    n, found = len(text), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and text[i] == text[i + q]:
                i += 1
            if i + q - s >= max(shortest, times * q):
                found.setdefault((s, i + q), q)  # the smallest period comes first
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(doc, text):
    w = words(text)
    h = zlib.crc32(("" if doc is None else str(doc)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc, text):
    w = plain_words(doc, text)
    found = plain_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc, len(found), *best, best[1] * 1000 // best[2] if found else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def made(draw):
    """Words of a small alphabet with stretches that repeat, some inside each other."""
    out = []
    for _ in range(draw.randint(0, 6)):
        kind = draw.random()
        if kind < 0.4:
            out += [draw.choice("abc") for _ in range(draw.randint(0, 40))]
        elif kind < 0.9:
            unit = [draw.choice("ab") for _ in range(draw.randint(1, 14))]
            n = draw.randint(1, 9 * len(unit))
            out += [unit[i % len(unit)] for i in range(n)]
        else:
            out += out[-draw.randint(1, 30) :] * draw.randint(1, 4)
    return [w.encode() for w in out]


def test_runs_against_all_periods():
    draw = random.Random(3)
    texts = [made(draw) for _ in range(1500)] + [[b"x"] * 1000, [], [b"y"] * 23, [b"z"] * 24]
    for part in (texts[:700], texts[700:]):
        assert runs.runs_of(part) == [plain_runs(t) for t in part]
    texts = texts[:300]
    assert runs.runs_of(texts, 6, 2) == [plain_runs(t, 6, 2) for t in texts]


def test_common_prefixes_and_order():
    draw = random.Random(8)
    texts = [[draw.randint(0, 2) for _ in range(draw.randint(1, 60))] for _ in range(20)]
    array = runs.SuffixArray(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    array.sort()
    suffixes = [(int(array.text[i]), list(map(int, array.word[i : array.end[i]]))) for i in array.order]
    assert suffixes == sorted(suffixes)
    for (ta, a), (tb, b), common in zip(suffixes, suffixes[1:], array.common_prefixes()[1:], strict=False):
        same = 0
        while ta == tb and same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert same == common


def test_very_long_run():
    text = [f"{i % 4001}".encode() for i in range(60_000)]
    assert runs.runs_of([text, text[:100]]) == [[(0, 60_000, 4001)], []]
    assert runs.runs_of([[b"w"] * 100_000]) == [[(0, 100_000, 1)]]


def report(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_report_on_documents_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = report(runs.run_report(runs.with_tails(docs)))
    expected = sorted(plain_row(*r) for r in given if len(words(r[1])) < 3000)
    short = {r[0] for r in expected}
    assert [r for r in rows if r[0] in short] == expected and len(rows) == len(given)
    assert sum(r[1] > 0 for r in rows) >= 0.05 * len(rows)

    odd = report(runs.run_report(runs.with_tails(odd_documents(spark))))
    expected = [plain_row(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 10_000]
    assert len(odd) == len(odd_rows()) and sorted(map(str, expected)) == sorted(str(r) for r in odd if r[0] != 5)
    assert runs.run_report(runs.with_tails(odd_documents(spark, empty=True))).count() == 0


def test_found_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "start " + "a b " * 15 + "end"), (2, "plain words")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in runs.find_runs(docs).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(1, 30, 2)]
    assert rows[1]["collapsed"] == "start a b end" and rows[2]["collapsed"] == "plain words" and rows[2]["runs"] == []
