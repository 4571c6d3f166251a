import hashlib
import itertools
import math
import random
import re

import pytest

from tallymap.llm import personal as p

from .helpers import odd_documents, odd_rows

PIECES = ["a", "x.y", "@", ".", "-", "+", "(", ")", " ", "0", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+1 (017) 555-7713", "é", "_%", "7", "\n", "bob@mail.example.com"]


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and check % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return out


def test_base_spans_are_those_of_the_patterns(spark, sf_dir):
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25)))
        assert p.base_spans(text) == plain_base(text)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert p.base_spans(r["text"] or "") == plain_base(r["text"] or "")


def test_long_stretches_take_no_longer_than_others():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1 " * 100_000 + "+1" + " " * 100_000 + "a." * 100_000 + "@" + "1.2." * 50_000
    model = p.Model({("card", ""): 1.0, ("email", ""): 1.0}, {})
    base, _ = p.find(text, model)
    assert all(e <= len(text) for _, e, _ in base)


def segmentations(found):
    """All sets of candidates that don't overlap."""
    for size in range(len(found) + 1):
        for chosen in itertools.combinations(range(len(found)), size):
            spans = sorted((found[k][0], found[k][1], k) for k in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                yield [k for *_, k in spans]


def test_best_and_sum_over_all_segmentations():
    draw = random.Random(2)
    for _ in range(300):
        found = set()
        for _ in range(draw.randint(1, 9)):
            start = draw.randint(0, 9)
            found.add((start, start + draw.randint(1, 4), draw.choice(p.KINDS)))
        found = sorted(((*c, []) for c in found), key=lambda c: (c[1], c[0], c[2]))
        scores = [draw.uniform(-2, 2) for _ in found]
        touch = {(a, b): draw.uniform(-1.5, 1.5) for a in p.KINDS for b in p.KINDS}

        def value(chosen, found=found, scores=scores, touch=touch):
            joined = sum(touch[found[a][2], found[b][2]] for a, b in zip(chosen, chosen[1:], strict=False) if found[a][1] == found[b][0])
            return sum(scores[k] for k in chosen) + joined

        every = [(value(c), c) for c in segmentations(found)]
        best = p.best_segments(found, scores, touch)
        assert value(sorted(best, key=lambda k: found[k][0])) == pytest.approx(max(v for v, _ in every))
        total = math.log(sum(math.exp(v) for v, _ in every))
        got, share, touched = p.marginals(found, scores, touch)
        assert got == pytest.approx(total)
        for k, s in enumerate(share):
            assert s == pytest.approx(sum(math.exp(v - total) for v, c in every if k in c))
        for pair, s in touched.items():
            times = lambda c, pair=pair: sum((found[a][2], found[b][2]) == pair and found[a][1] == found[b][0] for a, b in zip(c, c[1:], strict=False))
            assert s == pytest.approx(sum(math.exp(v - total) * times(c) for v, c in every))


@pytest.fixture(scope="module")
def model(spark):
    return p.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 60)


def test_held_out_accuracy(spark, model):
    """Disguised data and decoys of other documents than those learned from."""
    seen = {x[1] for x in p.training_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 60)}
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").collect()
    held = sorted({x for r in rows for x in p.pieces(r["text"] or "")} - seen)
    held = [x for x in held if x[1] not in seen]
    data = clean = caught = alone = 0
    for text, spans in p.examples(held):
        found = p.candidates(text)
        got = {found[k][:3] for k in p.best_segments(found, [model.score(c) for c in found], model.touch)}
        if spans:
            data, caught = data + 1, caught + (set(spans) <= got)
        else:
            clean, alone = clean + 1, alone + (not got)
    assert data > 200 and caught >= 0.95 * data and clean > 200 and alone >= 0.97 * clean


def test_spans_beyond_the_patterns(model):
    def added(text):
        base, more = p.find(text, model)
        assert base == plain_base(text)
        return [(text[s:e], kind) for s, e, kind in more]

    assert added("my number is (212) 555-0188.") == [("(212) 555-0188", "phone")]
    assert added("mail john.doe [at] example [dot] com please") == [("john.doe [at] example [dot] com", "email")]
    assert added("at 10[.]0[.]0[.]1 there") == [("10[.]0[.]0[.]1", "ip")]
    assert added("paid by 4111.1111.1111.1111") == [("4111.1111.1111.1111", "card")]
    assert added("+1 (826) 555-4081 190.137.223.200 too") == [("+1 (826) 555-4081", "phone")]
    assert added("bob@mail.example.com on 1990-01-02, v1.2.3, 3.14159 or 1234567890123456 at home.") == []


def report(df):
    return {(r["doc_id"], r["base_sha256"]): r for r in df.collect()}


def test_report_against_patterns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = p.personal_report(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        base = [f"{k}:{s}:{e}" for s, e, k in plain_base(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in p.KINDS] == [sum(b.startswith(k) for b in base) for k in p.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s in base] == base and len(spans) == len(base) + r["n_added"]
        assert spans == sorted(spans, key=lambda x: (p.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))
    again = {(r["doc_id"], r["spans"]) for r in p.personal_report(docs).collect()}
    assert again == {(r["doc_id"], r["spans"]) for r in rows}


def test_odd_rows(spark):
    rows = p.personal_report(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 6 for r in rows) == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in rows if r["doc_id"] in (2, 3, 4))
    assert p.personal_report(odd_documents(spark, empty=True)).count() == 0
    few = spark.createDataFrame([(1, "call +1 (212) 555-0188 or bob@mail.example.com")] * 3, "doc_id long, text string")
    assert {r["n_phone"] + r["n_email"] for r in p.personal_report(few).collect()} == {2}


def test_learned_pieces_are_bounded_and_different(spark):
    rows = [(i, f"number {i % 50} bob{i % 40}@mail.example.com and 12345{i % 30}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = p.training_pieces(docs, 10)
    assert len(found) == len(set(found)) and max(sum(x[0] == k for x in found) for k in ("email", "none")) == 10
    assert found == p.training_pieces(docs.coalesce(1), 10)
