import math

import numpy as np
import pytest

from tallymap.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, c string, component string, n string, node string, times string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, components=32):
    """By a dense eigensolver over the exact covariance."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in rows)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in rows]
    n, sums = len(x), [sum(r[d] for r in x) for d in range(width)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in rows], n, deviation, white, values[order] / values.sum()


def check(got, rows, components=32, close=1e-9):
    ids, n, deviation, white, explained = plain(rows, components)
    assert len(got) == len(ids) * len(explained) and {r["n"] for r in got} == {n}
    got = sorted(got, key=lambda r: (r["component"], r["deviation"], r["vec_id"] or -1))
    for c in range(len(explained)):
        mine = [r for r in got if r["component"] == c + 1]
        theirs = sorted(zip(deviation, [-1 if i is None else i for i in ids], white[:, c], strict=True))
        assert [(r["deviation"], r["vec_id"] if r["vec_id"] is not None else -1) for r in mine] == [t[:2] for t in theirs]
        a, b = np.array([r["whitened"] for r in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < close
        assert all(abs(r["explained"] - explained[c]) <= 1e-10 * explained[c] for r in mine)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-10


@pytest.mark.parametrize("dim,rows,kind", [(12, 300, "spread"), (30, 400, "few"), (9, 200, "flat"), (1, 9, "spread"), (16, 300, "whole")])
def test_rank_one_updates(dim, rows, kind):
    draw = np.random.default_rng(dim)
    x = draw.normal(size=(rows, dim)) * np.exp(2 * draw.normal(size=dim))
    if kind == "few":
        x = x[draw.integers(0, 4, rows)]
    if kind == "flat":
        x[:, 4:] = 0
    if kind == "whole":
        x = np.round(draw.normal(size=(rows, dim)))
    spectra = []
    for part in np.array_split(x, 3):
        d, q = np.zeros(dim), np.eye(dim)
        for vector in part:
            d, q = w.rank_one(d, q, vector)
        spectra.append((d, q))
    d, q = w.combine(spectra)
    whole = x.T @ x
    top = np.linalg.eigvalsh(whole)[-1]
    assert np.abs(d - np.linalg.eigvalsh(whole)).max() < 1e-13 * top
    assert np.abs(q.T @ q - np.eye(dim)).max() < 1e-12 and np.abs(q * d @ q.T - whole).max() < 1e-12 * top
    weighted = w.rank_one(*w.rank_one(np.zeros(dim), np.eye(dim), x[0], 5.0), x[1])
    assert np.allclose(weighted[1] * weighted[0] @ weighted[1].T, 5 * np.outer(x[0], x[0]) + np.outer(x[1], x[1]))


def test_whole_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    check(w.whitening_report(vectors).collect(), rows)


def test_odd_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=5).round(2).tolist()) for i in range(80)]
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # copies
    rows += [(7, [1.0] * 5), (7, [1.0] * 5), (None, [2.0, 1.0, 0.0, 0.0, 1.0]), (600, [0.5]), (601, [])]
    odd = [(700, None), (701, [None] * 5), (702, [0.1, float("nan"), 0.0, 0.0, 0.0]), (703, [float("inf")] * 5)]
    check(w.whitening_report(frame(spark, rows + odd)).collect(), rows)
    found = w.whiten(frame(spark, rows), components=2).collect()
    check(found, rows, 2)
    assert w.whiten(frame(spark, [])).count() == 0 and w.whiten(frame(spark, odd)).count() == 0
    assert w.whiten(frame(spark, [(1, [0.5, 0.25])])).count() == 0  # no variance
    flat = [(i, [float(i), 0.0, -2.0 * i]) for i in range(9)]
    assert {r["component"] for r in w.whiten(frame(spark, flat)).collect()} == {1}


def test_large_entries(spark):
    rows = [(1, [1e30, 0.5]), (2, [-3.0, 0.25]), (3, [4.0, -7.0])]
    got = w.whitening_report(frame(spark, rows)).collect()
    assert len(got) in (3, 6) and all(math.isfinite(r["whitened"]) for r in got)
    exact = [3 * x - (2**40 - 192 + 256) for x in (2**40, -192, 256)]
    second = [3 * x - (32 + 16 - 448) for x in (32, 16, -448)]
    whole = {i + 1: a * a + b * b for i, (a, b) in enumerate(zip(exact, second, strict=True))}
    assert {r["vec_id"]: int(r["deviation"]) for r in w.whiten(frame(spark, rows)).collect()} == whole
    assert all(r["deviation"] is None for r in got if whole[r["vec_id"]] >= 2**63)


def test_widened_subspace(spark):
    """A subspace that is far off is mended by its residuals."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 10)) * np.array([9, 7, 6, 4, 3, 1, 1, 0.5, 0.4, 0.3])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    usable = w.usable(frame(spark, rows))
    fit = w.exact_sums(usable)
    values, axes = w.rayleigh_ritz(usable, fit, draw.normal(size=(10, 4)), 2)
    _, _, _, _, explained = plain(rows, 10)
    assert abs(values[0] / values[1] - explained[0] / explained[1]) < 1e-9
