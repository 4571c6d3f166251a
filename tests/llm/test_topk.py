import math
import random

import numpy as np
import pytest

from tallymap.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, query string, rank string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, every=50, top=5):
    known = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        known.append((i, q))
    out = []
    for row, (i, q) in enumerate(known):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j) for other, (j, w) in enumerate(known) if other != row)
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,size", [(8192, 1024), (17, 3)])
def test_against_all_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(topk.build_index, "__defaults__", (block,))
    monkeypatch.setattr(topk.pack_queries, "__defaults__", (size,))
    draw = random.Random(9)
    rows = [(i, [round(draw.gauss(0, 0.3), 2) for _ in range(6)]) for i in range(240)]
    rows += [(i, rows[50][1]) for i in range(240, 300)]  # ties
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.5] * 6), (304, []), (305, [0.2])]
    rows += [rows[3], rows[100], (7, [9.0] * 6), (50, [8.0] * 6)]  # repeated rows, and ids with two vectors
    found = topk.top_products(frame(spark, rows))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, found.collect()))
    assert got == plain(rows)


def test_few_rows_and_none(spark):
    assert sorted(map(tuple, topk.top_products(frame(spark, [(0, [1.0]), (1, [0.5]), (50, [-1.0])])).collect())) == [
        (0, 1, 1, 32768), (0, 2, 50, -65536), (50, 1, 1, -32768), (50, 2, 0, -65536),
    ]
    assert topk.top_products(frame(spark, [(0, [1.0])])).count() == 0
    assert topk.top_products(frame(spark, [])).count() == 0


def test_the_index_is_dealt_once(spark, monkeypatch):
    """However many blocks there are, one Generate spreads queries, and tasks are those of the session."""
    seen = []
    monkeypatch.setattr(topk.build_index, "__defaults__", (10,))
    monkeypatch.setattr(topk.pack_queries, "__defaults__", (1,))
    map_rows = topk.map_rows
    monkeypatch.setattr(topk, "map_rows", lambda df, *a: seen.append(df) or map_rows(df, *a))
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    assert sorted(map(tuple, topk.top_products(frame(spark, rows)).collect())) == plain(rows)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    index = next(x for x in plan.splitlines() if "postings" in x or "Relation" in x and "rests" in x)
    above = plan[: plan.index(index)].splitlines()
    assert sum("Generate" in x for x in plan.splitlines()) == 1 and "Generate explode" not in above[-1]
    assert seen[0].rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "SortMergeJoin" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_segments_are_left_out_only_on_proof():
    """With one large component the first segment decides; the result is that of all of them."""
    draw = np.random.default_rng(2)
    matrix = draw.integers(-3, 4, (500, 8))
    matrix[:, 0] = draw.permutation(500) * 40
    level = np.frexp(np.abs(matrix).astype(float))[1]
    block = {"n": 500, "width": 8, "rids": np.arange(500).tobytes(), "ids": np.arange(500).tobytes(), "vectors": [], "dims": [], "values": [], "rests": []}
    left = matrix.astype(float)
    for at in sorted(set(level[matrix != 0].tolist()), reverse=True):
        vector, dim = np.nonzero((level == at) & (matrix != 0))
        left[vector, dim] = 0
        block["vectors"].append(vector.astype(np.uint16).tobytes())
        block["dims"].append(dim.astype(np.uint16).tobytes())
        block["values"].append(matrix[vector, dim].astype(np.int64).tobytes())
        block["rests"].append(np.sqrt((left**2).sum(axis=1)).tobytes())
    q_ids = np.array([0, 50, 499, 1000])
    queries = matrix[[0, 50, 499, 7]]
    got = [(int(q_ids[i]), v, s) for i, v, s in topk.search_block(queries, q_ids, block)]
    for i, q in zip(q_ids.tolist(), queries, strict=True):
        scored = sorted((-int(matrix[j] @ q), j) for j in range(500) if j != i)[:5]
        assert [(v, s) for a, v, s in got if a == i] == [(j, -s) for s, j in scored]
