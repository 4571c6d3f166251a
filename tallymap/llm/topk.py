"""Exact top-k inner products from an impact-ordered index, score at a time.

Components are integers, floor(scale * x). Vectors are dealt to blocks by hash of their id. A block's index has one posting
for each component that isn't 0, (vector, dimension, value), in segments of equal quantised impact (the bits of the
absolute value), the highest impact first. For each vector and segment it also has the norm of the components that
are still to come behind it.

Queries are packed into blocks too. Each of these is sent to each block of the index, through an equi-join on the number
of the index block, so the index itself is shuffled once, to as many tasks as the session has for a shuffle. The segments are processed in order; one adds to all scores of the block pair at once. By the
inequality of Cauchy and Schwarz a score is then known up to

    norm of the query * norm of what is still to come of the vector.

A vector whose highest possible score is below the k-th best lowest possible one is proven not to be a member.
The remaining segments are left out only when every query's possible members are few, or all segments are done; the
possible members are then rescored from their whole vectors, in whole numbers, and the best of all blocks are taken.

A vector that is null, or holds null or non-finite components, takes no part, nor does a row without vec_id. Every other row is
a candidate of all queries but itself, also if its vec_id is repeated; a repeated query has its own result for each row. Shorter vectors count as filled up with 0. Ties go to the
smaller vec_id. An empty table gives no rows. Other columns are not read. Scores are exact as long as they are below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows, parts
from tallymap.session import write_stage

SCALE = 256
EVERY = 50
TOP = 5
BLOCK = 8_192
QUERIES = 1_024
#: Possible members of a query, times k, at which rescoring is cheaper than another segment.
FEW = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """rid (a number of the row's own), vec_id and its integer components."""
    usable = F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    values = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"))


def _matrix(values: pd.Series) -> np.ndarray:
    width = max((len(v) for v in values), default=0)
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


_INDEX = "block long, n int, width int, rids binary, ids binary, levels array<int>, vectors array<binary>, dims array<binary>, values array<binary>, rests array<binary>"


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block: its ids, and per segment the postings and the norms of what is still to come."""
    blocks = max(1, -(-rows.count() // block))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid")
        matrix = _matrix(group["v"])
        level = np.frexp(np.abs(matrix).astype(np.float64))[1]
        vector, dim = np.nonzero(matrix)
        of_posting = level[vector, dim]
        out = {"levels": [], "vectors": [], "dims": [], "values": [], "rests": []}
        left = matrix.astype(np.float64)
        for at in sorted(set(of_posting.tolist()), reverse=True):
            own = of_posting == at
            left[vector[own], dim[own]] = 0
            out["levels"].append(at)
            out["vectors"].append(vector[own].astype(np.uint16 if len(group) <= 65_536 else np.uint32).tobytes())
            out["dims"].append(dim[own].astype(np.uint16).tobytes())
            out["values"].append(matrix[vector[own], dim[own]].astype(np.int64).tobytes())
            # rounded up, so that the bound holds in floating point
            out["rests"].append((np.sqrt((left**2).sum(axis=1)) * (1 + 1e-9)).tobytes())
        head = {"block": [int(group["block"].iloc[0])], "n": [len(group)], "width": [matrix.shape[1]], "rids": [group["rid"].to_numpy(np.int64).tobytes()], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()]}
        return pd.DataFrame(head | {k: [v] for k, v in out.items()})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    return keyed.groupBy("block").applyInPandas(build, _INDEX)


def pack_queries(rows: DataFrame, size: int = QUERIES) -> DataFrame:
    """Blocks of queries: qblock, ids and components (row by row)."""
    blocks = max(1, -(-rows.count() // size))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(group["v"])
        rids, ids = (group[c].to_numpy(np.int64).tobytes() for c in ("rid", "vec_id"))
        return pd.DataFrame({"qblock": [int(group["qblock"].iloc[0])], "q_rids": [rids], "q_ids": [ids], "q_width": [matrix.shape[1]], "q": [matrix.tobytes()]})

    keyed = rows.withColumn("qblock", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)))
    return keyed.groupBy("qblock").applyInPandas(pack, "qblock long, q_rids binary, q_ids binary, q_width int, q binary")


def search_block(queries: np.ndarray, q_rids: np.ndarray, block: dict, top: int = TOP) -> list[tuple[int, int, int]]:
    """(place of the query, vec_id, score) of each query's best in a block of the index; ties to smaller vec_id."""
    n, rids, ids = block["n"], np.frombuffer(block["rids"], dtype=np.int64), np.frombuffer(block["ids"], dtype=np.int64)
    width = max(block["width"], queries.shape[1], 1)
    q = np.zeros((len(queries), width))
    q[:, : queries.shape[1]] = queries
    norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
    index_type = np.uint16 if n <= 65_536 else np.uint32
    own = np.searchsorted(rids, q_rids)
    own_row = np.flatnonzero((own < n) & (rids[np.minimum(own, n - 1)] == q_rids))
    scores = np.zeros((len(q), n))
    whole = np.zeros((n, width), dtype=np.int64)
    postings = [
        (np.frombuffer(v, index_type), np.frombuffer(d, np.uint16), np.frombuffer(x, np.int64), np.frombuffer(r, np.float64))
        for v, d, x, r in zip(block["vectors"], block["dims"], block["values"], block["rests"], strict=True)
    ]
    for vector, dim, value, _ in postings:
        whole[vector, dim] = value
    possible = np.ones((len(q), n), dtype=bool)
    for vector, dim, value, rest in postings:
        plane = np.zeros((n, width))
        plane[vector, dim] = value
        scores += q @ plane.T
        unknown = norm[:, None] * rest[None, :]
        lowest = scores - unknown
        lowest[own_row, own[own_row]] = -np.inf
        if n > top:
            bar = np.partition(lowest, n - top, axis=1)[:, n - top]
            possible = scores + unknown >= bar[:, None]
        if possible.sum() <= FEW * top * len(q):
            break
    possible[own_row, own[own_row]] = False
    found = []
    exact_q = queries.astype(np.int64)
    for i in range(len(q_rids)):
        member = np.flatnonzero(possible[i])
        exact = whole[member, : exact_q.shape[1]] @ exact_q[i]
        best = np.lexsort((ids[member], -exact))[:top]
        found += [(i, int(ids[member[b]]), int(exact[b])) for b in best]
    return found


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: each query's best among all other rows."""
    rows = write_stage(quantised(vectors, scale), "vectors")
    index = write_stage(build_index(rows), "impact-index")
    packed = write_stage(pack_queries(rows.where(F.pmod("vec_id", F.lit(every)) == 0)), "queries")
    blocks = index.agg(F.max("block")).first()[0]
    # the queries, the smaller side, go to every block of the index; the index is dealt once, to a number of tasks that doesn't grow
    spread = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks or 0).cast("long"))))
    tasks = parts(vectors.sparkSession)
    met = spread.repartition(tasks, "block").join(index.repartition(tasks, "block").hint("merge"), "block")

    def search(batch):
        for row in batch.to_pylist():
            q_rids, q_ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("q_rids", "q_ids"))
            queries = np.frombuffer(row["q"], dtype=np.int64).reshape(len(q_ids), row["q_width"])
            for i, vec_id, score in search_block(queries, q_rids, row, top):
                yield int(q_rids[i]), int(q_ids[i]), vec_id, score

    found = map_rows(met, search, "q_rid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
