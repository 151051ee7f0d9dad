from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import topk
from quillmill.llm.queries import op10_topk

SMALL = "/root/testdata/sf0.01"


def plain(rows, asks, k):
    """(query_id, rank, id, score) over (id, vector) rows."""
    out = []
    for i, (q, v) in enumerate(rows):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), -1 if x is None else x, j) for j, (x, w) in enumerate(rows) if j != i)
            out += [(q, n + 1, rows[j][0], -s) for n, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_query(spark):
    rows = [(r.vec_id, [int(np.floor(1024 * float(x))) for x in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op10_topk(spark, SMALL).collect()), key=str)
    assert got == plain(rows, lambda i: i % 100 == 0, 10)


@pytest.mark.parametrize(("pivots", "block"), [(1, 4096), (7, 5), (30, 3)])
def test_blocks_and_bounds_lose_nothing(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    rng = np.random.default_rng(pivots)
    centres = rng.normal(0, 500, (6, 8))
    data = [(i, (centres[i % 6] + rng.normal(0, 20, 8)).astype(int).tolist()) for i in range(300)]
    data += [(1000 + i, [3] * 8) for i in range(150)] + [(7, [5] * 8), (7, [5] * 8)]
    df = spark.createDataFrame(data, "vec_id long, v array<bigint>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, pivots=pivots).collect()), key=str)
    assert got == plain(data, lambda i: i % 10 == 0, 4)


def test_groups_of_queries_need_few_shells_at_any_size(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4000, (6, 8))
    data = [(i, [int(x) for x in centres[i % 6] + rng.normal(0, 20, 8)], i % 10 == 0, i) for i in range(600)]
    cells = topk.Cells(spark.createDataFrame(data, "id long, v array<bigint>, asks boolean, row long").select("row", "id", "v", "asks"), 20)
    needed = cells.needed(4).collect()
    asking = {r.cell for r in cells.summary if r.asking}
    assert len(asking) > 1 and {r.for_cell for r in needed} == asking
    assert len(needed) < 0.5 * len(asking) * len(cells.summary)
    assert [x[1] for x in cells.blocks(4096)] == [0] * len({r.cell for r in cells.summary})
    whole = {b for *_, b, _ in cells.buckets(20_000)}
    assert whole == {0}
    buckets = {(c, s): b for c, s, _, b, _ in cells.buckets(50)}
    tiles = {(r.for_cell, buckets[r.cell, r.shell]) for r in needed}
    assert len(tiles) < 0.6 * len(asking) * len(set(buckets.values()))  # queries don't go to all buckets
    assert max(n for *_, n in cells.buckets(3)) > 1
    parts = cells.blocks(3)
    assert len({b for _, b, _ in parts}) > 1 and max(n for _, _, n in parts) > 1


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (1, [nan, 1.0], 1), (2, [1.0, None], 1), (3, [inf, 0.0], 1), (None, [1.0, 1.0], 1), (4, [-0.5], 1), (5, [], 1), (0, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ready = df.select("vec_id", topk.quantized(F.col("embedding")).alias("v"), "score")
    got = sorted(map(tuple, topk.top_k(ready, F.col("vec_id") % 100 == 0).collect()), key=str)
    data = [(0, [1024, 2048]), (None, [1024, 1024]), (4, [-512]), (5, []), (0, [1024, 2048])]
    assert got == plain(data, lambda i: i == 0, 10)
    assert topk.top_k(ready.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    big = spark.createDataFrame([(0, [1 << 30, 1]), (1, [1 << 30, 3])], "vec_id long, v array<bigint>")
    assert topk.top_k(big, F.col("vec_id") == 0).collect()[0].score == (1 << 60) + 3
