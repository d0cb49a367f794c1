"""Repeated ids, equal rows and cells of many sizes, against brute force over rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import neighbours


def brute(rows, k):
    out = []
    for i, (a, v) in enumerate(rows):
        if a % 10 == 0:
            near = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)))), b) for j, (b, w) in enumerate(rows) if j != i and len(w) == len(v))
            out += [(a, r + 1, b, round(d, 9)) for r, (d, b) in enumerate(near[:k])]
    return sorted(out)


def test_rows_of_one_id_find_one_another(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect())
    assert [(q, r, v) for q, r, v, _ in found] == [(100, 1, 100), (100, 1, 100)] and all(abs(s - 2**0.5) < 1e-12 for *_, s in found)


@pytest.mark.parametrize(("shard", "block", "pivots"), [(10_000, 20_000, 256), (25, 3, 8), (7, 2, 40), (25, 3, 1)])
def test_rows_equal_brute_force(spark, shard, block, pivots):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(120, 3)) * 0.01 + 5]).round(2)
    rows = [(int(i) % 90, p.tolist()) for i, p in enumerate(points) if p.any()]
    rows += [(10, rows[3][1])] * 15 + [rows[40]] * 4 + [(7, [1.0, 2.0]), (20, [2.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, copies int")
    found = neighbours.nearest(frame, F.col("vec_id") % 10 == 0, 6, shard_rows=shard, block_rows=block, pivots=pivots)
    assert sorted((q, r, v, round(s, 9)) for q, r, v, s in found.collect()) == brute(rows, 6)


def test_cells_beyond_the_bound_are_left_out(spark):
    """Clusters far apart: a query's routes are those of its cluster."""
    pivots = {2: (np.arange(4), np.array([[0.0, 0], [100, 0], [0, 100], [100, 100]]))}
    ranges = {(2, c): (0.0, 1.0) for c in range(4)}
    import pandas as pd

    queries = pd.DataFrame({"dim": [2, 2], "cell": [0, 1], "salt": [0, 0], "name": [1, 2], "vec_id": [1, 2], "vector": [[0.5, 0.5], [99.0, 1.0]], "most": [2.0, float("inf")]})
    out = pd.concat(neighbours._routes(pivots, ranges, 1.0)(iter([queries])))
    assert out[out.name == 1].goes.tolist() == [0] and sorted(out[out.name == 2].goes) == [0, 1, 2, 3]
