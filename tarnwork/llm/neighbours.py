"""Nearest neighbours with vantage-point trees, one per shard.

1. At most ``pivots`` vectors, those of smallest hash, part the vectors into cells by the
   nearest pivot; a cell's vectors are dealt to shards of bounded size by a hash of all their
   row, so a vector that very many rows share is dealt evenly too.
2. Each shard's vantage-point tree is built once and stored as one row.
3. A query first searches a shard of its own cell; its k-th distance there bounds what it
   seeks.  Then it goes to those shards only whose cell that bound reaches: a cell is left out
   if the distance of the query to its pivot, with the least and largest distance of the
   cell's vectors from the pivot, or the nearer pivot, puts all of the cell beyond the bound.
4. In a tree a subtree is left out once the triangle inequality puts it beyond a query's k-th
   distance.  Leaves are compared as matrix products; what these cannot rule out is measured
   directly, in double precision.
5. The k nearest of all shards are the answer.

``factor`` relaxes both prunings: 1 is exact search, and with f > 1 a cell or subtree is left
out if its bound times f exceeds the k-th distance.  A shard's queries come in blocks; a block
and a shard are what a task holds.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, as queries or candidates; vectors meet only those of their own length; a row
never finds itself, but finds other rows of its id, equal ones too; every asked row is a
query, so an id asked for in n rows has n answers of its own, whose ranks repeat; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_table

LEAF = 256
SLACK = 1e-9
#: Numbers of a shard's, or a block's, vectors that a task holds at most, about (8 bytes each).
FLOATS = 1_500_000


class VantageTree:
    """Vantage-point tree over the rows of a matrix, its points in leaf order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.points = points
        #: (vantage point, nearest, farthest, middle distance) of inner nodes and (lo, hi) of leaves
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(points), leaf, np.random.default_rng(len(points)))
        self.points = points[self.order]
        self.squares = np.einsum("ij,ij->i", self.points, self.points)

    def _build(self, lo: int, hi: int, leaf: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        part = self.order[lo:hi]
        if hi - lo > leaf:
            vantage = self.points[part[rng.integers(len(part))]]
            far = np.sqrt(((self.points[part] - vantage) ** 2).sum(axis=1))
            ranks = np.argsort(far, kind="stable")
            half = len(part) // 2
            self.order[lo:hi] = part[ranks]
            inside, outside = far[ranks[:half]], far[ranks[half:]]
            bounds = (inside[0], inside[-1], outside[0], outside[-1])
            near = self._build(lo, lo + half, leaf, rng)
            away = self._build(lo + half, hi, leaf, rng)
            self.nodes[at] = (vantage, bounds, near, away)
        else:
            self.nodes[at] = (lo, hi)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float, names: np.ndarray | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest, nearest first; inf where there are fewer.  Points whose
        name (their id, if ``names`` is null) is the query's ``own`` are left out, and so are those beyond ``most``."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        told = np.full((n, k), np.iinfo(np.int64).max)
        squares = np.einsum("ij,ij->i", queries, queries)
        names = (ids if names is None else names)[self.order]
        ids = ids[self.order]
        most = np.full(n, np.inf) if most is None else most

        def leaf(lo: int, hi: int, rows: np.ndarray) -> None:
            scale = squares[rows][:, None] + self.squares[lo:hi]
            rough = scale - 2 * (queries[rows] @ self.points[lo:hi].T)
            limit = np.minimum(best[rows, -1], most[rows]) ** 2
            r, c = np.nonzero((rough <= limit[:, None] * (1 + SLACK) + SLACK * scale) & (own[rows][:, None] != names[lo:hi]))
            if not len(r):
                return
            # Only the k smallest of a row can count, ties and rounding aside.
            if len(r) > 4 * k * len(rows):
                rough[own[rows][:, None] == names[lo:hi]] = np.inf
                cut = np.partition(rough, min(k, hi - lo) - 1, axis=1)[:, min(k, hi - lo) - 1]
                r, c = np.nonzero((rough <= np.minimum(limit, cut)[:, None] * (1 + SLACK) + SLACK * scale) & np.isfinite(rough))
            exact = np.empty(len(r))
            for at in range(0, len(r), 20_000):
                part = slice(at, at + 20_000)
                exact[part] = np.sqrt(np.cumsum((queries[rows[r[part]]] - self.points[lo + c[part]]) ** 2, axis=1)[:, -1])  # summed in order
            for i in np.unique(r):
                mine = r == i if len(rows) == 1 else slice(*np.searchsorted(r, (i, i + 1)))
                row = rows[i]
                d, x = np.append(best[row], exact[mine]), np.append(told[row], ids[lo + c[mine]])
                order = np.lexsort((x, d))[:k]
                best[row], told[row] = d[order], x[order]

        def visit(at: int, rows: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                leaf(*node, rows)
                return
            vantage, (low_in, high_in, low_out, high_out), near, away = node
            far = np.sqrt(((queries[rows] - vantage) ** 2).sum(axis=1))
            to_in = np.maximum(np.maximum(low_in - far, far - high_in), 0)
            to_out = np.maximum(np.maximum(low_out - far, far - high_out), 0)
            first_in = to_in <= to_out
            for bound, child, chosen in ((to_in, near, first_in), (to_out, away, ~first_in), (to_in, near, ~first_in), (to_out, away, first_in)):
                keep = chosen & (bound * factor * (1 - SLACK) <= np.minimum(best[rows, -1], most[rows]) + SLACK)  # each query's nearer side first
                if keep.any():
                    visit(child, rows[keep])

        if len(ids):
            visit(self.root, np.arange(n))
        return best, told


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _of_length(pivots: dict[int, tuple[np.ndarray, np.ndarray]], frames: Iterator[pd.DataFrame], told):
    """Each frame's rows by the length of their vectors, with the pivots (their cells and vectors) of that length."""
    for frame in frames:
        for dim, rows in frame.groupby("dim"):
            cells, points = pivots.get(dim, (np.empty(0, dtype=np.int64), None))
            yield told(rows, np.stack(rows["vector"].to_list()).astype(np.float64), cells, points)


def _assign(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    def told(rows: pd.DataFrame, vectors: np.ndarray, cells: np.ndarray, points: np.ndarray | None) -> pd.DataFrame:
        if not len(cells):
            return rows.assign(cell=-1, far=0.0)
        far = _distances(vectors, points)
        near = far.argmin(axis=1)
        return rows.assign(cell=cells[near], far=far[np.arange(len(far)), near])

    return lambda frames: _of_length(pivots, frames, told)


def _routes(pivots: dict[int, tuple[np.ndarray, np.ndarray]], ranges: dict[tuple[int, int], tuple[float, float]], factor: float):
    """The cells that each query's bound reaches."""

    def told(rows: pd.DataFrame, vectors: np.ndarray, cells: np.ndarray, points: np.ndarray | None) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        if not len(cells):
            return rows.assign(goes=-1)
        far = _distances(vectors, points)
        low, high = (np.array([ranges[rows["dim"][0], c][i] if (rows["dim"][0], c) in ranges else math.inf for c in cells]) for i in (0, 1))
        least = np.maximum(np.maximum(low - far, far - high), (far - far.min(axis=1, keepdims=True)) / 2)
        least = np.where(np.isfinite(low), np.maximum(least, 0), math.inf)
        scale = SLACK * (1 + far)
        i, j = np.nonzero(least * factor - scale <= rows["most"].to_numpy()[:, None])
        return rows.iloc[i].assign(goes=cells[j])

    return lambda frames: _of_length(pivots, frames, told)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    tree = VantageTree(np.stack(rows["vector"].to_list()).astype(np.float64))
    raw = pickle.dumps((tree, rows["vec_id"].to_numpy(), rows["name"].to_numpy()), protocol=5)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "cell": rows["cell"].iloc[:1], "salt": rows["salt"].iloc[:1], "tree": [raw]})


_FOUND = {"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"}


def _search(k: int, factor: float, block: int = 2048):
    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in _FOUND.items()})]
        if len(shard) and len(asked):
            tree, ids, names = pickle.loads(shard["tree"].iloc[0])
            for at in range(0, len(asked), block):
                part = asked.iloc[at : at + block]
                own = part["name"].to_numpy()
                found, told = tree.search(np.stack(part["vector"].to_list()).astype(np.float64), own, ids, k, factor, names, part["most"].to_numpy())
                r, c = np.nonzero(np.isfinite(found))
                out.append(pd.DataFrame({"query": own[r], "query_id": part["vec_id"].to_numpy()[r], "vec_id": told[r, c], "score": found[r, c]}))
        return pd.concat(out) if len(out) > 1 else out[0]

    return run


def _ask(trees: DataFrame, queries: DataFrame, k: int, factor: float, block_rows: int) -> DataFrame:
    """Queries, each with its shard, in blocks against the shard's tree."""
    shard = ["dim", "cell", "salt"]
    held = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.floor(F.lit(FLOATS) / F.col("dim"))))
    blocks = shared_table(queries.groupBy(*shard).agg(F.count("*").alias("asked")).withColumn("blocks", F.ceil(F.col("asked") / held).cast("long")).drop("asked"), "blocks")
    dealt = queries.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("name", F.lit(5)), F.col("blocks"))).drop("blocks")
    spread = trees.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    task = [*shard, "block"]
    found = spread.groupBy(*task).cogroup(dealt.groupBy(*task)).applyInPandas(_search(k, factor), "query long, query_id long, vec_id long, score double")
    return shared_table(found, "found")


def nearest(vectors: DataFrame, asked: Column, k: int = 10, factor: float = 1.0, shard_rows: int = 10_000, block_rows: int = 20_000, pivots: int = 256) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)`` for the rows of ``vectors(vec_id, embedding)`` where ``asked``
    holds, against all rows.  A task holds about ``shard_rows`` vectors and ``block_rows`` queries, and fewer if
    they are long; the driver holds ``pivots`` vectors."""
    full = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).cast("long").alias("asked"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    full = full.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound)
    # Equal rows are one with a number of copies, of which k + 1 at most can count.
    rows = full.groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k + 1)).alias("copies"), F.sum("asked").alias("asked"))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("name", F.xxhash64("vec_id", "vector", F.lit(1)))
    rows = shared_table(rows, "vectors")
    number = min(pivots, max(1, math.ceil(rows.count() / shard_rows)))
    chosen: dict[int, list[tuple[int, list[float]]]] = {}
    for cell, r in enumerate(rows.select("dim", "vector", F.xxhash64("name", F.lit(6)).alias("key")).orderBy("key", "vector").limit(number).collect()):
        chosen.setdefault(r.dim, []).append((cell, r.vector))
    heads = {dim: (np.array([c for c, _ in some]), np.array([v for _, v in some], dtype=np.float64)) for dim, some in chosen.items()}
    schema = "vec_id long, vector array<double>, copies long, asked long, dim int, name long"
    placed = shared_table(rows.mapInPandas(_assign(heads), f"{schema}, cell long, far double"), "placed")
    held = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(FLOATS) / F.col("dim"))))
    cells = placed.groupBy("dim", "cell").agg(F.sum("copies").alias("rows"), F.min("far").alias("low"), F.max("far").alias("high"))
    cells = shared_table(cells.withColumn("salts", F.ceil(F.col("rows") / held).cast("long")), "cells")
    ranges = {(r.dim, r.cell): (r.low, r.high) for r in cells.where("cell >= 0").collect()}

    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    dealt = placed.join(cells.select("dim", "cell", "salts"), ["dim", "cell"]).withColumn("copy", copy)
    # The first copy bears the name of the query that is its row; the others are candidates of every query.
    name = F.when(F.col("copy") == 1, F.col("name")).otherwise(F.xxhash64("vec_id", "vector", "copy"))
    dealt = dealt.select("dim", "cell", F.pmod(F.xxhash64("name", "copy"), F.col("salts")).alias("salt"), "vec_id", "vector", name.alias("name"))
    trees = shared_table(dealt.groupBy("dim", "cell", "salt").applyInPandas(_build, "dim int, cell long, salt long, tree binary"), "trees")

    salts = cells.select("dim", "cell", "salts")
    queries = placed.where("asked > 0").join(salts, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("name", F.lit(7)), F.col("salts")))
    queries = queries.select("dim", "cell", "salt", "name", "vec_id", "vector", F.lit(math.inf).alias("most"))
    first = _ask(trees, queries, k, factor, block_rows)
    bound = first.groupBy("query", "query_id").agg(F.max("score").alias("bound"), F.count("*").alias("n")).where(f"n >= {int(k)}")
    bound = bound.select(F.col("query").alias("name"), F.col("query_id").alias("vec_id"), "bound")
    queries = queries.join(bound, ["name", "vec_id"], "left").withColumn("most", F.coalesce("bound", F.lit(math.inf)))
    routed = queries.select("dim", "cell", "salt", "name", "vec_id", "vector", "most")
    routed = routed.mapInPandas(_routes(heads, ranges, factor), "dim int, cell long, salt long, name long, vec_id long, vector array<double>, most double, goes long")
    routed = routed.select("dim", F.col("cell").alias("home"), F.col("salt").alias("home_salt"), F.col("goes").alias("cell"), "name", "vec_id", "vector", "most")
    routed = routed.join(salts, ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    routed = routed.where("cell <> home or salt <> home_salt").select("dim", "cell", "salt", "name", "vec_id", "vector", "most")
    found = first.unionByName(_ask(trees, shared_table(routed, "routed"), k, factor, block_rows))

    order = Window.partitionBy("query", "query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    times = placed.where("asked > 1").select(F.col("name").alias("query"), F.col("vec_id").alias("query_id"), "asked")
    ranked = ranked.join(times, ["query", "query_id"], "left").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("asked", F.lit(1).cast("long")))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
