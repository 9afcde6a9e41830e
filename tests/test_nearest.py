"""Nearest neighbours where points crowd: against brute force, and rows met in proportion to points."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import graph as G


def crowd(n, seed):
    """90 % of the points in 1 % of the area, ten of a hundred of these in a ten-thousandth of it, and one far away."""
    r = np.random.default_rng(seed)
    at = r.random((n, 2)) * 1000
    at[: n * 9 // 10] = 300 + r.random((n * 9 // 10, 2)) * 100
    at[: n // 10] = 350 + r.random((n // 10, 2)) * 10
    at[-1] = 1e5, -1e5
    return at


def brute(at, ids, k):
    out = {}
    for a in range(0, len(at), 500):
        d = ((at[a : a + 500, None] - at[None]) ** 2).sum(2)
        for i, row in enumerate(d):
            row[a + i] = np.inf
            near = np.argpartition(row, min(k + 3, len(row) - 1))[: k + 4]
            near = np.flatnonzero(row <= np.sort(row[near])[min(k, len(near)) - 1])
            out[ids[a + i]] = sorted((row[j], ids[j]) for j in near if j != a + i)[:k]
    return out


def table(spark, at, graph=0):
    return spark.createDataFrame([(graph, k, *map(float, p)) for k, p in enumerate(at)], "graph_id long, node_id long, x double, y double")


def test_nearest_of_a_crowd_equal_brute_force(spark):
    at = crowd(6000, 1)
    want = brute(at, list(range(len(at))), 5)
    got = {}
    for r in G.nearest(table(spark, at), 5).orderBy("node_id", "rank").collect():
        got.setdefault(r.node_id, []).append((r.dist, r.other))
    assert len(got) == len(at)
    for n, rows in got.items():
        assert [o for _, o in rows] == [o for _, o in want[n]] and np.allclose([d * d for d, _ in rows], [d for d, _ in want[n]])


def test_nearest_of_hard_points(spark):
    rows = [(0, k, 1.0, 2.0) for k in range(40)] + [(0, 40 + k, float(k % 3), 5.0) for k in range(9)] + [(0, 99, None, 1.0), (0, 98, float("nan"), 1.0)]
    rows += [(1, 7, 3.0, 3.0)] + [(2, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (2, 3, 1e-12, 0.0)] + [(None, 5, 0.0, 0.0)]
    got = {}
    for r in G.nearest(spark.createDataFrame(rows, "graph_id long, node_id long, x double, y double"), 3).orderBy("rank").collect():
        got.setdefault((r.graph_id, r.node_id), []).append(r.other)
    assert {g for g, _ in got} == {0, 2}
    assert got[0, 0] == [1, 2, 3] and got[0, 2] == [0, 1, 3] and got[0, 30] == [0, 1, 2]
    assert got[0, 40] == [43, 46, 41] and got[2, 1] == [2, 3] and got[2, 3] == [1, 2] and len(got) == 52


def test_rows_met_grow_with_the_points(spark):
    met = {}
    for n in (5000, 20_000):
        placed = G._placed(table(spark, crowd(n, 2)))
        spots = placed.select("graph_id", "x", "y", "ix", "iy", "span").distinct()
        others = placed.select("graph_id", F.col("node_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "ix", "iy")
        met[n] = G._met(G.cell_levels(spots, 5), others).count()
    assert met[20_000] < 5.5 * met[5000] and met[20_000] < 60 * 20_000
