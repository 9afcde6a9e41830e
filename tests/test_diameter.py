"""Diameters by bounds: against all shortest paths."""

import random

import pytest

from tessera.operators import graph as G


def farthest(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    most = 0
    for root in out:
        seen, front, d = {root}, {root}, 0
        while front:
            front = {b for a in front for b in out[a]} - seen
            seen |= front
            d += bool(front)
        most = max(most, d) if len(seen) == len(out) else float("inf")
    return most


def graphs():
    r = random.Random(3)
    path = [(k, k + 1) for k in range(14)]
    out = {0: path + [(b, a) for a, b in path], 1: [(k, (k + 1) % 11) for k in range(11)], 2: [(5, 5)], 3: [(0, k) for k in range(1, 40)] + [(k, 0) for k in range(1, 40)]}
    for g in range(4, 7):
        ring = [(k, (k + 1) % 30) for k in range(30)]
        out[g] = ring + [(r.randrange(30), r.randrange(30)) for _ in range(8 * (g - 4))]
    return out


@pytest.mark.parametrize("roots", [2, 32])
def test_diameters_equal_all_paths(spark, roots):
    every = graphs()
    df = spark.createDataFrame([(g, a, b) for g, es in every.items() for a, b in es * 2], "graph_id long, src long, dst long")
    assert {r.graph_id: r.diameter for r in G.diameter(df, roots=roots).collect()} == {g: farthest(es) for g, es in every.items()}


def test_graphs_in_pieces(spark):
    df = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 3), (2, 1, None)], "graph_id long, src long, dst long")
    assert {tuple(r) for r in G.diameter(df, strict=False).collect()} == {(0, 1), (1, None)}
    with pytest.raises(ValueError):
        G.diameter(df)
    assert G.diameter(df.limit(0)).count() == 0
