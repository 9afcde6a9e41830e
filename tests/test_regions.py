"""Region outlines and the feature vector against brute force on small rasters."""

import itertools
import math
import time

import numpy as np
import pytest

from tessera.operators import graph as G
from tessera.operators import regions as R

RASTERS = {
    1: ["####", "####", "####", "####"],
    2: ["#"],
    3: ["####"],
    4: ["#####", "#...#", "#.#.#", "#...#", "#####"],
    5: [".#.", "#.#", ".#."],
    6: ["##....", "##....", "......", "...###"],
    7: ["#....", ".#...", "..##.", "..#.#", "#.###"],
}


def pixels(raster):
    return [(y, x) for y, row in enumerate(raster) for x, c in enumerate(row) if c == "#"]


def flood(cells, start, near):
    seen, todo = {start}, [start]
    while todo:
        y, x = todo.pop()
        for dy, dx in near:
            if (to := (y + dy, x + dx)) in cells and to not in seen:
                seen.add(to)
                todo.append(to)
    return seen


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def brute_outline(own):
    cells = set(own)
    pieces, left = [], set(own)
    while left:
        piece = flood(cells, min(left), EIGHT)
        pieces.append(piece)
        left -= piece
    last = max(pieces, key=min)

    def corners(points):
        """Ordered pairs of points with all others on one side: the hull's sides."""
        out = []
        for a, b in itertools.permutations(set(points), 2):
            side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
            if all(s <= 0 for s in side) and all(math.dist(a, p) <= math.dist(a, b) and math.dist(b, p) <= math.dist(a, b) for s, p in zip(side, points) if s == 0):
                out.append((a, b))
        return out

    perimeter = sum(math.dist(a, b) for a, b in corners(list(last)))
    middles = [(y + d, x + e) for y, x in own for d, e in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    sides = corners(middles)
    ys, xs = [y for y, _ in own], [x for _, x in own]
    box = [(y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1)]
    convex = sum(all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) <= 1e-9 for a, b in sides) for p in box)
    frame = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)} - cells
    return perimeter, convex, len(box) and len(frame | cells) - len(flood(frame, (min(ys) - 1, min(xs) - 1), EIGHT))


def test_outlines_equal_brute_force(spark):
    rasters = dict(RASTERS)
    r = np.random.default_rng(7)
    for k in range(8, 20):
        rasters[k] = ["".join(".#"[int(v)] for v in row) for row in r.random((6, 7)) < 0.55]
    rows = [(0, y, x, k) for k, raster in rasters.items() for y, x in pixels(raster)]
    got = {r.label: r for r in R.convex_hulls(spark.createDataFrame(rows, "image_id long, y int, x int, label int")).collect()}
    for k, raster in rasters.items():
        perimeter, convex, filled = brute_outline(pixels(raster))
        assert (got[k].hull_perimeter, got[k].convex_area, got[k].filled_area) == (pytest.approx(perimeter), convex, filled), k
    assert (got[1].hull_perimeter, got[2].hull_perimeter, got[3].hull_perimeter) == (12.0, 0.0, 6.0)
    assert got[4].filled_area == 25 and got[5].filled_area == 4


def test_feature_vector(spark):
    rows = [(0, y + 8 * k, x, k, (y * 40 + x * 7) % 256) for k, raster in RASTERS.items() for y, x in pixels(raster)]
    out = R.handcrafted(spark.createDataFrame(rows, "image_id long, y int, x int, label int, v int"))
    assert out.columns == ["image_id", "label", *R.FEATURES] and len(R.FEATURES) == 24
    got = {r.label: r for r in out.collect()}
    assert len(got) == 7
    square = got[1]
    assert (square.area, square.convex_area, square.euler_number, square.extent, square.filled_area, square.perimeter, square.solidity) == (16, 16, 1, 1.0, 16, 12.0, 1.0)
    assert square.roughness == pytest.approx(1) and square.shape_factor == pytest.approx(4 * math.pi * 16 / 144) and square.eccentricity == 0
    assert got[3].orientation == pytest.approx(math.pi / 2, abs=1e-9) or got[3].orientation == pytest.approx(-math.pi / 2, abs=1e-9)
    assert got[2].shape_factor is None and got[2].roughness is None
    centers = {k: np.mean(pixels(raster), 0) + (8 * k, 0) for k, raster in RASTERS.items()}
    for k, c in centers.items():
        d = sorted(math.dist(c, o) for o in centers.values())[:6]
        assert got[k].mean_crowdedness == pytest.approx(np.mean(d)) and got[k].std_crowdedness == pytest.approx(np.std(d))


def test_figures_of_a_region_are_made_once(spark):
    px = spark.createDataFrame([(0, y, x, 1, 9) for y, x in pixels(RASTERS[4])], "image_id long, y int, x int, label int, v int")
    text = R.handcrafted(px)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "InPandas" not in text
    # A comb of many pieces and a row of many runs: time grows with the runs.
    began = time.perf_counter()
    comb = [(2 * k, 0, 0) for k in range(8000)]
    wide = [(y, 2 * k, 2 * k) for y in range(2) for k in range(8000)]
    assert R._outline(comb) == (0.0, 15999, 8000) and R._outline(wide)[1:] == (31998, 16000)
    assert time.perf_counter() - began < 2


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(2)
    at = {0: r.random((200, 2)) * 100, 1: np.vstack([r.random((60, 2)), [[900.0, 900.0], [5000.0, 1.0]]]), 2: np.zeros((7, 2)), 3: np.array([[1.0, 2.0]]), 4: np.array([[0.0, 0.0], [3.0, 4.0]]), 5: np.array([[k % 9, k // 9] for k in range(81)], float)}
    points = spark.createDataFrame([(g, k, float(x), float(y)) for g, p in at.items() for k, (x, y) in enumerate(p)], "graph_id int, node_id int, x double, y double")
    got = {}
    for row in G.nearest(points, 5).collect():
        got.setdefault((row.graph_id, row.node_id), []).append((row["rank"], row.dist, row.other))
    for g, p in at.items():
        for k, a in enumerate(p):
            want = sorted((float(((a - b) ** 2).sum()), o) for o, b in enumerate(p) if o != k)[:5]
            mine = sorted(got.get((g, k), []))
            assert [m[2] for m in mine] == [w[1] for w in want] and [m[1] for m in mine] == pytest.approx([w[0] ** 0.5 for w in want])
    edges = {(e.graph_id, e.src, e.dst) for e in G.knn_graph(points, 5).collect()}
    assert edges == {(g, k, o) for (g, k), m in got.items() for _, d, o in m if d > 0}
    near = {(e.graph_id, e.src, e.dst) for e in G.knn_graph(points, 5, 2.0).collect()}
    assert near == {(g, k, o) for (g, k), m in got.items() for _, d, o in m if 0 < d <= 2.0}


def test_diameter_of_a_path_and_a_ring(spark):
    path = [(0, a, b) for k in range(6) for a, b in ((k, k + 1), (k + 1, k))]
    ring = [(1, k, (k + 1) % 7) for k in range(7)]
    edges = spark.createDataFrame(path + ring, "graph_id int, src int, dst int")
    assert {r.graph_id: r.diameter for r in G.diameter(edges).collect()} == {0: 6, 1: 6}
