"""Painting, the graph builder, metrics as a protocol, files by name and the lasso: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import builder as B
from tessera.operators import metrics as M
from tessera.operators import paint
from tessera.operators import stain as S

H, W = 24, 30


def inside(s, y, x):
    t = s.get("thickness", -1)
    if s["shape"] in ("circle", "ellipse"):
        rx, ry = s.get("rx", s.get("radius")), s.get("ry", s.get("radius"))
        within = lambda a, b: ((x - s["x"]) * b) ** 2 + ((y - s["y"]) * a) ** 2 <= (a * b) ** 2
        return within(rx, ry) and not (t >= 0 and rx > t and ry > t and within(rx - t, ry - t))
    if s["shape"] == "line":
        a, b, p = np.array([s["x1"], s["y1"]]), np.array([s["x2"], s["y2"]]), np.array([x, y], float)
        d = b - a
        u = 0.0 if not d.any() else min(1.0, max(0.0, float((p - a) @ d / (d @ d))))
        return ((p - a - u * d) ** 2).sum() <= (t / 2) ** 2 + 1e-12
    ps, out = s["points"], False
    for (ax, ay), (bx, by) in zip(ps, ps[1:] + ps[:1]):
        if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            out = not out
    return out


def test_painting_equals_a_plain_painter(spark):
    c = lambda r, g, b: {"red": r, "green": g, "blue": b}
    shapes = [
        {"shape": "circle", "x": 7.25, "y": 6.5, "radius": 5.0, "thickness": -1, "z_order": 2} | c(1, 2, 3), {"shape": "circle", "x": 20.0, "y": 12.0, "radius": 9.0, "thickness": 2, "z_order": 1} | c(9, 9, 9),
        {"shape": "ellipse", "x": 12.5, "y": 15.0, "rx": 11.0, "ry": 3.5, "thickness": 1, "z_order": 3} | c(50, 0, 0), {"shape": "line", "x1": 2.0, "y1": 20.5, "x2": 27.0, "y2": 3.25, "thickness": 3, "z_order": 0} | c(0, 50, 0),
        {"shape": "line", "x1": -9.0, "y1": 22.0, "x2": 50.0, "y2": 22.0, "thickness": 2, "z_order": 5} | c(0, 0, 50), {"shape": "line", "x1": 25.3, "y1": 5.0, "x2": 25.3, "y2": 5.0, "thickness": 4, "z_order": 6} | c(7, 7, 7),
        {"shape": "polygon", "points": [(1.0, 1.0), (12.0, 9.3), (3.0, 18.0), (8.0, 2.0)], "z_order": 2} | c(4, 4, 4), {"shape": "circle", "x": 200.0, "y": 2.0, "radius": 3.0, "z_order": 9} | c(8, 8, 8), {"shape": "circle", "x": None, "y": 2.0, "radius": 3.0, "z_order": 9} | c(8, 8, 8),
    ]
    schema = "graph_id long, shape string, z_order int, x double, y double, radius double, rx double, ry double, x1 double, y1 double, x2 double, y2 double, thickness int, points array<struct<x:double,y:double>>, red int, green int, blue int"
    names = [f.split()[0] for f in schema.split(", ")][1:]
    df = spark.createDataFrame([(g, *(s.get(n) for n in names)) for g in (0, 1) for s in (shapes if g == 0 else shapes[:2])], schema)
    px = spark.createDataFrame([(g, y, x, 200, 201, 202) for g in (0, 1, 2) for y in range(H) for x in range(W)], "image_id long, y int, x int, r int, g int, b int")
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in paint.painted(px, df, H, W).collect()}
    assert len(got) == 3 * H * W
    for (g, y, x), color in got.items():
        own = [] if g == 2 else shapes if g == 0 else shapes[:2]
        over = max(((s["z_order"], (s["red"], s["green"], s["blue"])) for s in own if s.get("x", 0) is not None and inside(s, y, x)), default=(0, (200, 201, 202)))
        assert color == over[1], (g, y, x)
    least = df.filter("shape = 'circle'").select("graph_id", "shape", "x", "y", "radius", "red", "green", "blue")
    assert paint.covered(least, H, W).count() > 0 and paint.covered(least.limit(0), H, W).count() == 0


def regions(spark):
    picture = ["1120", "1123", "0033"]
    lab = [(g, y, x, int(c)) for g in (0, 1) for y, line in enumerate(picture) for x, c in enumerate(line)]
    return spark.createDataFrame(lab, "image_id long, y int, x int, label int")


def test_graphs_are_built_from_separate_tables(spark):
    lab = regions(spark)
    feats = [(g, k, [float(g), float(k)]) for g in (0, 1) for k in (3, 1, 2)]
    features = spark.createDataFrame(feats, "image_id long, label int, feat array<double>")
    cls = spark.createDataFrame([(g, y, x, (y + x + g) % 3) for g in (0, 1) for y in range(3) for x in range(4)], "image_id long, y int, x int, cls int")
    nodes, edges = B.build(lab, features, cls, background=0, classes=3, location=True)
    got = {(r.graph_id, r.node_id): r for r in nodes.collect()}
    assert sorted(got) == [(g, k) for g in (0, 1) for k in range(3)]
    assert got[0, 0].feat == [0.0, 1.0, 0.0, 0.0] and (got[0, 2].label, got[0, 2].x, got[0, 2].y) == (3, 3.0, 2.0) and got[0, 2].feat == [0.0, 3.0, 0.75, 2 / 3]
    assert got[0, 0].cls == 1
    assert {(r.src, r.dst) for r in edges.filter("graph_id = 1").collect()} == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)}
    own = spark.createDataFrame([(g, k, k) for g in (0, 1) for k in (1, 2, 3)], "image_id long, label int, cls int")
    nodes, edges = B.build(lab, features, own, topology="knn", k=1)
    assert {r.cls for r in nodes.collect()} == {1, 2, 3} and edges.count() == 6
    for wrong in (features.filter("label < 3"), features.unionByName(features), features.unionByName(spark.createDataFrame([(0, 9, [0.0])], features.schema))):
        with pytest.raises(ValueError):
            B.build(lab, wrong)
    with pytest.raises(ValueError):
        B.build(lab, features, cls, classes=2)
    with pytest.raises(ValueError):
        B.build(lab, features, own.filter("label > 1"))
    with pytest.raises(ValueError):
        B.build(lab, features, topology="delaunay")


def test_last_ones_and_files_of_one_name(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), (None, 1)], "g string, k int")
    assert {(r.g, r.k) for r in B.last_flagged(df, ["g"], ["k"]).filter("is_last").collect()} == {("a", 2), ("b", 5), (None, 1)}
    graphs = spark.createDataFrame([("x/283_dcis_4.bin",), ("y.tar.bin",), ("z",), (".hidden",)], "graph_path string")
    images = spark.createDataFrame([("i/283_dcis_4.png",), ("j/283_dcis_4.jpg",), ("y.tar.png",), ("other.png",)], "image_path string")
    got = {r.graph_path: (r.name, r.image_path) for r in B.by_name(graphs, images).collect()}
    assert got == {"x/283_dcis_4.bin": ("283_dcis_4", "i/283_dcis_4.png"), "y.tar.bin": ("y.tar", "y.tar.png"), "z": ("z", None), ".hidden": (".hidden", None)}


def test_metrics_know_what_is_better(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (2, 2)], "pred int, truth int")
    table = M.confusion(pairs, 3)
    for name, m in M.METRICS.items():
        out = m.scores(table)
        assert out.count() == {"confusion": 9}.get(name, 3 if m.per_class else 1)
    runs = spark.createDataFrame([("m", k, v) for k, v in enumerate([0.5, 0.4, 0.5, None, float("nan"), 0.6])], "run string, step int, v double")
    assert [r.is_better for r in M.best(runs, ["run"], "step", "v").orderBy("step").collect()] == [True, False, True, False, False, True]


def test_lasso_equals_brute_force(spark):
    r = np.random.default_rng(6)
    od = np.vstack([r.normal(size=(60, 3)), r.random((60, 3)) * 2, np.zeros((1, 3))])
    stains = np.abs(r.normal(size=(len(od), 2, 3)))
    stains[:20] /= np.linalg.norm(stains[:20], axis=2, keepdims=True)
    stains[20] = stains[20][0]
    df = spark.createDataFrame([(k, *map(float, o), *map(float, s.ravel())) for k, (o, s) in enumerate(zip(od, stains))], "k int, od_r double, od_g double, od_b double, " + ", ".join(f"s{i}{j} double" for i in range(2) for j in range(3)))
    for x in S.lasso(df, 0.1).collect():
        value = lambda c: 0.5 * ((od[x.k] - c @ stains[x.k]) ** 2).sum() + 0.1 * c.sum()  # noqa: B023, E731
        c = np.zeros(2)
        for _ in range(3000):
            for i in (0, 1):
                rest = od[x.k] - c[1 - i] * stains[x.k][1 - i]
                c[i] = max(0.0, (rest @ stains[x.k][i] - 0.1) / (stains[x.k][i] @ stains[x.k][i]))
        assert x.c1 >= 0 and x.c2 >= 0 and value(np.array([x.c1, x.c2])) <= value(c) + 1e-9
