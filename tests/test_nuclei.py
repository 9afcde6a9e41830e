"""Nucleus instances on drawn maps, and the filters they are made of against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import nuclei as N
from tests.conftest import SMALL


def frame(spark, a, name="v"):
    return spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], f"image_id long, y int, x int, {name} double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_derivatives_equal_brute_force(spark):
    a = np.random.default_rng(1).random((14, 17))
    smooth, slope = N.derivative_kernels(5)
    assert (smooth, slope) == ([1, 4, 6, 4, 1], [-1, -2, 0, 2, 1])
    assert N.derivative_kernels(3) == ([1, 2, 1], [-1, 0, 1]) and len(N.derivative_kernels(21)[1]) == 21
    for got, down, along in zip(N.sobel(frame(spark, a), 14, 17, 5), (smooth, slope), (slope, smooth)):
        big = np.pad(a, 2, mode="reflect")
        want = sum(down[i] * along[j] * big[i : i + 14, j : j + 17] for i in range(5) for j in range(5))
        assert np.allclose(array(got, a.shape), want)


def test_opening_equals_brute_force(spark):
    m = np.random.default_rng(2).random((12, 15)) < 0.8
    offsets = [(y - 2, x) for y, half in enumerate(N.ELLIPSE) for x in range(-half, half + 1)]
    at = lambda a, y, x, beyond: a[y, x] if 0 <= y < 12 and 0 <= x < 15 else beyond
    eroded = np.array([[all(at(m, y + dy, x + dx, True) for dy, dx in offsets) for x in range(15)] for y in range(12)])
    want = {(y, x) for y in range(12) for x in range(15) if any(at(eroded, y + dy, x + dx, False) for dy, dx in offsets)}
    got = N.opening(spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(m)], "image_id long, y int, x int"), 12, 15)
    assert {(r.y, r.x) for r in got.collect()} == want


def test_touching_nuclei_are_told_apart(spark):
    h, w, centers = 28, 48, [(14, 14), (14, 33)]
    y, x = np.mgrid[:h, :w]
    p, dx, dy = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    for cy, cx in centers:
        inside = (y - cy) ** 2 + (x - cx) ** 2 <= 100
        p[inside], dx[inside], dy[inside] = 1, (x - cx)[inside] / 10, (y - cy)[inside] / 10
    p[1, 1] = 1
    rows = [(0, a, b, float(p[a, b]), float(dx[a, b]), float(dy[a, b])) for a in range(h) for b in range(w)]
    got = {(r.y, r.x): r.label for r in N.instances(spark.createDataFrame(rows, "image_id long, y int, x int, p double, h double, v double"), h, w).collect()}
    assert {got.get(c) for c in centers} == {1, 2} and (1, 1) not in got
    assert set(got) <= set(map(tuple, np.argwhere(p > 0).tolist())) and len(got) >= 0.9 * (p.sum() - 1)
    assert np.mean([(label == got[14, 14]) == (bx < 24) for (_, bx), label in got.items()]) > 0.97


def test_extraction_finds_every_disk(spark, tmp_path):
    """The query over two images of sixteen drawn disks each, the second one with other keys."""
    own = spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id < 100")
    own.unionByName(own.withColumn("vec_id", F.col("vec_id") + 700)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["nuclei_extraction"](spark, str(tmp_path)).collect()
    assert sorted((r.image_id, r.label) for r in got) == [(k, n) for k in (0, 7) for n in range(1, 17)]
    for k in (0, 7):
        places = sorted((round((r.cy - 10) / 20), round((r.cx - 10) / 20)) for r in got if r.image_id == k)
        assert places == [(a, b) for a in range(2) for b in range(8)]
    assert all(250 <= r.area <= 320 and abs(r.cy % 20 - 10) <= 2 and abs(r.cx % 20 - 10) <= 2 for r in got)
