"""Joins of tables that are far larger than their files say: none of their sides is sent through the driver."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import explain, gnn
from tessera.operators import graph as G
from tessera.operators import nuclei as N
from tessera.operators import raster as P
from tessera.sources import images
from tests.conftest import SMALL, rows, same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def points(spark):
    return spark.range(40).select((F.col("id") % 2).alias("graph_id"), F.col("id").alias("node_id"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") * 5 % 13).cast("double").alias("y"))


def test_graph_steps_shuffle(spark, points):
    edges = points.select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    spots = G._placed(points)
    met = G._met(spots.withColumn("level", F.lit(2)), spots.select("graph_id", F.col("node_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "ix", "iy"))
    for df in (spots, met, G.hops(edges, 3), G.thresholded(edges, 0.5)[0], G.knn_graph_bucketed(points, 3, 2.0)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_pixel_steps_shuffle(spark):
    px = spark.range(64).select(F.lit(0).alias("image_id"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") * 37 % 256).cast("int").alias("v"))
    assert "Join" not in plan(P.resample(px, 8, 8, 20, 5))
    # What is broadcast is a side's weights, never pixels.
    assert all("parquet" not in part and "Range (0, 64" not in part for part in plan(P.bilinear(px, 8, 8, 12, 5)).split("BroadcastExchange")[1:])


@pytest.fixture
def gap(spark):
    """An image of 6 x 7 pixels without those of y >= 4 and x >= 3."""
    at = [(0, y, x, (y * 7 + x) * 37 % 256) for y in range(6) for x in range(7) if y < 4 or x < 3]
    return spark.createDataFrame(at, "image_id long, y int, x int, v int"), {(y, x): v for _, y, x, v in at}


def test_resample_of_an_image_with_gaps(gap):
    px, at = gap
    for h, w in ((13, 9), (4, 3), (6, 7)):
        got = {(r.y, r.x): r.v for r in P.resample(px, 6, 7, h, w).collect()}
        assert got == {(y, x): at[y * 6 // h, x * 7 // w] for y in range(h) for x in range(w) if (y * 6 // h, x * 7 // w) in at}


def test_filters_of_an_image_with_gaps(gap):
    px, at = gap
    zero = lambda y, x: at.get((y, x), 0)
    got = {(r.y, r.x): (r.gx, r.gy) for r in P.sobel(px, 6, 7).collect()}
    side = lambda f: sum(k * f(d) for d, k in ((-1, 1), (0, 2), (1, 1)))
    want = {(y, x): (side(lambda d: zero(y + d, x + 1) - zero(y + d, x - 1)), side(lambda d: zero(y + 1, x + d) - zero(y - 1, x + d))) for y in range(1, 5) for x in range(1, 6)}
    assert {k: v for k, v in want.items() if v != (0, 0)} == {k: v for k, v in got.items() if v != (0, 0)} and set(got) <= set(want)
    assert {(r.y, r.x) for r in P.gaussian_blur(px, 1.0, 6, 7).collect()} == set(at)
    mask = {k for k, v in at.items() if v >= 60}
    kept = P.erode(px.filter("v >= 60").select(*P.AT), 3, 6, 7, px)
    assert {(r.y, r.x) for r in kept.collect()} == {(y, x) for y, x in at if all((y + b, x + a) in mask for b in (-1, 0, 1) for a in (-1, 0, 1) if (y + b, x + a) in at)}


def test_taps_of_an_image_with_gaps(gap):
    px, at = gap
    w = [1.0, 2.0, 4.0]
    mirror = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
    of = lambda y, x: sum(w[b] * w[a] * at.get((mirror(y + b - 1, 6), mirror(x + a - 1, 7)), 0) for b in range(3) for a in range(3))
    # Down first: a column's gaps are its own when they are not asked for.
    whole = {(r.y, r.x): r.v for r in N.separable(px, w, w, 6, 7, gaps=True).collect()}
    assert all(v == of(y, x) for (y, x), v in whole.items())
    assert {(r.y, r.x) for r in N.separable(px, w, w, 6, 7).collect()} == set(at) and set(at) < set(whole)


def test_patch_means_of_an_image_with_gaps(spark, oracle, tmp_path):
    """Pixels meet the patches in a shuffle, and the last image ends after 56 of its 100 tiles."""
    spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id < 256").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["patch_mean_embedding"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(got)
    made = [f for f in tmp_path.glob("embeddings.parquet/*.parquet")]
    same(rows(got), oracle(catalog.ORACLES["patch_mean_embedding"], str(tmp_path), embeddings=duckdb.read_parquet(list(map(str, made))).arrow()))


def test_files_of_an_image_with_gaps(spark, gap, tmp_path):
    px, at = gap
    for k, names in enumerate((("v",), ("v", "v2", "v3"))):
        folder = f"{tmp_path}/{k}"
        images.write_png(px.withColumns({"v2": F.lit(5), "v3": F.lit(0)}), folder, names, gaps=True).count()
        assert {(r.y, r.x): r.r for r in images.scan(spark, folder, clear=False).collect()} == at
        assert images.scan(spark, folder).count() == 42


def test_gradients_write_no_inputs(spark):
    """The features of the nodes are in none of the tables that a reverse pass reads again."""
    nodes = spark.range(4).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("h"))
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 3)], "graph_id long, src long, dst long")
    weights = gnn.Weights.load(gnn.synthetic(spark, {"a": (2, 3), "b": (3, 3), "c": (3, 3), "d": (3, 3), "top": (6, 2)}))
    stack = gnn.Stack((gnn.Gin(2, ("a", "b"), 3), gnn.Gin(3, ("c", "d"), 3)))
    first, second = explain._forward(nodes, edges, stack, weights, inputs=False)[0]
    assert first.columns == ["graph_id", "node_id", "h"] and second.columns == ["graph_id", "node_id", "z", "h"]
    assert explain.grad_cam(nodes, edges, stack, ["top"], weights).count() == 4


def test_masked_graphs_send_messages_as_narrow_as_their_layers():
    seen = []

    class Matrix(np.ndarray):
        def __matmul__(self, x):
            seen.append(x.shape[1])
            return np.asarray(self) @ x

    layers = [((np.ones((3, 50)), np.zeros(3)), (np.ones((3, 3)), np.zeros(3)))] * 1
    graph = explain.MaskedGraph(np.ones((4, 50)), np.eye(4).view(Matrix), layers, [(np.ones((2, 3)), np.zeros(2))], True, np.array([0.4, 0.6]), explain.Pruning())
    graph.loss(np.ones(4))
    assert seen and max(seen) == 3
