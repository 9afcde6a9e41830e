"""Figures of labelled regions: sizes, boxes, histograms, texture, shape, crowdedness."""

from __future__ import annotations

from math import ceil, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import nearest
from tessera.plans.scratch import shuffled

KEY = ["image_id", "label"]


def region_props(label_map: DataFrame) -> DataFrame:
    """Area, half-open box and rounded centroid (half to even) of every label > 0."""
    return label_map.filter("label > 0").groupBy(*KEY).agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.bround(F.avg("x")).alias("cx"), F.bround(F.avg("y")).alias("cy"),
    )


def with_node_ids(props: DataFrame) -> DataFrame:
    return props.withColumn("node_id", F.dense_rank().over(W.partitionBy("image_id").orderBy("label")) - 1)


def label_histogram(label_map: DataFrame, classes: int) -> DataFrame:
    """Pixels of every class in every region, zeros included."""
    counts = label_map.filter("label > 0").groupBy(*KEY, "cls").agg(F.count("*").alias("n"))
    grid = counts.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    return grid.join(counts, [*KEY, "cls"], "left").select(*KEY, "cls", F.coalesce("n", F.lit(0)).alias("n"))


def majority_class(label_map: DataFrame, background: int) -> DataFrame:
    """The commonest class other than the background, ties to the lowest; the background where there is no other."""
    n = label_map.filter("label > 0").groupBy(*KEY, "cls").agg(F.count("*").alias("n"))
    own = F.col("cls") != background
    return n.groupBy(*KEY).agg(F.max_by("cls", F.when(own, F.struct("n", -F.col("cls")))).alias("top"), F.max(F.when(own, F.lit(1))).alias("any")).select(*KEY, F.when(F.col("any") == 1, F.col("top")).otherwise(F.lit(background)).alias("cls"))


def distinct_labels(label_map: DataFrame) -> DataFrame:
    """Labels of each image, the background counted where there is some."""
    return label_map.groupBy("image_id").agg(F.countDistinct("label").alias("n_labels"))


def crowdedness(points: DataFrame, k: int = 10) -> DataFrame:
    """Mean and population deviation of the k + 1 smallest distances, the point itself included; k is n - 2 for 3 to k points, and fewer points give 0."""
    sizes = points.groupBy("graph_id").agg(F.count("*").alias("n"))
    others = F.when(F.col("n") < k, F.col("n") - 2).otherwise(F.least(F.lit(k), F.col("n") - 1))
    near = nearest(points, k).join(shuffled(sizes), "graph_id").filter(F.col("rank") <= others).select("graph_id", "node_id", F.col("dist").alias("d"))
    both = near.unionByName(points.select("graph_id", "node_id", F.lit(0.0).alias("d")))
    return both.groupBy("graph_id", "node_id").agg(F.avg("d").alias("mean_crowd"), F.stddev_pop("d").alias("std_crowd"))


def glcm(gray: DataFrame) -> DataFrame:
    """gray(image_id, y, x, label, v): counts of horizontal neighbours (i, j) inside a region; black is left out."""
    own = gray.filter("label > 0 AND v > 0")
    right = own.select("image_id", "label", "y", (F.col("x") - 1).alias("x"), F.col("v").alias("j"))
    return own.select("image_id", "label", "y", "x", F.col("v").alias("i")).join(right, ["image_id", "label", "y", "x"]).groupBy(*KEY, "i", "j").agg(F.count("*").alias("n"))


def glcm_props(counts: DataFrame, labels: DataFrame, levels: int = 255) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, ASM, energy and dispersion of every label; a region without pairs has zeros."""
    d = F.col("i") - F.col("j")
    s = counts.groupBy(*KEY).agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * d * d).alias("c"), F.sum(F.col("n") * F.abs(d)).alias("d"), F.sum(F.col("n") / (1 + d * d)).alias("h"), F.sum(F.col("n") * F.col("n")).alias("q"),
    )
    cells = float(levels * levels)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return labels.select(*KEY).distinct().join(s, KEY, "left").select(
        *KEY, z(F.col("c") / F.col("t")).alias("contrast"), z(F.col("d") / F.col("t")).alias("dissimilarity"), z(F.col("h") / F.col("t")).alias("homogeneity"),
        z(F.col("q") / (F.col("t") * F.col("t"))).alias("asm"), z(F.sqrt(F.col("q") / (F.col("t") * F.col("t")))).alias("energy"),
        z(F.sqrt(F.col("q") / cells - F.pow(F.col("t") / cells, 2))).alias("dispersion"),
    )


def shape_moments(label_map: DataFrame) -> DataFrame:
    """Axes, eccentricity, orientation, equivalent diameter and extent from second central moments of pixel centres. The orientation is the major axis's angle to the y axis."""
    # Sums of whole numbers are exact in any order, so that equal axes come out equal.
    x, y = F.col("x").cast("decimal(10,0)"), F.col("y").cast("decimal(10,0)")
    n = F.count("*").cast("decimal(12,0)")
    second = lambda u, v: ((n * F.sum(u * v).cast("decimal(25,0)") - (F.sum(u).cast("decimal(18,0)") * F.sum(v).cast("decimal(18,0)"))).cast("double") / (n * n).cast("double"))
    m = label_map.filter("label > 0").groupBy(*KEY).agg(
        F.count("*").alias("area"), second(x, x).alias("a"), second(y, y).alias("c"), (-second(x, y)).alias("b"),
        ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"),
    )
    root = F.sqrt(4 * F.col("b") * F.col("b") + (F.col("a") - F.col("c")) * (F.col("a") - F.col("c")))
    m = m.withColumn("l1", (F.col("a") + F.col("c") + root) / 2).withColumn("l2", F.greatest((F.col("a") + F.col("c") - root) / 2, F.lit(0.0)))
    angle = F.when(F.abs(F.col("a") - F.col("c")) < 1e-9, F.when(F.col("b") < 0, pi / 4).otherwise(-pi / 4)).otherwise(0.5 * F.atan2(-2 * F.col("b"), F.col("c") - F.col("a")))
    return m.select(
        *KEY, "area", (4 * F.sqrt("l1")).alias("major_axis"), (4 * F.sqrt("l2")).alias("minor_axis"), F.when(F.col("l1") > 0, F.sqrt(F.greatest(1 - F.try_divide("l2", "l1"), F.lit(0.0)))).otherwise(0.0).alias("eccentricity"),
        angle.alias("orientation"), F.sqrt(4 * F.col("area") / pi).alias("equivalent_diameter"), (F.col("area") / F.col("box")).alias("extent"),
    )


def perimeter_euler(label_map: DataFrame) -> DataFrame:
    """Euler number (8-connected, from 2 x 2 quads) and perimeter (border pixels weighed by their border neighbours).

    Every pixel adds itself to the four quads that it is part of; a quad is a bit mask from one aggregate.
    """
    own = label_map.filter("label > 0").select(*KEY, "y", "x")
    part = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8))]))
    quads = own.select(*KEY, "y", "x", part.alias("o")).groupBy(*KEY, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.sum("o.bit").alias("m"))
    one, three, two = F.col("m").isin(1, 2, 4, 8), F.col("m").isin(7, 11, 13, 14), F.col("m").isin(6, 9)
    worth = F.when(one, 1).when(three, -1).when(two, -2).otherwise(0)
    euler = quads.groupBy(*KEY).agg((F.sum(worth) / 4).cast("int").alias("euler_number"))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    inside = own.select(*KEY, "y", "x", near.alias("o")).groupBy(*KEY, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.count("*").alias("k"))
    border = own.join(inside.filter("k = 4"), [*KEY, "y", "x"], "left_anti")
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(2 if 0 in (dy, dx) else 10).alias("w")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]))
    code = border.select(*KEY, "y", "x", around.alias("o")).select(*KEY, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.w").alias("w"))
    code = border.join(code, [*KEY, "y", "x"], "left").groupBy(*KEY, "y", "x").agg((F.coalesce(F.sum("w"), F.lit(0)) + 1).alias("c"))
    weight = F.when(F.col("c").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("c").isin(21, 33), sqrt(2)).when(F.col("c").isin(13, 23), (1 + sqrt(2)) / 2).otherwise(0.0)
    return euler.join(code.groupBy(*KEY).agg(F.sum(weight).alias("perimeter")), KEY)


def runs(label_map: DataFrame) -> DataFrame:
    """The horizontal runs (x0 to x1, both inside) of each region's rows."""
    at = W.partitionBy(*KEY, "y").orderBy("x")
    own = label_map.filter("label > 0").select(*KEY, "y", "x", (F.col("x") - F.row_number().over(at)).alias("run"))
    return own.groupBy(*KEY, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def _hull(points: list) -> np.ndarray:
    """Corners of the convex hull, in order; none for a single point."""
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    line, points = [], sorted(set(points))
    for way in (points, points[::-1]):
        part: list = []
        for p in way:
            while len(part) > 1 and cross(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        line += part[:-1]
    return np.array(line, float).reshape(-1, 2)


def _pieces(rows: list[tuple[int, int, int]]) -> list[int]:
    """For each run (y, x0, x1), sorted: the first run of its 8-connected piece."""
    up, before, here = list(range(len(rows))), [], []

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    at = 0
    for k, (y, x0, x1) in enumerate(rows):
        if here and rows[here[0]][0] != y:
            before, here, at = (here if rows[here[0]][0] == y - 1 else []), [], 0
        # Both rows go from left to right: what ends before this run also ends before the next ones.
        while at < len(before) and rows[before[at]][2] + 1 < x0:
            at += 1
        j = at
        while j < len(before) and rows[before[j]][1] <= x1 + 1:
            one, other = sorted((top(k), top(before[j])))
            up[other] = one
            j += 1
        here.append(k)
    return [top(k) for k in range(len(rows))]


def _outline(rows: list[tuple[int, int, int]]) -> tuple[float, int, int]:
    """Hull perimeter, pixels of the convex hull, pixels with holes filled, of sorted runs."""
    of = _pieces(rows)
    # The contour that is listed first: that of the piece which a scan from the top finds last.
    last = max(of)
    first = [r for r, p in zip(rows, of) if p == last]
    h = _hull([(x, y) for y, x0, x1 in first for x in (x0, x1)])
    perimeter = float(np.hypot(*(np.roll(h, -1, 0) - h).T).sum()) if len(h) else 0.0
    # The hull of the middles of the pixels' sides; a pixel counts if its centre is in it or on it.
    c = _hull([p for y, x0, x1 in rows for p in ((x0, y - 0.5), (x0, y + 0.5), (x1, y - 0.5), (x1, y + 0.5), (x0 - 0.5, y), (x1 + 0.5, y))])
    # Each side of the hull names the x of its rows; a row of pixels lies between the least and the largest.
    low, high = [float("inf")] * (rows[-1][0] - rows[0][0] + 1), [float("-inf")] * (rows[-1][0] - rows[0][0] + 1)
    corners = c.tolist()
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        for y in range(ceil(min(ya, yb)), floor(max(ya, yb)) + 1) if ya != yb else ():
            x, k = xa + (y - ya) * (xb - xa) / (yb - ya), y - rows[0][0]
            low[k], high[k] = min(low[k], x), max(high[k], x)
    convex = sum(floor(x1 + 1e-9) - ceil(x0 - 1e-9) + 1 for x0, x1 in zip(low, high))
    left, right = min(r[1] for r in rows) - 1, max(r[2] for r in rows) + 1
    outside, at = [(rows[0][0] - 1, left, right)], 0
    for y in range(rows[0][0], rows[-1][0] + 1):
        x = left
        while at < len(rows) and rows[at][0] == y:
            if x < rows[at][1]:
                outside.append((y, x, rows[at][1] - 1))
            x, at = rows[at][2] + 1, at + 1
        outside.append((y, x, right))
    outside.append((rows[-1][0] + 1, left, right))
    holes = sum(x1 - x0 + 1 for (_, x0, x1), p in zip(outside, _pieces(outside)) if p)
    return perimeter, convex, sum(x1 - x0 + 1 for _, x0, x1 in rows) + holes


def convex_hulls(label_map: DataFrame) -> DataFrame:
    """hull_perimeter, convex_area and filled_area of each region.

    The perimeter is that of the hull of the pixel centres of a region's first contour; the area counts the pixels of the hull of all its pixels' sides; holes are
    background that no 8-connected way leads out of. Only a region's runs are gathered, not its pixels.
    """

    def outlines(column: pa.Array) -> pa.Array:
        flat, ends = column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
        rows = list(zip(*(flat.field(k).to_pylist() for k in range(3))))
        got = [_outline(sorted(rows[a:z])) for a, z in zip([0, *ends], ends)]
        return pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*got) if got else ((), (), ()), (pa.float64(), pa.int64(), pa.int64()))], ["hull_perimeter", "convex_area", "filled_area"])

    held = runs(label_map).groupBy(*KEY).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    return held.select(*KEY, F.arrow_udf(outlines, "struct<hull_perimeter:double,convex_area:bigint,filled_area:bigint>")("runs").alias("o")).select(*KEY, "o.*")


def _ratios() -> list[Column]:
    return [
        F.try_divide("hull_perimeter", "perimeter").alias("roughness"), F.try_divide(4 * pi * F.col("area"), F.col("hull_perimeter") * F.col("hull_perimeter")).alias("shape_factor"),
        F.try_divide("minor_axis", "major_axis").alias("ellipticity"), F.try_divide(4 * pi * F.col("area"), F.col("perimeter") * F.col("perimeter")).alias("roundness"), F.try_divide("area", "convex_area").alias("solidity"),
    ]


def derived_shape(moments: DataFrame, outline: DataFrame, hulls: DataFrame) -> DataFrame:
    """Ratios; null where the divisor is 0."""
    return moments.join(outline, KEY).join(hulls, KEY).select(*KEY, *_ratios())


#: The features of a region by name, in the order of the feature vector.
FEATURES = (
    "area", "convex_area", "eccentricity", "equivalent_diameter", "euler_number", "extent", "filled_area", "major_axis_length", "minor_axis_length", "orientation", "perimeter", "solidity",
    "roughness", "shape_factor", "ellipticity", "roundness", "glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_ASM", "glcm_dispersion", "mean_crowdedness", "std_crowdedness",
)


def handcrafted(label_map: DataFrame) -> DataFrame:
    """label_map(image_id, y, x, label, v: gray value) -> the FEATURES of every region, one row each."""
    # Figures that others are made of are joined once: each of them is a pass over the pixels.
    shape = shape_moments(label_map).join(perimeter_euler(label_map), KEY).join(convex_hulls(label_map), KEY).select("*", *_ratios())
    centers = label_map.filter("label > 0").groupBy(F.col("image_id").alias("graph_id"), F.col("label").cast("long").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    crowd = crowdedness(centers).select(F.col("graph_id").alias("image_id"), F.col("node_id").cast("int").alias("label"), F.col("mean_crowd").alias("mean_crowdedness"), F.col("std_crowd").alias("std_crowdedness"))
    texture = glcm_props(glcm(label_map), label_map).select(*KEY, *[F.col(c.lower()).alias(f"glcm_{c}") for c in ("contrast", "dissimilarity", "homogeneity", "energy", "ASM", "dispersion")])
    out = shape.withColumnsRenamed({"major_axis": "major_axis_length", "minor_axis": "minor_axis_length"})
    return out.join(texture, KEY).join(crowd, KEY).select(*KEY, *FEATURES)


def concepts(features: DataFrame, names: str) -> DataFrame:
    """The features of a comma list, in its order."""
    return features.select(*KEY, *[n.strip() for n in names.split(",")])
