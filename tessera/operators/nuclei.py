"""Nucleus instances from a network's maps: probability, horizontal and vertical distance to the nucleus's centre."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.flood import watershed_tiles
from tessera.operators.raster import AT, min_max, reflect_index
from tessera.operators.tissue import fill_holes, remove_small
from tessera.plans.scratch import cut, drop, shuffled

#: The rows of an ellipse of 5 x 5 as half-widths.
ELLIPSE = (0, 2, 2, 2, 0)


def derivative_kernels(size: int) -> tuple[list[float], list[float]]:
    """Smoothing and first derivative of a Sobel operator of that size: binomial weights, and those of size - 1 convolved with (-1, 1)."""
    smooth = [float(comb(size - 1, k)) for k in range(size)]
    less = [float(comb(size - 2, k)) for k in range(size - 1)]
    return smooth, [(less[k - 1] if k else 0.0) - (less[k] if k < size - 1 else 0.0) for k in range(size)]


def separable(px: DataFrame, down: list[float], along: list[float], height: int, width: int, gaps: bool = False) -> DataFrame:
    """px(image_id, y, x, v): correlation with down over y and along over x, mirrored at the edges (which are not repeated). A missing pixel weighs nothing, and has a row of its own only with gaps.

    Every pixel goes to the targets that it weighs in, by a table of the side's length times the weights; sums are partial before the shuffle.
    """
    for axis, weights, size in (("y", down, height), ("x", along, width)):
        other = "x" if axis == "y" else "y"
        taps = px.sparkSession.range(size).select(F.col("id").cast("int").alias("_t"), F.posexplode(F.array(*map(F.lit, weights))).alias("_k", "_w"))
        taps = taps.select("_t", "_w", (F.col("_k") == len(weights) // 2).alias("_own"), reflect_index(F.col("_t") + F.col("_k") - len(weights) // 2, size).cast("int").alias(axis))
        met = px.select("image_id", "y", "x", "v").join(F.broadcast(taps), axis).groupBy("image_id", other, F.col("_t").alias(axis)).agg(F.sum(F.col("_w") * F.col("v")).alias("v"), F.max("_own").alias("_own"))
        px = (met if gaps else met.filter("_own")).select(*AT, "v")
    return px


def sobel(px: DataFrame, height: int, width: int, size: int = 21, gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Derivatives of v along x and along y."""
    smooth, slope = derivative_kernels(size)
    return separable(px, smooth, slope, height, width, gaps), separable(px, slope, smooth, height, width, gaps)


def opening(mask: DataFrame, height: int, width: int, rows: tuple[int, ...] = ELLIPSE) -> DataFrame:
    """Erosion, for which everything beyond the image is set, then dilation, by a shape given as half-widths of its rows."""
    r = len(rows) // 2
    offsets = [(dy - r, dx) for dy, half in enumerate(rows) for dx in range(-half, half + 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    spread = lambda m: m.select(*AT, shift.alias("o")).select("image_id", (F.col("y") + F.col("o.dy")).cast("int").alias("y"), (F.col("x") + F.col("o.dx")).cast("int").alias("x")).filter(inside)
    held = sum((((F.col("y") + dy).between(0, height - 1)) & ((F.col("x") + dx).between(0, width - 1))).cast("int") for dy, dx in offsets)
    # The shape is symmetric: a pixel meets as many set ones as there are that reach it.
    kept = spread(mask).groupBy(*AT).agg(F.count("*").alias("n")).filter(F.col("n") == held).select(*AT)
    return spread(kept).distinct()


def instances(maps: DataFrame, height: int, width: int, least: int = 10, tile: int = 256) -> DataFrame:
    """maps(image_id, y, x, p, h, v), dense -> image_id, y, x, label: nuclei grown from markers inside the probable pixels, along the ridges of the distance maps. The flood goes tile by tile."""
    mask = cut(remove_small(maps.filter(F.col("p") >= 0.5).select(*AT), width, least).select(*AT), "mask")
    edges = []
    for column, part in (("h", 0), ("v", 1)):
        spread = min_max(maps.select(*AT, column), column).select(*AT, F.col(column).alias("v"))
        edges.append(min_max(sobel(spread, height, width)[part], "v").select(*AT, (1 - F.col("v")).alias(f"e{part}")))
    both = edges[0].join(shuffled(edges[1]), AT).join(shuffled(mask.withColumn("in", F.lit(1))), AT, "left")
    both = cut(both.select(*AT, F.coalesce("in", F.lit(0)).alias("in"), F.greatest(F.greatest("e0", "e1") - (1 - F.coalesce("in", F.lit(0))), F.lit(0.0)).alias("ridge")), "ridges")
    depth = separable(both.select(*AT, ((1 - F.col("ridge")) * F.col("in")).alias("v")), [0.25, 0.5, 0.25], [0.25, 0.5, 0.25], height, width).select(*AT, (-F.col("v")).alias("v"))
    seeds = opening(fill_holes(both.filter((F.col("in") == 1) & (F.col("ridge") < 0.5)).select(*AT), height, width), height, width)
    marked = remove_small(seeds, width, least)
    named = marked.select("image_id", "component").distinct().withColumn("label", F.row_number().over(W.partitionBy("image_id").orderBy("component")))
    return watershed_tiles(depth, marked.join(shuffled(named), ["image_id", "component"]).select(*AT, "label"), mask, tile)


#: A window's side, and that of its inner square, which is what a model gives back.
WINDOW, CORE = 256, 164


def predicted(px: DataFrame, model: Callable[[np.ndarray], np.ndarray], height: int, width: int, tissue: DataFrame | None = None, batch: int = 4) -> DataFrame:
    """px(image_id, y, x, r, g, b), dense -> image_id, y, x, p, h, v: a model's maps, window by window.

    model: from windows (n, WINDOW, WINDOW, 3), channels in 0 to 1, to maps (n, CORE, CORE, 3) of their inner squares. Windows reach beyond the image into its mirror. Pixels outside the tissue are white to it.
    A task's group is `batch` windows beside one another.
    """
    if tissue is not None:
        px = px.join(shuffled(tissue.select(*AT, F.lit(True).alias("in"))), AT, "left").select(*AT, *[F.when(F.col("in"), F.col(c)).otherwise(255).alias(c) for c in "rgb"])
    edge = (WINDOW - CORE) // 2

    def axis(name: str, size: int) -> DataFrame:
        """Window w, position t in it, and the pixel that lies there."""
        told = px.sparkSession.range(-(-size // CORE) * WINDOW).select((F.col("id") / WINDOW).cast("int").alias(f"w{name}"), (F.col("id") % WINDOW).cast("int").alias(f"t{name}"))
        place = F.col(f"w{name}") * CORE + F.col(f"t{name}") - edge
        return told.withColumn(name, (reflect_index(place, size) if size > 1 else F.lit(0)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        image, wy = table.column("image_id")[0].as_py(), table.column("wy")[0].as_py()
        column = lambda c: table.column(c).to_numpy()
        own, at = np.unique(column("wx"), return_inverse=True)
        seen = np.zeros((len(own), WINDOW, WINDOW, 3), np.float32)
        for k, c in enumerate("rgb"):
            seen[at, column("ty"), column("tx"), k] = column(c) / 255.0
        maps = np.asarray(model(seen))
        y = (wy * CORE + np.arange(CORE))[None, :, None] + np.zeros(maps.shape[:3], int)
        x = own[:, None, None] * CORE + np.arange(CORE)[None, None, :] + np.zeros(maps.shape[:3], int)
        inside = (y < height) & (x < width)
        flat = {"y": pa.array(y[inside], pa.int32()), "x": pa.array(x[inside], pa.int32())} | {c: pa.array(maps[..., k][inside].astype(float)) for k, c in enumerate("phv")}
        return pa.table({"image_id": pa.array([image] * int(inside.sum()), table.schema.field("image_id").type)} | flat)

    placed = px.select(*[F.col(c).cast("int").alias(c) if c in "yx" else F.col(c) for c in (*AT, *"rgb")]).join(axis("y", height), "y").join(axis("x", width), "x")
    kind = px.schema["image_id"].dataType.simpleString()
    groups = placed.select("image_id", "wy", "wx", "ty", "tx", *"rgb", F.floor(F.col("wx") / batch).alias("some")).groupBy("image_id", "wy", "some")
    return groups.applyInArrow(run, f"image_id {kind}, y int, x int, p double, h double, v double")


def extract(px: DataFrame, model: Callable[[np.ndarray], np.ndarray], height: int, width: int, tissue: DataFrame | None = None, least: int = 10, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """The nuclei of images: (image_id, y, x, label), and (image_id, label, cx, cy), the rounded mean places in the order of labels."""
    maps = cut(predicted(px, model, height, width, tissue), "maps")
    found = instances(maps, height, width, least, tile)
    drop(maps)
    return found, found.groupBy("image_id", "label").agg(F.rint(F.avg("x")).cast("int").alias("cx"), F.rint(F.avg("y")).cast("int").alias("cy"))
