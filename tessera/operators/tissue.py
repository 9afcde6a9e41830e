"""Masks: pixel components, hole filling, tissue masks and watershed, over all images at once."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import cut, drop, shuffled

from .graph import components, largest_component
from .raster import AT, dilate, gaussian_blur, gray, gray_bgr_inverted, kernel as gaussian, otsu, otsu_binned

#: Images of up to so many pixels are worked on in a task each, larger ones by jobs over their pixels.
TASK_PIXELS = 1 << 20


def pixel_components(mask: DataFrame, width: int) -> DataFrame:
    """mask(image_id, y, x): the 4-connected component of every pixel, named by its first pixel.

    Runs of a row are one node, so a component takes far fewer rounds and rows than pixels.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id", "y").orderBy("x")
    starts = F.when(F.lag("x").over(w) == F.col("x") - 1, None).otherwise(F.col("y").cast("long") * width + F.col("x"))
    own = cut(mask.select(*AT, starts.alias("s")).select(*AT, F.last("s", ignorenulls=True).over(w).alias("node_id")), "runs")
    below = own.select("image_id", (F.col("y") + 1).alias("y"), "x", F.col("node_id").alias("dst"))
    edges = own.select(*AT, F.col("node_id").alias("src")).join(shuffled(below), AT).select("image_id", "src", "dst").distinct()
    named = components(own.select("image_id", "node_id").distinct(), edges, "image_id")
    return own.join(shuffled(named), ["image_id", "node_id"]).select(*AT, "component")


def remove_small(mask: DataFrame, width: int, least: int) -> DataFrame:
    """The pixels of components of at least so many, with their component."""
    own = cut(pixel_components(mask, width), "named")
    large = own.groupBy("image_id", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return own.join(shuffled(large.select("image_id", "component")), ["image_id", "component"], "left_semi").select(*AT, "component")


def fill_holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The mask with background that cannot reach the edge of the image (by side steps) added."""
    grid = mask.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    outside = pixel_components(grid.join(shuffled(mask.withColumn("y", F.col("y").cast("int")).withColumn("x", F.col("x").cast("int"))), AT, "left_anti"), width)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    open_ = outside.filter(edge).select("image_id", "component").distinct()
    return mask.select(*AT).unionByName(outside.join(shuffled(open_), ["image_id", "component"], "left_anti").select(*AT))


def tissue_step(px: DataFrame, height: int, width: int, sigma: float, min_size: int, steps: int = 1) -> DataFrame:
    """The largest component of what is left of the inverted gray image after `steps` times a blur and the Otsu threshold (values under it become 0); none if it is small.

    Without a blur values stay whole numbers, and so are the bins of the threshold. An image of one value has no tissue.
    """
    v = px.select(*AT, gray_bgr_inverted().cast("double").alias("v"))
    varied = v.groupBy("image_id").agg((F.min("v") < F.max("v")).alias("varied")).filter("varied")
    v, before = v.join(shuffled(varied.select("image_id")), "image_id", "left_semi"), None
    for _ in range(steps):
        v = cut(gaussian_blur(v, sigma, height, width).select(*AT, "v") if sigma > 0 else v, "blur")
        drop(before)
        before, threshold = v, otsu_binned(v) if sigma > 0 else otsu(v)
        v = v.join(threshold, "image_id", "left").select(*AT, F.when(F.col("v") >= F.coalesce("threshold", F.lit(0)), F.col("v")).otherwise(0.0).alias("v"))
    named = cut(pixel_components(v.filter("v > 0").select(*AT), width), "named")
    best = largest_component(named.select("image_id", "component"), "image_id").filter(F.col("size") >= min_size)
    return named.join(shuffled(best.select("image_id", "component")), ["image_id", "component"]).select(*AT)


def gaussian_tissue_mask(px: DataFrame, height: int, width: int, sigma: float = 20.0, min_size: int = 10, kernel: int = 20, background: float = 228.0, steps: int = 1) -> DataFrame:
    """Tissue found in rounds, each taking a component and whitening it, until what is found is as light as the background or adds no pixel.

    How light a component is, is the mean of its own gray before any whitening, black pixels aside.
    Rounds follow one another, and each needs the whole image: images of up to TASK_PIXELS are a group each, spread over tasks, with all their rounds in one job. Larger ones go through `tissue_by_pixels`, some jobs a round.
    """
    if height * width > TASK_PIXELS:
        return tissue_by_pixels(px, height, width, sigma, min_size, kernel, background, steps)
    rows = px.select(*AT, gray_bgr_inverted().alias("v"), gray().alias("own"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("image_id").applyInArrow(_tissue(height, width, gaussian(sigma) if sigma > 0 else None, min_size, kernel, background, steps), ", ".join(f"{c} {kinds[c]}" for c in AT))


def _blurred(v: np.ndarray, inside: np.ndarray, weights: list[float]) -> np.ndarray:
    """As `gaussian_blur`: edges repeated; missing pixels are 0 before and after each pass."""
    r, (h, w) = len(weights) // 2, v.shape
    wide = np.pad(v, ((r, r), (0, 0)), "edge")
    v = np.where(inside, sum(k * wide[i : i + h] for i, k in enumerate(weights)), 0.0)
    wide = np.pad(v, ((0, 0), (r, r)), "edge")
    return np.where(inside, sum(k * wide[:, i : i + w] for i, k in enumerate(weights)), 0.0)


def _otsu(v: np.ndarray, binned: bool, bins: int = 256) -> float:
    """As `otsu_binned` or `otsu`."""
    some = v[v > 0]
    if not some.size or some.min() == some.max():
        return 0.0
    lo, hi = some.min(), some.max()
    t = (np.minimum(np.floor((some - lo) / (hi - lo) * bins), bins - 1) + 1 if binned else some).astype(int)
    n = np.bincount(t)
    n1, s1 = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    at = np.flatnonzero((n > 0) & (n1 < n1[-1]))
    if not at.size:
        return 0.0
    n1, s1, n, total = n1[at], s1[at], n1[-1], s1[-1]
    gap = s1 / n1 - (total - s1) / (n - n1)
    best = at[np.argmax(np.round(n1 * (n - n1) * gap * gap, 6))]
    return lo + (best - 0.5) * (hi - lo) / bins if binned else float(best)


def _rooted(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of n nodes and their edges: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        low, least = label.copy(), np.minimum(label[one], label[other])
        for side in (one, other):
            # Also the label's own root sinks, so that long chains take few rounds.
            np.minimum.at(low, label[side], least)
            np.minimum.at(low, side, least)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _largest(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected component, ties to the one with the first pixel, by labels of runs as in `pixel_components`."""
    first = mask.copy()
    first[:, 1:] &= ~mask[:, :-1]
    run = np.cumsum(first.ravel()).reshape(mask.shape) - 1
    meet = mask[1:] & mask[:-1]
    label = _rooted(int(first.sum()), run[:-1][meet], run[1:][meet])
    of = label[run[mask]]
    out = np.zeros_like(mask)
    if of.size:
        out[mask] = of == np.bincount(of).argmax()
    return out


def _grown(mask: np.ndarray, size: int) -> np.ndarray:
    """As `dilate`."""
    (h, w), lo, hi = mask.shape, size // 2, size - 1 - size // 2
    wide = np.pad(mask, ((lo, hi), (0, 0)))
    mask = np.logical_or.reduce([wide[i : i + h] for i in range(size)])
    wide = np.pad(mask, ((0, 0), (lo, hi)))
    return np.logical_or.reduce([wide[:, i : i + w] for i in range(size)])


def _tissue(height: int, width: int, weights: list[float] | None, min_size: int, kernel: int, background: float, steps: int):
    def run(table: pa.Table) -> pa.Table:
        at = tuple(table.column(c).to_numpy() for c in ("y", "x"))
        v, own, inside, hit = (np.zeros((height, width), kind) for kind in (float, int, bool, bool))
        inside[at] = True
        v[at], own[at] = (pc.fill_null(table.column(c), 0).to_numpy() for c in ("v", "own"))
        while v[inside].min() < v[inside].max():
            left = v
            for _ in range(steps):
                left = _blurred(left, inside, weights) if weights else left
                left = np.where(left >= _otsu(left, weights is not None), left, 0.0)
            piece = _largest(left > 0)
            if not piece.any() or piece.sum() < min_size:
                break
            under = _grown(piece, kernel) & inside
            new, gray_ = under & ~hit, own[under & (own > 0)]
            if not gray_.size or gray_.mean() >= background or not new.any():
                break
            hit |= new
            v[new] = 0
        return table.select(AT).filter(pa.array(hit[at]))

    return run


def tissue_by_pixels(px: DataFrame, height: int, width: int, sigma: float, min_size: int, kernel: int, background: float, steps: int) -> DataFrame:
    """`gaussian_tissue_mask` of images of any size: images that are done leave the loop; every round is a few jobs over the images still open."""
    open_ = cut(px.select(*AT, "r", "g", "b", gray().alias("own"), F.lit(False).alias("hit")), "open")
    found = px.select(*AT).filter("false")
    while True:
        grown = dilate(tissue_step(open_, height, width, sigma, min_size, steps), kernel, height, width).select("image_id", F.col("y").cast("int"), F.col("x").cast("int"))
        under = cut(open_.join(shuffled(grown), AT).select(*AT, "own", "hit"), "under")
        dark = under.groupBy("image_id").agg(F.avg(F.when(F.col("own") > 0, F.col("own"))).alias("light")).filter(F.col("light") < background)
        new = cut(under.filter(~F.col("hit")).join(shuffled(dark.select("image_id")), "image_id", "left_semi").select(*AT), "new")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        still = open_.join(shuffled(new.select("image_id").distinct()), "image_id", "left_semi").join(shuffled(new.withColumn("now", F.lit(True))), AT, "left")
        white = lambda c: F.when(F.col("now"), 255).otherwise(F.col(c)).alias(c)
        open_ = cut(still.select(*AT, white("r"), white("g"), white("b"), "own", (F.col("hit") | F.col("now").isNotNull()).alias("hit")), "open")


def _flood(height: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        y, x, v, mark = (table.column(c).to_pylist() for c in ("y", "x", "v", "label"))
        # A frame of closed pixels spares the tests for the edge.
        wide = width + 2
        value, label = [None] * ((height + 2) * wide), [None] * ((height + 2) * wide)
        at = [(a + 1) * wide + b + 1 for a, b in zip(y, x)]
        for i, a, m in zip(at, v, mark):
            value[i], label[i] = a, m
        heap = [(value[i], 0, i) for i in at if label[i] is not None]
        heapq.heapify(heap)
        age = 0
        while heap:
            i = heapq.heappop(heap)[2]
            for n in (i - wide, i - 1, i + 1, i + wide):
                if value[n] is not None and label[n] is None:
                    age += 1
                    label[n] = label[i]
                    heapq.heappush(heap, (value[n], age, n))
        out = pa.array([label[i] for i in at], table.schema.field("label").type)
        return table.drop_columns(["v", "label"]).append_column("label", out).filter(pc.is_valid(out))

    return run


def watershed(px: DataFrame, markers: DataFrame, height: int, width: int, mask: DataFrame | None = None) -> DataFrame:
    """px(image_id, y, x, v), markers(image_id, y, x, label): labels grown from the markers over the pixels (of the mask), lowest v first.

    A priority flood: v may be any number; a pixel takes the label that touches it first, and of equal v the one touched first goes on first.
    The order runs through the whole image, so an image is one group; a pixel marked twice has its smallest label.
    """
    if mask is not None:
        px = px.join(shuffled(mask.select(*AT).distinct()), AT, "left_semi")
    marks = markers.groupBy(*AT).agg(F.min("label").alias("label"))
    rows = px.filter(F.col("v").isNotNull()).select(*AT, "v").join(shuffled(marks), AT, "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("image_id").applyInArrow(_flood(height, width), ", ".join(f"{c} {kinds[c]}" for c in (*AT, "label")))
