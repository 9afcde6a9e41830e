"""Superpixels: clustering, colour figures, adjacency weights, tissue filter and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import cut, drop, shuffled

from .graph import connectivity, region_adjacency
from .raster import AT, WHITE, XYZ, cie_lab, gaussian_blur, hed, kernel, resample
from .tissue import TASK_PIXELS, _blurred, _rooted, pixel_components

KEY = ["image_id", "label"]
BINS = 4


def count_for(height: Column, width: Column, size: int, most: int | None = None) -> Column:
    """Superpixels of about `size` pixels that an image takes, up to `most`."""
    n = F.floor(height * width / size)
    return n if most is None else F.least(n, F.lit(most))


def connected(lab: DataFrame, width: int, least: int) -> DataFrame:
    """lab(image_id, y, x, label) with every connected piece as a label of its own, from 1 in the order of their first pixels.

    A piece of under `least` pixels joins the piece left of its first pixel, or above it. That one begins earlier, so joins form no cycle;
    only the piece of an image's first pixel can stay small.
    """
    own = pixel_components(lab.select(F.struct("image_id", "label").alias("image_id"), "y", "x"), width)
    own = cut(own.select(F.col("image_id.image_id").alias("image_id"), "y", "x", "component"), "pieces")
    small = own.groupBy("image_id", "component").agg((F.count("*") < least).alias("small"))
    left = own.select("image_id", "y", (F.col("x") + 1).alias("x"), F.col("component").alias("left"))
    above = own.select("image_id", (F.col("y") + 1).alias("y"), "x", F.col("component").alias("above"))
    first = own.filter(F.col("component") == F.col("y").cast("long") * width + F.col("x")).join(shuffled(small), ["image_id", "component"])
    first = first.join(shuffled(left), ["image_id", "y", "x"], "left").join(shuffled(above), ["image_id", "y", "x"], "left")
    to = cut(first.select("image_id", "component", F.when(F.col("small"), F.coalesce("left", "above", "component")).otherwise(F.col("component")).alias("to")), "joins")
    while True:
        jump = to.select("image_id", F.col("component").alias("to"), F.col("to").alias("next"))
        after = cut(to.join(shuffled(jump), ["image_id", "to"]).select("image_id", "component", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "joins")
        to = after.select("image_id", "component", "to")
        if after.filter("moved").isEmpty():
            break
    named = to.select("image_id", "to").distinct().withColumn("label", F.row_number().over(W.partitionBy("image_id").orderBy("to")))
    return own.join(shuffled(to.join(shuffled(named), ["image_id", "to"])), ["image_id", "component"]).select("image_id", "y", "x", "label")


def _coloured(px: DataFrame, color_space: str) -> DataFrame:
    """px with values r, g, b: its own, a missing one as 0, or the stains' separation made into an image again."""
    if color_space not in ("rgb", "hed"):
        raise ValueError("color_space must be rgb or hed")
    px = px.select(*AT, *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])
    return px if color_space == "rgb" else px.select(*AT, *hed()).select(*AT, *[(F.col(c) * 255).alias(n) for c, n in zip("hed", "rgb")])


def clustered(px: DataFrame, height: int, width: int, step: int, compactness: float = 20.0, rounds: int = 10, sigma: float = 1.0, color_space: str = "rgb") -> DataFrame:
    """px(image_id, y, x, r, g, b) -> image_id, y, x, seed: k-means over blurred colour and place, not yet connected.

    A pixel takes the seed at the least squared distance, colour over compactness and place over step, among the 3 x 3 seeds around its own grid cell, ties to the first. Colours are CIE Lab of the blurred values, of the stains'
    separation made into an image again where color_space is hed. The first of the rounds gives every pixel its own grid cell, as seeds begin without a colour.

    Pixels keep their grid cell, and the seeds around a cell are one row, so a round is one equi-join of a row a pixel and one partial aggregate.
    """
    px = _coloured(px, color_space)
    rows, cols = -(-height // step), -(-width // step)
    if sigma > 0:
        # A channel is an image to the blur.
        each = px.select(*AT, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in "rgb"])).alias("o"))
        soft = gaussian_blur(each.select(F.struct("image_id", "o.c").alias("image_id"), "y", "x", "o.v"), sigma, height, width)
        px = soft.groupBy(F.col("image_id.image_id").alias("image_id"), "y", "x").agg(*[F.max(F.when(F.col("image_id.c") == c, F.col("v"))).alias(c) for c in "rgb"])
    cell = F.floor(F.col("y") / step) * cols + F.floor(F.col("x") / step)
    own = cut(px.select(*[F.col(c).cast("int").alias(c) if c in "yx" else F.col(c) for c in AT], *[c.alias(n) for c, n in zip(cie_lab(), ("l", "a", "b"))], cell.alias("cell")), "colours")
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    to_y, to_x = F.floor(F.col("seed") / cols) + F.col("o.dy"), F.col("seed") % cols + F.col("o.dx")
    means = [F.avg(c).alias(f"m{c}") for c in ("y", "x", "l", "a", "b")]
    given, seeds = own.withColumn("seed", F.col("cell")), None

    def far(s: Column) -> Column:
        square = lambda c: (F.col(c) - s[f"m{c}"]) * (F.col(c) - s[f"m{c}"])
        d = (square("l") + square("a") + square("b")) / (compactness * compactness) + (square("y") + square("x")) / float(step * step)
        return F.struct(d.alias("d"), s["seed"].alias("seed"))

    for _ in range(rounds - 1):
        after = cut(given.groupBy("image_id", "seed").agg(*means), "seeds")
        drop(seeds)
        seeds = after
        reach = seeds.select("*", around.alias("o")).filter(to_y.between(0, rows - 1) & to_x.between(0, cols - 1)).withColumn("cell", to_y * cols + to_x)
        near = reach.groupBy("image_id", "cell").agg(F.collect_list(F.struct("seed", *[f"m{c}" for c in ("y", "x", "l", "a", "b")])).alias("near"))
        given = own.join(shuffled(near), ["image_id", "cell"]).withColumn("seed", F.array_min(F.transform("near", far))["seed"]).drop("near")
    return given.select(*AT, "seed")


def _seeds(values: np.ndarray, y: np.ndarray, x: np.ndarray, cols: int, step: int, compactness: float, rounds: int) -> np.ndarray:
    """As `clustered`: of pixels at (y, x) with colours values[0..2] the seeds, numbered in a grid that has a frame without seeds."""
    values, wide = np.stack([*values, y, x]), cols + 2
    cell = (y // step + 1) * wide + x // step + 1
    given, size = cell, int(cell.max()) + wide + 2
    for _ in range(rounds - 1):
        n = np.bincount(given, minlength=size)
        # A seed without pixels is nowhere, and so is the frame.
        means = [np.where(n > 0, np.bincount(given, v, size) / np.maximum(n, 1), np.inf) for v in values]
        least, given = np.full(len(cell), np.inf), np.zeros_like(cell)
        for move in (a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1)):
            seed = cell + move
            l, a, b, down, along = ((v - m[seed]) ** 2 for v, m in zip(values, means))
            d = (l + a + b) / (compactness * compactness) + (down + along) / float(step * step)
            nearer = d < least
            given, least = np.where(nearer, seed, given), np.where(nearer, d, least)
    return given


def _lab(rgb: list[np.ndarray]) -> list[np.ndarray]:
    """As `cie_lab`."""
    linear = [np.where(c / 255.0 > 0.04045, ((c / 255.0 + 0.055) / 1.055) ** 2.4, c / 255.0 / 12.92) for c in rgb]
    x, y, z = (sum(w * c for w, c in zip(row, linear)) / white for row, white in zip(XYZ, WHITE))
    x, y, z = (np.where(v > 0.008856, v ** (1 / 3), 7.787 * v + 16 / 116) for v in (x, y, z))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def _pieces(seed: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """As `connected`: the labels of the pixels inside, in their order."""
    width, same = seed.shape[1], inside[:, 1:] & inside[:, :-1] & (seed[:, 1:] == seed[:, :-1])
    first = inside.copy()
    first[:, 1:] &= ~same
    run, start = np.cumsum(first.ravel()).reshape(seed.shape) - 1, np.flatnonzero(first)
    # Runs that touch do so first where one of them begins.
    meet = inside[1:] & inside[:-1] & (seed[1:] == seed[:-1]) & (first[1:] | first[:-1])
    root, own = _rooted(len(start), run[:-1][meet], run[1:][meet]), np.arange(len(start))
    small = np.bincount(root[run[inside]], minlength=len(start)) < least
    # A root is its piece's first run, and begins at its first pixel.
    there, of = inside.ravel(), root[run.ravel()]
    left, above = (start % width > 0) & there[start - 1], (start >= width) & there[start - width]
    to = np.where(small & left, of[start - 1], np.where(small & above, of[start - width], own))
    while (to[to] != to).any():
        to = to[to]
    return np.unique(to[root[run[inside]]], return_inverse=True)[1] + 1


def _slic(height: int, width: int, step: int, compactness: float, rounds: int, weights: list[float] | None):
    cols = -(-width // step)

    def run(table: pa.Table) -> pa.Table:
        at = tuple(table.column(c).to_numpy() for c in ("y", "x"))
        image, inside, seed = np.zeros((3, height, width)), np.zeros((height, width), bool), np.zeros((height, width), int)
        inside[at] = True
        for c, channel in zip("rgb", image):
            channel[at] = table.column(c).to_numpy()
        y, x = np.nonzero(inside)
        colours = _lab([(_blurred(c, inside, weights) if weights else c)[inside] for c in image])
        seed[inside] = _seeds(colours, y, x, cols, step, compactness, rounds)
        label = _pieces(seed, inside, step * step // 2)
        return pa.table({"image_id": pa.repeat(table.column("image_id")[0], len(y))} | {n: pa.array(v, pa.int32()) for n, v in (("y", y), ("x", x), ("label", label))})

    return run


def slic(px: DataFrame, height: int, width: int, step: int, compactness: float = 20.0, rounds: int = 10, sigma: float = 1.0, color_space: str = "rgb") -> DataFrame:
    """Labels from 1 by k-means over blurred colour and place, each connected and none under half a grid cell's pixels.

    Rounds follow one another: images of up to TASK_PIXELS are a group each, spread over tasks, with all their rounds in one job. Larger ones go through `clustered` and `connected`, some jobs a round.
    """
    if height * width > TASK_PIXELS:
        given = clustered(px, height, width, step, compactness, rounds, sigma, color_space)
        return connected(given.withColumnRenamed("seed", "label"), width, step * step // 2)
    rows = _coloured(px, color_space).filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), *"rgb")
    kind = px.schema["image_id"].dataType.simpleString()
    return rows.groupBy("image_id").applyInArrow(_slic(height, width, step, compactness, rounds, kernel(sigma) if sigma > 0 else None), f"image_id {kind}, y int, x int, label int")


def grid_step(height: int, width: int, number: int | None = None, size: int | None = None, most: int | None = None) -> int:
    """The side of the seeds' cells for a number of superpixels or for their size in pixels, exactly one of which is given; at most `most` superpixels."""
    if (number is None) == (size is None):
        raise ValueError("give either a number of superpixels or a size")
    n = number if size is None else height * width // size
    n = n if most is None else min(n, most)
    if n < 1:
        raise ValueError("an image must take a superpixel at least")
    return max(1, round((height * width / n) ** 0.5))


def superpixels(
    px: DataFrame, height: int, width: int, number: int | None = None, size: int | None = None, most: int | None = None, tissue: DataFrame | None = None, factor: int = 1, thresh: float = 0.06,
    w_hist: float = 0.5, w_mean: float = 0.5, legacy: bool = True, **how,
) -> DataFrame:
    """image_id, y, x, initial, merged: superpixels before merging, and after it, 0 outside the tissue.

    Images are looked at by every `factor`-th pixel, and labels spread to the whole image by the nearest. Superpixels with under a tenth of tissue(image_id, y, x) take no part in merging; without a tissue mask all do.
    """
    h, w = -(-height // factor), -(-width // factor)
    small = px.select("image_id", "y", "x", "r", "g", "b") if factor == 1 else resample(px.select("image_id", "y", "x", "r", "g", "b"), height, width, h, w)
    first = cut(slic(small, h, w, grid_step(h, w, number, size, most), **how), "initial")
    lab = first.join(shuffled(small), ["image_id", "y", "x"])
    own = lab.withColumn("label", F.col("label").cast("int"))
    if tissue is not None:
        mask = tissue.select("image_id", "y", "x", F.lit(1).alias("_in"))
        if factor > 1:
            dense = px.select("image_id", "y", "x").join(shuffled(mask), ["image_id", "y", "x"], "left")
            mask = resample(dense, height, width, h, w)
        own = own.join(shuffled(mask), ["image_id", "y", "x"], "left")
        kept = tissue_filter(own, F.coalesce("_in", F.lit(0)) == 1)
        own = own.join(shuffled(kept), KEY).select("image_id", "y", "x", F.col("new_label").cast("int").alias("label"), "r", "g", "b")
    own = cut(own.select("image_id", "y", "x", "label", "r", "g", "b"), "tissue")
    merged = own.join(shuffled(merge(own, thresh, w_hist, w_mean, legacy)), KEY).select("image_id", "y", "x", "merged")
    both = first.select("image_id", "y", "x", F.col("label").alias("initial")).join(shuffled(merged), ["image_id", "y", "x"], "left").withColumn("merged", F.coalesce("merged", F.lit(0)))
    out = both if factor == 1 else resample(both, h, w, height, width)
    out = cut(out, "superpixels")
    drop(first, own)
    return out


def color_stats(lab: DataFrame) -> DataFrame:
    """N, colour sums, mean colour's length and 4-bin histograms of every superpixel."""
    hist = [F.sum((F.floor(F.col(c) / 64) == k).cast("int")).alias(f"h{c}{k}") for c in "rgb" for k in range(BINS)]
    s = lab.filter("label > 0").groupBy(*KEY).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "rgb"], *hist)
    return s.withColumn("norm", F.sqrt(sum(((F.col(f"s{c}") / F.col("n")) ** 2 for c in "rgb"), F.lit(0.0))))


def _weight(w_hist: float, w_mean: float, legacy: bool) -> Column:
    """Of columns a_*, b_*: half the mean histogram distance and half the mean colour distance, each normalised.

    legacy: the green and the blue vector are the red unit vector over the length of the green and of the blue counts.
    """
    length = lambda s, n: F.sqrt(sum((F.col(f"{s}_h{n}{k}").cast("double") ** 2 for k in range(BINS)), F.lit(0.0)))

    def value(s: str, n: str, k: int) -> Column:
        if not legacy or n == "r":
            return F.col(f"{s}_h{n}{k}") / length(s, n)
        return F.col(f"{s}_hr{k}") / length(s, "r") / length(s, n)

    dists = [F.sqrt(sum(((value("a", n, k) - value("b", n, k)) ** 2 for k in range(BINS)), F.lit(0.0))) / 2 for n in "rgb"]
    mean = lambda s, c: F.coalesce(F.try_divide(F.col(f"{s}_s{c}") / F.col(f"{s}_n"), F.col(f"{s}_norm")), F.lit(0.0))
    color = F.sqrt(sum(((mean("a", c) - mean("b", c)) ** 2 for c in "rgb"), F.lit(0.0))) / 2
    return w_hist * (dists[0] + dists[1] + dists[2]) / 3 + w_mean * color


def rag_weights(lab: DataFrame, w_hist: float = 0.5, w_mean: float = 0.5, neighbours: int = 2, legacy: bool = True) -> DataFrame:
    """Adjacent superpixels (src < dst) with the distance of their colours."""
    s = color_stats(lab)
    side = lambda p, key: s.select("image_id", F.col("label").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in s.columns if c not in KEY])
    e = region_adjacency(lab, connectivity(neighbours)).filter("src < dst")
    return e.join(shuffled(side("a", "src")), ["image_id", "src"]).join(shuffled(side("b", "dst")), ["image_id", "dst"]).select("image_id", "src", "dst", _weight(w_hist, w_mean, legacy).alias("w"))


def tissue_filter(lab: DataFrame, mask: Column, least: float = 0.1) -> DataFrame:
    """Superpixels with enough tissue, renumbered from 1; (image_id, label) -> new_label."""
    share = lab.filter("label > 0").groupBy(*KEY).agg(F.avg(mask.cast("int")).alias("share")).filter(F.col("share") >= least)
    return share.select(*KEY, F.dense_rank().over(W.partitionBy("image_id").orderBy("label")).alias("new_label"))


def merge(lab: DataFrame, thresh: float = 0.03, w_hist: float = 0.5, w_mean: float = 0.5, legacy: bool = True) -> DataFrame:
    """Greedy merging of the closest adjacent superpixels while closer than thresh: (image_id, label) -> merged, from 1.

    Only an image's region graph and figures meet in one task, a few numbers a superpixel; pixels are relabelled by a join.
    """
    s = color_stats(lab).select("image_id", F.struct(*[c for c in color_stats(lab).columns if c != "image_id"]).alias("node"), F.lit(None).cast("struct<src:int,dst:int,w:double>").alias("edge"))
    e = rag_weights(lab, w_hist, w_mean, legacy=legacy).select("image_id", F.lit(None).cast(s.schema["node"].dataType).alias("node"), F.struct("src", "dst", "w").alias("edge"))

    def run(key, pdf):
        import heapq

        import numpy as np
        import pandas as pd

        node = {x["label"]: x for x in pdf.node if x is not None}
        vec = {k: np.array([v["n"], v["sr"], v["sg"], v["sb"]] + [v[f"h{c}{b}"] for c in "rgb" for b in range(BINS)], float) for k, v in node.items()}
        near: dict = {k: set() for k in node}
        heap = []
        for x in pdf.edge:
            if x is not None:
                near[x["src"]].add(x["dst"])
                near[x["dst"]].add(x["src"])
                heap.append((x["w"], x["src"], x["dst"]))
        heapq.heapify(heap)
        into = {k: k for k in node}
        top = max(node, default=0)

        def unit(v):
            n = np.linalg.norm(v)
            return v / n if n else v

        def histograms(v):
            counts = v[4:].reshape(3, BINS)
            if not legacy:
                return [unit(c) for c in counts]
            return [unit(counts[0]) / (np.linalg.norm(c) if i else 1.0) for i, c in enumerate(counts)]

        def weight(a, b):  # the colour term is not halved once a region was merged
            h = np.mean([np.linalg.norm(x - y) / 2 for x, y in zip(histograms(a), histograms(b))])
            return w_hist * h + w_mean * np.linalg.norm(unit(a[1:4]) - unit(b[1:4]))

        while heap:
            w, a, b = heapq.heappop(heap)
            if w >= thresh:
                break
            if a not in near or b not in near:
                continue
            top += 1
            vec[top] = vec.pop(a) + vec.pop(b)
            near[top] = (near.pop(a) | near.pop(b)) - {a, b}
            into[a] = into[b] = top
            into[top] = top
            for c in near[top]:
                near[c] = (near[c] - {a, b}) | {top}
                heapq.heappush(heap, (float(weight(vec[top], vec[c])), min(c, top), max(c, top)))

        def root(k):
            while into[k] != k:
                k = into[k]
            return k

        ends = {k: root(k) for k in node}
        order = {r: i + 1 for i, r in enumerate(sorted(set(ends.values())))}
        return pd.DataFrame([[key[0], k, order[r]] for k, r in ends.items()], columns=["image_id", "label", "merged"])

    return s.unionByName(e).groupBy("image_id").applyInPandas(run, "image_id long, label int, merged int")
