"""Patch features with an injected embedding: patches of instances and grids, augmented or masked, and predictions stitched back.

An embedding is a function of a numpy batch (n, patch, patch, 3), normalised, that gives (n, width) numbers: a network's forward pass, or any figure; figures that are means or sums ask for float64. It runs in Arrow
batches of `batch` patches. A patch's pixels come by an equi-join on their coordinates; what lies outside the image is filled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import shuffled

Embedding = Callable[[np.ndarray], np.ndarray]

#: Channel means and deviations of the usual normaliser.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def patch_pixels(corners: DataFrame, px: DataFrame, patch: int, fill: int = 255, only: DataFrame | None = None, degrees: float = 0) -> DataFrame:
    """corners(image_id, *keys, top, left) -> the same with data array<int>: the patch's r, g, b, row by row.

    only: a label map; pixels of other instances than the corner's `label` are filled too. degrees: the patch turned counter-clockwise around its centre: each of its places takes the nearest pixel of the image at the place it
    comes from, so its corners show what lies around the upright patch, not `fill`.
    """
    keys = corners.columns
    span = F.explode(F.sequence(F.lit(0), F.lit(patch - 1)))
    at = corners.withColumn("_ty", span).withColumn("_tx", span)
    c, angle = (patch - 1) / 2, float(np.deg2rad(degrees))
    y, x = F.col("_ty") - c, F.col("_tx") - c
    # Sines and cosines that are nearly 0 or 1 would round places off by one at right angles.
    cos, sin = round(float(np.cos(angle)), 12), round(float(np.sin(angle)), 12)
    at = at.withColumn("y", (F.col("top") + F.rint(cos * y + sin * x + c)).cast("int")).withColumn("x", (F.col("left") + F.rint(-sin * y + cos * x + c)).cast("int"))
    met = at.join(shuffled(px.select("image_id", "y", "x", "r", "g", "b")), ["image_id", "y", "x"], "left")
    keep = F.lit(True)
    if only is not None:
        met = met.join(shuffled(only.select("image_id", "y", "x", F.col("label").alias("_there"))), ["image_id", "y", "x"], "left")
        keep = F.coalesce(F.col("_there") == F.col("label"), F.lit(False))
    value = [F.coalesce(F.when(keep, F.col(c)), F.lit(fill)).cast("int").alias(c) for c in "rgb"]
    place = (F.col("_ty") * patch + F.col("_tx")).cast("int").alias("at")
    cells = met.select(*keys, F.struct(place, *value).alias("cell")).groupBy(*keys).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return cells.select(*keys, F.flatten(F.transform("cells", lambda c: F.array(c["r"], c["g"], c["b"]))).alias("data"))


def turned(batch: np.ndarray, degrees: float, fill: float) -> np.ndarray:
    """Patches turned counter-clockwise: right angles exactly, others around the centre by the nearest pixel, with `fill` where nothing is."""
    if degrees % 90 == 0:
        return np.rot90(batch, int(degrees // 90) % 4, (1, 2))
    n = batch.shape[1]
    c, t = (n - 1) / 2, np.deg2rad(degrees)
    y, x = np.mgrid[:n, :n] - c
    sy, sx = np.rint(np.cos(t) * y + np.sin(t) * x + c).astype(int), np.rint(-np.sin(t) * y + np.cos(t) * x + c).astype(int)
    inside = (sy >= 0) & (sy < n) & (sx >= 0) & (sx < n)
    out = np.full_like(batch, fill)
    out[:, inside] = batch[:, sy[inside], sx[inside]]
    return out


def augmentations(rotations: list[float] | None, flips: list[str] | None) -> list[tuple[float, str]]:
    """Rotations times flips (n none, h left-right, v up-down), rotations first."""
    return [(d, f) for d in rotations or [0] for f in flips or ["n"]]


def embed(patches: DataFrame, patch: int, fn: Embedding, means=MEANS, deviations=DEVIATIONS, augs: list[tuple[float, str]] = ((0, "n"),), fill: int = 255, batch: int = 32, dtype: type = np.float32) -> DataFrame:
    """patches(*keys, data) -> *keys, aug, feat: the embedding of every patch under every augmentation, in and from numbers of `dtype` (np.float32 or np.float64)."""
    keys = [c for c in patches.columns if c != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema if f.name != "data") + f", aug int, feat array<{'float' if dtype is np.float32 else 'double'}>"
    mean, dev = np.array(means, dtype), np.array(deviations, dtype)
    flip = {"n": lambda x: x, "h": lambda x: x[:, :, ::-1], "v": lambda x: x[:, ::-1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                raw = np.asarray(part.column("data").flatten()).reshape(len(part), patch, patch, 3).astype(dtype)
                for k, (degrees, f) in enumerate(augs):
                    x = (flip[f](turned(raw, degrees, fill)) / dtype(255) - mean) / dev
                    feats = np.asarray(fn(np.ascontiguousarray(x)), dtype)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * feats.shape[1]), pa.array(feats.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(np.full(len(part), k, np.int32)), lists], names=[*keys, "aug", "feat"])

    return patches.select(*keys, "data").mapInArrow(run, schema)


def seen(corners: DataFrame, px: DataFrame, patch: int, fn: Embedding, augs: list[tuple[float, str]] = ((0, "n"),), only: DataFrame | None = None, drop: tuple[str, ...] = (), fill: int = 255, **how) -> DataFrame:
    """corners(image_id, *keys, top, left) -> keys, aug, feat. Right angles turn the upright patch; any other angle is read from the image as a patch of its own."""
    angles = sorted({0.0 if d % 90 == 0 else float(d) for d, _ in augs})
    out = None
    for angle in angles:
        own = [(k, (d if angle == 0 else 0, f)) for k, (d, f) in enumerate(augs) if (0.0 if d % 90 == 0 else float(d)) == angle]
        part = embed(patch_pixels(corners, px, patch, fill, only, angle).drop(*drop), patch, fn, augs=[a for _, a in own], fill=fill, **how)
        part = part.withColumn("aug", F.element_at(F.array(*[F.lit(k) for k, _ in own]), F.col("aug") + 1))
        out = part if out is None else out.unionByName(part)
    return out


def mean_features(embedded: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The mean embedding of the patches of a key."""
    return embedded.groupBy(*keys).agg(F.array(*[F.avg(F.col("feat")[i].cast("double")) for i in range(width)]).alias("feat"))


def instance_features(centers: DataFrame, px: DataFrame, patch: int, fn: Embedding, width: int, label_map: DataFrame | None = None, augs: list[tuple[float, str]] = ((0, "n"),), **how) -> DataFrame:
    """image_id, label, aug, feat: the mean embedding of an instance's patches, centres (image_id, label, px, py) as `raster.instance_patches` gives them.

    label_map: mask other instances. Instances without an accepted patch have no row.
    """
    corners = centers.select("image_id", "label", (F.col("py") - patch // 2).alias("top"), (F.col("px") - patch // 2).alias("left"))
    return mean_features(seen(corners, px, patch, fn, augs, label_map, **how), ["image_id", "label", "aug"], width)


def grid_corners(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """images(image_id, height, width) -> image_id, row, col, top, left of a grid over the image, padded so that strides end at its edge (the larger half first)."""
    from tessera.operators.raster import pad_sizes

    def steps(size: Column) -> tuple[Column, Column]:
        before, after = pad_sizes(size, patch, stride)
        return before, F.sequence(F.lit(0), ((size + before + after - patch) / stride).cast("int"))

    (above, rows), (aside, cols) = steps(F.col("height")), steps(F.col("width"))
    grid = images.select("image_id", above.alias("a"), aside.alias("b"), F.explode(rows).alias("row"), cols.alias("cols")).withColumn("col", F.explode("cols"))
    return grid.select("image_id", "row", "col", (F.col("row") * stride - F.col("a")).alias("top"), (F.col("col") * stride - F.col("b")).alias("left"))


def grid_features(images: DataFrame, px: DataFrame, patch: int, stride: int, fn: Embedding, augs: list[tuple[float, str]] = ((0, "n"),), **how) -> DataFrame:
    """image_id, row, col, aug, feat: the feature cube."""
    return seen(grid_corners(images, patch, stride), px, patch, fn, augs, drop=("top", "left"), **how)


def masked_grid_features(images: DataFrame, px: DataFrame, mask: DataFrame, patch: int, stride: int, fn: Embedding, least: float = 0.1, **how) -> DataFrame:
    """The feature cube with the share of tissue of every patch and whether it is enough; mask(image_id, y, x) holds tissue pixels, padding is none."""
    corners = grid_corners(images, patch, stride)
    span = lambda c: F.explode(F.sequence(F.greatest(F.col(c), F.lit(0)), F.col(c) + patch - 1))
    cells = corners.withColumn("y", span("top")).withColumn("x", span("left")).select("image_id", "row", "col", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    share = cells.join(shuffled(mask.select("image_id", "y", "x")), ["image_id", "y", "x"]).groupBy("image_id", "row", "col").agg((F.count("*") / float(patch * patch)).alias("fraction"))
    feats = embed(patch_pixels(corners, px, patch).drop("top", "left"), patch, fn, **how)
    out = feats.join(share, ["image_id", "row", "col"], "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    return out.withColumn("is_valid", F.col("fraction") >= least)


def stitch(patches: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """patches(image_id, top, left, data array of size * size values) -> image_id, y, x, v inside the image; patches must not overlap."""
    cell = patches.select("image_id", "top", "left", F.posexplode("data").alias("at", "v"))
    out = cell.select("image_id", (F.col("top") + F.floor(F.col("at") / size)).cast("int").alias("y"), (F.col("left") + F.col("at") % size).cast("int").alias("x"), "v")
    return out.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def pooled(layer: Column, channels: int) -> Column:
    """The mean of each channel of a layer's values (channel by channel)."""
    n = F.size(layer) / channels
    mean = lambda k: F.aggregate(F.slice(layer, k * n.cast("int") + 1, n.cast("int")), F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), mean)


def architecture_name(c: str) -> Column:
    """A model's name without characters that paths forbid: `MLflow(experiment, run, metric)` or `MLflow(experiment, name)` of s3 model stores, `Local(..)` of files, others as they are."""
    name = F.col(c)
    parts = F.split(F.substring(name, 6, 1 << 30), "/")
    inside = F.when(F.size(parts) == 5, F.concat_ws(",", *[F.get(parts, F.lit(k)) for k in (1, 2, 4)])).when(F.size(parts) == 4, F.concat_ws(",", *[F.get(parts, F.lit(k)) for k in (1, 3)])).otherwise(F.array_join(parts, ","))
    return F.when(name.startswith("s3://mlflow"), F.concat(F.lit("MLflow("), inside, F.lit(")"))).when(name.endswith(".pth"), F.concat(F.lit("Local("), F.replace(name, F.lit("/"), F.lit("_")), F.lit(")"))).otherwise(name)
