"""Watershed over tiles: images larger than a task, flooded tile by tile until no border changes."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import cut, drop, shuffled

from .raster import AT

TILE = ["image_id", "ty", "tx"]


def _flood(tile: int, whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Floods a tile from its markers and from what is known of the pixels around it.

    A pixel is reached at (pass, steps): the highest value on the way to it, and the steps since that was last raised. The front's least (pass, steps, label) goes on first,
    and a pixel takes the label that touches it first.
    """

    def run(own: pa.Table, around: pa.Table) -> pa.Table:
        ys, xs, vs, marks = (own.column(c).to_pylist() for c in ("y", "x", "v", "mark"))
        out: list[tuple] = []
        if ys:
            image, ty, tx = (own.column(c)[0] for c in TILE)
            wide, top, left = tile + 2, ty.as_py() * tile - 1, tx.as_py() * tile - 1
            value: list = [None] * (wide * wide)
            label: list = [None] * (wide * wide)
            reached: list = [None] * (wide * wide)
            heap = []
            for y, x, v, m in zip(ys, xs, vs, marks):
                at = (y - top) * wide + x - left
                value[at] = v
                if m is not None:
                    label[at], reached[at] = m, (v, 0)
                    heap.append((v, 0, m, at))
            for y, x, v, s, m in zip(*(around.column(c).to_pylist() for c in ("y", "x", "pass", "steps", "label"))):
                heap.append((v, s, m, (y - top) * wide + x - left))
            heapq.heapify(heap)
            while heap:
                v, s, m, at = heapq.heappop(heap)
                row, column = divmod(at, wide)
                for to, inside in ((at - wide, row > 1), (at - 1, column > 1), (at + 1, column < tile), (at + wide, row < tile)):
                    if inside and 0 <= to < len(value) and value[to] is not None and label[to] is None:
                        label[to], reached[to] = m, ((value[to], 0) if value[to] > v else (v, s + 1))
                        heapq.heappush(heap, (*reached[to], m, to))
            for y, x in zip(ys, xs):
                at = (y - top) * wide + x - left
                if label[at] is not None and (whole or y % tile in (0, tile - 1) or x % tile in (0, tile - 1)):
                    out.append((y, x, *reached[at], label[at]))
        names = ("y", "x", "pass", "steps", "label")
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), own.schema.field("mark").type]
        columns = {n: pa.array(c, k) for n, c, k in zip(names, zip(*out) if out else [[]] * 5, kinds)}
        keys = {c: pa.array([own.column(c)[0].as_py() if out else None] * len(out), own.schema.field(c).type) for c in TILE}
        return pa.table(keys | columns)

    return run


def watershed_tiles(px: DataFrame, markers: DataFrame, mask: DataFrame | None = None, tile: int = 256) -> DataFrame:
    """px(image_id, y, x, v), markers(image_id, y, x, label): labels grown from the markers over the pixels (of the mask), lowest v first -> image_id, y, x, label.

    Tiles are flooded on their own; labels, passes and steps of pixels at their borders are then sources for the tiles beside them, which are flooded anew until no border
    changes. A pixel's pass only falls and its label follows, so rounds are at most the tiles on the longest way from a marker, and each is over the tiles that saw a change.

    Where values differ this is the priority flood of `tissue.watershed`. Pixels that ways of one pass reach are shared by steps, then by the smaller label; the order of arrival, which only a flood of the whole image knows,
    plays no part. Pixels without a value and those that no marker reaches have no row; a pixel marked twice has its smallest label; values count as doubles.
    """
    if mask is not None:
        px = px.join(shuffled(mask.select(*AT).distinct()), AT, "left_semi")
    marks = markers.groupBy(*AT).agg(F.min("label").alias("mark"))
    tiles = [F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("y", "ty"), ("x", "tx"))]
    at = [F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")]
    base = cut(px.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))).join(shuffled(marks), AT, "left").select("image_id", *tiles, *at, F.col("v").cast("double").alias("v"), "mark"), "tiles")
    kind = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = f"image_id {kind['image_id']}, ty int, tx int, y int, x int, pass double, steps long, label {kind['mark']}"
    flooded = lambda rows, around, whole: rows.groupBy(*TILE).cogroup(around.groupBy(*TILE)).applyInArrow(_flood(tile, whole), schema)
    # The tiles beside a border pixel.
    beside = [F.when(c, F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"))) for c, dy, dx in ((F.col("y") % tile == 0, -1, 0), (F.col("y") % tile == tile - 1, 1, 0), (F.col("x") % tile == 0, 0, -1), (F.col("x") % tile == tile - 1, 0, 1))]
    seen = lambda rows: rows.select("*", F.explode(F.array_compact(F.array(*beside))).alias("to")).select("image_id", "to.ty", "to.tx", "y", "x", "pass", "steps", "label")
    known = cut(flooded(base, base.sparkSession.createDataFrame([], schema), False), "borders")
    changed = known
    while True:
        open_ = cut(seen(changed).select(*TILE).distinct().join(shuffled(base.select(*TILE).distinct()), TILE, "left_semi"), "open")
        if changed is not known:
            drop(changed)
        if open_.isEmpty():
            break
        new = cut(flooded(base.join(shuffled(open_), TILE, "left_semi"), seen(known).join(shuffled(open_), TILE, "left_semi"), False), "borders")
        changed = cut(new.exceptAll(known), "changed")
        after = cut(known.join(shuffled(open_), TILE, "left_anti").unionByName(new), "borders")
        drop(open_, known, new)
        known = after
    drop(open_)
    out = cut(flooded(base, seen(known), True).select(*AT, "label"), "flooded")
    drop(base, known)
    return out
