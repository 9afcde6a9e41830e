"""Draw lists painted onto pixels: shapes are cut to scan lines, scan lines to pixels, and of what covers a pixel the topmost shows.

A shape's rows and the interval it covers in each follow from its figures, so it makes about as many rows as it covers pixels, however large its box is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import AT

#: Intervals are this much wider than computed; the exact test follows.
SLACK = 1e-6


def _rows(shapes: DataFrame, low: Column, high: Column, height: int) -> DataFrame:
    """Every pixel row between two heights, inside the canvas."""
    first, last = F.greatest(F.ceil(low - SLACK), F.lit(0)), F.least(F.floor(high + SLACK), F.lit(height - 1))
    return shapes.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last").withColumn("_y", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _across(rows: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    first, last = F.greatest(F.ceil(low - SLACK), F.lit(0)), F.least(F.floor(high + SLACK), F.lit(width - 1))
    return rows.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last").withColumn("_x", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _ellipses(shapes: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels within the ellipse of half-axes rx and ry; with a thickness only those that one smaller by it leaves out."""
    dx, dy, rx, ry, t = F.col("_x") - F.col("x"), F.col("_y") - F.col("y"), F.col("rx"), F.col("ry"), F.col("thickness")
    rows = _rows(shapes, F.col("y") - ry, F.col("y") + ry, height)
    half = rx * F.sqrt(F.greatest(1 - dy * dy / (ry * ry), F.lit(0.0)))
    cells = _across(rows, F.col("x") - half, F.col("x") + half, width)
    within = lambda a, b: dx * dx * (b * b) + dy * dy * (a * a) <= a * a * (b * b)
    hollow = (t >= 0) & (rx > t) & (ry > t) & within(rx - t, ry - t)
    return cells.filter(within(rx, ry) & ~hollow)


def _lines(shapes: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels within half the thickness of the segment from (x1, y1) to (x2, y2)."""
    dx, dy, r = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("thickness") / 2.0
    square = dx * dx + dy * dy
    rows = _rows(shapes, F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, height)
    ends = F.least("x1", "x2") - r, F.greatest("x1", "x2") + r
    # The strip around the line crosses a row in an interval; one along the row is bounded by its ends.
    middle, half = F.col("x1") + (F.col("_y") - F.col("y1")) * dx / dy, r * F.sqrt(square) / F.abs(dy)
    low, high = (F.when(dy == 0, e).otherwise(f(e, m)) for e, f, m in ((ends[0], F.greatest, middle - half), (ends[1], F.least, middle + half)))
    cells = _across(rows, low, high, width)
    px, py = F.col("_x") - F.col("x1"), F.col("_y") - F.col("y1")
    along, off = px * dx + py * dy, px * dy - py * dx
    past = F.col("_x") - F.col("x2"), F.col("_y") - F.col("y2")
    near = F.when(along <= 0, px * px + py * py <= r * r).when(along >= square, past[0] * past[0] + past[1] * past[1] <= r * r).otherwise(off * off <= r * r * square)
    return cells.filter(near)


def _polygons(shapes: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels inside the polygon of `points`, by the even-odd rule; on an edge, those whose right side is inside."""
    ends = F.zip_with("points", F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(1))), F.slice("points", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ends = F.filter(ends, lambda e: e["b"].isNotNull() & e["a"].isNotNull())
    told = shapes.filter(F.size("points") > 2).withColumn("_ends", ends)
    ys = F.transform("points", lambda p: p["y"])
    rows = _rows(told, F.array_min(ys), F.array_max(ys), height)
    met = F.filter("_ends", lambda e: (e["a"]["y"] <= F.col("_y")) != (e["b"]["y"] <= F.col("_y")))
    cuts = F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (F.col("_y") - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    spans = rows.withColumn("_cuts", cuts).filter(F.size("_cuts") > 1).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2, F.lit(2))))
    low, high = F.get("_cuts", F.col("_k")), F.get("_cuts", F.col("_k") + 1)
    return _across(spans.withColumn("_low", low).withColumn("_high", high), F.col("_low"), F.col("_high"), width).filter("_x >= _low AND _x < _high").drop("_ends", "_cuts", "_k", "_low", "_high")


def covered(shapes: DataFrame, height: int, width: int, key: str = "graph_id", order: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, x, r, g, b: the colour of the topmost shape at each covered pixel, by z_order, then by the columns of `order`, then by colour.

    shapes: `shape` with its figures: circle (x, y, radius), ellipse (x, y, rx, ry), line (x1, y1, x2, y2) or polygon (points array<struct<x,y>>); `thickness`, under 0 for a filled shape; red, green, blue. Columns that no shape
    needs may be missing; shapes with a null among their figures cover nothing.
    """
    have = set(shapes.columns)
    number = lambda c: (F.col(c) if c in have else F.lit(None)).cast("double")
    own = shapes.select(
        F.col(key).alias("image_id"), "shape", F.struct(*[F.col(c) for c in (("z_order",) if "z_order" in have else ()) + tuple(order)], F.lit(0).alias("_")).alias("_over"), *[F.col(c) for c in ("red", "green", "blue")],
        *[number(c).alias(c) for c in ("x", "y", "x1", "y1", "x2", "y2")], F.coalesce(number("rx"), number("radius")).alias("rx"), F.coalesce(number("ry"), number("radius")).alias("ry"),
        F.coalesce(number("thickness"), F.lit(-1.0)).alias("thickness"), (F.col("points") if "points" in have else F.lit(None).cast("array<struct<x:double,y:double>>")).alias("points"),
    )
    parts = [_ellipses(own.filter("shape IN ('circle', 'ellipse')"), height, width), _lines(own.filter("shape = 'line'"), height, width), _polygons(own.filter("shape = 'polygon'"), height, width)]
    cells = None
    for p in parts:
        p = p.select("image_id", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), "_over", F.struct("red", "green", "blue").alias("_rgb"))
        cells = p if cells is None else cells.unionByName(p)
    top = cells.groupBy(*AT).agg(F.max(F.struct("_over", "_rgb")).alias("_top"))
    return top.select(*AT, *[F.col(f"_top._rgb.{c}").cast("int").alias(n) for c, n in (("red", "r"), ("green", "g"), ("blue", "b"))])


def painted(px: DataFrame, shapes: DataFrame, height: int, width: int, key: str = "graph_id", order: tuple[str, ...] = ()) -> DataFrame:
    """px(image_id, y, x, r, g, b) with a draw list painted onto it."""
    over = covered(shapes, height, width, key, order).select(*AT, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    return px.join(over, AT, "left").select(*AT, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in "rgb"])
