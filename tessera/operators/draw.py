"""Draw lists: what is to be drawn, as tables (z_order, shape, place, colour, size). A writer of any format can follow them row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.raster import boundaries, ramp

#: Red, green and blue of named colours.
NAMED = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255)}
RGB = ("red", "green", "blue")


def named(color: str) -> list[Column]:
    if color not in NAMED:
        raise ValueError(f"no colour {color}; there are {sorted(NAMED)}")
    return [F.lit(v).alias(c) for c, v in zip(RGB, NAMED[color])]


def cycled(items: DataFrame, order: list[str], values: list, name: str, key: str = "graph_id") -> DataFrame:
    """items with the values given to them in turn, by their place in their graph."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return items.withColumn(name, F.array(*map(F.lit, values))[(place % len(values)).cast("int")])


def spread(items: DataFrame, column: str, key: str = "graph_id") -> DataFrame:
    """A numeric column over its range in the graph; equal values become 0."""
    ends = items.groupBy(key).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return items.join(ends, key).withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def _painted(items: DataFrame, color: str | None) -> DataFrame:
    """Colours: a named one, or the ramp over the column `value`, spread over the graph."""
    if color is not None:
        return items.withColumns(dict(zip(RGB, [c.cast("int") for c in named(color)])))
    out = spread(items, "value")
    return out.withColumns(dict(zip(RGB, ramp(F.lit(0.0), F.lit(1.0), F.col("value")))))


def node_list(nodes: DataFrame, color: str | None = "yellow", radius: list[int] = (5,), thickness: list[int] = (2,), style: str = "outline") -> DataFrame:
    """nodes(graph_id, node_id, x, y[, value]) -> one circle a node. style: outline or fill (a fill has thickness -1). Without a colour `value` is shown."""
    if style not in ("outline", "fill"):
        raise ValueError("style must be outline or fill")
    out = cycled(cycled(_painted(nodes, color), ["node_id"], list(radius), "radius"), ["node_id"], list(thickness) if style == "outline" else [-1], "thickness")
    return out.select("graph_id", F.lit("circle").alias("shape"), "node_id", "x", "y", "radius", "thickness", *RGB)


def edge_list(edges: DataFrame, nodes: DataFrame, color: str | None = "blue", thickness: list[int] = (2,)) -> DataFrame:
    """edges(graph_id, src, dst[, value]) -> one line an edge, from centre to centre."""
    end = lambda side, n: nodes.select("graph_id", F.col("node_id").alias(side), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    met = edges.join(end("src", 1), ["graph_id", "src"]).join(end("dst", 2), ["graph_id", "dst"])
    out = cycled(_painted(met, color), ["src", "dst"], list(thickness), "thickness")
    return out.select("graph_id", F.lit("line").alias("shape"), "src", "dst", "x1", "y1", "x2", "y2", "thickness", *RGB)


def instance_overlay(px: DataFrame, label_map: DataFrame, style: str = "outline", color: str = "yellow", alpha: float = 0.5) -> DataFrame:
    """px(image_id, y, x, r, g, b) with instances drawn: thick borders in a colour, and, if the style names fill, each instance mixed with the ramp of its label over the largest one.

    label_map is dense, 0 where there is none. The canvas's share is cut to whole numbers before the colour is added, and so is the sum.
    """
    out = px.join(label_map.select("image_id", "y", "x", "label"), ["image_id", "y", "x"])
    if "outline" in style:
        edge = boundaries(label_map.select("image_id", "y", "x", "label")).select("image_id", "y", "x").distinct().withColumn("edge", F.lit(True))
        paint = dict(zip("rgb", NAMED[color]))
        out = out.join(edge, ["image_id", "y", "x"], "left").withColumns({c: F.when(F.col("edge"), v).otherwise(F.col(c)) for c, v in paint.items()})
    if "fill" in style:
        top = label_map.groupBy("image_id").agg(F.max("label").alias("top"))
        tone = dict(zip("rgb", ramp(F.lit(0.0), F.lit(1.0), F.coalesce(F.try_divide("label", "top"), F.lit(0.0)))))
        out = out.join(top, "image_id").withColumns({c: F.floor(F.floor(F.col(c) * (1 - alpha)) + tone[c] * alpha).cast("int") for c in "rgb"})
    return out.select("image_id", "y", "x", "r", "g", "b")


def overlay(edges: DataFrame, nodes: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """One list in drawing order: instances (0), edges (1), nodes (2)."""
    parts = [t.withColumn("z_order", F.lit(k)) for k, t in enumerate((instances, edges, nodes)) if t is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def hierarchy(cells: DataFrame, cell_edges: DataFrame, tissue: DataFrame, tissue_edges: DataFrame, tissue_map: DataFrame, color: str | None = None) -> DataFrame:
    """Cells and their edges, then tissue nodes and theirs, in one list. Without a colour a cell has that of the tissue label at its centre (background 0)."""
    if color is None:
        at = cells.withColumn("_y", F.floor("y").cast("int")).withColumn("_x", F.floor("x").cast("int"))
        there = tissue_map.select(F.col("image_id").alias("graph_id"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("label").cast("double").alias("value"))
        cells = at.join(there, ["graph_id", "_y", "_x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).drop("_y", "_x")
    low = overlay(edge_list(cell_edges, cells), node_list(cells, color))
    high = overlay(edge_list(tissue_edges, tissue, "red"), node_list(tissue, "red", [10]))
    return low.unionByName(high.withColumn("z_order", F.col("z_order") + 2))
