"""Patch features with embeddings that SQL can state, stitching, and draw lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import IRR, LAB, LINKS, NODES, PX
from tessera.operators import draw as D
from tessera.operators import patches as A
from tessera.operators import raster as P
from tessera.operators import regions as R

from . import query
from .raster import _INST, H, Wd

_N = lambda c: "(coalesce({c}, 255) / 255.0::DOUBLE - {m}) / {d}".format(c=c, m=dict(zip("rgb", A.MEANS))[c[-1]], d=dict(zip("rgb", A.DEVIATIONS))[c[-1]])


#: Figures are taken in doubles, as SQL takes them.
DOUBLE = {"dtype": np.float64}


def means(x):
    """A patch's embedding: its channels' means."""
    return x.mean((1, 2))


def corner(x):
    """A patch's embedding: its first pixel."""
    return x[:, 0, 0]


def long(df, *keys):
    return df.select(*keys, *[F.round(F.col("feat")[k].cast("double"), 3).alias(f"f{k}") for k in range(3)])


def instances(spark, sf, **how):
    px = X.pixels(spark, sf)
    lab = X.labels(px, dense=False)
    centers = P.instance_patches(R.region_props(lab), lab, 8, 4)
    return A.instance_features(centers, px, 8, means, 3, lab.select(*P.AT, "label") if how.pop("masked", False) else None, **DOUBLE, **how)


_CELLS = f"{_INST}, ce8 AS (SELECT image_id, label, px AS cx, py AS cy, px - 4 + dx AS x, py - 4 + dy AS y FROM ip, unnest(range(8)) a(dx), unnest(range(8)) b(dy))"
_PER = lambda src: f"pf AS (SELECT image_id, label, cx, cy, {', '.join(f'avg({_N(c)}) AS m{k}' for k, c in enumerate('rgb'))} FROM {src} GROUP BY ALL) SELECT image_id, label, 0 AS aug, {', '.join(f'round(avg(m{k}), 3) AS f{k}' for k in range(3))} FROM pf GROUP BY image_id, label"


@query(f"WITH {PX}, {LAB}, {IRR}, {_CELLS}, {_PER('(SELECT c.*, r, g, b FROM ce8 c LEFT JOIN px USING (image_id, y, x))')}")
def deep_instance_features(spark, sf):
    return long(instances(spark, sf), "image_id", "label", "aug")


@query(f"WITH {PX}, {LAB}, {IRR}, {_CELLS}, {_PER('(SELECT c.image_id, c.label, cx, cy, i.r, i.g, i.b FROM ce8 c LEFT JOIN irr i ON i.image_id = c.image_id AND i.y = c.y AND i.x = c.x AND i.label = c.label)')}")
def masked_instance_features(spark, sf):
    return long(instances(spark, sf, masked=True), "image_id", "label", "aug")


def images(spark, sf):
    """All images are of one size, whatever pixels they hold."""
    return X.pixels(spark, sf).select("image_id", F.lit(H).alias("height"), F.lit(Wd).alias("width")).distinct()


# Patches of 12 with stride 10 over 40 x 160: 2 pixels are missing below and aside, so 1 is added on each side.
_GRID = f"gr AS (SELECT image_id, row, col, row * 10 - 1 + dy AS y, col * 10 - 1 + dx AS x, dy, dx FROM (SELECT DISTINCT image_id FROM px), unnest(range({H} // 10)) a(row), unnest(range({Wd} // 10)) b(col), unnest(range(12)) c(dy), unnest(range(12)) d(dx)), gp AS (SELECT g.*, r, g, b FROM gr g LEFT JOIN px USING (image_id, y, x))"


@query(f"WITH {PX}, {_GRID} SELECT image_id, row, col, 0 AS aug, {', '.join(f'round(avg({_N(c)}), 3) AS f{k}' for k, c in enumerate('rgb'))} FROM gp GROUP BY image_id, row, col".replace("g.*, r, g, b", "g.*, px.r, px.g, px.b"))
def grid_deep_features(spark, sf):
    return long(A.grid_features(images(spark, sf), X.pixels(spark, sf), 12, 10, means, **DOUBLE), "image_id", "row", "col", "aug")


_CORNERS = {0: (0, 0), 1: (0, 11), 2: (0, 11), 3: (11, 11)}


@query(f"WITH {PX}, {_GRID} SELECT image_id, row, col, aug, {', '.join(f'round({_N(c)}, 3) AS f{k}' for k, c in enumerate('rgb'))} FROM gp JOIN (VALUES {', '.join(f'({k}, {y}, {x})' for k, (y, x) in _CORNERS.items())}) t(aug, dy, dx) USING (dy, dx)".replace("g.*, r, g, b", "g.*, px.r, px.g, px.b"))
def augmented_grid_features(spark, sf):
    """Turns of 0 and 90 degrees, plain and mirrored; a turn brings the upper right pixel first, mirrored the lower right one."""
    return long(A.grid_features(images(spark, sf), X.pixels(spark, sf), 12, 10, corner, A.augmentations([0, 90], ["n", "h"]), **DOUBLE), "image_id", "row", "col", "aug")


@query(f"WITH {PX}, {_GRID} SELECT image_id, row, col, {', '.join(f'round(avg({_N(c)}), 3) AS f{k}' for k, c in enumerate('rgb'))}, round(count(*) FILTER (r >= 180) / 144, 6) AS fraction, count(*) FILTER (r >= 180) / 144 >= 0.1 AS is_valid FROM gp GROUP BY image_id, row, col".replace("g.*, r, g, b", "g.*, px.r, px.g, px.b"))
def masked_grid_deep_features(spark, sf):
    px = X.pixels(spark, sf)
    out = A.masked_grid_features(images(spark, sf), px, px.filter("r >= 180"), 12, 10, means)
    return out.withColumn("fraction", F.round("fraction", 6)).select("image_id", "row", "col", *[F.round(F.col("feat")[k].cast("double"), 3).alias(f"f{k}") for k in range(3)], "fraction", "is_valid")


@query(f"WITH {PX} SELECT image_id, y, x, r AS v FROM px WHERE y < 35 AND x < 150")
def stitch_patches(spark, sf):
    """Tiles of 8 x 8, each with its values as a list, put together and cropped."""
    tiles = P.grid_patches(X.pixels(spark, sf), 8, 8, H, Wd).groupBy("image_id", "row", "col").agg(F.array_sort(F.collect_list(F.struct("py", "px", "r"))).alias("t"))
    return A.stitch(tiles.select("image_id", (F.col("row") * 8).alias("top"), (F.col("col") * 8).alias("left"), F.col("t.r").alias("data")), 8, 35, 150)


@query("SELECT vec_id, CAST(unnest(range(4)) AS INT) AS channel, round(list_avg(list_transform(embedding[unnest(range(4)) * 16 + 1:unnest(range(4)) * 16 + 16], lambda x: x::DOUBLE)), 6) AS v FROM embeddings")
def channel_pooling(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.posexplode(A.pooled(F.col("e"), 4)).alias("channel", "v")).withColumn("v", F.round("v", 6))


@query("SELECT * FROM (VALUES ('s3://mlflow/7/run/artifacts/x', 'MLflow(7,run,x)'), ('s3://mlflow/7/artifacts/x', 'MLflow(7,x)'), ('models/a/net.pth', 'Local(models_a_net.pth)'), ('resnet18', 'resnet18')) t(place, name)")
def architecture_names(spark, sf):
    return spark.createDataFrame([("s3://mlflow/7/run/artifacts/x",), ("s3://mlflow/7/artifacts/x",), ("models/a/net.pth",), ("resnet18",)], "place string").select("place", A.architecture_name("place").alias("name"))


# Draw lists.

_RAMP = lambda t: ", ".join((f"CAST(greatest(0, floor(255 * (2 * {t} - 1))) AS INT) AS red", f"CAST(255 - greatest(0, floor(255 * (1 - 2 * {t}))) - greatest(0, floor(255 * (2 * {t} - 1))) AS INT) AS green", f"CAST(greatest(0, floor(255 * (1 - 2 * {t}))) AS INT) AS blue"))
_NL = f"nl AS (SELECT graph_id, 'circle' AS shape, node_id, x, y, [5, 7][((row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1) % 2 + 1)::INT] AS radius, [1, 2, 3][((row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1) % 3 + 1)::INT] AS thickness, {_RAMP('t')} FROM (SELECT *, coalesce((x - min(x) OVER g) / nullif(max(x) OVER g - min(x) OVER g, 0), 0) AS t FROM pts WINDOW g AS (PARTITION BY graph_id)))"
_EL = "el AS (SELECT l.graph_id, 'line' AS shape, src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, [2, 4][((row_number() OVER (PARTITION BY l.graph_id ORDER BY src, dst) - 1) % 2 + 1)::INT] AS thickness, 0 AS red, 0 AS green, 255 AS blue FROM links l JOIN pts a ON a.node_id = l.src JOIN pts b ON b.node_id = l.dst)"


def _nodes(spark, sf):
    return D.node_list(X.points(spark, sf).withColumn("value", F.col("x")), None, [5, 7], [1, 2, 3])


def _edges(spark, sf):
    return D.edge_list(X.links(spark, sf), X.points(spark, sf), "blue", [2, 4])


@query(f"WITH {NODES}, {_NL} SELECT * FROM nl")
def node_draw_list(spark, sf):
    return _nodes(spark, sf)


@query(f"WITH {NODES}, {LINKS}, {_EL} SELECT * FROM el")
def edge_draw_list(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {NODES}, {LINKS}, {_NL}, {_EL} SELECT graph_id, shape, node_id, src, dst, thickness, red, z_order FROM (SELECT graph_id, shape, node_id, NULL AS src, NULL AS dst, thickness, red, 2 AS z_order FROM nl UNION ALL SELECT graph_id, shape, NULL, src, dst, thickness, red, 1 FROM el)")
def graph_overlay(spark, sf):
    return D.overlay(_edges(spark, sf), _nodes(spark, sf)).select("graph_id", "shape", "node_id", "src", "dst", "thickness", "red", "z_order")


_EDGE = "ed AS (SELECT DISTINCT a.image_id, a.y, a.x FROM l0 a JOIN l0 b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1)) WHERE a.label <> b.label)"


@query(f"WITH {PX}, {LAB}, l0 AS (SELECT image_id, y, x, r, g, b, CASE WHEN r >= 128 THEN label ELSE 0 END AS label FROM lab), {_EDGE}, o AS (SELECT l0.image_id, l0.y, l0.x, CASE WHEN ed.y IS NULL THEN r ELSE 255 END AS r, CASE WHEN ed.y IS NULL THEN g ELSE 255 END AS g, CASE WHEN ed.y IS NULL THEN b ELSE 0 END AS b, label / max(label) OVER (PARTITION BY l0.image_id) AS t FROM l0 LEFT JOIN ed USING (image_id, y, x)), c AS (SELECT *, {_RAMP('t')} FROM o) SELECT image_id, y, x, CAST(floor(floor(r * 0.5) + red * 0.5) AS INT) AS r, CAST(floor(floor(g * 0.5) + green * 0.5) AS INT) AS g, CAST(floor(floor(b * 0.5) + blue * 0.5) AS INT) AS b FROM c")
def instance_overlay(spark, sf):
    lab = X.labels(X.pixels(spark, sf)).select(*P.AT, F.when(F.col("r") >= 128, F.col("label")).otherwise(0).alias("label"))
    return D.instance_overlay(X.pixels(spark, sf), lab, "outline+fill")


@query(f"WITH {PX}, {LAB}, {IRR}, ce AS (SELECT p_partkey % (SELECT count(DISTINCT vec_id // 100) FROM embeddings) AS graph_id, p_partkey AS node_id, p_partkey * 7919 % 160 + 0.5 AS x, p_partkey * 104729 % 40 + 0.25 AS y FROM part), v AS (SELECT ce.graph_id, node_id, coalesce(label, 0)::DOUBLE AS value FROM ce LEFT JOIN irr i ON i.image_id = ce.graph_id AND i.y = floor(ce.y) AND i.x = floor(ce.x)), s AS (SELECT *, coalesce((value - min(value) OVER g) / nullif(max(value) OVER g - min(value) OVER g, 0), 0) AS t FROM v WINDOW g AS (PARTITION BY graph_id)) SELECT graph_id, node_id, 2 AS z_order, 5 AS radius, {_RAMP('t')} FROM s UNION ALL SELECT image_id, label, 4, 10, 255, 0, 0 FROM (SELECT DISTINCT image_id, label FROM irr)")
def hierarchy_overlay(spark, sf):
    from .graph import cells

    lab = X.labels(X.pixels(spark, sf), dense=False)
    low = cells(spark, sf).select(F.col("image_id").alias("graph_id"), "node_id", "x", "y")
    high = R.region_props(lab).select(F.col("image_id").alias("graph_id"), F.col("label").cast("long").alias("node_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    none = low.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")).filter("false")
    return D.hierarchy(low, none, high, none, lab.select(*P.AT, "label")).filter("shape = 'circle'").select("graph_id", "node_id", "z_order", "radius", *D.RGB)
