"""Graphs built in one call, painted draw lists, metrics as a protocol, and files of one name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import HEIGHT as H
from tessera.fixtures import LAB, PX
from tessera.fixtures import WIDTH as Wd
from tessera.operators import builder as B
from tessera.operators import draw as D
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import paint as K
from tessera.operators import raster as P

from . import query
from .graph import _rag

# Label map, annotation and features are tables of their own: the features of a region are its mean colours.
_CEN = "cen AS (SELECT image_id, label, avg(x) AS x, avg(y) AS y, avg(r) AS f0, avg(g) AS f1, avg(b) AS f2 FROM lab GROUP BY ALL)"
_MAJ = f"hi AS (SELECT image_id, label, cls, count(*) AS n FROM lab WHERE cls <> {X.BACKGROUND} GROUP BY ALL), maj AS (SELECT image_id, label, arg_max(cls, n * 1000 - cls) AS cls FROM hi GROUP BY ALL)"


def _tables(spark, sf):
    lab = X.labels(X.pixels(spark, sf))
    features = lab.groupBy("image_id", "label").agg(F.array(F.avg("r"), F.avg("g"), F.avg("b")).alias("feat"))
    return lab.select(*P.AT, "label"), features, lab.select(*P.AT, "cls")


@query(
    f"WITH {PX}, {LAB}, {_CEN}, {_MAJ} SELECT image_id AS graph_id, row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS node_id, label, round_even(x, 0) AS x, round_even(y, 0) AS y, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2,"
    f" round(round_even(x, 0) / {Wd}, 6) AS f3, round(round_even(y, 0) / {H}, 6) AS f4, coalesce(cls, {X.BACKGROUND}) AS cls FROM cen LEFT JOIN maj USING (image_id, label)"
)
def graph_builder_nodes(spark, sf):
    nodes, _ = B.build(*_tables(spark, sf), classes=X.CLASSES, background=X.BACKGROUND, location=True, size=(H, Wd))
    return nodes.select("graph_id", "node_id", "label", "x", "y", *[F.round(F.col("feat")[k], 6).alias(f"f{k}") for k in range(5)], "cls")


@query(f"WITH {PX}, {LAB}, e AS ({_rag('lab')}), n AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS id FROM (SELECT DISTINCT image_id, label FROM lab)) SELECT e.image_id AS graph_id, a.id AS src, b.id AS dst FROM e JOIN n a ON a.image_id = e.image_id AND a.label = e.src JOIN n b ON b.image_id = e.image_id AND b.label = e.dst")
def graph_builder_edges(spark, sf):
    return B.build(*_tables(spark, sf), classes=X.CLASSES, background=X.BACKGROUND)[1]


# Nodes are disks of radius 3, edges lines of thickness 2 below them; colours tell what is on top.
@query(
    f"WITH {PX}, {LAB}, {_CEN}, e AS ({_rag('lab')}), d AS (SELECT p.image_id, p.y, p.x FROM px p JOIN cen c ON c.image_id = p.image_id AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 9 GROUP BY ALL),"
    " s AS (SELECT e.image_id, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM e JOIN cen a ON a.image_id = e.image_id AND a.label = e.src JOIN cen b ON b.image_id = e.image_id AND b.label = e.dst WHERE e.src < e.dst),"
    " l AS (SELECT p.image_id, p.y, p.x FROM px p JOIN s ON s.image_id = p.image_id AND p.x BETWEEN least(x1, x1 + dx) - 1 AND greatest(x1, x1 + dx) + 1 AND p.y BETWEEN least(y1, y1 + dy) - 1 AND greatest(y1, y1 + dy) + 1"
    "  WHERE CASE WHEN (p.x - x1) * dx + (p.y - y1) * dy <= 0 THEN (p.x - x1) ** 2 + (p.y - y1) ** 2 <= 1 WHEN (p.x - x1) * dx + (p.y - y1) * dy >= dx * dx + dy * dy THEN (p.x - x1 - dx) ** 2 + (p.y - y1 - dy) ** 2 <= 1"
    "  ELSE ((p.x - x1) * dy - (p.y - y1) * dx) ** 2 <= dx * dx + dy * dy END GROUP BY ALL)"
    " SELECT px.image_id, px.y, px.x, CASE WHEN d.y IS NOT NULL THEN 255 WHEN l.y IS NOT NULL THEN 0 ELSE r END AS r, CASE WHEN d.y IS NOT NULL THEN 255 WHEN l.y IS NOT NULL THEN 0 ELSE g END AS g,"
    " CASE WHEN d.y IS NOT NULL THEN 0 WHEN l.y IS NOT NULL THEN 255 ELSE b END AS b FROM px LEFT JOIN d USING (image_id, y, x) LEFT JOIN l USING (image_id, y, x)"
)
def painted_graph(spark, sf):
    px = X.pixels(spark, sf)
    lab = X.labels(px)
    nodes = lab.groupBy(F.col("image_id").alias("graph_id"), F.col("label").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    edges = G.region_adjacency(lab, G.offsets(3)).filter("src < dst").withColumnRenamed("image_id", "graph_id")
    shapes = D.overlay(D.edge_list(edges, nodes), D.node_list(nodes, radius=[3], style="fill"))
    return K.painted(px.select(*P.AT, "r", "g", "b"), shapes, H, Wd)


@query("SELECT part.p_partkey // 250 AS graph_id, p_partkey AS node_id, p_partkey = max(p_partkey) OVER (PARTITION BY p_partkey // 250) AS is_last FROM part")
def last_of_graph(spark, sf):
    return B.last_flagged(X.points(spark, sf).select("graph_id", "node_id"), ["graph_id"], ["node_id"])


@query("SELECT 'g' || p_partkey AS name, 'graphs/g' || p_partkey || '.bin' AS graph_path, CASE WHEN s_suppkey IS NOT NULL THEN 'images/g' || p_partkey || '.png' END AS image_path FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def files_by_name(spark, sf):
    graphs = X.table(spark, sf, "part").select(F.format_string("graphs/g%d.bin", "p_partkey").alias("graph_path"))
    images = X.table(spark, sf, "supplier").select(F.explode(F.array(F.format_string("images/g%d.png", "s_suppkey"), F.format_string("zips/g%d.jpg", "s_suppkey"))).alias("image_path"))
    return B.by_name(graphs, images)


@query(f"WITH {PX}, v AS (SELECT image_id, avg((cls = r // 26)::INT) AS v FROM px GROUP BY 1) SELECT image_id, round(v, 6) AS accuracy, coalesce(v >= max(v) OVER (ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_better FROM v")
def best_so_far(spark, sf):
    """Images as the steps of one run, the share of pixels of the right class as its metric."""
    values = X.pixels(spark, sf).groupBy("image_id").agg(F.avg((F.col("cls") == F.floor(F.col("r") / 26)).cast("int")).alias("v"))
    return M.best(values.withColumn("run", F.lit(0)), ["run"], "image_id", "v").select("image_id", F.round("v", 6).alias("accuracy"), "is_better")
