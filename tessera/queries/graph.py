"""Graphs, regions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import EDGES, IRR, LAB, PTS, PX
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import raster as P
from tessera.operators import regions as R

from . import query

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
Q6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


def edges(spark, sf):
    return G.knn_graph(X.points(spark, sf), 5, 100.0)


@query(f"WITH {PTS}, {EDGES} SELECT graph_id, src, dst, round(dist, 6) AS dist FROM edges")
def knn_graph(spark, sf):
    return edges(spark, sf).select("graph_id", "src", "dst", *R6("dist"))


@query(f"WITH {PTS}, {EDGES.replace('<= 100', '<= 60')} SELECT graph_id, src, dst, round(dist, 6) AS dist FROM edges")
def knn_graph_bucketed(spark, sf):
    return G.knn_graph_bucketed(X.points(spark, sf), 5, 60.0).select("graph_id", "src", "dst", *R6("dist"))


def _rag_sql(source: str, offsets: str) -> str:
    return f"SELECT DISTINCT a.image_id, a.label AS src, b.label AS dst FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND a.label <> b.label AND {offsets}"


_RAG8 = "abs(a.y - b.y) <= 1 AND b.x BETWEEN a.x - 1 AND a.x + 1"
_NEAR8 = "JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON TRUE JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON TRUE"


def _rag(source: str, four: bool = False) -> str:
    keep = " WHERE dy = 0 OR dx = 0" if four else ""
    return f"SELECT DISTINCT a.image_id, a.label AS src, b.label AS dst FROM (SELECT image_id, label, y + dy AS y, x + dx AS x FROM {source} {_NEAR8}{keep}) a JOIN {source} b USING (image_id, y, x) WHERE a.label <> b.label"


@query(f"WITH {PX}, {LAB} {_rag('lab')}")
def rag_graph(spark, sf):
    return G.region_adjacency(X.labels(X.pixels(spark, sf)), G.offsets(3))


@query(f"WITH {PX}, {LAB}, {IRR} {_rag('irr', True)}")
def rag_pixel_connectivity(spark, sf):
    return G.region_adjacency(X.labels(X.pixels(spark, sf), dense=False), G.connectivity(1))


_TWO = "SELECT DISTINCT graph_id, src, dst FROM (SELECT graph_id, src, dst FROM edges UNION ALL SELECT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src) WHERE src <> dst"


@query(f"WITH {PTS}, {EDGES} {_TWO}")
def two_hop(spark, sf):
    return G.hops(edges(spark, sf), 2)


@query(f"WITH {PTS}, {EDGES}, two AS ({_TWO}) SELECT DISTINCT graph_id, src, dst FROM (SELECT * FROM two UNION ALL SELECT a.graph_id, a.src, b.dst FROM two a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src) WHERE src <> dst")
def khop_pairs(spark, sf):
    return G.hops(edges(spark, sf), 3)


_CELLS = "cells AS (SELECT p_partkey % (SELECT count(DISTINCT vec_id // 100) FROM embeddings) AS image_id, p_partkey AS node_id, p_partkey * 7919 % 160 + 0.5 AS x, p_partkey * 104729 % 40 + 0.25 AS y FROM part)"


def cells(spark, sf):
    """Points inside the images."""
    n = X.table(spark, sf, "embeddings").agg(F.countDistinct(F.floor(F.col("vec_id") / 100)).alias("n"))
    k = F.col("p_partkey")
    return X.table(spark, sf, "part").crossJoin(F.broadcast(n)).select((k % F.col("n")).alias("image_id"), k.alias("node_id"), (k * 7919 % 160 + 0.5).alias("x"), (k * 104729 % 40 + 0.25).alias("y"))


_ASSIGN = "asg AS (SELECT c.image_id, c.node_id AS low_id, irr.label AS high_id FROM cells c JOIN irr ON irr.image_id = c.image_id AND irr.y = floor(c.y) AND irr.x = floor(c.x))"


@query(f"WITH {PX}, {LAB}, {IRR}, {_CELLS}, {_ASSIGN} SELECT * FROM asg")
def assignment_pairs(spark, sf):
    return G.assignment(cells(spark, sf), X.labels(X.pixels(spark, sf), dense=False))


@query(f"WITH {PX}, {LAB}, {IRR}, {_CELLS}, {_ASSIGN} SELECT c.image_id, c.node_id AS low_id, h.label AS high_id, CASE WHEN a.low_id IS NULL THEN 0 ELSE 1 END AS assigned FROM cells c JOIN (SELECT DISTINCT image_id, label FROM irr) h USING (image_id) LEFT JOIN asg a ON a.image_id = c.image_id AND a.low_id = c.node_id AND a.high_id = h.label")
def assignment_dense(spark, sf):
    lab, pts = X.labels(X.pixels(spark, sf), dense=False), cells(spark, sf)
    return G.assignment_dense(G.assignment(pts, lab), pts.select("image_id", F.col("node_id").alias("low_id")), lab.select("image_id", F.col("label").alias("high_id")))


@query(f"WITH {PTS} SELECT graph_id, node_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first, round(x / 997, 6) AS rx, round(y / 991, 6) AS ry FROM pts JOIN embeddings e ON e.vec_id = node_id % (SELECT count(*) FROM embeddings)")
def loc_features(spark, sf):
    f = G.with_location(X.nodes(spark, sf), 997.0, 991.0)
    return f.select("graph_id", "node_id", F.round(F.col("feat")[0], 6).alias("first"), F.round(F.col("feat")[64], 6).alias("rx"), F.round(F.col("feat")[65], 6).alias("ry"))


@query(f"WITH {PTS}, {EDGES}, k AS (SELECT * FROM edges WHERE 1 / dist >= 0.04), n AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i FROM (SELECT graph_id, src AS node_id FROM k UNION SELECT graph_id, dst FROM k)) SELECT k.graph_id, a.i AS src, b.i AS dst, round(1 / dist, 6) AS w FROM k JOIN n a ON a.graph_id = k.graph_id AND a.node_id = src JOIN n b ON b.graph_id = k.graph_id AND b.node_id = dst")
def adjacency_threshold(spark, sf):
    kept, _ = G.thresholded(edges(spark, sf).withColumn("w", 1 / F.col("dist")), 0.04)
    return kept.select("graph_id", F.col("src").cast("long"), F.col("dst").cast("long"), *R6("w"))


_GRAPH_CC = "WITH RECURSIVE {pts}, {edges}, e AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges), r(graph_id, node_id, c) AS (SELECT graph_id, node_id, node_id FROM pts UNION SELECT e.graph_id, e.dst, r.c FROM r JOIN e ON e.graph_id = r.graph_id AND e.src = r.node_id AND r.c < e.dst), cc AS (SELECT graph_id, node_id, min(c) AS component FROM r GROUP BY 1, 2)"
_CC = _GRAPH_CC.format(pts=PTS, edges=EDGES.replace("<= 100", "<= 30"))


def _cc(spark, sf):
    pts = X.points(spark, sf)
    return G.components(pts.select("graph_id", "node_id"), G.knn_graph(pts, 5, 30.0))


@query(f"{_CC} SELECT * FROM cc")
def graph_components(spark, sf):
    return _cc(spark, sf)


@query(f"{_CC}, s AS (SELECT graph_id, component, count(*) AS size FROM cc GROUP BY 1, 2) SELECT graph_id, component, size FROM s QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY size DESC, component) = 1")
def largest_component(spark, sf):
    return G.largest_component(_cc(spark, sf))


@query(f"WITH RECURSIVE {PX}, {LAB}, e AS ({_rag('lab')}), r(image_id, root, node, d) AS (SELECT DISTINCT image_id, src, src, 0 FROM e UNION SELECT r.image_id, r.root, e.dst, r.d + 1 FROM r JOIN e ON e.image_id = r.image_id AND e.src = r.node WHERE r.d < 20), m AS (SELECT image_id, root, node, min(d) AS d FROM r GROUP BY 1, 2, 3) SELECT image_id, max(d) AS diameter FROM m GROUP BY 1")
def graph_diameter(spark, sf):
    return G.diameter(G.region_adjacency(X.labels(X.pixels(spark, sf)), G.offsets(3)), "image_id")


# Regions.


def irregular(spark, sf):
    return X.labels(X.pixels(spark, sf), dense=False)


@query(f"WITH {PX}, {LAB}, {IRR} SELECT image_id, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, round_even(avg(x), 0) AS cx, round_even(avg(y), 0) AS cy FROM irr GROUP BY 1, 2")
def region_props(spark, sf):
    return R.region_props(irregular(spark, sf))


@query(f"WITH {PX}, {LAB}, {IRR} SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY label) - 1 AS INT) AS node_id, label, cx, cy FROM (SELECT image_id, label, round_even(avg(x), 0) AS cx, round_even(avg(y), 0) AS cy FROM irr GROUP BY 1, 2)")
def region_centroids(spark, sf):
    return R.with_node_ids(R.region_props(irregular(spark, sf))).select("image_id", "node_id", "label", "cx", "cy")


_HIST = "h AS (SELECT k.image_id, k.label, c.cls, count(i.cls) AS n FROM (SELECT DISTINCT image_id, label FROM irr) k JOIN (SELECT CAST(unnest(range(10)) AS INT) AS cls) c ON TRUE LEFT JOIN irr i ON i.image_id = k.image_id AND i.label = k.label AND i.cls = c.cls GROUP BY 1, 2, 3)"


@query(f"WITH {PX}, {LAB}, {IRR}, {_HIST} SELECT * FROM h")
def label_histogram(spark, sf):
    return R.label_histogram(irregular(spark, sf), X.CLASSES)


@query(f"WITH {PX}, {LAB}, {IRR}, {_HIST} SELECT image_id, label, CASE WHEN max(CASE WHEN cls <> 9 THEN n END) > 0 THEN (arg_max(cls, n * 100 - cls) FILTER (cls <> 9)) ELSE 9 END AS cls FROM h GROUP BY 1, 2")
def majority_annotation(spark, sf):
    return R.majority_class(irregular(spark, sf), X.BACKGROUND)


@query(f"WITH {PX}, {LAB} SELECT image_id, count(DISTINCT CASE WHEN r >= 200 THEN label ELSE 0 END) AS n_labels FROM lab GROUP BY 1")
def superpixel_count(spark, sf):
    return R.distinct_labels(X.labels(X.pixels(spark, sf)).withColumn("label", F.when(F.col("r") >= 200, F.col("label")).otherwise(0)))


@query(f"WITH {PTS}, d AS (SELECT a.graph_id, a.node_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d, b.node_id AS o, count(*) OVER (PARTITION BY a.graph_id, a.node_id) AS n FROM pts a JOIN pts b USING (graph_id)), k AS (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY d, o) AS k FROM d) SELECT graph_id, node_id, round(CASE WHEN max(n) < 3 THEN 0 ELSE avg(d) END, 6) AS mean_crowd, round(CASE WHEN max(n) < 3 THEN 0 ELSE stddev_pop(d) END, 6) AS std_crowd FROM k WHERE k <= greatest(1, CASE WHEN n < 10 THEN n - 1 ELSE least(11, n) END) GROUP BY 1, 2")
def crowdedness(spark, sf):
    return R.crowdedness(X.points(spark, sf)).select("graph_id", "node_id", *R6("mean_crowd", "std_crowd"))


_GLCM = "gl AS (SELECT a.image_id, a.label, a.r AS i, b.r AS j, count(*) AS n FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.label = b.label AND a.y = b.y AND a.x + 1 = b.x WHERE a.r > 0 AND b.r > 0 GROUP BY 1, 2, 3, 4)"


def _gray_labels(spark, sf, dense=True):
    return X.labels(X.pixels(spark, sf), dense).select("image_id", "y", "x", "label", F.col("r").alias("v"))


@query(f"WITH {PX}, {LAB}, {_GLCM} SELECT * FROM gl")
def glcm(spark, sf):
    return R.glcm(_gray_labels(spark, sf))


_PROPS = ["contrast", "dissimilarity", "homogeneity", "asm", "energy", "dispersion"]


@query(f"WITH {PX}, {LAB}, {_GLCM}, s AS (SELECT image_id, label, sum(n) AS t, sum(n*(i-j)*(i-j)) AS c, sum(n*abs(i-j)) AS d, sum(n / (1.0::DOUBLE + (i-j)*(i-j))) AS h, sum(n*n) AS q FROM gl GROUP BY 1, 2), p AS (SELECT l.image_id, l.label, coalesce(c / t, 0) AS contrast, coalesce(d / t, 0) AS dissimilarity, coalesce(h / t, 0) AS homogeneity, coalesce(q / (t * t), 0) AS asm, coalesce(sqrt(q / (t * t)), 0) AS energy, coalesce(sqrt(q / 65025.0::DOUBLE - (t / 65025.0::DOUBLE) ** 2), 0) AS dispersion FROM (SELECT DISTINCT image_id, label FROM lab) l LEFT JOIN s USING (image_id, label)) SELECT image_id, label, {Q6(*_PROPS)} FROM p")
def glcm_props(spark, sf):
    g = _gray_labels(spark, sf)
    return R.glcm_props(R.glcm(g), g).select("image_id", "label", *R6(*_PROPS))


_SHAPE = ["major_axis", "minor_axis", "eccentricity", "orientation", "equivalent_diameter", "extent"]
_MOM = """m AS (SELECT image_id, label, count(*) AS area, (max(y)-min(y)+1)*(max(x)-min(x)+1) AS box, var_pop(x) AS a, var_pop(y) AS c, -covar_pop(x, y) AS b FROM irr GROUP BY 1, 2),
 l AS (SELECT *, (a + c + sqrt(4*b*b + (a-c)*(a-c))) / 2 AS l1, greatest((a + c - sqrt(4*b*b + (a-c)*(a-c))) / 2, 0) AS l2 FROM m),
 shape AS (SELECT image_id, label, area, 4*sqrt(l1) AS major_axis, 4*sqrt(l2) AS minor_axis, CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2/l1, 0)) ELSE 0 END AS eccentricity, CASE WHEN abs(a-c) < 1e-9 THEN CASE WHEN b < 0 THEN pi()/4 ELSE -pi()/4 END ELSE 0.5*atan2(-2*b, c-a) END AS orientation, sqrt(4*area/pi()) AS equivalent_diameter, area / box AS extent FROM l)"""


# A direction is compared by its doubled angle; where the axes are equal it is not defined, and by rounding alone.
_TURN = "CASE WHEN abs(abs(orientation) - pi() / 4) > 1e-6 THEN round({f}(2 * orientation), 6) + 0.0 END"


@query(f"WITH {PX}, {LAB}, {IRR}, {_MOM} SELECT image_id, label, area, {Q6(*[c for c in _SHAPE if c != 'orientation'])}, abs({_TURN.format(f='sin')}) AS turn_sin, {_TURN.format(f='cos')} AS turn_cos FROM shape")
def shape_moments(spark, sf):
    out = R.shape_moments(irregular(spark, sf))
    turn = [F.expr(_TURN.format(f=f)) for f in ("sin", "cos")]
    return out.withColumns({"turn_sin": F.abs(turn[0]), "turn_cos": turn[1]}).select("image_id", "label", "area", *R6(*[c for c in _SHAPE if c != "orientation"]), "turn_sin", "turn_cos")


_EULER = """q AS (SELECT image_id, label, y + dy AS y, x + dx AS x, sum(bit) AS m FROM irr JOIN (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)) o(dy, dx, bit) ON TRUE GROUP BY 1, 2, 3, 4),
 eu AS (SELECT image_id, label, CAST(sum(CASE WHEN m IN (1, 2, 4, 8) THEN 1 WHEN m IN (7, 11, 13, 14) THEN -1 WHEN m IN (6, 9) THEN -2 ELSE 0 END) / 4 AS INT) AS euler_number FROM q GROUP BY 1, 2),
 inn AS (SELECT a.image_id, a.label, a.y, a.x FROM irr a JOIN irr b ON a.image_id = b.image_id AND a.label = b.label AND a.y = b.y AND b.x = a.x + 1 JOIN irr c ON a.image_id = c.image_id AND a.label = c.label AND a.y = c.y AND c.x = a.x - 1 JOIN irr d ON a.image_id = d.image_id AND a.label = d.label AND d.y = a.y + 1 AND d.x = a.x JOIN irr e ON a.image_id = e.image_id AND a.label = e.label AND e.y = a.y - 1 AND e.x = a.x),
 bo AS (SELECT image_id, label, y, x FROM irr EXCEPT SELECT * FROM inn),
 co AS (SELECT a.image_id, a.label, a.y, a.x, 1 + coalesce(sum(CASE WHEN b.x IS NULL THEN 0 WHEN dy = 0 OR dx = 0 THEN 2 ELSE 10 END), 0) AS c FROM (SELECT * FROM bo JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON TRUE JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON TRUE WHERE dy <> 0 OR dx <> 0) a LEFT JOIN bo b ON a.image_id = b.image_id AND a.label = b.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4),
 pe AS (SELECT image_id, label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1.0 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM co GROUP BY 1, 2)"""


@query(f"WITH {PX}, {LAB}, {IRR}, {_EULER} SELECT image_id, label, euler_number, round(perimeter, 6) AS perimeter FROM eu JOIN pe USING (image_id, label)")
def perimeter_euler(spark, sf):
    return R.perimeter_euler(irregular(spark, sf)).select("image_id", "label", "euler_number", *R6("perimeter"))


@query(f"WITH {PX}, {LAB}, {IRR}, {_MOM}, {_EULER} SELECT image_id, label, round(minor_axis / nullif(major_axis, 0), 6) AS ellipticity, round(4*pi()*area / nullif(perimeter*perimeter, 0), 6) AS roundness FROM shape JOIN pe USING (image_id, label)")
def derived_shape(spark, sf):
    lab = irregular(spark, sf)
    return R.derived_shape(R.shape_moments(lab), R.perimeter_euler(lab), R.convex_hulls(lab)).select("image_id", "label", *R6("ellipticity", "roundness"))


# Hulls and holes have no SQL; the tests compare them with brute force.


@query()
def convex_hulls(spark, sf):
    return R.convex_hulls(irregular(spark, sf))


@query()
def handcrafted_features(spark, sf):
    return R.handcrafted(X.labels(X.pixels(spark, sf), dense=False).select("image_id", "y", "x", "label", P.gray().alias("v")))


@query(f"WITH {PX}, {LAB}, {IRR}, {_MOM} SELECT image_id, label, round(eccentricity, 6) AS eccentricity, area FROM shape")
def concept_subset(spark, sf):
    return R.concepts(R.shape_moments(irregular(spark, sf)), "eccentricity, area").select("image_id", "label", *R6("eccentricity"), "area")


# Metrics: the annotation against the class of each block's brightest tenth, with a mask.


def _pairs(spark, sf):
    return X.pixels(spark, sf).select(F.col("cls").alias("truth"), (F.floor(F.col("r") / 25.6)).cast("int").alias("pred"), ((F.col("x") + F.col("y")) % 7 != 0).alias("m"))


_CONF = "cf AS (SELECT p.pred, t.truth, count(d.pred) AS n FROM (SELECT CAST(unnest(range(10)) AS INT) AS pred) p JOIN (SELECT CAST(unnest(range(10)) AS INT) AS truth) t ON TRUE LEFT JOIN (SELECT cls AS truth, CAST(floor(r / 25.6) AS INT) AS pred FROM px WHERE cls <> 9 AND (x + y) % 7 <> 0) d ON d.pred = p.pred AND d.truth = t.truth GROUP BY 1, 2)"
_SUMS = "su AS (SELECT c AS cls, (SELECT sum(n) FROM cf WHERE pred = c) AS row, (SELECT sum(n) FROM cf WHERE truth = c) AS col, (SELECT sum(n) FROM cf WHERE truth = c AND pred = c) AS tp FROM (SELECT CAST(unnest(range(10)) AS INT) AS c)), sc AS (SELECT cls, (tp + 1e-12) / (col + 1e-12) AS re, (tp + 1e-12) / (row + 1e-12) AS pr, tp / nullif(row + col - tp, 0) AS iou FROM su)"


def _table(spark, sf):
    return M.confusion(_pairs(spark, sf), X.CLASSES, X.BACKGROUND, F.col("m"))


@query(f"WITH {PX}, {_CONF} SELECT * FROM cf")
def confusion_matrix(spark, sf):
    return _table(spark, sf)


@query(f"WITH {PX}, {_CONF}, {_SUMS} SELECT cls, round(2 * re * pr / (re + pr), 6) AS dice FROM sc")
def dice_per_class(spark, sf):
    return M.dice(_table(spark, sf)).select("cls", *R6("dice"))


@query(f"WITH {PX}, {_CONF}, {_SUMS} SELECT cls, round(iou, 6) AS iou FROM sc")
def iou_per_class(spark, sf):
    return M.iou(_table(spark, sf)).select("cls", *R6("iou"))


@query(f"WITH {PX}, {_CONF}, {_SUMS} SELECT round(avg(2 * re * pr / (re + pr)), 6) AS mean_dice FROM sc")
def mean_dice(spark, sf):
    return M.mean(M.dice(_table(spark, sf)), "dice").select(*R6("mean_dice"))


@query(f"WITH {PX}, {_CONF}, {_SUMS} SELECT round(avg(iou), 6) AS mean_iou FROM sc")
def mean_iou(spark, sf):
    return M.mean(M.iou(_table(spark, sf)), "iou").select(*R6("mean_iou"))
