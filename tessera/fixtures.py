"""Images, label maps, points and graphs derived from the driver's tables, in Spark and as DuckDB CTEs.

An image is a mosaic of 5 x 20 embeddings of 8 x 8 pixels, so the number of images grows with the table; graphs hold 250 points each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import shuffled

HEIGHT, WIDTH, TILE = 40, 160, 8
PER_GRAPH = 250
CLASSES, BACKGROUND = 10, 9
FEATURES = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, y, x, r, g, b, gray value v, annotation cls."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cls"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    q = lambda shift: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * F.col("embedding")[(F.col("p") + shift) % 64].cast("double")).cast("int")))
    return e.select(
        F.floor(F.col("vec_id") / 100).alias("image_id"),
        (F.floor(F.col("vec_id") % 100 / 20) * 8 + F.floor(F.col("p") / 8)).cast("int").alias("y"),
        (F.col("vec_id") % 20 * 8 + F.col("p") % 8).cast("int").alias("x"),
        q(0).alias("r"), q(21).alias("g"), q(42).alias("b"), "cls",
    )


PX = """px AS (SELECT vec_id // 100 AS image_id, CAST((vec_id % 100) // 20 * 8 + p // 8 AS INT) AS y, CAST(vec_id % 20 * 8 + p % 8 AS INT) AS x,
  greatest(0, least(255, CAST(floor(128 + 256 * CAST(embedding[p + 1] AS DOUBLE)) AS INT))) AS r,
  greatest(0, least(255, CAST(floor(128 + 256 * CAST(embedding[(p + 21) % 64 + 1] AS DOUBLE)) AS INT))) AS g,
  greatest(0, least(255, CAST(floor(128 + 256 * CAST(embedding[(p + 42) % 64 + 1] AS DOUBLE)) AS INT))) AS b, label AS cls
  FROM (SELECT *, unnest(range(64)) AS p FROM embeddings))"""


def labels(px: DataFrame, dense: bool = True) -> DataFrame:
    """Blocks of 10 x 10 pixels as instances 1..64 of each image; with dense off only pixels of r >= 128, so that regions are irregular."""
    out = px.select("image_id", "y", "x", (F.floor(F.col("y") / 10) * 16 + F.floor(F.col("x") / 10) + 1).cast("int").alias("label"), "r", "g", "b", "cls")
    return out if dense else out.filter("r >= 128")


LAB = "lab AS (SELECT image_id, y, x, CAST(y // 10 * 16 + x // 10 + 1 AS INT) AS label, r, g, b, cls FROM px)"
IRR = "irr AS (SELECT * FROM lab WHERE r >= 128)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """graph_id, node_id, x, y: distinct points but for one coincident pair every 50."""
    k = F.col("p_partkey")
    at = F.when(k % 50 == 7, k - 1).otherwise(k)
    return table(spark, sf, "part").select(
        F.floor(k / PER_GRAPH).alias("graph_id"), k.alias("node_id"), (at * 7919 % 997).cast("double").alias("x"), (at * 104729 % 991).cast("double").alias("y"),
    )


PTS = f"""pts AS (SELECT p_partkey // {PER_GRAPH} AS graph_id, p_partkey AS node_id, CAST(a * 7919 % 997 AS DOUBLE) AS x, CAST(a * 104729 % 991 AS DOUBLE) AS y
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 1 ELSE p_partkey END AS a FROM part))"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Points with the 64 features of embedding node_id modulo the number of embeddings."""
    feat = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))
    n = feat.agg(F.count("*").alias("n"))  # one row
    keyed = points(spark, sf).crossJoin(F.broadcast(n)).withColumn("v", F.col("node_id") % F.col("n"))
    return keyed.join(shuffled(feat), "v").select("graph_id", "node_id", "x", "y", "feat")


NODES = f"{PTS}, nodes AS (SELECT graph_id, node_id, x, y, embedding FROM pts JOIN embeddings ON node_id % (SELECT count(*) FROM embeddings) = vec_id), nf AS (SELECT graph_id, node_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM nodes)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges between the points of a graph by rule; a tenth of the nodes has no edge into it."""
    k = F.col("p_partkey")
    base, at = F.floor(k / PER_GRAPH) * PER_GRAPH, k % PER_GRAPH
    ends = F.explode(F.array(*[base + (at * m + c) % PER_GRAPH for m, c in ((1, 1), (3, 2), (7, 5))]))
    out = table(spark, sf, "part").select(F.floor(k / PER_GRAPH).alias("graph_id"), k.alias("src"), ends.alias("dst")).filter("dst % 10 <> 3")
    return out.join(shuffled(table(spark, sf, "part").select(F.col("p_partkey").alias("dst"))), "dst", "left_semi").select("graph_id", "src", "dst")


LINKS = f"""links AS (SELECT p_partkey // {PER_GRAPH} AS graph_id, p_partkey AS src, p_partkey // {PER_GRAPH} * {PER_GRAPH} + (p_partkey % {PER_GRAPH} * m + c) % {PER_GRAPH} AS dst
  FROM part, (VALUES (1, 1), (3, 2), (7, 5)) t(m, c) WHERE (p_partkey // {PER_GRAPH} * {PER_GRAPH} + (p_partkey % {PER_GRAPH} * m + c) % {PER_GRAPH}) % 10 <> 3
  AND p_partkey // {PER_GRAPH} * {PER_GRAPH} + (p_partkey % {PER_GRAPH} * m + c) % {PER_GRAPH} IN (SELECT p_partkey FROM part))"""

EDGES = """edges AS (SELECT graph_id, src, dst, dist FROM (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist,
  row_number() OVER (PARTITION BY a.graph_id, a.node_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.node_id) AS k
  FROM pts a JOIN pts b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id) WHERE k <= 5 AND dist > 0 AND dist <= 100)"""
