"""Sources and sinks: what is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import LINKS, NODES, PX
from tessera.operators import raster as P
from tessera.operators import regions as R
from tessera.plans.scratch import shared_path
from tessera.sources import images, store

from . import query

_GRAY = "(r * 4899 + g * 9617 + b * 1868 + 8192) >> 14"


@query(f"WITH {PX} SELECT CAST(image_id AS VARCHAR) AS image_id, y, x, r, g, b FROM px")
def image_scan(spark, sf):
    folder = shared_path(spark, "images")
    images.write_png(X.pixels(spark, sf), folder, gaps=True).count()
    return images.scan(spark, folder, clear=False)


@query(f"WITH {PX} SELECT CAST(image_id AS VARCHAR) AS image_id, y, x, CAST(r >= 128 AS INT) AS m FROM px")
def mask_sink(spark, sf):
    folder = shared_path(spark, "masks")
    images.write_png(X.pixels(spark, sf).withColumn("m", (F.col("r") >= 128).cast("int")), folder, ("m",), gaps=True).count()
    return images.scan(spark, folder, clear=False).select("image_id", "y", "x", F.col("r").alias("m"))


@query(f"WITH {PX} SELECT image_id, y, x, CAST({_GRAY} AS INT) AS v FROM px")
def memoised_gray(spark, sf):
    """The even images are there when all are asked for."""
    px = X.pixels(spark, sf)
    memo = store.Memo(spark, shared_path(spark, "memo"), "gray", {"order": "rgb"})
    step = lambda rows: rows.select("image_id", "y", "x", P.gray().cast("int").alias("v"))
    memo(px.filter("image_id % 2 = 0"), step)
    return memo(px, step)


@query(f"WITH {NODES}, {LINKS} SELECT l.graph_id, l.dst AS node_id, count(*) AS n, round(any_value(p.x), 6) AS x FROM links l JOIN pts p ON p.node_id = l.dst WHERE l.graph_id IN (0, 2) GROUP BY 1, 2")
def graph_store(spark, sf):
    root = shared_path(spark, "graphs")
    store.write_graphs(X.points(spark, sf), X.links(spark, sf), root)
    nodes, edges = store.read_graphs(spark, root, [0, 2])
    return edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n")).join(nodes, ["graph_id", "node_id"]).select("graph_id", "node_id", "n", F.round("x", 6).alias("x"))


@query("SELECT CAST(vec_id AS VARCHAR) AS name, round(CAST(embedding[1] AS DOUBLE), 6) AS first_, CAST(len(embedding) AS INT) AS n, round(2 * CAST(embedding[2] AS DOUBLE), 6) AS second_ FROM embeddings")
def array_store(spark, sf):
    """Two arrays a name, read in the order of their keys."""
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    root = shared_path(spark, "arrays")
    store.write_arrays(e.withColumn("key", F.lit("a")), root)
    store.write_arrays(e.withColumn("key", F.lit("b")).withColumn("value", F.transform("value", lambda x: 2 * x)), root)
    return store.read_arrays(spark, root).select("name", F.round(F.col("a")[0], 6).alias("first_"), F.size("a").alias("n"), F.round(F.col("b")[1], 6).alias("second_"))


@query("SELECT 'default' AS profile_id, * FROM (VALUES (0, 0.5626::DOUBLE, 0.7201::DOUBLE, 0.4062::DOUBLE, 1.9705::DOUBLE), (1, 0.2159, 0.8012, 0.5581, 1.0308)) t(stain, od_r, od_g, od_b, max_conc)")
def stain_profile_store(spark, sf):
    path = shared_path(spark, "profile")
    store.stain_profile(spark).write.parquet(path)
    return store.stain_profile(spark, path).select("profile_id", "stain", *[F.col("od")[k].alias(f"od_{c}") for k, c in enumerate("rgb")], "max_conc")


@query(f"WITH {PX} SELECT 'image' || image_id AS name, CAST(count(DISTINCT cls) AS DOUBLE) AS value FROM px GROUP BY image_id")
def stats_csv(spark, sf):
    """A row an image, in two appends after a fresh start."""
    px, folder = X.pixels(spark, sf), shared_path(spark, "stats")
    rows = R.distinct_labels(px.withColumnRenamed("cls", "label")).select("image_id", F.concat(F.lit("image"), "image_id").alias("name"), F.col("n_labels").alias("value"))
    store.append_stats(rows.limit(1), folder, new=True)
    store.append_stats(rows.filter("image_id % 2 = 0"), folder, new=True)
    store.append_stats(rows.filter("image_id % 2 = 1"), folder)
    return store.read_stats(spark, folder)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def json_round_trip(spark, sf):
    rows = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    path = shared_path(spark, "json")
    # One indented document a part file.
    rows.coalesce(1).agg(F.collect_list(F.struct("key", "name")).alias("all")).select(store.pretty_json("all").alias("value")).write.text(path)
    return store.read_json(spark, path).select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT 'second' AS checkpoint")
def checkpoint_lookup(spark, sf):
    registry = spark.createDataFrame([("first", "gin", 3, 5), ("second", "gin", 3, None), ("third", "pna", 3, 7)], "checkpoint string, layer string, layers int, classes int")
    return spark.createDataFrame([(store.lookup_checkpoint(registry, {"layer": "gin", "layers": 3}),)], "checkpoint string")


@query("SELECT url, regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') AS file FROM pages")
def path_file_name(spark, sf):
    return X.table(spark, sf, "pages").select("url", images.file_name("url").alias("file"))


@query("SELECT url, contains(url, 'box') AS box FROM pages")
def url_predicate(spark, sf):
    return X.table(spark, sf, "pages").select("url", F.contains("url", F.lit("box")).alias("box"))
