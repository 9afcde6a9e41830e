"""Entity graphs in one call: nodes with places, features and labels, and edges, from tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import cut, shuffled

from .graph import knn_graph, offsets, region_adjacency
from .regions import majority_class

KEY = ["image_id", "label"]


def _named(nodes: DataFrame, values: DataFrame, what: str) -> DataFrame:
    """nodes with the columns of values(image_id, label, ..), one row a node: more, fewer or others are an error."""
    own = values.withColumn("_n", F.count("*").over(W.partitionBy(*KEY)))
    bad = nodes.select(*KEY, F.lit(1).alias("_node")).join(own.select(*KEY, "_n").distinct(), KEY, "full").filter("_node IS NULL OR _n IS NULL OR _n > 1").first()
    if bad is not None:
        raise ValueError(f"image {bad.image_id}, region {bad.label}: {what} do not match the nodes, one to one")
    return nodes.join(values, KEY)


def build(
    label_map: DataFrame, features: DataFrame, annotation: DataFrame | None = None, topology: str = "rag", k: int = 5, thresh: float | None = None, kernel: int = 3,
    classes: int = 5, background: int | None = None, location: bool = False, size: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node_id, label, x, y, feat[, cls]) and edges (graph_id, src, dst[, dist]) of label_map(image_id, y, x, label), 0 where there is no region.

    features: (image_id, label, feat), one row a region. annotation: (image_id, y, x, cls), of which a node takes the commonest class other than the background, or (image_id, label, cls), one row a region.
    topology: rag joins regions that touch within the kernel, knn the k nearest centres up to thresh. location: the centre over the image's width and height is added to the features; these are `size` (height, width), or where the label map ends.
    Nodes are numbered from 0 by label. Classes outside 0 to classes - 1 are an error.
    """
    if topology not in ("rag", "knn"):
        raise ValueError("topology must be rag or knn")
    own = label_map.filter("label > 0").groupBy(*KEY).agg(F.bround(F.avg("x")).alias("x"), F.bround(F.avg("y")).alias("y"))
    nodes = cut(own.withColumn("node_id", F.row_number().over(W.partitionBy("image_id").orderBy("label")) - 1), "nodes")
    full = _named(nodes, features.select(*KEY, "feat"), "features")
    if location:
        sizes = label_map.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
        full = full.join(sizes, "image_id") if size is None else full.withColumns({"_h": F.lit(size[0]), "_w": F.lit(size[1])})
        full = full.withColumn("feat", F.concat("feat", F.array(F.col("x") / F.col("_w"), F.col("y") / F.col("_h")))).drop("_w", "_h")
    if annotation is not None:
        beyond = annotation.filter(~F.col("cls").between(0, classes - 1)).first()
        if beyond is not None:
            raise ValueError(f"image {beyond.image_id}: class {beyond.cls} of {classes}")
        if "label" not in annotation.columns:
            there = label_map.join(shuffled(annotation.select("image_id", "y", "x", "cls")), ["image_id", "y", "x"])
            annotation = majority_class(there, -1 if background is None else background)
        full = _named(full, annotation.select(*KEY, "cls"), "labels")
    full = full.select(F.col("image_id").alias("graph_id"), "node_id", "label", "x", "y", "feat", *(["cls"] if annotation is not None else []))
    if topology == "knn":
        return full, knn_graph(nodes.select(F.col("image_id").alias("graph_id"), "node_id", "x", "y"), k, thresh)
    edges = region_adjacency(label_map, offsets(kernel))
    for side in ("src", "dst"):
        edges = edges.join(nodes.select("image_id", F.col("label").alias(side), F.col("node_id").alias(f"{side}_id")), ["image_id", side])
    return full, edges.select(F.col("image_id").alias("graph_id"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def last_flagged(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """items with `is_last`: whether none of the same `by` follows in the order."""
    return items.withColumn("is_last", F.lead(F.lit(True)).over(W.partitionBy(*by).orderBy(*order)).isNull())


def stem(path: str) -> F.Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def by_name(graphs: DataFrame, images: DataFrame) -> DataFrame:
    """graphs(graph_path) and images(image_path) of one file name, extensions aside: name, graph_path, image_path; a graph without an image has none, of several images it has the first by path."""
    first = images.groupBy(stem("image_path").alias("name")).agg(F.min("image_path").alias("image_path"))
    return graphs.select(stem("graph_path").alias("name"), "graph_path").join(first, "name", "left").select("name", "graph_path", "image_path")
