"""Entity graphs: nearest-neighbour and adjacency edges, closures, assignments, components and diameters.

Tables are keyed by graph or image, so a batch of graphs is one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import cut, drop, shuffled


def _ranked(pairs: DataFrame, k: int, thresh: float | None) -> DataFrame:
    """Rank by distance, then drop coincident points and long edges: a coincident point uses up a rank."""
    w = W.partitionBy("graph_id", "src").orderBy("d2", "dst")
    edges = pairs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("graph_id", "src", "dst", F.sqrt("d2").alias("dist")).filter("dist > 0")
    return edges if thresh is None else edges.filter(F.col("dist") <= thresh)


def _sides(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda n, s: points.select("graph_id", F.col("node_id").alias(n), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    return side("src", 1), side("dst", 2)


_D2 = "(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)"


def knn_graph(points: DataFrame, k: int = 5, thresh: float | None = None) -> DataFrame:
    """Directed edges to the k nearest other points of the same graph, kept up to thresh; a coincident point uses up a rank, and is no edge."""
    near = nearest(points, k).filter("dist > 0")
    if thresh is not None:
        near = near.filter(F.col("dist") <= thresh)
    return near.select("graph_id", F.col("node_id").alias("src"), F.col("other").alias("dst"), "dist")


def knn_graph_bucketed(points: DataFrame, k: int, thresh: float) -> DataFrame:
    """The same edges for a threshold where points are spread evenly: one join of the 3 x 3 cells of its width around a point. Points that crowd in a cell all meet there."""
    a, b = _sides(points)
    cell = lambda c: F.floor(F.col(c) / thresh)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = a.withColumn("i", near).withColumn("j", near).select("graph_id", "src", "x1", "y1", (cell("x1") + F.col("i")).alias("cx"), (cell("y1") + F.col("j")).alias("cy"))
    b = b.select("graph_id", "dst", "x2", "y2", cell("x2").alias("cx"), cell("y2").alias("cy"))
    pairs = a.join(shuffled(b), ["graph_id", "cx", "cy"]).filter("src <> dst").withColumn("d2", F.expr(_D2)).filter(F.col("d2") <= thresh * thresh)
    return _ranked(pairs, k, thresh)


#: Places are whole numbers of so many bits along each side of a graph's square.
BITS = 30
#: Levels of cells that are counted in one pass.
PASS = 10


def _placed(points: DataFrame) -> DataFrame:
    """graph_id, node_id, x, y with the place (ix, iy) in the graph's square and its side."""
    own = points.select("graph_id", "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x = x AND y = y AND NOT isnan(x) AND NOT isnan(y)")
    box = own.groupBy("graph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    at = lambda c: F.when(F.col("span") > 0, F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("span") * float(1 << BITS)), F.lit((1 << BITS) - 1))).otherwise(0).cast("long")
    return own.join(shuffled(box), "graph_id").select("graph_id", "node_id", "x", "y", at("x").alias("ix"), at("y").alias("iy"), "span")


def _cell(c: str, level: str) -> F.Column:
    """The cell of a place at a level: its leading bits."""
    return F.expr(f"shiftright({c}, {BITS} - {level})")


def cell_levels(spots: DataFrame, most: int) -> DataFrame:
    """spots(graph_id, x, y, ix, iy, span) with the first level at which their cell holds at most so many, BITS if none does."""
    open_, done = spots, None
    for low in range(0, BITS, PASS):
        each = open_.select("*", F.explode(F.sequence(F.lit(low), F.lit(low + PASS - 1))).alias("level")).select("*", _cell("ix", "level").alias("cx"), _cell("iy", "level").alias("cy"))
        few = each.groupBy("graph_id", "level", "cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("graph_id", "level", "cx", "cy")
        first = each.join(shuffled(few), ["graph_id", "level", "cx", "cy"]).groupBy("graph_id", "x", "y").agg(F.min("level").alias("level"))
        told = cut(open_.join(shuffled(first), ["graph_id", "x", "y"], "left"), "levels")
        part = told.filter("level IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        open_ = told.filter("level IS NULL").drop("level")
        if open_.isEmpty():
            return done
    return done.unionByName(open_.withColumn("level", F.lit(BITS)))


def _met(open_: DataFrame, others: DataFrame) -> DataFrame:
    """Spots with all others of the 3 x 3 cells of their level around them."""
    levels = sorted(r.level for r in open_.select("level").distinct().collect())
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = open_.withColumn("i", near).withColumn("j", near).withColumn("cx", _cell("ix", "level") + F.col("i")).withColumn("cy", _cell("iy", "level") + F.col("j")).drop("i", "j", "ix", "iy")
    held = others.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).select("graph_id", "other", "x2", "y2", "level", _cell("ix", "level").alias("cx"), _cell("iy", "level").alias("cy"))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return around.join(shuffled(held), ["graph_id", "level", "cx", "cy"]).withColumn("d2", d2)


def nearest(points: DataFrame, k: int) -> DataFrame:
    """graph_id, node_id, other, dist, rank: the k nearest other points of each point, or all of a graph's others where it has no k, ties by id.

    A tree of square cells follows the density: a cell is split until it holds few spots (a spot is a place with a point), so every spot starts at the width that suits its surroundings. It meets the 3 x 3 cells of that width
    around it, found by the leading bits of places; one with k + 1 points within a cell's width of it is done, others go on with cells twice as wide. Only lone spots come to wide cells, so rows met grow with the points, however
    these crowd. Points on one spot have one search, and only the k + 1 smallest ids of a spot can be anyone's neighbours.

    Points without a place (null or NaN) have no row. Crowds of over k spots within a billionth of their graph's side meet one another.
    """
    placed = cut(_placed(points), "placed")
    by_id = W.partitionBy("graph_id", "x", "y").orderBy("node_id")
    others = placed.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    others = cut(others.select("graph_id", F.col("node_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "ix", "iy"), "others")
    spots = placed.select("graph_id", "x", "y", "ix", "iy", "span").distinct()
    open_, done = cut(cell_levels(spots, max(k, 2)), "open"), None
    best = W.partitionBy("graph_id", "x", "y").orderBy("d2", "other")
    sure = F.pow(F.col("span") / F.pow(F.lit(2.0), F.col("level")) * (1 - 1e-9), F.lit(2.0))
    while True:
        top = _met(open_, others).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
        held = cut(top.select("graph_id", "x", "y", "level", "other", "d2", ((F.col("d2") < sure) | (F.col("level") == 0)).alias("sure")), "met")
        certain = held.groupBy("graph_id", "x", "y").agg((F.sum(F.col("sure").cast("int")) >= k + 1).alias("enough"), (F.max("level") == 0).alias("whole")).filter("enough OR whole").select("graph_id", "x", "y")
        part = cut(held.select("graph_id", "x", "y", "other", "d2").join(shuffled(certain), ["graph_id", "x", "y"], "left_semi"), "nearest")
        done = part if done is None else done.unionByName(part)
        left = cut(open_.join(shuffled(part.select("graph_id", "x", "y").distinct()), ["graph_id", "x", "y"], "left_anti").withColumn("level", F.col("level") - 1), "open")
        drop(open_, held)
        open_ = left
        if open_.isEmpty():
            break
    rank = W.partitionBy("graph_id", "node_id").orderBy("d2", "other")
    own = placed.select("graph_id", "node_id", "x", "y").join(shuffled(done), ["graph_id", "x", "y"]).filter("node_id <> other").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    out = cut(own.select("graph_id", "node_id", "other", F.sqrt("d2").alias("dist"), "rank"), "nearest")
    drop(placed, others, open_)
    return out


def offsets(kernel: int) -> list[tuple[int, int]]:
    r = kernel // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if (dy, dx) != (0, 0)]


def connectivity(n: int) -> list[tuple[int, int]]:
    """1: the four side neighbours; 2: the eight around."""
    return [(dy, dx) for dy, dx in offsets(3) if n == 2 or 0 in (dy, dx)]


def region_adjacency(label_map: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """Pairs of labels (> 0) with pixels at one of the given offsets, in both directions.

    Only half the offsets are joined, and only boundary pairs leave the join: it is an equi-join on pixel coordinates.
    """
    half = [o for o in around if o > (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in half]))
    own = label_map.filter("label > 0")
    a = own.select("image_id", F.col("label").alias("a"), "y", "x", shift.alias("o")).select("image_id", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    pairs = a.join(shuffled(own.select("image_id", "y", "x", F.col("label").alias("b"))), ["image_id", "y", "x"]).filter("a <> b").select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select("image_id", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))).alias("e")).select("image_id", F.col("e.s").alias("src"), F.col("e.d").alias("dst"))


def hops(edges: DataFrame, k: int) -> DataFrame:
    """Pairs of different nodes within k steps along edges(graph_id, src, dst)."""
    one = edges.select("graph_id", "src", "dst").filter("src <> dst").distinct()
    reach = one
    for _ in range(k - 1):
        step = reach.join(shuffled(one.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))), ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst"))
        reach = reach.unionByName(step).filter("src <> dst").distinct()
    return reach


def assignment(points: DataFrame, label_map: DataFrame) -> DataFrame:
    """points(image_id, node_id, x, y) to the label at (int(y), int(x)); background assigns nothing."""
    at = points.select("image_id", F.col("node_id").alias("low_id"), F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x"))
    return at.join(shuffled(label_map.filter("label > 0").select("image_id", "y", "x", F.col("label").alias("high_id"))), ["image_id", "y", "x"]).select("image_id", "low_id", "high_id")


def assignment_dense(pairs: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """The 0/1 matrix in long form: every low node of an image with every label of it."""
    grid = low.select("image_id", "low_id").join(shuffled(high.select("image_id", "high_id").distinct()), "image_id")
    return grid.join(shuffled(pairs.withColumn("hit", F.lit(1))), ["image_id", "low_id", "high_id"], "left").select("image_id", "low_id", "high_id", F.coalesce("hit", F.lit(0)).alias("assigned"))


def with_location(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """Features with the centroid relative to the image appended."""
    return nodes.withColumn("feat", F.concat("feat", F.array(F.col("x") / width, F.col("y") / height)))


def thresholded(weights: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """weights(graph_id, src, dst, w) -> edges with w >= least on renumbered nodes, and the node table; isolated nodes are gone."""
    kept = weights.filter(F.col("w") >= least)
    ends = kept.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    numbered = ends.withColumn("new_id", F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1)
    for side in ("src", "dst"):
        kept = kept.join(shuffled(numbered.select("graph_id", F.col("node_id").alias(side), F.col("new_id").alias(f"{side}_new"))), ["graph_id", side])
    return kept.select("graph_id", F.col("src_new").alias("src"), F.col("dst_new").alias("dst"), "w"), numbered


def components(nodes: DataFrame, edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """nodes(key, node_id), edges(key, src, dst) -> component: the smallest node id that can be reached, directions aside.

    Smallest label of the neighbourhood, then one pointer jump, until nothing changes; each round is cut by a table.
    """
    both = cut(edges.select(key, "src", "dst").unionByName(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    label, before = nodes.select(key, "node_id", F.col("node_id").alias("component")), None
    while True:
        seen = both.join(shuffled(label.select(key, F.col("node_id").alias("dst"), "component")), [key, "dst"]).groupBy(key, F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        low = label.join(shuffled(seen), [key, "node_id"], "left").select(key, "node_id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = low.select(key, F.col("node_id").alias("component"), F.col("component").alias("to"))
        after = cut(low.join(shuffled(jump), [key, "component"]).select(key, "node_id", F.col("to").alias("component"), (F.col("to") != F.col("was")).alias("moved")), "labels")
        label = after.select(key, "node_id", "component")
        drop(before)
        before = after
        if after.filter("moved").isEmpty():
            drop(both)
            return label


def largest_component(labelled: DataFrame, key: str = "graph_id") -> DataFrame:
    """The component with most nodes, ties to the smallest: key, component, size."""
    sizes = labelled.groupBy(key, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(key).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"), F.max("size").alias("size"))
    return best


def _searched(step: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key, root, ahead, node, d: the steps from each root along the edges (ahead) and against them, by breadth-first frontiers from all roots at once."""
    reached = cut(roots.select(key, F.col("node").alias("root"), F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), "node", F.lit(0).alias("d")), "reached")
    d = 0
    while True:
        new = reached.filter(F.col("d") == d).join(shuffled(step), [key, "ahead", "node"]).select(key, "root", "ahead", F.col("to").alias("node"), F.lit(d + 1).alias("d"))
        # One grouping gives every pair its least distance, and keeps what is known.
        after = cut(reached.unionByName(new).groupBy(key, "root", "ahead", "node").agg(F.min("d").alias("d")), "reached")
        drop(reached)
        reached, d = after, d + 1
        if reached.filter(F.col("d") == d).isEmpty():
            return reached


def diameter(edges: DataFrame, key: str = "graph_id", roots: int = 32, strict: bool = True) -> DataFrame:
    """key, diameter: the longest shortest path of each graph with edges, directed.

    Searches from a few roots bound how far every node is from its farthest one: with the root's own distance e, f steps from the root and b steps to it, between max(e - f, b) and b + e.
    The next roots are the nodes with the highest bounds, until none is above the longest distance seen. A search is a row a node, so rows are nodes times searches, not pairs of nodes; graphs of up to `roots` nodes take one round.

    In a graph that is not strongly connected some distance is infinite: that is an error, or a null diameter where strict is off.
    """
    one = edges.select(key, F.col("src").alias("node"), F.col("dst").alias("to")).filter("node IS NOT NULL AND to IS NOT NULL").distinct()
    step = cut(one.select("*", F.lit(True).alias("ahead")).unionByName(one.select(key, F.col("to").alias("node"), F.col("node").alias("to"), F.lit(False).alias("ahead"))), "steps")
    degrees = step.groupBy(key, "node").agg(F.count("*").alias("degree"))
    bounds = cut(degrees.select("*", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"), F.lit(-1).alias("best")), "bounds")
    sizes = cut(bounds.groupBy(key).agg(F.count("*").alias("n")), "sizes")
    first = W.partitionBy(key).orderBy(F.col("high").desc_nulls_first(), F.col("low"), F.col("degree").desc(), "node")
    apart = None
    while True:
        picked = cut(bounds.filter(F.col("high").isNull() | (F.col("high") > F.col("best"))).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= roots).select(key, "node"), "roots")
        if picked.isEmpty():
            break
        reached = _searched(step, picked, key)
        if apart is None:
            short = reached.groupBy(key, "root", "ahead").agg(F.count("*").alias("seen")).join(shuffled(sizes), key).filter(F.col("seen") < F.col("n"))
            apart = cut(short.select(key).distinct(), "apart")
            if strict and (bad := apart.first()) is not None:
                raise ValueError(f"graph {bad[0]} is not strongly connected")
        far = reached.filter("ahead").groupBy(key, "root").agg(F.max("d").alias("e"))
        both = reached.groupBy(key, "root", "node").agg(F.max(F.when(F.col("ahead"), F.col("d"))).alias("f"), F.max(F.when(~F.col("ahead"), F.col("d"))).alias("b")).join(shuffled(far), [key, "root"])
        told = both.groupBy(key, "node").agg(F.max(F.greatest(F.col("e") - F.col("f"), F.col("b"))).alias("l"), F.min(F.col("b") + F.col("e")).alias("h"))
        after = bounds.join(shuffled(apart), key, "left_anti").join(shuffled(told), [key, "node"], "left").select(key, "node", "degree", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high"))
        after = cut(after, "bounds")
        best = after.groupBy(key).agg(F.max("low").alias("best"))
        drop(bounds)
        bounds = cut(after.join(shuffled(best), key), "bounds")
        drop(after, picked, reached)
    out = bounds.groupBy(key).agg(F.max("best").alias("diameter"))
    return out if apart is None else out.unionByName(apart.select(key, F.lit(None).cast("int").alias("diameter")))
