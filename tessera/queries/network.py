"""Graph networks and their explanations, with weights by rule so that SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import LINKS, NODES
from tessera.operators import explain as E
from tessera.operators import gnn as N

from . import query

#: Layers by name with inputs and outputs; a layer's place is its number in the rule of the weights.
SHAPES = {
    "a1": (64, 8), "a2": (8, 8), "b1": (8, 8), "b2": (8, 8), "head1": (16, 6), "head2": (6, 3), "pre": (128, 8), "post": (160, 8), "mix": (8, 8),
    "pre2": (16, 8), "post2": (104, 8), "mix2": (8, 8), "t1": (20, 8), "t2": (8, 8), "tail1": (8, 6), "tail2": (6, 3),
}
STACK = N.Stack((N.Gin(64, ("a1", "a2"), 8), N.Gin(8, ("b1", "b2"), 8)))
LAST = N.Stack(STACK.layers, readout="none")
PNA = N.Stack((N.Pna(64, 8, (("pre", "post"),), "mix"), N.Pna(8, 8, (("pre2", "post2"),), "mix2")))
TISSUE = N.Stack((N.Gin(20, ("t1", "t2"), 8), N.Gin(8, ("b1", "b2"), 8)))


def weights(spark) -> N.Weights:
    return N.Weights.load(N.synthetic(spark, SHAPES))


def nodes(spark, sf):
    return X.nodes(spark, sf).select("graph_id", "node_id", F.col("feat").alias("h"))


def long(df, column="h", *keys):
    """One row a value."""
    return df.select(*(keys or ("graph_id", "node_id")), F.posexplode(column).alias("i", "v")).withColumn("v", F.round("v", 6))


# DuckDB: vectors are lists, a dense layer is a list expression.


def _relu(h: str) -> str:
    return f"list_transform({h}, lambda v: greatest(v, 0.0::DOUBLE))"


def _leaky(h: str) -> str:
    return f"list_transform({h}, lambda v: CASE WHEN v > 0 THEN v ELSE 0.01::DOUBLE * v END)"


def _row(inputs: int, n: int, j: str = "j") -> str:
    return f"list_transform(range({inputs}), lambda i: ((i * 31 + {j} * 17 + {n} * 7) % 97 - 48)::DOUBLE / 97)"


def _linear(h: str, layer: str) -> str:
    inputs, outputs = SHAPES[layer]
    return f"list_transform(range({outputs}), lambda j: list_inner_product({h}, {_row(inputs, list(SHAPES).index(layer))}) + (j * 13 % 11 - 5)::DOUBLE / 11)"


def _step(frm: str, to: str, layer: str, act=_relu, keys: str = "graph_id, node_id", keep: str = "") -> str:
    """CTE `to`: a dense layer and its activation over frm(keys, h)."""
    return f"{to} AS (SELECT {keys}, {act(_linear('h', layer))} AS h{keep} FROM {frm})"


def _plus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] + p[2])"


def _lists(value: str, frm: str, keys: str, width: int) -> str:
    return f"SELECT {keys}, list(v ORDER BY i) AS m FROM (SELECT {keys}, i, {value} AS v FROM {frm}, unnest(range(1, {width} + 1)) t(i) GROUP BY {keys}, i) GROUP BY {keys}"


def _gin_sql(frm: str, to: str, first: str, second: str, edges: str = "links") -> str:
    width = SHAPES[first][0]
    met = _lists("avg(s.h[i])", f"(SELECT e.graph_id, e.dst AS node_id, n.h FROM {edges} e JOIN {frm} n ON n.graph_id = e.graph_id AND n.node_id = e.src) s", "graph_id, node_id", width)
    return (
        f"{to}m AS ({met}), {to}z AS (SELECT n.graph_id, n.node_id, CASE WHEN m IS NULL THEN h ELSE {_plus('h', 'm')} END AS h FROM {frm} n LEFT JOIN {to}m USING (graph_id, node_id)), "
        f"{_step(f'{to}z', f'{to}1', first)}, {_step(f'{to}1', to, second)}"
    )


BASE = f"WITH {NODES}, {LINKS}, n0 AS (SELECT graph_id, node_id, list_transform(embedding, lambda x: x::DOUBLE) AS h FROM nodes)"
_LONG = "SELECT graph_id, node_id, (i - 1)::INT AS i, round(h[i], 6) AS v FROM {frm}, unnest(range(1, {width} + 1)) t(i)"
_NONE = lambda h: h


@query(f"{BASE}, {_step('n0', 'h1', 'a1')}, {_step('h1', 'h2', 'a2', _NONE)} {_LONG.format(frm='h2', width=8)}")
def mlp_forward(spark, sf):
    return long(nodes(spark, sf).withColumn("h", N.mlp(F.col("h"), weights(spark), ["a1", "a2"])))


_GIN = _gin_sql("n0", "h1", "a1", "a2")


@query(f"{BASE}, {_GIN} {_LONG.format(frm='h1', width=8)}")
def gin_layer(spark, sf):
    return long(STACK.layers[0](nodes(spark, sf), X.links(spark, sf), weights(spark)))


def _dense_sql() -> str:
    met = _lists("sum(w * h[i])", "(SELECT a.graph_id, a.src AS node_id, 1 / d.n AS w, n.h FROM links a JOIN (SELECT graph_id, dst, count(*) AS n FROM links GROUP BY ALL) d USING (graph_id, dst) JOIN n0 n ON n.graph_id = a.graph_id AND n.node_id = a.dst)", "graph_id, node_id", 64)
    return f"m AS ({met}), z AS (SELECT n.graph_id, n.node_id, CASE WHEN m IS NULL THEN h ELSE {_plus('h', 'm')} END AS h FROM n0 n LEFT JOIN m USING (graph_id, node_id)), {_step('z', 'z1', 'a1')}, {_step('z1', 'z2', 'a2')}"


@query(f"{BASE}, {_dense_sql()} {_LONG.format(frm='z2', width=8)}")
def dense_gin_layer(spark, sf):
    return long(N.dense_gin(nodes(spark, sf), X.links(spark, sf).withColumn("w", F.lit(1.0)), weights(spark), ["a1", "a2"], 64))


def _pna_sql(frm: str, to: str, pre: str, post: str, mix: str) -> str:
    wide = 8
    of = ("avg(x)", "max(x)", "min(x)", "sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0) + 1e-5)")
    rows = ", ".join(f"{a} AS a{k}" for k, a in enumerate(of))
    lists = " || ".join(f"list(a{k} ORDER BY i)" for k in range(len(of)))
    scaled = " || ".join(f"list_transform(m, lambda v: v {s})" for s in ("* 1.0::DOUBLE", "* r", "/ r"))
    inputs = SHAPES[pre][0] // 2
    own = "h" if inputs == wide else "NULL"
    res = f"CASE WHEN {own} IS NULL THEN y ELSE {_plus(own, 'y')} END" if own != "NULL" else "y"
    return (
        f"{to}e AS (SELECT e.graph_id, e.dst, a.h || b.h AS h FROM links e JOIN {frm} a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN {frm} b ON b.graph_id = e.graph_id AND b.node_id = e.dst), "
        f"{_step(f'{to}e', f'{to}f', pre, keys='graph_id, dst')}, "
        f"{to}g AS (SELECT graph_id, dst AS node_id, i, count(*) AS d, {rows} FROM (SELECT graph_id, dst, i, h[i] AS x FROM {to}f, unnest(range(1, {wide} + 1)) t(i)) GROUP BY graph_id, dst, i), "
        f"{to}k AS (SELECT graph_id, node_id, {lists} AS m, ln(any_value(d) + 1.0::DOUBLE) / ln(5.0::DOUBLE) AS r FROM {to}g GROUP BY graph_id, node_id), "
        f"{to}s AS (SELECT graph_id, node_id, {scaled} AS m FROM {to}k), "
        f"{to}c AS (SELECT n.graph_id, n.node_id, n.h || coalesce(m, list_transform(range({wide * 12}), lambda i: 0.0::DOUBLE)) AS h, n.h AS own FROM {frm} n LEFT JOIN {to}s USING (graph_id, node_id)), "
        f"{_step(f'{to}c', f'{to}p', post, keep=', own')}, {to}y AS (SELECT graph_id, node_id, {_leaky(_linear('h', mix))} AS y, own AS h FROM {to}p), "
        f"{to} AS (SELECT graph_id, node_id, {res} AS h FROM {to}y)"
    )


_PNA = _pna_sql("n0", "h1", "pre", "post", "mix")


@query(f"{BASE}, {_PNA} SELECT graph_id, node_id, (i - 1)::INT AS i, round(m[i], 6) AS v FROM h1s, unnest(range(1, 97)) t(i)")
def pna_aggregate(spark, sf):
    own = nodes(spark, sf)
    ends = lambda end: own.select("graph_id", F.col("node_id").alias(end), F.col("h").alias(f"h_{end}"))
    met = X.links(spark, sf).join(ends("src"), ["graph_id", "src"]).join(ends("dst"), ["graph_id", "dst"])
    e = F.transform(N.linear(F.concat("h_src", "h_dst"), weights(spark), "pre"), N.ACTIVATIONS["relu"])
    return long(N.pna_aggregate(met.select("graph_id", "dst", e.alias("e")), 8), "m")


@query(f"{BASE}, {_PNA} {_LONG.format(frm='h1', width=8)}")
def pna_layer(spark, sf):
    return long(PNA.layers[0](nodes(spark, sf), X.links(spark, sf), weights(spark)))


_TWO = f"{_GIN}, {_gin_sql('h1', 'h2', 'b1', 'b2')}"
_BOTH = "al AS (SELECT a.graph_id, a.node_id, a.h || b.h AS h FROM h1 a JOIN h2 b USING (graph_id, node_id))"


def _read_sql(frm: str, width: int, how: str = "avg") -> str:
    return f"g AS (SELECT graph_id, m AS h FROM ({_lists(f'{how}(h[i])', frm, 'graph_id', width)}))"


@query(f"{BASE}, {_TWO}, {_BOTH}, {_read_sql('al', 16)} SELECT graph_id, (i - 1)::INT AS i, round(h[i], 6) AS v FROM g, unnest(range(1, 17)) t(i)")
def graph_readout(spark, sf):
    return long(STACK.graph_embeddings(nodes(spark, sf), X.links(spark, sf), weights(spark)), "h", "graph_id")


_LOGITS = "SELECT graph_id, (i - 1)::INT AS i, round(h[i], 6) AS v FROM lo, unnest(range(1, 4)) t(i)"
_HEAD = f"{_step('g', 'q1', 'head1', keys='graph_id')}, {_step('q1', 'lo', 'head2', _NONE, keys='graph_id')}"
_CELL = f"{BASE}, {_TWO}, {_BOTH}, {_read_sql('al', 16)}, {_HEAD}"


def _logits(spark, sf):
    return N.classify(nodes(spark, sf), X.links(spark, sf), STACK, ["head1", "head2"], weights(spark))


@query(f"{_CELL} {_LOGITS}")
def cell_graph_logits(spark, sf):
    return long(_logits(spark, sf), "logits", "graph_id")


@query(f"{BASE}, {_PNA}, {_pna_sql('h1', 'h2', 'pre2', 'post2', 'mix2')}, {_BOTH}, {_read_sql('al', 16, 'max')}, {_HEAD} {_LOGITS}")
def pna_graph_logits(spark, sf):
    stack = N.Stack(PNA.layers, reduce="max")
    return long(N.classify(nodes(spark, sf), X.links(spark, sf), stack, ["head1", "head2"], weights(spark)), "logits", "graph_id")


@query(f"{_CELL} SELECT graph_id, (list_position(h, list_max(h)) - 1)::INT AS cls FROM lo")
def argmax_class(spark, sf):
    return _logits(spark, sf).select("graph_id", N.argmax(F.col("logits")).alias("cls"))


@query(f"{_CELL} SELECT graph_id, (i - 1)::INT AS i, round(exp(h[i] - list_max(h)) / list_sum(list_transform(h, lambda x: exp(x - list_max(h)))), 6) AS v FROM lo, unnest(range(1, 4)) t(i)")
def softmax(spark, sf):
    return long(_logits(spark, sf).select("graph_id", N.softmax(F.col("logits")).alias("h")), "h", "graph_id")


# Tissue nodes: ten a graph, of which the last has no cell; a node's features are its number's digits.


def _tissue(spark, sf):
    graphs = X.points(spark, sf).select("graph_id").distinct()
    h = F.array(*[((F.col("node_id") * m + F.col("graph_id")) % 7).cast("double") / 7 for m in (1, 2, 3, 4)])
    return graphs.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("node_id")).withColumn("h", h)


def _assigned(spark, sf):
    return X.points(spark, sf).select("graph_id", F.col("node_id").alias("low_id"), F.explode(F.array(F.col("node_id") % 9, F.col("node_id") % 4)).alias("high_id")).distinct()


def _ring(spark, sf):
    return _tissue(spark, sf).select("graph_id", F.col("node_id").alias("src"), ((F.col("node_id") + 1) % 10).alias("dst"))


_TISSUE = """ts AS (SELECT graph_id, node_id, list_transform([1, 2, 3, 4], lambda m: ((node_id * m + graph_id) % 7)::DOUBLE / 7) AS h FROM (SELECT DISTINCT graph_id FROM pts), unnest(range(10)) t(node_id)),
  ring AS (SELECT graph_id, node_id AS src, (node_id + 1) % 10 AS dst FROM ts), asg AS (SELECT DISTINCT graph_id, node_id AS low_id, unnest([node_id % 9, node_id % 4]) AS high_id FROM pts)"""
_ROLLED = f"ru AS ({_lists('sum(h[i])', '(SELECT a.graph_id, a.high_id AS node_id, n.h FROM asg a JOIN al n ON n.graph_id = a.graph_id AND n.node_id = a.low_id)', 'graph_id, node_id', 16)}), rt AS (SELECT graph_id, node_id, coalesce(m, list_transform(range(16), lambda i: 0.0::DOUBLE)) || h AS h FROM ts LEFT JOIN ru USING (graph_id, node_id))"
_HACT = f"{BASE}, {_TWO}, {_BOTH}, {_TISSUE}, {_ROLLED}"


@query(f"{_HACT} {_LONG.format(frm='rt', width=20)}")
def hact_rollup(spark, sf):
    low = STACK.node_embeddings(nodes(spark, sf), X.links(spark, sf), weights(spark))
    return long(N.roll_up(low, _assigned(spark, sf), _tissue(spark, sf), 16))


_UP = f"{_gin_sql('rt', 'u1', 't1', 't2', 'ring')}, {_gin_sql('u1', 'u2', 'b1', 'b2', 'ring')}, ul AS (SELECT a.graph_id, a.node_id, a.h || b.h AS h FROM u1 a JOIN u2 b USING (graph_id, node_id))"


@query(f"{_HACT}, {_UP}, {_read_sql('ul', 16)}, {_HEAD} {_LOGITS}")
def hact_logits(spark, sf):
    w = weights(spark)
    return long(N.classify_hierarchy(nodes(spark, sf), X.links(spark, sf), _tissue(spark, sf), _ring(spark, sf), _assigned(spark, sf), STACK, TISSUE, ["head1", "head2"], w), "logits", "graph_id")


@query(f"{BASE}, {_TISSUE}, tt AS (SELECT graph_id, node_id, list_transform(range(16), lambda i: 0.0::DOUBLE) || h AS h FROM ts), {_gin_sql('tt', 'u1', 't1', 't2', 'ring')}, {_gin_sql('u1', 'u2', 'b1', 'b2', 'ring')}, {_read_sql('u2', 8, 'sum')}, {_step('g', 'q1', 'tail1', keys='graph_id')}, {_step('q1', 'lo', 'tail2', _NONE, keys='graph_id')} {_LOGITS}")
def tissue_graph_logits(spark, sf):
    t = _tissue(spark, sf).withColumn("h", F.concat(N.zeros(16), "h"))
    return long(N.classify(t, _ring(spark, sf), N.Stack(TISSUE.layers, "none", "sum"), ["tail1", "tail2"], weights(spark)), "logits", "graph_id")


@query("SELECT c_mktsegment || 'VS' || c_name AS split, 2 AS classes FROM customer")
def class_count(spark, sf):
    split = F.concat_ws("VS", "c_mktsegment", "c_name")
    return X.table(spark, sf, "customer").select(split.alias("split"), N.number_of_classes(split).alias("classes"))


# Explanations: the tests compare them with a brute-force pass and with finite differences.


@query()
def gradcam_nodes(spark, sf):
    return E.grad_cam(nodes(spark, sf), X.links(spark, sf), STACK, ["head1", "head2"], weights(spark), [0, 1, 2])


@query()
def gradcampp_nodes(spark, sf):
    return E.grad_cam(nodes(spark, sf), X.links(spark, sf), STACK, ["head1", "head2"], weights(spark), plus_plus=True)


@query()
def lrp_nodes(spark, sf):
    return E.relevance(nodes(spark, sf), X.links(spark, sf), LAST, ["tail1", "tail2"], weights(spark))


@query()
def pruned_importance(spark, sf):
    return E.thresholded_importance(gradcam_nodes(spark, sf), 0.5)


@query()
def pruning_explainer(spark, sf):
    return E.pruned(nodes(spark, sf), X.links(spark, sf), STACK, ["head1", "head2"], weights(spark))
