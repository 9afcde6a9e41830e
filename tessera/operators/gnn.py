"""Graph networks as joins and aggregates: message passing is edges joined with source nodes and grouped by destination.

Nodes are tables (graph_id, node_id, h array<double>), edges (graph_id, src, dst); a batch of graphs is one table. A layer is an equi-join on the source, a grouping with map-side partial
aggregates for each dimension, and an equi-join back; a dense layer is an array expression over weights, which are literals of the plan: their size is the model's, not the data's.
Layers of a stack end in tables of the shared folder, because each is read twice by the next one. Nodes without a message aggregate to zeros.

Weights are a table (layer string, j int, w array<double>, b double): the weights and the bias of output j of a dense layer.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import cut

ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
    "prelu": lambda x: F.when(x > 0, x).otherwise(0.25 * x),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
}
REDUCE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


class Weights(dict):
    """Dense layers by name: rows of (weights, bias), one an output."""

    @classmethod
    def load(cls, table: DataFrame) -> Weights:
        """From a weights table; a model's size is all that reaches the driver."""
        out = cls()
        for r in sorted(table.collect(), key=lambda r: (r.layer, r.j)):
            out.setdefault(r.layer, []).append((list(r.w), r.b))
        return out

    def literal(self, layer: str) -> Column:
        text = json.dumps([{"w": w, "b": b} for w, b in self[layer]])
        return F.from_json(F.lit(text), "array<struct<w:array<double>,b:double>>")

    def matrix(self, layer: str, transposed: bool = False, positive: bool = False) -> Column:
        rows = [[max(x, 0.0) if positive else x for x in w] for w, _ in self[layer]]
        return F.from_json(F.lit(json.dumps([list(c) for c in zip(*rows)] if transposed else rows)), "array<array<double>>")


def synthetic(spark: SparkSession, shapes: dict[str, tuple[int, int]]) -> DataFrame:
    """Deterministic weights for layers (inputs, outputs); the n-th layer has number n."""
    parts = None
    for n, (name, (inputs, outputs)) in enumerate(shapes.items()):
        j = F.col("id")
        w = F.transform(F.sequence(F.lit(0), F.lit(inputs - 1)), lambda i: ((i * 31 + j * 17 + n * 7) % 97 - 48) / F.lit(97.0))  # noqa: B023
        one = spark.range(outputs).select(F.lit(name).alias("layer"), j.cast("int").alias("j"), w.alias("w"), ((j * 13 % 11 - 5) / F.lit(11.0)).alias("b"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def times(rows: Column, h: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return let(h, lambda x: F.transform(rows, lambda r: dot(r, x)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def linear(h: Column, weights: Weights, layer: str) -> Column:
    return let(h, lambda x: F.transform(weights.literal(layer), lambda r: dot(r["w"], x) + r["b"]))


def batch_norm(h: Column, mean: list[float], var: list[float], gamma: list[float], beta: list[float], eps: float = 1e-5) -> Column:
    """Inference: an affine map of each dimension."""
    scale = [g / math.sqrt(v + eps) for g, v in zip(gamma, var)]
    maps = F.from_json(F.lit(json.dumps([{"a": s, "c": b - m * s} for s, m, b in zip(scale, mean, beta)])), "array<struct<a:double,c:double>>")
    return F.zip_with(h, maps, lambda x, m: x * m["a"] + m["c"])


def mlp(h: Column, weights: Weights, layers: list[str], act: str = "relu") -> Column:
    """Dense layers with an activation after all but the last."""
    if act not in ACTIVATIONS:
        raise ValueError(f"no activation {act}; there are {sorted(ACTIVATIONS)}")
    for k, layer in enumerate(layers):
        h = linear(h, weights, layer)
        if k < len(layers) - 1:
            h = F.transform(h, ACTIVATIONS[act])
    return h


def softmax(h: Column) -> Column:
    return let(F.transform(h, lambda x: F.exp(x - F.array_max(h))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda n, y: n + y)))


def argmax(h: Column) -> Column:
    """Position of the largest value, the first of equals."""
    return F.array_position(h, F.array_max(h)).cast("int") - 1


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def gather(edges: DataFrame, nodes: DataFrame, value: Column, width: int, how: str = "mean", frm: str = "src", to: str = "dst") -> DataFrame:
    """graph_id, node_id, m: for each node the reduced `value` of the nodes at the other end of its edges."""
    side = nodes.select("graph_id", F.col("node_id").alias("_from"), value.alias("_m"))
    met = edges.select("graph_id", F.col(frm).alias("_from"), F.col(to).alias("_to")).join(side, ["graph_id", "_from"])
    return met.groupBy("graph_id", F.col("_to").alias("node_id")).agg(F.array(*[REDUCE[how](F.col("_m")[i]) for i in range(width)]).alias("m"))


def with_messages(nodes: DataFrame, messages: DataFrame, width: int) -> DataFrame:
    return nodes.join(messages, ["graph_id", "node_id"], "left").withColumn("m", F.coalesce("m", zeros(width)))


def graph_norm(nodes: DataFrame) -> DataFrame:
    """h times the square root of one over its graph's node count."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    return nodes.join(n, "graph_id").withColumn("h", F.transform("h", lambda x: x * F.sqrt(1 / F.col("_n")))).drop("_n")


@dataclass(frozen=True)
class Gin:
    """A GIN layer: relu(MLP(aggregate(neighbours) + own)), then norms. norm: mean, var, gamma and beta of batch norm."""

    inputs: int
    layers: tuple[str, str]
    outputs: int
    agg: str = "mean"
    act: str = "relu"
    graph_norm: bool = False
    norm: tuple | None = None

    def before(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """nodes with z, what the layer's MLP sees."""
        return with_messages(nodes, gather(edges, nodes, F.col("h"), self.inputs, self.agg), self.inputs).withColumn("z", plus(F.col("m"), F.col("h"))).drop("m")

    def __call__(self, nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
        out = self.before(nodes, edges).withColumn("h", F.transform(mlp(F.col("z"), weights, list(self.layers), self.act), ACTIVATIONS["relu"])).drop("z")
        if self.graph_norm:
            out = graph_norm(out)
        return out.withColumn("h", batch_norm(F.col("h"), *self.norm)) if self.norm else out


def dense_gin(nodes: DataFrame, adjacency: DataFrame, weights: Weights, layers: list[str], inputs: int, normalize: str | None = "col", add_self: bool = True, act: str = "relu") -> DataFrame:
    """GIN over adjacency(graph_id, src, dst, w), row src and column dst: relu(MLP((A / degree + I) h)). normalize: degrees are sums of columns or of rows; none for None."""
    a = adjacency.select("graph_id", "src", "dst", "w")
    if normalize:
        key = "dst" if normalize == "col" else "src"
        degree = a.groupBy("graph_id", key).agg(F.sum("w").alias("degree"))
        a = a.join(degree, ["graph_id", key]).withColumn("w", F.col("w") / F.when(F.col("degree") == 0, 1.0).otherwise(F.col("degree")))
    side = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("h").alias("_m"))
    met = a.join(side, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array(*[F.sum(F.col("w") * F.col("_m")[i]) for i in range(inputs)]).alias("m"))
    z = plus(F.col("m"), F.col("h")) if add_self else F.col("m")
    return with_messages(nodes, met, inputs).withColumn("h", F.transform(mlp(z, weights, layers, act), ACTIVATIONS["relu"])).drop("m")


def _scaled(h: Column, by: Column) -> Column:
    return F.transform(h, lambda x: x * by)


AGGREGATORS = ("mean", "max", "min", "std")
SCALERS = ("identity", "amplification", "attenuation")


def pna_aggregate(messages: DataFrame, width: int, aggregators=AGGREGATORS, scalers=SCALERS, avg_d: float = 4) -> DataFrame:
    """messages(graph_id, dst, e) -> graph_id, node_id, m: every aggregate of every dimension, once for each scaler of the in-degree."""
    e = lambda i: F.col("e")[i]
    of = {
        "mean": lambda i: F.avg(e(i)), "max": lambda i: F.max(e(i)), "min": lambda i: F.min(e(i)),
        "std": lambda i: F.sqrt(F.greatest(F.avg(e(i) * e(i)) - F.avg(e(i)) * F.avg(e(i)), F.lit(0.0)) + 1e-5),
        "var": lambda i: F.greatest(F.avg(e(i) * e(i)) - F.avg(e(i)) * F.avg(e(i)), F.lit(0.0)),
    }
    out = messages.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("_d"), F.array(*[of[a](i) for a in aggregators for i in range(width)]).alias("m"))
    ratio = F.log(F.col("_d") + 1.0) / math.log(avg_d + 1)
    scale = {"identity": F.lit(1.0), "amplification": ratio, "attenuation": 1 / ratio}
    return out.select("graph_id", "node_id", F.concat(*[_scaled(F.col("m"), scale[s]) for s in scalers]).alias("m"))


@dataclass(frozen=True)
class Pna:
    """A PNA layer. towers: for each the names of its two dense layers, on messages and on what they aggregate to; mix: the mixing layer's name."""

    inputs: int
    outputs: int
    towers: tuple[tuple[str, str], ...]
    mix: str
    aggregators: tuple[str, ...] = AGGREGATORS
    scalers: tuple[str, ...] = SCALERS
    avg_d: float = 4
    divide_input: bool = True
    residual: bool = True
    graph_norm: bool = False
    norm: tuple | None = None

    def __post_init__(self):
        if self.outputs % len(self.towers) or (self.divide_input and self.inputs % len(self.towers)):
            raise ValueError("the number of towers must divide the output width, and the input width where it is divided")

    def __call__(self, nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
        wide, out = self.outputs // len(self.towers), None
        for k, (pre, post) in enumerate(self.towers):
            width = self.inputs // len(self.towers) if self.divide_input else self.inputs
            part = F.slice("h", k * width + 1, width) if self.divide_input else F.col("h")
            own = nodes.select("graph_id", "node_id", part.alias("h"))
            ends = lambda end, h: own.select("graph_id", F.col("node_id").alias(end), F.col("h").alias(h))  # noqa: B023, E731
            met = edges.select("graph_id", "src", "dst").join(ends("src", "hs"), ["graph_id", "src"]).join(ends("dst", "hd"), ["graph_id", "dst"])
            messages = met.select("graph_id", "dst", F.transform(linear(F.concat("hs", "hd"), weights, pre), ACTIVATIONS["relu"]).alias("e"))
            seen = with_messages(own, pna_aggregate(messages, wide, self.aggregators, self.scalers, self.avg_d), wide * len(self.aggregators) * len(self.scalers))
            tower = seen.select("graph_id", "node_id", F.transform(linear(F.concat("h", "m"), weights, post), ACTIVATIONS["relu"]).alias("h"))
            tower = graph_norm(tower) if self.graph_norm else tower
            tower = tower.withColumn("h", batch_norm(F.col("h"), *self.norm)) if self.norm else tower
            out = tower if out is None else out.join(tower.withColumnRenamed("h", "_next"), ["graph_id", "node_id"]).select("graph_id", "node_id", F.concat("h", "_next").alias("h"))
        mixed = out.select("graph_id", "node_id", F.transform(linear(F.col("h"), weights, self.mix), ACTIVATIONS["leaky_relu"]).alias("_mixed"))
        both = nodes.join(mixed, ["graph_id", "node_id"])
        return both.withColumn("h", plus(F.col("h"), F.col("_mixed")) if self.residual and self.inputs == self.outputs else F.col("_mixed")).drop("_mixed")


@dataclass(frozen=True)
class Lstm:
    """A layer readout: a bidirectional LSTM over a node's layers scores them, and the softmax of the scores weighs their outputs.

    ways: for both directions the weights (4 * hidden, inputs + hidden) and biases of input, forget, cell and output gates; score: weights (2 * hidden) and bias.
    """

    ways: tuple
    score: tuple

    def __call__(self, layers: np.ndarray) -> np.ndarray:
        """layers (nodes, layers, width) -> (nodes, width)."""
        sides = []
        for (w, b), order in zip(self.ways, (1, -1)):
            w, b, hidden = np.asarray(w), np.asarray(b), len(b) // 4
            h, c, out = np.zeros((len(layers), hidden)), np.zeros((len(layers), hidden)), []
            for k in range(layers.shape[1])[::order]:
                gates = np.hstack([layers[:, k], h]) @ w.T + b
                i, f, g, o = (gates[:, n * hidden : (n + 1) * hidden] for n in range(4))
                sigmoid = lambda x: 1 / (1 + np.exp(-x))
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out.append(h)
            sides.append(np.stack(out[::order], 1))
        s = np.concatenate(sides, 2) @ np.asarray(self.score[0]) + self.score[1]
        a = np.exp(s - s.max(1, keepdims=True))
        return ((a / a.sum(1, keepdims=True))[..., None] * layers).sum(1)

    def attended(self, h: Column, count: int, width: int) -> Column:
        """Of arrays of all layers' outputs, one after another."""

        def run(column: pa.Array) -> pa.Array:
            out = self(np.asarray(column.flatten()).reshape(-1, count, width))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(out).ravel()))

        return F.arrow_udf(run, "array<double>")(h)


@dataclass(frozen=True)
class Stack:
    """Layers one after another and the readout. readout: `concat` of all layers' outputs, `lstm` for their attention by `lstm`, or `none` for the last one's alone; reduce: over the nodes of a graph."""

    layers: tuple = field(default_factory=tuple)
    readout: str = "concat"
    reduce: str = "mean"
    lstm: Lstm | None = None

    def __post_init__(self):
        if self.readout not in ("concat", "lstm", "none") or (self.readout == "lstm") != (self.lstm is not None):
            raise ValueError("readout must be concat, lstm with its weights, or none")
        if len(self.layers) < 2:
            raise ValueError("a stack has an input and an output layer at least")

    @property
    def width(self) -> int:
        return sum(x.outputs for x in self.layers) if self.readout == "concat" else self.layers[-1].outputs

    def node_embeddings(self, nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
        """graph_id, node_id, h."""
        edges = cut(edges.select("graph_id", "src", "dst"), "edges")
        state = nodes.select("graph_id", "node_id", "h", F.array().cast("array<double>").alias("all"))
        for layer in self.layers:
            state = cut(layer(state, edges, weights).withColumn("all", F.concat("all", "h")), "layer")
        if self.readout == "lstm":
            return state.select("graph_id", "node_id", self.lstm.attended(F.col("all"), len(self.layers), self.width).alias("h"))
        return state.select("graph_id", "node_id", F.col("all" if self.readout == "concat" else "h").alias("h"))

    def graph_embeddings(self, nodes: DataFrame, edges: DataFrame, weights: Weights) -> DataFrame:
        """graph_id, h."""
        return read_out(self.node_embeddings(nodes, edges, weights), self.width, self.reduce)


def read_out(nodes: DataFrame, width: int, reduce: str = "mean") -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.array(*[REDUCE[reduce](F.col("h")[i]) for i in range(width)]).alias("h"))


def classify(nodes: DataFrame, edges: DataFrame, stack: Stack, head: list[str], weights: Weights) -> DataFrame:
    """Cell-graph or tissue-graph classifier: graph_id, logits."""
    return stack.graph_embeddings(nodes, edges, weights).select("graph_id", mlp(F.col("h"), weights, head).alias("logits"))


def roll_up(low: DataFrame, assignment: DataFrame, high: DataFrame, width: int) -> DataFrame:
    """high(graph_id, node_id, h) with the sum of its assigned low nodes' features in front; nodes without any get zeros."""
    pairs = assignment.select("graph_id", F.col("low_id").alias("node_id"), "high_id").join(low, ["graph_id", "node_id"])
    sums = pairs.groupBy("graph_id", F.col("high_id").alias("node_id")).agg(F.array(*[F.sum(F.col("h")[i]) for i in range(width)]).alias("m"))
    return with_messages(high, sums, width).withColumn("h", F.concat("m", "h")).drop("m")


def classify_hierarchy(cells: DataFrame, cell_edges: DataFrame, tissue: DataFrame, tissue_edges: DataFrame, assignment: DataFrame, cell_stack: Stack, tissue_stack: Stack, head: list[str], weights: Weights) -> DataFrame:
    """Hierarchical classifier: graph_id, logits."""
    if cell_stack.readout != tissue_stack.readout:
        raise ValueError("both stacks need the same readout")
    low = cell_stack.node_embeddings(cells, cell_edges, weights)
    return classify(cut(roll_up(low, assignment, tissue, cell_stack.width), "tissue"), tissue_edges, tissue_stack, head, weights)


def number_of_classes(split: str | Column) -> Column:
    """Classes of a split such as `benignVSatypicalVSmalignant`."""
    return F.size(F.split(F.col(split) if isinstance(split, str) else split, "VS"))
