"""Quality classification by co-training of two views.

The content view sees the text only: a hashed profile of byte trigrams, and shares of capitals, digits, marks, sentence ends, line feeds and repeated words. The metadata view
sees the record only: language, source and the stated number of characters. Each view is a linear discriminant, which needs no more than the rows' count, sum and second moments by class.
In every round each view labels all unlabelled rows of which it is sure, and their moments join the training rows of the other view, with the same weight in all as the
labelled rows of their class. Afterwards labelled rows that were kept out of all rounds calibrate each view, and a logistic curve over both calibrated views gives the score of every document.

Figures of all rows are written once to the shared folder, without their texts. A round is one pass over them: every task adds up moments, sums are merged on the executors in two steps, and the
driver sees one pair of moments a view. Only the figures of at most `sample` labelled ids of each class, chosen by a hash of their id, reach the driver; unlabelled rows have no bound.

Cases: null and empty texts have an empty profile and are scored from it; null language, source or length is a value of its own; rows without a
label, and labelled rows beyond the sample, are only unlabelled rows; several labels of one id count as low quality if any is; of several rows of a labelled id one is learned from; with no labelled row of a class every text scores the share
of high quality (0.5 without any); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cuts, read
from .rolling import SPACE, Rolling, again, chunks, mix, runs, texts_of
from .toxicity import _logistic, held_out

PROFILE, BUCKETS = 256, 16
SAMPLE = 2000
ROUNDS, SURE = 3, 0.97
RIDGE = 0.05

_UPPER, _DIGIT, _MARK, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[list(b"#*$%&|<>{}[]=_~^\\")] = True
_STOP[list(b".!?")] = True


class Content:
    """The content view's figures for a run of texts."""

    width = PROFILE + 7

    def __init__(self) -> None:
        self.rolling = Rolling()

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        docs = len(starts)
        doc = np.repeat(np.arange(docs), ends - starts)
        profile = np.zeros((docs, PROFILE))
        if len(b) > 2:
            x = b.astype(np.uint32)
            three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
            three = (three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(24)
            inside = doc[:-2] == doc[2:]
            profile = np.bincount((doc[:-2] * PROFILE + three)[inside], minlength=docs * PROFILE).reshape(docs, PROFILE).astype(float)
        size = np.maximum(ends - starts, 1)
        opens, closes = runs(~SPACE[b], starts, ends)
        of = np.searchsorted(ends, opens, side="right")
        words = np.bincount(of, minlength=docs)
        _, later = again(self.rolling.over(b)(opens, closes) ^ mix(of.astype(np.uint64) + np.uint64(1)))
        count = lambda table: np.bincount(doc, table[b], minlength=docs)
        each = np.maximum(words, 1)
        shares = [
            np.minimum((size - count(SPACE)) / each, 30.0) / 30, count(_UPPER) / size, count(_DIGIT) / size, count(_MARK) / size,
            count(_STOP) / each, np.bincount(doc, b == 10, minlength=docs) / each, np.bincount(of[later], minlength=docs) / each,
        ]
        return np.hstack([np.sqrt(profile / size[:, None]), np.stack(shares, 1)])


METADATA = 2 * BUCKETS + 3


def metadata(langs: list, sources: list, sizes: list) -> np.ndarray:
    """The metadata view's figures."""
    out = np.zeros((len(langs), METADATA))
    for side, values in enumerate((langs, sources)):
        at = [zlib.crc32(repr(v).encode()) % BUCKETS + side * BUCKETS for v in values]
        out[np.arange(len(values)), at] = 1
    log = np.array([0.0 if n is None else np.log1p(max(n, 0)) / 10 for n in sizes])
    out[:, -3:] = np.stack([log, log**2, [n is None for n in sizes]], 1)
    return out


FIGURES = "content binary, metadata binary"
_WIDTH = (Content.width, METADATA)


def figures(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", source: str = "source", size: str = "n_chars") -> DataFrame:
    """id and FIGURES (half-precision numbers) for each row of docs; columns that docs lacks count as null."""
    kind = docs.schema[id].dataType.simpleString()
    of = lambda c, to: (F.col(c) if c in docs.columns else F.lit(None)).cast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            record = metadata(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            for a, z in chunks(offsets, 1 << 20):
                own = offsets[a : z + 1]
                both = content(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0]), record[a:z]
                packed = [pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary()) for x in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *packed], names=[id, "content", "metadata"])

    return docs.select(F.col(id), of(text, "string").alias("_text"), of(lang, "string").alias("_lang"), of(source, "string").alias("_source"), of(size, "long").alias("_size")).mapInArrow(run, f"`{id}` {kind}, {FIGURES}")


def _rows(column: pa.Array, view: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(-1, _WIDTH[view]).astype(np.float64)


class Moments:
    """Count, sum and second moments of rows."""

    def __init__(self, width: int):
        self.n, self.sum, self.second = 0.0, np.zeros(width), np.zeros((width, width))

    def add(self, x: np.ndarray) -> None:
        self.n, self.sum, self.second = self.n + len(x), self.sum + x.sum(0), self.second + x.T @ x

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.sum, self.second.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: np.ndarray, width: int) -> Moments:
        out = cls(width)
        out.n, out.sum, out.second = raw[0], raw[1 : 1 + width], raw[1 + width :].reshape(width, width)
        return out


@dataclass
class Model:
    weights: list[np.ndarray] = field(default_factory=list)
    curves: list[np.ndarray] = field(default_factory=list)
    combine: np.ndarray | None = None
    constant: float | None = None

    def raw(self, view: int, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[view][:-1] + self.weights[view][-1], -50, 50)

    def logits(self, views) -> np.ndarray:
        return np.stack([self.raw(v, x) * self.curves[v][0] + self.curves[v][1] for v, x in enumerate(views)], 1)

    def __call__(self, views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated content and metadata scores and the combined one."""
        if self.constant is not None:
            same = np.full(len(views[0]), self.constant)
            return same, same, same
        logits = self.logits(views)
        return _sigmoid(logits[:, 0]), _sigmoid(logits[:, 1]), _sigmoid(logits @ self.combine[:2] + self.combine[2])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discriminant(classes: list[list[Moments]]) -> np.ndarray:
    """Weights and constant from each class's moments: labelled rows and, with the same weight in all, those that the other view labelled."""
    means, spread = [], 0.0
    for parts in classes:
        parts = [m for m in parts if m.n]
        mean = np.mean([m.sum / m.n for m in parts], axis=0)
        means.append(mean)
        spread = spread + (np.mean([m.second / m.n for m in parts], axis=0) - np.outer(mean, mean)) / 2
    scale = np.trace(spread) / len(spread) or 1.0
    w = np.linalg.solve(spread + RIDGE * scale * np.eye(len(spread)), means[1] - means[0])
    return np.append(w, -w @ (means[0] + means[1]) / 2)


def fit_calibrated(model: Model, views, y: np.ndarray) -> None:
    raw = [model.raw(v, x) for v, x in enumerate(views)]
    model.curves = [_logistic(r[:, None], y, ridge=0.1) for r in raw]
    model.combine = _logistic(model.logits(views), y, ridge=0.1)


def exchange(table: DataFrame, model: Model, sure: float) -> dict[tuple[int, int], Moments]:
    """One round over table(labelled, FIGURES): by (view, class), the moments of the unlabelled rows that the other view is sure of."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(v, c): Moments(_WIDTH[v]) for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            views = [_rows(batch.column(v), v) for v in (0, 1)]
            p = _sigmoid(model.logits(views))
            for v in (0, 1):
                held[v, 1].add(views[v][p[:, 1 - v] >= sure])
                held[v, 0].add(views[v][p[:, 1 - v] <= 1 - sure])
        yield _packed({k: m.pack() for k, m in held.items() if m.n}, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for view, cls, raw in zip(*(batch.column(k).to_pylist() for k in ("view", "cls", "moments"))):
                one = np.frombuffer(raw)
                total[view, cls] = total[view, cls] + one if (view, cls) in total else one
        yield _packed({k: x.tobytes() for k, x in total.items()}, TaskContext.get().partitionId())

    schema = "view int, cls int, part int, moments binary"
    parts = table.filter("NOT labelled").select("content", "metadata").mapInArrow(add, schema)
    # First within 16 shares of the tasks, then one row a view and class.
    sums = parts.repartition(16, "view", "cls", F.pmod("part", F.lit(16))).mapInArrow(merge, schema).repartition(4, "view", "cls").mapInArrow(merge, schema)
    return {(r.view, r.cls): Moments.unpack(np.frombuffer(r.moments), _WIDTH[r.view]) for r in sums.collect()}


def _packed(moments: dict[tuple[int, int], bytes], part: int) -> pa.RecordBatch:
    views, classes = [k[0] for k in moments], [k[1] for k in moments]
    return pa.RecordBatch.from_arrays([pa.array(views, pa.int32()), pa.array(classes, pa.int32()), pa.array([part] * len(views), pa.int32()), pa.array(list(moments.values()), pa.binary())], names=["view", "cls", "part", "moments"])


def train(figs: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS, sure: float = SURE, trace: list[Model] | None = None) -> Model:
    """Learns from `figures` of all rows and the labels of some. trace: gets the calibrated model of every round."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    order = F.xxhash64("_id")
    picks = marked.filter("_y = 1").orderBy(order, "_id").limit(sample).unionByName(marked.filter("_y <> 1").orderBy(order, "_id").limit(sample))
    # One row an id: at most 2 * sample rows of figures, whatever the tables hold.
    own = figs.join(F.broadcast(picks), F.col(id) == F.col("_id")).groupBy(F.col("_id").cast("string").alias("i"), "_y").agg(F.min(F.struct("content", "metadata")).alias("f"))
    rows = sorted(own.select("i", "_y", "f.content", "f.metadata").collect(), key=lambda r: (zlib.crc32(f"order {r.i}".encode()), r.i))
    y = np.array([min(max(r._y, 0), 1) for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    views = [_rows(pa.array([bytes(r[c]) for r in rows]), v) for v, c in enumerate(("content", "metadata"))]
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    apart = nth % 4 == 0
    if not 0 < y[apart].sum() < apart.sum():
        apart = np.ones(len(y), bool)
    learn = ~apart if not apart.all() else apart
    own = {(v, c): Moments(_WIDTH[v]) for v in (0, 1) for c in (0, 1)}
    for (v, c), m in own.items():
        m.add(views[v][learn & (y == c)])
    # The sample's ids are few and known: figures stay where they are. Labelled rows beyond the sample count as unlabelled.
    table = figs.join(F.broadcast(picks.select("_id")), F.col(id) == F.col("_id"), "left").select("content", "metadata", F.col("_id").isNotNull().alias("labelled"))
    given: dict = {}
    for turn in range(rounds + 1):
        model = Model([discriminant([[own[v, c], *([given[v, c]] if (v, c) in given else [])] for c in (0, 1)]) for v in (0, 1)])
        fit_calibrated(model, [x[apart] for x in views], y[apart])
        if trace is not None:
            trace.append(model)
        if turn == rounds:
            break
        before, given = given, exchange(table, model, sure)
        if {k: m.n for k, m in before.items()} == {k: m.n for k, m in given.items()}:
            break
    return model


def score(figs: DataFrame, model: Model, id: str = "doc_id") -> DataFrame:
    """id, content_score, metadata_score, score for each row of `figures`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                got = model([_rows(part.column(1 + v), v) for v in (0, 1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got)], names=[id, "content_score", "metadata_score", "score"])

    kind = figs.schema[id].dataType.simpleString()
    return figs.select(id, "content", "metadata").mapInArrow(run, f"`{id}` {kind}, content_score double, metadata_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", trace: list[Model] | None = None) -> DataFrame:
    """`score` of docs by a model trained on them and the labels of some."""
    figs = Cuts(docs.sparkSession).table(figures(docs, id=id), "figures")
    return score(figs, train(figs, labels, id, trace=trace), id)


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
