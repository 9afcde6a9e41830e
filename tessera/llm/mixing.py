"""Mixing sources to target weights by iterative proportional fitting.

A topic is a cluster of documents by their words: hashed profiles of all documents, `ROUNDS` Lloyd rounds from the octants of three fixed directions around the mean
profile. Each round is a partial sum over the table of profiles and brings `TOPICS` means to the driver. A topic column takes its place where documents have one.

Tokens are counted by cell (source, language, topic). The share `keep` of all tokens is to stay. Raking scales the cells' weights per token in turn until the weighted tokens of
every source, language and topic meet their target share of that budget. A weight is the probability with which each document of the cell is kept, so after every sweep it is held
to at most 1 and at least keep / `trim`. A target that these bounds cannot give for its value alone is first moved to the bound, and the other values of the axis
take the difference in proportion (`reachable`). What targets of several axes ask of each other can still be out of reach: then `keep` is lowered step by step, as smaller budgets leave small
cells more room. The draw is a hash of the document: the same in every run and on every retry.

Sweeps go on until all targets are met up to `close` or no longer come closer; `gaps` tells what each value wanted and got, and misses are logged. More than `few` cells stay a DataFrame:
a sweep is a partial aggregate and a join over cells for each axis, cut by a table in the shared folder. Fewer cells are raked on the driver.
Documents meet their cell by an equi-join; a cell with a third of all documents is only a probability for them.

Cases: null source or language is a value of its own; null text has no tokens and the topic `empty`; documents of cells without tokens are kept;
repeated rows are drawn alike; values that targets do not name keep their own share of tokens; an empty table gives an empty result; other columns are carried along in `row`.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cuts, read, whole
from .rolling import SPACE, Rolling, chunks, runs, texts_of

AXES = ("source", "lang", "topic")
KEEP, TEMPERATURE, TRIM, CLOSE = 0.75, 0.8, 4.0, 1e-3
#: Where the targets cannot be met at `keep`, it is lowered by STEP at a time, down to LEAST_KEEP.
STEP, LEAST_KEEP = 0.05, 0.4
#: Raking has stalled if its gap fell by less than LEAST_FALL over the last STALL sweeps.
STALL, LEAST_FALL = 20, 1e-6
#: Up to so many cells the sweeps run on the driver, with the same figures as the sweeps in Spark.
FEW = 1 << 16
TOPICS, PROFILE, ROUNDS = 8, 64, 3

_log = logging.getLogger(__name__)


def profiled(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: words of each, and its profile, the square roots of hashed word counts as a unit vector."""
    rolling = Rolling()
    offsets, data = texts_of(texts)
    for a, z in chunks(offsets, 1 << 20):
        own = offsets[a : z + 1] - offsets[a]
        b, docs = data[offsets[a] : offsets[z]], z - a
        opens, closes = runs(~SPACE[b], own[:-1], own[1:])
        doc = np.searchsorted(own[1:], opens, side="right")
        bucket = (rolling.over(b)(opens, closes) >> np.uint64(58)).astype(np.int64)
        counts = np.sqrt(np.bincount(doc * PROFILE + bucket, minlength=docs * PROFILE).reshape(docs, PROFILE))
        words = np.bincount(doc, minlength=docs)
        yield words, (counts / np.sqrt(np.maximum(words, 1))[:, None]).astype(np.float32)


def nearest(profile: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each profile, the first of equals; a center of NaN has no members."""
    distance = (centers**2).sum(1) - 2 * (profile.astype(float) @ centers.T)
    return np.where(np.isnan(distance), np.inf, distance).argmin(1)


def _names(words: np.ndarray, profile: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.array([f"topic {k}" for k in range(len(centers))] + ["empty"], object)[np.where(words == 0, len(centers), nearest(profile, centers))]


def _octants(profile: np.ndarray, mean: np.ndarray) -> np.ndarray:
    side = (profile - mean) @ np.random.default_rng(11).choice([-1.0, 1.0], (PROFILE, 3)) > 0
    return side @ np.array([1, 2, 4])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, PROFILE)


def _means(table: DataFrame, group) -> np.ndarray:
    """Mean profile of each of TOPICS groups (group: profiles -> numbers) of the documents with words; NaN without members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((TOPICS, PROFILE)), np.zeros(TOPICS, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            of = group(x)
            n += np.bincount(of, minlength=TOPICS)
            for k in np.unique(of):
                sums[k] += x[of == k].sum(0)
        k = np.repeat(np.arange(TOPICS), PROFILE)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.tile(np.arange(PROFILE), TOPICS)), pa.array(sums.ravel()), pa.array(n[k])], names=["k", "d", "s", "n"])

    out = np.full((TOPICS, PROFILE), np.nan)
    for r in table.filter("tokens > 0").select("profile").mapInArrow(run, "k long, d long, s double, n long").groupBy("k", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").collect():
        out[r.k, r.d] = r.s / r.n
    return out


def topics(table: DataFrame) -> np.ndarray:
    """table(tokens, profile) -> centers of the topics."""
    mean = np.nan_to_num(_means(table, lambda x: np.zeros(len(x), np.int64))[0])
    centers = _means(table, lambda x: _octants(x, mean))
    for _ in range(ROUNDS):
        before = centers
        centers = _means(table, lambda x: nearest(x, before))
    return centers


def tempered(cells: DataFrame, axis: str, temperature: float) -> DataFrame:
    """Target shares of an axis: its token shares to the power of temperature."""
    own = cells.groupBy(F.col(axis).alias("value")).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    total = own.agg(F.sum(F.pow("tokens", F.lit(temperature))).alias("total"))
    # `total` is one row.
    return own.crossJoin(F.broadcast(total)).select("value", (F.pow("tokens", F.lit(temperature)) / F.col("total")).alias("share"))


def _done(gaps: list[float], close: float) -> bool:
    return gaps[-1] < close or (len(gaps) > STALL and gaps[-1 - STALL] - gaps[-1] < LEAST_FALL)


def reachable(tokens: np.ndarray, share: np.ndarray, keep: float, trim: float) -> np.ndarray:
    """Target shares of an axis's values with each within what weights of keep / trim to 1 can give it; NaN is no target."""
    named = ~np.isnan(share) & (tokens > 0)
    out, part = share.copy(), tokens / max(tokens.sum(), 1)
    low, high, free = part / trim, part / keep, named.copy()
    total = share[named].sum()
    while free.any():
        want = share[free] * max(total - out[named & ~free].sum(), 0.0) / max(share[free].sum(), 1e-300)
        over, under = np.maximum(want - high[free], 0), np.maximum(low[free] - want, 0)
        at = np.flatnonzero(free)
        out[at] = want
        # The larger of the two sides is settled first; the other one may come right by itself.
        bound, hit = (high, over > 0) if over.sum() >= under.sum() else (low, under > 0)
        if not hit.any():
            break
        out[at[hit]] = bound[at[hit]]
        free[at[hit]] = False
    return out


def _reachable_many(cuts: Cuts, values: DataFrame, keep: float, trim: float) -> DataFrame:
    """`reachable` over values(w, tokens, share) as a DataFrame."""
    whole = F.broadcast(values.agg(F.sum("tokens").alias("t"), F.sum("share").alias("s")))  # one row
    state = cuts.table(values.crossJoin(whole).select("w", "share", "s", (F.col("tokens") / F.col("t") / trim).alias("low"), (F.col("tokens") / F.col("t") / keep).alias("high"), F.lit(None).cast("double").alias("held")), "reachable")
    while True:
        sums = state.agg(F.max("s").alias("s"), F.sum("held").alias("held"), F.sum(F.when(F.col("held").isNull(), F.col("share"))).alias("free")).first()
        if not sums.free:
            return state.select("w", F.coalesce("held", "share").alias("share"))
        want = F.col("share") * (max(sums.s - (sums.held or 0.0), 0.0) / sums.free)
        moved = state.withColumn("want", F.when(F.col("held").isNull(), want))
        side = moved.agg(F.sum(F.greatest(F.col("want") - F.col("high"), F.lit(0.0))).alias("over"), F.sum(F.greatest(F.col("low") - F.col("want"), F.lit(0.0))).alias("under")).first()
        if not side.over and not side.under:
            return moved.select("w", F.coalesce("held", "want").alias("share"))
        bound, hit = ("high", F.col("want") > F.col("high")) if side.over >= side.under else ("low", F.col("want") < F.col("low"))
        after = cuts.table(moved.withColumn("held", F.coalesce("held", F.when(hit, F.col(bound)))).drop("want"), "reachable")
        cuts.drop(state)
        state = after


def _rake_few(rows: list, axes: list[str], share: dict[str, dict], keep: float, trim: float, close: float) -> tuple[np.ndarray, float]:
    """The sweeps of `rake` over at most FEW cells: a weight for each, and the gap left."""
    tokens, weight = np.array([r["tokens"] for r in rows], float), np.full(len(rows), keep)
    budget, least, of, want = tokens.sum() * keep, [], {}, {}
    for a in axes:
        at: dict = {}
        of[a] = np.array([at.setdefault(r[a], len(at)) for r in rows])
        want[a] = reachable(np.bincount(of[a], tokens), np.array([share[a].get(v, np.nan) for v in at], float), keep, trim)
    while not least or not _done(least, close):
        gap = 0.0
        for a in axes:
            have = np.bincount(of[a], tokens * weight)
            gap = max(gap, np.nan_to_num(np.abs(want[a] - have / budget)).max())
            factor = np.divide(want[a] * budget, have, out=np.ones(len(have)), where=(have > 0) & ~np.isnan(want[a]))
            weight = weight * factor[of[a]]
        weight = np.clip(weight, keep / trim, 1.0)
        least.append(gap)
    left = [np.abs(np.array([share[a].get(v, np.nan) for v in dict.fromkeys(r[a] for r in rows)], float) - np.bincount(of[a], tokens * weight) / budget) for a in axes]
    return weight, max(float(np.nan_to_num(x).max()) for x in left)


def gaps(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP) -> DataFrame:
    """axis, value, wanted, got for every value that a target names: its share of the budget as wanted and under `weight`."""
    some, out = cells.filter("tokens > 0"), None
    budget = (some.agg(F.sum("tokens")).first()[0] or 0) * keep
    for axis, target in targets.items():
        have = some.groupBy(F.col(axis).alias("v")).agg(F.try_divide(F.sum(F.col("tokens") * F.col("weight")), F.lit(float(budget))).alias("got"))
        both = have.join(target.select(F.col("value").alias("w"), "share"), F.col("v").eqNullSafe(F.col("w")))
        one = both.select(F.lit(axis).alias("axis"), F.col("v").cast("string").alias("value"), F.col("share").alias("wanted"), "got")
        out = one if out is None else out.unionByName(one)
    return out


def missed(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP) -> dict[str, float]:
    """By axis, the largest gap between a value's target share and its share of the budget under `weight`."""
    found = gaps(cells, targets, keep).groupBy("axis").agg(F.max(F.abs(F.col("wanted") - F.col("got"))).alias("gap")).collect()
    return {a: 0.0 for a in targets} | {r.axis: r.gap or 0.0 for r in found}


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, trim: float = TRIM, close: float = CLOSE, few: int = FEW, least_keep: float = LEAST_KEEP) -> tuple[DataFrame, float]:
    """cells(*axes, tokens) and targets by axis (value, share) -> cells with the probability `weight`, and the share kept: `keep`, or the largest step under it at which all targets are met.

    Sweeps go on until every target is met up to `close` or the gap has stalled. If no step meets the targets the one with the least gap is taken; what the returned weights miss is logged by axis.
    """
    cuts = Cuts(cells.sparkSession)
    axes = list(targets)
    some = cells.filter("tokens > 0").select(*axes, "tokens")
    share = {a: cuts.table(targets[a].select(F.col("value").alias("w"), "share"), "target") for a in axes}
    rows = some.limit(few + 1).collect()
    on_driver = 0 < len(rows) <= few
    if on_driver:
        known = {a: {r["w"]: r["share"] for r in share[a].join(F.broadcast(some.select(F.col(a).alias("v")).distinct()), F.col("v").eqNullSafe(F.col("w")), "left_semi").collect()} for a in axes}
    best, at = None, keep
    while best is None or (best[1] >= close and at >= min(least_keep, keep)):
        weights, gap = _rake_few(rows, axes, known, at, trim, close) if on_driver else _rake_many(cuts, some, axes, share, at, trim, close)
        if best is None or gap < best[1] - LEAST_FALL:
            best = weights, gap, at
        at -= STEP
    weights, _, kept = best
    if on_driver:
        schema = T.StructType([*some.schema.fields, T.StructField("weight", T.DoubleType())])
        weights = cells.sparkSession.createDataFrame([(*r, float(w)) for r, w in zip(rows, weights)], schema)
    if rows:
        for axis, gap in missed(weights, targets, kept).items():
            if gap >= close:
                _log.warning("raking misses a target of %s by a share of %.6f", axis, gap)
    return weights, kept


def _rake_many(cuts: Cuts, some: DataFrame, axes: list[str], share: dict[str, DataFrame], keep: float, trim: float, close: float) -> tuple[DataFrame, float]:
    # `budget` is one row.
    budget = F.broadcast(some.agg((F.sum("tokens") * keep).alias("budget")))
    state, before, gaps = some.crossJoin(budget).select(*axes, "tokens", "budget", F.lit(keep).alias("weight")), None, []
    held = F.greatest(F.least("weight", F.lit(1.0)), F.lit(keep / trim))
    asked, share, short = share, {}, 0.0
    for axis in axes:
        own = some.groupBy(F.col(axis).alias("v")).agg(F.sum("tokens").alias("tokens"))
        share[axis] = cuts.table(_reachable_many(cuts, own.join(asked[axis], F.col("v").eqNullSafe(F.col("w"))).select("w", "tokens", "share"), keep, trim), "target")
        moved = share[axis].join(asked[axis].select(F.col("w").alias("a"), F.col("share").alias("asked")), F.col("w").eqNullSafe(F.col("a")))
        short = max(short, moved.agg(F.max(F.abs(F.col("share") - F.col("asked")))).first()[0] or 0.0)
    while not gaps or not _done(gaps, close):
        gap = 0.0
        for axis in axes:
            # Each axis ends in a table: the next one reads its rows twice, not its plan.
            have = state.groupBy(F.col(axis).alias("v")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"), F.first("budget").alias("all"))
            factor = have.join(share[axis], F.col("v").eqNullSafe(F.col("w")), "left").select("v", F.coalesce(F.try_divide(F.col("share") * F.col("all"), F.col("have")), F.lit(1.0)).alias("factor"), F.abs(F.coalesce(F.col("share") - F.col("have") / F.col("all"), F.lit(0.0))).alias("gap"))
            moved = state.join(factor, F.col(axis).eqNullSafe(F.col("v"))).select(*axes, "tokens", "budget", (F.col("weight") * F.col("factor")).alias("weight"), "gap")
            after = cuts.table(moved.withColumn("weight", held) if axis == axes[-1] else moved, "rake")
            gap = max(gap, after.agg(F.max("gap")).first()[0] or 0.0)
            if before is not None:
                cuts.drop(before)
            before, state = after, after.select(*axes, "tokens", "budget", "weight")
        gaps.append(gap)
    return state.select(*axes, "tokens", "weight"), max(short, gaps[-1])


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _counted(texts: pa.Array) -> pa.Array:
    got = list(profiled(texts))
    words, profile = _joined([g[0] for g in got], np.int64), _joined([g[1].ravel() for g in got], np.float32)
    return pa.StructArray.from_arrays([pa.array(words), pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * PROFILE), pa.array(profile))], ["tokens", "profile"])


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: str | None = None, text: str = "text", id: str = "doc_id", keep: float = KEEP, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """docs(source, lang, text) -> row (struct of all columns), tokens, source, lang, topic, probability, kept."""
    cuts = Cuts(docs.sparkSession)
    given = topic is not None
    first = docs.select(F.col("source").alias("source"), F.col("lang").alias("lang"), *([F.col(topic).alias("topic")] if given else []), F.arrow_udf(_counted, "tokens long, profile array<float>")(whole(text)).alias("own"))
    table = cuts.table(first.select("source", "lang", *(["topic"] if given else []), "own.tokens", "own.profile"), "profiles")
    centers = np.zeros((1, PROFILE)) if given else topics(table)

    def label(texts: pa.Array) -> pa.Array:
        got = [(words, _names(words, profile, centers)) for words, profile in profiled(texts)]
        return pa.StructArray.from_arrays([pa.array(_joined([g[0] for g in got], np.int64)), pa.array(_joined([g[1] for g in got], object), pa.string())], ["tokens", "topic"])

    def name(tokens: pa.Array, profile: pa.Array) -> pa.Array:
        return pa.array(_names(np.asarray(tokens), _matrix(profile), centers), pa.string())

    named = table if given else table.withColumn("topic", F.arrow_udf(name, "string")("tokens", "profile"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), F.col("lang").alias("lang"), F.arrow_udf(label, "tokens long, topic string")(whole(text)).alias("own"),
    ).select("row", "source", "lang", (F.col("row").getField(topic) if given else F.col("own.topic")).alias("topic"), "own.tokens")
    cells = cuts.table(named.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "cells")
    cuts.drop(table)
    goals = {a: (targets or {}).get(a) for a in AXES}
    goals = {a: tempered(cells, a, temperature) if g is None else g for a, g in goals.items()}
    # A table, so that its size is known to the planner: a few cells are broadcast, many are not.
    rates = cuts.table(rake(cells, goals, keep)[0].select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col("weight").alias("probability")), "rates")
    same = F.lit(True)
    for a in AXES:
        same &= F.col(a).eqNullSafe(F.col(f"_{a}"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(f"row.{id}"), whole(F.col(f"row.{text}"))), F.lit(1 << 53)) / float(1 << 53)
    return rows.join(rates, same, "left").select(
        "row", "tokens", *AXES, F.coalesce("probability", F.lit(1.0)).alias("probability"), (draw < F.coalesce("probability", F.lit(1.0))).alias("kept"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("row.doc_id", "tokens", *AXES, "probability", "kept")
