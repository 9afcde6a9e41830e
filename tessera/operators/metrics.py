"""Segmentation metrics over a confusion table (pred, truth, n)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTH = 1e-12


def confusion(pairs: DataFrame, classes: int, background: int | None = None, mask: Column | None = None) -> DataFrame:
    """pairs(pred, truth): counts of every pair of classes, zeros included; background truth and masked-out pixels do not count."""
    if background is not None:
        pairs = pairs.filter(F.col("truth") != background)
    if mask is not None:
        pairs = pairs.filter(mask)
    n = pairs.groupBy("pred", "truth").agg(F.count("*").alias("n"))
    # classes * classes rows: a constant of the metric.
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = pairs.sparkSession.range(1).select(F.explode(every).alias("pred")).select("pred", F.explode(every).alias("truth"))
    return grid.join(n, ["pred", "truth"], "left").select("pred", "truth", F.coalesce("n", F.lit(0)).alias("n"))


def _sums(table: DataFrame) -> DataFrame:
    both = table.select(F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0).cast("long").alias("tp")), F.struct(F.col("truth").alias("cls"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col"), F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(F.lit(0)).alias("tp")))).alias("s")).select("s.*")
    return both.groupBy("cls").agg(F.sum("row").alias("row"), F.sum("col").alias("col"), F.sum("tp").alias("tp"))


def dice(table: DataFrame) -> DataFrame:
    """Harmonic mean of recall and precision per class, smoothed; an absent class counts as almost 0."""
    recall = (F.col("tp") + SMOOTH) / (F.col("col") + SMOOTH)
    precision = (F.col("tp") + SMOOTH) / (F.col("row") + SMOOTH)
    return _sums(table).withColumn("recall", recall).withColumn("precision", precision).select("cls", (2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).alias("dice"))


def iou(table: DataFrame) -> DataFrame:
    """TP / (TP + FP + FN) per class, null for a class that is nowhere."""
    return _sums(table).select("cls", F.try_divide("tp", F.col("row") + F.col("col") - F.col("tp")).alias("iou"))


def mean(scores: DataFrame, column: str) -> DataFrame:
    """Mean over classes, nulls left out."""
    return scores.agg(F.avg(column).alias(f"mean_{column}"))


@dataclass(frozen=True)
class Metric:
    """What a metric is to whoever keeps the best model: its scores of a confusion table, whether they are one a class, and whether a better one keeps the model."""

    scores: Callable[[DataFrame], DataFrame]
    per_class: bool = False
    logs_model: bool = True

    @staticmethod
    def is_better(value: Column, other: Column) -> Column:
        """At least as good; a value that is not defined never is."""
        return F.coalesce(value >= other, F.lit(False))


METRICS = {
    "confusion": Metric(lambda t: t),
    "dice": Metric(dice, per_class=True),
    "iou": Metric(iou, per_class=True, logs_model=False),
    "mean_dice": Metric(lambda t: mean(dice(t), "dice")),
    "mean_iou": Metric(lambda t: mean(iou(t), "iou"), logs_model=False),
}


def best(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """history with `is_better`: whether a value is at least as good as all before it in the order, undefined ones aside."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.when(~F.isnan(F.col(value)), F.col(value))).over(before)
    return history.withColumn("is_better", F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (held.isNull() | Metric.is_better(F.col(value), held)))
