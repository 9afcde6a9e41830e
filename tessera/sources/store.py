"""Results of steps as tables: memoisation, graphs, several arrays, profiles, statistics and the checkpoint registry."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def fingerprint(step: str, params: dict, parent: str = "") -> str:
    """The key of a step's results: its name, its parameters in sorted order, and the key of the step before it."""
    text = json.dumps([parent, step, params], sort_keys=True, default=str)
    return f"{step}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


class Memo:
    """Results under root/fingerprint, keyed by a column: only ids that are not there are computed."""

    def __init__(self, spark: SparkSession, root: str, step: str, params: dict, parent: str = "", key: str = "image_id"):
        self.spark, self.key, self.id = spark, key, fingerprint(step, params, parent)
        self.path = f"{root.rstrip('/')}/{self.id}"
        self.done = f"{self.path}-ids"

    def missing(self, source: DataFrame) -> DataFrame:
        """Rows of source whose id has no result. Ids count as done even where their result has no row."""
        if not exists(self.spark, self.done):
            return source
        return source.join(self.spark.read.parquet(self.done), self.key, "left_anti")

    def __call__(self, source: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results for every id of source; compute sees the missing ids' rows only.

        Results are appended before their ids are noted: a run that stops in between computes them again, and rows of an id come from one run because the id's
        earlier, unnoted rows carry another run's number.
        """
        new = self.missing(source)
        ids = new.select(self.key).distinct()
        if not ids.isEmpty():
            run = uuid.uuid4().hex
            compute(new).withColumn("_run", F.lit(run)).write.mode("append").parquet(self.path)
            ids.withColumn("_run", F.lit(run)).write.mode("append").parquet(self.done)
        if not exists(self.spark, self.done):
            return compute(new)
        noted = self.spark.read.parquet(self.done)
        wanted = noted.join(source.select(self.key).distinct(), self.key, "left_semi")
        return self.spark.read.parquet(self.path).join(wanted, [self.key, "_run"], "left_semi").drop("_run")


def write_graphs(nodes: DataFrame, edges: DataFrame, root: str, mode: str = "overwrite") -> None:
    """nodes(graph_id, ...) and edges(graph_id, src, dst, ...) under root, sorted by graph so that a read of some graphs skips the other row groups."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.repartitionByRange("graph_id").sortWithinPartitions("graph_id").write.mode(mode).parquet(f"{root}/{name}")


def read_graphs(spark: SparkSession, root: str, graphs: list | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the given graphs, or of all."""
    tables = [spark.read.parquet(f"{root}/{name}") for name in ("nodes", "edges")]
    return tuple(t if graphs is None else t.filter(F.col("graph_id").isin(graphs)) for t in tables)


def write_arrays(arrays: DataFrame, root: str, mode: str = "append") -> None:
    """arrays(name, key, value): several arrays of one name, such as a map and its centroids."""
    arrays.write.mode(mode).partitionBy("key").parquet(root)


def read_arrays(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """name and one column an array, in the order of their keys; a single key gives `value`. Keys are partitions, so others are not read."""
    table = spark.read.parquet(root)
    keys = sorted(r.key for r in table.select("key").distinct().collect()) if keys is None else keys
    one = table.filter(F.col("key").isin(keys)).groupBy("name").agg(*[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(k) for k in keys])
    return one.withColumnRenamed(keys[0], "value") if len(keys) == 1 else one


#: The default profile, two stains as optical densities of red, green and blue, and their largest concentrations.
DEFAULT_STAINS = (((0.5626, 0.7201, 0.4062), 1.9705), ((0.2159, 0.8012, 0.5581), 1.0308))
PROFILE = "profile_id string, stain int, od array<double>, max_conc double"


def stain_profile(spark: SparkSession, path: str | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """PROFILE: the table at path, or one that was just fitted, or the default one. Both at once is an error, and so is a path without a table."""
    if path is not None and fitted is not None:
        raise AssertionError("a stain profile is either fitted or loaded")
    if fitted is not None:
        return fitted
    if path is None:
        return spark.createDataFrame([("default", k, list(od), c) for k, (od, c) in enumerate(DEFAULT_STAINS)], PROFILE)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(PROFILE).parquet(path)


def append_stats(rows: DataFrame, folder: str, new: bool = False) -> None:
    """name, value rows appended as CSV with a header line a file; new: what was there goes."""
    rows.select("name", "value").write.mode("overwrite" if new else "append").option("header", True).csv(folder)


def read_stats(spark: SparkSession, folder: str, kind: str = "double") -> DataFrame:
    return spark.read.option("header", True).schema(f"name string, value {kind}").csv(folder)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of several lines."""
    return spark.read.option("multiLine", True).json(path)


def pretty_json(column) -> F.Column:
    """A struct, map or array as indented JSON text."""
    return F.to_json(column, {"pretty": "true"})


def lookup_checkpoint(registry: DataFrame, config: dict) -> str:
    """The checkpoint whose configuration equals config in every column of the registry but `checkpoint`, null-safely; NotImplementedError where there is none."""
    match = registry
    for c in (c for c in registry.columns if c != "checkpoint"):
        match = match.filter(F.col(c).eqNullSafe(F.lit(config.get(c))))
    got = match.select("checkpoint").orderBy("checkpoint").limit(1).collect()
    if not got:
        raise NotImplementedError(f"no checkpoint for {config}")
    return got[0].checkpoint
