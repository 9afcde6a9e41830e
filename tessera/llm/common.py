"""Shared helpers of the training-data operators: the shared scratch folder and table cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word, line and shingle rule in this package.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a scratch path through Hadoop's file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_cleaned: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there goes when the driver ends."""
    root = shared_dir(spark)
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _forget(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the JVM may be gone already; the folder is only scratch space
        pass


#: Spark's own setting to remove a query's shuffle files when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Writes in this context remove their shuffle files at their end; the session's own setting comes back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Cuts:
    """Tables written to the shared folder to cut lineage; `drop` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        with shuffles_end(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        # The frame is held with its path, so that its number is not given to another one.
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if own := self.paths.pop(id(t), None):
                delete(self.spark, own[1])

    def drop_others(self, *kept: DataFrame) -> None:
        """Removes every table but these."""
        self.drop(*[t for t, _ in list(self.paths.values()) if not any(t is k for k in kept)])


def whole(text: str | Column) -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: An array that grows by one element a step is copied at every step, so folds that build one go over parts of this many elements.
PART = 128


def in_parts(array: Column) -> Column:
    """An array cut into arrays of at most PART elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / PART).cast("int")), lambda k: F.slice(array, k * PART + 1, F.lit(PART)))


def running(sums: Column) -> Column:
    """For each element the sum of those before it."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
