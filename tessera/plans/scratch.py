"""Tables in the cluster's shared folder, to cut the lineage of iterative plans, and joins of tables that only shuffles can hold."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: set[str] = set()
_held: dict[int, tuple[DataFrame, str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); what is left there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    root = f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # the JVM may be gone already; the folder is only scratch space
        pass


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: a lost executor costs a re-read, not the whole loop."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _held[id(out)] = (out, path)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that shuffles. Spark takes a table's size from its files, not from the rows that arrays and packed columns become, and would send such a side whole through the driver."""
    return df.hint("merge")


def drop(*tables: DataFrame | None) -> None:
    """Removes tables made by `cut` that nothing reads any more; other frames are left alone."""
    for t in tables:
        if own := _held.pop(id(t), None):
            _delete(t.sparkSession, own[1])
