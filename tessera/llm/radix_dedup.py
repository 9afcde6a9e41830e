"""Exact deduplication by distributed MSD radix partitioning.

Texts are compared after each run of ASCII white space became one space. The sort key of a text is
its length in bytes followed by its bytes, so a group's texts end together. The first digit is
the length and the first bytes. Every later round splits the groups that are still open by their next digit, whose
width grows by a fixed factor: the first `MOST_DIGIT` bytes take five rounds, each of which carries only what is left of them. A group
leaves when it holds one row or its texts have ended; then its texts are equal byte by byte, and no digest
decides anything. Groups that are open behind these bytes are decided at once, however long their texts: what is left is cut to pieces of `MOST_DIGIT` bytes, equal pieces at one position of a group are
named by the smallest tag that holds them, and texts with the same names at all positions are equal. Groups are counted with map-side partial aggregation and rows meet their group by an
equi-join whose hot keys adaptive execution splits, so a group with a third of all rows is never one task's work.

Cases: null text counts as empty; empty texts equal one another. Of equal texts the row with the smallest
id stays (null ids come last); among repeated rows with that same id exactly one stays. Repeated rows each
get a row of the result. An empty table gives an empty result. Other columns are ignored, or carried in `row`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Cuts, read, whole

FIRST_DIGIT = 64
GROWTH = 8
#: No digit and no piece is wider: what a task sorts by stays small, however long a text is.
MOST_DIGIT = 1 << 15


def normalised(text) -> F.Column:
    return F.regexp_replace(whole(text), f"[{ASCII_SPACE}]+", " ")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per row of docs: row (struct of id, or of all columns with carry), id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    cuts = Cuts(spark)
    base = docs.select(
        F.struct(*([F.col(c) for c in docs.columns] if carry else [F.col(id)])).alias("row"),
        F.col(id).alias("id"),
        normalised(text).alias("norm"),
    ).select("*", F.octet_length("norm").alias("size"), F.substring(F.col("norm").cast("binary"), 1, FIRST_DIGIT).alias("digit"))
    shared = base.groupBy("size", "digit").agg(F.count("*").alias("n")).filter("n > 1")
    # Every row once, with the text only where its first digit is shared; `tag` tells repeated rows apart.
    rows = cuts.table(
        base.join(shared, ["size", "digit"], "left").select(
            "row", "id", "size", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.when(F.col("n") > 1, F.col("digit")).alias("digit"),
            F.when(F.col("n") > 1, F.col("norm").cast("binary")).alias("bytes"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "radix-rows",
    )
    done = [rows.filter("digit IS NULL").select("row", "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))]
    # The first round's group is (size, first digit); later a group goes by the tag of its first row. `bytes` is what is left of the first MOST_DIGIT.
    left = F.substring("bytes", FIRST_DIGIT + 1, MOST_DIGIT - FIRST_DIGIT)
    active = rows.filter("digit IS NOT NULL").select("row", "id", "sha", "size", "tag", left.alias("bytes"), F.struct("size", "digit").alias("group"))
    told = lambda split: split.select("row", "id", "sha", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("first.tag")).alias("kept"))
    at, width = FIRST_DIGIT, FIRST_DIGIT * (GROWTH - 1)
    while at < MOST_DIGIT and not active.isEmpty():
        keyed = active.withColumn("digit", F.substring("bytes", 1, width))
        split = cuts.table(_split(keyed, "digit").withColumn("ended", (F.col("n") == 1) | (F.col("size") <= at + width)), "radix-round")
        done.append(told(split.filter("ended")))
        active = split.filter("NOT ended").select("row", "id", "sha", "size", "tag", F.substring("bytes", width + 1, MOST_DIGIT).alias("bytes"), F.col("first.tag").alias("group"))
        at += width
        width = min(at * (GROWTH - 1), MOST_DIGIT - at)
    if not active.isEmpty():
        named = _piece_names(rows, active, cuts)
        done.append(told(cuts.table(_split(active.join(named, "tag"), "names"), "radix-long")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("row", "id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def _split(keyed: DataFrame, by: str) -> DataFrame:
    """Rows with the size n and the first row of their part: those of their group with the same value of `by`."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first")
    groups = keyed.groupBy("group", by).agg(F.count("*").alias("n"), first)
    # The renamed keys keep both sides of the self-join apart.
    groups = groups.select(F.col("group").alias("g"), F.col(by).alias("d"), "n", "first")
    return keyed.join(groups, (F.col("group") == F.col("g")) & (F.col(by) == F.col("d"))).drop("g", "d", by)


def _piece_names(rows: DataFrame, active: DataFrame, cuts: Cuts) -> DataFrame:
    """tag, names: for each piece of a text behind its first MOST_DIGIT bytes, the smallest tag of its group that has the same piece there."""
    last = F.floor((F.col("size") - 1) / MOST_DIGIT).cast("int")
    cut = F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(F.col("bytes"), k * MOST_DIGIT + 1, F.lit(MOST_DIGIT)))
    pieces = cuts.table(rows.select("tag", "size", "bytes").join(active.select("tag", "group"), "tag").select("group", "tag", F.posexplode(cut).alias("pos", "piece")), "pieces")
    same = pieces.groupBy("group", "pos", "piece").agg(F.min("tag").alias("name")).select(F.col("group").alias("g"), F.col("pos").alias("p"), F.col("piece").alias("x"), "name")
    met = pieces.join(same, (F.col("group") == F.col("g")) & (F.col("pos") == F.col("p")) & (F.col("piece") == F.col("x")))
    return met.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("in_order")).select("tag", F.col("in_order.name").alias("names"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
