"""Interaction audit of filters by lattice-edge aggregation.

A document is the set of the filters that it fails. Whatever the order of the filters, a step applies one of them after a set of others: an edge of the lattice of
subsets, of which five filters have 80 (set applied before, next filter). Documents are first counted by part, failed filters and labels; these counts, at most 32 x 4 a part, are what
contributes to the 80 edges. The 600 steps of all 120 orders are paths in the lattice: each joins its edge.

Whether a text repeats one of a smaller id is decided without meeting its copies: rows are counted by (digest, part, filters, labels) with map-side partial sums, together with the
smallest id and how many rows have it, and only these counts meet by digest; a text with a third of all rows is a few counts.

Cases: null text and null part are the empty string; a row without an id is no smaller than any and repeats none; rows that share id and text repeat neither; repeated rows count each; of several label rows of an id any 1 counts;
an empty table has no part, so it gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, read, whole

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The failure of filter E, found table-wide.
REPEAT = 1 << FILTERS.index("E")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{ASCII_SPACE}]+"), lambda w: w != "")


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text of these words fails."""
    n = F.size(words)
    short = n < 100
    dull = 100 * F.size(F.array_distinct(words)) < 80 * n
    loud = 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text)
    odd = text.rlike(r"[#$%&*|]")
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate((short, dull, loud, odd))]
    return sum(bits[1:], bits[0])


def failure_counts(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, fails (bit set of failed filters), good, toxic, n."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marked = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(one("quality"), one("toxic"))
    rows = (
        docs.select(F.col(id).alias("_id"), whole(F.col(part).cast("string")).alias("part"), whole(F.col(text).cast("string")).alias("_text"))
        .select("_id", "part", "_text", words_of(F.col("_text")).alias("_words"))
        .select("_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), text_failures(F.col("_text"), F.col("_words")).alias("fails"))
    )
    held = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    # Rows of one id are one row from here on; the join has dealt them by id already.
    each = rows.join(marked, "_id", "left").groupBy("_id", "digest", "part", "fails", held("quality"), held("toxic")).agg(F.count("*").alias("n"))
    cells = each.groupBy("digest", "part", "fails", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min("_id").alias("first"), F.min_by("n", F.col("_id")).alias("at_first"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    least = cells.groupBy("digest").agg(F.min("first").alias("least"))
    # Rows that keep their text: those of the smallest id, and those without one.
    own = F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0) + F.col("no_id")
    split = cells.join(least, "digest").select(
        "part", "quality", "toxic",
        F.explode(F.array(F.struct(F.col("fails").alias("fails"), own.alias("n")), F.struct((F.col("fails") + REPEAT).alias("fails"), (F.col("n") - own).alias("n")))).alias("x"),
    )
    return split.groupBy("part", "x.fails", F.col("quality").alias("good"), "toxic").agg(F.sum("x.n").alias("n"))


def edges(counts: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """part, before (bit set), bit, and what the filter of that bit does after those in `before`; with `shapley` by part and filter."""
    every = [(s, 1 << k, factorial(s.bit_count()) * factorial(n_filters - 1 - s.bit_count())) for k in range(n_filters) for s in range(1 << n_filters) if not s >> k & 1]
    table = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(b).alias("bit"), F.lit(w).alias("orders")) for s, b, w in every])
    met = counts.select("*", F.explode(table).alias("e")).select("*", "e.*")
    fails, past = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("before")) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    out = met.groupBy("part", "before", "bit", "orders").agg(
        total(past & ~fails)("kept"), total(past & fails)("removed"), total(~past & fails)("redundant"), total(F.col("fails") == F.col("bit"))("unique_fails"),
        total(past & fails & F.col("good"))("good_lost"), total(past & fails & F.col("toxic"))("toxic_lost"),
    )
    shares = out.groupBy(F.col("part").alias("p"), F.col("bit").alias("b")).agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return out.join(shares, (F.col("part") == F.col("p")) & (F.col("bit") == F.col("b"))).drop("p", "b", "orders")


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, before, bit: all orders of the filters as paths of the lattice."""
    told = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, f in enumerate(order):
            told.append(("".join(filters[x] for x in order), k + 1, before, 1 << f))
            before |= 1 << f
    return spark.createDataFrame(told, "filter_order string, step int, before int, bit int")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part, order and step."""
    told = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # The steps are as many as orders times filters, whatever the corpus.
    joined = edges(failure_counts(docs, labels, text, id, part)).join(F.broadcast(steps(docs.sparkSession)), ["before", "bit"])
    return joined.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in told])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(copy, FALSE)::INT AS f
      FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT o, k::INT AS step, (1 << (ascii(o[k]) - 65))::INT AS bit, coalesce(list_sum(list_transform(range(1, k), lambda j: (1 << (ascii(o[j]) - 65))::INT)), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, o AS filter_order, step, bit,
        sum(n) FILTER ((f & (before | bit)) = 0) AS kept, sum(n) FILTER ((f & before) = 0 AND (f & bit) <> 0) AS removed,
        sum(n) FILTER ((f & before) <> 0 AND (f & bit) <> 0) AS redundant, sum(n) FILTER (f = bit) AS unique_fails,
        sum(n) FILTER ((f & before) = 0 AND (f & bit) <> 0 AND good) AS good_lost, sum(n) FILTER ((f & before) = 0 AND (f & bit) <> 0 AND toxic) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
