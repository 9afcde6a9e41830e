"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every historical version (path, version, content) is addressed by the SHA-256 of its content. The ledger is a
table of the blobs scanned so far with the rule versions that were applied and what they found. A run scans one copy
of each blob for exactly the (blob, rule version) pairs that the ledger lacks, appends them, and joins the findings
back to every path and version by address. So copies, renames and unchanged history cost a digest, not a scan, and a new rule
version rescans for that rule alone.

A blob's copy is found by its smallest (path, version), an aggregate with map-side partial sums, and
fetched by an equi-join on blob, path and version, which spreads copies of a hot blob over all partitions. Positions come from
lengths: `split` gives what lies between matches and `regexp_extract_all` the matches; they are summed in parts of bounded length, so time is linear in the hits.

A run that is repeated after a half-finished one, or that meets another run on the same ledger, can append a blob twice; findings are read as a set, so that changes nothing but the ledger's size.

Cases: null content is empty; null paths and versions are ordinary values; repeated rows are scanned once and each reported; very long contents are scanned whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, read, running, scratch, whole


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose given group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans with one start are listed. The run patterns of access and hex match maximal runs of at least the wanted
#: length, which are the matches of the plain `+` pattern less the short ones.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", base=True),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+", base=True),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

SPAN = "struct<rule:string,start:bigint,end:bigint>"
LEDGER = f"blob binary, rules array<string>, findings array<{SPAN}>"


def _found(rule: Rule, text: Column, hits: Column) -> Column:
    """array<SPAN> of a rule, given all its matches."""
    between = F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    none = F.array().cast(f"array<{SPAN}>")
    sized = F.transform(F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("p"), hits.alias("h"), sized.alias("s")), lambda z: F.struct(F.length(z["p"]).alias("lead"), F.length(z["h"]).alias("length"), F.length(z["s"]).alias("group")))
    parts = in_parts(sized)
    bases = running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda n, x: n + x["lead"] + x["length"])))

    def spans(part: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["lead"]
            end = start + x["length"]
            span = F.struct(F.lit(rule.key).alias("rule"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["group"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(base.alias("at"), none.alias("spans")), step)["spans"]

    return F.when(F.size(hits) > 0, F.flatten(F.zip_with(parts, bases, spans))).otherwise(none)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs(blob, content, pending array<string>) -> ledger rows."""
    hits = [
        F.when(F.array_contains("pending", r.key), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"hits{k}")
        for k, r in enumerate(rules)
    ]
    found = [_found(r, F.col("content"), F.col(f"hits{k}")) for k, r in enumerate(rules)]
    return blobs.select("blob", "pending", "content", *hits).select("blob", F.col("pending").alias("rules"), F.concat(*found).alias("findings"))


def scan_history(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """versions(path, version, content) with the ledger table at a path of the shared store -> path, version, blob, findings.

    The ledger is created where there is none; findings are those of the given rules, ordered by start, then rule.
    """
    spark = versions.sparkSession
    keys = [r.key for r in rules]
    held = versions.select("path", "version", F.unhex(F.sha2(whole("content").cast("binary"), 256)).alias("blob"), whole("content").alias("content"))
    wanted = held.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    all_rules = F.array(*map(F.lit, keys))
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        wanted = wanted.join(seen, "blob", "left").select("blob", "at", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending"))
    else:
        wanted = wanted.select("blob", "at", all_rules.alias("pending"))
    wanted = wanted.filter(F.size("pending") > 0).select(F.col("blob").alias("b"), F.col("at.path").alias("p"), F.col("at.version").alias("v"), "pending")
    same = (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v"))
    unseen = held.join(wanted, same).select("blob", "content", "pending")
    # Repeated rows can bring one blob twice; their findings are the same.
    scan(unseen, rules).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(keys) for x in (r, k)])
    found = (
        spark.read.schema(LEDGER).parquet(ledger)
        .select("blob", F.explode("findings").alias("f"))
        .filter(F.col("f.rule").isin(keys))
        .groupBy("blob")
        # A set: a blob that two runs appended at once has its findings once.
        .agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), rank[F.col("f.rule")].alias("rank"), F.col("f.rule").alias("rule"), F.col("f.end").alias("end")))).alias("findings"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,rule:string,end:bigint>>")
    return held.select("path", "version", "blob").join(found, "blob", "left").select("path", "version", "blob", F.coalesce("findings", none).alias("findings"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one version each, over a ledger that starts empty."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    out = scan_history(docs, scratch(spark, "secret-ledger"))
    kind = lambda x: F.substring_index(x["rule"], "@", 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["rule"].isin([r.key for r in RULES if r.base]))
    count = lambda k: F.size(F.filter("findings", lambda x: kind(x) == k)).cast("long").alias(f"n_{k}")
    return out.select(
        F.col("path").alias("doc_id"), *(count(r.kind) for r in RULES if r.base),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    def one(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(list_zip(list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)), list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)),
          list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x))[:length(regexp_extract_all(t, '{p}', 0))], range(1, 1 + length(regexp_extract_all(t, '{p}', 0))))) AS z,
          list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS ms, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS ps, {least} AS least FROM d"""

    # No look-behind or possessive repeats in this dialect: a greedy run of the least length is the same maximal run.
    plain = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
    parts = " UNION ALL ".join(one(k, r.kind, plain.get(r.kind, r.pattern), r.group, r.least) for k, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
s AS (SELECT doc_id, rank, kind, (list_sum(ps[:z[4]]) + coalesce(list_sum(ms[:z[4] - 1]), 0))::BIGINT AS b, z[1] AS n FROM m WHERE z[2] >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) FILTER (kind IN ({base})) AS base,
  string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP2_SQL = _sql()
