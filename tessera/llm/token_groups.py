"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct five-word shingles, as 64-bit hashes. Equal sets are one class, so copies cost nothing after the scan. With
o = ceil(0.8 n) the least overlap of a set of n shingles with any partner, two sets that link share, in any fixed order of shingles, at least l of the
first n - o + l of each (l up to the partner's own): that prefix is all that is compared until pairs are verified.

1. Scan: the hash-ordered prefix of each set with l = n / 10. Shingles that two classes hold are found by partial aggregation,
   and only classes with l of them in their prefix go on. Their whole sets are read; their shingles are counted and ordered rarest first.
2. Groups: each shingle of a rare-first prefix names as hub the class most of whose shingles are shared. Classes that are
   verified to link to a hub form a group with it, by connected components. A cluster of k near copies costs about k checks, not k * k.
   Classes without a link are similar to others all the same: they are pooled by the hub that they share most with.
3. Matrix: groups and pools of many classes are cut into blocks. Sets of n and m <= n shingles that link share 4/9 (n + m), at least 8/9 m, so of the
   smaller one a shorter prefix is enough: the matrix counts for each (shingle, block) the members with it in there. A class is a query to the blocks, those of its own group aside, that
   hold l shingles of its prefix (l = a tenth of the least overlap, as above, of the smaller one; shingles that only itself holds in its own block do not count) and a size up to its own. The overlap of the query with
   a block's union bounds that with every member: blocks under the least overlap with their smallest member are not opened. In an opened block a query's overlap with all members is counted in one task
   from their shingles, and a link joins the two groups; no pair leaves the task but links that join groups.

Only links inside a group are left unchecked, as they change no component, so the components are those of all links. The rarest-first order keeps passages that many documents share
out of the prefixes; every count and minimum is pre-aggregated, hot join keys are those adaptive execution splits, and no array grows with a group.

Cases: null and empty texts and texts without a word have no shingle and are their own component; texts under five words are one
shingle; repeated rows are one class; the component id is the smallest id of all rows in it, null ids aside (null only if all are); rows that share an id but not a text
are classes of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cuts, read
from .components import connected_components
from .rolling import SPACE, Rolling, chunks, mix, runs, texts_of

SHINGLE, PERCENT = 5, 80
SPREAD = 10
#: A block has about so many classes, and not many more shingles than TOKENS.
BLOCK, TOKENS = 256, 1 << 22

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n):
    """ceil(n * PERCENT / 100), for numbers and arrays."""
    return (n * PERCENT + 99) // 100


def _least(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * PERCENT + 99) / 100)


def _needed(n: Column, m: Column) -> Column:
    """The least overlap of sets of n and m shingles that link."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT))


class Shingles:
    """The sorted distinct shingles of each of a run of texts."""

    def __init__(self) -> None:
        self.rolling = Rolling(_FOLD)

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values, and how many each text has."""
        opens, closes = runs(~SPACE[b], starts, ends)
        words = self.rolling.over(b)(opens, closes)
        doc = np.searchsorted(ends, opens, side="right")
        count = np.bincount(doc, minlength=len(starts))
        m = max(len(words) - SHINGLE + 1, 0)
        value = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            value = value * _STEP + words[k : k + m]
        full = doc[:m] == doc[SHINGLE - 1 :] if m else np.zeros(0, bool)
        value, owner = mix(value[full] + np.uint64(SHINGLE)), doc[:m][full]
        # A text of fewer words is one shingle.
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(SHINGLE - 1):
                has = count[short] > k
                whole[has] = whole[has] * _STEP + words[first[short[has]] + k]
            value = np.concatenate([value, mix(whole + count[short].astype(np.uint64))])
            owner = np.concatenate([owner, short])
        value = value.view(np.int64)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        return value[new], np.bincount(owner[new], minlength=len(starts))


SETS = "n long, sig binary, mark long, tokens array<long>"


def shingle_sets(docs: DataFrame, text: str, id: str, whole: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, extra and SETS for each row: the size, a 128-bit signature, half of it as a number, and the set or its prefix in hash order."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id, *extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            offsets, data = texts_of(batch.column(0))
            for a, z in chunks(offsets, 2 << 20):
                own = offsets[a : z + 1]
                value, n = shingles(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0])
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value.view(np.uint64) + np.uint64(k)))]) for k in (1, 2)]
                sig = np.stack([mix(s[at[1:]] - s[at[:-1]] + n.astype(np.uint64)) for s in sums], 1)
                if not whole:
                    keep = np.where(n > 0, n - least_overlap(n) + np.maximum(1, n // SPREAD), 0)
                    value = value[np.arange(len(value)) - np.repeat(at[:-1], n) < np.repeat(keep, n)]
                    at = np.concatenate([[0], np.cumsum(keep)])
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(sig.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value))
                passed = [batch.column(1 + k).slice(a, z - a) for k in range(1 + len(extra))]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(n.astype(np.int64)), packed, pa.array(np.ascontiguousarray(sig[:, 0]).view(np.int64)), lists], names=[id, *extra, "n", "sig", "mark", "tokens"])

    return docs.select(F.col(text).cast("string").alias("_text"), F.col(id), *extra).mapInArrow(run, f"{kinds}, {SETS}")


def _few(n: str | Column) -> Column:
    """How many shingles a class must share inside the prefixes: l of the text above."""
    return F.greatest(F.floor(_least(n) / SPREAD), F.lit(1))


def _fits(n: str, m: str) -> Column:
    """Can sets of these sizes link."""
    return (_least(F.greatest(n, m))) <= F.least(n, m)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link; sets(cid, n, common): shingles that other classes hold too."""
    one = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("common").alias(f"c{x}"))
    both = F.size(F.array_intersect("ca", "cb"))
    return pairs.join(one("a"), "a").join(one("b"), "b").filter(100 * both >= PERCENT * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _near(rows: DataFrame, id: str) -> DataFrame:
    """Signatures of classes that hold enough of their prefix in common with other classes, with the id k and the text's hash of one row of each."""
    shared = rows.select("mark", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo < hi").select("token")
    counts = rows.select(F.col("_tag").alias("t"), F.explode("tokens").alias("token")).join(shared, "token").groupBy("t").agg(F.count("*").alias("hits"))
    enough = rows.join(counts, F.col("_tag") == F.col("t")).filter(F.col("hits") >= _few("n"))
    return enough.groupBy("sig").agg(F.min(F.struct(id, "_key")).alias("at")).select("sig", F.col("at").getField(id).alias("k"), F.col("at._key").alias("h"))


def _sets(docs: DataFrame, near: DataFrame, text: str, id: str) -> DataFrame:
    """The whole sets of those classes: cid, n, tokens. Rows are met by id and text, so rows that share an id do not multiply."""
    same = F.col(id).eqNullSafe(F.col("k")) & (F.col("_key") == F.col("h"))
    whole = docs.join(near.withColumnRenamed("sig", "want"), same).select(id, text, "want")
    return shingle_sets(whole, text, id, whole=True, extra=("want",)).filter("sig = want").dropDuplicates(["sig"]).select(F.col("sig").alias("cid"), "n", "tokens")


def _ranked(sets: DataFrame) -> DataFrame:
    """Classes that can have a partner, with the shingles that others hold too, rarest first, the prefix of these, and how much of it partners of their size or more need."""
    each = sets.select("cid", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    common = each.join(often, "token").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    return common.filter(F.size("ranked") >= _least("n")).select(
        "cid", "n", F.col("ranked.token").alias("common"), (F.size("ranked") / F.col("n")).alias("central"),
        (F.size("ranked") - _least("n") + 1).alias("one"),
        F.slice(F.col("ranked.token"), 1, (F.size("ranked") - _least("n") + _few("n")).cast("int")).alias("prefix"),
        # With too few shared shingles for any partner of its size or more, a class is no member that a query can find.
        F.when(F.size("ranked") >= _needed(F.col("n"), F.col("n")), F.size("ranked") - _needed(F.col("n"), F.col("n")) + _few("n")).otherwise(0).alias("short"),
        # As a query it can link to sets of at most this size.
        F.least(F.floor(F.size("ranked") * (100 + PERCENT) / PERCENT - F.col("n")), F.col("n")).alias("reach"),
    )


def _place(pool: str, block: str) -> Column:
    """A block's name."""
    return F.concat_ws(":", F.col(f"{pool}.linked").cast("string"), F.hex(f"{pool}.id"), F.col(block).cast("string"))


def _links(members: pa.Table, askers: pa.Table) -> pa.Table:
    """Links (a, b) between askers and members of a block (cid, n, common, group) that join their groups: of all links as many as a tree of the groups has.

    Every asker's overlap with all members is counted at once from the members' shingles in order.
    """
    a, b = [], []
    if len(members) and len(askers):
        lists = members.column("common").combine_chunks()
        value, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        order = np.argsort(value, kind="stable")
        token, owner = value[order], np.repeat(np.arange(len(members)), size)[order]
        m, cid, group = members.column("n").to_numpy(), members.column("cid").to_pylist(), members.column("group").to_pylist()
        up: dict = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for k in range(len(askers)):
            own, n, home = (askers.column(c)[k] for c in ("common", "n", "group"))
            own, n, home = own.values.to_numpy(), n.as_py(), home.as_py()
            low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(m))
            for j in np.flatnonzero(100 * both >= PERCENT * (n + m - both)).tolist():
                x, y = top(home), top(group[j])
                if x != y:
                    up[x] = y
                    a.append(askers.column("cid")[k].as_py())
                    b.append(cid[j])
    kind = members.schema.field("cid").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})


def ngram_components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_shingles and component_id for each row of docs."""
    cuts = Cuts(docs.sparkSession)
    docs = docs.select(F.col(id), F.col(text).cast("string").alias(text), F.xxhash64(F.col(text).cast("string")).alias("_key"))
    rows = cuts.table(shingle_sets(docs, text, id, whole=False, extra=("_key",)).withColumn("_tag", F.monotonically_increasing_id()), "shingles")

    # 1. Every step ends in a table, and its shuffle files go with it.
    near = cuts.table(_near(rows, id), "near")
    sets = cuts.table(_sets(docs, near, text, id), "sets")
    ranked = cuts.table(_ranked(sets), "ranked")
    cuts.drop(near, sets)

    # 2. Groups around hubs.
    prefix = ranked.select("cid", "n", "central", "one", "short", "reach", F.posexplode("prefix").alias("pos", "token"))
    rare = prefix.filter("pos < one")
    hubs = rare.groupBy("token").agg(F.max(F.struct("central", "cid", "n")).alias("hub"), F.count("*").alias("held")).filter("held > 1").select("token", F.col("hub.cid").alias("b"), F.col("hub.n").alias("m"))
    met = cuts.table(rare.join(hubs, "token").filter(F.col("cid") != F.col("b")).groupBy(F.col("cid").alias("a"), "n", "b", "m").agg(F.count("*").alias("shared")), "met")
    links = cuts.table(_linked(met.filter(_fits("n", "m")).select("a", "b"), ranked), "links")
    group = connected_components(links, cuts)
    home = met.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("most")).select("a", F.col("most.b").alias("hub"))
    linked = F.col("component").isNotNull()
    pool = F.struct(linked.alias("linked"), F.coalesce("component", "hub", "cid").alias("id")).alias("pool")
    member = ranked.join(group, F.col("cid") == F.col("node"), "left").join(home, F.col("cid") == F.col("a"), "left").select("cid", "n", F.coalesce("component", "cid").alias("group"), pool)
    sizes = member.groupBy("pool").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    block = F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("tokens") / TOKENS))).alias("block")
    member = cuts.table(member.join(sizes, "pool").select("cid", "n", "group", "pool", block), "members")

    # 3. The matrix, its bounds, and the groups they leave open.
    held = cuts.table(prefix.select("cid", "n", "reach", "token", (F.col("pos") < F.col("short")).alias("first")).join(member.drop("n"), "cid"), "held")
    matrix = held.filter("first").groupBy(F.col("pool").alias("g"), F.col("block").alias("k"), "token").agg(F.count("*").alias("holders"))
    own = (F.col("pool") == F.col("g")) & (F.col("block") == F.col("k"))
    others = F.col("holders") > F.when(own & F.col("first"), 1).otherwise(0)
    # A query and a block that share too few shingles of the prefixes hold no link: nothing more is read of them.
    shared = held.join(matrix, "token").filter(~(F.col("pool.linked") & (F.col("pool") == F.col("g"))) & others).groupBy("cid", "n", "reach", "g", "k", own.alias("own")).agg(F.count("*").alias("hits"))
    blocks = member.groupBy(F.col("pool").alias("g"), F.col("block").alias("k")).agg(F.min("n").alias("small"), F.max("n").alias("large"))
    fits = (_least("n") <= F.col("large")) & (F.col("small") <= F.col("reach"))
    enough = F.col("hits") >= F.least(_few("n"), _few(F.greatest(F.col("small"), _least("n"))))
    asked = cuts.table(shared.join(blocks, ["g", "k"]).filter(fits & enough).select("cid", "n", "g", "k", "own", "small"), "asked")
    wanted = asked.select(F.col("g").alias("pool"), F.col("k").alias("block")).distinct()
    union = member.join(wanted, ["pool", "block"]).join(ranked.select("cid", "common"), "cid").select(F.col("pool").alias("g"), F.col("block").alias("k"), F.explode("common").alias("token")).groupBy("g", "k", "token").agg(F.count("*").alias("holders"))
    # A block's union is one row, with the shingles of two members or more, which are what is left of it for a member of its own; a query meets it as a set.
    unions = union.groupBy("g", "k").agg(F.collect_list("token").alias("held"), F.collect_list(F.when(F.col("holders") > 1, F.col("token"))).alias("held_twice"))
    met = asked.join(ranked.select("cid", "common"), "cid").join(unions, ["g", "k"])
    overlap = met.select("cid", "n", "small", "g", "k", F.size("common").alias("tokens"), F.size(F.array_intersect("common", F.when(F.col("own"), F.col("held_twice")).otherwise(F.col("held")))).alias("overlap"))
    enough = _needed(F.col("n"), F.greatest(F.col("small"), _least("n")))
    opened = cuts.table(overlap.filter(F.col("overlap") >= enough).select("cid", _place("g", "k").alias("at"), "tokens"), "opened")

    # Members and askers of an opened block meet in a task, by shares of bounded size; what leaves it is links that join groups.
    load = opened.groupBy("at").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("tokens") / TOKENS)).alias("parts"))
    # The aliases keep both sides of the cogroup apart.
    sets = lambda: member.select(F.col("cid").alias("cid"), F.col("group").alias("group")).join(ranked.select(F.col("cid").alias("cid"), F.col("n").alias("n"), F.col("common").alias("common")), "cid")
    asking = opened.join(load, "at").select("cid", "at", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part")).join(sets(), "cid")
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    members = member.select(F.col("cid").alias("cid"), _place("pool", "block").alias("at")).join(load.select(F.col("at").alias("at"), F.col("parts").alias("parts")), "at").select("cid", "at", share).join(sets(), "cid")
    kind = dict(ranked.dtypes)["cid"]
    across = cuts.table(members.groupBy("at", "part").cogroup(asking.groupBy("at", "part")).applyInArrow(_links, f"a {kind}, b {kind}"), "across")
    of = member.select(F.col("cid"), "group")
    joined = across.join(of.select(F.col("cid").alias("a"), F.col("group").alias("ga")), "a").join(of.select(F.col("cid").alias("b"), F.col("group").alias("gb")), "b")
    top = connected_components(joined.select(F.col("ga").alias("a"), F.col("gb").alias("b")), cuts)
    final = member.join(top, F.col("group") == F.col("node"), "left").select(F.col("cid").alias("sig"), F.coalesce("component", "group").alias("group"))

    # Every class with the smallest id of its component, and every row with that of its class.
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min(id).alias("least"))
    linked = final.join(classes, "sig")
    least = linked.groupBy("group").agg(F.min("least").alias("lowest"))
    named = cuts.table(classes.join(linked.join(least, "group").select("sig", "lowest"), "sig", "left").select(F.col("sig").alias("s"), F.coalesce("lowest", "least").alias("component_id")), "named")
    cuts.drop_others(rows, named)
    # Null ids aside, the smallest id of a component is there for all of it.
    out = rows.select(id, "n", "sig").join(named, (F.col("sig") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select(F.col(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id)).alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM l
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT l.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(l.doc_id, coalesce(min(r.b), l.doc_id)) AS component_id
FROM l LEFT JOIN n ON n.doc_id = l.doc_id LEFT JOIN r ON r.a = l.doc_id GROUP BY l.doc_id
"""
