"""Collocations by suffix counting: which phrases of 2 to `MAX_N` words stand together more often than their parts suggest.

1. Sketch. One pass over the texts counts hashed n-grams of every length in arrays of a fixed number of slots (8-bit, saturated). A slot under the wanted count proves all
   its n-grams too rare; the arrays of all tasks are summed in levels of a bounded fan-in and broadcast, at a size that does not depend on the corpus.
2. Suffixes. From every word on, up to `MAX_N` words of its piece, cut before the first n-gram that is proven too rare; equal ones of a run of texts become one row
   with a count. These are shuffled by language, first word and one of `PARTS` shares, so that a word with a third of all positions is many tasks, and sorted in reverse
   lexicographic order. One pass with a stack of `MAX_N` counters counts all prefixes of all suffixes: an extension always comes before its prefix.
3. Parts. The shares' counts of a phrase are summed, and phrases join the counts of their two sides for every cut. Sides are at least as frequent as the phrase, so they are in the same table.

Rare phrases are dropped by their exact counts in the end; the sketch only saves rows that cannot count. Where a corpus fills the sketch it saves nothing, and every suffix is shuffled once.

Cases: null text is empty and has no word; null language is `und`; other languages stand for themselves; repeated rows count each; white space or marks alone have no word; a piece of any length is read whole; counts and products are exact (decimals);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cuts, read
from .rolling import Rolling, chunks, mix, runs, texts_of

MAX_N, LEAST, TOP, PERCENT, SCALE = 4, 30, 2000, 80, 2_000_000
NO_LANG = "und"
#: Slots of each of the two rows of the sketch for each n-gram length, and bytes of the blocks in which it is summed.
SLOTS = 1 << 22
BLOCK = 1 << 17
#: Partial sketches that one task sums.
FAN_IN = 64
#: Shares of a first word's suffixes.
PARTS = 8
#: Bytes of texts that are counted together before the shuffle.
RUN = 4 << 20
#: Bytes that are hashed at once.
SPAN = 1 << 20

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LOWER = _FOLD.astype(np.uint8)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INNER = ~_BREAK
_INNER[[32, 9]] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a run of texts: byte spans, language codes, hashes, and how many words follow in the piece."""

    def __init__(self) -> None:
        self.rolling = Rolling(_FOLD)

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray):
        """seeds: a number for each text's language."""
        opens, closes = runs(_INNER[b], starts, ends)
        doc = np.searchsorted(ends, opens, side="right")
        piece = np.cumsum(_BREAK[b])[opens] + doc
        n = len(opens)
        hashes = np.empty(n, np.uint64)
        # Hashing takes some 40 bytes of memory a byte, so it goes by stretches of the run.
        edges = np.unique(np.append(np.searchsorted(opens, np.arange(0, len(b), SPAN)), n))
        for a, z in zip(edges[:-1], edges[1:]):
            low = opens[a]
            hashes[a:z] = self.rolling.over(b[low : closes[z - 1]])(opens[a:z] - low, closes[a:z] - low)
        hashes += seeds[doc]
        # Whether the next word is in the same piece, and so on for more words.
        joined = [np.ones(n, bool)]
        for k in range(1, MAX_N):
            same = np.zeros(n, bool)
            same[: max(n - k, 0)] = (piece[k:] == piece[:-k]) & (doc[k:] == doc[:-k]) if n > k else False
            joined.append(same)
        return opens, closes, doc, hashes, joined


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on (those at the end wrap around; they are not joined)."""
    value = hashes
    for k in range(1, n):
        value = value * _STEP + np.roll(hashes, -k)
    return mix(value + np.uint64(n))


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slot of each n-gram in either row of the sketch."""
    return [(grams & np.uint64(slots - 1)).astype(np.int64), (grams >> np.uint64(33) & np.uint64(slots - 1)).astype(np.int64)]


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Runs of texts as bytes, starts and ends, with the language of each text."""
    for batch in batches:
        offsets, data = texts_of(batch.column(0))
        langs = batch.column(1).fill_null(NO_LANG).to_pylist()
        for a, z in chunks(offsets, most):
            own = offsets[a : z + 1]
            yield data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0], langs[a:z]


def _seeds(langs: list[str]) -> np.ndarray:
    """A number for each text's language, so that its n-grams have slots of their own."""
    known = {x: (2 * zlib.crc32(x.encode()) + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def sketch(texts: DataFrame, slots: int = SLOTS, least: int = LEAST) -> list[np.ndarray]:
    """For n-grams of 1 to MAX_N words, which slots of two rows hold at least `least`; texts(_text, _lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, any_ = np.zeros((2 * MAX_N, slots), np.uint8), Words(), False
        for b, starts, ends, langs in _batches(batches, RUN):
            *_, hashes, joined = words(b, starts, ends, _seeds(langs))
            for n in range(1, MAX_N + 1):
                grams = _grams(hashes, n)[joined[n - 1]]
                any_ = any_ or bool(len(grams))
                for row, at in zip(total[2 * n - 2 :], _slots(grams, slots)):
                    now = np.bincount(at, minlength=slots)
                    now = np.minimum(now, 255, out=now).astype(np.uint8)
                    # Saturated: what would wrap around becomes 255.
                    row += now
                    row[row < now] = 255
        if any_:
            task = TaskContext.get().partitionId()
            flat = total.ravel()
            for k, at in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "task": pa.array([task], pa.int64()), "held": pa.array([zlib.compress(flat[at : at + BLOCK].tobytes(), 1)], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(BLOCK, 2 * MAX_N * slots), np.uint16)
        for held in rows.held:
            total = np.minimum(total + np.frombuffer(zlib.decompress(held), np.uint8), 255).astype(np.uint16)
        return pd.DataFrame({"block": rows.block.iloc[:1], "task": rows.task.iloc[:1] // FAN_IN, "held": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})

    kinds = "block int, task long, held binary"
    cuts = Cuts(texts.sparkSession)
    parts = cuts.table(texts.mapInArrow(count, kinds), "sketch")
    tasks = parts.agg(F.max("task")).first()[0]
    while tasks:
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN_IN)).applyInPandas(merge, kinds)
        tasks //= FAN_IN
    out = np.zeros(2 * MAX_N * slots, np.uint8)
    for r in parts.collect():
        out[r.block * BLOCK :][: min(BLOCK, len(out))] = np.frombuffer(zlib.decompress(r.held), np.uint8)
    cuts.drop_others()
    return [np.packbits(x >= least, axis=1) for x in out.reshape(MAX_N, 2, slots)]


def _has(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which n-grams both rows let pass."""
    one, two = ((row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0 for row, at in zip(bits, _slots(grams, 8 * bits.shape[1])))
    return one & two


def _joined(data: np.ndarray, starts: list[np.ndarray], ends: list[np.ndarray], length: np.ndarray) -> pa.Array:
    """Each row's first `length` spans with a tab, which no word has, between two."""
    size = [np.where(length > k, ends[k] - starts[k] + (length > k + 1), 0) for k in range(MAX_N)]
    offsets = np.concatenate([[0], np.cumsum(sum(size))])
    out = np.full(offsets[-1], 9, np.uint8)
    begin = offsets[:-1].copy()
    for k in range(MAX_N):
        own = np.where(length > k, ends[k] - starts[k], 0)
        before = np.cumsum(own) - own
        step = np.arange(own.sum()) - np.repeat(before, own)
        out[np.repeat(begin, own) + step] = _LOWER[data[np.repeat(starts[k], own) + step]]
        begin += size[k]
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def suffixes(texts: DataFrame, frequent: list[np.ndarray]) -> DataFrame:
    """lang, words (tabs between), c: the cut suffixes of all words, counted within runs and in the order of their words, as such rows are packed best; words is null in the row that counts all words of a run."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["lang", "words", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = shared.value, Words()
        for b, starts, ends, langs in _batches(batches, RUN):
            told = sorted(set(langs))
            code = np.array([told.index(x) for x in langs], np.int64)
            opens, closes, doc, hashes, joined = words(b, starts, ends, _seeds(langs))
            if not len(opens):
                continue
            lang = code[doc]
            # Words by number; a phrase is the pair of its beginning and its last word, so no phrase goes by its hash alone.
            _, word = np.unique(hashes, return_inverse=True)
            kept = _has(bits[0], _grams(hashes, 1))
            at, length = np.flatnonzero(kept), np.ones(len(word), np.int64)
            ids = [word]
            for n in range(2, MAX_N + 1):
                longer = kept & np.roll(kept, -1) & joined[n - 1]
                longer[longer] = _has(bits[n - 1], _grams(hashes, n)[longer])
                length[longer] = n
                pair = np.full(len(word), -1, np.int64)
                _, pair[longer] = np.unique(ids[-1][longer] << 32 | np.roll(word, 1 - n)[longer], return_inverse=True)
                ids.append(pair)
                kept = longer
            key = np.choose(length - 1, ids) * MAX_N + length - 1
            _, first, count = np.unique(key[at], return_index=True, return_counts=True)
            first = at[first]
            then = [np.where(length[first] > k, np.roll(word, -k)[first], -1) for k in range(1, MAX_N)]
            order = np.lexsort((*reversed(then), word[first]))
            first, count = first[order], count[order]
            which = [np.minimum(first + k, len(opens) - 1) for k in range(MAX_N)]
            joined_words = _joined(b, [opens[x] for x in which], [closes[x] for x in which], length[first])
            dictionary = pa.array(told, pa.string())
            yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(lang[first])), joined_words, pa.array(count.astype(np.int64))], names=names)
            total = np.bincount(lang, minlength=len(told))
            yield pa.RecordBatch.from_arrays([dictionary, pa.nulls(len(told), pa.string()), pa.array(total.astype(np.int64))], names=names)

    return texts.mapInArrow(run, "lang string, words string, c long")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in reverse lexicographic order -> all their prefixes with their counts; a count of all words is a phrase of no word."""
    stack: list[str] = []
    counts: list[int] = []
    lang, out = None, []

    def pop(to: int) -> None:
        while len(stack) > to:
            n = counts.pop()
            out.append((lang, " ".join(stack), len(stack), n))
            stack.pop()
            if counts:
                counts[-1] += n

    def told() -> pa.RecordBatch:
        arrays = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "size", "f"])

    for batch in batches:
        for own, joined, c in zip(*(x.to_pylist() for x in batch.columns)):
            words = joined.split("\t") if joined is not None else []
            same = 0
            if own == lang:
                while same < min(len(stack), len(words)) and stack[same] == words[same]:
                    same += 1
            pop(same)
            lang = own
            if joined is None:
                out.append((lang, None, 0, c))
                continue
            for w in words[same:]:
                stack.append(w)
                counts.append(0)
            counts[-1] += c
            if len(out) >= 10_000:
                yield told()
    pop(0)
    if out:
        yield told()


def phrase_counts(texts: DataFrame, cuts: Cuts, least: int = LEAST, slots: int = SLOTS) -> DataFrame:
    """A table of lang, phrase, size, f for phrases of 1 to MAX_N words and at least `least` occurrences; the phrase of size 0 is null and counts all words. texts(_text, _lang)."""
    # Neighbours in the order of words mostly share a share, and even two words that begin a third of all suffixes have several.
    word = lambda k: F.get(F.split("words", "\t", k + 2), F.lit(k))
    share = F.pmod(F.xxhash64(word(1), F.pmod(F.xxhash64(word(2)), F.lit(4)), F.when(F.col("words").isNull(), F.col("c"))), F.lit(PARTS))
    dealt = suffixes(texts, sketch(texts, slots, least)).repartition("lang", word(0), share)
    # Words with characters below the tab come between a suffix and its prefix; a prefix's count is then in two parts, which are summed like those of shares.
    ordered = dealt.sortWithinPartitions(F.col("lang").desc_nulls_last(), F.col("words").desc_nulls_last())
    parts = ordered.mapInArrow(_prefixes, "lang string, phrase string, size int, f long")
    return cuts.table(parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0)), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    cuts = Cuts(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    told = phrase_counts(texts, cuts, least, slots)
    counts, total = told.filter("size > 0"), told.filter("size = 0").select("lang", F.col("f").alias("n"))
    long = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cut = long.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size")).alias("rest"))
    side = lambda c, f: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    both = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = "decimal(20,0)"
    score = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as {wide}) div (cast(l as {wide}) + cast(r as {wide})) as long)")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A phrase falls with a longer one that holds nearly all of its occurrences.
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: F.array_join(F.slice("words", a, n), " "))))
    inside = long.filter("size > 2").select("lang", F.explode(pieces).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer").cast(wide) < PERCENT * F.col("a").cast(wide), F.lit(True)))
    # The limit by rank is taken in every task before rows of a language meet.
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    out = cuts.table(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "collocations")
    cuts.drop_others(out)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, y.f AS l, z.f AS r, (2000000::HUGEINT * x.a // (y.f + z.f))::BIGINT AS score
      FROM x JOIN f y ON y.lang = x.lang AND y.phrase = array_to_string(w[:cut], ' ') JOIN f z ON z.lang = x.lang AND z.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(CASE WHEN size = 3 THEN [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]
        ELSE [array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')] END) AS phrase FROM c WHERE size > 2) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN t USING (lang) LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
"""
