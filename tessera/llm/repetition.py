"""Quality rules by repetition coverage.

Each Arrow batch of texts is one byte array to numpy. A rolling hash (prefix sums of random byte values times powers of an odd
base, modulo 2**64) gives the hash of every word and line as a difference of two prefixes; the hashes of n-word windows roll from
those of n-1 words. A window is duplicated when its hash occurs twice or more in the same document, and only the starts of duplicated
windows of n-1 words are looked at for n, so the longer windows cost little. What counts is coverage: characters inside duplicated
windows, each character once, against all characters in words; likewise for lines equal to an earlier line.

One pass, no shuffle. Texts are taken in pieces of about `chunk_bytes`, never cut: memory is about 60 bytes a byte of
the longest text or of a piece, whichever is more.

Cases: a null or empty text has no words and fails the base rule; invisible and non-ASCII spaces are letters of words; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .rolling import SPACE, Rolling, again, chunks, mix, runs, texts_of

#: Most permitted percentage of word characters inside duplicated windows of n words.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 20
CHUNK_BYTES = 2 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup{n}_chars" for n in NGRAM_LIMITS)]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"

_WORD = np.uint64(0xD6E8FEB86659FD93)


class Kernel:
    """Counts for a run of texts that lie one after another in a byte array."""

    def __init__(self) -> None:
        self.rolling = Rolling()
        self.symbol = np.zeros(256, bool)
        self.symbol[list(b"#*$%&|<>")] = True

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """b: the bytes; starts, ends: of each text, in order and without gaps."""
        docs, size = len(starts), len(b)
        span = self.rolling.over(b)
        opens, closes = runs(~SPACE[b], starts, ends)
        letters = np.zeros(size + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=letters[1:])
        doc = np.searchsorted(ends, opens, side="right")  # empty texts end where they start and are passed over
        chars = letters[closes] - letters[opens]
        add = lambda at, w=None: np.bincount(at, w, minlength=docs).astype(np.int64)
        out = {"n_words": add(doc), "word_chars": add(doc, chars)}
        marks = np.zeros(size + 1, np.int64)
        np.cumsum(self.symbol[b], out=marks[1:])
        out["n_symbols"] = marks[ends] - marks[starts]

        # Lines: every text's start opens one, and so does what follows a line feed.
        feeds = np.flatnonzero(b == 10)
        full = starts < ends
        line_from = np.concatenate([starts[full], feeds + 1])
        line_to = np.concatenate([feeds, ends[full]])
        line_from.sort()
        line_to.sort()
        line_doc = np.searchsorted(ends, line_from, side="right")
        line_doc[line_from >= size] = np.searchsorted(ends, size)
        line_doc = np.minimum(line_doc, docs - 1)
        if (last := (line_from == line_to)).any():  # an empty last line belongs to the text that ends there; it has no word
            keep = ~last
            line_from, line_to, line_doc = line_from[keep], line_to[keep], line_doc[keep]
        worded = np.searchsorted(opens, line_to) > np.searchsorted(opens, line_from)
        line_from, line_to, line_doc = line_from[worded], line_to[worded], line_doc[worded]
        _, later = again(span(line_from, line_to) ^ mix(line_doc.astype(np.uint64) * _WORD))
        out["n_lines"], out["n_dup_lines"] = add(line_doc), add(line_doc[later])
        out["dup_line_chars"] = add(line_doc[later], (letters[line_to] - letters[line_from])[later])

        # Windows of n words: the key holds the document, so that equal keys lie in one text.
        words, salt = span(opens, closes), mix(doc.astype(np.uint64) * _WORD)
        rolled, twice = words.copy(), np.ones(len(words), bool)
        for n in range(2, max(NGRAM_LIMITS) + 1):
            m = max(len(words) - n + 1, 0)
            rolled = rolled[:m] * _WORD + words[n - 1 :]
            if n < 3:
                twice = twice[:m] & (doc[:m] == doc[n - 1 :])
                continue
            at = np.flatnonzero(twice[:m] & twice[1 : m + 1] & (doc[:m] == doc[n - 1 :]))
            twice = np.zeros(m, bool)
            twice[at] = again(mix(rolled[at]) ^ salt[at])[0]
            if n == 3 or n in NGRAM_LIMITS:
                steps = np.zeros(len(words) + 1, np.int32)
                hit = np.flatnonzero(twice)
                steps[hit] += 1
                steps[hit + n] -= 1
                covered = np.cumsum(steps[:-1]) > 0
                if n == 3:
                    out["n_repeat_words"] = add(doc[covered])
                else:
                    out[f"dup{n}_chars"] = add(doc[covered], chars[covered])
        out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        fine = (100 * out["n_dup_lines"] <= LINE_LIMIT * out["n_lines"]) & (100 * out["dup_line_chars"] <= LINE_CHAR_LIMIT * out["word_chars"])
        for n, most in NGRAM_LIMITS.items():
            fine &= 100 * out[f"dup{n}_chars"] <= most * out["word_chars"]
        out["kept"] = fine & ~out["base_failed"]
        return out


def repetition(docs: DataFrame, text: str = "text", id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id and SCHEMA for each row of docs."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel()
        for batch in batches:
            offsets, data = texts_of(batch.column(1))
            for a, z in chunks(offsets, chunk_bytes):
                own = offsets[a : z + 1]
                got = kernel(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *(pa.array(got[c]) for c in [*COUNTS, "base_failed", "kept"])], names=[id, *COUNTS, "base_failed", "kept"])

    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"{id} {kind}, {SCHEMA}")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read(spark, sf_dir, "documents"))


def _sql() -> str:
    own, sums = [], []
    for n in (3, *NGRAM_LIMITS):
        row = f"w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
        own.append(f"CASE WHEN count(*) OVER ({row}) = {n} THEN string_agg(word, ' ') OVER ({row}) END AS g{n}")
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS t{n}" for n in (3, *NGRAM_LIMITS))
    cover = ", ".join(f"bool_or(t{n}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (3, *NGRAM_LIMITS))
    sums = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n}), 0)::BIGINT AS dup{n}_chars" for n in NGRAM_LIMITS)
    limits = " AND ".join(f"100 * dup{n}_chars <= {most} * word_chars" for n, most in NGRAM_LIMITS.items())
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS if c != "n_symbols")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d)),
g AS (SELECT *, {", ".join(own)} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, word, {twice} FROM g),
c AS (SELECT doc_id, word, {cover} FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1), 0)::BIGINT AS dup_line_chars FROM l GROUP BY doc_id),
f AS (SELECT doc_id, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, {zero} FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * n_dup_lines <= {LINE_LIMIT} * n_lines AND 100 * dup_line_chars <= {LINE_CHAR_LIMIT} * word_chars AND {limits} AS kept FROM v
"""


OP1_SQL = _sql()
