"""Sequence packing: best-fit decreasing over a segment tree of remaining capacities.

A document's token ids, with an end id, are cut into full windows of the sequence length and one rest. Full windows are
sequences of their own. Rests are dealt over tasks by a hash of document and position and packed there, largest first, each into the open
sequence with the least remaining room that still takes it. The segment tree's leaves are the remaining capacities 0..window; a
descent finds the smallest capacity in use that is large enough in O(log window), whatever the number of open sequences.

A task's rests come sorted by Spark and stream through one segment tree, so memory is that of the open sequences alone. Every task leaves about
one partly filled sequence. Sequence ids hold the task's partition and a counter. Rests are dealt to a fixed number of partitions by their hash and sorted by all that tells them apart,
so every run and every retry gives the same ids.

Token ids are those of the `tokenizers` file. They are computed by tiktoken's merge loop over the vocabulary read from that file, which is some
three times faster; a probe text must get the same ids from both, or the file's own encoder is used, as it is for texts with a special token's string in them:
there the file's encoder gives that token's id.

Cases: null text is empty: its only id is the end id. A document of one window is one full sequence. Repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The pre-tokenizer pattern of byte-level vocabularies of this kind, and a text to compare encoders on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's they'll  we've\n\n 12½ ²x é́ ß中文字 \u00a0\u200b\u2028z\t\x1c!\x85 #*$%&|<> naïveté 😀👍🏽 <|thwhanation   \r\n "


def _plain_bytes(token: str) -> bytes:
    """The bytes of a token as byte-level vocabularies spell it: printable bytes as themselves, the others counted up from 256."""
    if not _spelled:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _spelled.update({chr(b): b for b in shown})
        _spelled.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))})
    return bytes(_spelled[c] for c in token)


_spelled: dict[str, int] = {}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.plain = lambda text: own.encode(text, add_special_tokens=False).ids
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        try:
            ranks = {_plain_bytes(t): i for t, i in own.get_vocab().items() if t not in special}
            fast = Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = fast if fast(PROBE) == self.plain(PROBE) else self.plain
        except (KeyError, ValueError):  # not a byte-level vocabulary
            self.ids = self.plain

    def __call__(self, text: str) -> bytes:
        ids = self.plain if self.special and self.special.search(text) else self.ids
        return array("I", ids(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Capacities:
    """Open sequences by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = defaultdict(list)

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.size
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The smallest capacity of at least `least` and a sequence that has it."""
        at = least + self.size
        if not self.used[at]:
            while at > 1 and (at & 1 or not self.used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.used[2 * at] else 2 * at + 1
        capacity = at - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            self.used[at] = 0
            at >>= 1
            while at and not (self.used[2 * at] or self.used[2 * at + 1]):
                self.used[at] = 0
                at >>= 1
        return capacity, sequence


class BestFit:
    """Places pieces, which must come largest first, each into the open sequence with the least room that takes it."""

    def __init__(self, window: int):
        self.window, self.room, self.sequences = window, Capacities(window), 0

    def __call__(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each of the next pieces."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for k, n in enumerate(lengths.tolist()):
            if (got := self.room.take(n)) is None:
                got, self.sequences = (self.window, self.sequences), self.sequences + 1
            capacity, sequence[k] = got
            offset[k] = self.window - capacity
            if capacity > n:
                self.room.put(capacity - n, got[1])
        return sequence, offset


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens (and ids binary): each document cut into full windows and a rest."""
    kind = docs.schema[id].dataType.simpleString()
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    ids = encode(t or "") + end
                    for s in range(0, len(ids), 4 * window):
                        part = ids[s : s + 4 * window]
                        rows.append(k)
                        starts.append(s // 4)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        totals.append(len(ids) // 4)
                        if with_ids:
                            parts.append(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
                names = [id, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"{id} {kind}, {PIECE}" + ", ids binary" * with_ids)


def pack(cut: DataFrame, id: str = "doc_id", window: int = 1024, tasks: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset; tasks: how many partitions pack them (the session's shuffle partitions)."""
    tasks = tasks or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, place = TaskContext.get().partitionId() << 40, BestFit(window)
        for batch in batches:
            sequence, offset = place(batch.column("length").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    dealt = cut.repartition(tasks, F.col(id), F.col("start"), F.col("ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), F.col(id), F.col("start"), F.col("ids_crc32")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `window` ids: the pieces with their sequence and offset, and with_ids their ids."""
    return pack(pieces(docs, tokenizer, text, id, window, end_id, with_ids), id, window)


def op8_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
