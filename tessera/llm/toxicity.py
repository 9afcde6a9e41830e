"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text's windows of `WINDOW` words are compressed with
each; a window that is shorter with the toxic dictionary than with the ordinary one resembles toxic text. Window differences make a few
figures a document (largest, mean, windows over a threshold), and a logistic curve calibrated on other labelled rows turns them into
a score.

What is compressed is each word's 16-byte code (a hash of its letters, case folded), not its letters. In plain bytes a short
insult costs zstandard about as much as the sequence that would replace it, so a window says nothing; as codes a known word saves 13 bytes and a
chance match is impossible. Each dictionary is trained on the words of its class that the other class's training texts lack.

Fit: at most `sample` labelled ids of each class, one text of at most `most_bytes` bytes each, chosen by a hash of the id from the rows given; half train the
dictionaries, half set the threshold and the curve. One task fits them; the driver sees the two dictionaries and the curve, no text.
Scoring covers whole texts in one pass without a shuffle.

Cases: null and empty texts have no window and get the calibrated score of a text without evidence; rows without a
label or with a null label do not train; several labels of one id count as toxic if any is; with no labelled row of a class every text scores the share
of toxic rows (0.5 without any); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .rolling import Rolling, chunks, mix, runs, texts_of

WINDOW = 64
DICTIONARY_BYTES = 8192
SAMPLE, MOST_BYTES = 3000, 1 << 15
CODE = 16

#: Word bytes: ASCII letters and digits, and all of other scripts' letters. Capitals count as small letters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32


class Coder:
    """Texts to arrays of word codes."""

    def __init__(self) -> None:
        self.rolling = Rolling(_FOLD)

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts as rows of two numbers, and for each text the end of its rows."""
        opens, closes = runs(_LETTER[b], starts, ends)
        words = self.rolling.over(b)(opens, closes)
        return np.stack([words, mix(words + np.uint64(1))], 1), np.searchsorted(opens, ends)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: list[float]
    scale: list[float]
    constant: float | None = None


def _compressor(dictionary: bytes):
    import zstandard as z

    # Literals stay raw and only whole codes match: the length counts known words.
    how = z.ZstdCompressionParameters.from_level(
        1, strategy=z.STRATEGY_FAST, min_match=7, target_length=1, window_log=17, hash_log=15,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS,
    )
    return z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT))


class Windows:
    """Differences of the windows' compressed lengths: ordinary less toxic."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)

    def __call__(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number a window, and each window's text."""
        import zstandard as z

        sizes = np.diff(ends, prepend=0)
        count = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(ends)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = (ends - sizes)[text] + nth * WINDOW
        if not len(text):
            return np.zeros(0), text
        length = np.minimum(WINDOW, ends[text] - start)
        segments = np.stack([start, length], 1).astype(np.uint64) * np.uint64(CODE)
        plain = z.BufferWithSegments(np.ascontiguousarray(codes).tobytes(), segments.tobytes())
        got = [np.fromiter((len(x) for x in c.multi_compress_to_buffer(plain, threads=1)), np.int64, len(text)) for c in (self.ordinary, self.toxic)]
        return (got[0] - got[1]).astype(float), text


def figures(diff: np.ndarray, text: np.ndarray, texts: int, threshold: float) -> np.ndarray:
    """For each text: largest and mean difference, windows at or over the threshold, their share."""
    n = np.bincount(text, minlength=texts)
    most = np.full(texts, 0.0)
    np.maximum.at(most, text, diff)
    over = np.bincount(text, diff >= threshold, minlength=texts)
    safe = np.maximum(n, 1)
    return np.stack([most, np.bincount(text, diff, minlength=texts) / safe, np.log1p(over), over / safe], 1)


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard as z

    samples = [s for s in samples if s]
    try:
        # Steps of 8 bytes, segments of one code. Only the content counts: entropy tables would be those of letters.
        return z.train_dictionary(DICTIONARY_BYTES, samples, k=CODE, d=8, level=1).as_bytes()
    except z.ZstdError:  # too few texts to train on
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """From labelled texts, in random order."""
    if not 0 < toxic.sum() < len(toxic):
        return Model(b"", b"", 0, [], [], float(toxic.mean()) if len(toxic) else 0.5)
    offsets, data = texts_of(pa.array(texts, pa.large_string()))
    coder, each = Coder(), []
    for a, z in chunks(offsets, 1 << 20):
        own = offsets[a : z + 1]
        codes, ends = coder(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0])
        each += np.split(codes, ends[:-1])
    # Every other text of each class calibrates, so that both halves hold both classes (where there are two of each).
    nth = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    learn = nth % 2 == 1
    known = {c: [each[i] for i in np.flatnonzero(learn & (toxic == c))] for c in (True, False)}
    vocabulary = {c: np.unique(np.concatenate([x[:, 0] for x in known[c]])) for c in known}

    def own(c: bool) -> list[bytes]:
        word, docs = np.unique(np.concatenate([np.unique(x[:, 0]) for x in known[c]]), return_counts=True)
        mine = word[~np.isin(word, vocabulary[not c]) & (docs >= min(2, len(known[c])))]
        return [np.ascontiguousarray(x[np.isin(x[:, 0], mine)]).tobytes() for x in known[c]]

    model = Model(_dictionary(own(True)), _dictionary(own(False)), 0, [], [])
    rest = np.flatnonzero(~learn) if 0 < toxic[~learn].sum() < (~learn).sum() else np.arange(len(texts))
    chosen = [each[i] for i in rest]
    diff, text = Windows(model)(np.concatenate(chosen), np.cumsum([len(x) for x in chosen]))
    y = toxic[rest]
    # The window threshold that tells the classes apart best.
    best = -1.0
    for t in range(1, 40):
        hit = np.bincount(text, diff >= t, minlength=len(rest)) > 0
        if (gain := hit[y].mean() - hit[~y].mean()) > best:
            best, model.threshold = gain, float(t)
    x = figures(diff, text, len(rest), model.threshold)
    model.scale = [float(s) or 1.0 for s in x.std(0)]
    model.weights = _logistic(x / model.scale, y.astype(float)).tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """Learns from a bounded sample of the rows of docs that labels marks."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64("id")
    picks = marked.filter("y = 1").orderBy(order, "id").limit(sample).unionByName(marked.filter("y <> 1").orderBy(order, "id").limit(sample))
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") <= most_bytes)
    # One text an id: at most 2 * sample short rows, whatever the tables hold. They meet in one task.
    rows = own.join(F.broadcast(picks), "id").groupBy(F.col("id").cast("string").alias("id"), "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((hash_id(r["id"]), r["id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
        model = fit([r[2] for r in held], np.array([r[3] == 1 for r in held], bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got.model) if got else fit([], np.zeros(0, bool))


def hash_id(x) -> int:
    import zlib

    return zlib.crc32(f"order {x}".encode())


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", carry: bool = False) -> DataFrame:
    """id (with carry: row, a struct of all columns) and score (0 to 1) for each row of docs."""
    source = docs.select(F.struct(*docs.columns).alias("row")) if carry else docs.select(F.col(id), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, windows = Coder(), Windows(model)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), text).cast(pa.string()) if carry else batch.column(1)
            offsets, data = texts_of(texts)
            for a, z in chunks(offsets, 2 << 20):
                if model.constant is not None:
                    p = np.full(z - a, model.constant)
                else:
                    own = offsets[a : z + 1]
                    codes, ends = coder(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0])
                    x = figures(*windows(codes, ends), z - a, model.threshold) / model.scale
                    p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(p)], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(id: str = "doc_id"):
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(~held_out())
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
