"""WARC archives with a two-level capture index.

Writing. Each task appends its pages to one archive in the shared store, a gzip member a record. Of records with
equal payloads the one with the largest id is a response and the others revisit it; of several rows with that id the last in the table's order is. Archive names are unique to the
task attempt, and the captures (key, id, file, offset, length) are committed as a table before anything reads them, so a
retried task leaves an unused file and nothing else.

Index. Captures are range-partitioned and sorted by (reversed-host URL key, id). Each partition becomes one index file: blocks of `BLOCK` captures, compressed,
then a sparse directory with each block's first key, offset and length, and at the end the directory's own length. The manifest
has one row an index file with its first and last key; there are as many as index partitions.

Reading. Requests (key, id) are range-partitioned and sorted the same way. A task binary-searches the manifest for the file, the file's
directory for the block, and the block for the capture; directory and block are range reads and each is read once a run
of requests. The captures found are grouped by archive and read by offset, neighbouring ranges in one read.

Stores: archives and index files go through pyarrow's file systems by the folder's URI (local or mounted paths, HDFS, S3, GCS); tables go through Spark.

Cases: null html is an empty payload; null or unparsable urls are keyed by their text; a null id sorts first and is never the largest unless
alone; repeated rows are records of their own, each found once, of which one is the response; payloads under `least` bytes are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cuts, read, scratch, whole

BLOCK = 1024
#: Ranges of one archive that lie at most so far apart are read together, up to the most bytes.
NEAR, TOGETHER = 1 << 14, 4 << 20

CAPTURE = "key string, id long, file string, offset long, length long"


def reversed_host_key(url: str | Column) -> Column:
    """`http://www.Example.com/a?b#c` -> `com,example,www)/a?b`; other texts stay as they are."""
    url = whole(url)
    parts = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.array_join(F.reverse(F.split(F.lower(parts), r"\.")), ",")
    return F.when(parts != "", F.concat(host, F.lit(")"), rest)).otherwise(url)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, id: int | None, payload: bytes, digest: str, revisits: bool, original: int | None) -> bytes:
    """One WARC record; ids are in the record URIs, and a revisit keeps the HTTP head with the full length."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {name(id)}", "WARC-Date: 1970-01-01T00:00:00Z", *_target(url), f"WARC-Payload-Digest: sha1:{digest}"]
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(original)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _target(url: str) -> list[str]:
    """The header of a URL: as it is, percent signs too. One with control characters, which no header line holds, is escaped whole and marked."""
    if not re.search(r"[\x00-\x1f\x7f]", url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url)}", "WARC-Target-Escaped: percent"]


def parse(raw: bytes) -> dict:
    """The fields of a record, with payload None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(x, ""))) else None
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"id": page("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-Escaped" in fields else fields["WARC-Target-URI"], "bytes": full, "digest": digest, "kind": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 3) -> DataFrame:
    """pages(page_id, url, html) to archives in the folder; the captures, one a page: CAPTURE. Payloads under `least` bytes are never revisited."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"), whole("url").alias("url"), reversed_host_key("url").alias("key"), whole("html").cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("tag"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    # Equal payloads: partial counts before the shuffle, and only digests that occur twice meet the pages again.
    shared = rows.filter(F.length("payload") >= least).groupBy("sha").agg(F.max(F.struct("id", "tag")).alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("last.id").alias("original"), F.col("last.tag").alias("chosen"))
    told = rows.join(shared, "sha", "left").select("id", "url", "key", "payload", "original", F.coalesce((F.length("payload") >= least) & (F.col("tag") != F.col("chosen")), F.lit(False)).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, at, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
        for whole_batch in batches:
            for start in range(0, len(whole_batch), 256):
                batch = whole_batch.slice(start, 256)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                offsets, lengths = [], []
                for r in batch.to_pylist():
                    raw = record(r["url"], r["id"], r["payload"], base32_sha1(r["payload"]), r["revisits"], r["original"])
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array([name] * len(batch)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return told.mapInArrow(run, CAPTURE)


MANIFEST = "first_key string, first_id long, last_key string, last_id long, file string, captures long"


def _order(key: str, id: int | None) -> tuple:
    return (key, id is not None, id or 0)


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Index files in the folder from captures; the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, at, held, directory, total, last, out = f"captures-{uuid.uuid4().hex}.idx", 0, [], [], 0, None, None

        def flush() -> None:
            nonlocal at, held
            packed = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            directory.append([held[0][0], held[0][1], at, len(packed)])
            out.write(packed)
            at += len(packed)
            held = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append([r["key"], r["id"], r["file"], r["offset"], r["length"]])
                total, last = total + 1, held[-1]
                if len(held) == block:
                    flush()
        if out is not None:
            if held:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + len(packed).to_bytes(8, "little"))
            out.close()
            ends = [directory[0][0], directory[0][1], last[0], last[1], name, total]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) or k in (1, 3) else pa.string()) for k, x in enumerate(ends)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, MANIFEST)


class IndexReader:
    """Finds captures by binary search: manifest, directory of a file, block of a directory. The last file and block stay in memory."""

    def __init__(self, manifest: list[tuple], folder: str):
        """manifest: (last_key, last_id, file) by key."""
        self.store, self.root = _store(folder)
        self.files = [m[2] for m in manifest]
        self.lasts = [_order(m[0], m[1]) for m in manifest]
        self.file = self.block = None

    def _range(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return zlib.decompress(self.source.read(length))

    def _open(self, file: str) -> None:
        if file != self.file:
            self.file, self.block = file, None
            self.source = self.store.open_input_file(f"{self.root}/{file}")
            size = self.source.size()
            self.source.seek(size - 8)
            length = int.from_bytes(self.source.read(8), "little")
            self.directory = json.loads(self._range(size - 8 - length, length))
            self.firsts = [_order(x[0], x[1]) for x in self.directory]

    def find(self, key: str, id: int | None) -> Iterator[list]:
        want = _order(key, id)
        for f in range(bisect.bisect_left(self.lasts, want), len(self.files)):
            self._open(self.files[f])
            for b in range(max(0, bisect.bisect_left(self.firsts, want) - 1), len(self.firsts)):
                if self.firsts[b] > want:
                    return
                if self.block != b:
                    self.block = b
                    self.lines = [json.loads(x) for x in self._range(*self.directory[b][2:]).split(b"\n")]
                    self.keys = [_order(x[0], x[1]) for x in self.lines]
                at = bisect.bisect_left(self.keys, want)
                while at < len(self.keys) and self.keys[at] == want:
                    yield self.lines[at]
                    at += 1
            if self.lasts[f] > want:
                return


def lookup(requests: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """requests(key, id), each wanted once -> CAPTURE of every capture with that key and id."""
    # One row an index partition: a bound set by the cluster's partition count, not by the data.
    files = sorted(((r.last_key, r.last_id, r.file) for r in manifest.select("last_key", "last_id", "file").collect()), key=lambda r: _order(r[0], r[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(files, folder)
        kinds = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            found = [x for r in batch.to_pylist() for x in reader.find(r["key"], r["id"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return requests.distinct().repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, CAPTURE)


RECORD = "id long, url string, bytes long, digest string, kind string, refers_to long"


#: A fetching task reads about so many bytes of archives.
FETCH_BYTES = 32 << 20


def fetch(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of captures by range reads: RECORD, and the payload where wanted (null in revisits).

    captures should be a table: it is read twice before. Tasks are as many as the records' bytes need, not as the small rows of captures suggest.
    """
    spark = captures.sparkSession
    total = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // FETCH_BYTES))
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = {"id": pa.int64(), "bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        file = source = None
        for batch in batches:
            rows, out = batch.select(["file", "offset", "length"]).to_pylist(), []
            k = 0
            while k < len(rows):
                first, z = rows[k], k
                end = first["offset"] + first["length"]
                while z + 1 < len(rows) and rows[z + 1]["file"] == first["file"] and 0 <= rows[z + 1]["offset"] - end <= NEAR and end - first["offset"] < TOGETHER:
                    z += 1
                    end = rows[z]["offset"] + rows[z]["length"]
                if file != first["file"]:
                    file, source = first["file"], store.open_input_file(f"{root}/{first['file']}")
                source.seek(first["offset"])
                span = source.read(end - first["offset"])
                out += [parse(zlib.decompress(span[r["offset"] - first["offset"] :][: r["length"]], 31)) for r in rows[k : z + 1]]
                k = z + 1
                if len(out) >= 256 or k >= len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kinds.get(n, pa.string())) for n in names], names=names)
                    out = []

    schema = RECORD + ", payload binary" * with_payload
    return captures.repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder, cuts = read(spark, sf_dir, "pages"), scratch(spark, "warc"), Cuts(spark)
    captures = cuts.table(write_archives(pages, folder), "captures")
    manifest = cuts.table(build_index(captures, folder), "manifest")
    requests = pages.select(reversed_host_key("url").alias("key"), F.col("page_id").cast("long").alias("id"))
    out = fetch(cuts.table(lookup(requests, manifest, folder), "found"), folder)
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS original FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: (16 >> j) * CAST(substr(bits, 5 * i + j + 1, 1) AS INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM b
"""
