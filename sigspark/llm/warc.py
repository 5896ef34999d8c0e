"""WARC archives of pages and their merged capture index.

Writing: a page becomes a response record, or a revisit record when another page with an equal payload is the response.
Spark's text writer puts the records down with the line separator that the format wants between them, so the archives are
plain gzipped WARC/1.1 files on any file system that Spark writes to. Every archive is a sorted run of captures by URL key
(host labels reversed, then the path) and time.

Reading: each archive is parsed by the declared lengths, its captures become sorted segments by key range, and every range
is merged from the segments of all archives by a loser tree. The result is the global capture index: ranges in order, and
inside a range by URL key, time and page.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, text_bytes, written

#: fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: payload bytes per archive
ARCHIVE_BYTES = 16 << 20
#: captures per key range of the merge
RANGE_ROWS = 50_000
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)

INDEX = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
_NAMES = [c.strip().split()[0] for c in INDEX.split(",")]


def url_key(url: str | None) -> str:
    """Host labels reversed, without www and port, then path and query in lower case: captures of one page sort together."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    labels = [x for x in host.split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + slash + path.lower()


def capture_time(page_id: int | None) -> str:
    """The tables have no capture times: one second per page id after the start of 2000."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id, url, html, size, digest, refers_to, revisit: bool) -> str:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http if revisit else http + html
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {capture_time(page_id)}", *([] if url is None else [f"WARC-Target-URI: {quote(url)}"]), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def quote(url: str) -> str:
    """A header value in one line: control characters are escaped."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> str:
    """Archives of all pages in `folder`/archives. Of pages with equal payloads of at least `min_bytes` bytes the one with
    the largest page_id is the response (each row of it, if the id is repeated), the others are revisits of it."""
    t = F.coalesce(F.col("html").cast("string"), F.lit(""))
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), t.alias("html"),
                     F.octet_length(t).cast("long").alias("size"), F.unhex(F.sha1(t)).alias("sha"))
    # only payloads that occur under several ids have anything to look up
    last = x.groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").where(F.col("size") >= min_bytes)
    # written first: where it is small, the pages are not shuffled for it
    x = x.join(written(last.drop("n"), "repeated"), ["sha", "size"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    x = x.select("page_id", "url", F.when(revisit, "").otherwise(F.col("html")).alias("html"), "size", "sha", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = [_record(r["page_id"], r["url"], r["html"], r["size"], base64.b32encode(r["sha"]).decode(), r["refers_to"], r["revisit"]) for r in rows]
            keys = [url_key(r["url"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([capture_time(r["page_id"]) for r in rows]), pa.array([r["page_id"] for r in rows], pa.int64()), pa.array(out)],
                                             ["url_key", "ts", "page_id", "value"])

    n = max(1, -(-text_bytes(pages, "html") // ARCHIVE_BYTES))
    r = x.mapInArrow(run, "url_key string, ts string, page_id long, value string")
    r = r.repartition(n, F.xxhash64("page_id", "url_key", F.length("value"))).sortWithinPartitions("url_key", "ts", "page_id").select("value")
    r.write.option("lineSep", END).option("compression", "gzip").text(f"{folder}/archives")
    return f"{folder}/archives"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of the records of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])  # an empty value keeps its blank
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is not closed")
        yield head, data[start:stop], at, stop - at
        at = stop + 4


def _page(uri: str) -> int | None:
    n = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def _capture(head: dict, block: bytes, at: int, length: int, archive: str) -> tuple:
    payload = block[block.index(b"\r\n\r\n") + 4:]
    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
    url = head.get("WARC-Target-URI")
    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), url, kind, size, digest, refers, archive, at, length


def order_key(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[8], c[9]


class LoserTree:
    """k-way merge of sorted runs: the inner nodes keep the losers, so each step plays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        c = next(self.runs[i], None) if i < len(self.runs) else None
        return None if c is None else (order_key(c), i, c)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return x[:2] < y[:2]

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i][2]
            self.head[i] = self._next(i)
            self._play(i)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives, sorted by URL key and time inside an archive; digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, name = [], path.rsplit("/", 1)[-1]
                for head, block, at, length in parse(gzip.decompress(content.as_py())):
                    rows.append(_capture(head, block, at, length, name))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content").mapInArrow(run, INDEX)


def merged_index(spark: SparkSession, folder: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture index of all archives in `folder`: INDEX plus `key_range`, ordered by key_range and inside it as the
    rows come. Ranges are cut at sampled keys (URL key, time, page), so captures of one hot URL are spread as well."""
    runs = written(captures(spark, folder), "runs")
    n = max(1, -(-runs.count() // range_rows))
    key = F.concat_ws("\x01", "url_key", "timestamp", F.lpad(F.coalesce("page_id", F.lit(-1)).cast("string"), 20, " "))
    # cuts from a bounded sample of keys: they shape the ranges, every row is in one of them
    some = sorted(r[0] for r in runs.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(min(20_000, 40 * n)).collect()) if n > 1 else []
    cuts = [some[len(some) * i // n] for i in range(1, n)] if some else []
    shared = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def range_of(k: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value, x) for x in k.to_pylist()], pa.int32())

    def merge(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t.column(c).to_pylist() for c in _NAMES]))
        runs: dict[str, list] = {}
        for r in rows:
            runs.setdefault(r[8], []).append(r)
        for r in runs.values():  # the shuffle may deliver the pieces of a run in any order
            r.sort(key=lambda c: c[9])
        out = _batch(list(LoserTree([iter(runs[k]) for k in sorted(runs)])))
        return pa.Table.from_batches([out]).append_column("key_range", pa.array([t.column("key_range")[0].as_py()] * out.num_rows, pa.int32()))

    x = runs.withColumn("key_range", range_of(key))
    return x.groupBy("key_range").applyInArrow(merge, INDEX + ", key_range int")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC archives, read them back as the merged capture index.

    Null html is an empty payload; null page_id and url give records without page number and target, a page_id of null is
    never referred to; repeated rows are records of their own; other columns are ignored; an empty table gives an empty
    index.
    """
    spark = pages.sparkSession
    return merged_index(spark, write(pages, folder or scratch(spark, "warc"), min_bytes))
