"""WARC archives of pages, read back through an external merge of their capture indexes.

Archives are WARC/1.0 files with a gzip member for each record, on any file system: Spark's text writer puts the members
one behind the other, and what it writes between them as end of line is an empty member. The index says where a record's
member stands, so it is read without what lies before it. Reading goes through an archive member by member and sorts its
captures by URL key, timestamp and page: a run. Runs are dealt by ranges of that key, of a bounded number of captures
each; in a range a loser tree merges the pieces of all runs, so that the parts, one after the other, are the capture
histories in global order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of so many bytes are stored once.
LEAST_REVISIT = 1000
RECORDS_A_FILE = 2000
#: Captures of a range that is merged at once (some 400 bytes each).
RANGE_CAPTURES = 200_000
#: A gzip member without content.
EMPTY_MEMBER = bytes((0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0))
RECORD_ID = re.compile(rb"<urn:page:(-?\d+|none)>")
CAPTURE = "run string, urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_at long, record_bytes long"


def revisits(pages: DataFrame) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to. Of equal payloads the largest page_id
    is the response; rows that share it are all responses, and so are all rows if none has a page_id."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    # only digests that occur more than once are joined back
    groups = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    out = rows.join(groups, ["payload_digest", "payload_bytes"], "left").withColumn("again", F.coalesce(first, F.lit(False)))
    return out.withColumns({"record_type": F.when(F.col("again"), "revisit").otherwise("response"), "refers_to": F.when(F.col("again"), F.col("first"))})


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_archives(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE) -> None:
    """Writes a record for each row of pages (page_id, url, html), whole ones alone: Spark's commit protocol makes each file
    appear whole or not at all. Null html: an empty payload. Control characters and spaces of a URL are percent-encoded; a
    null URL has no header. Capture times are seconds from a fixed day by page_id, as pages have none. Rows that share a
    page_id are records with the same id."""
    url = F.col("url")
    for c in (" ", "\r", "\n", "\t", "\x00"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31_536_000))
    date = F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.0\r\n"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", urn(F.col("page_id"))), _header("WARC-Target-URI", url), _header("WARC-Date", date),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _header("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    records_ = revisits(pages).select(F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column("value"):
                yield pa.RecordBatch.from_arrays([pa.array([zlib_member(record.as_buffer())], pa.binary())], names=["value"])

    # the bytes are a string to the writer, which copies them as they are
    members_ = records_.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    members_.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_a_file).text(path)


def zlib_member(raw: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of each gzip member that isn't empty, one at a time."""
    at, view = 0, memoryview(raw)
    while at < len(view):
        begin, z, out = at, zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + (1 << 16)]
            if not len(part):
                raise ValueError(f"the member at {begin} has no end")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if content := b"".join(out):
            yield begin, at - begin, content


def read_record(raw: bytes, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """Headers and content of the record that the index says stands at `at` of an archive, with `size` bytes: only those
    are read."""
    _, _, head, content = next(records(zlib.decompress(raw[at : at + size], 31)))
    return head, bytes(content)


def url_key(url: str) -> str:
    """A URL's sort key: host labels reversed, without scheme, user, default port and fragment, then path and query."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    m = re.match(r"(?:[^/?@]*@)?([^/?:]*)(:\d+)?(.*)", rest, re.S)
    host, port, path = m[1].lower().rstrip("."), m[2] or "", m[3]
    port = "" if port in (":80", ":443") else port
    return ",".join(reversed(host.split("."))) + port + ")" + (path or "/")


def records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """The records of an archive: offset and length in it, headers by lower-case name, content."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        yield at, stop - at, headers, view[end + 4 : stop]
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it should")
        at = stop + 4


def _page(urn: str) -> int | None:
    m = RECORD_ID.match(urn.encode())
    return None if m is None or m[1] == b"none" else int(m[1])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, each archive's sorted: a run. Payloads are checked against digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, run = [], name.as_py().rsplit("/", 1)[-1]
                for at, size, raw in members(content.as_buffer()):
                    for _, _, head, content_ in records(raw):
                        payload = bytes(content_).partition(b"\r\n\r\n")[2]
                        digest, kind, n = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(head["warc-payload-length"])
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
                            raise ValueError(f"{run}: the payload at {at} isn't what its digest says")
                        rows.append((url_key(head.get("warc-target-uri", "")), re.sub(r"\D", "", head["warc-date"]), _page(head["warc-record-id"]), n, digest, kind, _page(head["warc-refers-to"]) if kind == "revisit" else None, at, size))
                rows.sort(key=capture_key)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[run] * len(rows), *cols], types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, CAPTURE)


def capture_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next winner takes log k comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.keys = [self._key(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)  # node 0: the winner
        for i in range(self.k):
            self._play(i)

    def _key(self, i: int) -> tuple:
        # a run that is over loses against all others; the run's number settles ties
        return (0, capture_key(self.runs[i][self.at[i]]), i) if self.at[i] < len(self.runs[i]) else (1, (), i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its opponent
                self.tree[node] = i
                return
            if self.keys[other] < self.keys[i]:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while True:
            i = self.tree[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.keys[i] = self._key(i)
            self._play(i)


def merge_runs(captures: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Sorted runs -> all captures in global order of URL key, timestamp and page. There are as many ranges as it takes for
    each to have about range_captures; captures with one key, time and page stay together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        runs: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for run, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                runs.setdefault(run, []).append((*row, run))
        if schema is None:
            return
        for rows in runs.values():
            rows.sort(key=capture_key)  # a run's pieces come in order from each of its files' tasks, which this sees at once
        out: list[tuple] = []
        for row in LoserTree(list(runs.values())):
            out.append((row[-1], *row[:-1]))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)

    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // range_captures))
    return captures.repartitionByRange(n, "urlkey", "ts", "page_id").mapInArrow(merge, CAPTURE)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives to `path` (a new folder of the shared one if none is given), reads
    them back and returns the merged capture index. An empty table gives an empty index. Rows that share a page_id are
    records of their own. Other columns are ignored."""
    spark = pages.sparkSession
    path = path or common.new_path(spark, "archives")
    write_archives(pages, path)
    return merge_runs(common.materialize(read_archives(spark, path), "captures"))
