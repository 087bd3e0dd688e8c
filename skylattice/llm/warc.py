"""WARC archives of pages: writing with revisit records, reading back, and a globally ordered capture index.

Archives are whole WARC/1.1 files held as binary rows of a Parquet table, so that they live in any store Spark
reaches. The index is built the external way: every archive yields a run of captures sorted by (URL key,
timestamp); key ranges are dealt to tasks; each task merges the pieces of the runs with a loser tree.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import common

ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this always get a record of their own.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long"
CAPTURE = "urlkey string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long"
#: Captures of one merge task, about.
RANGE_ROWS = 200_000


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path and query, all lower case; no scheme, ``www.`` or port 80. Null gives ''."""
    rest = (url or "").strip().lower().partition("://")
    rest = rest[2] or rest[0]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:].partition("#")[0]
    host = host.removesuffix(":80").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/") if host else path


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): the smallest page_id of equal payloads of 100 bytes or more stands for the others."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    first = pages.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pages.join(first, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _head(line: str, fields: list[tuple[str, object]]) -> bytes:
    return (line + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_bytes(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    """One record. The date is the page's number in seconds after 2020, as the table has no time of its own."""
    payload = html.encode()
    date = (datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=(page_id or 0) % 10**9)).isoformat() + "Z"
    clean = "".join(c for c in url or "" if c not in "\r\n")
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", clean))
    fields.append(("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", len(payload))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): WARC files of about 8 MB, stored in the shared folder. An empty table gives no archive."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out():
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:20] + ".warc"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(record_bytes(*row))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return common.stored(plan_records(pages).mapInArrow(pack, "archive string, content binary"))


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one WARC file, in the columns of ``RECORD`` without the archive's name."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        line, *lines = content[at:end].decode().split("\r\n")
        if not line.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(field["content-length"])
        block = content[end + 4 : end + 4 + size]
        payload = block.partition(b"\r\n\r\n")[2]
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        revisit = field["warc-type"] == "revisit"
        digest = field["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs at byte {at}")
        yield number(field["warc-record-id"]), field.get("warc-target-uri"), field["warc-date"], field["warc-type"], number(field["warc-refers-to"]) if revisit else None, int(field["x-payload-length"]) if revisit else len(payload), digest, None if revisit else payload, at
        at = end + 4 + size + 4


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives (``RECORD``); payloads on demand, digests checked either way."""
    schema = RECORD if payloads else RECORD.replace("payload binary, ", "")
    own = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
    keep = [n for n in own.names if payloads or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for row in parse(batch.column(1)[i].as_py()):
                    rows.append((*row[:7], row[7] if payloads else None, name, row[8]))
                columns = list(zip(*rows)) if rows else [[] for _ in own]
                full = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own)], schema=own)
                yield full.select(keep)

    return archives.select("archive", "content").mapInArrow(run, schema)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner moves up; one path is replayed per item."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.loser = [-1] * self.k
        winner = [-1] * (2 * self.k)
        for i in range(len(runs)):
            winner[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._beats(a, b) else (b, a)
        self.top = winner[1]

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self):
        while self.top >= 0 and self.at[self.top] < len(self.runs[self.top]):
            now = self.top
            yield self.runs[now][self.at[now]]
            self.at[now] += 1
            node = (self.k + now) // 2
            while node:
                other = self.loser[node]
                if self._beats(other, now):
                    self.loser[node], now = now, other
                node //= 2
            self.top = now


def capture_index(records: DataFrame) -> DataFrame:
    """All captures (``CAPTURE``) in the order of URL key, timestamp and page_id across partitions.

    Runs are the archives, each sorted where it is read and written in that order. A range of about ``RANGE_ROWS`` captures
    goes to one task, which merges the runs' pieces in it; ranges end anywhere in (key, timestamp, page_id, archive, offset),
    so that one very common URL, or one repeated page, spreads over many tasks. Null URLs have key ''; a null page_id
    comes first among captures of one key and time; captures equal in all three keep the order of archive and offset.
    """
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    types = [pa.int64() if "long" in c else pa.string() for c in CAPTURE.split(", ")]

    def runs(batches):
        for batch in batches:
            rows = [(url_key(u), *r) for u, *r in zip(*(c.to_pylist() for c in batch.columns))]
            rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[7], r[8]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[] for _ in names], types)], names)

    def merge(batches):
        # the pieces of the runs in this range, as Arrow batches; only their keys become Python objects
        pieces: list[list[tuple]] = []
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = len(held)
            held.append(batch)
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in order))):
                k = (*k[:2], k[2] is not None, k[2] or 0, *k[3:])
                if last is None or k < last:  # the shuffle hands a run's rows over in order: a fall begins another piece
                    pieces.append([])
                pieces[-1].append((k, at, i))
                last = k
        rows: list[tuple[int, int]] = []
        for _, at, i in LoserTree(pieces) if pieces else ():
            rows.append((at, i))
            if len(rows) == 8192:
                yield _taken(held, rows)
                rows = []
        if rows:
            yield _taken(held, rows)

    local = records.select("url", "captured", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset").mapInArrow(runs, CAPTURE)
    # written once: drawing the range borders does not parse the archives again
    local = common.stored(local)
    order = ["urlkey", "captured", "page_id", "archive", "offset"]
    ranges = max(-(-local.count() // RANGE_ROWS), 1)
    return local.repartitionByRange(ranges, *order).mapInArrow(merge, CAPTURE)


def _taken(batches: list[pa.RecordBatch], rows: list[tuple[int, int]]) -> pa.RecordBatch:
    """The rows (batch, place) in this order."""
    used = sorted({b for b, _ in rows})
    first = {b: sum(batches[x].num_rows for x in used[:i]) for i, b in enumerate(used)}
    table = pa.Table.from_batches([batches[b] for b in used]).take(pa.array([first[b] + i for b, i in rows]))
    return table.combine_chunks().to_batches()[0]


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns the merged capture history of all records."""
    captures = capture_index(read_archives(write_archives(common.table(spark, sf_dir, "pages")), payloads=False))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, lower(trim(coalesce(url, ''))) AS u FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY d),
r AS (SELECT *, CASE WHEN contains(u, '://') AND substr(u, strpos(u, '://') + 3) <> '' THEN substr(u, strpos(u, '://') + 3) ELSE split_part(u, '://', 1) END AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS front FROM r),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(front, '^.*@', ''), ':80$', ''), '^www\\.', '') AS host, regexp_replace(substr(rest, length(front) + 1), '#.*$', '') AS path FROM h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, k.d AS payload_digest,
       CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to,
       CASE WHEN host = '' THEN path ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS urlkey,
       strftime(TIMESTAMP '2020-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM k LEFT JOIN f ON k.d = f.d
"""
