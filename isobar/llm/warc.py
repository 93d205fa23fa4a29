"""WARC archives with deduplicated payloads, and the merged index of their captures.

Every page becomes one record. Equal payloads are stored once: the record with the
largest page_id is the response, all others are revisit records that name it. Spark's
text writer commits the archives, one file or more per task, with the two line ends
that close a record as its separator.

Reading gives a capture run per file: its records sorted by URL key and time. The
runs are cut at the same bounds, and each range is merged from all its runs by a
loser tree, so the ranges one after another are the capture history of every URL.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.session import scratch, settle

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_BYTES = 0
#: Records in one file at most; a file is read in one piece.
RECORDS = 5000
#: Time of capture of pages that have none of their own.
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = (
    "url_key string, captured string, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, url string, path string, position long, length long"
)


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 40 bits are 10 hexadecimal or 8 base-32 digits."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """One header line; none if the value is null. Line ends cannot enter it."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record): the WARC record of each row of ``pages`` (page_id, url, html), without its closing line ends.

    A null html is empty, a null url or page_id has no header. Among equal payloads,
    rows with the largest page_id are responses; rows without a page_id revisit it,
    or are all responses if no row has one.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "size": F.octet_length("payload").cast("long"), "digest": digest(F.col("payload")),
    })
    narrow = settle(rows.select("page_id", "url", "size", "digest"), "payloads").where(F.col("size") >= least_bytes)
    first = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("to"), F.count("*").alias("n")).where("n > 1")
    # Copies are joined with their response by digest in narrow rows, which a join may split; payloads
    # are then joined by page_id, of which there are few rows each.
    revisits = narrow.select("page_id", "digest").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("to.page_id")))
    revisits = settle(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "to").distinct(), "revisits")
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("d").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    name = F.md5(F.concat_ws("\x1f", F.col("page_id").cast("string"), "url", "digest"))
    uuid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    to = F.when(again, F.col("to.page_id"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", uuid),
        _header("WARC-Date", F.lit(CAPTURED)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _header("WARC-Refers-To-Target-URI", F.when(again, F.col("to.url"))),
        _header("X-Refers-To-Page-ID", to),
        _header("X-Page-ID", F.col("page_id")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    return joined.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of ``pages`` to new WARC files under ``path``; an empty table gives empty ones."""
    out = records(pages, least_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS)
    out.text(path)


def url_key(url: str | None) -> str:
    """The sort key of a URL: reversed host labels, port, path and ordered query, in lower case; '' for none."""
    try:
        parts = urlsplit((url or "").strip())
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return (url or "").lower()
    host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def _headers(lines: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in lines.split(b"\r\n")[1:] if b": " in line)


def parse(data: memoryview) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes, memoryview]]:
    """Position, length, headers, HTTP head and payload of each record of one archive."""
    at, whole = 0, bytes(data[:0])
    while at < len(data):
        step = 4096
        while (end := (whole := bytes(data[at : at + step])).find(b"\r\n\r\n")) < 0:
            if at + step >= len(data):
                raise ValueError(f"a record without a header end at {at}")
            step *= 4
        if not whole.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = _headers(whole[:end])
        begin = at + end + 4
        stop = begin + int(headers[b"Content-Length"])
        if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        head = bytes(data[begin : min(stop, begin + 65536)])
        head = head[: head.index(b"\r\n\r\n") + 4]
        yield at, stop - at, headers, head, data[begin + len(head) : stop]
        at = stop + 4


def _captures(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for position, length, headers, head, payload in parse(memoryview(content.as_buffer())):
                kind = headers[b"WARC-Type"].decode()
                named = headers[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != named or len(payload) != size:
                        raise ValueError(f"{path}: the payload at {position} is not what its headers say")
                url = headers.get(b"WARC-Target-URI")
                url = None if url is None else url.decode()
                page, to = (headers.get(k) for k in (b"X-Page-ID", b"X-Refers-To-Page-ID"))
                rows.append((
                    url_key(url), headers[b"WARC-Date"].decode(), None if page is None else int(page), kind, size,
                    named, None if to is None else int(to), url, path, position, length,
                ))
            rows.sort(key=_order)
            names = [c.split()[0] for c in _CAPTURE.split(", ")]
            types = [pa.int64() if c.endswith("long") else pa.string() for c in _CAPTURE.split(", ")]
            columns = zip(*rows) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _order(row: tuple) -> tuple:
    """URL key, time, page_id (null first), file, position."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; those of one file are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(_captures, _CAPTURE)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next winner takes one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _key(self, run: int) -> tuple:
        """Exhausted runs come after all others."""
        if run < len(self.runs) and self.at[run] < len(self.runs[run]):
            return 0, self.runs[run][self.at[run]], run
        return 1, (), run

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._key(a) <= self._key(b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) of every element in order."""
        while not (key := self._key(self.winner))[0]:
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            key, node = self._key(run), (run + self.size) // 2
            while node:
                other = self._key(self.losers[node])
                if other < key:
                    self.losers[node], run, key = run, self.losers[node], other
                node //= 2
            self.winner = run


def _merge(batches):
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return
    keys = list(map(_order, zip(*(c.to_pylist() for c in table.columns))))
    runs: dict[str, list[int]] = {}
    for i, path in enumerate(table.column("path").to_pylist()):
        runs.setdefault(path, []).append(i)
    # A run arrives as its writer left it, in order; what was read in another order is put right here.
    rows = [sorted(run, key=keys.__getitem__) for run in runs.values()]
    tree = LoserTree([[keys[i] for i in run] for run in rows])
    order = np.fromiter((rows[run][at] for run, at in tree), np.int64, len(keys))
    yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)


def capture_history(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time, page_id: ranges of it, each merged from its runs.

    A URL with very many captures is spread over ranges by time and page_id.
    """
    spread = runs.repartitionByRange("url_key", "captured", "page_id", "path", "position")
    return spread.mapInArrow(_merge, _CAPTURE)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and return their capture history."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes)
    return capture_history(settle(capture_runs(spark, path), "runs"))
