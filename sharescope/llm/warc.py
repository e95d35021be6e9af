"""WARC archives and their index: runs sorted per archive, merged into globally ordered capture histories.

Pages are written as records of WARC/1.1 by Spark's own writer, into compressed files of a bounded number of records; of records
with equal payloads one is the response and the others revisit it. Archives are read back record by record from a stream.
Each archive gives a run of captures sorted by URL key and time, once; runs are cut at common split points, their pieces stay in order, and every range
is merged from its pieces through a loser tree. There is a range for every `RANGE` captures, whatever the cluster. Splits are taken from a bounded sample of whole keys (URL key, time and page), so
a URL with very many captures is split like any other. The sizes of the ranges then give every capture its place in the global order.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import store

RECORDS = 4096
RANGE = 32768
BREAK = "\r\n"
SAMPLE = 64
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def base32(sha1: Column) -> Column:
    """Base 32 of 40 hexadecimal digits."""
    five = lambda i: F.conv(F.substring(sha1, F.lit(1) + F.lit(5) * F.floor(i / 4).cast("int"), F.lit(5)), 16, 10).cast("int")
    letter = lambda i: F.substring(F.lit(_ALPHABET), F.call_function("shiftright", five(i), F.lit(15) - F.lit(5) * (i % 4)).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def url_key(url: Column) -> Column:
    """The URL with its host's labels reversed, so that a site's captures lie together."""
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), "\\.")), ","), F.lit(")"), rest)


def write_archives(pages: DataFrame, folder: str, page_id: str, url: str, html: str, date: Column, least: int, records: int) -> None:
    """One record a page. Payloads of `least` bytes and more are stored once, with the largest page id of equal ones."""
    payload = F.coalesce(F.col(html), F.lit(""))
    taken = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), date.alias("date")).withColumns(
        {"sha": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    narrow = taken.select("id", "sha", "bytes").distinct()
    keeper = narrow.filter(F.col("bytes") >= least).groupBy("sha").agg(F.max("id").alias("keeper"))
    roles = narrow.join(keeper, "sha", "left").select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "keeper")
    rows = taken.join(roles, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    again = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    fields = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))), F.concat(F.lit("WARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x1F\\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.upper("sha"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("keeper")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # A record ends in two line breaks, which is what the writer puts between rows.
    rows.select(F.concat(fields, F.lit(BREAK * 2), block).alias("value")).write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", records).text(folder, compression="gzip")


class Stream:
    """Bytes of a gzip file, a piece at a time."""

    def __init__(self, packed: bytes, step: int = 1 << 18):
        self.packed, self.step, self.at, self.held, self.done = memoryview(packed), step, 0, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        while self.at < len(self.packed):
            part = self.inflate.decompress(self.packed[self.at:self.at + self.step])
            self.at += self.step
            self.held += part
            if part:
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is dropped."""
        since = 0
        while (found := self.held.find(mark, since)) < 0:
            since = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))[:-len(mark)]

    def take(self, count: int) -> bytes:
        while len(self.held) < count and self.more():
            pass
        part = bytes(self.held[:count])
        del self.held[:count]
        self.done += len(part)
        return part


def records_of(packed: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of every record of a compressed archive."""
    stream = Stream(packed)
    while True:
        at = stream.done
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split(BREAK)[1:])
        yield at, fields, stream.take(int(fields["Content-Length"]))
        stream.take(4)


def capture(at: int, fields: dict[str, str], block: bytes) -> dict:
    """One line of the index; a revisit's payload is the one it refers to, whose size its HTTP header has kept."""
    head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if name in (None, "<urn:page:none>") else int(name[len("<urn:page:"):-1])
    again = fields["WARC-Type"] == "revisit"
    size = int(head.rsplit(b"Content-Length: ", 1)[1]) if again else len(payload)
    digest = fields["WARC-Payload-Digest"][len("sha1:"):] if again else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"url": fields["WARC-Target-URI"], "captured": fields["WARC-Date"], "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "at": at}


def order_key(row: dict) -> tuple:
    return row["url_key"], row["captured"], -1 if row["page_id"] is None else row["page_id"]


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list[list[dict]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        self.heads = [order_key(r[0]) if r else None for r in runs]
        for run in range(len(runs)):
            self._replay(run)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, run: int) -> None:
        node = (run + self.size) // 2
        while node:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = run
                return
            if self._before(held, run):
                self.losers[node], run = run, held
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[dict]:
        while self.runs and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = order_key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            self._replay(run)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: Column | None = None, least: int = 0,
             folder: str | None = None, records: int = RECORDS) -> DataFrame:
    """Archive all pages and give the merged index: `CAPTURE` and `place`, which counts the captures in global order from 1.

    The order is by URL key, time and page id; a null id comes first, and equal captures follow each other in any order. A null payload is empty, a null URL is
    an empty one. Rows that repeat a page id with an equal payload are all
    written as responses; a null id never is one another refers to. An empty table gives an empty index. Payloads of any length are written whole; an
    archive is one task's to read, so with payloads of many megabytes choose fewer `records`, so that a compressed archive stays below 2 GB. The archives stay
    in `folder`, by default a new one below the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/sharescope-warc-{uuid.uuid4().hex}"
    date = date if date is not None else F.timestamp_seconds(F.coalesce(F.col(page_id).cast("long"), F.lit(0)))
    write_archives(pages, folder, page_id, url, html, date, least, records)
    whole = F.concat_ws("\t", url_key(F.coalesce(F.col(url), F.lit(""))), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lpad(F.coalesce(F.col(page_id).cast("long"), F.lit(-1)).cast("string"), 20, " "))
    # As many ranges as captures need, at the keys of a sample that is drawn by hash.
    ranges = -(-pages.count() // RANGE) or 1
    sample = sorted(r[0] for r in pages.select(whole.alias("k"), F.xxhash64(page_id, url).alias("h")).orderBy("h", "k").limit(SAMPLE * ranges).collect()) if ranges > 1 else []
    splits = sorted(set(sample[SAMPLE::SAMPLE]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, packed = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                rows = [capture(*r) | {"archive": path} for r in records_of(packed)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A long archive may come in several batches, each of which is a run.
            runs: dict[str, list[dict]] = {}
            for row in batch.to_pylist():
                runs.setdefault(row["archive"], []).append(row)
            pieces: list[dict] = []
            for run in runs.values():
                run.sort(key=order_key)
                held: dict[int, list[dict]] = {}
                for row in run:
                    held.setdefault(bisect_right(splits, "\t".join((row["url_key"], row["captured"], f"{-1 if row['page_id'] is None else row['page_id']:>20}"))), []).append(row)
                pieces += [{"range": r, "piece": rows} for r, rows in held.items()]
            if pieces:
                yield pa.RecordBatch.from_pylist(pieces, schema=_PIECES)

    def merge(group: pa.Table) -> pa.Table:
        merged = list(LoserTree(group["piece"].to_pylist()))
        at = group["range"][0].as_py()
        return pa.Table.from_pylist([{**row, "range": at, "rank": i + 1} for i, row in enumerate(merged)], schema=_MERGED)

    archives = spark.read.format("binaryFile").load(folder).filter(F.col("path").endswith(".gz")).select("path", "content")
    found = archives.mapInArrow(read, "url string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long")
    keyed = found.withColumn("url_key", url_key(F.col("url"))).drop("url")
    pieces = keyed.select(*[f.split()[0] for f in CAPTURE.split(", ")]).mapInArrow(cut, f"range int, piece array<struct<{CAPTURE.replace(' ', ':').replace(',:', ', ')}>>")
    merged = store(pieces.groupBy("range").applyInArrow(merge, f"{CAPTURE}, range int, rank long"))
    # One row a range: how many captures come before it.
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return merged.join(before, "range").select(*[f.split()[0] for f in CAPTURE.split(", ")], (F.col("before") + F.col("rank")).alias("place"))


_CAPTURE = [(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in CAPTURE.split(", "))]
_READ = pa.schema([("url", pa.string()), *_CAPTURE[1:]])
_PIECES = pa.schema([("range", pa.int32()), ("piece", pa.list_(pa.struct(_CAPTURE)))])
_MERGED = pa.schema([*_CAPTURE, ("range", pa.int32()), ("rank", pa.int64())])


def archive_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back, and its place in the history."""
    return captures(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place")
