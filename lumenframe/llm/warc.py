"""WARC archives with a two-level capture index.

Writing: records go to compressed archives, one gzip member for each record, in
the order of their reversed-host key. Beside each archive lies its index: capture
lines, sorted by key, in compressed blocks (level two), and a sparse directory
with the first key and the place of each block (level one). A catalog of the
same form lists all archives of a folder by their first capture. Reading: the
catalog and the archive's directory are binary-searched, one block is read by
range and searched, and the record is read by range from the archive.

Captures of one URL are told apart by their number, which is that of the row in
the table that was written. Tables are dealt out by ranges of (key, number), so
the archives of a folder cover ranges that do not overlap, also where one URL
holds a large share of all rows.

Files are written under a fresh name and only then announced as rows, so a task
that runs twice leaves an unused file and nothing wrong. They are written
through pyarrow's file systems, so the shared folder may be any store it knows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import byte_rows, cut, shared_dir, small

BLOCK_LINES = 512
ARCHIVE_MB = 64
BROADCAST_DIGESTS = 100_000  # 48 bytes each; beyond, pages go by digest, and the planner may split hot ones
_URL = r"(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"


def reversed_key(url: Column) -> Column:
    """SURT-like key: host labels from the right, then port, path and query. What is no URL is its own key, null that of ''."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    key = F.concat(host, part(2), F.lit(")"), F.when(part(3) == "", "/").otherwise(part(3)))
    return F.coalesce(F.when(url.rlike(_URL), key).otherwise(url), F.lit(""))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, response_id: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    kind = "response" if response_id is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if response_id is None else b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if response_id is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response_id}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    ident = re.search(r"<urn:page:(-?\d*)>", fields["WARC-Record-ID"])[1]
    refers = re.search(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return {
        "page_id": int(ident) if ident else None, "url": json.loads(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": length, "refers_to": int(refers[1]) if refers else None, "payload": payload,
    }


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


Key = tuple[str, int]  # reversed-host key and number of a capture


def write_blocks(store: fs.FileSystem, base: str, lines: Iterator[tuple[Key, str]]) -> None:
    """A sorted list of (key, rest) in two levels: compressed blocks of lines, and a directory of their first keys and places."""
    directory, at = [], 0
    spelt = lambda key, rest: f"{json.dumps(key[0])}\t{key[1]}\t{rest}"
    with store.open_output_stream(f"{base}.cdx.gz", compression=None) as out:
        while part := list(itertools.islice(lines, BLOCK_LINES)):
            data = _member("\n".join(spelt(*x) for x in part).encode())
            out.write(data)
            directory.append(spelt(part[0][0], f"{at}\t{len(data)}"))
            at += len(data)
    with store.open_output_stream(f"{base}.idx", compression=None) as out:
        out.write("\n".join(directory).encode())


def _parsed(data: bytes) -> list[tuple[Key, list[str]]]:
    split = [line.split("\t") for line in data.decode().split("\n") if line]
    return [((json.loads(x[0]), int(x[1])), x[2:]) for x in split]


class Blocks:
    """Reads what write_blocks wrote: the directory is held, one block at a time is read by range."""

    def __init__(self, store: fs.FileSystem, base: str):
        with store.open_input_stream(f"{base}.idx", compression=None) as f:
            self.directory = _parsed(f.read())
        self.first = [key for key, _ in self.directory]
        self.file = store.open_input_file(f"{base}.cdx.gz")
        self.block, self.keys, self.lines = -1, [], []

    def load(self, k: int) -> None:
        if k != self.block:
            offset, length = map(int, self.directory[k][1])
            self.lines = _parsed(zlib.decompress(self.file.read_at(length, offset), 31))
            self.block, self.keys = k, [key for key, _ in self.lines]

    def last_up_to(self, key: Key) -> tuple[Key, list[str]] | None:
        """The last line whose key is `key` or smaller."""
        k = bisect.bisect_right(self.first, key) - 1
        if k < 0:
            return None
        self.load(k)
        return self.lines[bisect.bisect_right(self.keys, key) - 1]

    def beginning(self, key: Key) -> Iterator[tuple[Key, list[str]]]:
        """Lines from the first one at `key` or larger."""
        k = max(0, bisect.bisect_right(self.first, key) - 1)
        for block in range(k, len(self.first)):
            self.load(block)
            lines = self.lines  # another search may load another block
            yield from lines[bisect.bisect_left(self.keys, key) if block == k else 0 :]

    def close(self) -> None:
        self.file.close()


class ArchiveWriter:
    """One archive and its index. Records have to come by ascending (key, number)."""

    def __init__(self, folder: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.base = f"{path}/{uuid.uuid4().hex}"
        self.name = self.base.rsplit("/", 1)[1]
        self.out, self.at, self.lines = self.store.open_output_stream(f"{self.base}.warc.gz", compression=None), 0, []

    def add(self, key: Key, raw: bytes) -> None:
        data = _member(raw)
        self.out.write(data)
        self.lines.append((key, f"{self.at}\t{len(data)}"))
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        write_blocks(self.store, self.base, iter(self.lines))


class Collection:
    """Looks captures up over all archives of a folder. Holds one archive open."""

    def __init__(self, folder: str, catalog: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.catalog = Blocks(self.store, f"{self.path}/{catalog}")
        self.name, self.index, self.archive = "", None, None

    def open(self, name: str) -> None:
        if name != self.name:
            self.shut()
            self.index = Blocks(self.store, f"{self.path}/{name}")
            self.archive = self.store.open_input_file(f"{self.path}/{name}.warc.gz")
            self.name = name

    def shut(self) -> None:
        if self.index:
            self.index.close()
            self.archive.close()
            self.index, self.name = None, ""

    def record(self, line: list[str]) -> dict:
        offset, length = map(int, line)
        return parse(zlib.decompress(self.archive.read_at(length, offset), 31))

    def find(self, key: Key) -> dict | None:
        """The record of one capture."""
        if (entry := self.catalog.last_up_to(key)) is None:
            return None
        self.open(entry[1][0])
        found = self.index.last_up_to(key)
        return self.record(found[1]) if found and found[0] == key else None

    def captures(self, key: str) -> Iterator[dict]:
        """The records of all captures of a key, by number; they may go on over several archives."""
        least = (key, -1)
        before = self.catalog.last_up_to(least)
        for first, (name,) in itertools.chain([before] if before else [], self.catalog.beginning(least)):
            if first[0] > key:
                return
            self.open(name)
            for at, line in self.index.beginning(least):
                if at[0] != key:
                    break
                yield self.record(line)

    def close(self) -> None:
        self.shut()
        self.catalog.close()


def _write(folder: str):
    """Sorted (key, number, page_id, url, html, response_id) -> (key, number, archive) of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []

        def flush() -> pa.RecordBatch:
            writer.close()
            keys, numbers = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), pa.array([writer.name] * len(done), pa.string())], names=["key", "number", "archive"])

        for batch in small(batches):
            keys, numbers, ids, urls, pages, refs = batch.columns
            for key, number, page_id, url, payload, ref in zip(keys.to_pylist(), numbers.to_pylist(), ids.to_pylist(), urls.to_pylist(), byte_rows(pages), refs.to_pylist(), strict=True):
                if writer and writer.at > ARCHIVE_MB << 20:
                    yield flush()
                    writer, done = None, []
                writer = writer or ArchiveWriter(folder)
                writer.add((key, number), record(page_id, url, payload or b"", digest(payload or b""), ref))
                done.append((key, number))
        if writer:
            yield flush()

    return run


def _catalog(folder: str):
    """Sorted (key, number, archive), one for each archive -> the catalog's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"catalog-{uuid.uuid4().hex}"
        write_blocks(store, f"{path}/{name}", (((k, n), a) for batch in batches for k, n, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return run


RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
DIGESTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _records(found: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], _KINDS[t]) for n, t in fields], names=[n for n, _ in fields])


@dataclass(frozen=True)
class Archives:
    """Written archives: their folder, the catalog's name, and captures (key, number, archive) as a written table."""

    folder: str
    catalog: str
    captures: DataFrame


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> Archives:
    """Write a record for each row of pages (page_id, url, html) into a folder of its own.

    Of records with equal payloads of at least least_bytes bytes the one with the
    largest page_id is the response and others revisit it; the rest are responses.
    A null html is an empty payload; rows that repeat the response's page_id and
    payload are responses too; a null page_id never stands for others. Rows that
    share URL and page_id are captures with numbers of their own, whatever their
    html. An empty table gives an empty catalog. Other columns are not read. pages
    has to give the same rows in the same order when a task is repeated, as files do.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), reversed_key(url).alias("key"), F.monotonically_increasing_id().alias("number"))
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    # payloads that occur again; up to BROADCAST_DIGESTS of them reach every task, so that no page moves for this join; beyond, both sides meet by digest with the same result
    again = rows.where(long_enough).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 and response is not null").select("sha", "response")
    again = cut(again, "copies")
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    rows = rows.join(again, "sha", "left").withColumn("ref", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")))
    dealt = rows.select("key", "number", "page_id", "url", "html", "ref").repartitionByRange("key", "number").sortWithinPartitions("key", "number")
    captures = cut(dealt.mapInArrow(_write(folder), "key string, number long, archive string"), "captures")
    first = captures.groupBy("archive").agg(F.min(F.struct("key", "number")).alias("first")).select("first.key", "first.number", "archive")
    catalog = first.repartition(1).sortWithinPartitions("key", "number").mapInArrow(_catalog(folder), "name string").first()
    return Archives(folder, catalog["name"], captures)


def read_archives(archives: Archives, schema: str = RECORD) -> DataFrame:
    """The record of each capture, looked up by its key and number over all archives; payloads are checked against their digests."""
    folder, catalog = archives.folder, archives.catalog

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Collection(folder, catalog)
        for batch in small(batches, 256):
            out = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = reader.find(key)
                if found is None:
                    raise ValueError(f"no capture {key} in {folder}")
                if found["record_type"] == "response" and (digest(found["payload"]) != found["payload_digest"] or len(found["payload"]) != found["payload_bytes"]):
                    raise ValueError(f"damaged record {key} in {folder}")
                out.append(found)
            yield _records(out, schema)
        reader.close()

    return archives.captures.select("key", "number").mapInArrow(run, schema)


def lookup(archives: Archives, urls: DataFrame) -> DataFrame:
    """The records of all captures of each URL (column url), over all archives. A URL without captures gives none, a repeated one repeats them."""
    folder, catalog = archives.folder, archives.catalog

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Collection(folder, catalog)
        for batch in batches:
            for url, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (r for r in reader.captures(key) if r["url"] == url)  # other schemes, users and fragments share the key
                while part := list(itertools.islice(found, 256)):
                    yield _records(part, RECORD)
        reader.close()

    wanted = urls.select(F.col("url").cast("string").alias("url"))
    return wanted.withColumn("key", reversed_key(F.col("url"))).sortWithinPartitions("key").mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back: one row for each row of pages. Cases: see write_archives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), DIGESTS)
