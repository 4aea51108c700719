"""WARC archives with a two-level capture index.

Tasks write archives into the shared folder, one gzip member a record, and hand on where each record lies. Captures are then sorted by
reversed-host URL key and page_id; every task of that sort writes its lines as compressed blocks of BLOCK lines into one index file,
and beside it a sparse directory with the first key, offset and length of each block. A lookup finds the index file among the files'
first keys (as many as the sort had tasks), then the block in that file's directory, both by binary search, reads the block's range,
finds the line by binary search and reads the record's range. Lookups are sorted like the index, so each task reads few blocks, once.

Files carry a name of their own for each attempt, and only what successful tasks hand on is indexed: a lost executor leaves stray
files, never wrong entries.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, LOOKUPS = 3_000, 8_192
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
OPEN_FILES, OPEN_BLOCKS = 32, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """host,reversed)/path?query in lower-case host; no scheme, user, port 80/443 or fragment; white space and control characters as %20."""
    whole = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"#.*$", "")
    authority = F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":(?:80|443)?$", "")
    rest = F.regexp_replace(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.regexp_replace(key, r"[\s\p{Cntrl}]", "%20")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _line(value: object) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", str(value))


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record whose HTTP header still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Capture:
    page_id: int
    record_type: str
    refers_to: int | None
    payload: bytes | None  # None for a revisit
    payload_bytes: int
    payload_digest: str


def _number(value: str) -> int:
    return int(value.rpartition(":")[2].rstrip(">"))


def parse(raw: bytes) -> Capture:
    """A record from its gzip member. A response's payload is checked against its digest."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        digest, expected = hashlib.sha256(payload).hexdigest(), digest
        if digest != expected or len(payload) != size:
            raise ValueError(f"damaged record of page {fields['WARC-Record-ID']}")
    return Capture(_number(fields["WARC-Record-ID"]), fields["WARC-Type"], _number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload, size, digest)


def _archiver(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, path = _place(folder)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    out = place.open_output_stream(f"{path}/{name}", compression=None)
                where = []
                for page_id, url, html, digest, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"], strict=True):
                    member = gzip.compress(record(page_id, url, html.encode("utf-8", "replace"), digest, None if pd.isna(refers_to) else int(refers_to)), 6, mtime=0)
                    out.write(member)
                    where.append((at, len(member)))
                    at += len(member)
                yield pd.DataFrame({"key": batch["key"], "page_id": batch["page_id"], "file": name, "offset": [w[0] for w in where], "length": [w[1] for w in where]})
        finally:
            if out is not None:
                out.close()

    return write


def _indexer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, path = _place(folder)
        name = f"captures-{uuid.uuid4().hex}"
        out, at, lines, directory = None, 0, [], []

        def flush():
            nonlocal at, out
            if out is None:
                out = place.open_output_stream(f"{path}/{name}.cdx.gz", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            key, page_id = lines[0].split(" ", 2)[:2]
            directory.append([key, int(page_id), at, len(block)])
            at += len(block)
            lines.clear()

        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    lines.append(f"{row.key} {row.page_id} {row.file} {row.offset} {row.length}")
                    if len(lines) == BLOCK:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        if directory:
            with place.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
                f.write("\n".join(map(json.dumps, directory)).encode())
            yield pd.DataFrame({"key": [directory[0][0]], "page_id": [directory[0][1]], "name": [name]})

    return write


class Reader:
    """Looks captures up in the index and reads their records. tops: first key, first page_id and name of each index file, sorted."""

    def __init__(self, folder: str, tops: list[tuple[str, int, str]]):
        self.place, self.path = _place(folder)
        self.tops, self.first = tops, [(k, p) for k, p, _ in tops]
        self.directories: OrderedDict[str, tuple[list[tuple[str, int]], list]] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], tuple[list[tuple[str, int]], list[str]]] = OrderedDict()
        self.files: OrderedDict[str, object] = OrderedDict()

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.place.open_input_file(f"{self.path}/{name}")
            if len(self.files) > OPEN_FILES:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        self.files[name].seek(offset)
        return self.files[name].read(length)

    def _directory(self, name: str):
        if name not in self.directories:
            with self.place.open_input_stream(f"{self.path}/{name}.directory", compression=None) as f:
                rows = [json.loads(line) for line in f.read().decode().split("\n")]
            self.directories[name] = [(r[0], r[1]) for r in rows], rows
            if len(self.directories) > 2:
                self.directories.popitem(last=False)
        return self.directories[name]

    def _block(self, name: str, number: int):
        if (name, number) not in self.blocks:
            _, _, offset, length = self._directory(name)[1][number]
            lines = zlib.decompress(self._range(f"{name}.cdx.gz", offset, length)).decode().split("\n")
            keys = [(k, int(p)) for k, p, _ in (line.split(" ", 2) for line in lines)]
            self.blocks[name, number] = keys, lines
            if len(self.blocks) > OPEN_BLOCKS:
                self.blocks.popitem(last=False)
        return self.blocks[name, number]

    def find(self, key: str, page_id: int) -> tuple[str, int, int] | None:
        """Archive, offset and length of one capture."""
        top = bisect.bisect_right(self.first, (key, page_id)) - 1
        if top < 0:
            return None
        name = self.tops[top][2]
        number = bisect.bisect_right(self._directory(name)[0], (key, page_id)) - 1
        keys, lines = self._block(name, number)
        line = bisect.bisect_left(keys, (key, page_id))
        if line == len(keys) or keys[line] != (key, page_id):
            return None
        _, _, file, offset, length = lines[line].split(" ")
        return file, int(offset), int(length)

    def captures(self, key: str) -> Iterator[int]:
        """The page_ids of a URL key, in order."""
        start = max(0, bisect.bisect_left(self.first, (key, -(2**63))) - 1)
        for _, _, name in self.tops[start:]:
            firsts = self._directory(name)[0]
            for number in range(max(0, bisect.bisect_left(firsts, (key, -(2**63))) - 1), len(firsts)):
                keys, _ = self._block(name, number)
                for at in range(bisect.bisect_left(keys, (key, -(2**63))), len(keys)):
                    if keys[at][0] != key:
                        return
                    yield keys[at][1]

    def read(self, key: str, page_id: int) -> Capture | None:
        where = self.find(key, page_id)
        return parse(self._range(*where)) if where else None


@dataclass
class Archive:
    """A folder of archives and index files, and the index files' first keys."""

    folder: str
    tops: list[tuple[str, int, str]]

    def reader(self) -> Reader:
        return Reader(self.folder, self.tops)


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Archive pages(page_id, url, html) and index the captures.

    Null url and html count as empty; rows with a null page_id are left out, as no record could name them. Equal payloads of at least
    LEAST_REVISIT bytes are stored once, under the smallest page_id; a repeated page_id gives a record each time, but the index finds one.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or common.new_folder(spark, "warc")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html")).where("page_id is not null")
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("key", url_key(F.col("url")))
    firsts = base.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = common.salted_left_join(base, firsts, ["digest"], "page_id").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first")))
    stored = marked.select("page_id", "url", "html", "digest", "key", "refers_to").mapInPandas(_archiver(folder), "key string, page_id long, file string, offset long, length long")
    stored = common.written(stored, "captures")
    ordered = stored.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    tops = ordered.mapInPandas(_indexer(folder), "key string, page_id long, name string").collect()  # a row for each index file
    return Archive(folder, sorted((r[0], r[1], r[2]) for r in tops))


def read_back(pages: DataFrame, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page found in the archive under its URL."""
    spark: SparkSession = pages.sparkSession
    held = spark.sparkContext.broadcast(archive)  # as many rows as index files

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = held.value.reader()
        for batch in batches:
            found = [c for c in map(reader.read, batch["key"], batch["page_id"]) if c is not None]
            out = pd.DataFrame([(c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in found], columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "int64", "payload_bytes": "int64", "refers_to": "Int64"})

    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id")).where("page_id is not null")
    # rows are tiny and reads aren't, so partitions follow the number of records, not of bytes
    wanted = wanted.repartitionByRange(max(1, -(-wanted.count() // LOOKUPS)), "key", "page_id").sortWithinPartitions("key", "page_id")
    return wanted.mapInPandas(look_up, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return read_back(pages, write_archive(pages))


ORACLE = f"""
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
