"""WARC archives with a two-level capture index (operator 2).

Writing: each task writes its pages as gzip members (one per record) to
archive files in a shared folder. Of pages with equal payloads the one with
the smallest page_id becomes the response, the others revisits that refer to
it and carry no payload.

Index: captures are sorted by reversed-host URL key and page (SURT order) and
dealt by range into index files. An index file holds compressed blocks of
``BLOCK_LINES`` lines and, at its end, a sparse directory with the first key,
place and length of each block. A lookup bisects the list of index files (one
entry each, a few thousand at most by ``files_of``), range-reads the directory,
bisects it, range-reads the blocks that can hold the key, bisects those, and
yields file, offset and length of the records, which are then range-read.

Files are named by task attempt and only those of attempts that succeeded are
ever referred to, so a lost executor leaves at most files that nobody reads.
Executors reach the folder through ``pyarrow.fs`` (file, hdfs, s3 and others).

Null html is an empty payload; null and malformed urls get a key of their raw
text; pages without page_id are revisits of any equal page that has one and
responses otherwise. Pages that share the smallest page_id are all responses.
Repeated rows are repeated records. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import join_hot_key, materialize, scratch

BLOCK_LINES, ARCHIVE_BYTES, LEVEL = 1000, 64 << 20, 3
LEAST_REVISIT_BYTES = 0
DATE = "2025-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_FOOTER = "<QQ"


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return arrow_fs.FileSystem.from_uri(uri)


def safe(url: str | None) -> str:
    """A url that fits a header line and an index line."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str | None) -> str:
    """Reversed-host key: http://a.example.com:80/x?y#z -> com,example,a)/x?y."""
    text = safe(url)
    try:
        u = urlsplit(text)
        host, port = u.hostname, u.port
    except ValueError:
        return text
    if not host:
        return text
    at = "" if port in (None, {"http": 80, "https": 443}.get(u.scheme)) else f":{port}"
    return ",".join(reversed(host.split("."))) + at + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def page_key(url: str | None, page: str | None) -> str:
    """What a capture is sorted and looked up by: url key, then the page."""
    return f"{url_key(url)} {'-' if page is None else page.rjust(20, '0')}"


def _record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(url: str | None, page: str | None, payload: bytes, digest: str, first: str | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page)),
            ("WARC-Date", DATE), ("WARC-Target-URI", safe(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        head.append(("WARC-Page", page))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _record_id(first)), ("WARC-Refers-To-Page", first)]
    block = http if revisit else http + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a gzip member."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    return head, rest[:int(head["Content-Length"])].partition(b"\r\n\r\n")[2]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, least: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, out, size = None, None, 0
        try:
            for b in batches:
                rows = []
                for url, page, html, first, shared in zip(b["url"], b["page"], b["html"], b["first"], b["shared"]):
                    payload = html.encode("utf-8", "replace")
                    revisit = bool(shared) and len(payload) >= least and first is not None and page != first
                    if out is None or size > ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(url, page, payload, base32_sha1(payload), first, revisit)
                    out.write(member)
                    rows.append((page_key(url, page), name, size, len(member)))
                    size += len(member)
                yield pd.DataFrame(rows, columns=["key", "file", "at", "length"])
        finally:
            if out:
                out.close()
    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``; returns the captures (key, file, at, length)."""
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    own = pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # written first, so that Catalyst knows its size: pages meet it by broadcast if it is small, else by a
    # shuffle in which AQE can split a payload that a third of the pages share
    equal = materialize(own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                        .filter(F.col("n") > 1).select(F.col("digest").alias("d"), "first"), "equal_payloads")
    typed = own.join(equal, F.col("digest") == F.col("d"), "left").select(
        "url", F.col("id").cast("string").alias("page"), "html", F.col("first").cast("string").alias("first"),
        F.col("d").isNotNull().alias("shared"))
    return materialize(typed.mapInPandas(_writer(folder, least), "key string, file string, at long, length long"), "captures")


def files_of(captures: int) -> int:
    """Index files for so many captures: about sqrt / 64, 16,384 captures each at least."""
    return max(1, math.ceil(captures / max(16384, 64 * math.sqrt(max(captures, 1)))))


def _indexer(folder: str):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, out, at, directory, lines, last = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush() -> int:
            block = zlib.compress("\n".join(lines).encode(), LEVEL)
            directory.append((lines[0].split("\t", 1)[0], at, len(block)))
            out.write(block)
            lines.clear()
            return at + len(block)

        for b in batches:
            for key, file, place, length in zip(b["key"], b["file"], b["at"], b["length"]):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(f"{key}\t{file}\t{place}\t{length}")
                last = key
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if out:
            if lines:
                at = flush()
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed + struct.pack(_FOOTER, at, len(packed)))
            out.close()
            yield pd.DataFrame([(directory[0][0], last, name)], columns=["low", "high", "file"])
    return index


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Write the index of written ``captures``; returns (lowest key, highest key, file) of each index file."""
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    order = ["key", "file", "at"]
    dealt = captures.repartitionByRange(files_of(captures.count()), *order).sortWithinPartitions(*order)
    rows = materialize(dealt.mapInPandas(_indexer(folder), "low string, high string, file string"), "index_files")
    return sorted(tuple(r) for r in rows.collect())


class IndexFile:
    """Binary search in one index file by range reads."""

    def __init__(self, fs: arrow_fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(_FOOTER)
        at, length = struct.unpack(_FOOTER, self._read(size - tail, tail))
        self.directory = json.loads(zlib.decompress(self._read(at, length)))
        self.first = [d[0] for d in self.directory]
        self.held, self.lines, self.keys = -1, [], []

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _load(self, k: int) -> None:
        if k != self.held:
            self.lines = zlib.decompress(self._read(*self.directory[k][1:])).decode().split("\n")
            self.keys, self.held = [x.split("\t", 1)[0] for x in self.lines], k

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of ``key``."""
        out, k = [], max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.first) and self.first[k] <= key:
            self._load(k)
            for line in self.lines[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)]:
                _, file, at, length = line.split("\t")
                out.append((file, int(at), int(length)))
            k += 1
        return out


def look_up(keys: DataFrame, folder: str, files: list[tuple[str, str, str]]) -> DataFrame:
    """(key, file, at, length) of every capture of the distinct ``keys(key)``."""
    lows, highs = [f[0] for f in files], [f[1] for f in files]

    @F.pandas_udf("array<int>")
    def reach(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k))) for k in key])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        shard, held = None, None
        for b in batches:
            rows = []
            for s, key in zip(b["shard"], b["key"]):
                if s != shard:
                    shard, held = s, IndexFile(fs, f"{root}/{files[s][2]}")
                rows += [(key, *hit) for hit in held.find(key)]
            yield pd.DataFrame(rows, columns=["key", "file", "at", "length"])

    dealt = keys.select("key").distinct().withColumn("shard", F.explode(reach("key")))
    return (dealt.repartition(max(1, len(files)), "shard").sortWithinPartitions("shard", "key")
            .mapInPandas(search, "key string, file string, at long, length long"))


_READ = ("page string, record_type string, payload_digest string, payload_bytes long, refers_to string, "
         "url string, payload binary")


def read_records(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at ``places(file, at, length)``, each checked against its digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        name, held = None, None
        for b in batches:
            rows = []
            for file, at, length in zip(b["file"], b["at"], b["length"]):
                if file != name:
                    name, held = file, fs.open_input_file(f"{root}/{file}")
                held.seek(at)
                head, payload = parse(held.read(length))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{file} at {at}: the payload does not have its digest")
                own = kind == "response"
                rows.append((head.get("WARC-Page"), kind, digest, len(payload) if own else None,
                             head.get("WARC-Refers-To-Page"), head["WARC-Target-URI"],
                             payload if own and with_payload else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])
            out["payload_bytes"] = out["payload_bytes"].astype("Int64")
            yield out

    return places.select("file", "at", "length").repartition("file").sortWithinPartitions("file", "at").mapInPandas(read, _READ)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all ``pages``, index them, look every page up and read its record back."""
    spark, kind = pages.sparkSession, dict(pages.select("page_id").dtypes)["page_id"]
    folder, index = scratch(spark, "archives"), scratch(spark, "capture_index")
    captures = write_archives(pages, folder)
    files = build_index(captures, index)

    @F.pandas_udf("string")
    def key(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([page_key(u, p) for u, p in zip(url, page)], dtype=object)

    wanted = pages.select(key(F.col("url"), F.col("page_id").cast("string")).alias("key"))
    read = materialize(read_records(look_up(wanted, index, files), folder, with_payload=False).drop("payload", "url"), "records")
    again = read.filter(F.col("record_type") == "revisit")
    sizes = read.filter(F.col("record_type") == "response").groupBy(F.col("payload_digest").alias("d")).agg(
        F.max("payload_bytes").alias("full_bytes"))
    shared = materialize(again.groupBy("payload_digest").agg(F.count("*").alias("n"))
                         .join(sizes, F.col("payload_digest") == F.col("d")).select("payload_digest", "n", "full_bytes"), "sizes")
    total = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    resolved = join_hot_key(again, shared, "payload_digest", "n", total).withColumn("payload_bytes", F.col("full_bytes"))
    rows = read.filter(F.col("record_type") == "response").unionByName(resolved.drop("full_bytes"))
    return rows.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))
