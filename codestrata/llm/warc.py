"""WARC archives with a two-level capture index.

Writing. Records are single gzip members in files in the shared folder. Of
records with equal payloads (SHA-1) of at least ``revisit_from`` bytes the one
with the largest page id is the response; the others are revisits that name it.
A task writes files of its own under a fresh name and returns one row a record;
the written table of these rows is the commit, so files of lost or repeated
attempts are never read.

Index. Captures are sorted by their key: the host's labels reversed, then the
rest of the URL, then the page id. Level 1: runs of ``BLOCK`` lines as
compressed blocks, a file for each range of keys. Level 2: beside each file a
sparse directory of its blocks' first keys and places. A look-up binary-searches
the ranges' first keys (one a task of the sort), then the range's directory,
reads that block's bytes, searches its lines and reads the record's bytes.

The files are read and written on the executors by ``pyarrow.fs`` from the
shared folder's URI; tables come through Spark alone.

Defined cases: null html is the empty payload; null URLs have the empty key;
payloads whose largest page id is null are all responses; rows equal in id and
payload are all responses or all revisits and each keeps its own record (their
record ids, made from the page id, are equal); an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.arrow import column, map_rows, utf8
from codestrata.llm.scratch import Scratch

BLOCK = 256
FILE_BYTES = 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_SCHEMA = "key string, file string, at long, size long, payload_bytes long"


def capture_key(url: Column, page_id: Column) -> Column:
    """``org,example,www)/path?query`` and the page id in twenty digits, in an order that bytes keep."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    host = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    turned = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    number = F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit(""))
    return F.concat(F.regexp_replace(F.concat(turned, F.lit(")"), rest), "\\s", "%20"), F.lit(" "), number)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: object) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_urn(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, names in lower case, and its payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Range reads through a few files kept open."""

    def __init__(self, limit: int = 8):
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.limit = limit

    def read(self, uri: str, at: int, size: int) -> bytes:
        file = self.open.pop(uri, None)
        if file is None:
            system, path = pafs.FileSystem.from_uri(uri)
            file = system.open_input_file(path)
        self.open[uri] = file
        if len(self.open) > self.limit:
            self.open.popitem(last=False)[1].close()
        return file.read_at(size, at)

    def all(self, uri: str) -> bytes:
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as file:
            return file.read()


class Archive:
    """Writes pages to an archive and reads them back through its index."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.root = scratch.root

    def write(self, pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
        """Shuffles each page once, to its payload's digest (a plain join, split where a payload is hot)."""
        root = self.root
        rows = pages.select(pages[id_column].alias("i"), pages[url_column].alias("u"), F.coalesce(pages[html_column], F.lit("")).alias("t"))
        rows = rows.select("i", "u", "t", capture_key(F.col("u"), F.col("i")).alias("key"), F.sha1("t").alias("d"))
        largest = self.scratch.table(rows.where(F.octet_length("t") >= revisit_from).groupBy("d").agg(F.max("i").alias("kept"), F.count("*").alias("n")).where("n > 1").select("d", "kept"), "largest")
        joined = rows.join(largest, "d", "left").select("i", "u", "t", "key", F.when(F.coalesce(F.col("kept") != F.col("i"), F.col("kept").isNotNull()), F.col("kept")).alias("refers_to"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            out, name, at = None, "", 0
            for batch in batches:
                made: dict[str, list] = {k: [] for k in ("key", "file", "at", "size", "payload_bytes")}
                texts = utf8(column(batch, "t"))
                for i, u, key, refers, payload in zip(*(column(batch, c).to_pylist() for c in ("i", "u", "key", "refers_to")), texts, strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{root}/archive/{uuid.uuid4().hex}.warc.gz", 0
                        system, path = pafs.FileSystem.from_uri(name)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    packed = _gzip(record(i, u, payload, base32_sha1(payload), refers, date))
                    out.write(packed)
                    for k, v in (("key", key), ("file", name), ("at", at), ("size", len(packed)), ("payload_bytes", len(payload))):
                        made[k].append(v)
                    at += len(packed)
                yield made
            if out is not None:
                out.close()

        captures = self.scratch.table(map_rows(joined, CAPTURE_SCHEMA, run), "captures")
        self._index(captures)

    def _ranges(self) -> int:
        """Named where rows are few and small but cost much to read, since adaptive execution would put them into one task."""
        return max(1, int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions")))

    def _index(self, captures: DataFrame) -> None:
        """Sorts the captures (not the pages) and writes blocks and directories, one pair of files a range."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            out, name, at = None, "", 0
            directory: list[str] = []
            keys: list[str] = []
            lines: list[str] = []

            def flush() -> None:
                nonlocal at
                packed = _gzip("\n".join(lines).encode())
                out.write(packed)
                directory.append(f"{keys[0]}\t{at}\t{len(packed)}")
                at += len(packed)
                keys.clear()
                lines.clear()

            first = ""
            for batch in batches:
                for key, file, place, size, n in zip(*(column(batch, c).to_pylist() for c in ("key", "file", "at", "size", "payload_bytes")), strict=True):
                    if out is None:
                        first = key
                        name = f"{root}/index/{uuid.uuid4().hex}"
                        system, path = pafs.FileSystem.from_uri(name)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(f"{path}.blocks", compression=None)
                    if len(lines) >= BLOCK:
                        flush()
                    keys.append(key)
                    lines.append(f"{key}\t" + json.dumps([file, place, size, n]))
            if out is not None:
                flush()
                out.close()
                with system.open_output_stream(f"{path}.directory", compression=None) as level2:
                    level2.write("\n".join(directory).encode())
                yield {"first": [first], "name": [name]}

        ordered = captures.repartitionByRange(self._ranges(), "key").sortWithinPartitions("key", "file", "at")
        self.scratch.table(map_rows(ordered, "first string, name string", run), "ranges")

    def captures(self, keys: DataFrame, key_column: str = "key") -> DataFrame:
        """Looks keys up: one row a capture, from the record itself.

        (key, page_id, record_type, payload_digest, payload_bytes, refers_to, payload).
        A response's digest is computed from the payload that was read.
        """
        # One row a range of keys: as many as the sort had tasks.
        ranges = sorted((r["first"], r["name"]) for r in self.scratch.spark.read.schema("first string, name string").parquet(self.scratch.path("ranges")).collect())
        firsts = [r[0] for r in ranges]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            files = _Files()
            loaded: tuple[int, list[str], list[tuple[int, int]]] = (-1, [], [])
            block: tuple[tuple[int, int], list[str], list[str]] = ((-1, -1), [], [])
            names = ("key", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
            for batch in batches:
                made: dict[str, list] = {k: [] for k in names}
                size = 0
                for key in column(batch, "key").to_pylist():
                    # Equal keys may cross a border: begin before the first range, and block, that starts with the key.
                    r = max(bisect.bisect_left(firsts, key) - 1, 0)
                    while r < len(firsts) and (firsts[r] <= key):
                        if loaded[0] != r:
                            entries = [x.rsplit("\t", 2) for x in files.all(f"{ranges[r][1]}.directory").decode().split("\n")]
                            loaded = (r, [x[0] for x in entries], [(int(x[1]), int(x[2])) for x in entries])
                        b = max(bisect.bisect_left(loaded[1], key) - 1, 0)
                        while b < len(loaded[1]) and loaded[1][b] <= key:
                            if block[0] != (r, b):
                                text = zlib.decompress(files.read(f"{ranges[r][1]}.blocks", *loaded[2][b]), 31).decode()
                                lines = [x.rsplit("\t", 1) for x in text.split("\n")]
                                block = ((r, b), [x[0] for x in lines], [x[1] for x in lines])
                            for k in range(bisect.bisect_left(block[1], key), bisect.bisect_right(block[1], key)):
                                file, at, length, n = json.loads(block[2][k])
                                headers, payload = parse_record(zlib.decompress(files.read(file, at, length), 31))
                                revisit = headers["warc-type"] == "revisit"
                                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                                if not revisit and base32_sha1(payload) != digest:
                                    raise ValueError(f"{file} at {at}: the payload differs from its digest")
                                page = headers["warc-record-id"].rpartition(":")[2].rstrip(">")
                                refers = headers.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
                                for name, value in zip(names, (key, int(page) if page else None, headers["warc-type"], digest, n if revisit else len(payload), int(refers) if refers else None, payload), strict=True):
                                    made[name].append(value)
                                size += len(payload)
                            b += 1
                        r += 1
                    if size > 4 << 20:
                        yield made
                        made, size = {k: [] for k in names}, 0
                yield made

        ordered = keys.select(keys[key_column].alias("key")).distinct().repartitionByRange(self._ranges(), "key").sortWithinPartitions("key")
        return map_rows(ordered, "key string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary", run)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archives all pages, then reads every one back through the index."""
    archive = Archive(Scratch(pages.sparkSession, "warc"))
    archive.write(pages)
    return archive.captures(pages.select(capture_key(pages["url"], pages["page_id"]).alias("key")))
