"""WARC records inside ZIP packages, read by ranges and never extracted.

The directory at the end of a package (ZIP64 too) says where its stored members lie. The index members say where each record lies in
an archive member, so that tasks fetch just those ranges, neighbouring ones together. What an index leaves out, or
an archive member without one, is searched for records in pieces. pages_to_packages() writes such packages."""

from __future__ import annotations

import codecs
import gzip
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

PACKAGE_BYTES, SPAN_BYTES, CHUNK = 16 << 20, 4 << 20, 1 << 20
#: Compressed bytes for one task to fetch and parse.
TASK_BYTES = 32 << 20
ARCHIVE, INDEX = re.compile(r"(^|/)archive/[^/]+\.warc(\.gz)?$"), re.compile(r"(^|/)indexes/[^/]+\.cdxj?(\.gz)?$")
RECORD = "package string, url string, record_id string, date string, status int, mime string, body string, error string"
Read = Callable[[int, int], bytes]


@dataclass
class Member:
    name: str
    method: int
    encrypted: bool
    size: int
    packed: int
    header: int

    def start(self, read: Read) -> int:
        """Where its bytes begin: after the local header, whose lengths may differ from the directory's."""
        h = read(self.header, 30)
        if h[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {self.name}")
        name, extra = struct.unpack("<HH", h[26:30])
        return self.header + 30 + name + extra


def directory(read: Read, size: int) -> list[Member]:
    """The members of a package, from the central directory, ZIP64 or not."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] == len(tail):
            break
    count, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if count == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        locator = read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\6\7":
            where = struct.unpack("<Q", locator[8:16])[0]
            record = read(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, begin = struct.unpack("<QQQ", record[32:56])
    data, out, p = read(begin, length), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[p + 8 : p + 12])
        packed, full, n, m, k, disk = struct.unpack("<IIHHHH", data[p + 20 : p + 36])
        header = struct.unpack("<I", data[p + 42 : p + 46])[0]
        name = data[p + 46 : p + 46 + n].decode("utf8" if flags & 0x800 else "cp437")
        extra, q = data[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, size_ = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:
                value, v = extra[q + 4 : q + 4 + size_], 0
                # only what is all ones in the entry stands here, in this order
                if full == 0xFFFFFFFF:
                    full, v = struct.unpack("<Q", value[v : v + 8])[0], v + 8
                if packed == 0xFFFFFFFF:
                    packed, v = struct.unpack("<Q", value[v : v + 8])[0], v + 8
                if header == 0xFFFFFFFF:
                    header, v = struct.unpack("<Q", value[v : v + 8])[0], v + 8
            q += 4 + size_
        out.append(Member(name, method, bool(flags & 1), full, packed, header))
        p += 46 + n + m + k
    return out


def opened(path: str) -> tuple[Read, int, object]:
    """Ranged reads of a file on any file system that pyarrow knows."""
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    f = system.open_input_file(at)

    def read(offset: int, length: int) -> bytes:
        data = f.read_at(length, offset)
        if len(data) < length:
            raise ValueError("the package ends too early")
        return data

    return read, f.size(), f


def locate(read: Read, size: int) -> tuple[list[tuple[int, int, int, bool, list[tuple[int, int]]]], list[str]]:
    """(first byte, last byte + 1, end of the archive member, whether a record begins at the first byte, records' ranges) of spans to fetch, and what is wrong with single members or index lines.

    Without ranges a span is to be searched for the records that begin in it: all of a member without an index, and whatever an index leaves out."""
    members = directory(read, size)
    out, errors = [], []
    archives: dict[str, Member] = {}
    ranges: dict[str, set[tuple[int, int]]] = {}
    for m in members:
        if (ARCHIVE.search(m.name) or INDEX.search(m.name)) and (m.method != 0 or m.encrypted):
            errors.append(f"ValueError: {m.name} is not stored")
        elif ARCHIVE.search(m.name):
            archives[m.name.rsplit("/", 1)[1]] = m
    for m in members:
        if INDEX.search(m.name) and m.method == 0 and not m.encrypted:
            try:
                text = read(m.start(read), m.packed)
                text = gzip.decompress(text) if m.name.endswith(".gz") else text
            except Exception as e:  # any defect of the index: the archive is read without it
                errors.append(f"{type(e).__name__}: {m.name}: {e}")
                continue
            for line in text.decode("utf8", "replace").splitlines():
                if "{" in line and not line.startswith("!"):
                    try:
                        x = json.loads(line[line.index("{") :])
                        name, offset, length = x["filename"].rsplit("/", 1)[-1], int(x["offset"]), int(x["length"])
                        if name not in archives or offset < 0 or length <= 0 or offset + length > archives[name].packed:
                            raise ValueError("it points to nothing")
                        ranges.setdefault(name, set()).add((offset, length))
                    except (ValueError, KeyError, TypeError, AttributeError) as e:
                        errors.append(f"{type(e).__name__}: {m.name}: {e}: {line[:200]}")
    for name, m in archives.items():
        try:
            start = m.start(read)
        except Exception as e:  # any defect of the member
            errors.append(f"{type(e).__name__}: {m.name}: {e}")
            continue
        end, at = start + m.packed, start
        plain = not name.endswith(".gz")
        span: list[tuple[int, int]] = []

        def close() -> None:
            if span:
                out.append((span[0][0], max(x + n for x, n in span), end, True, list(span)))
                span.clear()

        def gap(a: int, b: int) -> None:
            # a compressed record can be told wherever it begins; one that isn't compressed only from the one before it
            step = b - a if plain else SPAN_BYTES
            out.extend((x, min(x + step, b), end, x == a, []) for x in range(a, b, max(step, 1)))

        for offset, length in sorted(ranges.get(name, ())):
            x = start + offset
            if x > at:
                close()
                gap(at, x)
            elif span and x + length - span[0][0] > SPAN_BYTES:
                close()
            span.append((x, length))
            at = max(at, x + length)
        close()
        gap(at, end)
    return out, errors


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf8", "replace").split("\r\n")[1:])}


def dechunked(body: bytes) -> bytes:
    """A body sent in chunks, put together; one that only claims to be (no length where one has to be) as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?$", body[at : end if end >= 0 else len(body)])
        if not size:
            if not out:
                return body
            raise ValueError("a broken chunk")
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        if end < 0 or end + 2 + n > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + (2 if body[end + 2 + n : end + 4 + n] == b"\r\n" else 0)


def decoded(body: bytes, encoding: str) -> bytes:
    """Without the content encodings, the last one first; a body that is named compressed and isn't stays as it is."""
    for e in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if e in ("gzip", "x-gzip"):
            body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
        elif e == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
        elif e == "zstd":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif e != "identity":
            raise ValueError(f"content encoding {e} is unknown")
    return body


def charset(kind: str | None) -> str:
    """The codec that a content type names; UTF-8 where it names none that Python knows."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind or "", re.I)
    try:
        return codecs.lookup(m[1]).name if m and "\0" not in m[1] else "utf8"
    except LookupError:
        return "utf8"


def parse(record: bytes) -> tuple | None:
    """(url, record id, date, status, mime, body, error) of a response record; None for others. A body that can't be decoded is null, with the error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    h = headers(head)
    if h.get("warc-type") != "response":
        return None
    if not h.get("content-length", "").isdigit():
        raise ValueError("a record without its length")
    block = rest[: int(h["content-length"])]
    if len(block) < int(h["content-length"]):
        raise ValueError("a record is cut off")
    http, _, body = block.partition(b"\r\n\r\n")
    inner = headers(http)
    status = re.match(rb"HTTP/\S+ (\d{3})", http)
    text, error = None, None
    try:
        if "chunked" in inner.get("transfer-encoding", "").lower():
            body = dechunked(body)
        text = decoded(body, inner.get("content-encoding", "")).decode(charset(inner.get("content-type")), "replace")
    except Exception as e:  # any defect of the body
        error = f"{type(e).__name__}: {e}"
    return h.get("warc-target-uri"), h.get("warc-record-id"), h.get("warc-date"), int(status[1]) if status else None, inner.get("content-type"), text, error


def gunzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


class Window:
    """Bytes of a file from a place on, fetched by chunks and forgotten once passed."""

    def __init__(self, read: Read, end: int):
        self.read, self.end, self.at, self.data = read, end, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes at a place; fewer at the end."""
        n = min(n, self.end - at)
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.read(at, min(max(n, CHUNK), self.end - at)) if n > 0 else b""
        return self.data[at - self.at : at - self.at + n]


def compressed_record(w: Window, at: int) -> tuple[bytes, int]:
    """The gzip member at a place, and where it ends."""
    z, out, p = zlib.decompressobj(31), [], at
    while not z.eof:
        data = w.bytes(p, CHUNK)
        if not data:
            raise ValueError("a record is cut off")
        out.append(z.decompress(data))
        p += len(data)
    return b"".join(out), p - len(z.unused_data)


def next_record(w: Window, at: int, stop: int) -> int:
    """The next place before `stop` where a compressed record begins (that of no member can be taken for it: it has to open with the mark of a record); stop, if none does."""
    while at < stop:
        data = w.bytes(at, CHUNK)
        x = data.find(b"\x1f\x8b\x08")
        if x < 0:
            at += max(1, len(data) - 2)
            continue
        at += x
        if at < stop:
            try:
                if zlib.decompressobj(31).decompress(w.bytes(at, 4096), 5) == b"WARC/":
                    return at
            except zlib.error:
                pass
            at += 1
    return stop


def searched(read: Read, start: int, stop: int, end: int, known: bool) -> Iterator[bytes | Exception]:
    """The records of an archive member that begin from start to stop (one has to begin at start, if that is known), or what is wrong
    with one; after that the search goes on with the next."""
    w = Window(read, end)
    if known and w.bytes(start, 5) == b"WARC/":
        yield from plain_records(w, start, stop)
        return
    at = start
    while at < (end if known else stop):
        # where one record ends another begins, even if it is for the next task to read
        here = next_record(w, at, at + 1) == at
        if known and not here:
            yield ValueError(f"no record at {at}")
        if at >= stop:
            return
        if not here:
            at, known = next_record(w, at + 1, stop), False
            continue
        try:
            data, at = compressed_record(w, at)
            known = True
            yield data
        except Exception as e:  # any defect of the record
            yield e
            at, known = at + 1, False


def plain_records(w: Window, at: int, stop: int) -> Iterator[bytes | Exception]:
    """Records that aren't compressed, one after the other by their lengths."""
    while at < stop:
        head = b""
        while b"\r\n\r\n" not in head and len(more := w.bytes(at, len(head) + 4096)) > len(head):
            head = more
        head = head.partition(b"\r\n\r\n")[0]
        n = headers(head).get("content-length", "") if head.startswith(b"WARC/") else ""
        if n.isdigit():
            size = len(head) + 4 + int(n)
            yield w.bytes(at, size)
            at += size
            while w.bytes(at, 2) == b"\r\n":
                at += 2
        else:
            yield ValueError("a record without its mark or length")
            # on to what looks like the next one
            at += 1
            while at < stop:
                data = w.bytes(at, CHUNK)
                x = data.find(b"\r\n\r\nWARC/1.")
                if x >= 0:
                    at += x + 4
                    break
                at += max(1, len(data) - 10)


def records_of(read: Read, first: int, last: int, end: int, known: bool, ranges: list[tuple[int, int]]) -> Iterator[tuple]:
    """The rows of one span without the package: seven fields and the error."""

    def failed(e: Exception, at: int) -> tuple:
        return (*[None] * 6, f"{type(e).__name__}: {e} (in the bytes {at} to {last})")

    def blocks() -> Iterator[tuple[int, bytes | Exception]]:
        if not ranges:
            yield from ((first, x) for x in searched(read, first, last, end, known))
            return
        try:
            data, base = read(first, last - first), first
        except Exception:  # perhaps some can be read one by one
            data = None
        for at, n in ranges:
            try:
                yield at, gunzip(read(at, n) if data is None else data[at - base : at - base + n])
            except Exception as e:  # any defect of the record
                yield at, e

    for at, block in blocks():
        if isinstance(block, Exception):
            yield failed(block, at)
            continue
        try:
            r = parse(block)
        except Exception as e:  # any defect of the record
            yield failed(e, at)
            continue
        if r:
            yield r


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each response record of every *.wacz package under the folder.

    The packages are listed without reading them; a first step reads their directories and indexes, a second fetches spans of records, spread over
    as many tasks as the spans' bytes ask for. Records that an index leaves out are searched for in what it doesn't cover. Of a package, member, index line or
    record that can't be read there is one row with the package and the error only, and everything else of the package is read; of a record whose
    body can't be decoded (a content encoding that is unknown here, or damaged) all but the body. Bodies are put together from chunks, decompressed (gzip, deflate, zstd) and
    read in the character set of the content type, else as UTF-8, with replacement characters for what isn't. An empty
    folder's result is empty, and a file of no bytes is no package; records of other types are left out; a record that is twice in a package is given twice."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").option("recursiveFileLookup", "true").load(folder).select("path")

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                try:
                    read, size, handle = opened(path)
                    with handle:
                        found, errors = locate(read, size)
                    rows = [(path, a, b, end, known, [x for x, _ in r], [n for _, n in r], None) for a, b, end, known, r in found]
                except Exception as e:  # any defect of the file
                    rows, errors = [], [f"{type(e).__name__}: {e}"]
                rows += [(path, 0, 0, 0, False, [], [], e) for e in errors]
                yield pd.DataFrame(rows, columns=["path", "first", "last", "end", "known", "starts", "lengths", "error"])

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, first, last, end, known, starts, lengths, error in f.itertuples(index=False):
                rows = [(path, *[None] * 6, error)] if error else []
                if not error:
                    try:
                        read, _, handle = opened(path)
                        with handle:
                            for r in records_of(read, first, last, end, known, list(zip(starts, lengths))):
                                rows.append((path, *r))
                                if len(rows) >= 256:
                                    yield framed(rows)
                                    rows = []
                    except Exception as e:  # the file can't be opened any more
                        rows.append((path, *[None] * 6, f"{type(e).__name__}: {e}"))
                yield framed(rows)

    def framed(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["package", "url", "record_id", "date", "status", "mime", "body", "error"]).astype({"status": "Int32"})

    found = cut(files.mapInPandas(spans, "path string, first long, last long, end long, known boolean, starts array<long>, lengths array<long>, error string"))
    n, size = found.agg(F.count("*"), F.sum(F.col("last") - F.col("first"))).first()
    # a number that is given is kept: spans are small rows that stand for megabytes
    tasks = max(1, min(n, max(-(-(size or 0) // TASK_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    return found.repartition(tasks).mapInPandas(records, RECORD)


def package(rows: list[tuple[int, str, str]], zip64: bool = False, index: bool = True) -> bytes:
    """A package of (page_id, url, html): archive/data.warc.gz and, if wanted, indexes/index.cdxj, both stored."""
    archive, lines = io.BytesIO(), []
    for page, url, html in rows:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
        data = gzip.compress(head.encode() + http + b"\r\n\r\n", 6, mtime=0)
        lines.append(f"{url} 20240101000000 " + json.dumps({"url": url, "filename": "data.warc.gz", "offset": str(archive.tell()), "length": str(len(data))}))
        archive.write(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("archive/data.warc.gz", archive.getvalue()), *([("indexes/index.cdxj", "\n".join(sorted(lines)).encode())] if index else [])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def pages_to_packages(pages: DataFrame, folder: str) -> int:
    """Writes the pages into packages of about PACKAGE_BYTES of HTML under the folder and returns how many; rows with a null
    page_id, url or html are left out. A task that is run again writes the same names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        system.create_dir(at, recursive=True)
        part, k = TaskContext.get().partitionId(), 0

        def write(rows: list) -> pd.DataFrame:
            nonlocal k
            draft = f"{at}/{uuid.uuid4().hex}.part"
            with system.open_output_stream(draft) as f:
                f.write(package(rows))
            system.move(draft, f"{at}/{part:06d}-{k:06d}.wacz")
            k += 1
            return pd.DataFrame({"n": [len(rows)]})

        rows, size = [], 0
        for f in frames:
            for r in f.itertuples(index=False):
                rows.append(tuple(r))
                size += len(r[2])
                if size >= PACKAGE_BYTES:
                    yield write(rows)
                    rows, size = [], 0
        if rows:
            yield write(rows)

    ready = pages.select("page_id", "url", "html").where("page_id is not null and url is not null and html is not null")
    return ready.mapInPandas(run, "n long").count()


def pages_through_packages(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, status, error) of pages written to packages under the folder and read back."""
    pages_to_packages(pages, folder)
    r = read_packages(pages.sparkSession, folder) if _any(folder) else pages.sparkSession.createDataFrame([], RECORD)
    return r.select(F.regexp_extract("record_id", r"(-?\d+)", 1).cast("long").alias("page_id"), "url", F.col("body").alias("html"), "status", "error")


def _any(folder: str) -> bool:
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return system.get_file_info(at).type == fs.FileType.Directory


SQL = "SELECT page_id, url, html, CAST(200 AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS error FROM pages"
