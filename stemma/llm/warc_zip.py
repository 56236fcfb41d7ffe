"""WARC records in ZIP packages: a writer, and a reader that never extracts a member.

A package is a ZIP file with stored members: archives (*.warc or *.warc.gz, whose records are gzip members of their own) and
indexes (*.cdx, *.cdxj, or either with .gz) that give the offset and length of each record in its archive. The reader takes
the end of the file, finds the end record of the central directory (and the ZIP64 end record where there is one), parses the
directory with its ZIP64 fields, locates the members, reads the indexes, and hands out byte ranges; tasks then read the ranges
and parse the records in them. An archive that no index names is read from its start to its end by one task. The writer makes
one archive, archive/data.warc.gz (or data.warc), and one index, indexes/index.cdxj, for each package.

Files are opened by pyarrow's file systems, from the URI of the shared folder (local, HDFS, S3, GCS). A task writes under a
name of its own attempt and renames the package when it is whole, so a repeated task leaves the same packages.

Defined cases: a null payload is empty; of equal payloads the record with the smallest page_id is the response (nulls after
all others; every row with that page_id), others revisit it; rows without a page_id have record ids of their own; rows that are
equal in page_id, url and payload are one record written again, under one id; an empty table makes no packages and gives no
rows; compressed members of a package are left alone, but a compressed or encrypted archive raises ValueError, as it has no
byte ranges; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import fresh_folder, materialize, tidy, to_batch

PACKAGE_BYTES, RANGE_BYTES = 128_000_000, 4_000_000
MAX32 = 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, DATE_KEY = "1970-01-01T00:00:00Z", "19700101000000"
ARCHIVE, INDEX = re.compile(r"\.warc(\.gz)?$", re.IGNORECASE), re.compile(r"\.cdxj?(\.gz)?$", re.IGNORECASE)
#: Fields of an index in columns without a header line, by their usual letters: S is the length, V the offset, g the archive.
CDX_FIELDS = "N b a m s k r M S V g".split()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str | None, sha: str) -> str:
    """The id of a page's record: the same wherever it is named. Without a page the record is named nowhere, and has any id."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{sha}:{url}')}>"


def target_uri(url: str | None) -> str:
    """A URL on one line without blanks: other characters than visible ASCII are percent-encoded."""
    return urllib.parse.quote(url or "", safe="".join(chr(c) for c in range(33, 127)), errors="surrogatepass")


def warc_record(page: int | None, url: str | None, payload: bytes, sha: str, refers_to: dict | None = None) -> bytes:
    """A response record, or a revisit record (refers_to: page_id and url of its response) that has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, url, sha)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_uri(url)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"]
    lines += [f"X-Page-Id: {page}"] if page is not None else []
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to['page_id'], refers_to['url'], sha)}"] if refers_to else []
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower case) and the payload of one record: what follows the HTTP header, if there is one."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


class ZipWriter:
    """Writes stored members to a stream that cannot seek: sizes follow each member's data, with ZIP64 fields throughout."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.member = [raw, self.at, 0, 0]
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 8, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.member[2] = zlib.crc32(data, self.member[2])
        self.member[3] += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.member[2], self.member[3], self.member[3]))
        self.members.append(self.member)

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 8, 0, 0, 0x21, crc, MAX32, MAX32, len(raw), 28, 0, 0, 0, 0, MAX32) + raw + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, n, end64 = self.at - start, len(self.members), self.at
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end64, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, MAX32), MAX32, 0))


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of the data
    size: int
    crc: int
    stored: bool = True


class ZipReader:
    """Members of a ZIP file that can be read at any place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("the package is cut short")
        return data

    def directory(self) -> tuple[int, int, int]:
        """(offset, bytes, entries) of the central directory."""
        n = min(self.size, 65_557)
        tail = self.read(self.size - n, n)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (k + 22 > n or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != n):  # a comment may hold the mark
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        entries, size, start = struct.unpack_from("<HII", tail, k + 10)
        if entries == 0xFFFF or MAX32 in (size, start):
            mark, _, end64, _ = struct.unpack("<4sIQI", self.read(self.size - n + k - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self.read(end64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            entries, size, start = struct.unpack_from("<QQQ", record, 32)
        return start, size, entries

    def members(self) -> Iterator[Member]:
        """The stored members."""
        return (m for m in self.every_member() if m.stored)

    def every_member(self) -> Iterator[Member]:
        """All members; for those that are compressed or encrypted only the name counts."""
        start, size, entries = self.directory()
        data, at = self.read(start, size), 0
        for _ in range(entries):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method, _, _, crc, packed, plain, n, extra, comment, _, _, _, offset = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            k, end = at + 46 + n, at + 46 + n + extra
            while k + 4 <= end:
                kind, length = struct.unpack_from("<HH", data, k)
                if kind == 1:  # ZIP64: only the fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", data, k + 4))
                    plain = next(values) if plain == MAX32 else plain
                    packed = next(values) if packed == MAX32 else packed
                    offset = next(values) if offset == MAX32 else offset
                k += 4 + length
            at = end + comment
            if method or flags & 1:
                yield Member(name, offset, packed, crc, False)
                continue
            mark, n, extra = struct.unpack("<4s22xHH", self.read(offset, 30))
            if mark != b"PK\x03\x04":
                raise ValueError("bad local header")
            yield Member(name, offset + 30 + n + extra, plain, crc)


def _write(folder: str, packed: bool):
    archive = "data.warc.gz" if packed else "data.warc"
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        state: dict = {}
        made = []

        def open_package():
            name = f"{root}/part-{task.partitionId():06d}-{len(made):04d}.zip"
            state.update(final=name, temp=f"{name}.{task.taskAttemptId()}.tmp", index=[])
            state["stream"] = store.open_output_stream(state["temp"])
            state["zip"] = ZipWriter(state["stream"])
            state["zip"].begin(f"archive/{archive}")

        def close_package():
            z = state["zip"]
            z.end()
            z.begin("indexes/index.cdxj")
            z.write("".join(state["index"]).encode())
            z.end()
            z.close()
            state["stream"].close()
            store.move(state["temp"], state["final"])
            made.append((state["final"], z.at, len(state["index"])))
            state.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if not state:
                    if not made:
                        store.create_dir(root, recursive=True)
                    open_package()
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                data = warc_record(row["page_id"], row["url"], payload, digest32(payload), row["first"] if row["revisit"] else None)
                data = gzip.compress(data, 1, mtime=0) if packed else data
                z = state["zip"]
                where = json.dumps({"offset": str(z.member[3]), "length": str(len(data)), "filename": archive})
                state["index"].append(f"{target_uri(row['url']) or '-'} {DATE_KEY} {where}\n")
                z.write(data)
                if z.member[3] >= PACKAGE_BYTES:
                    close_package()
        if state:
            close_package()
        yield to_batch({"path": [m[0] for m in made], "bytes": [m[1] for m in made], "records": [m[2] for m in made]}, schema)

    return run


def write_packages(pages: DataFrame, folder: str | None = None, packed: bool = True) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) to packages in a folder of the shared one; (folder, written table of path, bytes, records).
    packed: each record is a gzip member of the archive."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha", F.sha1(F.coalesce(F.col("html"), F.lit(""))))
    # Both are written before they are joined: copies of one payload, however many, can then be split over tasks.
    first = materialize(p.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")), "first")
    marked = p.join(first, "sha").withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("page_id", "url", "html", "first", "revisit")
    return folder, materialize(marked.mapInArrow(tidy(_write(folder, packed)), "path string, bytes long, records long"), "packages")


def parse_index(text: str) -> Iterator[tuple[str, int, int]]:
    """(archive or "", offset, length or -1) of each line of an index: JSON after a key and a time, or columns by letters."""
    fields = CDX_FIELDS
    for line in text.splitlines():
        if line.lstrip().upper().startswith("CDX "):
            fields = line.split()[1:]
        elif (at := line.find("{")) >= 0:
            x = json.loads(line[at:])
            if "offset" in x:
                yield x.get("filename", ""), int(x["offset"]), int(x.get("length", -1))
        elif len(parts := line.split()) == len(fields) and (x := dict(zip(fields, parts, strict=True)))["V"].isdigit():
            yield x.get("g", ""), int(x["V"]), int(x["S"]) if x.get("S", "-").isdigit() else -1


def package_ranges(reader: ZipReader, path: str) -> Iterator[tuple[int, list[int], int]]:
    """(start, lengths of the records, bytes) of consecutive records in the archives of a package; no lengths: bytes to read through."""
    members = list(reader.every_member())
    archives = [m for m in members if ARCHIVE.search(m.name)]
    for m in archives:
        if not m.stored:
            raise ValueError(f"{path}: {m.name} is compressed or encrypted, and has no byte ranges")
    places: dict[str, dict[int, int]] = {m.name: {} for m in archives}
    for m in members:
        if not INDEX.search(m.name):
            continue
        if not m.stored:
            raise ValueError(f"{path}: {m.name} is compressed or encrypted")
        data = reader.read(m.start, m.size)
        if zlib.crc32(data) != m.crc:
            raise ValueError(f"{path}: the index is damaged")
        for name, offset, length in parse_index((gzip.decompress(data) if m.name.lower().endswith(".gz") else data).decode("utf-8")):
            named = [a for a in archives if a.name == name or a.name.endswith("/" + name)] or (archives if len(archives) == 1 and not name else [])
            if not named:
                raise ValueError(f"{path}: {m.name} names {name}, which is not there")
            places[named[0].name][offset] = max(length, places[named[0].name].get(offset, -1))
    for m in archives:
        if not places[m.name]:
            if m.size:
                yield m.start, [], m.size
            continue
        offsets = sorted(places[m.name])
        start, lengths = offsets[0], []
        for offset, after in zip(offsets, [*offsets[1:], m.size], strict=True):
            if lengths and (offset != start + sum(lengths) or sum(lengths) >= RANGE_BYTES):
                yield m.start + start, lengths, sum(lengths)
                start, lengths = offset, []
            length = places[m.name][offset]
            lengths.append(length if length >= 0 else after - offset)
        yield m.start + start, lengths, sum(lengths)


def _ranges(folder: str):
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64())), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    found = list(package_ranges(ZipReader(file, size), path))
                yield to_batch({"path": [path] * len(found), "start": [x[0] for x in found], "lengths": [x[1] for x in found], "size": [x[2] for x in found]}, schema)

    return run


def unpacked(data: bytes) -> bytes:
    """A record as it is, or out of its gzip member."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def through(file, start: int, size: int) -> Iterator[bytes]:
    """The records of an archive without an index, one after another; at most one record and a buffer are held."""
    file.seek(start)
    left, held, raw = size, b"", b""
    gz = None

    def more() -> bool:
        nonlocal left, held, raw, gz
        while True:
            if not raw:
                raw = file.read(min(left, 1 << 20))
                if not raw:
                    return False
                left -= len(raw)
                if gz is None and size - left == len(raw) and raw[:2] == b"\x1f\x8b":
                    gz = zlib.decompressobj(31)
            if gz is None:
                held, raw = held + raw, b""
                return True
            out = gz.decompress(raw)
            raw = gz.unused_data
            gz = zlib.decompressobj(31) if gz.eof else gz
            if out:
                held += out
                return True

    while True:
        held = held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in held:
            if not more():
                if held.strip():
                    raise ValueError("the archive is cut short")
                return
            held = held.lstrip(b"\r\n")
        end = held.index(b"\r\n\r\n") + 4
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", held[:end])
        if not length:
            raise ValueError("a record has no length")
        while len(held) < end + int(length[1]):
            if not more():
                raise ValueError("the archive is cut short")
        yield held[: end + int(length[1])]
        held = held[end + int(length[1]) :]


def _read(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def records(file, start: int, lengths: list[int], size: int) -> Iterator[bytes]:
        if not lengths:
            yield from through(file, start, size)
            return
        file.seek(start)
        data, at = file.read(size), 0
        for n in lengths:
            yield unpacked(data[at : at + n])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, lengths, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths", "size")), strict=True):
                with store.open_input_file(path) as file:
                    rows, held = {f.name: [] for f in schema}, 0
                    for data in records(file, start, lengths, size):
                        fields, payload = parse_record(data)
                        kind, sha = fields["warc-type"], fields.get("warc-payload-digest", "")
                        own = digest32(payload)
                        if kind == "response" and sha.startswith("sha1:") and len(sha) == 37 and own != sha[5:]:
                            raise ValueError(f"{path}: a payload does not have its digest")
                        page = fields.get("x-page-id")
                        values = int(page) if page else None, fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), sha.removeprefix("sha1:") or own, None if kind == "revisit" else payload
                        for k, v in zip(rows, values, strict=True):
                            rows[k].append(v)
                        held += len(payload)
                        if held > RANGE_BYTES:
                            yield to_batch(rows, schema)
                            rows, held = {f.name: [] for f in schema}, 0
                    yield to_batch(rows, schema)

    return run


def read_packages(folder: str, packages: DataFrame) -> DataFrame:
    """The records of packages (path, bytes): page_id (null unless this writer's), record_id, record_type, refers_to_id, target_uri,
    payload_digest, payload (null for revisits). The byte ranges are dealt out anew, so that one large package is read by many tasks."""
    ranges = packages.select("path", "bytes").mapInArrow(tidy(_ranges(folder)), "path string, start long, lengths array<long>, size long")
    spread = ranges.repartition(packages.sparkSession.sparkContext.defaultParallelism * 4, "path", "start")
    return spread.mapInArrow(tidy(_read(folder)), "page_id long, record_id string, record_type string, refers_to_id string, target_uri string, payload_digest string, payload binary")


def round_trip_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, as read back from the packages."""
    folder, packages = write_packages(pages)
    read = read_packages(folder, packages)
    records = materialize(read.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "records")
    response = materialize(records.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to_page"), F.any_value("payload_bytes").alias("to_bytes")), "responses")
    joined = records.join(response.select(F.col("record_id").alias("_to"), "to_page", "to_bytes"), F.col("refers_to_id") == F.col("_to"), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select("page_id", F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("to_page")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY 1),
x AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, first FROM p JOIN f USING (t))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
