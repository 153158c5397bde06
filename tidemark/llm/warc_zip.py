"""WARC records in ZIP-packaged archives: writing, and reading by ranges.

An archive is a ZIP file whose members are stored, not deflated:
``archive/data.warc.gz`` (every record a gzip member of its own) and
``indexes/index.cdxj`` (one line per record: place, length, digest).  Tasks
stream archives of bounded size into a shared folder; the ZIP64 forms of the
directory are written when a size, place or count outgrows the plain ones.

Reading never extracts: the end record, the ZIP64 locator and record and the
central directory are parsed from the tail of the file, the stored members
are located through their local headers, the index is read by range, and
bounded chunks of neighbouring records are range-read by other tasks.  An
archive without an index is walked gzip member by gzip member.

File access in tasks is by pyarrow's file systems, so the folder's scheme
must be one they know (file, hdfs, s3, gs, abfs).

Defined results: null payload is empty; a null URL has no target header;
control characters in a URL are percent-encoded; a null id is the smallest
and never has revisits pointing at it when another row has its payload; rows
that repeat the responding row are responses too; no rows, no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import scratch_path, stored

ARCHIVE_BYTES = 256 << 20   # an archive is closed beyond this
ARCHIVE_RECORDS = 50_000
CHUNK_BYTES = 8 << 20       # neighbouring records read at once
REVISIT_FROM = 1000         # bytes of payload from which copies become revisits
GZIP_LEVEL = 4

# fixed values of the ZIP and WARC formats
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"


def file_system(uri: str):
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members streamed one after the other; nothing is sought."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # sizes follow in a descriptor (flag 8); names are UTF-8 (flag 0x800)
        self.write(struct.pack("<4s5H3L2H", LOCAL, 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)

    def append(self, data: bytes) -> int:
        place = self.size
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self.write(data)
        return place

    def close_member(self) -> None:
        wide = self.force64 or self.size >= FULL32
        self.write(struct.pack("<4sLQQ" if wide else "<4sLLL", DESCRIPTOR, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        first = self.at
        for name, crc, size, start in self.members:
            wide = self.force64 or size >= FULL32 or start >= FULL32
            extra = struct.pack("<2H3Q", 1, 24, size, size, start) if wide else b""
            s, o = (FULL32, FULL32) if wide else (size, start)
            self.write(struct.pack("<4s6H3L5H2L", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, s, s, len(name),
                                   len(extra), 0, 0, 0, 0, o) + name + extra)
        n, size = len(self.members), self.at - first
        if self.force64 or n >= FULL16 or first >= FULL32 or size >= FULL32:
            end = self.at
            self.write(struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, n, n, size, first))
            self.write(struct.pack("<4sLQL", LOCATOR64, 0, end, 1))
            n, size, first = FULL16, FULL32, FULL32
        self.write(struct.pack("<4s4H2LH", END, 0, 0, n, n, size, first, 0))


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends within bytes {start} to {start + length}")
    return data


def stored_members(f) -> list[tuple[str, int, int]]:
    """``(name, first byte of the data, length)`` of every stored member."""
    total = f.size()
    tail_at = max(0, total - 22 - FULL16)       # the end record and its comment
    tail = read_range(f, tail_at, total - tail_at)
    at = tail.rfind(END)
    while at >= 0 and tail[at + 20:at + 22] != struct.pack("<H", max(0, len(tail) - at - 22)):
        at = tail.rfind(END, 0, at)             # the mark may stand in the comment
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    disk, first_disk, _, n, size, first = struct.unpack_from("<4H2L", tail, at + 4)
    if disk not in (0, FULL16) or first_disk not in (0, FULL16):
        raise ValueError("archives in several files are not read")
    if FULL16 in (n, disk) or FULL32 in (size, first):
        locator = tail_at + at - 20
        sign, _, place, _ = struct.unpack("<4sLQL", read_range(f, locator, 20))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator before the end record")
        sign, *_, n, size, first = struct.unpack("<4sQ2H2L4Q", read_range(f, place, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end record at the place the locator names")
    out, directory, at = [], read_range(f, first, size), 0
    for _ in range(n):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<2H", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<2L3H", directory, at + 20)
        place, = struct.unpack_from("<L", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name]
        extra, e = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<2H", extra, e)
            if kind == 1:                       # only what overflowed is here, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                place = next(wide) if place == FULL32 else place
            e += 4 + length
        if method == 0 and not flags & 1:
            head = read_range(f, place, 30)
            if head[:4] != LOCAL:
                raise ValueError("no local header at the place the directory names")
            out.append((name.decode("utf-8" if flags & 0x800 else "cp437"),
                        place + 30 + sum(struct.unpack_from("<2H", head, 26)), packed))
        at += 46 + n_name + n_extra + n_note
    return out


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def warc_record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>",
            f"WARC-Date: {WARC_DATE}", "Content-Type: application/http;msgtype=response",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
            f"Content-Length: {len(block)}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"),
            "target_uri": fields.get("warc-target-uri"),
            "refers_to": (fields.get("warc-refers-to") or "").strip("<>") or None,
            "declared_digest": fields.get("warc-payload-digest"), "payload": payload}


def mark_revisits(pages: DataFrame, id_col: str, body_col: str, revisit_from: int) -> DataFrame:
    """``pages`` with ``__wz_body``, ``__wz_sha`` and ``__wz_refers``."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8")
    page = F.col(id_col).cast("long")
    rows = pages.withColumn("__wz_body", body).withColumn("__wz_sha", F.sha1("__wz_body"))
    slim = rows.where(F.length("__wz_body") >= revisit_from).select("__wz_sha", page.alias("__wz_id"))
    heads = slim.groupBy("__wz_sha").agg(F.max("__wz_id").alias("__wz_refers"), F.count("*").alias("n"))
    heads = heads.where("n > 1 and __wz_refers is not null").drop("n")
    # decided on slim rows; the bodies are joined by page, which no copy skews
    revisits = slim.join(heads, "__wz_sha").where(~F.col("__wz_id").eqNullSafe(F.col("__wz_refers"))).distinct()
    rows = rows.withColumn("__wz_key", F.coalesce(page.cast("string"), F.lit("null")))
    revisits = revisits.withColumn("__wz_key", F.coalesce(F.col("__wz_id").cast("string"), F.lit("null"))).drop("__wz_id")
    return rows.join(revisits, ["__wz_key", "__wz_sha"], "left")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", *, revisit_from: int = REVISIT_FROM,
                   archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS,
                   force_zip64: bool = False) -> DataFrame:
    """Archives of one record per row; returns the stored manifest
    ``(path, records, bytes)``.  A task that is run again writes under new
    names, and only what a finished task wrote is in the manifest."""
    rows = mark_revisits(pages, id_col, body_col, revisit_from).select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
        F.col("__wz_body").alias("body"), F.col("__wz_sha").alias("sha"), F.col("__wz_refers").alias("refers"))

    def write(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done, zipped = [], None

        def finish():
            zipped.close_member()
            zipped.open(INDEX_MEMBER)
            zipped.append("".join(index).encode())
            zipped.close_member()
            zipped.close()
            zipped.out.close()
            done.append((path, len(index), zipped.at))

        for b in batches:
            for page, url, body, sha, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                if zipped is None:
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.wacz"
                    path, index = f"{folder.rstrip('/')}/{name}", []
                    zipped = ZipWriter(fs.open_output_stream(f"{base.rstrip('/')}/{name}"), force_zip64)
                    zipped.open(WARC_MEMBER)
                data = _gzip(warc_record(page, url, body, sha, refers), GZIP_LEVEL)
                place = zipped.append(data)
                index.append(f"{page} {WARC_DATE} " + json.dumps(
                    {"url": url, "digest": "sha1:" + sha, "offset": place, "length": len(data)}) + "\n")
                if zipped.at >= archive_bytes or len(index) >= archive_records:
                    finish()
                    zipped = None
        if zipped is not None:
            finish()
        p, n, s = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(n, pa.int64()), pa.array(s, pa.int64())],
                                         ["path", "records", "bytes"])

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def archive_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(path, start, ends)``: bounded runs of neighbouring records of the
    archives ``archives(path)``, from their indexes."""

    def chunks(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = file_system(path)
                with fs.open_input_file(p) as f:
                    members = stored_members(f)
                    for name, first, size in members:
                        if not re.search(r"\.warc(\.gz)?$", name):
                            continue
                        index = [m for m in members if re.search(r"\.cdxj?$", m[0])]
                        if index:
                            lines = read_range(f, *index[0][1:]).decode().splitlines()
                            spans = sorted((x["offset"], x["length"]) for x in (
                                json.loads(y[y.index("{"):]) for y in lines))
                        else:
                            spans = walk(f, first, size)
                        paths, starts, ends, at = [], [], [], 0
                        for offset, length in spans:
                            if not ends or offset + length - starts[-1] + first > chunk_bytes:
                                paths.append(path)
                                starts.append(first + offset)
                                ends.append([])
                            ends[-1].append(first + offset + length)
                        for i in range(0, len(paths), 1000):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(paths[i:i + 1000]), pa.array(starts[i:i + 1000], pa.int64()),
                                 pa.array(ends[i:i + 1000], pa.list_(pa.int64()))], ["path", "start", "ends"])

    return archives.select("path").mapInArrow(chunks, "path string, start long, ends array<long>")


def walk(f, first: int, size: int, step: int = 1 << 20) -> list[tuple[int, int]]:
    """Places of the gzip members of a stored member that has no index."""
    spans, at, begun, z, rest = [], 0, 0, zlib.decompressobj(31), b""
    while True:
        if not rest:
            if at >= size:
                break
            rest = read_range(f, first + at, min(step, size - at))
            at += len(rest)
        z.decompress(rest)
        rest = z.unused_data if z.eof else b""
        if z.eof:
            spans.append((begun, at - len(rest) - begun))
            begun, z = at - len(rest), zlib.decompressobj(31)
    return spans


RECORDS = ("page_id long, type string, target_uri string, refers_to long, declared_digest string, payload binary")


def read_records(archives: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every record of the archives named by ``archives(path)``."""
    parts = stored(archive_chunks(archives, chunk_bytes), "warc-chunks")
    spread = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for b in batches:
            for path, start, ends in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, p = file_system(path)
                with fs.open_input_file(p) as f:
                    data = memoryview(read_range(f, start, ends[-1] - start))
                out, held, at = [], 0, 0
                for end in ends:
                    r = parse_record(zlib.decompress(data[at:end - start], 31))
                    at = end - start
                    if r["type"] == "response" and sha1_of(r["declared_digest"]) != hashlib.sha1(r["payload"]).hexdigest():
                        raise ValueError(f"payload of {r['record_id']} differs from its digest")
                    number = lambda urn: None if urn in (None, "urn:page:null") else int(urn.rsplit(":", 1)[1])
                    out.append((number(r["record_id"]), r["type"], r["target_uri"], number(r["refers_to"]),
                                r["declared_digest"], r["payload"]))
                    held += len(r["payload"])
                    if held > chunk_bytes:
                        yield _records(out)
                        out, held = [], 0
                if out:
                    yield _records(out)

    return parts.repartition(spread, "path", "start").mapInArrow(read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      [x.split()[0] for x in RECORDS.split(", ")])


def sha1_of(declared: str) -> str:
    """A declared ``sha1:BASE32`` digest in lower-case hex."""
    return base64.b32decode(declared.split(":")[1]).hex()


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               folder: str | None = None, **options) -> DataFrame:
    """Archives written and read back: ``(page_id, payload_bytes,
    payload_digest, record_type, refers_to)``; a revisit's payload is that of
    the response it refers to."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    records = read_records(write_archives(pages, folder, id_col, url_col, body_col, **options).select("path"))
    slim = stored(records.select("page_id", "type", "refers_to", F.length("payload").cast("long").alias("bytes"),
                                 F.sha1("payload").alias("sha")), "warc-read")
    revisits = slim.where("type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    full = (slim.where("type = 'response'").join(wanted, "page_id", "left_semi").distinct()
            .select(F.col("page_id").alias("refers_to"), "bytes", "sha"))
    out = slim.where("type = 'response'").select("page_id", "bytes", "sha", "type", "refers_to").unionByName(
        revisits.drop("bytes", "sha").join(full, "refers_to", "left").select(
            "page_id", "bytes", "sha", "type", "refers_to"))
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
                      F.col("type").alias("record_type"), "refers_to")
