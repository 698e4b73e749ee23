"""WARC archives as a Spark Python data source: write, revisit detection, header-first reads.

One gzip member per record. Each member's header carries the skip-lengths field of the WARC
standard's gzip annex (subfield ``sl``: compressed and plain length), so a reader inflates only
the record's head and seeks over payloads that nobody asked for. Members without it are
inflated to their end, and may hold several records. Files that are not compressed are read as
they are, by seeking over the blocks.

Planning makes one input partition per archive file; the writer rolls files at ``file_bytes``.
Equality and set predicates on ``record_type`` and on header columns are taken over by the
reader (``spark.sql.python.filterPushdown.enabled``); a payload is decoded only if the schema
asks for it and the record passed all of them.

Defined cases: null html is an empty payload, a null url an empty target, a null page_id is
written as ``null`` and never referred to unless all its equals are null too; rows that tie for
the largest page_id of a payload are all responses; payloads of any length are written and read in
whole, one at a time; an empty table writes no file. In archives of others, a record without a valid
Content-Length ends with its member (in a plain file, with the file); a payload that is damaged or cut
short is null; members that do not begin with a readable head are passed over, and reading goes on at
the next one.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from siftwell.llm.shared import local_path, make_folder, shared_folder

HEADER_SCHEMA = (
    "record_type string, record_id string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to long"
)
FULL_SCHEMA = HEADER_SCHEMA + ", payload binary"
# Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARROW_TYPES = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
READ_BYTES = 1 << 16
#: How many ways the rows of one digest are dealt.
SALTS = 16
BATCH_ROWS = 512


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add digest, size, ``is_revisit`` and ``refers_to`` to pages.

    Only digests that repeat join back, each as ``SALTS`` narrow rows, so the pages of a payload that
    a third of all pages share are dealt over as many tasks.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt")
    rows = pages.select("page_id", "url", F.col("html").alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"), salt)
    groups = (
        rows.where(F.col("size") >= min_bytes)
        .groupBy(F.col("digest").alias("g_digest"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("newest"))
        .where("n > 1")
        .withColumn("g_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    )
    same = (rows["digest"] == groups["g_digest"]) & (rows["salt"] == groups["g_salt"]) & (rows["size"] >= min_bytes)
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    joined = rows.join(groups, same, "left")
    return joined.select("page_id", "url", "payload", "digest", "size", revisit.alias("is_revisit"), F.when(revisit, F.col("newest")).alias("refers_to"))


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(page_id, url, payload: bytes, digest_hex: str, size: int, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record as one gzip member with skip lengths."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = deflate.compress(plain) + deflate.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return (
        b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x04\xff"
        + struct.pack("<H", len(extra))
        + extra
        + packed
        + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    )


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files; the driver's commit gives those of the winning tries their names."""

    def __init__(self, folder: str, date: str, file_bytes: int) -> None:
        self.folder, self.date, self.file_bytes = folder, date, file_bytes

    def write(self, iterator) -> Written:
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"{self.folder}/_{uuid.uuid4().hex}.warc.gz"
                        out, size = _open(name, "wb"), 0
                        files.append(name)
                    record = encode_record(
                        row["page_id"], row["url"], (row["payload"] or "").encode(), row["digest"], row["size"], row["refers_to"], row["is_revisit"], self.date
                    )
                    out.write(record)
                    size += len(record)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages) -> None:
        for n, name in enumerate(f for m in messages if m is not None for f in m.files):
            _move(name, f"{self.folder}/part-{n:06d}-{name[-40:-8]}.warc.gz")

    def abort(self, messages) -> None:
        for name in (f for m in messages if m is not None for f in m.files):
            _remove(name)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _open(uri: str, mode: str):
    path = local_path(uri)
    if path is not None:
        return open(path, mode)
    store, inner = _store(uri)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def _move(old: str, new: str) -> None:
    import os

    if local_path(old) is not None:
        os.replace(local_path(old), local_path(new))
    else:
        store, inner = _store(old)
        store.move(inner, _store(new)[1])


def _remove(uri: str) -> None:
    import os

    if local_path(uri) is not None:
        if os.path.exists(local_path(uri)):
            os.remove(local_path(uri))
    else:
        store, inner = _store(uri)
        store.delete_file(inner)


def _archives(folder: str) -> list[str]:
    import os

    path = local_path(folder)
    if path is not None:
        names = sorted(os.listdir(path))
    else:
        from pyarrow import fs

        store, inner = _store(folder)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(inner)))
    return [f"{folder}/{n}" for n in names if n.endswith((".warc.gz", ".warc")) and not n.startswith(("_", "."))]


class _Plain:
    """The bytes of an archive that is not compressed, from one place on."""

    def __init__(self, source, at: int = 0) -> None:
        self.source, self.bytes = source, bytearray()
        source.seek(at)

    def more(self) -> bool:
        block = self.source.read(READ_BYTES)
        self.bytes += block
        return bool(block)

    def until(self, mark: bytes, start: int) -> int:
        """Where ``mark`` begins, -1 if it does not come."""
        while (found := self.bytes.find(mark, start)) < 0:
            start = max(start, len(self.bytes) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def upto(self, end: int) -> int:
        """Have the bytes before ``end``; how many there are."""
        while len(self.bytes) < end and self.more():
            pass
        return min(end, len(self.bytes))

    def skip(self, n: int) -> bool:
        """Let go of ``n`` bytes; whether any follow."""
        if n > len(self.bytes):
            self.source.seek(n - len(self.bytes), 1)
            self.bytes.clear()
        else:
            del self.bytes[:n]
        return bool(self.bytes) or self.more()


class _Member(_Plain):
    """The plain bytes of one gzip member."""

    def __init__(self, source, at: int) -> None:
        super().__init__(source, at)
        first = source.read(24)
        lengths = len(first) == 24 and first[3] & 4 and first[12:14] == b"sl"
        self.packed, self.length = struct.unpack("<II", first[16:24]) if lengths else (None, None)
        self.at, self.fed, self.let_go = at, 0, 0
        self.inflate = zlib.decompressobj(31)
        source.seek(at)

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        block = self.inflate.unconsumed_tail
        if not block:
            block = self.source.read(min(READ_BYTES, self.packed - self.fed) if self.packed else READ_BYTES)
            self.fed += len(block)
            if not block:
                return False
        self.bytes += self.inflate.decompress(block, READ_BYTES)
        return True

    def skip(self, n: int) -> bool:
        if self.length is not None and self.let_go + n >= self.length:
            return False
        self.let_go += n
        self.upto(n)
        del self.bytes[:n]
        return bool(self.bytes) or self.more() and bool(self.bytes)

    def following(self) -> int:
        """Where the next member begins."""
        if self.packed:
            return self.at + self.packed
        while self.more():
            self.bytes.clear()
        if not self.inflate.eof:
            raise zlib.error("truncated")
        return self.at + self.fed - len(self.inflate.unused_data)


@dataclass
class _Record:
    """A record's head, and its block on demand."""

    part: _Plain
    start: int
    head: dict[str, str]
    length: int | None

    @property
    def block_start(self) -> int:
        return self.part.until(b"\r\n\r\n", self.start) + 4

    def http_head(self) -> tuple[dict[str, str], int]:
        """The HTTP head, if the block has one, and where the payload begins."""
        if "http" not in self.head.get("content-type", ""):
            return {}, self.block_start
        end = self.part.until(b"\r\n\r\n", self.block_start)
        return (_parse_head(bytes(self.part.bytes[self.block_start : end])), end + 4) if end >= 0 else ({}, self.block_start)

    def payload_bytes(self) -> int | None:
        try:
            return _number(self.http_head()[0].get("content-length"))
        except zlib.error:
            return None

    def payload(self) -> bytes | None:
        """The payload, None if it is damaged or cut short."""
        try:
            start = self.http_head()[1]
            if self.length is None:
                end = self.part.upto(1 << 62)
                end -= 4 if self.part.bytes.endswith(b"\r\n\r\n") else 0
            else:
                end = self.block_start + self.length
                if self.part.upto(end) < end:
                    return None
        except zlib.error:
            return None
        return bytes(self.part.bytes[start:end])


def _records_in(part: _Plain):
    """The records of a plain file or a member."""
    while True:
        end = part.until(b"\r\n\r\n", 0)
        if end < 0 or not part.bytes.startswith(b"WARC/"):
            return
        head = _parse_head(bytes(part.bytes[:end]))
        length = _number(head.get("content-length"))
        length = length if length is not None and length >= 0 else None
        yield _Record(part, 0, head, length)
        if length is None or not part.skip(end + 4 + length + 4):
            return


def _next_member(source, at: int) -> int | None:
    """The next place from ``at`` on where a gzip member of records begins."""
    while True:
        source.seek(at)
        block = source.read(1 << 20)
        found = block.find(b"\x1f\x8b\x08")
        if found < 0 and len(block) < 1 << 20:
            return None
        at += found if found >= 0 else len(block) - 2
        if found >= 0:
            try:
                if _Member(source, at).upto(5) == 5:
                    return at
            except (zlib.error, struct.error):
                pass
            at += 1


def records(source):
    """All records of an archive, compressed or not."""
    source.seek(0)
    if source.read(2) != b"\x1f\x8b":
        yield from _records_in(_Plain(source))
        return
    at: int | None = 0
    while at is not None:
        source.seek(at)
        if not source.read(1):
            return
        try:
            member = _Member(source, at)
            yield from _records_in(member)
            at = member.following()
        except (zlib.error, struct.error):
            at = _next_member(source, at + 1)


def _number(value: str | None):
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def _parse_head(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _columns(head: dict[str, str]) -> dict:
    ident = head.get("warc-record-id", "")
    return {
        "record_type": head.get("warc-type"),
        "record_id": ident.strip("<>"),
        "page_id": _number(ident.strip("<>").rpartition(":")[2]),
        "target_uri": head.get("warc-target-uri"),
        "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": _number(head["warc-refers-to"].strip("<>").rpartition(":")[2]) if "warc-refers-to" in head else None,
    }


_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}
_EARLY = ("record_type", "record_id", "page_id", "target_uri", "payload_digest", "refers_to")


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema) -> None:
        self.folder = folder
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _EARLY and (type(f) in _TESTS or type(f) is IsNotNull):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        return [InputPartition(name) for name in _archives(self.folder)] or [InputPartition(None)]

    def _passes(self, row: dict) -> bool:
        return all(row[name] is not None and (kind is IsNotNull or _TESTS[kind](row[name], value)) for name, kind, value in self.tests)

    def read(self, partition):
        if partition.value is None:
            return
        wanted = {name for name, _ in self.fields}
        schema = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in self.fields])
        rows: list[dict] = []
        with _open(partition.value, "rb") as source:
            for record in records(source):
                row = _columns(record.head)
                if not self._passes(row):
                    continue
                if "payload_bytes" in wanted:
                    row["payload_bytes"] = record.payload_bytes()
                if "payload" in wanted and row["record_type"] == "response":
                    row["payload"] = record.payload()
                rows.append({name: row.get(name) for name, _ in self.fields})
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("siftwell_warc")``; options ``path``, ``date``, ``file_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "siftwell_warc"

    def schema(self) -> str:
        return FULL_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"), int(self.options.get("file_bytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, **options: str) -> None:
    """Write one record per page below ``folder``."""
    register(pages.sparkSession)
    make_folder(folder)
    revisits(pages, min_bytes).write.format("siftwell_warc").mode("append").options(path=folder, **options).save()


def read_archive(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records below ``folder``; payloads are decoded only on demand."""
    register(spark)
    return spark.read.format("siftwell_warc").schema(FULL_SCHEMA if payload else HEADER_SCHEMA).options(path=folder).load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to a fresh shared folder and read all records' heads back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_pages(pages, folder, min_bytes)
    return read_archive(pages.sparkSession, folder)
