"""WARC archives as a PySpark data source, and page archives in which equal payloads are written once."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import fresh_path, importable, materialise

FORMAT = "tidewright_warc"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
#: A file is closed once it holds so many compressed bytes, so that reads have files to deal out.
ROLL_BYTES = 64 << 20
_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or plain path; whatever pyarrow has a client for."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def gzip_member(data: bytes, level: int = 5) -> bytes:
    """A gzip member that tells its whole length and that of its content, 8 bytes each, in the extra field 'sl', so that readers can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 20 + len(body) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, total, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: Any) -> bytes:
    """One WARC record: headers, then an HTTP response block (with the payload unless it is a revisit)."""
    payload = bytes(row["payload"]) if row["payload"] is not None else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length'] or 0}\r\n\r\n".encode()
    block = http + payload
    heads = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}")]
    if row["record_type"] == "revisit":
        heads += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    heads += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in heads if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceWriter):
    """Each task writes files under names of its own, in a folder of this write; commit() gives them their final names, abort() removes them."""

    def __init__(self, path: str):
        self.path, self.folder = path, f"_temporary-{uuid.uuid4().hex}"

    def _clear(self, system: pafs.FileSystem, base: str) -> None:
        folder = posixpath.join(base, self.folder)
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)

    def write(self, iterator: Iterator[Any]) -> _Written:
        files, out, size = [], None, 0
        system, base = filesystem(self.path)
        system.create_dir(posixpath.join(base, self.folder), recursive=True)
        for row in iterator:
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                files.append((posixpath.join(base, self.folder, name), posixpath.join(base, name)))
                out, size = system.open_output_stream(files[-1][0], compression=None), 0
            size += out.write(gzip_member(record_bytes(row)))
            if size >= ROLL_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        for m in messages:
            for temporary, final in m.files if m else []:
                system.move(temporary, final)
        self._clear(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*filesystem(self.path))


def parse_head(data: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) and where the block starts; None until the header is complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


class _Text:
    """The unpacked content from one place of an archive on, read as far as it is asked for: gzip members one after another, or the plain bytes."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.held = stream, at, bytearray()  # grows at its end and shrinks at its start without a copy
        stream.seek(at)
        self.raw = stream.read(_CHUNK)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Takes on the next piece of content; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(_CHUNK)
            if not self.raw:
                if self.packed and not self.unpack.eof and self.started:
                    raise ValueError("an archive that ends within a gzip member")
                return False
        if not self.packed:
            self.held += self.raw
            self.raw = b""
            return True
        self.held += self.unpack.decompress(self.raw)
        self.started = True
        self.raw = b""
        if self.unpack.eof:
            self.raw, self.unpack, self.started = self.unpack.unused_data, zlib.decompressobj(31), False
        return True

    started = False

    def upto(self, size: int) -> bool:
        """Whether so much content is held, after reading on."""
        while len(self.held) < size:
            if not self.more():
                return False
        return True


class Records:
    """WARC records of a file: plain, a gzip member a record, or several records a member. Members of this module's writer are stepped over unread where their record isn't wanted."""

    def __init__(self, stream):
        self.stream, self.size = stream, stream.size()

    def _own_member(self, at: int) -> int | None:
        """Length of a member that tells it (one record then)."""
        self.stream.seek(at)
        first = self.stream.read(32)
        if len(first) == 32 and first[:4] == b"\x1f\x8b\x08\x04" and first[12:16] == b"sl\x10\0":
            return struct.unpack("<Q", first[16:24])[0]
        return None

    def read(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Fields and block of each record; block is None where wanted(fields) is 'head', and refused records ('') are left out."""
        at, text = 0, None
        while text is not None or at < self.size:
            skip = None
            if text is None:
                skip = self._own_member(at)
                text = _Text(self.stream, at)
            while (head := parse_head(text.held)) is None:
                if not text.more():
                    if text.held.strip(b"\r\n"):
                        raise ValueError("a WARC record without a complete header")
                    return
            fields, start = head
            want, length = wanted(fields), int(fields.get("content-length", 0))
            if skip is not None and want != "block":
                at, text = at + skip, None
                if want:
                    yield fields, None
                continue
            if want == "block":
                if not text.upto(start + length):
                    raise ValueError("a WARC record that ends before its length")
                yield fields, bytes(memoryview(text.held)[start : start + length])
            else:
                # What isn't wanted is unpacked, as members of others don't tell their length, but not kept.
                left = start + length
                while left > len(text.held):
                    left -= len(text.held)
                    text.held.clear()
                    if not text.more():
                        raise ValueError("a WARC record that ends before its length")
                del text.held[:left]
                start = length = 0
                if want:
                    yield fields, None
            if skip is not None:
                at, text = at + skip, None
                continue
            del text.held[: start + length]
            while True:  # blank lines between records
                blank = 0
                while blank < len(text.held) and text.held[blank] in b"\r\n":
                    blank += 1
                del text.held[:blank]
                if text.held or not text.more():
                    break
            if not text.held:
                return


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition a file. Equality and IN filters on the header columns are settled on the header, before a payload is unpacked."""

    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _FIELDS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.allowed[name] = self.allowed[name] & values if name in self.allowed else values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, base = filesystem(self.path)
        info = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return [_File(f.path) for f in sorted(info, key=lambda f: f.path) if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)

        def wanted(fields: dict[str, str]) -> str:
            for name, values in self.allowed.items():
                if self._column(name, fields) not in values:
                    return ""
            return "block" if self.payloads and fields.get("warc-type") != "revisit" else "head"

        if partition is None:
            return
        rows, size = [], 0
        with system.open_input_file(partition.path) as stream:
            for fields, block in Records(stream).read(wanted):
                rows.append(self._row(fields, block))
                size += len(block or b"")
                if len(rows) >= 2_000 or size >= 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _column(self, name: str, fields: dict[str, str]) -> str | None:
        value = fields.get(_FIELDS[name])
        return value.removeprefix("sha1:") if value is not None and name == "payload_digest" else value

    def _row(self, fields: dict[str, str], block: bytes | None) -> tuple:
        payload = length = None
        if block is not None:
            payload = block
            if fields.get("content-type", "").startswith("application/http"):
                payload = block[block.find(b"\r\n\r\n") + 4 :]
            digest = self._column("payload_digest", fields)
            if digest is not None and base32_sha1(payload) != digest:
                raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
            length = len(payload)
        return (*[self._column(n, fields) for n in _FIELDS], length, payload)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(_FIELDS) + [pa.int64(), pa.binary()]
        names = [*_FIELDS, "payload_length", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class WarcSource(DataSource):
    """Options: path, and payloads (true: unpack and check payloads; false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _urn(c):
    return F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))).otherwise(F.lit("<urn:page:>"))


def _page(c):
    return F.try_to_number(F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("bigint")


def page_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of each page; payloads stay in their tasks."""
    importable(pages.sparkSession)

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(map(base32_sha1, raw), pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("html").cast("string")).mapInArrow(digest, "page_id bigint, payload_bytes bigint, payload_digest string")


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives pages (page_id, url, html): of equal payloads of `least` bytes at least, the smallest page_id is the response, the others revisit it.

    A null html is an empty payload, a null url has no header. Rows with the smallest page_id of their payload are all
    responses; a null page_id revisits unless its payload has no other page. Payloads are shuffled only when there are
    more revisits than Spark would broadcast.
    """
    register(pages.sparkSession)
    found = materialise(page_digests(pages), "page-digests")
    first = found.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null")
    again = found.join(first, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "payload_digest").agg(F.first("first").alias("first"))
    again = materialise(again, "revisits")
    if again.limit(1).count():
        keys = again.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("payload_digest", "first"))).alias("firsts")).withColumnRenamed("page_id", "id")
        joined = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").join(keys, F.col("page_id").eqNullSafe(F.col("id")), "left")
    else:
        joined = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("firsts", F.lit(None).cast("map<string,bigint>"))

    def shape(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("html").to_pylist()]
            digests = [base32_sha1(r) for r in raw]
            first = [dict(m).get(d) if m else None for m, d in zip(part.column("firsts").to_pylist(), digests, strict=True)]
            revisit = [x is not None for x in first]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(["revisit" if v else "response" for v in revisit]),
                    part.column("url"),
                    pa.array(first, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([None if v else r for v, r in zip(revisit, raw, strict=True)], pa.binary()),
                ],
                names=["id", "record_type", "target_uri", "first", "payload_digest", "payload_length", "payload"],
            )

    light = joined.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), "firsts", F.col("html").cast("string").alias("html"))
    rows = light.mapInArrow(shape, "id bigint, record_type string, target_uri string, first bigint, payload_digest string, payload_length bigint, payload binary")
    out = rows.select(_urn(F.col("id")).alias("record_id"), "record_type", "target_uri", F.when(F.col("record_type") == "revisit", _urn(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length", "payload")
    out.write.format(FORMAT).mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payloads", str(payloads).lower()).load(path)


def warc_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Contract of the archive query: writes every page, reads the archives back.

    Responses are read with their payloads, which the reader checks against their digests; revisits by their headers
    alone, and get the length of the response that they refer to. Edge cases as in write_pages(); an empty table gives
    an empty result; extra columns aren't read.
    """
    path = fresh_path(spark, "archive")
    write_pages(pages, path)
    responses = materialise(read_pages(spark, path).where("record_type = 'response'").select(_page(F.col("record_id")).alias("page_id"), "payload_length", "payload_digest"), "responses")
    revisits = read_pages(spark, path, False).where("record_type = 'revisit'").select(_page(F.col("record_id")).alias("page_id"), "payload_digest", _page(F.col("refers_to")).alias("refers_to"))
    length = responses.groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("d")).agg(F.first("payload_length").alias("payload_bytes"))
    again = revisits.join(length, (F.col("refers_to") == F.col("id")) & (F.col("payload_digest") == F.col("d")), "left")
    first = responses.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return first.unionByName(again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
