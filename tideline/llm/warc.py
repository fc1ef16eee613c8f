"""WARC archives: a Python data source that reads them, and a writer.

Reading plans byte ranges of files as partitions; a range owns the records that begin in
it, so large archives are read by many tasks. Of each record the headers are parsed
first. Predicates on the record type and on header columns are pushed down
(``spark.sql.python.filterPushdown.enabled``) and decided on the headers alone; the
payload of a record that fails them is skipped: in plain files by its length, in
compressed ones by the skip length in the gzip member's extra field where the writer
left one (ours does), else by inflating without keeping. ``payload=false`` skips all payloads.

Writing gives one gzip member per record. Of records with equal payloads the one with
the smallest id is a response, the others are revisits of it and hold no payload.

Defined results: null html is the empty payload; a null url writes no target header;
rows that repeat the smallest id of a payload are responses; null ids count as larger
than all and name no one; other columns are not read. Records with broken headers or
lengths end the reading of their range with an error that names file and place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from tideline.llm import files, shared

NO_ID = (1 << 63) - 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # the digits that conv gives
RANGE_BYTES = 64 << 20
COLUMNS = {  # column: header
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", headers map<string,string>, http_headers map<string,string>, content_length bigint, payload binary, file string, position bigint"


# ---- one record -----------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` tells its compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<H", 8)
    size = 10 + 2 + 12 + len(body) + 8
    extra += struct.pack("<II", size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header lines after the first one; names lower-cased, folded lines joined."""
    headers: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers


# ---- reading --------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: ``payload`` (default true),
    ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((COLUMNS[column], "in", (f.value,)))
            elif column in COLUMNS and isinstance(f, In):
                self.wanted.append((COLUMNS[column], "in", tuple(f.value)))
            elif column in COLUMNS and isinstance(f, StringStartsWith):
                self.wanted.append((COLUMNS[column], "prefix", (f.value,)))
            elif column in COLUMNS and isinstance(f, IsNotNull):
                self.wanted.append((COLUMNS[column], "any", ()))
            else:
                yield f

    def keeps(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.wanted:
            value = headers.get(name)
            if value is None or (how == "in" and value not in values) or (how == "prefix" and not value.startswith(values[0])):
                return False
        return True

    def partitions(self):
        fs, path = files.place(self.folder)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        ranges = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("."):
                ranges += [Range(f.path, a, min(a + self.range_bytes, f.size)) for a in range(0, f.size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        fs, _ = files.place(self.folder)
        with fs.open_input_file(partition.path) as file:
            scan = packed_records if partition.path.endswith(".gz") else plain_records
            for at, headers, content in scan(file, partition.begin, partition.end, self.keeps, self.payload):
                http, payload = split_http(headers, content)
                size = int(headers.get("content-length", 0))
                yield (*(headers.get(h) for h in COLUMNS.values()), headers, http, size, payload, partition.path, at)


def split_http(headers: dict[str, str], content: bytes | None) -> tuple[dict[str, str] | None, bytes | None]:
    if content is None:
        return None, None
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, _, body = content.partition(b"\r\n\r\n")
        return parse_headers(head), body
    return None, content


def plain_records(file, begin: int, end: int, keeps, with_payload: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    size = file.size()
    at = _next_plain(file, begin, size)
    while at is not None and at < end:
        head = b""
        while b"\r\n\r\n" not in head:
            more = file.read_at(min(4096, size - at - len(head)), at + len(head)) if at + len(head) < size else b""
            if not more:
                raise ValueError(f"record at {at} has no end of headers")
            head += more
        block, _, _ = head.partition(b"\r\n\r\n")
        headers = parse_headers(block)
        body, length = at + len(block) + 4, int(headers["content-length"])
        if body + length > size:
            raise ValueError(f"record at {at} is cut off")
        if keeps(headers):
            yield at, headers, file.read_at(length, body) if with_payload else None
        at = body + length
        while at < size and (mark := file.read_at(min(4, size - at), at)).strip(b"\r\n") != mark:
            at += len(mark) - len(mark.lstrip(b"\r\n"))
        at = at if at < size else None


def _next_plain(file, begin: int, size: int) -> int | None:
    """The first record that begins at ``begin`` or later. Inside a payload the mark can
    stand too, so the record's own headers must be there as well."""
    if begin == 0:
        return 0 if size else None
    at, step = max(0, begin - 4), 1 << 16  # the blank line before a record at ``begin`` lies before it
    while at < size:
        data = file.read_at(min(step + 4096, size - at), at)
        k = data.find(b"\r\n\r\nWARC/1.", 0)
        while k >= 0 and k < step:
            head = file.read_at(min(4096, size - at - k - 4), at + k + 4).partition(b"\r\n\r\n")[0].lower()
            if b"warc-record-id:" in head and b"content-length:" in head:
                return at + k + 4
            k = data.find(b"\r\n\r\nWARC/1.", k + 1)
        at += step
    return None


def packed_records(file, begin: int, end: int, keeps, with_payload: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    size = file.size()
    at = _next_packed(file, begin, size)
    while at is not None and at < end:
        first = file.read_at(min(16_384, size - at), at)
        length, skip = _member_head(first)
        inflate = zlib.decompressobj(-15)
        source, place = first[length:], at + len(first)
        plain = b""
        while b"\r\n\r\n" not in plain:
            part = inflate.decompress(source, 4096)
            plain += part
            source = inflate.unconsumed_tail
            if not part and not source:
                if inflate.eof or place >= size:
                    raise ValueError(f"record at {at} has no end of headers")
                source = file.read_at(min(1 << 16, size - place), place)
                place += len(source)
        block, _, rest = plain.partition(b"\r\n\r\n")
        headers = parse_headers(block)
        wanted = keeps(headers)
        if (not wanted or not with_payload) and skip:
            if wanted:
                yield at, headers, None
            at += skip
        else:
            parts, need = [rest], int(headers["content-length"])
            while not inflate.eof:
                if not source:
                    if place >= size:
                        raise ValueError(f"record at {at} is cut off")
                    source = file.read_at(min(1 << 18, size - place), place)
                    place += len(source)
                part = inflate.decompress(source, 1 << 20)
                source = inflate.unconsumed_tail
                if wanted and with_payload:
                    parts.append(part)
            over = len(inflate.unused_data)
            content = b"".join(parts)
            if wanted:
                if with_payload and len(content) < need:
                    raise ValueError(f"record at {at} is cut off")
                yield at, headers, content[:need] if with_payload else None
            at = place - over + 8
        at = at if at < size else None


def _member_head(data: bytes) -> tuple[int, int]:
    """Length of the gzip header, and the member's length if the header tells it."""
    if data[:3] != b"\x1f\x8b\x08":
        raise ValueError("no gzip member")
    flags, at, skip = data[3], 10, 0
    if flags & 4:
        n = struct.unpack("<H", data[10:12])[0]
        extra, at = data[12 : 12 + n], 12 + n
        k = 0
        while k + 4 <= len(extra):
            size = struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if extra[k : k + 2] == b"sl" and size == 8:
                skip = struct.unpack("<I", extra[k + 4 : k + 8])[0]
            k += 4 + size
    for bit in (8, 16):
        if flags & bit:
            at = data.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0), skip


def _next_packed(file, begin: int, size: int) -> int | None:
    if begin == 0:
        return 0 if size else None
    at, step = begin, 1 << 16
    while at < size:
        data = file.read_at(min(step + 64, size - at), at)
        k = data.find(b"\x1f\x8b\x08")
        while 0 <= k < step:
            some = file.read_at(min(16_384, size - at - k), at + k)
            try:
                if zlib.decompressobj(-15).decompress(some[_member_head(some)[0] :], 8).startswith(b"WARC/1."):
                    return at + k
            except (ValueError, zlib.error, struct.error):
                pass  # these bytes only look like the beginning of a member
            k = data.find(b"\x1f\x8b\x08", k + 1)
        at += step
    return None


def read_warc(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses sources that take filters
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(folder)


# ---- writing --------------------------------------------------------------


def payload_digest(payload) -> object:
    """Bare upper-case base32 SHA-1 of a binary column, which is hashed once: ``code`` is
    a value of its own in the lambda, not the expression again for every use."""
    eights = lambda code: F.concat(*[F.lpad(F.conv(F.substring(code, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(F.get(F.transform(F.array(F.sha1(payload)), eights), 0), BASE32_HEX, BASE32)


def page_record(page_id: int | None, url: str | None, html: bytes, sha: str, first: int | None, date: str) -> bytes:
    headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers.append(("WARC-Payload-Digest", f"sha1:{sha}"))
    if first is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return record(headers, http + (html if first is None else b""))


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes ``pages`` as archives in ``folder``; gives (file, records). Of equal
    payloads of ``least_bytes`` or more, one stays a response."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"order": F.coalesce("page_id", F.lit(NO_ID)), "sha": payload_digest(F.col("html"))})
    groups = rows.where(F.octet_length("html") >= least_bytes).select("sha", "order")
    first = groups.groupBy("sha").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first < last")
    again = shared.stored(groups.join(first.select("sha", "first"), "sha").where("order > first").distinct(), "revisits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with files.Finished(folder, name) as out:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            out.write(member(info))
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, html, sha, first = (batch.column(c)[k].as_py() for c in range(5))
                    out.write(member(page_record(page_id, url, html, sha, first, date)))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    ready = rows.join(again, ["sha", "order"], "left").select("page_id", "url", "html", "sha", "first")
    return shared.stored(ready.mapInArrow(write, "file string, records long"), "archives")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A response's length and digest are taken from the payload that was read, and must
    agree with its header; a revisit's are in its headers."""
    found = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(\d+|-\d+)>$", 1)
    told, response = F.regexp_replace("payload_digest", "^sha1:", ""), F.col("record_type") == "response"
    taken = F.when(response, payload_digest(F.col("payload"))).otherwise(told)
    return found.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.element_at("http_headers", "content-length")).cast("long").alias("payload_bytes"),
        F.when(taken == told, told).otherwise(F.raise_error(F.concat(F.lit("the digest differs in "), F.col("record_id")))).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers_to").cast("long")).alias("refers_to"),
    )
