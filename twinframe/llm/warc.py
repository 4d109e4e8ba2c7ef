"""Converting legacy ARC archives into WARC.

ARC files open with a version block (``filedesc://``) whose second line names the version; version 1 header lines have 5 fields,
version 2 lines 10, the last always the declared length. A record whose block is an HTTP message becomes a WARC response or revisit;
any other (``dns:``, FTP, plain files) becomes a resource with its declared media type. Each gets a name-based UUID, an ISO time from the
14 digits, the IP address and SHA-1 digests.

Files are written by Spark's text sink, so lost tasks leave nothing behind. Records are put together in chunks of bytes, a chunk is a
line of the sink, and the sink starts a new file after a fixed number of chunks; so an archive holds at most ``archive_bytes`` before
compression, and one record more for each chunk. Files are read by the binaryFile source and parsed by declared lengths alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, as_bytes, join_by_count, stage_table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISIT = 1000
#: Bytes of an archive before compression; a chunk has a 16th of them.
ARCHIVE_BYTES, CHUNKS = 64_000_000, 16
_BATCH_BYTES = 4_000_000


def arc_header(version: int, url: bytes, date: bytes, mime: bytes, length: int) -> bytes:
    """One header line of ARC version 1 or 2."""
    url = b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes((c,)) for c in url) if any(c <= 32 or c == 127 for c in url) else url
    middle = b" 200 - - 0 -" if version == 2 else b""
    return b"%s 127.0.0.1 %s %s%s %d\n" % (url or b"about:blank", date, mime, middle, length)


def version_block(version: int, date: bytes) -> bytes:
    """The first record of an ARC file, without its closing newline."""
    body = b"%d 0 legacy\n%s\n" % (version, FIELDS[version])
    return arc_header(version, b"filedesc://legacy.arc", date, b"text/plain", len(body)) + body


def _chunks(made: Iterator[tuple[int, tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their size in bytes."""
    rows, held = [], 0
    for size, row in made:
        rows.append(row)
        held += size
        if held >= _BATCH_BYTES or len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _archives(made: Iterator[bytes], first: Callable[[bytes], bytes], gap: bytes, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records joined to chunks by ``gap``; every CHUNKS-th chunk, with which the sink opens a file, starts with ``first(record)``."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([gap.join(held)], pa.binary())], names=["chunk"])

    held, size, n = [], 0, 0
    for record in made:
        if not held and n % CHUNKS == 0:
            held.append(first(record))
        held.append(record)
        size += len(record)
        if size >= archive_bytes // CHUNKS:
            yield batch()
            held, size, n = [], 0, n + 1
    if held:
        yield batch()


def _write(chunks: DataFrame, path: str, gap: str, compression: str) -> None:
    lines = chunks.select(F.col("chunk").cast("string"))
    lines.write.option("lineSep", gap).option("compression", compression).option("maxRecordsPerFile", CHUNKS).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000", compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Legacy archives of the partitions of ``pages``, even partitions in version 1 and odd in version 2.

    Each record is an HTTP response that carries the page's id and the length of its payload (null: empty). Rows that repeat are
    written each for itself; an empty table gives a folder without records. Other columns are not read.
    """
    when = date.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2

        def made() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), as_bytes(batch.column(2))):
                    html = html or b""
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n" % (b"" if page is None else str(page).encode(), len(html))
                    yield b"".join((arc_header(version, url or b"", when, b"text/html", len(http) + len(html)), http, html))

        return _archives(made(), lambda _: version_block(version, when), b"\n", archive_bytes)

    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(payload_col).cast("string").alias("p"))
    _write(rows.mapInArrow(run, "chunk binary"), path, "\n", compression)


class _Reader:
    """Reads a possibly gzipped file piece by piece."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer = memoryview(raw), 0, bytearray()
        self.zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.zip is None:
            piece = self.raw[self.at : self.at + (1 << 20)]
            self.at += len(piece)
            self.buffer += piece
            return bool(piece)
        while self.at < len(self.raw) or self.zip.eof:
            if self.zip.eof:  # another member
                rest = self.zip.unused_data
                self.at -= len(rest)
                if self.at >= len(self.raw):
                    return False
                self.zip = zlib.decompressobj(31)
            piece = self.raw[self.at : self.at + (1 << 18)]
            self.at += len(piece)
            out = self.zip.decompress(piece)
            self.buffer += out
            if out:
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, which is passed over; None at the end of the file."""
        start = 0
        while (i := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end))
            if not self._more():
                return None
        found = bytes(self.buffer[:i])
        del self.buffer[: i + len(end)]
        return found

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record ends before its declared length")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def arc_records(raw: bytes) -> Iterator[dict]:
    """The records of one ARC file after its version block: url, ip, date, mime, block."""
    reader, fields = _Reader(raw), 0
    while (line := reader.until(b"\n")) is not None:
        if not line.strip():
            continue
        parts = line.split(b" ")
        block = reader.exactly(int(parts[-1]))
        if parts[0].startswith(b"filedesc://"):
            version = int(block.split(b" ", 1)[0])
            fields = len(FIELDS[version].split())
            continue
        if len(parts) != fields:
            raise ValueError(f"a header line has {len(parts)} fields, its version {fields}")
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "mime": parts[3], "block": block}


def _http(block: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """HTTP head with its blank line, payload, and header fields by lower-case name."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        return b"", block, {}
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return head + gap, payload, fields


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()  # noqa: S324


def record_id(url: bytes, date: bytes, digest: str, page: bytes) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url.decode(errors='replace'), date.decode(), digest, page.decode())))}>"


def _page(fields: dict[bytes, bytes]) -> int | None:
    page = fields.get(b"x-page-id", b"")
    return int(page) if page.isdigit() or page[:1] == b"-" and page[1:].isdigit() else None


def _facts(record: dict) -> tuple[bool, bytes, bytes, int | None, str, str]:
    """Of an ARC record: whether it is an HTTP message, its HTTP head and payload, page id, payload digest and record id."""
    http = record["block"].startswith(b"HTTP/")
    head, body, fields = _http(record["block"]) if http else (b"", record["block"], {})
    digest = _sha1(body)
    return http, head, body, _page(fields), digest, record_id(record["url"], record["date"], digest, fields.get(b"x-page-id", b""))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(path, at, page_id, record_id, url, ip, date, mime, digest, size[, head, payload]) of the records in the ARC files of a folder.

    ``at`` numbers the records of a file from 0. Without a page id in its HTTP head, and without such a head, page_id is null.
    """
    names = ["path", "at", "page_id", "record_id", "url", "ip", "date", "mime", "digest", "size", *["head", "payload"] * payload]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 2 * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for at, r in enumerate(arc_records(raw.as_py())):
                        _, head, body, page, digest, rid = _facts(r)
                        row = (name, at, page, rid, r["url"], r["ip"].decode(), r["date"].decode(), r["mime"].decode(), digest, len(body))
                        yield (len(body), (*row, head, body)) if payload else (300, row)

        yield from _chunks(made(), names, types)

    schema = "path string, at long, page_id long, record_id string, url binary, ip string, date string, mime string, digest string, size long"
    return _files(spark, path).mapInArrow(run, schema + ", head binary, payload binary" * payload)


def iso_time(digits: str) -> bytes:
    """ISO time of up to 14 digits (year first); what is missing is the start of the year, month, day or hour."""
    d = digits[:14] + "00000101000000"[len(digits[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z".encode()


def warc_record(kind: bytes, rid: bytes, url: bytes, date: str, digest: str | None, refers: str | None, block: bytes, mime: bytes = b"application/http; msgtype=response", ip: bytes = b"") -> bytes:
    """One WARC/1.1 record without the two line ends that close it."""
    base32 = lambda hexed: base64.b32encode(bytes.fromhex(hexed))
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, b"WARC-Date: " + iso_time(date)]
    if url:
        head.append(b"WARC-Target-URI: " + url)
    if ip and ip not in (b"-", b"0.0.0.0"):
        head.append(b"WARC-IP-Address: " + ip)
    if refers:
        head += [b"WARC-Profile: " + REVISIT, b"WARC-Refers-To: " + refers.encode()]
    if digest:
        head.append(b"WARC-Payload-Digest: sha1:" + base32(digest))
    head += [b"WARC-Block-Digest: sha1:" + base32(_sha1(block)), b"Content-Type: " + mime, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def convert_record(record: dict, refers: str | None) -> bytes:
    """The WARC record of an ARC record: a response, a revisit of ``refers``, or for what is no HTTP message a resource of its media type."""
    http, head, body, _, digest, rid = _facts(record)
    rest = (record["url"], record["date"].decode(), digest)
    if not http:
        declared = b"text/dns" if record["url"].startswith(b"dns:") else record["mime"] if b"/" in record["mime"] else b"application/octet-stream"
        return warc_record(b"resource", rid.encode(), *rest, None, body, declared, record["ip"])
    return warc_record(b"revisit" if refers else b"response", rid.encode(), *rest, refers, head if refers else head + body, ip=record["ip"])


def convert(spark: SparkSession, source: str, target: str, smallest: int = SMALLEST_REVISIT, compression: str = "gzip", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the ARC files of ``source`` as WARC files in the folder ``target``.

    Of HTTP records with equal payloads of at least ``smallest`` bytes, those with the largest page id are responses and the others
    revisit the first of them; records without a page id, and resources, are never revisits. Only facts about records are shuffled, by
    digest; the revisits of a file then go to its task (broadcast up to BROADCAST_IDS of them, else the compressed files meet
    them by path), and payloads stay where they are read. A folder without records gives one without records.
    """
    facts = stage_table(read_arc(spark, source, payload=False).filter((F.col("size") >= smallest) & F.col("page_id").isNotNull()).select("path", "at", "page_id", "record_id", "digest"), "warc-facts")
    groups = facts.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max(F.struct("page_id", "record_id")).alias("m")).filter("n > 1")
    shared = stage_table(groups.select("digest", "n", "last", F.col("m.record_id").alias("refers")), "warc-shared")
    revisits = stage_table(join_by_count(facts, shared, "digest").filter("page_id < last").select("path", "at", "refers"), "warc-revisits")
    by_file = revisits.groupBy("path").agg(F.collect_list(F.struct("at", "refers")).alias("revisits"))  # bounded by the size of an archive
    rows = _files(spark, source).join(F.broadcast(by_file) if revisits.count() <= BROADCAST_IDS else by_file, "path", "left").select("content", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                for raw, own in zip(batch.column(0), batch.column(1).to_pylist()):
                    refers = {r["at"]: r["refers"] for r in own or ()}
                    for at, record in enumerate(arc_records(raw.as_py())):
                        yield convert_record(record, refers.get(at))

        def info(record: bytes) -> bytes:
            name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, 'warcinfo ' + _sha1(record))}>".encode()
            return warc_record(b"warcinfo", name, b"", "20240101000000", None, None, b"format: WARC File Format 1.1\r\n", b"application/warc-fields")

        return _archives(made(), info, b"\r\n\r\n", archive_bytes)

    _write(rows.mapInArrow(run, "chunk binary"), target, "\r\n\r\n", compression)


def warc_records(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file."""
    reader = _Reader(raw)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.strip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("a record doesn't start where the one before ends")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in lines[1:]))
        block = reader.exactly(int(fields[b"content-length"]))
        reader.exactly(4)
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, payload_bytes, payload_digest, refers_id) of the response, revisit and resource records of a folder.

    The size and digest of a response or resource are those of the payload that was read, and must agree with its header; a revisit has them in
    its headers. A folder without records gives none.
    """
    names = ["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_id"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for raw in batch.column(1):
                    for fields, block in warc_records(raw.as_py()):
                        kind = fields[b"warc-type"].decode()
                        if kind == "warcinfo":
                            continue
                        _, payload, http = (b"", block, {}) if kind == "resource" else _http(block)
                        digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
                        if kind != "revisit" and digest != _sha1(payload):
                            raise ValueError("a payload differs from its digest")
                        size = int(http[b"content-length"]) if kind == "revisit" else len(payload)
                        yield 200, (fields[b"warc-record-id"].decode(), _page(http), kind, size, digest, fields[b"warc-refers-to"].decode() if b"warc-refers-to" in fields else None)

        yield from _chunks(made(), names, types)

    return _files(spark, path).mapInArrow(run, "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_id string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Replace refers_id by refers_to, the page id of the record that it names (null: it names none, or one without a page id).

    ``records`` should be cheap to read, as a staged table is.
    """
    seen = records.filter("record_type = 'revisit'").withColumnRenamed("refers_id", "t")
    plain = records.filter("record_type != 'revisit'")
    counts = seen.filter("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    targets = plain.select(F.col("record_id").alias("t"), F.col("page_id").alias("p")).join(counts, "t").groupBy("t").agg(F.max("n").alias("n"), F.max("p").alias("refers_to"))
    found = join_by_count(seen, stage_table(targets, "warc-targets"), "t", how="left")
    made = plain.withColumn("refers_to", F.lit(None).cast("long")).drop("refers_id")
    return made.unionByName(found.select(made.columns))
