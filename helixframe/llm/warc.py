"""Legacy archive converter: ARC archives in, WARC archives out, and back to rows.

ARC files hold records one after the other: a header line of blank-separated fields, whose number depends on the version
that the file's first record (`filedesc://`) declares, then as many bytes as the line's last field says. The converter
goes by these declared lengths alone, so payloads may hold anything. It synthesises what WARC needs and ARC lacks: record
ids, dates, types and digests. Equal payloads are written once; the others become revisit records that refer to it.

Archives are written by Spark's text writer and read by its binary reader, gzipped, a stream a file. Records go to the
writer in bundles, so that a file is cut by size and not by their number; reading inflates a file as a stream. Both work on
any store that Spark reaches. Python handles only bytes of the records at hand.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from helixframe.llm.common import fresh_path

#: A file holds so many bundles, each of about so many characters (or one longer record).
FILE_BUNDLES, BUNDLE = 16, 1 << 20
#: On web pages level 4 takes a third of the default level's time for files 4 % larger.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}
#: Payloads of at least so many bytes are written once only.
DEDUP_BYTES = 1000
# The fields of a header line by ARC version, as the format defines them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
EPOCH = "20200101000000"
SEPARATOR = "\r\n\r\n"


# --- single records -------------------------------------------------------------------------------------------------


def arc_url(url: str | None) -> str:
    """A header field cannot hold white space; null and empty become a dash."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "-"


def arc_header(version: int, url: str, content_type: str, length: int, date: str = EPOCH, checksum: str = "-") -> str:
    values = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": "200", "Checksum": checksum, "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(length)}
    return " ".join(values[f] for f in ARC_FIELDS[version])


def arc_start(version: int) -> str:
    """The record that opens an ARC file and declares its version and fields."""
    block = f"{version} 0 helixframe\n{' '.join(ARC_FIELDS[version])}\n"
    return f"{arc_header(version, 'filedesc://archive.arc', 'text/plain', len(block))}\n{block}"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None) -> str:
    """An HTTP response as an ARC record; the row's id travels as an HTTP header, since ARC has no field for it."""
    body = html or ""
    size = len(body.encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {size}{SEPARATOR}"
    return f"{arc_header(version, url or '', 'text/html', len(head) + size)}\n{head}{body}"


class ByteStream:
    """Reads lines and counted bytes from gzipped or plain bytes, inflating no more than is asked for."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.at, self.step, self.buffer = memoryview(data), 0, step, bytearray()
        self.inflater = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None
        self.rest = b""

    def _more(self) -> bool:
        if not self.inflater:
            piece = bytes(self.data[self.at : self.at + self.step])
            self.at += len(piece)
            self.buffer += piece
            return bool(piece)
        while self.rest or self.at < len(self.data):
            if not self.rest:
                self.rest = bytes(self.data[self.at : self.at + self.step])
                self.at += len(self.rest)
            got = self.inflater.decompress(self.rest, 1 << 20)
            self.rest = self.inflater.unconsumed_tail or self.inflater.unused_data
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True
        return False

    def line(self) -> bytes | None:
        """Up to the next line feed, without it; None at the end."""
        start = 0
        while (end := self.buffer.find(b"\n", start)) < 0:
            start = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                break
        found = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError(f"a record declares {n} bytes, {len(self.buffer)} are left")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file with their header fields, the opening record left out."""
    stream, version = ByteStream(data), 1
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8").split(" ")
        if values[0].startswith("filedesc:"):
            block = stream.take(int(values[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if len(values) != len(ARC_FIELDS[version]):
            raise ValueError(f"an ARC {version} header line with {len(values)} fields")
        fields = dict(zip(ARC_FIELDS[version], values))
        yield fields, stream.take(int(fields["Archive-length"]))


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """HTTP head, its headers by lower-case name, body; a block that is no HTTP message is all body."""
    if not block.startswith(b"HTTP/") or (end := block.find(b"\r\n\r\n")) < 0:
        return b"", {}, block
    headers = dict(x.split(": ", 1) for x in block[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return block[: end + 4], {k.lower(): v for k, v in headers.items()}, block[end + 4 :]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_to_hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def warc_date(arc_date: str) -> str:
    """14 digits to ISO; 12 digits (of early ARC) have no seconds, and whatever is no date becomes the epoch."""
    for digits, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M")):
        if len(arc_date) == digits and arc_date.isdigit():
            try:
                return datetime.strptime(arc_date, form).replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                break
    return warc_date(EPOCH)


def record_id(page_id: int | None, url: str, date: str) -> str:
    """The same for every run and retry: a name-based UUID."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url} {date}')}>"


def warc_record(fields: dict) -> str:
    """A record of WARC 1.1, without the two line ends that close it. `fields`: what `_CONVERTED` names, and `refers_to`."""
    body = fields["payload"]
    http = fields["http_head"]
    refers = fields.get("refers_to")
    kind = "response" if refers is None else "revisit"
    block = http + body if refers is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(fields['page_id'], fields['url'], fields['date'])}", f"WARC-Date: {warc_date(fields['date'])}", f"WARC-Target-URI: {fields['url']}",
        f"WARC-Payload-Digest: sha1:{fields['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block.encode())}", "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers, fields['refers_url'], fields['refers_date'])}", f"X-Refers-To-Page-Id: {refers}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}"]) + SEPARATOR + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: headers by lower-case name, block."""
    stream = ByteStream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:20]!r}")
        headers = {}
        while line := (stream.line() or b"").rstrip(b"\r"):
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name.lower()] = value
        yield headers, stream.take(int(headers["content-length"]))


# --- archives -------------------------------------------------------------------------------------------------------


def _batches(df: DataFrame, rows: callable, schema: str, limit: int = 4 << 20) -> DataFrame:
    """Maps rows (as dicts) to tuples; a batch goes out once it holds about `limit` characters."""
    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*held)) or [()] * len(arrow), arrow)], schema=arrow)

        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    for made in rows(row):
                        held.append(made)
                        size += sum(len(x) for x in made if isinstance(x, str))
                        if size > limit or len(held) > 5000:
                            yield out()
                            held, size = [], 0
        yield out()

    return df.mapInArrow(run, parsed)


def _bundled(df: DataFrame, record: callable, separator: str, start: str = "") -> DataFrame:
    """Rows (as dicts) to records, joined to bundles, so that files can be cut by size. `start` comes before the first record of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if not held and start and n % FILE_BUNDLES == 0:
                        held.append(start)
                    held.append(record(row))
                    size += len(held[-1])
                    if size >= BUNDLE:
                        yield pa.RecordBatch.from_pydict({"value": [separator.join(held)]})
                        held, size, n = [], 0, n + 1
        if held:
            yield pa.RecordBatch.from_pydict({"value": [separator.join(held)]})

    return df.mapInArrow(run, "value string")


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", version: int = 2) -> None:
    """Writes gzipped ARC files of the given version, one record a row; each file begins with the record that declares its version."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    lines = _bundled(rows, lambda r: arc_record(version, r["page_id"], r["url"], r["html"]), "\n", arc_start(version))
    lines.write.options(maxRecordsPerFile=FILE_BUNDLES, **GZIP).option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


_CONVERTED = "page_id long, url string, date string, http_head string, payload string, payload_bytes long, digest string"


def convert(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files in `path`, with what WARC asks for (see `_CONVERTED`; digest in base 32)."""

    def rows(file: dict) -> Iterator[tuple]:
        for fields, block in read_arc(file["content"]):
            head, headers, body = split_http(block)
            page = headers.get("x-page-id", "")
            yield int(page) if page else None, fields["URL"], fields["Archive-date"], head.decode(), body.decode("utf-8"), len(body), sha1_base32(body)

    return _batches(_files(spark, path), rows, _CONVERTED)


def with_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to, refers_url, refers_date: of records with equal payloads of DEDUP_BYTES or more, all but that with the largest
    page_id (nulls first) refer to it. The counts are summed before they are shuffled; the join is one that AQE can split."""
    first = F.max(F.struct("page_id", "url", "date"))
    many = records.where(F.col("payload_bytes") >= DEDUP_BYTES).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = records.join(many, "digest", "left")
    other = (F.col("payload_bytes") >= DEDUP_BYTES) & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "url", "date", "http_head", "payload", "payload_bytes", "digest", *(F.when(other, F.col(f"first.{a}")).alias(b) for a, b in (("page_id", "refers_to"), ("url", "refers_url"), ("date", "refers_date"))))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes gzipped WARC files; records end in two line ends, as the text writer's line separator."""
    lines = _bundled(records, warc_record, SEPARATOR)
    lines.write.options(maxRecordsPerFile=FILE_BUNDLES, **GZIP).option("lineSep", SEPARATOR).text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What the WARC files in `path` say of each record: page_id, payload_bytes, payload_digest (hex), record_type, refers_to."""

    def rows(file: dict) -> Iterator[tuple]:
        for headers, block in read_warc(file["content"]):
            _, http, body = split_http(block)
            digest = headers["warc-payload-digest"]
            if headers["warc-type"] == "response" and (len(body) != int(http["content-length"]) or f"sha1:{sha1_base32(body)}" != digest):
                raise ValueError(f"{headers['warc-record-id']}: payload and headers differ")
            page, refers = http["x-page-id"], headers.get("x-refers-to-page-id")
            yield int(page) if page else None, int(http["content-length"]), base32_to_hex(digest), headers["warc-type"], int(refers) if refers is not None else None

    return _batches(_files(spark, path), rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", version: int = 2) -> DataFrame:
    """Pages to ARC files, these to WARC files, and back: a row per row of `pages`.

    Returns page_id, payload_bytes, payload_digest (hex SHA-1 of the full payload), record_type, refers_to. A null html is an
    empty payload, a null url a dash. Records that share the largest page_id of their payload (repeated rows) are all
    responses; rows with a null page_id revisit a payload's largest page_id and are responses if there is none.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, key, url, html, version)
    write_warc(with_revisits(convert(spark, arc)), warc)
    return read_back(spark, warc)
