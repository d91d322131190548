"""Legacy archive converter: ARC files (versions 1 and 2) to WARC records, written, read back.

An ARC file starts with a version block that names the version and the fields of its header
lines; each record is a header line, then as many bytes as its last field declares, then a
line feed.  Conversion keeps the block byte for byte and synthesises what WARC asks for and
ARC lacks: a record id (a name-based UUID of address, time and digest), an ISO timestamp, the
record type and the payload digest.  Of records with equal payloads one becomes a response and
the others revisits that name it and keep only the protocol's header lines.

Archives are written in the shared folder with one gzip member for each record, as the format wants it, so that a record
can be read without those before it; a file is closed at `FILE_BYTES`.  They are read back as streams: payloads are held
against their digests, and a revisit's WARC-Refers-To is resolved to the record that has that id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligspark.storage import materialize, scratch_path

# The header fields of both versions of the legacy format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = b"\r\n"
#: Records of one legacy file, at most, and compressed bytes at which a written archive file is closed.
LEGACY_RECORDS = 500
FILE_BYTES = 16 << 20
#: Responses are broadcast up to this many groups of equal payloads; beyond it only those of groups of over `COMMON` pages.
BROADCAST_GROUPS = 500_000
COMMON = 10_000
#: A gzip member without content: what Spark's text writer puts behind the members of a file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000000000")[:20]
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class LegacyRecord:
    """One ARC record: named header fields and the block of the declared length."""

    fields: dict[str, str]
    block: bytes


@dataclass
class ArchiveRecord:
    """One WARC record."""

    headers: dict[str, str]
    block: bytes


def legacy_file(records: list[LegacyRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of the version, with its version block."""
    about = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n".encode() + b"\n"
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20200101000000", "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    out = bytearray()
    for record in [LegacyRecord(first, about), *records]:
        fields = record.fields | {"Offset": str(len(out)), "Archive-length": str(len(record.block))}
        out += " ".join(fields.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + record.block + b"\n"
    return bytes(out)


def parse_legacy(data: bytes) -> Iterator[LegacyRecord]:
    """The records of an ARC file after its version block; malformed lines and lengths raise ValueError."""
    names = None
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} has no end")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        fields = FIELDS[1] if names is None else names
        # the version block of either version has the length last; only it tells the fields of what follows
        values = line.rsplit(" ", len(fields) - 1) if names is not None else line.split(" ")
        if names is not None and len(values) != len(fields):
            raise ValueError(f"header line at {at} has {len(values)} fields, not {len(fields)}")
        try:
            length = int(values[-1])
        except ValueError:
            raise ValueError(f"header line at {at} declares no length") from None
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) != length:
            raise ValueError(f"record at {at} is shorter than the {length} bytes that it declares")
        if names is None:
            lines = block.decode().split("\n")
            version = lines[0].split(" ")[0]
            if not values[0].startswith("filedesc://") or version not in ("1", "2"):
                raise ValueError("no version block")
            names = lines[1].split(" ")
            if names != FIELDS[int(version)]:
                raise ValueError(f"fields of version {version} are not as defined")
        else:
            yield LegacyRecord(dict(zip(names, values)), block)
        at = end + 1 + length
        while data[at : at + 1] == b"\n":
            at += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Protocol header lines (with their blank line) and payload."""
    at = block.find(CRLF + CRLF)
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def http_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def record_identity(url: str, moment: str, digest: str) -> str:
    """A record id that depends on address, time and payload only, so that a repeated conversion gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {moment} {digest}')}>"


def convert(record: LegacyRecord) -> ArchiveRecord:
    """The equivalent WARC record: a response if the block is a protocol response, else a resource."""
    fields = record.fields
    is_http = record.block.startswith(b"HTTP/")
    payload = split_http(record.block)[1] if is_http else record.block
    moment = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    digest = base32_sha1(payload)
    headers = {
        "WARC-Type": "response" if is_http else "resource",
        "WARC-Record-ID": record_identity(fields["URL"], fields["Archive-date"], digest),
        "WARC-Date": moment,
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "Content-Type": "application/http; msgtype=response" if is_http else fields["Content-type"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(record.block)}",
    }
    return ArchiveRecord(headers, record.block)


def as_revisit(record: ArchiveRecord, refers_to: dict[str, str]) -> ArchiveRecord:
    """The record as a revisit: its protocol header lines only, naming the record that has the payload."""
    head = split_http(record.block)[0]
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Block-Digest": f"sha1:{base32_sha1(head)}"} | refers_to
    return ArchiveRecord(headers, head)


def record_bytes(record: ArchiveRecord) -> bytes:
    """The record without the two line ends that close it."""
    headers = record.headers | {"Content-Length": str(len(record.block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode("utf-8", "surrogateescape") + CRLF + record.block


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members."""
    view = memoryview(data)
    machine, at = zlib.decompressobj(31), 0
    while at < len(view) or machine.unconsumed_tail:
        piece = machine.unconsumed_tail
        if not piece:
            piece = bytes(view[at : at + step])
            at += len(piece)
        yield machine.decompress(piece, 4 * step)
        if machine.eof:
            rest = machine.unused_data
            at -= len(rest)
            machine = zlib.decompressobj(31)


def parse_archive(pieces: Iterator[bytes]) -> Iterator[ArchiveRecord]:
    """The records of a WARC file given in pieces; holds one record and one piece."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while held[:2] == CRLF:
            del held[:2]
        while (at := held.find(CRLF + CRLF)) < 0 or held[:2] == CRLF:
            if held[:2] == CRLF and len(held) > 2:
                del held[:2]
                continue
            if not more():
                if held.strip(CRLF):
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = bytes(held[:at]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no version line")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(headers["Content-Length"])
        while len(held) < end:
            if not more():
                raise ValueError("an archive ends inside a record's block")
        yield ArchiveRecord(headers, bytes(held[at + 4 : end]))
        del held[:end]


def page_as_legacy(page_id: int | None, url: str | None, html: bytes) -> LegacyRecord:
    """A page as it stands in a legacy archive: a protocol response under its address and time."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    address = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "about:blank"))
    moment = (EPOCH + timedelta(seconds=(page_id or 0) % 86_400_000)).strftime("%Y%m%d%H%M%S")
    return LegacyRecord({"URL": address, "IP-address": "0.0.0.0", "Archive-date": moment, "Content-type": "text/html", "Result-code": "200", "Filename": "pages.arc"}, head.encode() + html)


def gzip_member(data: bytes) -> bytes:
    machine = zlib.compressobj(1, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """(url, archive_date, content_type, warc_type, record_id, payload_digest, record) of all legacy files under `path`,
    plain or gzip-compressed, each record converted; malformed files raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = b"".join(inflated(data)) if data[:2] == b"\x1f\x8b" else data
                out = [(r.fields, convert(r)) for r in parse_legacy(data)]
                columns = [[f[k] for f, _ in out] for k in ("URL", "Archive-date", "Content-type")] + [[w.headers[k] for _, w in out] for k in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([record_bytes(w) for _, w in out], pa.binary())], names=["url", "archive_date", "content_type", "warc_type", "record_id", "payload_digest", "record"])

    schema = "url string, archive_date string, content_type string, warc_type string, record_id string, payload_digest string, record binary"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, schema)


def responses_of(keyed: DataFrame, least_bytes: int) -> DataFrame:
    """(html_sha1, response_page, response_url, copies): of each group of equal payloads of `least_bytes` or more, the largest page id."""
    groups = keyed.filter(F.col("n") >= least_bytes).groupBy("html_sha1").agg(F.max("page_id").alias("response_page"), F.max_by("url", "page_id").alias("response_url"), F.count(F.lit(1)).alias("copies"))
    return groups.filter("copies > 1 and response_page is not null")


def with_responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, response_page, response_url): found before any record is made; a group of very many pages never
    meets in one task."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("html_sha1"), F.octet_length(html).alias("n"))
    responses = materialize(responses_of(keyed.drop("html"), least_bytes), "warc-responses")
    rows = keyed.drop("n")
    if responses.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(responses.drop("copies")), "html_sha1", "left")
    common = responses.filter(F.col("copies") > COMMON).drop("copies")
    if common.limit(BROADCAST_GROUPS + 1).count() > BROADCAST_GROUPS:
        return rows.join(responses.drop("copies"), "html_sha1", "left")  # over five billion pages; adaptive execution splits what is skewed
    rest = rows.join(F.broadcast(common.select("html_sha1")), "html_sha1", "left_anti").join(responses.filter(F.col("copies") <= COMMON).drop("copies"), "html_sha1", "left")
    return rows.join(F.broadcast(common), "html_sha1").unionByName(rest)


def page_records(part: pa.RecordBatch, version: int) -> Iterator[ArchiveRecord]:
    """The pages of a batch through a legacy file of the version to archive records, revisits among them."""
    rows = list(zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "response_page", "response_url"))))
    data = legacy_file([page_as_legacy(*r[:3]) for r in rows], version)
    for record, (page, _, _, response, url) in zip(parse_legacy(data), rows):
        warc = convert(record)
        if response is not None and page != response:
            named = page_as_legacy(response, url, b"").fields
            identity = record_identity(named["URL"], named["Archive-date"], warc.headers["WARC-Payload-Digest"].removeprefix("sha1:"))
            warc = as_revisit(warc, {"WARC-Refers-To": identity, "WARC-Refers-To-Target-URI": named["URL"]})
        yield warc


def archive_files(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file): gzip members of one WARC record for each page, as many in a row as make a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, bytearray()
        for batch in batches:
            for at in range(0, batch.num_rows, LEGACY_RECORDS):
                number += 1
                for warc in page_records(batch.slice(at, LEGACY_RECORDS), 1 + number % 2):
                    held += gzip_member(record_bytes(warc) + CRLF + CRLF)
                    if len(held) >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["file"])
                        held = bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["file"])

    return with_responses(pages, least_bytes).mapInArrow(run, "file binary")


def write_archives(files: DataFrame, path: str) -> None:
    """Write rows of gzip members as one file each; what the writer puts behind a row is an empty member."""
    writer = files.select(F.col("file").cast("string").alias("file")).write.option("maxRecordsPerFile", 1).option("compression", "none")
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, target_uri string, record_id string, warc_date string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The page records of all archives under `path` as they name themselves and others; digests of stored payloads are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for record in parse_archive(inflated(content.as_py())):
                    headers = record.headers
                    head, payload = split_http(record.block)
                    http = http_headers(head)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest or length")
                    page = http["x-page-id"]
                    rows.append((int(page) if page else None, int(http["content-length"]), digest, headers["WARC-Type"], headers.get("WARC-Refers-To"), headers["WARC-Target-URI"], headers["WARC-Record-ID"], headers["WARC-Date"]))
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id", "target_uri", "record_id", "warc_date")
                types = (pa.int64(), pa.int64(), *[pa.string()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`read_records` with refers_to: the page of the response whose record id a revisit names; raises on a name without a record."""
    rows = materialize(read_records(spark, path), "warc-records")
    wanted = rows.filter(F.col("refers_to_id").isNotNull()).groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("revisits"))
    named = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    table = materialize(wanted.join(named, "refers_to_id", "left"), "warc-references")
    lost = table.filter(F.col("refers_to").isNull()).select("refers_to_id").limit(3).collect()
    if lost:
        raise ValueError(f"revisits name records that are nowhere: {[r[0] for r in lost]}")
    names = table.select("refers_to_id", "refers_to")
    common = table.filter(F.col("revisits") > COMMON).select("refers_to_id", "refers_to")
    if table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        out = rows.join(F.broadcast(names), "refers_to_id", "left")
    elif common.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        rest = rows.join(F.broadcast(common.select("refers_to_id")), "refers_to_id", "left_anti")
        rest = rest.join(table.filter(F.col("revisits") <= COMMON).select("refers_to_id", "refers_to"), "refers_to_id", "left")
        out = rows.join(F.broadcast(common), "refers_to_id").unionByName(rest)
    else:
        out = rows.join(names, "refers_to_id", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "warc_date")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Convert, write and read back `pages` (page_id, url, html); one row per page as `read_archives` gives it.  Very long
    payloads are records as any other.

    Null pages are empty payloads, null addresses about:blank, null ids stay null (they are
    never chosen as the response unless no row of the group has an id; then all are
    responses).  Rows that share the largest id of a group are all responses; repeated rows
    stay repeated; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(archive_files(pages, least_bytes), path)
    return read_archives(spark, path)


def archive_sql(least_bytes: int = 0) -> str:
    """DuckDB SQL for page_id, payload_bytes, payload_digest, record_type and refers_to."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(cast('0x' || substr(h, 5 * k + 1, 5) as bigint) // {0} % 32 as int) + 1, 1)"
    four = " || ".join(letter.format(32**j) for j in (3, 2, 1, 0))  # five hexadecimal digits are four letters
    return f"""
with p as (select page_id, coalesce(html, '') as html, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
g as (select html, max(page_id) as best from p group by html)
select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda k: {four}), '') as payload_digest,
       case when payload_bytes >= {least_bytes} and page_id <> best then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {least_bytes} and page_id <> best then best end as refers_to
from p join g using (html)"""
