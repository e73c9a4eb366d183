"""Legacy archives to WARC: ARC header lines and declared lengths parsed by version, WARC records synthesised.

An ARC archive begins with a ``filedesc://`` record whose body names its version and its header fields.
Version 1 headers have 5 fields (URL, IP, date, type, length), version 2 has 10 (also status, checksum,
location, offset, file name). Each record becomes a WARC record with
- an identifier: a UUID of version 8 that holds the 64-bit number of the page where the archive's table gives one, else
  one of version 5 of URL, date and payload digest;
- WARC-Date from the digits of the ARC date (12 or 14 of them),
- type ``response``, or ``revisit`` with the identifier it refers to,
- block and payload digests (SHA-1, base 32).
WARC files are written by Spark's text writer, so any file system that Spark writes to will do; blocks are bytes, not text, and
stay as they are. A file is one row of at most FILE_BYTES of records, or one larger record, after a ``warcinfo`` record; it ends with an
empty line, whose last byte is the writer's line end. Files are read back a chunk at a time, also those that have a gzip member a record.

Edge cases: a null html is an empty payload, a null url is ``urn:none``, blanks in urls are escaped (an ARC header is
separated by them). Rows with null page_id are written and read back with number null, always as responses. Rows of one page_id
may have different payloads: each refers to the largest page_id that has its own. Of rows with the largest page_id and one payload
all are responses. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.shared import new_path, small_batches, stored

REVISIT_FROM = 1000
FILE_BYTES = 32 << 20
CHUNK = 1 << 20
#: Payloads of more pages than this, and than one in HEAVY of all, are joined by broadcast: so there are at most HEAVY of them.
HEAVY = 100_000
#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2000, 1, 1)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: str | None
    block: bytes

    def split(self) -> tuple[bytes, bytes]:
        """HTTP head, with its empty line, and payload; no head without one."""
        if self.block.startswith(b"HTTP/"):
            head, gap, payload = self.block.partition(b"\r\n\r\n")
            if gap:
                return head + gap, payload
        return b"", self.block


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 tidelex\n{ARC_FIELDS[version]}\n\n".encode()
    date = "20000101000000"
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(body)}\n".encode(), body, b"\n"]
    at = sum(map(len, out))
    for r in records:
        rest = "" if version == 1 else f" {r.status or '-'} - - {at} {name}"
        head = f"{r.url} {r.ip} {r.date} {r.mime}{rest} {len(r.block)}\n".encode()
        out += [head, r.block, b"\n"]
        at += len(head) + len(r.block) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive, its version block left out. Raises ValueError on a malformed one."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at byte {at} has no end")
        fields = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(fields[-1]) if fields[-1].isdigit() else -1
        block = data[end + 1 : end + 1 + size]
        if size < 0 or len(block) != size:
            raise ValueError(f"ARC record at byte {at}: wrong length")
        at = end + 1 + size
        if version is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an ARC archive begins with its version block")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        want = ARC_FIELDS[version].count(" ") + 1
        if len(fields) < want:
            raise ValueError(f"ARC version {version} header with {len(fields)} fields")
        url = "%20".join(fields[: len(fields) - want + 1])  # only a url can hold stray blanks
        rest = fields[len(fields) - want + 1 :]
        yield ArcRecord(url, rest[0], rest[1], rest[2], rest[3] if version == 2 and rest[3] != "-" else None, block)


def record_id(page_id: int | None) -> str:
    """A UUID of version 8 with the 64 bits of a page's number in it; one bit says that there is none."""
    n = (page_id or 0) & (1 << 64) - 1
    value = (0x7469646C6578 << 80) | (8 << 76) | ((n >> 62 | (page_id is None) << 2) << 64) | (2 << 62) | (n & (1 << 62) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def own_id(r: ArcRecord) -> str:
    """The identifier of a record whose page has no number: the same for the same URL, date and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.url} {r.date} {_digest(r.split()[1])}')}>"


def page_of(identifier: str) -> int | None:
    """The page's number in an identifier made by ``record_id``; None of any other."""
    try:
        value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    high = value >> 64 & 0xFFF
    if value >> 80 != 0x7469646C6578 or value >> 76 & 15 != 8 or high & 4:
        return None
    n = (high & 3) << 62 | value & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def warcinfo(date: str) -> bytes:
    block = b"software: tidelex\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo ' + date)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return _record(fields, block)


def date_of(digits: str) -> str:
    """WARC-Date of an ARC date; seconds may be missing."""
    return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def to_warc(r: ArcRecord, page_id: int | None = None, refers_to: int | None = None, numbered: bool = True) -> bytes:
    """The WARC record equivalent to an ARC record, ended by its two empty lines. ``numbered``: page_id says which page it is."""
    head, payload = r.split()
    block = head if refers_to is not None else r.block
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(page_id) if numbered else own_id(r)),
        ("WARC-Date", date_of(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return _record([*fields, ("Content-Type", "application/http; msgtype=response" if head else r.mime)], block)


def unpacked(data: bytes, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a file in chunks: of all its gzip members, or as they are if it is not compressed."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data:
        member, rest = zlib.decompressobj(31), data
        while not member.eof:
            out = member.decompress(rest, chunk)
            if not out and not member.unconsumed_tail and not member.eof:
                raise ValueError("a gzip member without an end")
            rest = member.unconsumed_tail
            yield out
        data = member.unused_data


def read_warc(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file's bytes, or of chunks of them."""
    chunks, held, at = iter([data] if isinstance(data, bytes) else data), bytearray(), 0

    def have(n: int) -> bool:
        """Whether n bytes from ``at`` on are held; reads on for them."""
        nonlocal at
        while len(held) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at > CHUNK:
                del held[:at]
                at = 0
            held.extend(more)
        return True

    while have(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not have(len(held) - at + 1):
                break
        if end < 0 or not held.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        head, size = end + 4 - at, int(headers["content-length"])
        whole = have(head + size + 4)
        block = bytes(held[at + head : at + head + size])
        if not whole or held[at + head + size : at + head + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: wrong length")
        at += head + size + 4
        yield headers, block


def _arc_of(page_id: int | None, url: str | None, html: str | None) -> ArcRecord:
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    date = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 28))
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    return ArcRecord(clean, "0.0.0.0", date.strftime("%Y%m%d%H%M%S"), "text/html", "200", head.encode() + payload)


def legacy_archives(pages: DataFrame) -> DataFrame:
    """ARC archives of ``pages(page_id, url, html[, refers_to])``, some MB each and of either version in turn:
    (arc, page_ids, refers_to), the last two in the order of the records."""

    def run(batches):
        version = 1
        for batch in batches:
            for part in K.slices(batch, "html"):
                rows = part.to_pylist()
                arc = write_arc([_arc_of(r["page_id"], r["url"], r["html"]) for r in rows], version)
                version = 3 - version
                numbers = [pa.array([[r.get(k) for r in rows]], pa.list_(pa.int64())) for k in ("page_id", "refers_to")]
                yield pa.RecordBatch.from_arrays([pa.array([arc], pa.binary()), *numbers], names=["arc", "page_ids", "refers_to"])

    return pages.mapInArrow(run, "arc binary, page_ids array<long>, refers_to array<long>")


def convert(archives: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> str:
    """Write the records of ``archives(arc[, page_ids, refers_to])`` as gzipped WARC files below ``folder``. Archives without the
    two lists, or with null ones, give records named after their own URL, date and payload."""
    lists = [c for c in ("page_ids", "refers_to") if c in archives.columns]

    def run(batches):
        held, size = [], 0

        def flush():
            whole = b"".join([warcinfo(held[0][0]), *(x for _, x in held)])
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["value"])  # the writer adds the last byte

        for batch in batches:
            for row in batch.to_pylist():
                records, ids, refers = read_arc(row["arc"]), row.get("page_ids"), row.get("refers_to")
                for k, r in enumerate(records):
                    made = to_warc(r, ids[k] if ids else None, refers[k] if refers else None, ids is not None)
                    if held and size + len(made) > file_bytes:
                        yield flush()
                        held, size = [], 0
                    held.append((date_of(r.date), made))
                    size += len(made)
        if held:
            yield flush()

    files = archives.select("arc", *lists).mapInArrow(run, "value binary").select(F.col("value").cast("string"))  # the bytes stay as they are
    files.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)
    return folder


def read_back(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the responses and revisits of all WARC files below
    ``folder``. Digests of stored payloads are computed again and must agree. A revisit's size is what its HTTP head says, null without."""

    def row_of(headers: dict[str, str], block: bytes):
        kind, head, payload = headers["warc-type"], b"", block
        if block.startswith(b"HTTP/"):
            head, _, payload = block.partition(b"\r\n\r\n")
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        digest, size = hashlib.sha1(payload).digest(), len(payload)
        if kind == "revisit":
            said = [v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
            digest, size = base64.b32decode(stated) if stated else None, int(said[0]) if said else None
        elif stated and base64.b32decode(stated) != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload is not what its header says")
        to = headers.get("warc-refers-to")
        return page_of(headers["warc-record-id"]), size, digest.hex() if digest else None, kind, page_of(to) if to else None

    def run(batches):
        kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column("content"):
                rows = [row_of(h, b) for h, b in read_warc(unpacked(content.as_py())) if h["warc-type"] in ("response", "revisit")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    files = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _digest_of(html: str):
    return F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8"))


def revisits(pages: DataFrame, at_least: int = REVISIT_FROM, heavy: int = HEAVY) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload a larger page_id has too. Only digests are grouped. Payloads of very many
    pages are joined by broadcast, at most ``heavy`` of them, so that no task gets all their pages."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    thin = stored(pages.where(F.col("page_id").isNotNull() & (size >= at_least)).select("page_id", _digest_of("html").alias("digest")), "digests")
    groups = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("*").alias("many")).where("low < refers_to")
    groups = stored(groups.select("digest", "refers_to", "many"), "groups")
    limit = max(heavy, (groups.agg(F.sum("many")).first()[0] or 0) // heavy)
    often = groups.where(F.col("many") > limit).select("digest", "refers_to")
    seldom = groups.where(F.col("many") <= limit).select("digest", "refers_to")
    both = thin.join(F.broadcast(often), "digest").unionByName(thin.join(seldom.hint("merge"), "digest"))
    return both.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def warc_round_trip(pages: DataFrame, folder: str | None = None, heavy: int = HEAVY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC archives, these to WARC files in the shared folder, and those read back."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    known = pages.withColumn("digest", _digest_of("html")).join(revisits(pages, heavy=heavy).hint("merge"), ["page_id", "digest"], "left").drop("digest")
    folder = convert(legacy_archives(known), folder or new_path(pages.sparkSession, "warc"), file_bytes)
    return read_back(pages, folder)
