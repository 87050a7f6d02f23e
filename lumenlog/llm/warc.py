"""Legacy ARC archives to WARC, and both formats' readers and writers.

An archive travels as rows of a table: (archive string, segment long, content
binary), a segment holding whole records. Each version's header line names the
fields of its records' lines; a record's length is the declared one. A
conversion makes for each record a WARC record with an identifier derived from
the old record's place and content, its date, its type and its digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, scratch, split_by
from .textbytes import slices

#: Fixed values of the ARC formats: the fields of a record's line, by the version that the version block names.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_ARC_FRONT = re.compile(r"(.*?) (\S+) (\d{4,14}) (.*)")
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The HTTP header that carries a page's id through the archives.
ID_HEADER = "X-Page-Id"
#: An old record has no identifier; this name space makes one from its digest, date and URL.
ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lumenlog:arc-record")


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def type(self) -> str:
        return self.headers["WARC-Type"]


@dataclass(frozen=True)
class Original:
    """The response that a revisit refers to; name: its page's id."""

    record_id: str
    url: str
    date: str
    name: str


def base32_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def arc_version_block(name: str, version: str, date: str) -> bytes:
    body = f"{version} 0 lumenlog\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = ["filedesc://" + name, "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == "2" else []), str(len(body))]
    return " ".join(extra).encode() + b"\n" + body + b"\n"


def shown_url(url: str) -> str:
    """A URL as a record's line has it: percent-encoded beyond printable ASCII; no URL is "-"."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode()) or "-"


def arc_record(url: str, date: str, block: bytes, version: str, name: str = "-", mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """A record, its URL as shown_url has it."""
    shown = shown_url(url)
    extra = ["200", base64.b32encode(hashlib.sha1(block).digest()).decode(), "-", "0", name] if version == "2" else []
    return " ".join([shown, ip, date, mime, *extra, str(len(block))]).encode() + b"\n" + block + b"\n"


def _arc_fields(line: str, names: list[str]) -> dict[str, str] | None:
    """A record line's fields. Those behind the content type are taken from the right, as URLs and content types can hold spaces."""
    front, *tail = line.rsplit(" ", len(names) - 4)
    found = _ARC_FRONT.fullmatch(front) if len(tail) == len(names) - 4 and tail[-1].isdigit() else None
    return dict(zip(names, [*found.groups(), *tail], strict=True)) if found else None


def read_arc(data: bytes, version_block: bool = False) -> Iterator[ArcRecord]:
    """The records behind the version block, which says how to read their lines; with version_block, that too."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        size = int(line.split(" ")[-1]) if line.split(" ")[-1].isdigit() else -1
        if names is None:
            if not line.startswith("filedesc://") or size < 0:
                raise ValueError("an ARC file starts with a version block")
            lines = data[end + 1 : end + 1 + size].decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else ""
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r} is not known")
            names = ARC_FIELDS[version]
            if version_block:
                yield ArcRecord(_arc_fields(line, names) or dict(zip(ARC_FIELDS["1"], [*line.split(" ")[:4], str(size)], strict=False)), data[end + 1 : end + 1 + size])
        else:
            fields = _arc_fields(line, names)
            if fields is None:
                raise ValueError(f"an ARC record's line doesn't have the {len(names)} fields of its version: {line[:80]!r}")
            if end + 1 + size > len(data):
                raise ValueError(f"an ARC record declares {size} bytes, {len(data) - end - 1} are there")
            yield ArcRecord(fields, data[end + 1 : end + 1 + size])
        at = end + 1 + size


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """An HTTP response's head, its headers and its payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + gap, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_date(date: str) -> str:
    """An ARC date of four to fourteen digits; what it leaves out is the first month, day, hour, minute and second."""
    whole = date + "00000101000000"[len(date) :]
    return f"{whole[:4]}-{whole[4:6]}-{whole[6:8]}T{whole[8:10]}:{whole[10:12]}:{whole[12:14]}Z"


def record_id(url: str, date: str, block: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, f'{url} {date} {hashlib.sha1(block).hexdigest()}')}>"


def to_warc(record: ArcRecord, original: Original | None = None) -> WarcRecord:
    """The WARC record of an old one: a version block is a warcinfo, an HTTP message a response, anything else (dns:, ftp:) a resource of its own content type.

    With original, the response whose payload this one repeats, it is a revisit
    without the payload.
    """
    url, date = record.fields["URL"], record.fields["Archive-date"]
    about = url.startswith("filedesc://")
    http = not about and record.block.startswith(b"HTTP/")
    head, _, payload = split_http(record.block) if http else (b"", {}, record.block)
    block = record.block if original is None else head
    headers = {"WARC-Type": "warcinfo" if about else "revisit" if original is not None else "response" if http else "resource", "WARC-Record-ID": record_id(url, date, record.block), "WARC-Date": warc_date(date)}
    if about:
        headers["WARC-Filename"] = url.removeprefix("filedesc://")
    else:
        headers |= {"WARC-Target-URI": url, "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": base32_digest(payload)}
    headers |= {"WARC-Block-Digest": base32_digest(block), "Content-Type": "application/http; msgtype=response" if http else record.fields["Content-type"], "Content-Length": str(len(block))}
    if original is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original.record_id, "WARC-Refers-To-Target-URI": original.url, "WARC-Refers-To-Date": warc_date(original.date), "WARC-Refers-To-Page": original.name}
    return WarcRecord(headers, block)


def write_warc(record: WarcRecord) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode() + record.block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} doesn't end where it says")
        if headers.get("WARC-Block-Digest", base32_digest(block)) != base32_digest(block):
            raise ValueError(f"the WARC record at byte {at} doesn't have its digest")
        yield WarcRecord(headers, block)
        at = end + 8 + size


def convert(arc: bytes, originals: Iterable[Original | None] = (), warcinfo: bool = False) -> Iterator[WarcRecord]:
    """An ARC file's records as WARC records; with warcinfo, its version block too, first. originals: in the records' order, the response that each repeats, if any."""
    told = iter(originals)
    for record in read_arc(arc, warcinfo):
        yield to_warc(record, None if record.fields["URL"].startswith("filedesc://") else next(told, None))


def archive_pages(pages: DataFrame, least: int = 1000, segment_bytes: int = 4_000_000, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC segments, versions in turn, and those to WARC segments: (archive, segment, content), gzip members by record.

    Of rows with equal payloads of at least `least` bytes, those with the
    largest id are responses and the others revisit it; smaller payloads are
    all responses. Which rows have company is counted from digests alone; of the
    payloads only those whose digest repeats, and a few others, are shuffled. A
    null html is an empty payload, a null url "-"; a null id is smaller than
    any, and a group of null ids only is all responses. An empty table gives no
    rows; other columns are not read.
    """
    need(pages, id_col, url_col, html_col)
    rows = pages.select(pages[id_col].cast("string").alias("id"), pages[id_col].alias("number"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    top = keyed.where("digest is not null").groupBy("digest").agg(F.max(F.struct("number", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    repeats = scratch(top.select(F.col("digest").alias("d"), F.col("top.number").cast("string").alias("largest"), F.col("top.url").alias("its_url")), "repeats")
    some, others = split_by(keyed, F.col("digest"), repeats.select("d"))
    refers = F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))
    joined = some.join(repeats, some["digest"] == repeats["d"], "left").select("id", "url", "payload", refers.alias("refers"), "its_url")
    joined = joined.union(others.select("id", "url", "payload", F.lit(None).cast("string"), F.lit(None).cast("string")))

    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        version = "12"[part % 2]
        name = f"pages-{part:06d}"
        opening = arc_version_block(name + ".arc", version, date)
        records, size, originals = [], 0, []

        def message(i: str | None, payload: bytes) -> bytes:
            return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{ID_HEADER}: {'' if i is None else i}\r\n\r\n".encode() + payload

        def flush():
            warc = b"".join(gzip.compress(write_warc(w), 1, mtime=0) for w in convert(opening + b"".join(records), originals, warcinfo=True))
            return pa.RecordBatch.from_arrays([pa.array([name + ".warc.gz"]), pa.array([segment]), pa.array([warc], type=pa.binary())], ["archive", "segment", "content"])

        for batch in slices(batches, 2):
            for i, url, payload, to, its_url in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                records.append(arc_record(url, date, message(i, payload), version, name + ".arc"))
                originals.append(None if to is None else Original(record_id(shown_url(its_url), date, message(to, payload)), shown_url(its_url), date, to))
                size += len(records[-1])
                if size >= segment_bytes:
                    yield flush()
                    records, size, originals, segment = [], 0, [], segment + 1
        if records:
            yield flush()

    return joined.mapInArrow(run, "archive string, segment long, content binary")


def read_pages(archives: DataFrame, id_type: str = "bigint", id_col: str = "page_id") -> DataFrame:
    """What WARC segments say of each record: (id_col, url, payload_bytes, payload_digest, record_type, refers_to).

    A response's digest and length are those of the payload that is there; a
    revisit's are what its head declares of the full payload.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in read_warc(gzip.decompress(content.as_py())):
                    if record.type not in ("response", "revisit"):
                        continue
                    _, http, payload = split_http(record.block)
                    whole = record.type == "response"
                    digest = hashlib.sha1(payload).hexdigest() if whole else hex_digest(record.headers["WARC-Payload-Digest"])
                    if digest != hex_digest(record.headers["WARC-Payload-Digest"]):
                        raise ValueError(f"{record.headers['WARC-Record-ID']} doesn't have its payload's digest")
                    rows.append((http[ID_HEADER] or None, record.headers["WARC-Target-URI"], len(payload) if whole else int(http["Content-Length"]), digest, record.type, record.headers.get("WARC-Refers-To-Page")))
                names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers"]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kinds[k]) for k in range(6)], names)

    read = archives.select("content").mapInArrow(run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers string")
    return read.select(F.col("id").cast(id_type).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 1000, id_col: str = "page_id") -> DataFrame:
    """Archive the pages in the shared folder and read the archives back; a row for each page, see archive_pages."""
    archives = scratch(archive_pages(pages, least, id_col=id_col), "warc")
    return read_pages(archives, pages.schema[id_col].dataType.simpleString(), id_col)


def export_files(archives: DataFrame, folder: str) -> Iterable[str]:
    """Write each archive as a file in a folder that the driver can open; segments stream through in order, one at a time."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in archives.orderBy("archive", "segment").toLocalIterator():
        path = os.path.join(folder, row["archive"])
        with open(path, "ab" if path in names[-1:] else "wb") as f:
            f.write(row["content"])
        if path not in names[-1:]:
            names.append(path)
    return names
