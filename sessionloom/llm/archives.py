"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC file is a row of records: a header line of fields parted by spaces, then as many bytes as the line's last field declares, then a line break. The
first record (`filedesc:`) names the version and the fields of the lines that follow: version 1 has url, address, date, type and length; version 2
adds result code, checksum, location, offset and file name. Lines are split from the right, so that a url may hold spaces.

`read_arc` reads files with Spark's binaryFile source, one file a task at most, and unpacks them piece by piece (plain, or gzip with one or many members),
so a task holds a packed file and one record. `to_warc` gives each record what it has in WARC: an identifier (UUID of version 5 from file name and offset, so
a repeated run agrees), the date in ISO form, a type (filedesc is warcinfo, an HTTP reply is response, everything else resource), the media type, and the
SHA-256 of block and payload. `mark_revisits` makes repeats of a payload revisits of its first record. `write_warc` and `read_warc` write and read the archives; a
revisit has no payload, its length is that of the record it refers to (`resolve`).

Archives are written by Spark's text sink, whose line separator is the format's record separator; bytes that aren't UTF-8 stay as they are. Every
`per_file` records begin a new file with its own first record.

Work: payloads are shuffled once, for the join with their first records (two numbers and a digest of each payload that recurs). A digest that
many records share is `salts` keys.

Defined results: a header line that can't be parsed, and all after it up to the next line that can, is one row with `problem` set to header; a
record shorter than declared keeps what is there and has problem truncated; bytes that can't be unpacked end their file with problem packing. None of
these drops a whole file. Null urls are written as `unknown:`; white space in urls is percent-encoded, and so is the colon of a url that would be taken for a version record. Null payloads are empty. Dates that aren't 4 to 17 digits, nulls too, are written as the epoch. Repeated rows are records of
their own. Records of equal payloads are ordered by key (nulls last), then identifier. Empty folders and tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

# Names and order of the fields of a header line, by version of the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the UUID namespace for URLs

_PIECE = 1 << 20
_PACKED = 1 << 16
_SENT = 8 << 20
_COMMON = "file string, offset long, url string, date string, mime string, declared long, head binary, payload binary, payload_bytes long, payload_digest string, problem string"
ARC_ROW = f"version int, ip string, status int, {_COMMON}"
WARC_ROW = f"record_id string, record_type string, refers_to_id string, stated_digest string, {_COMMON}"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


class _Bytes:
    """The bytes of a file in order, unpacked as they are asked for."""

    def __init__(self, raw: memoryview):
        self.pieces, self.held, self.at, self.passed, self.broken = self._unpacked(raw), bytearray(), 0, 0, False

    def _unpacked(self, raw: memoryview) -> Iterator[bytes]:
        if bytes(raw[:2]) != b"\x1f\x8b":
            for i in range(0, len(raw), _PIECE):
                yield bytes(raw[i : i + _PIECE])
            return
        at = 0
        while bytes(raw[at : at + 2]) == b"\x1f\x8b":  # anything else after a member is filling
            unpack = zlib.decompressobj(31)
            while not unpack.eof and at < len(raw):
                piece = raw[at : at + _PACKED]
                at += len(piece)
                try:
                    yield unpack.decompress(piece)
                except zlib.error:
                    self.broken = True
                    return
            self.broken |= not unpack.eof
            at -= len(unpack.unused_data)

    @property
    def place(self) -> int:
        return self.passed + self.at

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > _PIECE:
            del self.held[: self.at]
            self.passed, self.at = self.passed + self.at, 0
        self.held += piece
        return True

    def line(self) -> bytes | None:
        """Up to the next line break, without it; None at the end."""
        looked = self.at
        while (end := self.held.find(b"\n", looked)) < 0:
            ahead = len(self.held) - self.at
            if not self._more():
                end = len(self.held)
                break
            looked = self.at + ahead
        out = bytes(self.held[self.at : end])
        if not out and end == len(self.held):
            return None
        self.at = min(end + 1, len(self.held))
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """The next n bytes, or those that are left."""
        while len(self.held) - self.at < n and self._more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def split_http(block: bytes) -> tuple[bytes | None, bytes]:
    """Head of an HTTP reply with its closing empty line, and what follows; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None, block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, n = min(ends)
    return block[: at + n], block[at + n :]


def arc_header(line: bytes, names: list[str]) -> dict[str, str] | None:
    """Fields of a header line; None if it isn't one."""
    values = _text(line).rsplit(" ", len(names) - 1)
    if len(values) != len(names):
        return None
    found = dict(zip(names, values, strict=True))
    date, length = found.get("Archive-date", ""), found.get("Archive-length", "")
    fine = found.get("URL") and date.isdigit() and date.isascii() and 4 <= len(date) <= 17 and length.isdigit() and length.isascii()
    return found if fine else None


def _version(content: bytes) -> tuple[int, list[str]]:
    """Version and field names that a version record states."""
    lines = _text(content).split("\n")
    first = lines[0].split(" ")[0]
    version = int(first) if first in ("1", "2") else 1
    names = lines[1].strip().split(" ") if len(lines) > 1 else []
    return version, names if {"URL", "Archive-date", "Archive-length"} <= set(names) else FIELDS[version]


def _parted(block: bytes, payloads: bool) -> dict:
    head, payload = split_http(block)
    return {"head": head, "payload": payload if payloads else None, "payload_bytes": len(payload), "payload_digest": sha256(payload).hexdigest()}


def arc_records(raw: memoryview, payloads: bool) -> Iterator[dict]:
    """Records of one file in order."""
    stream, version, names, lost = _Bytes(raw), 1, FIELDS[1], False
    while True:
        offset = stream.place
        line = stream.line()
        if line is None:
            break
        if not line.strip():
            continue
        # A version record's own line has the fields of the version that it is about to state.
        tried = (FIELDS[2], FIELDS[1]) if line.startswith(b"filedesc:") else (names,)
        head = next((h for n in tried if (h := arc_header(line, n))), None)
        if head is None:
            if not lost:
                yield {"offset": offset, "problem": "header"}
            lost = True
            continue
        lost, declared = False, int(head["Archive-length"])
        content = stream.take(declared)
        if head["URL"].startswith("filedesc:"):
            version, names = _version(content)
        status = head.get("Result-code", "")
        yield _parted(content, payloads) | {
            "version": version, "offset": offset, "url": head["URL"], "ip": head.get("IP-address"), "date": head["Archive-date"], "mime": head.get("Content-type"),
            "status": int(status) if status.isdigit() and len(status) < 6 else None, "declared": declared,
            "problem": "truncated" if len(content) < declared else None,
        }
    if stream.broken:
        yield {"offset": stream.place, "problem": "packing"}


def warc_records(raw: memoryview, payloads: bool) -> Iterator[dict]:
    """Records of one file in order."""
    stream, lost = _Bytes(raw), False
    while True:
        offset = stream.place
        line = stream.line()
        if line is None:
            break
        if not line.strip():
            continue
        found: dict[str, str] = {}
        if line.startswith(b"WARC/"):
            while line := stream.line():
                name, colon, value = _text(line).partition(":")
                found |= {name.strip().lower(): value.strip()} if colon else {}
        length = found.get("content-length", "")
        if not (length.isdigit() and length.isascii()):
            if not lost:
                yield {"offset": offset, "problem": "header"}
            lost = True
            continue
        lost, declared = False, int(length)
        content = stream.take(declared)
        yield _parted(content, payloads) | {
            "offset": offset, "record_id": found.get("warc-record-id"), "record_type": found.get("warc-type"), "url": found.get("warc-target-uri"),
            "date": found.get("warc-date"), "mime": found.get("content-type"), "refers_to_id": found.get("warc-refers-to"),
            "stated_digest": found.get("warc-payload-digest"), "declared": declared, "problem": "truncated" if len(content) < declared else None,
        }
    if stream.broken:
        yield {"offset": stream.place, "problem": "packing"}


def _read(spark: SparkSession, folder: str, parse, row: str, payloads: bool) -> DataFrame:
    kinds = [f.split(" ") for f in row.split(", ")]

    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], _ARROW[k]) for n, k in kinds], [n for n, _ in kinds])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, content in zip(part.column("path"), part.column("content"), strict=True):
                found, size = [], 0
                for record in parse(memoryview(content.as_buffer()), payloads):
                    found.append(record | {"file": path.as_py().rsplit("/", 1)[-1]})
                    size += 200 + len(record.get("head") or b"") + len(record.get("payload") or b"")
                    if size > _SENT:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(rows, row)


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all ARC files of a folder, with problems as rows (`ARC_ROW`)."""
    return _read(spark, folder, arc_records, ARC_ROW, payloads)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all WARC files of a folder, with problems as rows (`WARC_ROW`)."""
    return _read(spark, folder, warc_records, WARC_ROW, payloads)


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p).cast("binary") if isinstance(p, str) else p.cast("binary") for p in parts))


def _begins_file(per_file: int) -> Column:
    """The rows of a partition that open a new file, when files are closed after `per_file` rows."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) % per_file == 0


def _write(rows: DataFrame, value: Column, opening: Column, separator: str, folder: str, per_file: int) -> None:
    with_opening = F.when(_begins_file(per_file), F.concat(opening, F.lit(separator).cast("binary"), value)).otherwise(value)
    writer = rows.select(with_opening.cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(folder)


def write_arc(captures: DataFrame, folder: str, version: int = 1, per_file: int = 1_000) -> None:
    """ARC files of captures: url, ip, date (up to 14 digits), mime, status, content (bytes as received)."""
    listed = " ".join(FIELDS[version])
    described = f"{version} 0 archive\n{listed}\n"
    rest = "" if version == 1 else " 200 - - 0 records"
    opening = _bytes(f"filedesc://records.arc 0.0.0.0 19960101000000 text/plain{rest} {len(described)}\n{described}")
    url = F.regexp_replace(F.coalesce(F.when(F.col("url") != "", F.col("url")), F.lit("unknown:")), r"\s", "%20")
    url = F.regexp_replace(url, "^filedesc:", "filedesc%3A")
    plain = lambda c: F.coalesce(F.when(F.col(c) != "", F.regexp_replace(c, r"\s+", "")), F.lit("-"))
    content = F.coalesce("content", F.lit("").cast("binary"))
    date = F.coalesce(F.when(F.col("date").rlike("^[0-9]{4,17}$"), F.col("date")), F.lit("19700101000000"))
    fields = [url, plain("ip"), date, plain("mime")]
    if version == 2:
        fields += [F.coalesce(F.col("status").cast("string"), F.lit("-")), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("records")]
    line = F.concat_ws(" ", *fields, F.octet_length(content).cast("string"))
    _write(captures, _bytes(line, "\n", content), opening, "\n", folder, per_file)


def name_uuid(name: Column) -> Column:
    """UUID of version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def iso_date(digits: Column) -> Column:
    """YYYYMMDDhhmmss, or its beginning or more, as an ISO time; what is missing is the first month or day, or zero."""
    filled = F.concat(F.substring(digits, 1, 14), F.substr(F.lit("00000101000000"), F.least(F.length(digits), F.lit(14)) + 1))
    part = lambda at, n: F.substring(filled, at, n)
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))


def to_warc(records: DataFrame) -> DataFrame:
    """ARC records with record_id, record_type, warc_date, content_type and block; problems other than truncation have none and are left out."""
    kept = records.where(F.col("url").isNotNull())
    kind = F.when(F.col("url").startswith("filedesc:"), "warcinfo").when(F.col("head").isNotNull(), "response").otherwise("resource")
    mime = F.when(kind == "response", "application/http;msgtype=response").when(F.coalesce("mime", F.lit("-")) == "-", "application/octet-stream").otherwise(F.col("mime"))
    return kept.withColumns({
        "record_id": F.concat(F.lit("<urn:uuid:"), name_uuid(F.concat_ws("#", "file", "offset")), F.lit(">")),
        "record_type": kind, "warc_date": iso_date(F.col("date")), "content_type": mime,
    })


def met(rows: DataFrame, heads: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Left join with rows that are unique by `on`; a value that many rows share is dealt over several tasks. Nulls meet nothing."""
    keys = [*on, "_salt"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    return salted.join(heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), keys, "left").drop("_salt")


def first_records(records: DataFrame, key: str, least: int = 100) -> DataFrame:
    """payload_digest and payload_bytes of payloads of at least `least` bytes that recur among responses, with their first record."""
    place = F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("key"), F.col("record_id").alias("id"), F.col("url").alias("url"), F.col("warc_date").alias("date"))
    counted = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least))
    counted = counted.groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return counted.select("payload_digest", "payload_bytes", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))


def mark_revisits(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """Records with refers_to_id, refers_to_url and refers_to_date; repeats of a payload become revisits."""
    out = met(records, firsts, ["payload_digest", "payload_bytes"])
    again = (F.col("record_type") == "response") & F.col("first_id").isNotNull() & (F.col("first_id") != F.col("record_id"))
    named = {f"refers_to_{n}": F.when(again, F.col(f"first_{n}")) for n in ("id", "url", "date")}
    return out.withColumns(named | {"record_type": F.when(again, "revisit").otherwise(F.col("record_type"))}).drop("first_id", "first_url", "first_date")


def write_warc(records: DataFrame, folder: str, per_file: int = 1_000) -> None:
    """WARC files of records as `to_warc` and `mark_revisits` give them; a revisit keeps the head of its reply only."""
    nothing = F.lit("").cast("binary")
    again = F.col("record_type") == "revisit"
    block = F.concat(F.coalesce("head", nothing), F.when(again, nothing).otherwise(F.coalesce("payload", nothing)))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    described = "software: sessionloom\r\nformat: WARC File Format 1.0\r\n"
    info = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: warcinfo\r\n"), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), name_uuid(F.concat(F.lit("info "), "record_id")), F.lit(">"))),
        line("WARC-Date", F.col("warc_date")), F.lit(f"Content-Type: application/warc-fields\r\nContent-Length: {len(described)}\r\n\r\n{described}"),
    )
    headers = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("url"))), line("WARC-IP-Address", F.when(F.col("ip") != "-", F.col("ip"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Profile", F.when(again, REVISIT_PROFILE)), line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        line("WARC-Refers-To-Date", F.col("refers_to_date")), line("WARC-Truncated", F.when(F.col("problem") == "truncated", "disconnect")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    _write(records, _bytes(headers, block), info.cast("binary"), "\r\n\r\n", folder, per_file)


def resolve(records: DataFrame, key: str) -> DataFrame:
    """Records as read, with `refers_to`: the key of the record that a revisit refers to; its payload's length and digest are taken from there."""
    wanted = records.where(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = records.join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_id"))
    targets = targets.agg(F.min(key).alias("refers_to"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest"))
    out = met(records, targets, ["refers_to_id"])
    again = F.col("record_type") == "revisit"
    return out.withColumns({
        "payload_bytes": F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")),
    }).drop("_bytes", "_digest")


def page_captures(pages: DataFrame, date: Column | str = "20010101000000", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as the replies of a web server, their id in a header of the reply."""
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit("").cast("binary"))
    named = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col(page_id).cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), named, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(url).alias("url"), F.lit("0.0.0.0").alias("ip"), (F.lit(date) if isinstance(date, str) else date).alias("date"), F.lit("text/html").alias("mime"),
        F.lit(200).alias("status"), _bytes(head, body).alias("content"),
    )


def page_id_of(head: Column) -> Column:
    """The page id of a reply's head, null if it has none."""
    found = F.regexp_extract(head.cast("string"), r"(?:^|\n)X-Page-Id: (-?[0-9]+)\r?\n", 1)
    return F.when(found != "", found.cast("long"))


def convert(spark: SparkSession, legacy: str, folder: str, key: Column | None = None, least: int = 100, per_file: int = 1_000) -> None:
    """All ARC files of one folder as WARC files of another; `key` orders records of equal payloads (default: by identifier)."""
    keyed = lambda df: to_warc(df).withColumn("_key", F.col("record_id") if key is None else key)
    small = cut_lineage(first_records(keyed(read_arc(spark, legacy, payloads=False)), "_key", least))
    write_warc(mark_revisits(keyed(read_arc(spark, legacy)), small), folder, per_file)
