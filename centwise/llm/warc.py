"""Legacy archive converter: ARC files of either version to WARC/1.1 (operator 5).

``write_arc`` lays pages down as ARC files (version 1 or 2), ``read_arc`` parses ARC files by
their version block, header lines and declared lengths, ``convert`` turns each into a WARC file,
synthesising what a WARC record needs and ARC lacks - record id, ISO timestamp, type, block and payload
digests - and ``read_warc`` reads those back.  Files are written by Spark's text writer and read by its
binary reader, so any store that Spark reaches will do; they are gzip-compressed as a whole, at the
writer's fastest level (``LEVEL``).

Types: of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page id (then record id) is the response; the others become revisits, without payload, that refer
to it.  The choice is an aggregation by digest over the heads, so a payload that a third of all pages
share is one row per task.  Its outcome is one row per archive, the positions of its revisits, which
meets the archives' bytes where these are read: broadcast up to ``BROADCAST_REVISITS`` revisits in all
(some 100 bytes each), beyond that by a join that shuffles the archives as they are, compressed.
No payload is unpacked, repacked or shuffled by itself.

An archive is as large as one input split of the scan that feeds it
(``spark.sql.files.maxPartitionBytes``); a reader holds one archive, compressed, per task.

Defined cases: null html is an empty payload; a null url becomes ``about:blank``; blanks in urls
are percent-encoded, so that header lines keep their fields; a null page_id stays null and sorts
after all others; repeated rows are records of their own (one of them the response); an empty table
gives archives without records; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.llm.common import materialize, pieces, read, shared_path

MIN_REVISIT = 100
LEVEL = "BEST_SPEED"             # of gzip, as the Hadoop codec names it
BROADCAST_REVISITS = 300_000     # some 30 MB
ARC_DATE = "20010131000000"      # the capture time that made-up archives carry
# The URL-record definitions of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK_CODES = str.maketrans({c: f"%{ord(c):02X}" for c in " \t\n\x0b\x0c\r"})


# ---- ARC ---------------------------------------------------------------------------

def arc_line(version: int, url: str, mime: str, length: int, status: str, checksum: str, offset: int, name: str) -> bytes:
    line = f"{url} 0.0.0.0 {ARC_DATE} {mime} "
    if version == 2:
        line += f"{status} {checksum} - {offset} {name} "
    return f"{line}{length}\n".encode()


def arc_head(version: int, name: str) -> bytes:
    """The version block, which is a record of its own."""
    block = f"{version} 0 centwise\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", "text/plain", len(block), "200", "-", 0, name) + block


def write_arc(pages: DataFrame, path: str, version: int) -> None:
    """One ARC file per task; each record is the HTTP response of a page."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"centwise-{uuid.uuid4().hex}.arc"
        head = arc_head(version, name)
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary())], names=["record"])
        offset = len(head) + 1
        for batch in pieces(batches, 64):
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode()
                http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                        f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n").encode() + body
                line = arc_line(version, (url or "about:blank").translate(_BLANK_CODES), "text/html", len(http), "200",
                                hashlib.md5(http).hexdigest() if version == 2 else "-", offset, name)
                out.append(line + http)
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (pages.select("page_id", "url", "html").mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("compression", "gzip").option("zlib.compress.level", LEVEL).option("lineSep", "\n").text(path))


class Unzipped:
    """Reads a gzip-compressed byte string bit by bit."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left = memoryview(data), 0, b""
        self.zip = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.data):
            part = self.data[self.at:self.at + (1 << 16)]
            got = self.zip.decompress(part)
            self.at += len(part) - len(self.zip.unused_data)
            if self.zip.eof:                       # the next gzip member
                self.zip = zlib.decompressobj(31)
            if got:
                self.left += got
                return True
        return False

    def line(self) -> bytes | None:
        """Up to the next line feed, without it; None at the end."""
        seen = 0
        while (cut := self.left.find(b"\n", seen)) < 0:
            seen = len(self.left)
            if not self._more():
                if not self.left:
                    return None
                self.left, out = b"", self.left
                return out
        out, self.left = self.left[:cut], self.left[cut + 1:]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.left], len(self.left)
        self.left = b""
        while have < n:
            if not self._more():
                raise ValueError(f"archive ends {n - have} bytes early")
            parts.append(self.left)
            have += len(self.left)
            self.left = b""
        whole = b"".join(parts)
        self.left = whole[n:]
        return whole[:n]


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, blank, body = block.partition(b"\r\n\r\n")
    return (head, body) if blank else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1") or None
    return None


def arc_records(data: bytes) -> Iterator[dict]:
    """The records after the version block; the header fields are those that the block declares."""
    source = Unzipped(data)
    fields: list[str] | None = None
    version = 0
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        block = source.take(length)
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no ARC version block")
            about = block.decode().split("\n")
            version = int(about[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = about[1].split(" ")
            continue
        if len(parts) < len(fields):
            raise ValueError(f"header line of {len(parts)} fields, {len(fields)} declared")
        # a url with blanks: what the other fields leave over belongs to it
        extra = len(parts) - len(fields)
        values = ["%20".join(parts[:extra + 1]), *parts[extra + 1:]]
        yield dict(zip(fields, values)) | {"version": version, "block": block}


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _converted(archive: str, data: bytes) -> Iterator[tuple]:
    """(place, record id, date, record, HTTP head, payload, its digest) of an archive's records."""
    name = archive.rpartition("/")[2]
    for at, r in enumerate(arc_records(data)):
        head, body = split_http(r["block"])
        digest = hashlib.sha256(body).hexdigest()
        d = r["Archive-date"]
        yield (at, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}#{digest}')}",
               f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", r, head, body, digest)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, at, record_id, page_id, url, date, mime, payload_bytes, payload_digest) of every record."""
    schema = ("archive string, at int, record_id string, page_id long, url string, date string, mime string, "
              "payload_bytes long, payload_digest string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "at", "record_id", "page_id", "url", "date", "mime", "payload_bytes", "payload_digest"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in pieces(batches, 1):
            archive, rows = batch.column("path")[0].as_py(), []
            for at, record_id, date, r, head, body, digest in _converted(archive, batch.column("content")[0].as_py()):
                page_id = http_field(head, "X-Page-Id")
                rows.append((archive, at, record_id, None if page_id is None else int(page_id), r["URL"], date, r["Content-type"],
                             len(body), digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _archives(spark, path).mapInArrow(run, schema)


# ---- WARC --------------------------------------------------------------------------

def revisits(heads: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(archive, revisits array<struct<at, refers_to_id>>): the records of ``read_arc`` that repeat the
    payload of another one, which they refer to, by archive (an archive's records bound the array)."""
    who = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record_id"))
    first = (heads.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
             .agg(F.min(who).alias("who"), F.count("*").alias("n")).where("n > 1")
             .select("payload_digest", F.col("who.record_id").alias("refers_to_id")))
    return (heads.select("archive", "at", "record_id", "payload_digest").join(first, "payload_digest")
            .where(F.col("record_id") != F.col("refers_to_id"))
            .groupBy("archive").agg(F.collect_list(F.struct("at", "refers_to_id")).alias("revisits")))


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to the last line end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n"


def convert(spark: SparkSession, path: str, repeats: DataFrame, out: str) -> None:
    """The ARC files at ``path`` as WARC files at ``out``, a warcinfo record first in each; ``repeats``
    are their ``revisits``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            archive, data, again = (batch.column(c)[0].as_py() for c in ("path", "content", "revisits"))
            refers = {r["at"]: r["refers_to_id"] for r in again or ()}
            name = archive.rpartition("/")[2]
            records = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive)}>"),
                                    ("WARC-Date", "2001-01-31T00:00:00Z"), ("WARC-Filename", f"{name}.warc"),
                                    ("Content-Type", "application/warc-fields")],
                                   b"software: centwise\r\nformat: WARC File Format 1.1\r\n")]
            held = 0
            for at, record_id, date, r, head, _, digest in _converted(archive, data):
                block = r["block"] if at not in refers else head + b"\r\n\r\n"
                fields = [("WARC-Type", "revisit" if at in refers else "response"), ("WARC-Record-ID", f"<{record_id}>"),
                          ("WARC-Date", date), ("WARC-Target-URI", r["URL"]),
                          ("WARC-Payload-Digest", f"sha256:{digest}"),
                          ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                          ("WARC-Identified-Payload-Type", r["Content-type"]),
                          ("Content-Type", "application/http; msgtype=response")]
                if at in refers:
                    fields[2:2] = [("WARC-Refers-To", f"<{refers[at]}>"), ("WARC-Profile", REVISIT_PROFILE)]
                records.append(warc_record(fields, block))
                held += len(block)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
                    records, held = [], 0
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    r = repeats.withColumnRenamed("archive", "path")
    few = (repeats.agg(F.sum(F.size("revisits"))).first()[0] or 0) <= BROADCAST_REVISITS
    (_archives(spark, path).join(F.broadcast(r) if few else r, "path", "left").select("path", "content", "revisits")
     .mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("compression", "gzip").option("zlib.compress.level", LEVEL).option("lineSep", "\r\n").text(out))


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record, by declared length."""
    source = Unzipped(data)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where the declared length ends")
        fields = {}
        while (line := source.line() or b"").strip():
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, source.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits: (record_id, record_type, page_id, url, date, payload_bytes,
    payload_digest, refers_to_id).  Block digests are verified, and payload digests of responses;
    a revisit's size is that which its HTTP head declares."""
    names = ["record_id", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "refers_to_id"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = []
            for f, block in warc_records(batch.column("content")[0].as_py()):
                if f["warc-type"] not in ("response", "revisit"):
                    continue
                if f["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                    raise ValueError(f"block digest of {f['warc-record-id']}")
                head, body = split_http(block)
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                size = len(body)
                if f["warc-type"] == "revisit":
                    size = int(http_field(head, "Content-Length") or 0)
                elif hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"payload digest of {f['warc-record-id']}")
                page_id = http_field(head, "X-Page-Id")
                rows.append((f["warc-record-id"].strip("<>"), f["warc-type"], None if page_id is None else int(page_id),
                             f["warc-target-uri"], f["warc-date"], size, digest,
                             f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return (_archives(spark, path)
            .mapInArrow(run, "record_id string, record_type string, page_id long, url string, date string, "
                             "payload_bytes long, payload_digest string, refers_to_id string"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC (odd page ids in version 1, the rest in version 2), to WARC, and read back."""
    spark = pages.sparkSession
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages.where(odd), f"{arc}/v1", 1)
    write_arc(pages.where(~odd), f"{arc}/v2", 2)
    heads = materialize(spark, read_arc(spark, f"{arc}/v*")
                        .select("archive", "at", "record_id", "page_id", "payload_bytes", "payload_digest"), "arc-heads")
    convert(spark, f"{arc}/v*", materialize(spark, revisits(heads), "arc-revisits"), warc)
    back = materialize(spark, read_warc(spark, warc), "warc-heads")
    response = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"),
                                                             F.col("page_id").alias("refers_to"))
    return (back.where("record_type = 'revisit'").join(response, "refers_to_id", "left").select(*back.columns, "refers_to")
            .unionByName(back.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS rn,
             min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND rn > 1 THEN least END AS refers_to
FROM f"""
