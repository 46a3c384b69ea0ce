"""WARC archives: writing them from payloads, and a salvage reader.

Writing.  Every record is one gzip member (or plain bytes).  Records go out through Spark's text sink, whose values are
the members' bytes and whose separator is an empty gzip member (plain: the record's own last CRLF).  So archives land
in any store that Spark reaches, under Spark's commit protocol: a lost executor's half-written file is never seen.

Reading.  ``salvage`` walks the bytes of an archive.  A record passes if its member inflates (and gzip's checksum
agrees), its head parses, its length holds and its block digest agrees.  After a failed check the reader searches for
the next gzip member or version line at which a record passes, goes on there, and logs the gap of bytes between as
quarantined.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, byte_length, fresh, materialise, new_scratch_path, utf8

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
MEMBER_MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records, before compression, with which an archive is full; one task reads an archive.
ARCHIVE_BYTES = 64 << 20

#: Bytes given to the inflater at once, so that what it hands back unused stays small.
CHUNK = 8192

#: Payloads shorter than this are never revisits.
MIN_REVISIT = 100


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One plain record: version line, headers, block, two line ends."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in headers.items())
    return head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = gzip_member(b"")


class _Bad(Exception):
    pass


_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+(?=\r\n)")
_LINE_END = b"\r\n"


class _Plain:
    """Plain records in some bytes.

    Damaged bytes may be full of version lines.  So that they are read once and not once a version line, what was found is kept: where the
    next head ends, the next line that is no header, and up to where a head that has failed would fail again, since all heads before an
    end share its last lines.
    """

    def __init__(self, data: bytes):
        self.data = data
        self._searched, self._end = 0, -1  # the first head end behind the place searched from
        self._known = False
        self._bad_line = -1
        self._failed: tuple[int, int, str] = (-1, -1, "")  # head end, last place that fails alike, reason

    def _head_end(self, at: int) -> int:
        if not (self._known and self._searched <= at and (self._end < 0 or at <= self._end)):
            self._searched, self._end, self._known = at, self.data.find(b"\r\n\r\n", at), True
        return self._end

    def _fail(self, head_end: int, upto: int, reason: str) -> _Bad:
        self._failed = (head_end, upto, reason)
        return _Bad(reason)

    def record(self, at: int) -> tuple[Record, int]:
        """The record whose version line starts at ``at``, and where it ends."""
        data = self.data
        if not data.startswith(b"WARC/", at):
            raise _Bad("no version line")
        version = _VERSION_LINE.match(data, at)
        if not version:
            raise _Bad("bad version line")
        head_end = self._head_end(at)
        if head_end < 0:
            raise _Bad("head without end")
        if at < self._bad_line < head_end:
            raise _Bad("bad header line")
        if self._failed[0] == head_end and at < self._failed[1]:
            raise _Bad(self._failed[2])
        headers: dict[str, str] = {}
        places: dict[str, int] = {}
        pos = version.end() + 2
        while pos < head_end:
            stop = data.find(_LINE_END, pos, head_end + 2)
            try:
                name, colon, value = data[pos:stop].decode("utf-8").partition(":")
            except UnicodeDecodeError:
                self._bad_line = pos
                raise _Bad("head is not UTF-8") from None
            if not colon:
                self._bad_line = pos
                raise _Bad("bad header line")
            headers[name.strip().lower()] = value.strip()
            places[name.strip().lower()] = pos
            pos = stop + 2
        said = headers.get("content-length", "")
        upto = places.get("content-length", head_end)
        if not re.fullmatch(r"\d{1,18}", said):
            raise self._fail(head_end, upto, "bad length")
        start = head_end + 4
        end = start + int(said)
        if data[end : end + 4] != b"\r\n\r\n":
            raise self._fail(head_end, upto, "length does not hold")
        block = data[start:end]
        digest = headers.get("warc-block-digest", "")
        if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
            raise self._fail(head_end, min(upto, places["warc-block-digest"]), "block digest does not agree")
        return Record(at, headers, block), end + 4


def _parse(data: bytes, at: int, plain: _Plain) -> tuple[Record | None, int]:
    """The record at ``at``, gzip member or plain; None for an empty member."""
    if data.startswith(MEMBER_MAGIC, at):
        z = zlib.decompressobj(31)
        parts, end = [], at
        try:
            while not z.eof and end < len(data):
                parts.append(z.decompress(data[end : end + CHUNK]))
                end = min(end + CHUNK, len(data))
        except zlib.error as e:
            raise _Bad(f"member: {e}") from None
        if not z.eof:
            raise _Bad("member is cut short")
        end -= len(z.unused_data)
        inner = b"".join(parts)
        if not inner:
            return None, end
        record, used = _Plain(inner).record(0)
        if used != len(inner):
            raise _Bad("member holds more than a record")
        record.offset = at
        return record, end
    return plain.record(at)


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d")


def salvage(data: bytes) -> Salvaged:
    """All records that pass their checks, and the byte gaps between that don't."""
    out, at, bad_from, reason = Salvaged(), 0, -1, ""
    view, plain = data, _Plain(data)
    while at < len(view):
        try:
            record, end = _parse(view, at, plain)
        except _Bad as e:
            if bad_from < 0:
                bad_from, reason = at, str(e)
            found = _START.search(view, at + 1)
            if not found:
                break
            at = found.start()
            continue
        if bad_from >= 0:
            out.gaps.append(Gap(bad_from, at - bad_from, reason))
            bad_from = -1
        if record:
            out.records.append(record)
        at = end
    if bad_from >= 0:
        out.gaps.append(Gap(bad_from, len(view) - bad_from, reason))
    return out


def _as_sink_value(compress: bool, full: int):
    """Record columns -> the bytes that the text sink writes, and the archive of the task that they go to.

    A task starts a new archive when the records of the last hold ``full`` bytes, so only a single record can make one larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = held = 0
        for batch in batches:
            out, archives = [], []
            for id_, url, kind, digest, refers, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                block = b"" if kind == "revisit" else payload
                headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if id_ is None else id_}>", "WARC-Date": DATE}
                if url:
                    headers["WARC-Target-URI"] = url
                headers |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
                if kind == "revisit":
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{refers}>"}
                data = record_bytes(headers, block)
                if held and held + len(data) > full:
                    archive, held = archive + 1, 0
                held += len(data)
                archives.append(archive)
                out.append(gzip_member(data) if compress else data[:-2])
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(archives, pa.int32())], names=["value", "archive"])

    return run


def write_archives(pages: DataFrame, path: str, compress: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one WARC record a row of ``pages`` under ``path``, in archives of about ``archive_bytes`` bytes before compression.

    The payload is the html in UTF-8, empty for null.  Among records with equal payloads of at least 100 bytes the one
    with the smallest id is a response and the others revisit it, without a block of their own; rows that share this
    smallest id are all responses.  Rows with a null id are responses, and revisits of a row that has one.
    """
    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    slim = slim.withColumn("_digest", F.sha2(utf8(F.col("_html")), 256))
    # only digests that occur twice: their number and the join's other side shrink before anything wide moves
    twice = (
        slim.where(byte_length(F.col("_html")) >= MIN_REVISIT)
        .groupBy("_digest")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null")
        .select(fresh(F.col("_digest")).alias("_j"), "_first")
    )
    joined = slim.join(twice, fresh(F.col("_digest")) == F.col("_j"), "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    records = joined.select("_id", "_url", F.when(again, "revisit").otherwise("response").alias("_kind"), "_digest", F.when(again, F.col("_first")).alias("_refers"), "_html")
    values = records.mapInArrow(_as_sink_value(compress, archive_bytes), "value binary, archive int").select(F.col("value").cast("string").alias("value"), "archive")
    sep = EMPTY_MEMBER.decode("latin-1") if compress else "\r\n"
    values.write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", sep).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``.

    Columns: file, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, block, and for
    quarantined gaps record_type ``gap`` with gap_bytes and gap_reason.  Each archive is read by one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    number = re.compile(r"<urn:page:(-?\d+)>")

    def page(said: str | None) -> int | None:
        m = number.fullmatch(said or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = salvage(content.as_py())
                rows = []
                for r in got.records:
                    h = r.headers
                    rows.append((name, r.offset, h.get("warc-type"), page(h.get("warc-record-id")), h.get("warc-target-uri"), int(h.get("x-payload-length", len(r.block))), h.get("warc-payload-digest", "").removeprefix("sha256:"), page(h.get("warc-refers-to")), r.block, None, None))
                rows += [(name, g.offset, "gap", None, None, None, None, None, None, g.length, g.reason) for g in got.gaps]
                for i in range(0, len(rows), 1000):
                    part = list(zip(*rows[i : i + 1000]))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.record_batch([pa.array(list(x), k) for x, k in zip(part, kinds)], names=NAMES)

    return files.mapInArrow(run, "file string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, block binary, gap_bytes long, gap_reason string")


NAMES = ["file", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "block", "gap_bytes", "gap_reason"]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read all their records back."""
    path = new_scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
