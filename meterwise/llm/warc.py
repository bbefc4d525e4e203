"""WARC archives: a writer and a salvage reader.

Writer: every page becomes one WARC/1.0 record in a gzip member of its own. Of
records with equal payloads (SHA-1 and length), the one with the largest id is
a ``response`` that holds the payload, the others are ``revisit`` records that
refer to it; payloads under ``MIN_REVISIT`` bytes are all responses. Members
are written with Spark's text writer, so any folder Spark can write will do:
the line separator between two records is an empty gzip member, which leaves
the file a plain multi-member gzip.

Reader (salvage): each archive is walked member by member. A record counts if
its version line and headers parse, its block is as long as stated and matches
the block digest, which it must have, with an id, where its gzip member is damaged. After a
failed check the reader searches for the next version line within the member
and, behind it, for the next place where a member or, in plain files, a version
line starts, and goes on there; the bytes are logged as a quarantined gap with the
reason. What precedes the damage within a member is inflated and read; what
follows it in the same deflate stream cannot be, and nothing else is lost.

Archives hold a bounded number of records, chosen from the mean payload, so
that one archive fits a task.

Edge cases: null html is an empty payload; a null url is an empty URI. If rows
share the largest id of their payload (repeated rows), all of them are
responses. A null id never is the largest; if all ids of a payload are null,
all are responses. An empty table writes no record and reads none. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.scratch import broadcast_if_small, materialize, scratch_path

MIN_REVISIT = 0
ARCHIVE_BYTES = 32 << 20
VERSION = b"WARC/1.0\r\n"
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member: between two records' members.
SEPARATOR = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
LEVEL = 6
_FIELDS = ("page_id", "uri", "type", "digest", "length", "refers_to")
READ_SCHEMA = ("page_id long, uri string, record_type string, payload_digest string, payload_bytes long, "
               "refers_to long, payload binary, gap_start long, gap_end long, reason string")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: headers, block and the closing blank lines."""
    block = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)),
            ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{digest if not revisit else base32_sha1(block)}"),
            ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html"),
            ("Content-Length", str(len(block)))]
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", _urn(refers_to)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The record that starts at ``at`` and its end, or why there is none."""
    if data[at:at + 5] != b"WARC/":
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "headers do not end"
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return "bad header"
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        return "block does not end where stated"
    block = data[begin:end]
    want = head.get("warc-block-digest", "")
    if want and want != f"sha1:{base32_sha1(block)}":
        return "block digest differs"
    return {"head": head, "block": block}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(inflated bytes, end of the member, ""), or what came out of a damaged
    member before the damage, its start and what is wrong."""
    z = zlib.decompressobj(31)
    out, pos, step = [], at, 65536
    while not z.eof and pos < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(data[pos:pos + step]))
        except zlib.error:
            if step > 1:  # feed the same bytes one by one, for what precedes the damage
                z, step = before, 1
                continue
            return b"".join(out), at, "gzip member is damaged"
        pos += step
    if not z.eof:
        return b"".join(out), at, "gzip member is cut off"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def _records(raw: bytes) -> tuple[list[dict], str]:
    """The records of inflated ``raw``, going on at the next version line
    after a bad one, and the first fault ("" if there is none)."""
    good, fault, pos = [], "", 0
    while pos < len(raw):
        got = parse(raw, pos)
        if isinstance(got, str):
            fault = fault or got
            pos = raw.find(b"WARC/1.", pos + 1)
            if pos < 0:
                break
        else:
            good.append(got[0])
            pos = got[1]
    return good, fault


def _next_start(data: bytes, at: int) -> int:
    """The next offset where a member or a version line may start."""
    found = [x for x in (data.find(MAGIC, at), data.find(b"WARC/1.", at)) if x >= 0]
    return min(found) if found else len(data)


def salvage(data: bytes) -> Iterator[tuple[dict | None, int, int, str]]:
    """(record, start, end, reason) in file order; record is None for a
    quarantined gap. A member that holds a bad record gives its other records,
    then a gap over the member, whose bytes cannot be told apart; a member that
    breaks off gives the whole records before the break, and the gap lasts to
    the next start of a record."""
    at, gap, why = 0, None, ""
    while at < len(data):
        good: list[dict] = []
        reason, end = "", at
        if data[at:at + 3] == MAGIC:
            raw, end, broken = _inflate(data, at)
            good, fault = _records(raw)
            reason = broken or fault
            if broken:  # without a checksum, a record must prove itself
                good = [r for r in good if r["head"].keys() >= {"warc-block-digest", "warc-record-id"}]
        else:
            got = parse(data, at)
            if isinstance(got, str):
                reason = got
            else:
                good, end = [got[0]], got[1]
        if not reason or good:
            if gap is not None:
                yield None, gap, at, why
                gap = None
            for r in good:
                yield r, at, end, ""
        if reason:
            if gap is None:
                gap, why = at, reason
            at = end if end > at else _next_start(data, at + 1)
        else:
            at = end
    if gap is not None:
        yield None, gap, len(data), why


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _members(batches):
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        out = []
        for page_id, uri, payload, digest, refers, revisit in zip(*cols, strict=True):
            out.append(member(record(page_id, uri, payload, digest, refers, revisit)))
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for rec, start, end, reason in salvage(data):
                    if rec is None:
                        rows.append((path, None, None, None, None, None, None, None, start, end, reason))
                    else:
                        h = rec["head"]
                        block = rec["block"] if with_payload else None
                        size += len(block or b"")
                        rows.append((path, _page(h.get("warc-record-id", "")), h.get("warc-target-uri"),
                                     h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:"),
                                     int(h.get("x-payload-length", len(rec["block"]))),
                                     _page(h.get("warc-refers-to", "")), block, None, None, None))
                    if len(rows) >= 4096 or size >= 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return run


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(),
          pa.int64(), pa.int64(), pa.string()]
_NAMES = ["archive", "page_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload",
          "gap_start", "gap_end", "reason"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _base32(sha1_hex):
    """Base32 of a 40-digit hex string: five hex digits are four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    chars = []
    for g in range(8):
        n = F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int")
        for s in (15, 10, 5, 0):
            chars.append(F.substring(alphabet, F.call_function("shiftright", n, F.lit(s)).bitwiseAND(F.lit(31)) + 1,
                                     F.lit(1)))
    return F.concat(*chars)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> str:
    """Write one record for each row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(
        F.col(url_col).cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    sums = materialize(base.select("page_id", F.sha1("payload").alias("sha1"),
                                   F.octet_length("payload").cast("long").alias("size")), "digests")
    top = materialize(sums.where(F.col("size") >= MIN_REVISIT).groupBy("sha1", "size").agg(
        F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payload-groups")
    later = materialize(
        sums.join(top, ["sha1", "size"]).where("response_id is not null and not (page_id <=> response_id)")
        .select("page_id", "sha1", "response_id").distinct(), "revisits")
    stats = sums.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    per_file = max(1, int(ARCHIVE_BYTES / max(1.0, (stats["size"] or 0) / max(1, stats["n"]))))
    r = broadcast_if_small(later.select(F.col("page_id").alias("rp"), F.col("sha1").alias("rs"), "response_id"))
    rows = (base.withColumn("sha1", F.sha1("payload"))
            .join(r, F.col("page_id").eqNullSafe(F.col("rp")) & (F.col("sha1") == F.col("rs")), "left")
            .select("page_id", "uri", "payload", _base32(F.col("sha1")).alias("digest"), "response_id",
                    F.col("response_id").isNotNull().alias("revisit")))
    (rows.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", per_file).text(path))
    return path


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``reason`` not null) of all archives under
    ``path``, gzip or plain."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), "archive string, " + READ_SCHEMA)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = write_archives(pages, scratch_path(pages.sparkSession, "warc"), id_col, url_col, html_col)
    return (read_archives(pages.sparkSession, path, with_payload=False).where("reason is null")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
