"""WARC archives: a writer of gzip members, one for each record, and a reader that salvages damaged files.

The writer turns each record into a gzip member inside its task and leaves the files to Spark's own writer, whose
commit keeps them whole when executors are lost. Records with equal payloads are written once; the others are
``revisit`` records that name it.

The reader takes each archive file as bytes, checks every member (gzip checksum, version line, block length and
payload digest), and after a failed check searches for the next gzip member or version line from which a record
can be read, inside members of several records too, so one damaged record costs itself only. Skipped bytes are
returned as gaps. Of a member that is cut off, those records count whose payloads have their digests; of one that fails
its checksum, none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.salted import bit, for_members, salt
from tessera.llm.shared import checkpoint_dir, checkpointed

#: Bytes from which an archive file is closed; a reader's task holds one file.
ARCHIVE_BYTES = 16 << 20
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_STEP = 1 << 16


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value without control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, kind: str, date: str, size: int, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers and the digest of the payload, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _as_line(archive: bytes) -> bytes:
    """An archive less its last byte where that is zero: the line separator of the file writer restores it.

    The last byte is the highest of a record's length, so it is zero below 16 MB; a longer record keeps it and gets a
    zero byte of padding, which gzip allows.
    """
    return archive[:-1] if archive.endswith(b"\0") else archive


def with_roles(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload binary, bytes, digest, kind, refers_to): which record of equal payloads keeps it.

    Of records with equal payloads of at least ``min_bytes``, that of the smallest page_id (null last, then of the
    least url, null last, then one of the equal rows) is the response. Copies meet on their digest and a share of
    them, so that a payload that a third of all pages have is no task's alone; equal rows are counted before.
    """
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "salt": salt("page_id", "url")})
    out = ["page_id", "url", "payload", "bytes", "digest", "kind", "refers_to"]
    same = ["digest", "bytes"]
    shared = rows.where(F.col("bytes") >= min_bytes).groupBy(*same, "page_id").agg(F.count("*").alias("same"), F.bit_or(bit("salt")).alias("salts"))
    rank = F.struct(F.col("page_id").isNull(), "page_id")
    shared = shared.groupBy(*same).agg(F.min(F.struct(rank.alias("rank"), "same")).alias("first"), F.sum("same").alias("all"), F.bit_or("salts").alias("salts"))
    shared = checkpointed(shared.where("all > 1").select(*same, F.col("first.rank.page_id").alias("first_id"), F.col("first.same").alias("same"), "salts"))
    joined = rows.join(for_members(shared), [*same, "salt"], "left")
    is_first = F.col("same").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(F.col("same").isNull() | (is_first & (F.col("same") == 1)), "response").when(is_first, "one of").otherwise("revisit")
    joined = joined.withColumn("kind", kind).withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("first_id")))
    if not shared.where("same > 1").limit(1).count():
        return joined.select(*out)
    plain = joined.where(F.col("kind") != "one of").select(*out)
    many = joined.where(F.col("kind") == "one of").groupBy(*same, "page_id", "url").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    least = many.groupBy(*same).agg(F.min(F.struct(F.col("url").isNull().alias("no"), "url")).alias("least"), F.bit_or(bit(salt("page_id", "url"))).alias("salts"))
    many = many.withColumn("salt", salt("page_id", "url")).join(for_members(least), [*same, "salt"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    chosen = F.col("url").eqNullSafe(F.col("least.url")) & (F.col("nth") == 1)
    many = many.withColumn("kind", F.when(chosen, "response").otherwise("revisit")).withColumn("refers_to", F.when(~chosen, F.col("page_id")))
    return plain.unionByName(many.select(*out))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row of ``pages`` to archive files in the folder ``path``.

    A file is closed once it has ``archive_bytes``, so it is larger by one record at most. Null html is an empty
    payload, a null url leaves the target out, and control characters in urls are percent-encoded. Repeated rows are
    written each. Other columns are ignored; an empty table gives no records.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each file: the members of as many records as fill it."""
        line = lambda parts: pa.RecordBatch.from_arrays([pa.array([_as_line(b"".join(parts))], pa.binary())], ["value"])
        parts, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "kind", "bytes", "digest")]
            for row in zip(*columns, strict=True):
                *what, n, digest = (x.as_py() for x in row)
                parts.append(_member(record(*what, date, n, base64.b32encode(bytes.fromhex(digest)).decode())))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield line(parts)
                    parts, size = [], 0
        if parts:
            yield line(parts)

    roles = with_roles(pages, min_bytes, page_id, url, html)
    roles = roles.withColumn("payload", F.when(F.col("kind") == "response", F.col("payload")))
    lines = roles.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _parse(data: bytes, at: int, digest: bool = False) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record that begins at ``at``; None if a check fails. ``digest``: one is asked for."""
    if not data.startswith(_VERSION, at) or (end := data.find(b"\r\n\r\n", at)) < 0:
        return None
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        return None
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block, known = data[end + 4 : stop], head.get("warc-payload-digest", "")
    if digest and not (known and head.get("warc-type") == "response"):
        return None
    if head.get("warc-type") == "response" and known not in ("", f"sha1:{_digest(block.partition(b'\r\n\r\n')[2])}"):
        return None
    return head, block, stop + 4


def _unzip(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds and where it ends: no end if it is cut off, and nothing either if it is damaged."""
    unpack, out, stop = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = data[stop : stop + _STEP]
            if not piece:
                return b"".join(out), None
            out.append(unpack.decompress(piece))
            stop += len(piece)
    except zlib.error:
        return b"", None
    return b"".join(out), stop - len(unpack.unused_data)


Found = tuple[str, int, int, int | None, dict[str, str], bytes]


def _inside(content: bytes, whole: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(offset, length, headers, block) of the records in a member's content; without headers, of what lies between.

    Of a member that isn't ``whole``, only records with the digest of their payload count.
    """
    at, bad = 0, None
    while at < len(content):
        if parsed := _parse(content, at, digest=not whole):
            if bad is not None:
                yield bad, at - bad, None, b""
                bad = None
            yield at, parsed[2] - at, parsed[0], parsed[1]
            at = parsed[2]
            continue
        bad = at if bad is None else bad
        following = _LINE.search(content, at + 1)
        at = following.start() if following else len(content)
    if bad is not None:
        yield bad, len(content) - bad, None, b""


def salvage(data: bytes) -> Iterator[Found]:
    """("record", offset, length, inner, headers, block) and ("gap", offset, length, inner, {}, b"") in file order.

    Offset and length are those in the file: of a whole gzip member, whatever it holds, or of a plain record. ``inner``
    is the place in the member's content of what is not its only record; records recovered from a member that is cut off have
    length 0, as its bytes are a gap.
    """
    at, bad = 0, None
    while at < len(data):
        if data[at] == 0 and bad is None:  # padding between members
            stop = at
            while stop < len(data) and data[stop] == 0:
                stop += 1
            at = stop
            continue
        end, found = None, []
        if data.startswith(_MAGIC, at):
            content, end = _unzip(data, at)
            found = [(i, head, block) for i, _, head, block in _inside(content, end is not None) if head is not None or end is not None]
            if not any(head for _, head, _ in found):
                end, found = None, []
        elif parsed := _parse(data, at):
            end, found = parsed[2], [(0, parsed[0], parsed[1])]
        if end is not None:
            if bad is not None:
                yield "gap", bad, at - bad, None, {}, b""
                bad = None
            for i, head, block in found:
                inner = None if len(found) == 1 else i
                yield ("gap", at, end - at, i, {}, b"") if head is None else ("record", at, end - at, inner, head, block)
            at = end
            continue
        for i, head, block in found:
            yield "record", at, 0, i, head, block
        bad = at if bad is None else bad
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None:
        yield "gap", bad, len(data) - bad, None, {}, b""


_READ = "file string, offset long, length long, inner long, status string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archive files in ``path``.

    Returns (file, offset, length, inner, status, record_type, page_id, target_uri, payload_bytes, payload_digest,
    refers_to, payload): status is ``record``, or ``gap`` for quarantined bytes, whose other columns are null; offset,
    length and inner are those of ``salvage``.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload, of revisits too; ``payload`` is null for
    revisits and where ``payloads`` is false. Empty files give no rows.
    """
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", s or "")) else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for status, at, length, inner, head, block in salvage(content.as_py() or b""):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = re.search(rb"(?i)content-length: *([0-9]+)", http)
                    kind = head.get("warc-type")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    body = payload if payloads and kind == "response" else None
                    rows.append((name.as_py(), at, length, inner, status, kind, number(head.get("warc-record-id")), head.get("warc-target-uri"), (len(payload) if kind == "response" else int(size[1]) if size else None), digest, number(head.get("warc-refers-to")), body))
                    held += len(body or b"")
                    if len(rows) >= 10_000 or held >= 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC archives into the shared folder and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    back = read_warc(spark, path, payloads=False).where("status = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, (5 * i + 1)::INTEGER, 5))::BIGINT >> b)::INTEGER % 32 + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first END AS refers_to
FROM r
"""
