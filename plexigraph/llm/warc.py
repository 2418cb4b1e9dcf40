"""WARC archives in Zstandard form: one dictionary, one frame for each record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on that
archive's own first records; every record after it is a frame of its own, compressed with that
dictionary, so one record can be read without the others. The reader loads the dictionary from the
leading frame, decodes frame by frame, and checks version line, header syntax, Content-Length against the
block, and the digest of every payload. `read_archives` is for archives written here and stops at
the first breach; `read_records` takes any writer's and reports breaches as rows.

Archives travel as rows (archive, content binary): a task writes its archives of at most
`archive_records` records or `archive_bytes` bytes of payload, whichever comes first, into the
shared folder through Spark, so no local path is involved. The readers take any table with a
`content` column, among them Spark's `binaryFile` source over *.warc.zst files.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is a
response and the others revisit it. Counting is done on (digest, page_id) with map-side
aggregation, so a payload held by a third of all pages is one row per task; the join back is one
that adaptive execution splits.

Null html is an empty payload. Null page_ids never win a group and come out null; a group of nulls
only is all responses. Rows repeated with the winner's page_id are responses too. An empty table
gives no archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.llm._common import stash, table, trim

#: Fixed values of the format: skippable-frame magic numbers, Zstandard frame and dictionary magics.
SKIPPABLE, FRAME_MAGIC, DICT_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Versions that are read.
VERSIONS = ("WARC/1.1", "WARC/1.0")
NEEDED = ("warc-record-id", "warc-type", "warc-date", "content-length")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FOUND = "record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string, error string"


class WarcError(ValueError):
    """An archive that breaks the format."""


def _digest(payload_sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(payload_sha1_hex)).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    if not (m := re.fullmatch(r"<urn:page:(-?\d*)>", record_id)):
        raise WarcError(f"record id {record_id!r}")
    return int(m[1]) if m[1] else None


def _safe_uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def build_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe_uri(url)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_digest(sha1_hex)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def split_record(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    """(header fields by lower-case name, block) of a record, or WarcError. Names may repeat; lines may be folded."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in VERSIONS:
        raise WarcError("version line or end of header missing")
    fields: dict[str, list[str]] = {}
    last: list[str] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            last[-1] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"header line {line!r}")
        last = fields.setdefault(name.lower(), [])
        last.append(value.strip())
    if missing := [k for k in NEEDED if k not in fields]:
        raise WarcError(f"headers missing: {missing}")
    if not fields["content-length"][0].isdigit():
        raise WarcError(f"length {fields['content-length'][0]!r}")
    length = int(fields["content-length"][0])
    if rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block isn't {length} bytes long")
    return fields, rest[:length]


def _sha1_of(value: str | None) -> str | None:
    """Hex SHA-1 of a digest header in base 32 or hex; null for other algorithms."""
    m = re.fullmatch(r"(?i)sha1:([a-z2-7]{32}|[0-9a-f]{40})", value or "")
    return None if not m else m[1].lower() if len(m[1]) == 40 else base64.b32decode(m[1].upper()).hex()


def describe(raw: bytes) -> tuple:
    """The FOUND columns up to `error` for a record of any type and writer, or WarcError."""
    fields, block = split_record(raw)
    get = lambda k: fields[k][0] if k in fields else None
    payload, kind = block, fields["warc-type"][0].lower()
    if (get("content-type") or "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest, given = hashlib.sha1(payload).hexdigest(), _sha1_of(get("warc-payload-digest"))
    if kind != "revisit" and given and digest != given and b"\r\ntransfer-encoding:" not in block[:8192].lower():
        raise WarcError("payload differs from its digest")
    return get("warc-record-id"), kind, get("warc-target-uri"), get("warc-date"), len(payload), given if kind == "revisit" else digest, get("warc-refers-to")


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record as written here, or WarcError."""
    fields, block = split_record(raw)
    kind, digest = fields["warc-type"][0], _sha1_of(fields.get("warc-payload-digest", [None])[0])
    if kind not in ("response", "revisit") or not digest:
        raise WarcError(f"record type {kind!r} or digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length: (\d+)$", http)
    if not sep or not m:
        raise WarcError("HTTP header missing")
    n = int(m[1])
    if kind == "response" and (n != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("revisit with a payload or without a target")
    return _page_id(fields["warc-record-id"][0]), n, digest, kind, _page_id(fields["warc-refers-to"][0]) if kind == "revisit" else None


def build_archive(records: list[bytes], level: int = 3, dict_bytes: int = 32 << 10, train_bytes: int = 1 << 20) -> bytes:
    """Dictionary frame, then a frame for each record. Few or tiny records get a raw dictionary."""
    import zstandard as z

    sample, room = [], train_bytes
    for r in records:
        if room <= 0:
            break
        sample.append(r[: 16 << 10])
        room -= len(sample[-1])
    try:
        own = z.train_dictionary(dict_bytes, sample, k=1024, d=8, threads=0).as_bytes()
    except z.ZstdError:
        own = (b"".join(sample)[: 4 << 10]) or b"WARC/1.1\r\n"
    pack = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(own), write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(own)), own, *(pack.compress(r) for r in records)])


def iter_records(content: bytes):
    """Raw records of an archive, one frame at a time."""
    import zstandard as z

    view, at, own = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        held = bytes(view[8 : 8 + size])
        if len(held) != size:
            raise WarcError("dictionary frame cut short")
        if held[:4] == FRAME_MAGIC:  # the dictionary may be compressed itself
            held = z.ZstdDecompressor().decompressobj().decompress(held)
        own, at = z.ZstdCompressionDict(held), 8 + size
    reader = z.ZstdDecompressor(dict_data=own) if own else z.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]  # another skippable frame
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame, parts, start = reader.decompressobj(), [], at
        step = 1 << 16
        while not frame.eof:
            if start >= len(view):
                raise WarcError("frame cut short")
            try:
                parts.append(frame.decompress(view[start : start + step]))
            except z.ZstdError as e:
                raise WarcError(f"frame at byte {at}: {e}") from e
            start += step
        at = min(start, len(view)) - len(frame.unused_data)
        yield b"".join(parts)


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to) for pages(page_id, url, html)."""
    full = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= min_bytes
    groups = full.filter(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("g"), "first_id")
    out = full.join(groups, F.col("digest") == F.col("g"), "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return out.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(marked: DataFrame, archive_records: int = 2000, archive_bytes: int = 24 << 20) -> DataFrame:
    """(archive string, records int, content binary), written to the shared folder."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, k = [], 0, 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:05d}.warc.zst"]), pa.array([len(held)], pa.int32()), pa.array([build_archive(held)], pa.binary())], ["archive", "records", "content"])

        for batch in batches:
            for page_id, url, payload, digest, revisit, refers in zip(*(iter(c) for c in batch.columns), strict=True):
                body = payload.as_py()
                held.append(build_record(page_id.as_py(), url.as_py(), body, digest.as_py(), refers.as_py(), revisit.as_py()))
                size += len(held[-1])
                if len(held) >= archive_records or size >= archive_bytes:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()
        held.clear()
        trim()

    return stash(marked.select("page_id", "url", "payload", "digest", "revisit", "refers_to").mapInArrow(write, "archive string, records int, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of a table of archives (column `content`), each checked."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [parse_record(r) for r in iter_records(content.as_py())]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
        trim()

    return archives.select("content").mapInArrow(read, RECORDS)


def read_records(archives: DataFrame) -> DataFrame:
    """The records of any *.warc.zst archives (column `content`): FOUND, one row per record.

    Versions 1.0 and 1.1, all record types, repeated and folded headers. A record that breaks the
    format is a row with `error` set, and so is the rest of an archive whose frames break off.
    """
    names, kinds = [x.split()[0] for x in FOUND.split(", ")], [pa.int64() if x.endswith("long") else pa.string() for x in FOUND.split(", ")]

    def rows(content: bytes):
        frames = iter_records(content)
        while True:
            try:
                raw = next(frames, None)
            except WarcError as e:
                yield (*[None] * 7, str(e))
                return
            if raw is None:
                return
            try:
                yield (*describe(raw), None)
            except WarcError as e:
                yield (*[None] * 7, str(e))

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                if found := list(rows(content.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
        trim()

    return archives.select("content").mapInArrow(read, FOUND)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(mark_revisits(table(spark, sf_dir, "pages"))))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT h, max(page_id) AS first_id, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
