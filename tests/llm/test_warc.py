import hashlib
import struct

import pytest

from plexigraph.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


BIG = "<p>" + "same words " * 200 + "é</p>"


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        group = [j for j, _, g in rows if (g or "") == (h or "") and j is not None] if len(b) >= 1000 and sum((g or "") == (h or "") for _, _, g in rows) > 1 else []
        first = max(group, default=None)
        revisit = first is not None and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/x y\n", BIG), (2, None, BIG), (7, "u", BIG), (7, "u", BIG), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", BIG), (8, "u", "x" * 3_000_000), (9, "u", "HTTP/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]


def test_round_trip(spark):
    df = pages(spark, ROWS).selectExpr("*", "1 as digest")
    archives = warc.write_archives(warc.mark_revisits(df), archive_records=3)
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=repr)
    assert got == brute(ROWS)


def test_only_nulls_in_a_group_are_responses(spark):
    rows = [(None, "u", BIG), (None, "u", BIG)]
    got = warc.read_archives(warc.write_archives(warc.mark_revisits(pages(spark, rows)))).collect()
    assert {(r["record_type"], r["refers_to"]) for r in got} == {("response", None)} and len(got) == 2


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages(spark, [])))).count() == 0


def record(payload=b"hello", **k):
    return warc.build_record(k.get("page_id", 5), "http://h", payload, hashlib.sha1(payload).hexdigest(), k.get("refers"), k.get("revisit", False))


def test_one_frame_for_each_record_after_the_dictionary():
    raw = [record(b"payload %d" % k * 50) for k in range(30)]
    content = warc.build_archive(raw)
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.SKIPPABLE and size > 0
    assert content.count(warc.FRAME_MAGIC) >= 30
    assert list(warc.iter_records(content)) == raw


def test_compressed_dictionary_is_read():
    import zstandard as z

    raw = [record(b"payload %d" % k * 50) for k in range(30)]
    content = warc.build_archive(raw)
    size = struct.unpack_from("<I", content, 4)[0]
    packed = z.ZstdCompressor().compress(content[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + content[8 + size :]
    assert list(warc.iter_records(again)) == raw


@pytest.mark.parametrize(
    "broken",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"hello", b"jello"),
        lambda r: r[:-1],
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: odd"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r.replace(b"WARC-Date: ", b"WARC-Date "),
        lambda r: r + b"x",
    ],
)
def test_damage_is_found(broken):
    with pytest.raises(warc.WarcError):
        warc.parse_record(broken(record()))


def test_cut_archives_are_found():
    content = warc.build_archive([record(b"x" * 5000) for _ in range(3)])
    for cut in (5, len(content) - 3):
        with pytest.raises(warc.WarcError):
            list(warc.iter_records(content[:cut]))


def test_foreign_archives_yield_rows(spark):
    """Version 1.0, a warcinfo record, repeated and folded headers, another record id, no digest; then damage."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    reply = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Concurrent-To: <urn:uuid:1>\r\nWARC-Concurrent-To: <urn:uuid:\r\n 3>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    broken = reply.replace(b"Content-Length: ", b"Content-Length: 9")
    content = warc.build_archive([info, reply, broken, info])
    size = struct.unpack_from("<I", content, 4)[0]
    content = content[: 8 + size] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + content[8 + size :]
    cut = warc.build_archive([reply, reply])[:-4]
    df = spark.createDataFrame([(bytearray(content),), (bytearray(cut),), (bytearray(b""),), (None,)], "content binary")
    rows = [(r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["error"] is None) for r in warc.read_records(df).collect()]
    fine = ("<urn:uuid:2>", "response", 5, hashlib.sha1(b"hello").hexdigest(), True)
    head = ("<urn:uuid:1>", "warcinfo", 5, hashlib.sha1(b"a: b\n").hexdigest(), True)
    bad = (None, None, None, None, False)
    assert rows == [head, fine, bad, head, fine, bad]
