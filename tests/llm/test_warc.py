import base64
import hashlib
import random
import zlib

import pytest

from cargofile.llm import warc
from cargofile.llm.warc import Members, read_warc, records_of, resolved, warc_files, write_warc

SCHEMA = "page_id long, url string, html string, record_type string, payload_bytes string, key string, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "w") for i, u, h in rows], SCHEMA).repartition(3)


def brute(rows, least=0):
    out = []
    for id_, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        owner = min(same) if same and len(data) >= least else None
        response = owner is None or owner == id_
        out.append((id_, "response" if response else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    None if response else owner))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in df.collect()), key=str)


LONG = "".join(random.Random(5).choices("abc é<>\r\n\0😀", k=400_000))
PAGES = [(7, "http://a/x", "same"), (3, None, "same"), (9, "u\r\nWARC-Type: x", "same"), (9, "u", "same"), (3, "again", "same"),
         (1, "", None), (2, "e", ""), (4, "l", LONG), (5, "l", LONG), (6, "w", "WARC/1.1\r\n\r\n\x1f\x8b"), (None, "n", "same"),
         (None, "n", "nobody else"), (8, "t", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_read_back_as_written(spark, least):
    for rows in (PAGES, []):
        root = write_warc(frame(spark, rows), least=least, file_bytes=3000)
        assert rows_of(resolved(read_warc(warc_files(spark, root)))) == brute(rows, least)


def test_files_hold_one_member_per_record_and_whole_payloads(spark):
    root = write_warc(frame(spark, PAGES), file_bytes=1 << 30)
    records = read_warc(warc_files(spark, root), payloads=True).collect()
    assert all(r.error is None for r in records)
    held = {(int(r.id) if r.id else None, bytes(r.payload).decode()) for r in records if r.record_type == "response"}
    assert held == {(i, h or "") for i, _, h in PAGES if (i, h) in {(3, "same"), (1, None), (4, LONG), (6, PAGES[9][2]), (None, "nobody else"), (8, "\r\n\r\n")}}
    for path in {r.file for r in records}:
        data, count = open(path.removeprefix("file:"), "rb").read(), 0
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n")
            data, count = one.unused_data, count + 1
        assert count == sum(r.file == path for r in records)


def test_files_without_a_commit_are_not_read(spark):
    root = write_warc(frame(spark, PAGES))
    with warc.opened(f"{root}/lost-attempt.warc.gz", write=True) as out:
        out.write(warc.member("response", 77, "u", b"lost", None, "d"))
    assert rows_of(resolved(read_warc(warc_files(spark, root)))) == brute(PAGES)


def written(tmp_path, *parts):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    return str(path)


def member(k, payload=b"payload"):
    return warc.member("response", k, f"u{k}", payload, None, "d")


def test_broken_records_are_told_and_reading_goes_on(tmp_path):
    good, other = member(1), member(2, random.Random(1).randbytes(300_000))
    torn = bytearray(other)
    torn[len(torn) // 2] ^= 0xFF
    rows = list(records_of(written(tmp_path, good, bytes(torn), member(3)), False))
    assert [r.get("id") for r in rows if not r["error"]] == ["1", "3"] and sum(bool(r["error"]) for r in rows) == 1
    rows = list(records_of(written(tmp_path, good, other[:-9]), False))
    assert [bool(r["error"]) for r in rows] == [False, True]
    rows = list(records_of(written(tmp_path, b"junk" * 40_000, good), False))
    assert [bool(r["error"]) for r in rows] == [True, False] and rows[1]["position"] == 160_000
    assert list(records_of(written(tmp_path), False)) == []


def changed(k, old, new):
    return warc.gzipped(zlib.decompress(member(k), 31).replace(old, new))


@pytest.mark.parametrize(("old", "new", "says"), [
    (b"payload\r\n", b"PAYLOAD\r\n", "digest"), (b"Content-Length: 7", b"Content-Length: 8", "block digest"),
    (b"\r\n\r\npayload", b"\r\n\rpayload", "block"), (b"WARC/1.1", b"XARC/1.1", "not a WARC"),
    (b"payload\r\n\r\n", b"payload", "end"), (b"WARC-Type: response", b"WARC-Type:\r\n response", None)])
def test_length_end_and_digests_are_checked(tmp_path, old, new, says):
    rows = list(records_of(written(tmp_path, member(1), changed(2, old, new), member(3)), False))
    assert [r.get("id") for r in rows][::2] == ["1", "3"] and len(rows) == 3
    assert (rows[1]["error"] is None) if says is None else says in rows[1]["error"]


def test_member_is_unpacked_a_chunk_at_a_time(tmp_path):
    with warc.opened(written(tmp_path, warc.gzipped(bytes(50_000_000)))) as stream:
        source = Members(stream)
        assert source.advance()
        most, size = 0, 0
        while data := source.read():
            most, size = max(most, len(data), len(source.ready), len(source.raw)), size + len(data)
    assert size == 50_000_000 and most <= warc.CHUNK
