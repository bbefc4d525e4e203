"""Round trips, and salvage of damaged archives."""

import glob
import os
import random

import pytest

from meterwise.llm import warc

PAGES = [(1, "http://a/é", "<html>one</html>"), (2, "http://b", "<html>one</html>"), (3, None, None), (4, "u", ""),
         (5, "x\r\ny", "WARC/1.0\r\n\r\n fake \x00 body"), (6, "http://long", "z" * 300_000), (7, "http://c", "<html>one</html>"),
         (None, "http://n", "<html>one</html>"), (8, "http://twin", "twin"), (8, "http://twin", "twin"),
         (None, "http://m", "only without id")]


def pages(frame, rows=PAGES):
    return frame(rows, "page_id long, url string, html string")


def want(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, t in rows if (t or "") == (html or "") and j is not None]
        top = max(same, default=None)
        revisit = top is not None and i != top
        out.append((i, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(frame):
    got = warc.archive_pages(pages(frame)).collect()
    assert sorted(map(tuple, got), key=str) == want(PAGES)
    assert warc.archive_pages(pages(frame, [])).collect() == []


def test_round_trip_of_payloads(spark, frame, tmp_path):
    path = warc.write_archives(pages(frame), str(tmp_path / "w"))
    out = warc.read_archives(spark, path)
    assert out.where("reason is not null").count() == 0
    for r in out.collect():
        if r["record_type"] == "response" and r["page_id"] is not None:
            html = next(h for i, _, h in PAGES if i == r["page_id"])
            assert bytes(r["payload"]) == (html or "").encode() and r["payload_digest"] == warc.base32_sha1(r["payload"])
        elif r["record_type"] == "revisit":
            assert (r["refers_to"], r["payload_bytes"]) in {(7, len("<html>one</html>")), (4, 0)} and not r["payload"]


def test_archives_are_plain_gzip(spark, frame, tmp_path):
    import gzip

    path = warc.write_archives(pages(frame), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert text.count(b"WARC-Record-ID") == len(PAGES)


def members(n=12):
    bodies = [(f"body {i} " * (i + 1)).encode() for i in range(n)]
    return bodies, [warc.member(warc.record(i, f"http://x/{i}", b, warc.base32_sha1(b), None, False))
                    for i, b in enumerate(bodies)]


def found(data):
    records, gaps = {}, []
    for rec, start, end, reason in warc.salvage(data):
        if rec is None:
            gaps.append((start, end, reason))
        else:
            records[warc._page(rec["head"]["warc-record-id"])] = rec["block"]
    return records, gaps


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop_head", "digest", "length"])
def test_salvage_loses_only_the_damaged_record(damage):
    bodies, parts = members()
    k, lost = 5, {5}
    bad = bytearray(parts[k])
    if damage == "flip":
        bad[len(bad) // 2] ^= 0xFF
    elif damage == "cut":
        bad = bad[:len(bad) // 2]
    elif damage == "junk":
        bad = bytearray(b"\x00junk\x1f\x8b\x08junk WARC/1.1 junk") + bad
        lost = set()
    elif damage == "drop_head":
        bad = bad[12:]
    elif damage == "digest":
        bad = bytearray(warc.member(warc.record(k, "u", b"one", warc.base32_sha1(b"two"), None, False)))
    else:
        raw = warc.record(k, "u", bodies[k], warc.base32_sha1(bodies[k]), None, False)
        bad = bytearray(warc.member(raw.replace(b"Content-Length: ", b"Content-Length: 9")))
    data = b"".join([*parts[:k], bytes(bad), *parts[k + 1:]])
    records, gaps = found(data)
    assert records == {i: b for i, b in enumerate(bodies) if i not in lost}
    start = sum(map(len, parts[:k]))
    assert len(gaps) == 1 and gaps[0][0] == start and gaps[0][2]
    assert gaps[0][1] == start + len(bad) - (0 if lost else len(parts[k]))


def test_salvage_of_plain_files_and_tails():
    bodies = [f"plain {i}".encode() for i in range(6)]
    raw = [warc.record(i, "u", b, warc.base32_sha1(b), None, False) for i, b in enumerate(bodies)]
    data = raw[0] + raw[1][:-9] + raw[2] + b"garbage" + raw[3] + raw[4] + raw[5][:30]
    records, gaps = found(data)
    assert records == {0: bodies[0], 2: bodies[2], 3: bodies[3], 4: bodies[4]}
    assert [g[1] - g[0] for g in gaps] == [len(raw[1]) - 9, 7, 30]
    assert found(b"") == ({}, []) and found(b"\x00" * 50)[1] == [(0, 50, "no version line")]


def test_salvage_never_raises():
    rng = random.Random(1)
    _, parts = members(6)
    data = b"".join(parts)
    for _ in range(200):
        d = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            d[rng.randrange(len(d))] = rng.randrange(256)
        records, gaps = found(bytes(d[rng.randrange(0, 20):]))
        assert all(a < b for a, b, _ in gaps)


def test_damaged_archive_on_disk(spark, frame, tmp_path):
    rows = [(i, "u", f"page {i} " * 50) for i in range(40)]
    path = warc.write_archives(pages(frame, rows), str(tmp_path / "w"))
    files = sorted(glob.glob(f"{path}/part-*"), key=os.path.getsize)
    data = bytearray(open(files[-1], "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(files[-1], "wb").write(data)
    for crc in glob.glob(f"{path}/.*.crc"):
        os.truncate(crc, 0)
    spark.conf.set("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    out = warc.read_archives(spark, "file:" + path).collect()
    assert sum(r["reason"] is not None for r in out) >= 1
    assert len({r["page_id"] for r in out if r["reason"] is None}) >= 38


def several(n=10):
    raw = [warc.record(i, f"u{i}", (f"page {i} " * 200).encode(), warc.base32_sha1((f"page {i} " * 200).encode()), None, False)
           for i in range(n)]
    return raw, [warc.parse(r)[0]["head"]["warc-record-id"] for r in raw]


def ids(records):
    return [r["head"]["warc-record-id"] for r, *_ in records if r is not None]


def test_a_bad_record_in_a_member_loses_only_itself():
    raw, urns = several()
    for hurt in (lambda r: r.replace(b"page 3", b"pAge 3", 1), lambda r: r.replace(b"Content-Length", b"Content-Len"),
                 lambda r: r[:-40], lambda r: b"XXXX" + r[4:]):
        bad = [*raw[:3], hurt(raw[3]), *raw[4:]]
        data = warc.member(b"".join(bad)) + warc.member(raw[0])
        got = list(warc.salvage(data))
        assert ids(got) == urns[:3] + urns[4:] + urns[:1]
        gaps = [g[1:] for g in got if g[0] is None]
        assert len(gaps) == 1 and gaps[0][0] == 0 and gaps[0][2]


def test_what_precedes_the_break_of_a_member_is_read():
    raw, urns = several()
    whole = warc.member(b"".join(raw))
    flipped = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
    assert ids(warc.salvage(flipped)) == urns  # only the checksum is wrong
    assert ids(warc.salvage(flipped + warc.member(raw[2]))) == urns + urns[2:3]
    blocks = [random.Random(i).randbytes(20_000) for i in range(10)]
    long = [warc.record(i, "u", b, warc.base32_sha1(b), None, False) for i, b in enumerate(blocks)]
    names = [warc.parse(r)[0]["head"]["warc-record-id"] for r in long]
    data = warc.member(b"".join(long))
    for cut in (len(data) - 1, len(data) // 2, len(data) // 10, 30):
        found_ = ids(warc.salvage(data[:cut]))
        assert found_ == names[:len(found_)] and len(found_) >= 10 * cut // len(data) - 1
    broken = bytearray(data)
    at = len(data) // 2
    broken[at:at + 400] = b"\xff" * 400
    got = ids(warc.salvage(bytes(broken) + warc.member(raw[5])))
    assert got[-1] == urns[5] and got[:4] == names[:4]
