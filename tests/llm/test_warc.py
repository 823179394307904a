import base64
import hashlib
import os

from jointwork.llm import warc
from jointwork.llm.registry import ship
from jointwork.operators.skew import shared_dir


def pages(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def read(data):
    return list(warc.salvage(lambda at, n: data[at : at + n], len(data)))


def test_round_trip_with_revisits(spark):
    big = "ß" * 300_000
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", None), (2, "u 2", ""), (4, "u4", big), (None, "u", "same"), (None, "v", "alone"), (4, "u4", big)]
    files = warc.write_archives(pages(spark, rows), shared_dir(spark, "test-warc"))
    found = warc.read_archives(files).collect()
    assert all(r["problem"] is None for r in found)
    first = {"same": 3, "": 1, big: 4, "alone": None}
    want = []
    for p, _, html in rows:
        data = (html or "").encode()
        f = first[html or ""]
        revisit = f is not None and f != p
        want.append((warc.page_urn(p), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", warc.page_urn(f) if revisit else None))
    assert sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(want, key=str)
    assert {bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"} == {"same", "", big, "alone"}
    assert warc.read_archives(warc.write_archives(pages(spark, rows).limit(0), shared_dir(spark, "test-warc"))).count() == 0


def test_salvage_of_damaged_members():
    plain = [warc.record_bytes(i, f"http://a/{i}", os.urandom(3000) + b"WARC/1.1 in a payload", None) for i in range(8)]
    members = [warc.gzip_member(p) for p in plain]
    damaged = list(members)
    damaged[2] = damaged[2][:100] + b"\0\0\0\0" + damaged[2][104:]  # flipped bytes
    damaged[4] = damaged[4][:-300]  # cut
    data = b"junk\x1f\x8b\x08 at the start" + b"".join(damaged) + members[0][:50]
    found = read(data)
    assert [h["warc-record-id"] for *_, p, h, _ in found if p is None] == [f"<urn:page:{i}>" for i in (0, 1, 3, 5, 6, 7)]
    gaps = [(b, e) for b, e, p, *_ in found if p]
    assert len(gaps) == 4 and gaps[0][0] == 0 and gaps[-1][1] == len(data)
    assert [b for b, *_ in found] == [0] + [e for _, e, *_ in found][:-1]  # every byte is in a record or a gap


def test_salvage_of_plain_records_and_digests():
    plain = [warc.record_bytes(i, None, f"body {i}".encode() * 20, None) for i in range(5)]
    wrong = plain[1].replace(b"body 1", b"body X", 1)
    data = plain[0] + wrong + plain[2] + plain[3].replace(b"Content-Length: 120", b"Content-Length: 999") + plain[4]
    found = read(data)
    assert [h["warc-record-id"] for *_, p, h, _ in found if p is None] == [f"<urn:page:{i}>" for i in (0, 2, 4)]
    assert [p for *_, p, _, _ in found if p][0] == "block digest"


def test_all_damaged_and_empty():
    assert read(b"") == []
    assert [x[:2] for x in read(b"nothing here" * 100)] == [(0, 1200)]
    member = warc.gzip_member(warc.record_bytes(1, None, b"", None))
    assert [x[2] for x in read(member)] == [None]


def test_headers_of_any_length(spark):
    urls = ["data:text/plain," + "a" * n for n in (65_000, 65_536, 70_000, 200_000)] + ["u"]
    plain = [warc.record_bytes(i, url, b"body" * 50, None) for i, url in enumerate(urls)]
    for records in (plain, [warc.gzip_member(p) for p in plain]):
        found = read(b"".join(records))
        assert [(p, h["warc-target-uri"]) for *_, p, h, _ in found] == [(None, url) for url in urls]
    bare = warc.record_bytes(3, "", b"x", None).index(b"\r\n\r\n")
    for n in range(6):  # the end of headers lies across the end of a step
        url = "u" * (4 * warc.HEAD_BYTES - bare - 5 + n)
        assert [(p, len(h["warc-target-uri"])) for *_, p, h, _ in read(warc.record_bytes(3, url, b"x", None))] == [(None, len(url))]
    files = warc.write_archives(pages(spark, [(i, url, f"html {i}") for i, url in enumerate(urls)]), shared_dir(spark, "test-warc"))
    assert sorted((r["record_id"], r["problem"]) for r in warc.read_archives(files).collect()) == [(warc.page_urn(i), None) for i in range(len(urls))]


def test_a_version_line_without_headers_is_left_soon():
    asked = []
    data = b"WARC/1.1\r\nno header\r\n" + b"x" * 1_000_000
    try:
        warc.record_at(lambda at, n: asked.append(n) or data[at : at + n], 0, len(data))
    except warc.Damaged as error:
        assert str(error) == "header line without colon"
    assert sum(asked) < 2 * warc.HEAD_BYTES
