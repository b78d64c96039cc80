"""Archives: round trip, revisits, framing and digests."""

import gzip
import hashlib
import io

import pytest

from haulcast.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, refers_to long"


def member(page=1, payload=b"x" * 3_000, revisit=False):
    return warc.record_bytes(page, "http://a.example/\r\nX: y", payload, 9 if revisit else None, revisit)


def test_round_trip_of_edge_rows(spark):
    long = "ü<p>" * 400
    data = [(1, "http://a", long, "", 0), (5, None, long, "", 0), (5, "u", long, "", 0), (2, "http://b", None, None, 0),
            (3, "http://b", "", "", 0), (4, "http://c", "z" * 999, "", 0), (6, "http://c", "z" * 999, "", 0),
            (None, "http://d", long, "", 0), (7, "http://e", "q" * 3_000_000, "", 0)]
    got = sorted(map(tuple, warc.archive_round_trip(spark.createDataFrame(data, SCHEMA), 4_000).collect()), key=repr)
    want = []
    for page, _, html, *_ in data:
        body = (html or "").encode()
        other = 5 if html == long and page != 5 else None
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response", other))
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archive_is_gzip_of_records():
    data = member(1) + member(2, revisit=True)
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 2 and plain.endswith(b"\r\n\r\n") and b"\r\nX: y" not in plain
    first, second = warc.read_records(io.BytesIO(data))
    assert first.http()[1] == b"x" * 3_000 and second.http()[1] == b"" and second.http()[0]["content-length"] == "3000"
    assert second.headers["warc-refers-to"] == "<urn:page:9>"


def test_large_record_across_many_reads():
    payload = bytes(range(256)) * 20_000
    (record,) = warc.read_records(io.BytesIO(member(payload=payload)))
    assert record.http()[1] == payload
    (zeros,) = warc.read_records(io.BytesIO(member(payload=bytes(10 << 20))))
    assert len(zeros.http()[1]) == 10 << 20


def test_broken_archives():
    whole = member()
    plain = gzip.decompress(whole)
    for broken in (plain.replace(b"xxx", b"xyx", 1), plain[:-1], plain.replace(b"WARC/1.1", b"WORC/1.1"),
                   plain.replace(b"Content-Length: 30", b"Content-Length: 31", 2)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(broken))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(whole[:-9])))
