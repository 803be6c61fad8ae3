import base64
import hashlib

import pytest

from folioweave.llm import warc
from folioweave.llm.shared import SharedTables


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 8193, 70_000])
def test_framing(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_parse_rejects_a_cut_record():
    whole = b"".join(warc.records_of("1-0", "http://x", b"WARC/1.0\r\n\r\n" * 9, None, 40))
    assert sum(1 for _ in warc.parse(whole)) > 3
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-6]))


def test_round_trip(spark):
    html = [None, "", "a", "\r\n\r\nWARC/1.0\r\n", "é" * 60_000, "x" * 300_000, "y\n\n"]
    rows = [(i, f"http://h/{i}", h, 1) for i, h in enumerate(html)]
    rows += [(i + 100, None, h, 1) for i, h in enumerate(html)] + [(5, "http://h/5", "x" * 300_000, 1), (None, "u", "only"), (None, "u", "a")][:1]
    rows += [(None, "u", "a", 1), (None, "u\r\nX: y", "z", 1), (None, "u", "z", 1), (-3, "u", "neg", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -(10**9)), -(10**8) if i is None else i)
    want, used = [], set()
    for i, _, h, _ in sorted(rows, key=lambda r: -(10**8) if r[0] is None else r[0], reverse=True):
        b = (h or "").encode()
        first = h or ""
        kind = "revisit" if first in used else "response"
        used.add(first)
        to = None if kind == "response" or last[first] == -(10**8) else last[first]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, to))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.record_type == "response" for r in warc.round_trip(pages, least=10**9).collect())
    assert warc.round_trip(pages.where("false")).collect() == []


def test_payloads_come_back_and_a_missing_segment_fails(spark):
    tables = SharedTables(spark)
    body = bytes(range(256)) * 2000
    pages = spark.createDataFrame([(1, "u", bytearray(body)), (2, "v", bytearray(b"s"))], "page_id long, url string, payload binary")
    records = warc.read_archives(spark, warc.write_archives(tables, pages))
    back = {r.record_id.split("-")[0]: bytes(r.payload) for r in warc.reassemble(records).collect()}
    assert back == {"<urn:fw:1": body, "<urn:fw:2": b"s"}
    with pytest.raises(Exception, match="incomplete"):
        warc.reassemble(records.where("coalesce(headers['WARC-Segment-Number'], '') <> '2'")).collect()


def test_a_payload_of_hundreds_of_segments(spark):
    body = bytes(range(256)) * 160_000
    tables = SharedTables(spark)
    pages = spark.createDataFrame([(1, "u", bytearray(body))], "page_id long, url string, payload binary")
    records = warc.read_archives(spark, warc.write_archives(tables, pages))
    assert records.count() > 600
    assert warc.digest(bytes(warc.reassemble(records).first().payload)) == warc.digest(body)
