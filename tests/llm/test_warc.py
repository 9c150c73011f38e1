import base64
import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

from quirespark.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, (-1 << 63)), -1 << 63 if i is None else i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        kept = best.get(b, -1 << 63)
        again = kept > (-1 << 63 if i is None else i) and kept > -1 << 63
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", kept if again else None] += 1
    return out


ROWS = [
    (1, "http://a/", "x" * 3000),
    (2, "http://b/\r\nX-Page-ID: 9", "x" * 3000),
    (3, None, None),
    (4, "http://c/ä", ""),
    (5, "http://d/", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 60),
    (6, "http://e/", "ab\r\n\r\n" * 200_000),
    (7, "http://f/", "\r\n\r\nWARC/1.1\r\n"),
    (8, "http://g/", "short"),
    (9, "http://g/", "short"),
    (None, "http://h/", "x" * 3000),
    (10, "http://i/", "y" * 999),
    (11, "http://i/", "y" * 999),
    (12, "http://i/", "z" * 1000),
    (12, "http://i/", "z" * 1000),
]


def test_query_against_brute_force(spark, small):
    out = warc.op1_warc_chunks(spark, small(pages=(ROWS, PAGES))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == expected(ROWS)
    assert {r.page_id: r.segments for r in out}[6] == 1_200_000 // 65_536 + 1


def test_payloads_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h) for i, u, h in ROWS], "page_id long, url string, payload string")
    warc.write(pages.where("page_id in (3, 4, 5, 7, 8)"), f"{tmp_path}/w", chunk_bytes=7)
    parts = warc.read_chunks(spark, f"{tmp_path}/w").collect()
    page = {r.record_id: r.page_id for r in parts if r.type == "response"}
    got = {}
    for r in sorted(parts, key=lambda r: (r.segment or 1, r.chunk_no)):
        i = page[r.origin or r.record_id]
        got[i] = got.get(i, b"") + bytes(r.chunk)
    assert got == {i: (h or "").encode() for i, _, h in ROWS if i in (3, 4, 5, 7, 8)}


def plain(path):
    """The records of an archive by the standard alone: fields and block."""
    data, out = b"".join(gzip.open(p).read() for p in sorted(Path(path).glob("*.gz"))), []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        out.append((fields, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def test_archives_are_valid(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h) for i, u, h in ROWS], "page_id long, url string, payload string")
    for run in ("a", "b"):
        warc.write(pages, f"{tmp_path}/{run}")
    records = plain(f"{tmp_path}/a")
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(ids)) == len(ids) and not set(ids) & {f["WARC-Record-ID"] for f, _ in plain(f"{tmp_path}/b")}
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}"
    by_id = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    for f, block in records:
        assert re.fullmatch(f"<urn:uuid:{uuid}>", f["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) and f["WARC-Target-URI"]
        if f["WARC-Type"] == "revisit":
            kept, _ = by_id[f["WARC-Refers-To"]]
            assert kept["WARC-Type"] == "response" and kept["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and kept["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"]
            assert f["WARC-Profile"] == warc.PROFILE and block == warc.HTTP.encode()
        elif f["WARC-Type"] == "response" and "WARC-Segment-Number" in f:
            rest = sorted((int(g["WARC-Segment-Number"]), b, g) for g, b in records if g.get("WARC-Segment-Origin-ID") == f["WARC-Record-ID"])
            whole = block + b"".join(b for _, b, _ in rest)
            assert [n for n, *_ in rest] == list(range(2, len(rest) + 2)) and int(rest[-1][2]["WARC-Segment-Total-Length"]) == len(whole)
            assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(whole[len(warc.HTTP) :]).hexdigest()
        elif f["WARC-Type"] == "response":
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block[len(warc.HTTP) :]).hexdigest()


def record(kind, block, **fields):
    lines = [f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"content-length:{len(block)}"]
    return "\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_made_elsewhere(spark, tmp_path):
    """Other fields, other cases, version 1.0, binary payloads that hold whole records, digests in base 32, segments in another file."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    bad = b"\xff\xfe\x00\n\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    sha = "sha1:" + base64.b32encode(hashlib.sha1(bad).digest()).decode()
    one = record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields")
    one += record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/http; msgtype=request")
    one += record("response", http + bad, WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="<http://a/>", WARC_Payload_Digest=sha, Content_Type="Application/HTTP; msgtype=response")
    one += record("resource", b"plain", WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://b/", Content_Type="text/plain")
    one += record("revisit", b"", WARC_Record_ID="<urn:uuid:4>", WARC_Target_URI="http://c/", WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest=sha)
    one += record("response", http + b"first ", WARC_Record_ID="<urn:uuid:5>", WARC_Target_URI="http://d/", WARC_Segment_Number=1, Content_Type="application/http")
    two = record("continuation", b"second", WARC_Record_ID="<urn:uuid:6>", WARC_Target_URI="http://d/", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<urn:uuid:5>", WARC_Segment_Total_Length=12 + len(http))
    (tmp_path / "x.warc").write_bytes(one)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(two[:-4]))
    out = sorted((r.url, r.payload_bytes, r.payload_digest, r.record_type, r.segments) for r in warc.read(spark, str(tmp_path)).collect())
    digest = lambda b: hashlib.sha1(b).hexdigest()
    assert out == [
        ("http://a/", len(bad), digest(bad), "response", 1),
        ("http://b/", 5, digest(b"plain"), "resource", 1),
        ("http://c/", len(bad), digest(bad), "revisit", 1),
        ("http://d/", 12, digest(b"first second"), "response", 2),
    ]


@pytest.mark.parametrize("data", [b"hello\n", record("response", b"abc")[:-6], record("response", b"abc", WARC_Payload_Digest="sha1:" + "0" * 40), record("response", b"abc").replace(b"content-length:3\r\n", b"")])
def test_broken_archives_raise(spark, tmp_path, data):
    (tmp_path / "x.warc").write_bytes(data)
    with pytest.raises(Exception, match="record|digest"):
        warc.read(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("size", [1, 2, 5, 64, 10_000])
def test_parser_takes_parts_of_any_size(size):
    data = record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"a\r\n\r\nb" * 50, WARC_Record_ID="<1>", Content_Type="application/http") + record("metadata", b"", WARC_Record_ID="<2>")
    p = warc.Parser("x", 8, True)
    rows = [r for n in range(0, len(data), size) for r in p.feed(data[n : n + size])]
    p.close()
    first = [r for r in rows if r[0] == "<1>"]
    assert b"".join(r[10] for r in first) == b"a\r\n\r\nb" * 50 and [r[8] for r in first] == list(range(len(first))) and [r[9] for r in first] == [False] * (len(first) - 1) + [True]
    assert first[-1][11:] == (300, hashlib.sha1(b"a\r\n\r\nb" * 50).hexdigest()) and rows[-1][0] == "<2>" and rows[-1][10] == b""


def test_clashing_columns(spark):
    with pytest.raises(ValueError, match="running_bytes"):
        warc.chunk_table(spark.createDataFrame([("x", 1)], "payload string, last int"))


def test_running_digests(spark):
    text = "häµ" * 50
    rows = warc.chunk_table(spark.createDataFrame([(1, text)], "page_id long, payload string"), 11).collect()
    b = text.encode()
    assert [r.running_digest for r in rows] == [hashlib.sha1(b[: 11 * (i + 1)]).hexdigest() for i in range(len(rows))]
    assert b"".join(bytes(r.chunk) for r in rows) == b and rows[-1].last


def test_empty(spark, small):
    assert warc.op1_warc_chunks(spark, small(pages=([], PAGES))).count() == 0


def test_version_lines_next_to_headers_and_ends(spark, small):
    v = "WARC/1.1"
    texts = [f"{v}\r\nabc", f"\r\n{v}\r\nabc", f"\r\n\r\n{v}", v, f"\r\n{v}", "x" * 65_536 + f"{v}\r\n\r\nabc", "x" * 65_534 + f"\r\n\r\n{v}\r\nabc", "x" * 65_524 + f"\r\n\r\n{v}\r\nabc", f"{v} in {v}{v}"]
    rows = [(i, f"http://{i}/", t) for i, t in enumerate(texts)]
    out = warc.op1_warc_chunks(spark, small(pages=(rows, PAGES))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == expected(rows)
