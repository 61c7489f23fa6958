import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from rastrum.llm.warc import arc_records, base32_sha1, convert, read_arc, read_warc, warc_date, warc_records, write_arc

SCHEMA = "page_id long, url string, html string, name string, block string, key string"
LONG = "line\n" * 40_000 + "x" * 300_000
PAGES = [
    (1, "http://a.example/", "same page\r\n\r\nwith empty lines\n"), (9, "http://b.example/?q=a b\tc", "same page\r\n\r\nwith empty lines\n"), (4, None, "same page\r\n\r\nwith empty lines\n"), (2, "", None), (3, "u", ""),
    (5, "http://long.example/", LONG), (6, "http://x.example/ü", "WARC/1.1\r\n\r\n\r\n\r\nfiledesc:// ü \u0000 1"), (None, "n", "no id"), (None, "n", "no id"), (7, "n", "no id"), (8, "t", "twice"), (8, "t", "twice"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "n", "b", "k") for p in PAGES], SCHEMA)


def lines(data):
    return iter(data.split(b"\n"))


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected():
    tops = {}
    for page, _, html in PAGES:
        tops[html or ""] = max(tops.get(html or "", -1), -1 if page is None else page)
    out, whole = [], set()
    for page, _, html in PAGES:
        top, html = tops[html or ""], html or ""
        first = (page if page is not None else -1) == top and html not in whole
        whole |= {html} if first else set()
        out.append((page if page is not None else -1, len(html.encode()), digest(html), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast, parts", [(1000, 1), (0, 5)])
def test_round_trip(spark, pages, tmp_path, most_broadcast, parts):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    write_arc(pages.repartition(parts), arc)
    versions = {r.version for r in read_arc(spark, arc).collect()}
    assert versions == ({"1"} if parts == 1 else {"1", "2"})
    convert(spark, arc, warc, most_broadcast=most_broadcast)
    got = read_warc(spark, warc, payloads=True).collect()
    assert sorted([(-1 if r.key is None else r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected()
    assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(PAGES)
    texts = {p[0]: p[2] or "" for p in PAGES}
    assert all(bytes(r.payload).decode() == texts[r.key] for r in got if r.payload is not None and r.key is not None)
    assert {r.url for r in got if r.key in (9, 4, 2)} == {"http://b.example/?q=a%20b%20c", None}
    # What any reader of the format sees: declared lengths lead from record to record, and revisits name records that exist
    ids, refers = set(), set()
    for f in (tmp_path / "warc").glob("*.gz"):
        data = io.BytesIO(gzip.decompress(f.read_bytes()))
        while first := data.readline():
            assert first == b"WARC/1.1\r\n"
            fields = dict(x.split(b": ", 1) for x in iter(lambda: data.readline().rstrip(b"\r\n"), b""))
            assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields)
            data.read(int(fields[b"Content-Length"]))
            assert data.read(4) == b"\r\n\r\n"
            if fields[b"WARC-Type"] == b"response":
                ids.add(fields[b"WARC-Record-ID"])
            refers.add(fields.get(b"WARC-Refers-To", b""))
    assert len(ids) == 6 and refers - {b""} <= ids


def test_least_bytes_and_empty(spark, pages, tmp_path):
    arc = str(tmp_path / "arc")
    write_arc(pages, arc)
    convert(spark, arc, str(tmp_path / "warc"), least_bytes=6)
    got = read_warc(spark, str(tmp_path / "warc"))
    assert got.where("record_type = 'revisit'").select(F.max("payload_bytes"), F.min("payload_bytes")).first()[:] == (30, 30) and got.count() == len(PAGES)
    write_arc(pages.where("page_id = -1"), str(tmp_path / "none"))
    convert(spark, str(tmp_path / "none"), str(tmp_path / "none_warc"))
    assert read_warc(spark, str(tmp_path / "none_warc")).count() == 0


def test_header_lines_of_both_versions():
    v1 = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\nhttp://a b/ 1.2.3.4 199609231421 text/html 8\nab\ncd\n\ne\n\n\ndns:x 0.0.0.0 - text/dns 3\nabc"
    got = list(arc_records("f", lines(v1)))
    assert [(r["url"], r["date"], r["block"], r["truncated"]) for r in got[:1]] == [("http://a b/", "1996-09-23T14:21:00Z", b"ab\ncd\n\ne", False)] and got[0]["ip"] == "1.2.3.4"
    about = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc %d\n" % len(about) + about + b"\nhttp://c/ 1.1.1.1 20010203040506 image/gif 200 abc - 212 b.arc 5\n\xff\xfe"
    got = list(arc_records("f", lines(v2)))
    assert [(r["version"], r["mime"], r["block"], r["truncated"]) for r in got] == [("2", "image/gif", b"\xff\xfe\n", True)]
    with pytest.raises(ValueError, match="version block"):
        list(arc_records("f", lines(b"http://a/ 1.2.3.4 19960923142103 text/html 8\n")))
    with pytest.raises(ValueError, match="header line at"):
        list(arc_records("f", lines(v2.replace(b"b.arc 5", b"b.arc five"))))
    assert warc_date("2001", "") == "2001-01-01T00:00:00Z" and warc_date("-") == "1970-01-01T00:00:00Z" and base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_other_bytes(spark, tmp_path):
    """Records that are no HTTP and no UTF-8 keep their bytes."""
    (tmp_path / "arc").mkdir()
    body = bytes(range(256)) * 3
    about = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about + b"\nhttp://a/ 1.2.3.4 19960923142103 image/gif %d\n" % len(body) + body + b"\n"
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (row,) = read_warc(spark, str(tmp_path / "warc"), payloads=True).collect()
    assert row.record_type == "resource" and bytes(row.payload) == body and row.intact and row.date == "1996-09-23T14:21:03Z"
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert [r["warc-type"] for r in warc_records("f", lines(raw))] == ["warcinfo", "resource"] and b"WARC-IP-Address: 1.2.3.4\r\n" in raw
