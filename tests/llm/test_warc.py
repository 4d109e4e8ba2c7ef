import gzip
import hashlib
import os
import random
import tempfile

import pytest

from twinframe.llm import warc as W

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    big, odd = "x" * 1500 + "é", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(i, f"http://h{i}.net/a b\n{i}", "".join(rng.choice("ab\n\r<é") for _ in range(rng.randint(0, 3000)))) for i in range(40)]
    rows += [(100, "http://x", big), (101, "http://y", big), (105, "http://x", big), (105, "http://x", big), (None, "http://z", big)]
    rows += [(110, "u", "small"), (111, "u", "small"), (112, None, None), (113, "http://e", ""), (114, "http://q", odd), (115, "http://q", odd)]
    return rows + [(200, "http://n", "n" * 999), (201, "http://n", "n" * 999), (202, "http://n", "m" * 1000), (203, "http://n", "m" * 1000)]


def plain(rows):
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and h in last and i < last[h]
        yield i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None


def trip(spark, frame, **options):
    top = tempfile.mkdtemp(prefix="spark-")
    W.write_arc(frame, f"{top}/arc", **options)
    W.convert(spark, f"{top}/arc", f"{top}/warc", **options)
    got = W.resolve_revisits(W.read_warc(spark, f"{top}/warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return top, got.collect()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    rows = pages()
    _, got = trip(spark, spark.createDataFrame(rows, PAGES).repartition(4), compression=compression)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_both_arc_versions():
    for version, head in ((1, b"http://a 127.0.0.1 20200102030405 text/html 5\n"), (2, b"http://a 127.0.0.1 20200102030405 text/html 200 - - 0 - 5\n")):
        body = W.version_block(version, b"20200102030405") + b"\n" + head + b"1\n2\n3\n" + head + b"abcde\n"
        for raw in (body, gzip.compress(body), gzip.compress(body[:70]) + gzip.compress(body[70:])):
            got = list(W.arc_records(raw))
            assert [g["block"] for g in got] == [b"1\n2\n3", b"abcde"] and got[0]["url"] == b"http://a" and got[0]["date"] == b"20200102030405"
        with pytest.raises(ValueError, match="length"):
            list(W.arc_records(body[:-4]))
        other = (b"http://a 1 2 text/html 200 - - 0 - 5\n", b"http://a 1 2 text/html 5\n")[version - 1]
        with pytest.raises(ValueError, match="fields"):
            list(W.arc_records(W.version_block(version, b"2020") + b"\n" + other + b"abcde\n"))


def test_identifiers_dates_and_digests():
    assert W.record_id(b"u", b"2", "d", b"1") == W.record_id(b"u", b"2", "d", b"1") != W.record_id(b"u", b"2", "d", b"2")
    record = W.warc_record(b"response", b"<urn:uuid:1>", b"http://a", "20200102030405", "00" * 20, None, b"abc")
    (fields, block), = W.warc_records(record + b"\r\n\r\n")
    assert fields[b"warc-date"] == b"2020-01-02T03:04:05Z" and block == b"abc"
    assert fields[b"warc-payload-digest"] == b"sha1:" + b"A" * 32 and fields[b"content-length"] == b"3"


def test_empty_and_clashing(spark):
    assert trip(spark, spark.createDataFrame([], PAGES))[1] == []
    odd = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 as digest", "2 as record")
    assert len(trip(spark, odd)[1]) == len(pages())


def test_other_schemes_become_resources_with_type_and_address(spark):
    """Both versions: dns, FTP, a page without HTTP head and an undeclared type, read back from written files."""
    top = tempfile.mkdtemp(prefix="spark-")
    cases = [
        (b"dns:a.net", b"text/dns", b"20200102030405\na.net. 60 IN A 1.2.3.4\n", b"resource", b"text/dns"),
        (b"ftp://a.net/x.txt", b"text/plain", b"plain\r\n\r\ntext", b"resource", b"text/plain"),
        (b"file:///x", b"no-type", b"\x00\xff", b"resource", b"application/octet-stream"),
        (b"http://a.net/", b"text/html", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n<p>", b"response", b"application/http; msgtype=response"),
    ]
    os.makedirs(f"{top}/arc")
    for version in (1, 2):
        body = W.version_block(version, b"20200102030405") + b"\n"
        for url, mime, block, _, _ in cases:
            body += b"%s 1.2.3.4 20200102 %s%s %d\n%s\n" % (url, mime, b" 200 - - 0 -" if version == 2 else b"", len(block), block)
        with open(f"{top}/arc/part-{version}", "wb") as f:
            f.write(body)
    W.convert(spark, f"{top}/arc", f"{top}/warc", compression="none")
    found = []
    for name in sorted(os.listdir(f"{top}/warc")):
        if name.startswith("part-"):
            with open(f"{top}/warc/{name}", "rb") as f:
                found += [(h, b) for h, b in W.warc_records(f.read()) if h[b"warc-type"] != b"warcinfo"]
    assert len(found) == 8
    for url, _, block, kind, mime in cases:
        for fields, got in (x for x in found if x[0][b"warc-target-uri"] == url):
            assert (got, fields[b"warc-type"], fields[b"content-type"], fields[b"warc-ip-address"]) == (block, kind, mime, b"1.2.3.4")
            assert fields[b"warc-date"] == b"2020-01-02T00:00:00Z"
    back = W.resolve_revisits(W.read_warc(spark, f"{top}/warc")).collect()
    assert sorted((r.record_type, r.payload_bytes, r.page_id) for r in back if r.record_type == "resource") == sorted(("resource", len(c[2]), None) for c in cases[:3] * 2)


def test_archives_are_cut_by_size(spark):
    rows = [(i, f"http://h/{i}", ("y" * 400 + str(i % 7)) * 3) for i in range(400)]
    top, got = trip(spark, spark.createDataFrame(rows, PAGES).coalesce(1), compression="none", archive_bytes=16_000)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    sizes = [os.path.getsize(f"{top}/arc/{n}") for n in os.listdir(f"{top}/arc") if n.startswith("part-")]
    assert len(sizes) > 10 and max(sizes) < 16_000 + 16 * 1600


def test_hot_payloads_and_many_revisits_give_the_same(spark, monkeypatch):
    rows = [(i, "http://h", "z" * 1200 if i % 2 else f"{i}" * 600) for i in range(60)]
    want = sorted(plain(rows), key=str)
    split = W.join_by_count
    monkeypatch.setattr(W, "join_by_count", lambda *a, **k: split(*a, **k, hot_rows=3))
    monkeypatch.setattr(W, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, trip(spark, spark.createDataFrame(rows, PAGES).repartition(3))[1]), key=str) == want
