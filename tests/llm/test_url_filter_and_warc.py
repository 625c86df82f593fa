import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parchment.llm import warc
from parchment.llm.url_filter import RULES_SCHEMA, filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "/x", "block"), ("a.b", "", "allow"), ("b", "/x/y", "allow"), ("dup", "/", "allow"), ("dup", "/", "block")]


def brute(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def urls():
    r = random.Random(5)
    hosts = ["x.net", "net", "www.EXAMPLE.net", "example.net.", "example.com", "q.example.com", "a.org", "fr.org", "a.b", "z.a.b", "b", "dup", "notexample.net", "", "u@h:80.net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/de/x/y?q=/en/", "/fr/#/a", "?x", "/x", "/xy", "/x/y/z", "//", "/en//"]
    made = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    return [*made, None, "", "no scheme", "http://", "a://b://c/x", "HTTP://N.NET/\nline", "http://" + "a." * 300 + "net/" + "d/" * 500]


def test_filter_agrees_with_brute_force(spark):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, verdict string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, spark.createDataFrame(RULES, RULES_SCHEMA)).collect()}
    for i, u in rows:
        assert got[i] == brute(u, RULES), u


def test_filter_edges(spark):
    rules, none = spark.createDataFrame([*RULES, (None, "/", "block"), ("q", None, "block")], RULES_SCHEMA), spark.createDataFrame([], RULES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in filter_urls(pages, rules).orderBy("host").collect()] == ["allow", "block", "block"]
    assert filter_urls(pages, none, default="block").where("verdict = 'block' and rule is null").count() == 3
    assert filter_urls(pages.limit(0), rules).count() == 0


def page_rows():
    big = "ä" * 60
    return [(3, "http://a\nb", big), (1, "u1", big), (2, None, big), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (8, "u8", "y" * 100), (9, "u9", "y" * 99), (10, "u10", "y" * 99),
            (11, "u11", "y" * 100), (12, "100%25", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (None, "n", big), (2**53 + 1, "l", "z" * 200), (2**53, "l", "z" * 200)]


@pytest.mark.parametrize("most", [0, 1000])
def test_archives_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST_RECORDS", most)
    pages = spark.createDataFrame([(*r, "extra") for r in page_rows()], "page_id long, url string, html string, payload string")
    normal = warc.normalise_archives(warc.write_archives(warc.mark_revisits(pages)))
    got = {r["page_id"]: r for r in warc.read_archives(normal, warc.sidecar_index(normal)).collect()}
    assert len(got) == len(page_rows())
    for i, url, html in page_rows():
        data = (html or "").encode()
        same = [p for p, _, h in page_rows() if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 100 and i != min(same)
        r = got[i]
        assert r["payload_bytes"] == len(data) and r["url"] == url and r["intact"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if revisit else ("response", None))
        assert bytes(r["payload"]) == (b"" if revisit else data)
    none = warc.normalise_archives(warc.write_archives(warc.mark_revisits(pages.limit(0))))
    assert warc.mark_revisits(pages.limit(0)).count() == 0 and warc.read_archives(none, warc.sidecar_index(none)).count() == 0
    some = warc.sidecar_index(normal).where(F.col("record_id") == warc.record_id(8))
    assert [r["page_id"] for r in warc.read_archives(normal, some).collect()] == [8]


def test_every_record_is_a_member_of_its_own(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string")
    normal = warc.normalise_archives(warc.write_archives(warc.mark_revisits(pages)))
    index = warc.sidecar_index(normal).collect()
    assert len(index) == 20
    for row in normal.collect():
        whole = gzip.decompress(bytes(row["data"]))
        assert whole == b"".join(zlib.decompress(bytes(row["data"][o["offset"] : o["offset"] + o["length"]]), 31) for o in row["offsets"])


def test_cut_archives_are_found():
    record = warc.make_record(1, "u", "response", None, 3, "x", b"abc")
    zipped = gzip.compress(record * 3)
    assert len(warc.normalise(zipped)[1]) == 3
    with pytest.raises(ValueError):
        warc.normalise(zipped[:-12])
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(record + record[:-2]))


def test_all_members_of_an_archive_are_read():
    """Members of one and of several records, a stream of many, and zeros behind the last."""
    records = [warc.make_record(i, f"u{i}", "response", None, 3, "x", b"ab" + bytes([97 + i]) * (1 + 9000 * (i % 3))) for i in range(8)]
    mixed = gzip.compress(records[0]) + gzip.compress(b"".join(records[1:4])) + gzip.compress(b"") + b"".join(map(gzip.compress, records[4:])) + bytes(7)
    whole = gzip.compress(b"".join(records))
    for data in (mixed, whole):
        normal, offsets = warc.normalise(data)
        assert [zlib.decompress(normal[o["offset"] : o["offset"] + o["length"]], 31) for o in offsets] == records
        assert [o["record_id"] for o in offsets] == [warc.record_id(i) for i in range(8)]
    with pytest.raises(ValueError):
        warc.normalise(mixed + b"not gzip")
    with pytest.raises(ValueError):
        warc.normalise(mixed[:-7] + gzip.compress(records[0])[:-3])
    assert warc.normalise(gzip.compress(b"")) == (b"", [])


def test_records_are_http_responses():
    record = warc.make_record(7, "http://a/", "response", None, 5, "d", b"hello")
    head, http, payload = record[:-4].split(b"\r\n\r\n", 2)
    assert http.startswith(b"HTTP/1.1 200 ") and payload == b"hello"
    fields = warc.parse_head(head)
    assert fields["content-type"].startswith("application/http") and int(fields["content-length"]) == len(http) + 4 + len(payload)
    got = warc.parse_head(b"WARC/1.0\r\ncontent-LENGTH:12\r\nX-Y:  a: b ")
    assert got == {"content-length": "12", "x-y": "a: b"}
