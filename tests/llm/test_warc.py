import base64
import glob
import gzip
import hashlib
import io
import time
from html.parser import HTMLParser

import pytest

from sievector.llm import html, warc
from sievector.llm.queries import op2_warc_derivatives

PAGE = """<!DOCTYPE html><html lang="EN"><head><title>A &amp; B</title><style>p{}</style></head><body><nav><a href="/x#top">x</a></nav>
<script>var t="<a href='no'>";</script><!-- <a href="no2"> --><p>One <b>two</b>&nbsp;three<br>four</p><a href='http://o.example/'>o</a><a href="/x">again</a>
<img src=pic.png><a href="javascript:void(0)">j</a><div>5 &lt; 6"""


def test_text_and_links():
    assert warc.plain_text(PAGE) == "x\nOne two three\nfour\noagain\nj\n5 < 6"
    assert warc.links(PAGE, "http://h.example/d/p.html") == [("href", "http://h.example/x"), ("href", "http://o.example/"), ("src", "http://h.example/d/pic.png")]


def test_links_of_scripts():
    page = """<script src="/a.js"></script><SCRIPT async src='b.js'>var t = "<a href='no'>";</SCRIPT><style>/* <img src=no> */</style>
<!-- <script src="no.js"></script> --><script>"<img src=no>"</script><a href="/x">x</a><script defer src="c.js">"""
    assert [u for _, u in warc.links(page, "http://h.example/d/")] == [f"http://h.example/{x}" for x in ("a.js", "d/b.js", "x", "d/c.js")]


def test_records():
    fields, block = warc.response(1, "http://h.example/", PAGE, "2024-01-01T00:00:00Z")
    found = warc.derive(fields, block)
    assert [k for k, _, _, _ in found] == ["metadata", "conversion"]
    source = dict(fields)
    assert source["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    for _, head, text, _ in found:
        own = dict(head)
        assert own["WARC-Refers-To"] == source["WARC-Record-ID"] != own["WARC-Record-ID"]
        assert own["WARC-Date"] == source["WARC-Date"] and own["WARC-Target-URI"] == source["WARC-Target-URI"]
        assert own["WARC-Block-Digest"] == warc.digest(text.encode()) and int(own["Content-Length"]) == len(text.encode())
    meta = found[0][2].split("\r\n")
    assert "title: A & B" in meta and "language: en" in meta and "source-header: HTTP/1.1 200 OK" in meta and f"source-payload-digest: {source['WARC-Payload-Digest']}" in meta
    assert found == warc.derive(*warc.response(1, "http://h.example/", PAGE, "2024-01-01T00:00:00Z"))


def test_captures_have_ids_of_their_own():
    ids = {dict(warc.response(*x)[0])["WARC-Record-ID"] for x in ((1, "u", "AAA", "d"), (1, "u", "BBB", "d"), (2, "u", "AAA", "d"), (1, "v", "AAA", "d"), (1, "u", "AAA", "e"), (None, "u", "AAA", "d"), (None, "u", "BBB", "d"))}
    assert len(ids) == 7


class Reader(HTMLParser):
    """Links and text by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.shown, self.inside = [], [], []

    def handle_starttag(self, tag, attrs):
        kind = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}.get(tag)
        if kind and (dict(attrs).get(kind) or "").strip():
            self.found.append((kind, dict(attrs)[kind].strip()))
        if tag in ("script", "style", "title", "head"):
            self.inside.append(tag)
        if tag in html._LINES:
            self.shown.append("\n")

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)
        elif tag in html._LINES:
            self.shown.append("\n")

    def handle_data(self, data):
        if not self.inside:
            self.shown.append(data)


def test_against_the_standard_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        reader = Reader()
        reader.feed(r["html"])
        reader.close()
        page = html.read(r["html"])
        assert page.links == reader.found
        assert page.text.split() == "".join(reader.shown).split()


def test_quotes_and_unclosed_tags():
    page = html.read("""<p title="a > b">one</p><a href="x>y" HREF='no'>two</a><p it's>three <b and the rest""")
    assert page.links == [("href", "x>y")] and page.text == "one\ntwo\nthree"
    assert html.read("a < b <3 c").text == "a < b <3 c"
    assert html.read("<title>t</title><textarea><b>raw</textarea><template><a href=x>no</a></template>yes").text == "<b>raw yes"


@pytest.mark.parametrize("part", ["<a ", "<a href", "<a href='", '<a href="', "<", "<!--", "<script>", "</", "<a =", "<a = ", "<p>", "&", "<title>", "a" * 40 + "<"])
def test_hostile_pages(part):
    """A megabyte of anything takes about as long as a megabyte of text."""
    page, start = part * (1_000_000 // len(part)), time.process_time()
    warc.plain_text(page)
    warc.links(page, "http://h.example/")
    assert time.process_time() - start < 3


SOURCE = [
    ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
    (
        [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://h.example/a"), ("WARC-Date", "2020-02-02T02:02:02Z"), ("WARC-Payload-Digest", warc.digest(b"<p>\xe9t\xe9<a href=b>b</a>"))],
        b"HTTP/1.1 200 OK\r\nServer: s\r\nX-Long: one\r\n two\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>\xe9t\xe9<a href=b>b</a>",
    ),
    ([("warc-type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://h.example/z"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 404 Not Found\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"<h1>gone")),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "dns:h.example")], b"20200202020202\nh.example. 1 IN A 1.2.3.4"),
]


def test_warc_files(spark, tmp_path):
    """Headers of the source come through, from plain and gzipped files; what isn't an HTTP response gives nothing."""
    members = [warc.serialised(f, b) for f, b in SOURCE]
    (tmp_path / "a.warc").write_bytes(b"".join(members))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.responses(spark, f"{tmp_path}/*.warc*").collect()
    for name in ("a.warc", "b.warc.gz"):
        own = [r for r in rows if r["path"].endswith("/" + name)]
        assert [(r["record_type"], r["refers_to"]) for r in own] == [(k, f"<urn:uuid:{i}>") for i in (1, 2) for k in ("metadata", "conversion")]
        meta = own[0]["block"].split("\r\n")
        assert meta[:4] == ["source-header: HTTP/1.1 200 OK", "source-header: Server: s", "source-header: X-Long: one two", "source-header: Content-Type: text/html; charset=ISO-8859-1"]
        assert "outlink: http://h.example/b L href" in meta and f"source-payload-digest: {dict(SOURCE[1][0])['WARC-Payload-Digest']}" in meta and own[1]["block"] == "étéb"
        assert "WARC-Date: 2020-02-02T02:02:02Z" in own[0]["warc_headers"] and own[3]["block"] == "gone"
        assert "source-payload-digest: sha1:WRONG" in own[2]["block"] and "payload-digest-found: sha1:" in own[2]["block"]
    assert len(rows) == 8


def test_round_trip(spark, odd_pages, tmp_path):
    """Records written and read again are the same, digests included."""
    folder = f"{tmp_path}/out"
    assert sum(r["records"] for r in warc.write(warc.captures(odd_pages), folder).collect()) == odd_pages.count()
    kept = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_links", "warc_headers", "block")
    direct = warc.derivatives(odd_pages).select(*kept)
    assert sorted(warc.responses(spark, folder + "/*.gz").select(*kept).collect()) == sorted(direct.collect())
    out = f"{tmp_path}/derived"
    warc.write(direct, out).collect()
    found = []
    for path in glob.glob(out + "/*.warc.gz"):
        with open(path, "rb") as f:
            for fields, block in warc.records(f):
                assert warc.field(fields, "WARC-Block-Digest") == warc.digest(block)
                found.append((warc.field(fields, "WARC-Record-ID"), block.decode()))
    assert sorted(found) == sorted((r["record_id"], r["block"]) for r in direct.collect())


@pytest.mark.parametrize("data", [b"no warc", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"])
def test_broken_files(data):
    with pytest.raises(ValueError, match="WARC record"):
        list(warc.records(io.BytesIO(data)))


def test_query(spark):
    rows = op2_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages) == len({r["record_id"] for r in rows})
    for r in rows:
        page = pages[r["page_id"]]
        assert r["target_uri"] == page["url"] and r["payload_digest"] == warc.digest(page["html"].encode())
        if r["record_type"] == "conversion":
            assert r["text"] == warc.plain_text(page["html"]) and "<p>" not in r["text"]
        else:
            assert r["n_links"] == len(warc.links(page["html"], page["url"]))


@pytest.fixture
def odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://[bad", "<a href='//[x'>y"), (2, "u", ""), (3, "http://h.example/", "<p>é " + "long " * 100000), (4, "http://h.example/", PAGE), (4, "http://h.example/", "other")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS block", "2 AS record_id", "3 AS text")


def test_odd_pages(odd_pages):
    found = warc.derivatives(odd_pages).collect()
    assert len(found) == 14 and warc.derivatives(odd_pages.limit(0)).count() == 0
    assert len({r["record_id"] for r in found}) == 12  # the row that repeats gives its records again
