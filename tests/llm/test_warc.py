import base64
import gzip
import hashlib
import io
import json
import os
import sys
import time
import uuid
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from notarium.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style><script>var t="</p>";</script></head>
<body><nav><a href="/x">X</a> <a href='y?a=1&amp;b=2'>Y</a><a href=/x>again</a></nav><!-- gone <p> --><h1>Head&nbsp;line</h1><p><b>Bold</b> text<br>next é</p></body></html>"""
PAGES = [
    (1, "http://e.com/d/p", PAGE), (2, "http://e.com/", ""), (3, None, None), (1, "http://e.com/d/p", PAGE), (None, "http://[bad", "<a href='//[x'>q</a>"), (9, "http://big", "<p>word</p>" * 50000),
    (10, "http://e.com/a\r\nX-Injected: b\r\n\r\nc", "t &#9999999999999;"),
]
BLOCK_TAGS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "blockquote", "pre"}


class Page(HTMLParser):
    """What a page shows, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__()
        self.text, self.title, self.targets, self.hidden = "", None, [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.text += "\n"
        if tag == "a" and "href" in dict(attrs):
            self.targets.append(dict(attrs)["href"])
        if tag in ("script", "style", "title"):
            self.hidden.append(tag)
            if tag == "title" and self.title is None:
                self.title = ""

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.text += "\n"
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
        elif self.hidden[-1] == "title":
            self.title += data

    def lines(self):
        return [" ".join(x.replace("\xa0", " ").split()) for x in self.text.split("\n") if x.replace("\xa0", " ").strip()]


def derived(spark, pages=PAGES):
    return warc.derivatives_of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_records_are_linked(spark):
    rows = derived(spark).collect()
    assert len(rows) == 2 * len(PAGES)
    first = {r.record_type: r for r in rows if r.page_id == 1}
    about = json.loads(first["metadata"].block)
    assert about["title"] == "A & B" and about["links"] == ["http://e.com/x", "http://e.com/d/y?a=1&b=2"]
    assert about["conversion"] == first["conversion"].record_id and first["metadata"].refers_to == first["conversion"].refers_to == about["refers-to"]
    assert first["conversion"].block == "X Yagain\nHead line\nBold text\nnext é"
    assert first["conversion"].source_headers.startswith("HTTP/1.1 200") and first["conversion"].payload_digest == warc.digest(PAGE.encode())
    assert all(r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode()) for r in rows)
    assert {r.target_uri for r in rows if r.page_id == 10} == {"http://e.com/a%0D%0AX-Injected: b%0D%0A%0D%0Ac"}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query_matches_brute_force_on_the_whole_table(spark):
    from notarium.llm.queries import op8_warc_derivatives

    want = Counter()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page, payload = Page(r.html), r.html.encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        own = lambda kind, *parts: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join([kind, *map(str, parts)]))}>"
        source, text = own("response", r.page_id, r.url), "\n".join(page.lines())
        about = {
            "refers-to": source, "conversion": own("conversion", source), "response-block-digest": warc.digest(http.encode() + payload), "response-payload-digest": warc.digest(payload),
            "http-headers": http, "title": (page.title or "").strip(), "links": list(dict.fromkeys(urljoin(r.url, x) for x in page.targets)), "text-characters": len(text),
        }
        for kind, content, block in (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
            want[(r.page_id, kind, own(kind, source), source, r.url, "2024-01-01T00:00:00Z", content, warc.digest(block.encode()), warc.digest(payload), http, len(block.encode()), block)] += 1
    assert Counter(map(tuple, op8_warc_derivatives(spark, SF).collect())) == want


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<a ", "<", "<a href=\"", "<title>", "</", "<a " + " " * 50, "<a x='", "&#9", "<style", "<template>x", "<p", "</script", "<a =", "&"])
def test_unclosed_tags_take_linear_time(piece):
    page = piece * ((1 << 20) // len(piece))
    for p in (page, page + ">", "<a " + "x" * (1 << 20) + ">", "<a " + "x " * (1 << 19) + ">", "<a " + " " * (1 << 20) + ">"):
        began = time.perf_counter()
        _, pieces, _ = warc.scan(p)
        warc.plain_text(p, pieces)
        assert time.perf_counter() - began < 4


def test_text_that_is_no_tag_stays():
    assert warc.plain_text("a < b > c <3 <p>d<SCRIPT>x</scripty></Script >e") == "a < b > c <3\nde"
    assert warc.scan("<TITLE>T&lt;</Title><a HREF = q>1</a><a id=x href='r s' /><a>2</a>")[::2] == ("T<", ["q", "r s"])


def standard_records():
    """Records as other tools write them."""
    def record(fields, block, version="WARC/1.0"):
        return (f"{version}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    page = "<title>é</title><p>ça".encode("latin-1")
    zipped = gzip.compress(b"<p>zipped</p>")
    chunks = b"5\r\n<p>ab\r\n4;x=1\r\nc</p\r\n1\r\n>\r\n0\r\n\r\n"
    return [
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n"),
        record([("warc-type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "<http://a/b>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http;\r\n msgtype=response")],
               b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + page),
        record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>")], b"GET / HTTP/1.1\r\n\r\n"),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>")], b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + zipped, "WARC/1.1"),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:4>")], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:5>")], b""),
    ]


@pytest.mark.parametrize("form", ["plain", "members", "one"])
def test_standard_response_records(spark, tmp_path, form):
    records = standard_records()
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records))}[form]
    (tmp_path / "x.warc").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc",)], "file string")
    got = {r.record_id: r for r in warc.read_responses(files).collect()}
    assert set(got) == {f"<urn:uuid:{k}>" for k in (1, 3, 4, 5)}
    first = got["<urn:uuid:1>"]
    assert first.target_uri == "http://a/b" and first.payload == "<title>é</title><p>ça" and first.page_id is None and first.headers.startswith("HTTP/1.1 200 OK\r\n")
    assert first.payload_digest == warc.digest("<title>é</title><p>ça".encode("latin-1"))
    assert got["<urn:uuid:3>"].payload == "<p>zipped</p>" and got["<urn:uuid:4>"].payload == "<p>abc</p>" and got["<urn:uuid:5>"].payload == ""
    out = {(r.refers_to, r.record_type): r.block for r in warc.derive(warc.read_responses(files)).collect()}
    assert out["<urn:uuid:1>", "conversion"] == "ça" and json.loads(out["<urn:uuid:1>", "metadata"])["title"] == "é" and out["<urn:uuid:5>", "conversion"] == ""


def test_broken_files_are_errors():
    import io

    good = warc.to_bytes([("WARC-Type", "response")], b"abc")
    assert [b for _, b in warc.parse(io.BytesIO(good * 3))] == [b"abc"] * 3
    for bad in (good.replace(b"abc", b"abd"), good[:-6], good.replace(b"Content-Length: 3", b"X: 3"), b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS block", "'x' AS record_id")
    files = warc.write_pages(pages.repartition(3), f"file://{tmp_path}/r")
    listed = spark.createDataFrame(files.collect(), files.schema)
    assert sum(r.n for r in listed.collect()) == len(PAGES)
    records = warc.derive(warc.read_responses(listed))
    out = warc.write_warc(records, f"file://{tmp_path}/w")
    written = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(str, warc.read_warc(written).collect())) == sorted(map(str, records.collect()))


def test_empty(spark):
    assert derived(spark, []).count() == 0


def calls(work):
    """Calls that work takes: what it costs, whatever the machine."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(before)
    return n


def test_reading_a_record_takes_few_calls(tmp_path):
    one = warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"x" * 2000)
    (tmp_path / "r.warc.gz").write_bytes(b"".join(gzip.compress(one) for _ in range(300)))
    assert calls(lambda: list(warc.records_of(f"{tmp_path}/r.warc.gz"))) < 75 * 300


def test_digest_is_base_32():
    for n in range(300):
        assert warc.digest(b"x" * n) == "sha1:" + base64.b32encode(hashlib.sha1(b"x" * n).digest()).decode()


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_members(size):
    parts = [b"", b"a" * 300_000, os.urandom(200_000), b"b", os.urandom(70)]
    whole = b"".join(gzip.compress(p) + b"\0" * pad for p, pad in zip(parts, (0, 1, 70_000, 0, 3)))
    assert io.BufferedReader(warc.Members(io.BytesIO(whole)), size).read() == b"".join(parts)
    for cut in (5, 100_000, len(whole) - 10):
        with pytest.raises(EOFError):
            io.BufferedReader(warc.Members(io.BytesIO(whole[:cut])), size).read()


def test_paths_with_dots():
    for path in ("/no.", "/a.b/c", "/.", "/..", "/a/../b", "/a/./b", "/a.", "/a/..b", "/a..", "//x.y/z", "/a//b."):
        assert warc.links([path, path], "http://e.com/d/p") == [urljoin("http://e.com/d/p", path)]


def test_files_are_derived_in_one_map(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    files = warc.materialise(warc.write_pages(pages, f"{tmp_path}/r"), "files")
    one = warc.derive_files(files, f"{tmp_path}/one")
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    many = warc.write_warc(warc.derive(warc.read_responses(files)), f"{tmp_path}/many")
    assert sorted(r.n for r in one.collect()) == sorted(r.n for r in many.collect())
    got, want = ([sorted(map(str, warc.read_warc(spark.createDataFrame([(f"{tmp_path}/{d}/{x}",) for x in os.listdir(f"{tmp_path}/{d}")], "file string")).collect()))] for d in ("one", "many"))
    assert got == want and len(got[0]) == 2 * len(PAGES)
