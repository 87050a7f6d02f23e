"""Pages: extraction, archives and URL rules."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from lumenlog.llm import html_extract, queries, url_filter, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script><style>p{}</style></head><body>
<div class="site-header"><p>Top words here</p></div><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><!-- ad --><div class="ad">Buy now.</div>
<article><h1>The&nbsp;title &amp; more</h1><p><b>First   part.<br><p>Second &lt;part&gt; with <a href="/x">a link</a>
inside.</p><ul><li>item one</li><li>item two</li></ul><aside class="related"><p>Read this too</p></aside><p>Last a < b &am</p></article>
<aside class="sidebar"><h3>Side</h3><p>Side words that go on for a while, with some text.</p></aside><form class="newsletter"><p>Give your mail</p><label>Mail</label></form>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I like this a lot, it is a very good text.</p></div></div><footer>&copy; me</footer></body></html>"""
MAIN = "The title & more First part. Second <part> with a link inside. item one item two Last a < b &am"


@pytest.fixture(scope="module")
def model():
    return html_extract.train(250)


def test_a_page_of_every_kind(model):
    assert html_extract.main_text(PAGE, model) == MAIN


def test_held_out_pages(model):
    rng, right, count = random.Random(5), 0, 0
    for _ in range(60):
        nodes = html_extract.nodes_of(html_extract.parse(html_extract.training_page(rng)))
        taken = html_extract.decode(nodes, model.predict(html_extract.features(nodes)))
        for n, t in zip(nodes, taken, strict=True):
            if n.chars:
                count += 1
                right += ("data-main" in n.attributes) == bool(t)
    assert right / count > 0.98


def test_decoding_never_takes_below_what_is_left_out(model):
    nodes = html_extract.nodes_of(html_extract.parse(PAGE))
    taken = html_extract.decode(nodes, model.predict(html_extract.features(nodes)))
    assert all(not t for n, t in zip(nodes, taken, strict=True) if n.tag in ("nav", "footer", "form"))


def test_extract_edge_cases(spark, model):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", "plain words only", "x"), (5, "u", "<p>" * 2000 + "deep", "x"), (6, "u", "<article><p>" + "word " * 50000, "x")]
    got = {(r.page_id, r.text): r.n_chars for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()}
    assert got[1, MAIN] == len(MAIN) and got[2, ""] == 0 and got[None, ""] == 0
    assert got[6, ("word " * 50000).strip()] == 249999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


SEARCH = '<nav><form class="search"><input list="x"><datalist id="x"><option value="a"><option value="b"></datalist></form></nav>'
ARTICLE = "<article><h1>A title of it</h1>{}<p>The last words of a text that goes on for some time, as texts do.</p></article>"


@pytest.mark.parametrize(
    ("before", "inside", "wanted"),
    [
        (SEARCH, "", ""),
        ("", "<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p>", "So E=m holds. "),
        ("", '<object data="x"><p>Words in place of an object that is not shown here.</p></object>', "Words in place of an object that is not shown here. "),
        ("", "<canvas><p>Words in place of a canvas that is not shown here.</p></canvas>", "Words in place of a canvas that is not shown here. "),
        ("<div><button>Go</div><div><svg><path></div>", "", ""),
        ("<div><script>var x = 1;</div>", "", ""),
        ("<nav><ul><li><select><li><select><option>One</select></ul></nav>", "", ""),
        ("", "<p>More words of this same text.</p>" * 100, "More words of this same text. " * 100),
    ],
)
def test_nothing_of_the_article_is_lost(model, before, inside, wanted):
    page = f"<html><head><title>t</title></head><body>{before}{ARTICLE.format(inside)}<footer>&copy; me</footer></body></html>"
    assert html_extract.main_text(page, model) == f"A title of it {wanted}The last words of a text that goes on for some time, as texts do."


def test_the_share_of_like_siblings_has_no_bound():
    root = html_extract.parse("<div>" + "<p>a</p>" * 90 + "<ul></ul>" * 10 + "</div>")
    nodes = html_extract.nodes_of(root)
    shares = {n.tag: x for n, x in zip(nodes, html_extract.features(nodes)[:, 16], strict=True)}
    assert shares["p"] == 0.9 and shares["ul"] == 0.1


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_to_warc(version):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\n<p>\xc3\xa9\n\n</p>"
    data = warc.arc_version_block("a.arc", version, "20240101000000") + warc.arc_record("http://a/ b", "20010203040506", block, version, "a.arc") + warc.arc_record("http://c", "2001", b"HTTP/1.1 200 OK\r\n\r\n", version)
    one, two = warc.convert(data)
    assert one.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and one.headers["WARC-Target-URI"] == "http://a/%20b" and one.block == block
    assert one.headers["WARC-Record-ID"].startswith("<urn:uuid:") and one.headers["WARC-Record-ID"] == next(warc.convert(data)).headers["WARC-Record-ID"]
    again = list(warc.read_warc(warc.write_warc(one) + warc.write_warc(two)))
    assert [r.block for r in again] == [one.block, two.block]
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(data[:-10]))
    with pytest.raises(ValueError, match="doesn't have its digest"):
        list(warc.read_warc(warc.write_warc(one).replace(b"<p>", b"<q>")))


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u", big, 1), (2, "u", big, 1), (3, None, other, 1), (4, "v w\n", "small", 1), (5, "v", "small", 1), (6, "v", None, 1), (7, "v", "", 1), (2, "u", big, 1), (None, "n", big, 1), (8, "h", "a\r\n\r\nb" * 300, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes long")
    got = sorted((tuple(r) for r in warc.round_trip(pages).drop("url").collect()), key=repr)
    wanted = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        refers = 2 if html == big and i != 2 else None
        wanted.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(wanted, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    files = warc.export_files(warc.archive_pages(pages), str(tmp_path))
    assert files and all(f.endswith(".warc.gz") for f in files)


def test_url_rules(spark):
    rows = [
        (1, "https://a.example.org/es/1"), (2, "http://EXAMPLE.org/es/1?x"), (3, "http://badexample.org/es/1"), (4, "http://x.example.com/fr/a#b"), (5, "http://x.com/de/"), (6, "http://x.net/a"),
        (7, None), (8, "no scheme"), (9, "http://x.org"), (10, "http://"), (11, "http://example.org/en/12"), (11, "http://example.org/en/12"), (None, "http://x.org/q://r"), (13, "http://x.com?/fr/"), (14, "http://É.org/" + "a" * 9000),
    ]
    got = sorted((tuple(r) for r in url_filter.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string"), queries.URL_RULES).collect()), key=repr)

    def plain(i, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
        return i, host, path, best and best.text, best.verdict if best else "allow"

    assert got == sorted((plain(*r) for r in rows), key=repr)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), []).count() == 0
    with pytest.raises(ValueError, match="two verdicts"):
        url_filter.build_index([url_filter.Rule("a", "/", "allow"), url_filter.Rule("a", "/", "block")], "/tmp/none")


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda t: 5)
    path = str(tmp_path / "rules")
    url_filter.build_index([url_filter.Rule("a.org", "/x", "block"), url_filter.Rule("b.org", "/", "allow")], path)
    found = url_filter.DigestIndex(path).find([("s.a.org", "/xy"), ("b.org", "/q"), ("c.org", "/")])
    assert found == [("a.org/x", "block"), ("b.org/", "allow"), None]


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_records_of_all_kinds(version):
    http = b"HTTP/1.1 200 OK\r\n\r\nx"
    tail = " 200 abc - 0 a.arc" if version == "2" else ""
    data = warc.arc_version_block("a.arc", version, "20240101000000")
    data += f"http://a/b c 1.2.3.4 2001 text/html; charset=x{tail} {len(http)}\n".encode() + http + b"\n"
    data += warc.arc_record("dns:a.org", "200102", b"20010203040506\na.org 1 IN A 1.2.3.4\n", version, mime="text/dns")
    data += warc.arc_record("http://c", "20010203040506", http, version)
    first = warc.Original("<urn:uuid:0>", "http://a/b c", "2001", "7")
    info, page, name, again = warc.convert(data, [None, None, first], warcinfo=True)
    assert [r.type for r in (info, page, name, again)] == ["warcinfo", "response", "resource", "revisit"]
    assert info.headers["Content-Type"] == "text/plain" and info.headers["WARC-Filename"] == "a.arc" and "WARC-Target-URI" not in info.headers
    assert page.headers["WARC-Date"] == "2001-01-01T00:00:00Z" and page.headers["WARC-Target-URI"] == "http://a/b c" and page.block == http
    assert name.headers["Content-Type"] == "text/dns" and name.headers["WARC-Date"] == "2001-02-01T00:00:00Z" and name.block.startswith(b"2001")
    assert again.headers["WARC-Refers-To"] == "<urn:uuid:0>" and again.headers["WARC-Refers-To-Date"] == "2001-01-01T00:00:00Z" and again.block == b"HTTP/1.1 200 OK\r\n\r\n"
    assert again.headers["WARC-Payload-Digest"] == page.headers["WARC-Payload-Digest"]
    with pytest.raises(ValueError, match="fields of its version"):
        list(warc.read_arc(data + b"http://x text/html 3\nabc\n"))


def test_revisits_refer_to_records_that_are_there(spark):
    rows = [(i, f"http://x/{i} {i}", "p" * 2000 if i % 2 else "q" * i) for i in range(1, 12)]
    records = []
    for row in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        records += warc.read_warc(warc.gzip.decompress(row["content"]))
    there = {r.headers["WARC-Record-ID"]: r for r in records}
    revisits = [r for r in records if r.type == "revisit"]
    assert len(revisits) == 5 and len(there) == len(records)
    for r in revisits:
        target = there[r.headers["WARC-Refers-To"]]
        assert target.type == "response" and target.headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"]
        assert target.headers["WARC-Target-URI"] == r.headers["WARC-Refers-To-Target-URI"] and r.headers["WARC-Refers-To-Page"] == "11"


def test_quotes_in_unquoted_values_and_many_siblings(model):
    page = ARTICLE.format("<p title=it's>One more part of the text.</p><p data-x=\"a>b\" title='<p>'>And another part of it.</p>")
    text = html_extract.main_text(f"<html><body>{page}</body></html>", model)
    assert "One more part of the text." in text and "And another part of it." in text and "title=" not in text and ">" not in text
    many = "<html><body><article>" + "<p>some words of it</p>" * 100_000 + "</article></body></html>"
    assert html_extract.main_text(many, model).count("some words of it") == 100_000
    cut = html_extract.main_text("<html><body><article><p>A text that is long enough to be kept, and goes on.</p><p class=" + 'a="b" ' * 20_000, model)
    assert cut.startswith("A text that")


@pytest.mark.parametrize("seed", range(30))
def test_decoding_equals_trying_every_choice(seed):
    rng = random.Random(seed)
    nodes = [html_extract.Node("div", chars=rng.randint(0, 40))]
    for _ in range(rng.randint(0, 6)):
        parent = rng.choice(nodes)
        child = html_extract.Node("p", parent=parent, chars=rng.randint(0, 40))
        parent.parts.append(child)
        nodes.append(child)
    nodes = html_extract.nodes_of(nodes[0])
    odds = np.array([rng.uniform(-4, 4) for _ in nodes])
    gain = np.clip(odds, -6, 6) * np.log1p([n.chars for n in nodes])
    up = [next((j for j, p in enumerate(nodes) if p is n.parent), -1) for n in nodes]
    values = {}  # what is taken -> the most that it is worth
    for choice in itertools.product("nwo", repeat=len(nodes)):
        if any(up[i] >= 0 and choice[up[i]] != "o" and choice[i] != choice[up[i]] for i in range(len(nodes))):
            continue  # below what is taken or left out whole, all is
        if any(c == "o" and i not in up for i, c in enumerate(choice)):
            continue  # a leaf has no parts
        taken = tuple(c == "w" or c == "o" and g > 0 for c, g in zip(choice, gain, strict=True))
        worth = gain[list(taken)].sum() - 0.5 * choice.count("o")
        values[taken] = max(values.get(taken, -np.inf), worth)
    got = tuple(bool(t) for t in html_extract.decode(nodes, odds))
    assert values[got] == pytest.approx(max(values.values()))
