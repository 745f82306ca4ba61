"""Pages, WARC records and licences."""

from __future__ import annotations

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from telelake.llm import html_extract, licenses, registry, warc
from tests.compare import connect, difference
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_pages_give_their_documents(spark):
    """Each page of the test tables shows one document below its heading."""
    texts = {
        "\n".join(" ".join(line.split()) for line in r.text.split("\n") if line.split())
        for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    }
    rows = registry.op5_html(spark, SF).collect()
    assert len(rows) == 250
    for row in rows:
        assert row.text.split("\n", 1)[1] in texts and row.n_chars == len(row.text)


def test_differencing_acts_on_the_registered_pages(spark):
    rows = registry.op5_html(spark, SF).collect()
    assert sum(r.n_shared_lines for r in rows) > 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav>Menu</nav><div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head&amp;line</h1></header>
<p>One  <b>bo</b>ld&nbsp;word<br>next<p>Two &lt;tags&gt;<ul><li>a<li>b</ul><script>var x="</p>"</script>
<div id="ad-1">Buy</div><aside>Side</aside><form>Mail</form><div class="comments"><p>Nice!</p></div></article>
<footer>Foot</footer></body></html>"""


def test_markup():
    text, _ = html_extract.main_text(PAGE, None)
    assert text == "Head&line\nOne bold word next\nTwo <tags>\na\nb"


def test_frame_words_in_names_of_article_parts():
    page = """<article><section id="related-work"><h2>Related work</h2><p>Earlier papers.</p></section>
    <h2 id="search-algorithms">Search</h2><div id="notice-period">Three months.</div><section id="social-history">
    <h3>Smoking</h3></section><p>Let <math><mi>x</mi></math> be <label>small</label>.</p><h2 id="comments">On comments</h2>
    <div class="related-posts">More</div><div id="ad-1">Buy</div><div class="comment-list">Nice</div>
    <div class="share-buttons">Send</div></article><h2 id="search">Found</h2><label>Menu</label><div id="site-footer">Foot</div>"""
    text, _ = html_extract.main_text(page, None)
    assert text.split("\n") == [
        "Related work", "Earlier papers.", "Search", "Three months.", "Smoking", "Let x be small.", "On comments", "Found",
    ]


@pytest.mark.parametrize("page", ["", "plain text", "<p", "<!-- open", "<a href='x>y", "&#0;&bogus;&amp", "<script>x", "</p></div>", "<" * 500, "<p>" * 3000])
def test_broken_markup(page):
    assert isinstance(html_extract.main_text(page, [1, 2])[0], str)


def frame_page(body: str) -> str:
    return f"<body><div>Welcome to the site</div><div>Home Products About</div>{body}<div>All rights with us</div></body>"


def test_frame_without_markup_is_differenced(spark):
    pages = [
        (1, "http://h.example/a/1", frame_page("<p>The first story has its own words.</p><p>More.</p>")),
        (2, "https://h.example/a/2.html?x=1", frame_page("<p>A second story is quite another matter to read.</p>")),
        (3, "http://h.example/a/1#top", frame_page("<p>The first story has its own words.</p><p>More.</p>")),
        (4, "http://alone.example/", frame_page("<p>Nobody to compare with.</p>")),
        (5, None, None),
        (None, "http://h.example/b", ""),
    ]
    frame = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, `_out` string, MAIN string")
    rows = {r.page_id: r.main for r in html_extract.extract(frame).collect()}
    assert rows[1].text == rows[3].text == "The first story has its own words.\nMore."
    assert rows[2].text == "A second story is quite another matter to read."
    assert rows[1].n_shared_lines == 3
    assert "Welcome to the site" in rows[4].text
    assert rows[5].text == rows[None].text == ""
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_copies_are_not_emptied(spark):
    story = "<p>A long story that two addresses of one host show in full.</p><p>It has a second part as well.</p>"
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", frame_page(story)) for i in (1, 2)], "page_id long, url string, html string")
    assert all("A long story" in r.main.text for r in html_extract.extract(frame).collect())


def pages_frame(spark, pages):
    return spark.createDataFrame([(i, f"http://h.example{u}", frame_page(b)) for i, (u, b) in enumerate(pages)], "page_id long, url string, html string")


def test_copies_are_nobodys_neighbours(spark):
    """Copies under neighbouring paths are compared with another article, and all alike."""
    story, other = "<p>Story that stands at many addresses.</p>", "<p>An article of its own, rather longer than that.</p>"
    pages = [(f"/n/{i:02d}", story) for i in range(9)] + [("/z", other)]
    texts = {r.page_id: r.main.text for r in html_extract.extract(pages_frame(spark, pages)).collect()}
    assert {texts[i] for i in range(9)} == {"Story that stands at many addresses."}
    assert texts[9] == "An article of its own, rather longer than that."


def test_pages_that_differ_in_the_query_are_neighbours(spark):
    pages = [(f"/item?id={i}", f"<p>Item {i} has words that no other item has: {'abc'[i] * 30}.</p>") for i in range(3)]
    for r in html_extract.extract(pages_frame(spark, pages)).collect():
        assert r.main.text.startswith(f"Item {r.page_id}") and "\n" not in r.main.text and r.main.n_shared_lines == 3


def test_short_article_in_a_large_frame(spark):
    large = "".join(f"<div>Line {i} of the frame of this site, on every page.</div>" for i in range(60))
    pages = [(f"/{i}", f"{large}<article><p>Short {i}{i}{i}.</p></article>") for i in range(2)]
    assert {r.main.text for r in html_extract.extract(pages_frame(spark, pages)).collect()} == {"Short 000.", "Short 111."}


def test_articles_keep_shared_lines(spark):
    page = "<nav>Menu</nav><article><p>Quoted by both.</p><p>Own {}</p><p>And more of {} here.</p></article>"
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i, i)) for i in (1, 2)], "page_id long, url string, html string")
    assert {r.main.text.split("\n")[0] for r in html_extract.extract(frame).collect()} == {"Quoted by both."}


def test_text_outside_an_article_stays(spark):
    def page(i):
        cards = "<article>Read also this.</article><article>And this card.</article>"
        return frame_page(f"<h1>Headline {i}</h1><div>Lead of story {i}.</div><div class='entry'><p>Body {i} in a plain element.</p></div>{cards}")

    frame = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in (1, 2)], "page_id long, url string, html string")
    for r in html_extract.extract(frame).collect():
        i = r.page_id
        own = [f"Headline {i}", f"Lead of story {i}.", f"Body {i} in a plain element."]
        assert r.main.text.split("\n") == [*own, "Read also this.", "And this card."]


def test_nearest_path(spark):
    urls = ["http://h/a/x/1", "http://h/a/x/2", "http://h/b/1", "http://h/b/2/c", "http://other/a"]
    frame = spark.createDataFrame([(u, f"<p>{u}</p>") for u in urls], "url string, html string")
    found = {(r.host, r.path): r.hashes for r in html_extract.partners(frame).collect()}
    hashed = lambda u: [html_extract.line_hash(u)]
    assert found == {
        ("h", "/a/x/1"): hashed(urls[1]), ("h", "/a/x/2"): hashed(urls[0]), ("h", "/b/1"): hashed(urls[3]), ("h", "/b/2/c"): hashed(urls[2]),
    }


def test_common_subsequence(monkeypatch):
    rng = random.Random(0)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    def is_common(a, b, places):
        rest = iter(b)
        return places == sorted(set(places)) and all(a[p] in rest for p in places)

    for _ in range(800):
        a = [rng.randint(0, rng.choice([2, 5, 20])) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 14))]
        places = html_extract.common_subsequence(a, b)
        assert len(places) == longest(a, b) and is_common(a, b, places)
    monkeypatch.setattr(html_extract, "ALIGN_BITS", 20)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 25))] for _ in range(2))
        places = html_extract.common_subsequence(a, b)
        # Halving makes the table smaller, not the subsequence.
        assert is_common(a, b, places) and len(places) == longest(a, b)


def test_op9_equals_sql(spark):
    assert difference(registry.op9_warc(spark, SF), connect(SF), warc.SQL) is None


RECORDS = "record_id string, url string, date long, type string, profile string, status int, headers map<string,string>, payload_digest string, canonical string"


def test_resolve_cases(spark):
    not_modified = warc.NOT_MODIFIED
    rows = [
        ("a", "http://H.example:80/p?b=2&a=1#x", 10, "response", None, 200, {"ETag": '"1"', "Content-Type": "t", "X-Old": "o"}, "d1", "z"),
        ("b", "https://h.example/p?a=1&utm_source=q&b=2", 20, "revisit", not_modified, 304, {"etag": 'W/"1"', "Content-Type": "n", "X-New": "n"}, None, "z"),
        ("c", "http://h.example/p?a=1&b=2", 30, "response", None, 200, {"ETag": '"2"', "Last-Modified": "m"}, "d2", "z"),
        ("d", "http://h.example/p?a=1&b=2", 40, "revisit", not_modified, 304, {"ETag": '"1"'}, None, "z"),
        ("e", "http://h.example/p?a=1&b=2", 50, "revisit", not_modified, 304, {"Last-Modified": "m"}, None, "z"),
        ("f", "http://h.example/p?a=1&b=2", 60, "revisit", not_modified, 304, None, None, "z"),
        ("g", "http://h.example/none", 60, "revisit", not_modified, 304, {"ETag": '"1"'}, None, "z"),
        ("h", None, 60, "revisit", not_modified, 304, {"ETag": '"1"'}, None, "z"),
        ("i", "http://h.example/p?a=1&b=2", None, "revisit", not_modified, 304, {"ETag": '"1"'}, None, "z"),
        ("j", "http://h.example/p?a=1&b=2", 5, "revisit", not_modified, 304, {"ETag": '"1"'}, None, "z"),
        ("k", "http://h.example/p?a=1&b=2", 70, "response", None, 500, {"ETag": '"9"'}, "d3", "z"),
        ("l", "http://h.example/p?a=1&b=2", 30, "revisit", not_modified, 304, {"ETag": '"2"'}, None, "z"),
        ("l", "http://h.example/p?a=1&b=2", 30, "revisit", not_modified, 304, {"ETag": '"2"'}, None, "z"),
        (None, None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, RECORDS)
    found = warc.resolve(frame).collect()
    assert len(found) == len(rows)
    by = {r.record_id: r for r in found}
    outcomes = {k: r.outcome for k, r in by.items()}
    assert outcomes == {
        "a": "response", "b": "resolved", "c": "response", "d": "mismatch", "e": "resolved", "f": "unverifiable",
        "g": "no_response", "h": "no_response", "i": "no_response", "j": "no_response", "k": "other", "l": "resolved", None: "other",
    }
    assert by["b"].headers == {"etag": 'W/"1"', "content-type": "t", "x-old": "o", "x-new": "n"}
    assert (by["b"].refers_to, by["b"].payload_digest) == ("a", "d1") and by["e"].refers_to == by["l"].refers_to == "c"
    assert warc.resolve(frame.limit(0)).count() == 0


def test_op4_equals_sql(spark):
    assert difference(registry.op4_licenses(spark, SF), connect(SF), licenses.sql()) is None


def test_known_texts_have_an_anchor(spark):
    frame = spark.createDataFrame(licenses.KNOWN, "name string, text string")
    assert frame.where(~F.col("text").rlike(licenses.ANCHOR)).count() == 0


def test_whole_licences(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    texts = [
        mit, "Copyright (c) 2020 Some One\n" + mit.upper().replace("SUBLICENSE", "Sub" + "licence".replace("c", "c")),
        mit.replace("\n\n", "\n * ").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS") + "\nAll Rights Reserved.",
        "Some words first.\n" + mit, "RELEASED under the mit licence", "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(frame).collect()}
    assert [found[i].license for i in range(6)] == ["MIT", None, "MIT", None, "MIT", None]
    assert found[5].notices == ["CC-BY-NC-4.0", "MIT"] and found[4].notices == ["MIT"]


def test_long_licences_by_digest(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    files = {n: (folder / f).read_text() for f, n in names.items() if (folder / f).exists()}
    if not files:
        pytest.skip("no licence texts on this machine")
    rows = [(n, how, t) for n, text in files.items() for how, t in (("whole", text), ("upper", text.upper()), ("longer", text + "\nmore"))]
    bare = dict(licenses.KNOWN[:6])
    rows += [(n, "whole", "Copyright 2001 Some One\n" + t) for n, t in bare.items() if n != "MIT"]
    found = licenses.scan(spark.createDataFrame(rows, "name string, how string, text string")).collect()
    assert all(r.license.license == (None if r.how == "longer" else r.name) for r in found)


def test_a_known_text_that_no_scan_would_find_is_an_error(spark):
    with pytest.raises(ValueError, match="Beer"):
        licenses.scan(cases.documents(spark), known=[("Beer", "Buy me a drink some day.")])


def test_licence_edge_cases(spark):
    docs = cases.documents(spark)
    assert licenses.scan(docs, out="_out").count() == docs.count()
    assert licenses.scan(cases.empty(spark)).count() == 0
    assert all(r.license.license is None for r in licenses.scan(docs, known=[]).collect())
