"""Main text extraction: hand-made pages, the generated pages, templates."""

import html
import re
import time

from trafficscore.llm import pages, queries


def text(page, template=()):
    return pages.text_of(page, frozenset(template))


def test_structure():
    assert text("<nav>m</nav><div class='ad'>x</div><article><h1>T &amp; t</h1><p>a\n <b>b</b>c<br>d<p>e</article><footer>f</footer>") \
        == "T & t\na bc d\ne"
    assert text("<p>one<p>two</p>three<script>if (a<b) '</p>'</script><style>x</style>") == "one\ntwo\nthree"
    assert text("<ul><li>a<li>b</ul><table><tr><td>x<td>y</table>") == "a\nb\nx\ny"
    assert text("<main><header>h</header><section id=comments>c</section><div>body &lt;x&gt;&nbsp;y</div></main><p>out</p>") == "body <x> y"
    assert text("<article><p>in</p><aside>s</aside><form>f</form><div role='navigation'>n</div></article>") == "in"


def test_odd_pages():
    assert text("") == text("<") [:0] == text("<!-- x -->") == text("<script>never closed <p>x") == ""
    assert text("plain") == "plain"
    assert text("<p>a<!-- <p>no --> b</p></div></x>") == "a b"
    assert text("<a href='x>y'>l</a> <img alt=\"<p>\">t") == "l t"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("x " * 50_000) == ("x " * 50_000).strip()


def test_all_articles_stay():
    assert text("<main><p>Intro</p><article>First</article><article>Second</article></main>") == "Intro\nFirst\nSecond"
    assert text("<div><article><p>One</p></article><p>between</p><article><p>Two</p></article></div>") == "One\nTwo"
    assert text("<aside><article>teaser</article></aside><article></article><p>body</p>") == "body"
    assert text("<article>a<article class=comment>said</article></article>") == "a"
    assert text("<article>a</article><article class=comment>said</article>") == "a"
    assert text("<main><article class='post has-sidebar'>a</article></main>") == "a"


def test_tags_that_never_end():
    assert text('<p title="abc>text</p>') == "text"
    assert text("<p>1 < 2 <b") == "1 < 2 <b"
    for page in ("<a " * 350_000, "<a \"" * 250_001, "<a \">\" " * 150_000, "<a " + "x" * 1_000_000 + "=1>t", "<!-- " * 200_000):
        start = time.time()
        text(page)
        assert time.time() - start < 20


def plain(page):
    """Generated pages only: all blocks of the article."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_query_over_the_whole_table(spark, read):
    rows = read("pages", "/root/testdata/sf0.01").collect()
    got = {r.page_id: r for r in queries.op9_pages(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_templates_go_and_repeated_articles_stay(spark):
    shell = "<div class='box1'><p>Follow us everywhere</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{shell}<div><p>Story {i} tells more than the box does</p></div></body>") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", f"<article><p>Same story</p>{shell}</article>") for i in range(8)]
    rows += [(40, "http://c.example/1", f"<body>{shell}<p>Lone page of this host, with its own text</p></body>"),
             (41, None, None), (42, "not a url", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(got[i] == f"Story {i} tells more than the box does" for i in range(8))
    assert all(got[20 + i] == "Same story" for i in range(8))
    assert got[40] == "Follow us everywhere\nLone page of this host, with its own text"
    assert got[41] == got[42] == ""
    small = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert small == got


def test_shuffled_templates_equal_broadcast_ones(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i % 3}", f"<div><p>box</p></div><p>Long enough text of page number {i}</p>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = sorted(map(tuple, pages.main_texts(df).collect()))
    monkeypatch.setattr(pages, "BROADCAST_KEYS", -1)
    assert a == sorted(map(tuple, pages.main_texts(df).collect()))
    assert a[0][2] == "Long enough text of page number 0"


def test_empty(spark):
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_running_text_of_a_template_goes_by_different_contents(spark):
    """The counts alone decide here: no name or tag tells the notice from the story."""
    def page(i, story):
        shared = "<p>Told in three stories of ten</p>" if i % 10 < 3 else ""
        return f"<main><p>Part of the city gazette</p><h1>Title {story}</h1><p>Story {story} as it went</p>{shared}</main>"

    rows = [(i, f"http://a.example/{i}", page(i, i)) for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", page(0, 7)) for i in range(20)]
    rows += [(200 + i, f"http://c.example/{i}", page(i, i)) for i in range(4)]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    lines = {i: [x for x in re.split(r"<[^>]*>", h) if x] for i, _, h in rows}
    for i, url, _ in rows:                                    # brute force: contents of the host that have the line
        contents = {tuple(lines[j]) for j, u, _ in rows if u.split("/")[2] == url.split("/")[2]}
        often = {x for x in lines[i] if sum(x in c for c in contents) >= max(5, len(contents) / 2)}
        assert got[i] == "\n".join(x for x in lines[i] if x not in often)
    assert got[1] == "Title 1\nStory 1 as it went\nTold in three stories of ten"
    assert got[101].startswith("Part of the city gazette") and got[201].startswith("Part of the city gazette")


def test_columns_named_like_helpers(spark):
    rows = [(1, "http://a/", "<p>x</p>", "h", "t", "o")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string, _template string, _host string")
    got = pages.extract(df).collect()[0]
    assert (got.text, got._html, got._template, got._host) == ("x", "h", "t", "o")
