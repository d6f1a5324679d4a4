import pytest

from panelrisk.llm import html_extract as h


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just < text &amp; more", "just < text & more"), ("<p>a<b>b</b>c<br>d<p>x&nbsp;\n y</p><ul><li>1<li>2</ul>", "abc d x y 1 2"),
    ("<head><title>t</title></head><nav>n</nav><article><header><h1>T</h1><p>by</p></header><p>hi</p><aside>s</aside></article><footer>f</footer>", "T hi"),
    ("<div class='ad box'>buy</div><div id=main>one<script>var a='</p>'</script> two</div><!-- x --><div class=comment-list>c</div>", "one two"),
    ("<form>f</form><div role=navigation>r</div><p>&eacute;&#233;&#x41;</p>", "ééA"), ("<p title='un>a</p>b", "a b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article><p>one</p></article><article><p>two</p></article><p>out</p>", "one two"), ("<style>p{}</style><noscript>n</noscript>x<!-- open", "x"), ("<div>" * 5000 + "deep", "deep"), ("<p>a</p></div></p>b", "a b"),
])
def test_pages(page, text):
    assert h.main_text(h.parse(page)) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<article class='post has-sidebar'><p>real text</p></article>", "real text"), ("<main class='no-comments'><p>real</p></main>", "real"), ("<div class='sidebar-left'><main><p>real</p></main><div class=widget>w</div></div>", "real"),
    ("<article><div class='post-header'><h1>T</h1><p>by x</p></div><p>hi</p></article>", "T hi"), ("<div class='post-header'><p>s</p></div><p>hi</p>", "hi"),
    ("<article><p>a</p></article><ol class=comment-list><li><article class=comment-body>a longer remark</article></ol>", "a"), ("<div id=main>one</div><div class=comments><article>remark</article></div>", "one"),
    ("<div class=with-ads><article class=promo>card</article><article>x</article></div>", "x"), ("<div class=main-nav>n</div><div class='site_footer'>f</div>x", "x"), ("<aside><main>m</main></aside><p>x</p>", "x"),
    ("a <b c", "a <b c"), ("a</b c", "a"), ("a<!-- > b", "a"), ("a<? b", "a"), ("<i>a</i><a <a <a", "a<a <a <a"),
    ("<div>" * 600 + "a<p>b</p>c" + "</div>" * 600 + "<nav>n</nav>d", "a b c d"), ("<div>" * 600 + "<script>s</script>x" + "</div>" * 600 + "<div class=ad>n</div>", "x"),
])
def test_class_words_and_broken_markup(page, text):
    assert h.main_text(h.parse(page)) == text


@pytest.mark.parametrize("page", ["<a " * 200_000, "<b>" * 50_000 + "</x>" * 50_000, "<ul><li>" * 50_000, "<!-" * 200_000, "<p><b>" * 20_000 + "</p>" * 20_000, "<a '" * 100_001 + ">", "</a " * 200_000])
def test_broken_pages_take_linear_time(page):
    import time

    start = time.process_time()
    h.main_text(h.parse(page))
    assert time.process_time() - start < 8


def test_counts_against_brute_force(spark):
    """Pages of blocks without any article: a block goes if enough different pages of its host have it."""
    import random

    rng, rows, blocks = random.Random(5), [], {}
    for host, size in (("one.example", 3), ("two.example", 5), ("three.example", 11), ("four.example", 60), ("five.example", 200)):
        for k in range(size):
            shared = [f"shared {b} of {host}" for b in range(12) if rng.random() < (b + 1) / 13]
            own = [] if k % 10 == 9 else [f"story {k} of {host}"]
            found = shared[:6] + own + shared[6:]
            number = len(rows)
            rows.append((number, f"http://{host}/{k}", "<body>" + "".join(f"<div class=b{k}><p>{text}</div>" for text in found)))
            blocks[number] = (host, found)
    rows.append((len(rows), rows[-1][1], rows[-1][2]))  # a copy counts once
    blocks[len(rows) - 1] = blocks[len(rows) - 2]
    expected = {}
    for number, (host, found) in blocks.items():
        pages = {tuple(texts) for other, texts in blocks.values() if other == host}
        needed = max(0.2 * len(pages), min(8, max(4, 0.6 * len(pages))))
        expected[number] = " ".join(text for text in found if sum(text in p for p in pages) < needed)
    got = {r.page_id: r.text for r in h.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))[0].collect()}
    assert got == expected
    assert any(len(text.split(" of ")) < 4 for text in expected.values()) and any("shared" in text for text in expected.values())


def page(host, number, body):
    return (number, f"https://{host}/p/{number}", f"<body><div><b>Welcome to {host}</b></div>{body}<div><p>Call us: {host} desk</p></div></body>")


def test_templates_go_and_articles_stay(spark):
    rows = [page("a.example", k, f"<div><p>story {k} of a</p></div>") for k in range(12)]
    rows += [page("b.example", 100 + k, f"<div><p>story {k} of b</p></div>") for k in range(3)]  # too few pages for a template
    rows += [page("c.example", 200 + k, "<div><p>the same story</p></div>") for k in range(30)]  # copies of one page
    rows += [page("d.example", 300 + k, f"<article><p>a passage that many pages share</p><p>story {k}</p></article>") for k in range(12)]
    got = {r.page_id: r.text for r in h.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))[0].collect()}
    assert got[3] == "story 3 of a"
    assert got[101] == "Welcome to b.example story 1 of b Call us: b.example desk"
    assert got[205] == "Welcome to c.example the same story Call us: c.example desk"
    assert got[304] == "a passage that many pages share story 4"


def test_subtree_hashes_ignore_attributes_and_white_space():
    one, two = (h.subtrees(h.parse(p)) for p in ("<div><a href=1>x  y</a></div>", "<div>\n<a href=2>x y</a> </div>"))
    assert one == two and len(one) == 2


def test_table(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in h.with_main_text(pages)[0].collect():
        inner = re.sub(r"</?(p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", row.html, re.DOTALL)[1])
        assert row.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>", "x", "x"), (1, None, "<p>a</p>", "x", "x"), (2, "not a url", None, "x", "x"), (None, "http://h/", "", "x", None), (3, "http://h/", "<p>" + "w " * 50_000, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    found, name = h.with_main_text(pages)
    assert name == "text_" and found.columns == [*pages.columns, "text_"]
    assert sorted((r.page_id or 0, len(r[name])) for r in found.collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 99_999)]
    assert h.with_main_text(pages.limit(0))[0].count() == 0
