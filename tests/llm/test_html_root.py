"""HTML extraction of pages without a body tag, and of pages whose only wrapper is marked."""

from proofgrid.llm import html_extract

WANT = {
    "<p>plain <b>text": "plain text",
    "plain text": "plain text",
    "<html><title>t</title><p>One two.</p><p>Three.</p></html>": "One two.\nThree.",
    "<body><div class='has-sidebar'><p>The article.</p></div></body>": "The article.",
    "<div class='elementor-widget-container'><p>The article.</p><p hidden>no</p></div>": "The article.",
    "<body><article><p>A long enough article.</p></article><div class='sidebar'><p>no</p></div></body>": "A long enough article.",
    "": "",
}


def test_pages_without_containers_or_with_marked_wrappers_keep_their_text(spark):
    rows = [(k, f"http://h{k}.example/", page) for k, page in enumerate(WANT)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(WANT.values()))


KEPT = {
    "<body><article><header class='entry-header'><h1>The head.</h1></header><p>One long enough paragraph.</p></article></body>": "The head.\nOne long enough paragraph.",
    "<article><p class='share-price'>A price.</p><div class='search-results-study'><p>A study.</p></div><p>And more text.</p></article>": "A price.\nA study.\nAnd more text.",
    "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><svg><text>no</text></svg><p>More.</p></article>": "Where x=2 holds.\nMore.",
    "<article><p>Text one.</p><div class='ad-slot'>no</div><div class='social-share-buttons'>no</div><section id='reader-comments'><p>no</p></section><p>Two.</p></article>": "Text one.\nTwo.",
    "<b><div class='x'><p>One.</p></b><p>Two.</p></div>": "One.\nTwo.",
    "<header class='site-header'><p>no</p></header><main><p>The text of the page.</p></main><div role='complementary'><p>no</p></div>": "The text of the page.",
}


def test_article_text_survives_names_that_only_resemble_boilerplate():
    for page, want in KEPT.items():
        assert html_extract.text_at(page, html_extract.best_path(page)[0]) == want, page


def test_paths_that_share_a_long_end_stay_apart():
    inner = "".join(f"<div class='wrapper-of-a-long-name-{chr(97 + k)}'>" for k in range(20))
    close = "</div>" * 20
    page = f"<div class='left'>{inner}<p>{'The article. ' * 30}</p>{close}</div><div class='other'>{inner}<p>Unrelated column.</p>{close}</div>"
    assert html_extract.text_at(page, html_extract.best_path(page)[0]) == ("The article. " * 30).strip()


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    for unit in ("<b>", "<div>", "<ul><li>", "</i><b>"):
        spent = []
        for n in (4_000, 32_000):
            began = time.process_time()
            page = unit * n + "x"
            html_extract.text_at(page, html_extract.best_path(page)[0])
            spent.append(time.process_time() - began)
        assert spent[1] < 8 * 4 * spent[0] + 0.5, (unit, spent)


def plain_reader(page):
    """A second reading of small well-formed pages: blocks of the article outside marked parts, by the standard parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks, self.held = [], [], ""

        def flush(self):
            if words := self.held.split():
                self.blocks.append(" ".join(words))
            self.held = ""

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("class")))
            if tag not in ("b", "i", "a"):
                self.flush()

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a"):
                self.flush()
            self.open.pop()

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not any(t in ("nav", "aside", "form") or c in ("ad", "comments") for t, c in self.open):
                self.held += data

    reader = Reader()
    reader.feed(page)
    return "\n".join(reader.blocks)


def test_random_pages_match_a_plain_reader(spark):
    import random

    rng, pages = random.Random(9), []
    words = lambda n: " ".join(rng.choice(("alpha", "b&amp;c", "d<b>e</b>f", "<i>g</i>", "<a href='/x'>h</a>", "&eacute;", "x  y")) for _ in range(n))
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(3, 9)):
            body = words(rng.randint(5, 30))
            parts.append(rng.choice((f"<p>{body}</p>", f"<p>{body}</p>", f"<h2>{body}</h2>", f"<ul><li>{body}</li><li>k</li></ul>", f"<div class='ad'>{body}</div>", f"<aside>{body}</aside>", f"<div class='comments'><p>{body}</p></div>")))
        pages.append(f"<html><body><nav><a href='/'>menu</a></nav><article><h1>T</h1><p>{words(60)}</p>{''.join(parts)}</article><form>no</form></body></html>")
    rows = [(k, f"http://h{k % 7}.example/{k}", page, "clash", 1) for k, page in enumerate([*pages, pages[0]])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, path string, host int")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(docs).collect()}
    assert got == {k: plain_reader(page) for k, page in enumerate([*pages, pages[0]])}


ODD = {
    "<body><form id='aspnetForm' method='post'><div class='menu'><a href='/'>Home</a></div><div class='content'><h1>Head.</h1><p>One paragraph of the article.</p></div></form></body>": "Head.\nOne paragraph of the article.",
    "<body><div><a href='#c'>Skip</a></div><form><div class='content'><p>One.</p><p>Two.</p><p>Three.</p><input><button>no</button></div></form></body>": "One.\nTwo.\nThree.",
    "<body><article><p>A paragraph that is long enough to be one.</p><form action='/s'><label>Your name</label><p>no</p></form></article></body>": "A paragraph that is long enough to be one.",
    "<article><p title=\"the hidden truth\">First.</p><p data-x='a class=sidebar b'>Second.</p><p data-y=\"id='ads'\">Third.</p><p title=x hidden>no</p></article>": "First.\nSecond.\nThird.",
    "<div class='row'><div class='col-md-8'><p>The article, in the wide column of a grid, of many words beside a short teaser that isn't part of it.</p><p>More of it.</p></div><div class='col-md-4'><p>A teaser.</p></div></div>": "The article, in the wide column of a grid, of many words beside a short teaser that isn't part of it.\nMore of it.",
    "<div class='row'><div class='col-4'><a href='/1'>Link</a> teaser</div><div class='col-8'><p>The article, in the wide column.</p></div></div>": "The article, in the wide column.",
    "<main><section class='part'><p>First part of the article.</p></section><section class='part'><p>Second part of it.</p></section></main>": "First part of the article.\nSecond part of it.",
    "<h1>Beside</h1><header><h1>Above</h1></header><article><h1>Within</h1><p>Text of the article.</p></article>": "Within\nText of the article.",
}


def test_forms_quoted_attributes_and_grids(spark):
    rows = [(k, f"http://g{k}.example/", page) for k, page in enumerate(ODD)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(ODD.values()))


def test_columns_of_one_host_stay_apart(spark):
    """Every page of a host has an article of eight columns and a teaser of four, in either order, and the teaser may be the longer vote of a short page."""
    page = lambda k: f"<div class='row'><div class='col-{'4' if k % 2 else '8'}'>{{}}</div><div class='col-{'8' if k % 2 else '4'}'>{{}}</div></div>"
    article, teaser = "<p>Words of the article, of number {}.</p><p>And more of them.</p>", "<a href='/{}'>Teaser</a>"
    rows = [(k, "http://grid.example/", page(k).format(*(teaser.format(k), article.format(k))[:: 1 if k % 2 else -1])) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Words of the article, of number {k}.\nAnd more of them." for k in range(20)}


def test_many_open_forms_take_time_in_proportion():
    import time

    spent = []
    for n in (2_000, 16_000):
        began = time.process_time()
        html_extract.text_at("<form><i>" * n + "x", html_extract.ROOT)
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * 4 * spent[0] + 0.5
