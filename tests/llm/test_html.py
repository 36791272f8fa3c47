"""Pages whose article HTML extraction must not lose."""
import pytest

from caravan.llm import html_extract as H

LONG = "word " * 60 + "end"
ARTICLE = f"<h1>Title</h1><p>{LONG}</p>"
TEXT = f"Title\n{LONG}"


def texts(*pages):
    path = H.article_path(H.aligned([H.expression(H.parse(p)) for p in pages]))
    return [H.extract(p, path) for p in pages]


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><nav>Menu</nav><div>%s</div></body>",
    "<body class='skin-vector-search-vue'><div>%s</div><div class='sidebar-left'>Side</div></body>",
    "<html class='no-comments'><body class='login popup'><article>%s</article></body></html>",
    "<body><main class='with-comments'>%s</main><div id='comments'>" + LONG * 9 + "</div></body>",
    "<body><article class='search-result'>%s</article><div class='site-footer'>Foot</div></body>",
    "<body><form id=all><nav>Menu</nav><div class=page>%s</div></form></body>",
    "<body><p>Skip</p><div class='sidebar-layout'><main>%s</main><div class='sidebar'>Side</div></div></body>",
    "<body><div class='widget'>%s</div><footer>Foot</footer></body>",
    "<body><aside><article>teaser</article></aside><div class=content>%s</div></body>",
])
def test_containers_of_the_article_are_read(page):
    assert texts(page % ARTICLE) == [TEXT]


def test_side_blocks_stay_out():
    assert texts("<nav>only menu</nav>", f"<div class=comments><article class=comment>{LONG}</article></div>") == ["", ""]
    assert texts(f"<div class=post>{ARTICLE}</div><div class=comments-area><p>{LONG * 9}</p></div>") == [TEXT]


@pytest.mark.parametrize("head", ["<div class='main-header'>Site</div>", "<div id='maintenance'>Soon</div>",
                                  "<div class='main'>Site</div>", "<article>teaser</article>"])
def test_main_is_a_whole_name_and_holds_the_text(head):
    assert texts(f"<body>{head}<div class='content'>{ARTICLE}</div></body>") == [TEXT]


def test_main_by_name():
    assert texts(f"<body><p>Skip</p><div id=main>{ARTICLE}</div></body>") == [TEXT]
    assert texts(f"<body><p>Skip</p><div role=main class=x>{ARTICLE}</div></body>") == [TEXT]


@pytest.mark.parametrize("icon", [
    '<svg class="i"/>', '<svg><use href="#i"/></svg>', '<svg viewBox="0 0"><path d="M0"/><text>icon</text></svg>',
    "<div><svg class=i></div>", "<div><select><option>a<option>b</div>", "<div><noscript>off</div>",
    "<div><canvas></div>", "<div><template></div>", "<div><object></div>", "<svg><path>", "<math/>",
    "<div><textarea>x</div>", "<iframe src=a></iframe>", "<textarea></div><p>typed</textarea>"])
def test_skipped_elements_do_not_end_the_page(icon):
    page = f"<body><div class=post><h1>Title</h1>{icon}<p>{LONG}</p></div><footer><svg></svg><i></i></footer></body>"
    assert texts(page) == [TEXT]


def test_blocks_in_skipped_elements_stay_skipped():
    page = f"<div class=post><h1>Title</h1><p>{LONG} <noscript><p>off</p><ul><li>x</ul></noscript></p></div>"
    assert texts(page) == [TEXT]
    assert texts(f"<div><h1>Title</h1><p>{LONG} <canvas>off<p>end</div>") == [f"{TEXT}\nend"]


def test_unclosed_raw_text():
    assert texts(f"<head><title>T<body><div>{ARTICLE}</div></body>") == [TEXT]
    assert texts(f"<body><div>{ARTICLE}<style>p {{}}<p>no</div>", f"<body><div>{ARTICLE}<!-- <p>no</div>") == [TEXT] * 2


def test_wrapper_is_bounded_by_the_template(spark):
    """A name of its own on each page adds nothing to the wrapper."""
    def page(i):
        slug = "".join(chr(97 + int(d)) for d in f"{i:04d}")
        heads = "".join(f"<h2 id='{slug}{k}' class='css-{slug} t'>H {i}</h2><p>{LONG} {i}</p><i></i>" for k in "xyz")
        return (f"<body class='post post-{slug}'><nav class='n{slug}'>Menu</nav>"
                f"<div id='main' class='c{slug}'>{heads}</div><div class='foot-{slug}'>F</div></body>")

    def size(n):
        d = spark.createDataFrame([(i, u, page(i)) for i in range(n) for u in ("http://a.org/x", None)],
                                  "page_id long, url string, html string").repartition(4)
        found = {r.host: r.wrapper for r in H.wrappers(d).collect()}
        assert set(found) == {"a.org", ""}
        got = H.main_texts(d).collect()
        assert len(got) == 2 * n and all(r.text == "\n".join([f"H {r.page_id}", f"{LONG} {r.page_id}"] * 3) for r in got)
        return max(map(len, found.values()))

    assert size(400) < 1.1 * size(100)


def test_literals_of_a_host_go_unless_its_pages_are_copies(spark):
    legal = "All rights reserved by the publisher"

    def page(*blocks):
        return "<body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + f"<div class=legal>{legal}</div></article></body>"
    many = [page(f"{LONG} {i}", f"more {i}") for i in range(40)] + [page(f"{LONG} copy")] * 20
    copies, near = [page(LONG, "same")] * 30, [page(LONG, f"end {i}") for i in range(30)]
    few, two = [page(f"{LONG} {i}") for i in range(10)], [page(f"{LONG} {i}") for i in range(2)]
    hosts = {"many": many, "copies": copies, "near": near, "few": few, "two": two}
    rows = [(k, f"http://{h}.org/{k}", p) for h, pages in hosts.items() for k, p in enumerate(pages)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.url: (r.text, r.n_chars) for r in H.main_texts(d).collect()}
    for k, url, p in rows:
        blocks = p.replace("<div class=legal>", "<p>").replace("</div>", "</p>").split("<p>")[1:]
        want = [b.split("</p>")[0] for b in blocks]
        text = "\n".join(w for w in want if w != legal or not ("many" in url or "few" in url))
        assert got[url] == (text, len(text))


@pytest.mark.parametrize("deep", ["<b>" * 10000 + "%s" + "</b>" * 10000, "<div>" * 10000 + "%s", "<nav><i>" * 3000 + "</i></nav>" * 3000 + "%s",
                                  "<ul><li>" * 4000 + "%s", "<svg><g>" * 5000 + "</g></svg>" * 5000 + "%s"])
def test_deep_pages(deep):
    assert texts(deep % ARTICLE, deep % ARTICLE) == [TEXT, TEXT]


def test_blocks_below_the_deepest_level_stay_blocks():
    page = "<div>" * 400 + f"<p>{LONG}</p><div>one<div>two</div>three</div><nav>Menu<b>x</b></nav><ul><li>four</ul>"
    assert texts(page) == [f"{LONG}\none\ntwo\nthree\nfour"]


@pytest.mark.parametrize("odd", ['<a "', "<a ='", '<a ="', "<a", "<a ", "<!", "<script ", "<select>", "</x>", "<title><iframe>", "<textarea>", "<br>"])
def test_reading_time_is_linear(odd):
    """Ten times the page takes not much more than ten times as long."""
    import time

    def seconds(n):
        start = time.perf_counter()
        H.extract(odd * n + ARTICLE, None)
        H.keys_in(odd * n)
        return time.perf_counter() - start
    seconds(100)
    assert seconds(20000) < 40 * max(seconds(2000), 0.01)


def test_a_megabyte_of_unclosed_quotes(spark):
    rows = [(1, "http://a.org", '<a "' * 260000 + ARTICLE), (2, "http://a.org", f"<div>{ARTICLE}</div>"),
            (3, "http://a.org", "<b>" * 20000 + ARTICLE)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == got[3] == TEXT and got[1].endswith(LONG)


@pytest.mark.parametrize("name", ["class='post-comments'", "id='user-comments'", "class='google-ads'", "class='left-sidebar'",
                                  "class='comments-area'", "class='sidebar-left'", "class='ad_slot_2'", "id=footer", "role=navigation"])
def test_boilerplate_by_name(name):
    assert texts(f"<div class=post><h1>Title</h1><div {name}><p>not this</p></div><p>{LONG}</p></div>") == [TEXT]


@pytest.mark.parametrize("name", ["class='share-prices'", "class='notice-period'", "class='has-sidebar'", "id='no-comments'",
                                  "class='related-work'", "class='menu-prices-explained'", "class=shareholder", "class=addresses"])
def test_articles_by_name(name):
    assert texts(f"<div class=post>{ARTICLE}<div {name}><p>more</p></div></div>") == [f"{TEXT}\nmore"]


LAYOUTS = {
    "semantic": "<body><header>Site</header><nav><a>Home</a></nav><article>%s</article><footer>Foot</footer></body>",
    "divs": "<body><div id=top-menu>Home</div><div class='content wrap'><div class=post>%s</div><div class=left-sidebar>Side</div></div>"
            "<div class=site-footer>Foot</div></body>",
    "table": "<body><table><tr><td class=nav>Home<td class=text>%s<td class=sidebar>Side</table></body>",
    "form": "<body><form><div role=main>%s<div class=share-buttons>Share</div></div><div class=cookie-banner>Ok</div></form></body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_against_plain(spark, layout):
    """Pages made from known blocks: the text is those blocks."""
    rows, want = [], {}
    for i in range(30):
        blocks = [f"{LONG} {layout} {i} {k}" for k in range(1 + i % 4)]
        body = f"<h1>Head {i}</h1>" + "".join(f"<p>{b}</p>" + ("<aside>teaser</aside>" if i % 3 == 0 else "") for b in blocks)
        if i % 5 == 0:
            body += "<ul><li>first<li>second &amp; last</ul>"
        rows.append((i, f"http://{layout}.org/{i}", LAYOUTS[layout] % body))
        want[i] = "\n".join([f"Head {i}", *blocks, *(["first", "second & last"] if i % 5 == 0 else [])])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in H.main_texts(df).collect()} == want
