"""Wrapper induction: names of layout are no furniture, deep markup, independence of the partitioning."""

import functools
import random
import zlib

import pytest

from loadgrid.llm import wrapper

PAGES = "page_id long, url string, html string"
#: Names of containers that hold the whole page or the article: the usual output of blog software, and names of furniture on the wrong block.
LAYOUT = ["content has-sidebar", "content no-sidebar", "page menu-open", "post comment-open", "post-header content", "entry ads-free", "side-effects", "recommended-reading", "has-sidebar",
          "post no-sidebar", "with-nav", "footer-visible", "no-ads", "cookies-accepted", "newsletter-archive", "promo-codes-explained", "login-required", "sharing-economy", "social-studies",
          "popup-closed", "two-column sidebar-left-open", "single-post comments-enabled", "sidebar", "menu", "widget", "comment-list", "promo", "site-header"]


def _body(i):
    return f"<h1>Title {i}</h1><p>First paragraph of page {i} with words of its own.</p><p>Second one, number {i * i}, as long as the first.</p>"


def _want(i):
    return f"Title {i} First paragraph of page {i} with words of its own. Second one, number {i * i}, as long as the first."


def _html(name, i, element):
    inner = f"<article class='{name}'>{_body(i)}</article>" if element == "article" else f"<main class='{name}'>{_body(i)}</main>" if element == "main" else _body(i)
    inner = f"<div class='x'>{inner}</div>" if element == "inside" else inner
    name = "wrap" if element in ("article", "main") else name
    return (f"<html><body><header>The Site</header><nav><a href=/>Home</a></nav><div class='{name}'><div class='cookie-notice'>We use cookies {i}</div>{inner}"
            f"<div class='comments-area'><p>reader {i} writes</p></div><div class='related-posts'>See also {i + 1}</div></div><div class='site-footer'>Footer {i}</div></body></html>")


@pytest.mark.parametrize("element", ["div", "inside", "article", "main"])
def test_names_of_layout_keep_the_text(spark, element):
    rows = [(100 * k + i, f"http://h{k}.example.com/{i}", _html(name, i, element)) for k, name in enumerate(LAYOUT) for i in range(6)]
    got = {r.page_id: r.text for r in wrapper.report(spark.createDataFrame(rows, PAGES)).collect()}
    for k, name in enumerate(LAYOUT):
        for i in range(6):
            assert got[100 * k + i] == _want(i), name


def test_names_of_furniture():
    for name in ("sidebar", "site-footer", "cookie-notice", "related-posts", "share_buttons", "widget-area", "sidebar-2 left", "main-navigation", "post navigation", "comments", "ad-box"):
        assert wrapper._furniture_names(name), name
    for name in LAYOUT[:22]:
        assert not wrapper._furniture_names(name) or name == "post comment-open", name


@pytest.mark.parametrize("tag", ["div", "span", "b", "section", "li"])
def test_deep_markup(tag):
    n = 100_000
    page = f"<p>before</p>{f'<{tag}>' * n}deep &amp; down<p>there{f'</{tag}>' * n}<p>after</p>"
    tree = wrapper.parse(page)
    t = wrapper.folded(wrapper.summary(tree))
    assert wrapper.extract(page, wrapper.rule(t, [1])).split() == "before deep & down there after".split()
    assert wrapper.merge(t, t)[wrapper.N] == 2


def test_furniture_in_deep_markup_goes():
    page = "<div>" * 400 + "text <nav>menu <ul><li>more</ul></nav> and <div class=sidebar>side <div>inner</div></div> more" + "</div>" * 400
    assert wrapper.extract(page, {"path": [], "constant": {}}) == "text and more"


def test_result_does_not_depend_on_the_partitioning(spark):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        for i in range(14):
            blocks = [rng.choice([f"<p>Words {i} {rng.randrange(99)}</p>", "<p>Subscribe to our letter</p>", "<ul><li>one<li>two</ul>", f"<div class=note>Note {i}</div>", "<h2>Part</h2>"]) for _ in range(rng.randrange(2, 9))]
            rows.append((100 * k + i, f"http://p{k}.example.com/{i}", f"<body><div class=top>Top of site {k}</div><div class=body>{''.join(blocks)}</div><footer>f</footer></body>"))
    df = spark.createDataFrame(rows, PAGES)
    texts = [sorted((r.page_id, r.text) for r in wrapper.report(df.repartition(n, "page_id")).collect()) for n in (1, 5)]
    assert texts[0] == texts[1]


def _rule(pages):
    return wrapper.rule(*functools.reduce(wrapper._merged, [[wrapper.summary(wrapper.parse(t)), [zlib.crc32(t.encode())]] for t in pages]))


def _long(i, k):
    tags = [["h2", "p", "ul", "dl"][zlib.crc32(b"%d %d" % (i, j)) % 4] for j in range(k)]
    return "".join(f"<{t}>word {i} {j}</{t}>" for j, t in enumerate(tags))


@pytest.mark.parametrize("k", [5, 4_000])
def test_constants_do_not_depend_on_the_length_of_the_pages(k):
    wrap = "<body><div class=links><a href=/{0}>Older {0}</a></div><div class=body>{1}<div class=by>Author {0}</div><p>Thanks for reading</p></div><footer>f</footer></body>"
    pages = [wrap.format(i, _long(i, k)) for i in range(8)]
    r = _rule(pages)
    for i, t in enumerate(pages):
        assert wrapper.extract(t, r) == " ".join(f"word {i} {j}" for j in range(k)) + f" Author {i}"


def _made_up(i):
    """A page whose article lies in a block with a name of its own, beside a list of links without a name."""
    name = "".join(chr(97 + int(c)) for c in f"{i:03d}") + "zz"
    return f"<body><div class=wrap><div class={name}>{''.join(f'<h2>Head {i} {j}</h2><p>Words {i} of {j}</p>' for j in range(25))}</div></div><div class=more><a href=/{i}>Older story {i}</a></div></body>"


@pytest.mark.parametrize("n", [10, 63, 70, 200])
def test_rule_does_not_depend_on_the_number_of_pages(n):
    pages = [_made_up(i) for i in range(n)]
    r = _rule(pages)
    assert r["path"] and r["path"][0] == _rule(pages[:10])["path"][0]
    assert all("Older story" not in wrapper.extract(t, r) and f"Words {i} of 24" in wrapper.extract(t, r) for i, t in enumerate(pages))


def test_templates_merge_in_any_order_and_grouping():
    rng = random.Random(5)
    trees = []
    for i in range(24):
        blocks = "".join(rng.choice(["<p>a {}</p>", "<p>Same</p>", "<div class=n>n {}</div>", "<ul><li>l</ul>", "<h2>h {}</h2>", "<section><p>s {}</p><h3>x</h3></section>"]).format(i) for _ in range(rng.randrange(1, 12)))
        trees.append([wrapper.summary(wrapper.parse(f"<body><div class=body>{blocks}</div></body>")), [i]])
    want = functools.reduce(wrapper._merged, trees)
    for _ in range(5):
        rng.shuffle(trees)
        k = rng.randrange(1, 23)
        assert wrapper._merged(functools.reduce(wrapper._merged, trees[:k]), functools.reduce(wrapper._merged, trees[k:])) == want
