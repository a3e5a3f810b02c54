"""Main text of pages of several makes."""

import math
import re
import time

import pytest

from quillon.llm import html

ARTICLE = "<h1>A title</h1><p>First paragraph, with some words. And a second sentence.</p><p>Second &amp; last; it is not short at all.</p>"
TEXT = "A title\nFirst paragraph, with some words. And a second sentence.\nSecond & last; it is not short at all."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- c --><div class='ad'>Buy now, please.</div><article>{ARTICLE}</article><footer>&copy; me</footer></body></html>",
        f"<body><div id='menu'><a href=1>One</a> <a href=2>Two</a></div><div id='content'>{ARTICLE}</div><div class='sidebar'><p>Other things, to read.</p></div></body>",
        f"<article>{ARTICLE}<section class='comments'><p>I disagree, strongly.</p></section></article><form><p>Sign up, now.</p></form>",
        f"<main>{ARTICLE}<aside>See also this, and that.</aside></main><div class='cookie-notice'>We use cookies, lots of them.</div>",
        f"<body><header><h2>Site name</h2></header><article>{ARTICLE}",
        f"<article>{ARTICLE.replace('</p>', '')}</article>",
    ],
)
def test_pages(page):
    assert html.main_text(page) == TEXT


def test_blocks_and_space():
    page = "<article><p><b>Bold\n text<br>here<p>next <a href=x>link</a>\t.</p><ul><li>one<li>two</ul></article>"
    assert html.main_text(page) == "Bold text here\nnext link .\none\ntwo"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav>Home</nav>", "<!-- only", "<script>x</script>", "<"])
def test_no_text(page):
    assert html.main_text(page) in ("", "<")


def test_long_and_odd_pages():
    page = "<article>" + "<p>word, and more.</p>" * 5000 + "</article>"
    assert html.main_text(page).count("\n") == 4999
    assert html.main_text("<div>" * 3000 + "deep text, here." + "</div>" * 10) == "deep text, here."


def test_frame(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "n"), (None, None, None, "n"), (1, "u", f"<article>{ARTICLE}</article>", "n")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in out] == [(1, "u", TEXT, len(TEXT)), (None, None, "", 0), (1, "u", TEXT, len(TEXT))]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ratios_prefer_prose():
    _, blocks = html.parse_blocks(f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><section>{ARTICLE}</section>")
    scores = html.path_ratios(blocks)
    assert min(scores[-2:]) > max(scores[:2])


LONG, SHORT = ("".join(f"<p>{w} paragraph number {i}, with some words. And more of them, here.</p>" for i in range(n)) for w, n in (("One", 7), ("Two", 3)))


def plain(page):
    return re.sub(r"\s+", " ", re.sub("<[^>]*>", "\n", page)).replace(". One", ".\nOne").replace(". Two", ".\nTwo").strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><h1>Title</h1><div>{LONG}</div></main>", "Title\n" + plain(LONG)),
        (f"<body><h1>Title</h1><div>By me</div><div>{LONG}</div></body>", "Title\nBy me\n" + plain(LONG)),
        (f"<main><p>lead</p><section>{LONG}</section><section>{SHORT}</section></main>", "lead\n" + plain(LONG) + "\n" + plain(SHORT)),
        (f"<body><div><p>lead</p><div>{LONG}</div><div>{SHORT}</div></div></body>", "lead\n" + plain(LONG) + "\n" + plain(SHORT)),
        (f"<body><article>{LONG}</article><article>{SHORT}</article></body>", plain(LONG) + "\n" + plain(SHORT)),
        (f"<body>{LONG}<div><a href=1>Home</a> <a href=2>About</a></div>{SHORT}<div><a href=3>Next</a></div></body>", plain(LONG) + "\n" + plain(SHORT)),
        (f"<div id=x>{LONG}<ul><li><a href=1>A source</a><li><a href=2>Another</a></ul></div>", plain(LONG) + "\nA source\nAnother"),
    ],
)
def test_nothing_of_the_content_is_lost(page, want):
    assert html.main_text(page) == want


REPLY = "<div class='comments'>" + "<article class='comment'><p>I disagree with it, strongly.</p></article>" * 9 + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'>{ARTICLE}</div>",
        f"<div id='page-with-comments'><article>{ARTICLE}</article></div>",
        f"<div class='layout no-header'><div class='sidebar'>Other things, to read.</div><article>{ARTICLE}</article></div>",
        f"<div class='widget'><div class='sidebar'>Other things, to read.</div><article>{ARTICLE}</article></div>",
        f"<div class='post comments-open'>{ARTICLE}</div>",
        f"<div data-id='search' title='id=search'>{ARTICLE}</div><div id=search>Search this site, now.</div>",
        f"<div id='search-page'><main>{ARTICLE}</main></div>",
        f"<article>{ARTICLE}</article>{REPLY}",
        f"<div class='ad'>{LONG}</div><article>{ARTICLE}</article><div class='ad-box'>{LONG}</div>",
        f"<div class='page has-sidebar'><div id='content'>{ARTICLE}{REPLY}</div></div>",
    ],
)
def test_hints_of_wrappers(page):
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize(
    "odd",
    [
        "<svg><path d='x'/>",
        "<svg viewBox='0'><g><text>Label</text>",
        "<math><mi>x</mi>",
        "<object data=x>",
        "<p><object data=x></p>",
        "<object><object data=x>Old browser</object> too</object>",
        "<svg><title>Label<g></title><foreignObject><p>Label</p></foreignObject></svg>",
        "<svg/>",
    ],
)
def test_unclosed_foreign_elements(odd):
    assert html.main_text(f"<article>{odd}{ARTICLE}</article>") == TEXT
    assert html.main_text(f"<article>{ARTICLE}</article><p>{odd}</p><article>{ARTICLE}</article>") == TEXT + "\n" + TEXT


def test_closed_foreign_elements_do_not_part_a_block():
    assert html.main_text("<article><p>One <svg><text>no</text></svg>two <math><mi>x</mi></math>three.</article>") == "One two three."


PAIR = "<p>A first paragraph, which is long enough to be one; it says a thing or two.</p><p>A second one, which goes on; it is no shorter, and ends.</p>"
PAIR_TEXT = "A first paragraph, which is long enough to be one; it says a thing or two.\nA second one, which goes on; it is no shorter, and ends."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div>Home</div><div>About</div><div>Buy</div>{PAIR}",
        f"<body><div>Home About Buy</div>{PAIR}",
        f"<div><div>Home</div><div>About</div><div>Buy</div>{PAIR}</div>",
        f"<div><div><ul><li>Home<li>About</ul></div>{PAIR}<div>Imprint</div></div>",
        f"<div class='post alert-story'>{PAIR}</div>",
        f"<div class='post alert-story'>{PAIR}</div><div>Copyright me, 2020.</div>",
        f"<div id='search-results-article'>{PAIR}</div>",
        f"<div class='discussion'>{PAIR}</div><div>Copyright me, 2020.</div>",
        f"<form id='whole'><div>{PAIR}</div><input name=q></form>",
        f"<head><title>x</title>{PAIR}",
        f"<body>{PAIR}</body></html><!-- late --!>",
    ],
)
def test_paths_decide_and_names_only_help(page):
    assert html.main_text(page) == PAIR_TEXT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title='it's'>Hello world.</p><p>Don't worry, be happy.</p></article>", "Hello world.\nDon't worry, be happy."),
        ("<p>super<wbr>califragilistic, one<img src=x>two.", "supercalifragilistic, onetwo."),
        ("<p>a &am<b>p; b</b>, see &lt;x&gt; 1 < 2.</p>", "a &amp; b, see <x> 1 < 2."),
        ("<p>one <object><p>old</p>browser</object>two.", "one two."),
        ("<p>one <object>old browser</object>two.", "one two."),
        ("<p>one <object>shown.", "one shown."),
        ("<p a=b c = 'd>' e=\"f>\" / g=h/i>text, here.", "text, here."),
        ("<p>kept, this.</p><p class='lost", "kept, this."),
        ("<p>x, y.</p><!--><p>z, w.</p><!---><p>v.</p>", "x, y.\nz, w.\nv."),
        ("<p>x, y.</p></ odd><?php echo '<p>' ?><p>z, w.</p>", "x, y.\n' ?>\nz, w."),
        ("<table><tr><td>One, two.<td>Three, four.<tr><td>Five, six.</div></table>", "One, two.\nThree, four.\nFive, six."),
    ],
)
def test_markup_is_read_as_browsers_do(page, want):
    assert html.main_text(page) == want


SHAPES = ["<a ", "<div>x", "x\nx", "<object>x", "<object>x</object>", "<b><i></u>", "<svg><g>", "<i><p></p>", "<u><div><i></u>", "<a b='", "<!--", "<p>x</div>", "<td>x<tr>", "&amp"]


@pytest.mark.parametrize("shape", [*SHAPES, "nested"])
def test_time_is_linear(shape):
    page = lambda n: "<object>" * n + "</object>" * n if shape == "nested" else shape * n

    def took(n):
        began = time.perf_counter()
        html.main_text(page(n))
        return time.perf_counter() - began

    took(1000)
    assert took(64_000) < 40 * took(8_000) + 0.5
    assert took(64_000) < 10


def test_ratios_are_those_of_a_plain_count():
    nodes, blocks = html.parse_blocks(f"<div class=ad>Buy, now.</div><nav><a href=1>One</a></nav><div>{LONG}<ul><li>a<li>b.</ul></div><main>{SHORT}</main>")

    def trail(node):
        out = []
        while node is not None:
            if node.block is node:
                out.append((node.tag, *sorted(node.hints)))
            node = node.up
        return tuple(out)

    rows = [(trail(n), len(t) - linked, sum(c in ".,;:!?" for c in t)) for n, _, t, linked in blocks]

    def ratio(path):
        own = [(a, b) for p, a, b in rows if p == path]
        return math.sqrt(sum(a for a, _ in own) / len(own) * (1 + sum(b for _, b in own) / len(own)))

    def smooth(i):
        near = [(math.exp(-(i - j) ** 2 / 2), ratio(rows[j][0])) for j in range(len(rows)) if abs(i - j) <= 2]
        return sum(w * r for w, r in near) / sum(w for w, _ in near)

    want = []
    for path, _, _ in rows:
        own = [smooth(i) for i in range(len(rows)) if rows[i][0] == path]
        want.append(sum(own) / len(own))
    assert html.path_ratios(blocks) == pytest.approx(want)
