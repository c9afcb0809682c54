"""Extraction: names that do not mark the article, broken markup, long pages, and scores against a recursive version."""

import random
import time

import pytest

from loomtext.llm import html_extract

P = "<p>One sentence, with commas, and more text to read in this paragraph.</p>"
TEXT = "One sentence, with commas, and more text to read in this paragraph."


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="content has-sidebar">', '<div class="layout no-sidebar">', '<div class="page fixed-header">', '<div class="post comments-open">', '<div class="single tags-on">', '<div class="story with-share">', "<form action=/x>", '<div class="modal">', '<section id="community">'],
)
def test_wrappers_of_the_whole_article_stay(wrapper):
    end = "</" + wrapper[1:].split()[0].rstrip(">") + ">"
    page = f"<body>{wrapper}<nav><a href=/>Menu</a></nav>{P * 5}<input><button>Send</button>{end}<div class=footer>(c) us</div></body>"
    assert html_extract.main_text(page) == "\n\n".join([TEXT] * 5)


def test_comments_go_even_if_they_are_longer():
    remark = "<div class=comment><p>I read this, twice, and liked it, mostly, but not all.</p></div>"
    page = f"<article><h1>T</h1>{P}</article><div id=comments>{remark * 30}</div>"
    assert html_extract.main_text(page) == "T\n\n" + TEXT
    assert html_extract.main_text(f"<div class=post>{P * 2}</div><div class='sidebar'>{P}</div><form>{P}<input></form>") == "\n\n".join([TEXT] * 2)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div><p title=it's>one, a b</p><p>two, it's</p><p>three, c</p></div>", "one, a b\n\ntwo, it's\n\nthree, c"),
        ("<div><p title='a > b' data-x=\"</p>\">one, a</p><p a=b/>two, b</p></div>", "one, a\n\ntwo, b"),
        ("<title>x</title><body><p>a, b<!-->c<!-- no --> d</p>", "a, bc d"),
        ("<head><title>x</title><body><p>a, b</p>", "a, b"),
        ("<p>1 < 2, and 3 <4</p>", "1 < 2, and 3 <4"),
        ("<div><p>a, b</p></span></section><p>c, d</p></div></div>", "a, b\n\nc, d"),
        ("<table><tr><td>a, b</div><td>c, d</table>", "a, b\n\nc, d"),
        ("<p>a, b<a href='x", "a, b"),
        ("<ul><li>a, b<ul><li>c, d<li>e</ul><li>f</ul>", "a, b\n\nc, d\n\ne\n\nf"),
        ("<svg><p>no</svg><p>a, b</p><svg>c", "a, b"),
    ],
)
def test_broken_markup(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("part", ["<a ", "<a b='", "<div><p>", "<ul><li>", "<ul><li><li>", "<svg>x", "<!--", "<table><tr><td>", "<form>a, ", "<div class=sidebar>a, ", "</p>", "&amp", "<", "<p>a, <a>b</a>"])
def test_time_is_in_proportion_to_the_page(part):
    times = []
    for size in (100_000, 1_000_000):
        page = part * (size // len(part))
        began = time.process_time()
        html_extract.main_text(page)
        times.append(time.process_time() - began)
    assert times[1] < 30 * times[0] + 1


def test_scores_equal_a_recursive_version():
    r = random.Random(3)

    def grown(depth):
        name = r.choice(["div", "section", "article", "p", "ul", "blockquote", "a"] if depth else ["div"])
        if depth > 3 or name in ("p", "a"):
            words = " ".join(r.choice(["one,", "two", "three,", "fourteen", "sentences"]) for _ in range(r.randint(1, 40)))
            return ("p" if name not in ("p", "a") else name, [words])
        return (name, [grown(depth + 1) for _ in range(r.randint(1, 4))])

    html_of = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(html_of, t[1]))}</{t[0]}>"

    def length(t, linked=False):
        if isinstance(t, str):
            return 0 if linked == "only" else len(t)
        if linked == "only":
            return length(t) if t[0] == "a" else sum(length(c, "only") for c in t[1])
        return sum(map(length, t[1]))

    commas = lambda t: t.count(",") if isinstance(t, str) else sum(map(commas, t[1]))
    free = lambda t: 1 - length(t, "only") / length(t)

    def scores(t, above, out):
        """out[path]: what a node got from the paragraphs in it."""
        path = above[-1][0] if above else ()
        if t[0] in html_extract.PARAGRAPHS:
            for level, (key, node) in enumerate(above[-2::-1][: html_extract.LEVELS], 1):
                start = html_extract.BONUS.get(node[0], 0) + 25 * 0
                out[key] = out.get(key, start) + (1 + commas(t) + min(length(t) // 100, 3)) * free(t) / level
        for i, c in enumerate(t[1]):
            if not isinstance(c, str):
                scores(c, [*above, ((*path, i), c)], out)

    for _ in range(60):
        tree = ("html", [grown(0)])
        order = html_extract._in_order(html_extract.build(html_of(tree[1][0])), 0)
        html_extract._measure(order, 0)
        best = html_extract._best(order)
        out = {}
        scores(tree, [((), tree)], out)
        nodes = {}

        def walk(t, path):
            nodes[path] = t
            for i, c in enumerate(t[1]):
                if not isinstance(c, str):
                    walk(c, (*path, i))

        walk(tree, ())
        want = max((s * free(nodes[k]) for k, s in out.items() if nodes[k][0] in html_extract.BLOCKS), default=None)
        assert (best is None) == (want is None)
        if best is not None:
            assert best.score == pytest.approx(want)


SHORT = "<p>Short lead.</p>"


@pytest.mark.parametrize(
    "inside",
    ['<h2 id="search-engines">A</h2>', '<h3 class="social-life">A</h3>', '<h2 id="tags">A</h2>', '<section id="menu-history"><p>A</p></section>', '<div class="ad-free-note"><p>A</p></div>', '<div id="related-work">A</div>', '<p class="banner-years">A</p>', "<p><label>A</label></p>", '<span id="comment-culture">A</span>', '<ul class="share-prices"><li>A</ul>'],
)
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_names_about_the_text_stay_in_the_article(inside, outer):
    page = f"<body><nav><a href=/>Home</a></nav><{outer}><h1>T</h1>{P * 3}{inside}{P}</{outer}><div class=footer>(c)</div></body>"
    assert html_extract.main_text(page) == "\n\n".join(["T", TEXT, TEXT, TEXT, "A", TEXT])


@pytest.mark.parametrize("outer", ["article", "main", "div", "section class=post"])
def test_everything_beside_the_best_container_stays(outer):
    end = outer.split()[0]
    body = f"<div class=body>{P * 4}</div>"
    page = f"<body><{outer}><h1>T</h1>{SHORT}{body}<h2>H</h2><ul><li>one<li>two</ul><blockquote>q</blockquote>bare <b>text</b><pre>c</pre><table><tr><td>d</table><p>Short end.</p></{end}></body>"
    assert html_extract.main_text(page) == "\n\n".join(["T", "Short lead.", *[TEXT] * 4, "H", "one", "two", "q", "bare text", "c", "d", "Short end."])


@pytest.mark.parametrize("name", ["widget-content", "share-layout", "newsletter"])
def test_a_short_page_in_a_node_with_a_listed_name(name):
    assert html_extract.main_text(f"<body><div class={name}><p>Hello, you.</p></div></body>") == "Hello, you."


def test_what_is_not_the_article_goes_inside_it_too():
    gone = [
        '<div class="advert"><p>Buy, now.</p></div>', '<p class="notice">We use, cookies.</p>', '<aside>x</aside>', "<form><label>Name</label><input></form>", '<div class="related-posts"><a href=/1>One</a></div>',
        '<div class="newsletter-signup">Sign up, now</div>', '<div id="comment-list"><p>I like it, so much.</p></div>', '<div class="share-story"><a href=/t>Share</a></div>', "<footer>by me</footer>", '<div class="cookie-notice">x, y</div>',
    ]
    for part in gone:
        assert html_extract.main_text(f"<article><h1>T</h1>{P * 3}{part}{P}</article>") == "\n\n".join(["T", *[TEXT] * 4]), part


def test_links_beside_the_container_go():
    page = f"<article><h1>T</h1><div>{P * 40}</div><div><a href=/a>before</a> <a href=/b>next</a></div></article>"
    assert html_extract.main_text(page) == "\n\n".join(["T", *[TEXT] * 40])


@pytest.mark.parametrize("seed", range(40))
def test_random_articles_keep_all_their_prose(seed):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choices("some words, of text that are here and there, again".split(), k=n))
    name = lambda: r.choice(["", ' id="menu-of-the-day"', ' class="x y"', ' class="social-history"', ' id="ads-in-print"'])
    want = []

    def part(depth):
        kind = r.choice(["p", "p", "p", "h2", "h4", "blockquote", "pre", "ul", "div", "section"] if depth < 3 else ["p"])
        if kind in ("div", "section"):
            return f"<{kind}{name()}>" + "".join(part(depth + 1) for _ in range(r.randint(1, 4))) + f"</{kind}>"
        texts = [words(r.randint(2, 40)) for _ in range(r.randint(1, 3) if kind == "ul" else 1)]
        want.extend(texts)
        return f"<{kind}{name()}>" + "".join(f"<li>{x}" if kind == "ul" else x for x in texts) + f"</{kind}>"

    body = "".join(part(0) for _ in range(r.randint(2, 7)))
    page = f"<html><body><header><a href=/>Home</a></header><div class=sidebar><p>{words(30)}</p></div><article>{body}</article><div id=footer>{words(5)}</div></body></html>"
    assert html_extract.main_text(page).split("\n\n") == want
