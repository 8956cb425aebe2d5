"""Names alone drop no text of an article; work grows with the page."""

import math
import random
import time

import pytest

from tonearm.llm import html_density

LONG = ("A fairly long sentence of an article, with a few words. " * 4).strip()


@pytest.mark.parametrize(
    "block",
    [
        f"<section id=related-work><h2>Related work</h2><p>{LONG}</p></section>",
        f"<section id=related><p>{LONG}</p></section>",
        "<p class='form-of-government'>A republic.</p>",
        "<h2 id='search'>Search</h2>",
        "<p class=share-price>Up.</p>",
        "<div class=notice-period><p>Two weeks.</p></div>",
        "<ul class=items><li>one<li>two</ul>",
        "<p>An <span class=social>inline</span> word.</p>",
    ],
)
@pytest.mark.parametrize("element", ["article", "main"])
def test_article_keeps_blocks_of_telling_names(element, block):
    page = f"<body><nav>menu</nav><{element}><p>{LONG}</p>{block}<p>{LONG}</p></{element}></body>"
    bare = html_density._SPACE.sub(" ", html_density.re.sub(r"<[^>]+>", " ", block)).strip()
    got = html_density._SPACE.sub(" ", html_density.main_text(page)[0])
    assert got == f"{LONG} {bare} {LONG}"


@pytest.mark.parametrize(
    "block",
    [
        "<div class=ad>Buy now.</div>", "<p class=ad>Buy now.</p>", "<div class='cookie-notice'><p>We use cookies.</p></div>", "<div id=comments><p>First!</p></div>", "<ol class=comment-list><li>First!</ol>", "<div class='post-comments'>First!</div>",
        "<form><input><p>Ask</p></form>", "<ul class='related-posts'><li><a href=x>other</a></ul>", "<section id=related><a href=x>other</a></section>", "<div class=newsletter-signup>Join.</div>", "<aside>side</aside>", "<div role=navigation>x</div>", "<span class=ad>Buy.</span>",
    ],
)
def test_furniture_of_an_article_goes(block):
    page = f"<body><article><p>{LONG}</p>{block}<p>{LONG}</p></article></body>"
    assert html_density.main_text(page)[0] == f"{LONG} {LONG}"


def test_short_paragraphs_beside_a_long_one():
    page = f"<body><div id=top><div><p>{LONG}</p></div><div><p>Short one.</p><p>And another.</p></div></div></body>"
    assert html_density.main_text(page)[0] == f"{LONG} Short one. And another."


def test_page_in_a_form():
    page = f"<body><form action=/><div><p>{LONG}</p><input name=q><p>{LONG}</p></div></form></body>"
    assert html_density.main_text(page)[0] == f"{LONG} {LONG}"


def test_many_named_blocks_in_time():
    took = []
    for n in (4_000, 16_000):
        page = f"<body><article><p>{LONG}</p></article><div>" + "<div class=comment><p>a remark</p></div>" * n + "</div></body>"
        begin = time.perf_counter()
        assert html_density.main_text(page)[0] == LONG
        took.append(time.perf_counter() - begin)
    assert took[1] < 12 * took[0] + 0.5


def density(chars, tags, link_chars, link_tags, body_chars, body_link_chars):
    """The formula, term by term."""
    tags, links, link_tags, plain = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    base = math.log(chars / plain * links + body_link_chars / max(1, body_chars) * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / math.log(base)


def test_densities_against_a_plain_tree():
    """Random trees of div, p and a, measured again from the elements themselves."""
    rnd = random.Random(8)

    def node(depth):
        if depth == 0 or rnd.random() < 0.4:
            words = " ".join("word" for _ in range(rnd.randint(1, 30)))
            return ("p", [words if rnd.random() < 0.6 else ("a", [words])])
        return ("div", [node(depth - 1) for _ in range(rnd.randint(1, 4))])

    def page(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(page, x[1]))}</{x[0]}>"

    def measured(x, link=False):
        """chars, tags, link chars, link tags of an element with itself"""
        if isinstance(x, str):
            return len(x), 0, len(x) * link, 0
        inside = link or x[0] == "a"
        parts = [measured(c, inside) for c in x[1]]
        return tuple(sum(p[k] for p in parts) + (0, 1, 0, int(x[0] == "a"))[k] for k in range(4))

    for _ in range(60):
        tree = ("body", [node(3) for _ in range(rnd.randint(1, 3))])
        root = html_density.parse(page(tree))
        html_density._measure(root)
        body, order = html_density.densities(root)
        whole = measured(tree)
        plain = []

        def walk(x):
            if x[0] != "a":
                plain.append(density(*measured(x), whole[0], whole[2]))
                for c in x[1]:
                    if not isinstance(c, str):
                        walk(c)

        walk(tree)
        found = [b.density for b in order if b.name != "#root"]
        assert found == pytest.approx(plain)
