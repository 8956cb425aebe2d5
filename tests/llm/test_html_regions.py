"""What an article or main element holds is text, less what is dropped by kind or name."""

import pytest

from tonearm.llm import html_density

LONG = ("A fairly long sentence of an article, with a few words. " * 4).strip()


@pytest.mark.parametrize("names", ["content no-sidebar", "entry-content has-related", "layout--with-sidebar", "content sidebar-right", "post tags"])
@pytest.mark.parametrize("element", ["article", "main"])
def test_named_block_that_holds_the_element(element, names):
    page = f"<body><{element}><h1>Head</h1><div class='{names}'><p>{LONG}</p><div class=ad><p>buy</p></div><p>{LONG}</p></div></{element}></body>"
    assert html_density.main_text(page)[0] == f"Head {LONG} {LONG}"


def test_named_blocks_of_an_element_go():
    page = f"<body><article><p>{LONG}</p><div class=related><p>{LONG}</p></div><div class=comments>{f'<p>{LONG}</p>' * 9}</div></article></body>"
    assert html_density.main_text(page)[0] == LONG


@pytest.mark.parametrize("element", ["article", "main"])
def test_all_blocks_of_the_element(element):
    section = f"<section>{f'<p>{LONG}</p>' * 5}</section>"
    links = "<p>" + "<a href=x>link</a> " * 20 + "</p>"
    page = f"<body><div><p>No.</p></div><{element}>loose {section}{section}<p>Short closing line.</p><ul><li>a<li>b</ul>{links}<nav>menu</nav></{element}></body>"
    assert html_density.main_text(page)[0] == " ".join(["loose", *[LONG] * 10, "Short closing line.", "a", "b", *["link"] * 20])
