"""Articles inside of what looks like chrome by a word of its class."""

import pytest
from weftline.llm.html_extract import CHROME, page_lines


def kept(page):
    return [t for z, t in page_lines(page) if z != CHROME]


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="has-sidebar">', '<div class="page with-comments">', '<div class="login-state-off">', '<form id="aspnetForm">', '<div id="site" class="nav-open"><div class="no-footer">'],
)
@pytest.mark.parametrize("element", ["article", "main"])
def test_wrappers_keep_their_article(wrapper, element):
    page = f'<body>{wrapper}<nav><p>menu</p></nav><div>around</div><{element}><p>first</p><p class="related-work">related work</p><div class="ad">advert</div></{element}><aside>side</aside></div></form></body>'
    assert kept(page) == ["first", "related work"]


@pytest.mark.parametrize("wrapper", ['<div class="comments">', '<div id="related">', "<aside>", "<footer>", '<section class="comments-list">'])
def test_articles_of_readers_stay_out(wrapper):
    assert kept(f"<body><article><p>first</p></article>{wrapper}<article><p>reply</p></article></body>") == ["first"]


def test_a_menu_inside_a_wrapper_does_not_close_it():
    assert kept('<div class="has-menu"><nav><article><p>teaser</p></article></nav><article><p>text</p></article><p>after</p></div>') == ["text"]


def test_running_text_goes_by_all_its_words():
    assert kept('<article><p class="ad banner">buy</p><p class="share">share</p><h2 class="widget-title">title</h2><p>text</p></article>') == ["title", "text"]
