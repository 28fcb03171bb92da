"""The page parser on broken menus before an article, and on very many tags."""

import time

import pytest
from clipline.llm import extract

ARTICLE = "<article><p>The main text is here and it is long enough to read.</p></article>"
TEXT = "The main text is here and it is long enough to read."


def texts(html):
    return [extract.block_text(n) for n in extract.parse(html) if n.parts is not None]


@pytest.mark.parametrize("menu", [
    "<nav><svg class='x'/><a href='/'>Home</a></nav>", "<nav><button>Menu<a href='/'>x</a></nav>",
    "<div class='menu'><button class=b>Go</div>", "<nav><svg><path d='M0'/><use/></svg></nav>", "<button>Menu",
    "<div><select><option>a<option>b</div>", "<nav><object data=x><p>alt</p></nav>", "<math/>", "<button>Go</button>",
    "<div><noscript><div>Please turn scripts on</div></noscript></div>", "<svg><title>x</title><g><svg/></g></svg>"])
def test_articles_behind_hidden_elements_are_kept(menu):
    found = texts(f"<html><head><title>t</title></head><body>{menu}{ARTICLE}</body></html>")
    assert found[-1] == TEXT and found[:-1] in ([], ["Home"])
    nodes = extract.parse(f"<body>{menu}{ARTICLE}<p>after</p></body>")
    assert [n.tag for n in nodes if n.tag == "article"] == ["article"]


def test_hidden_content_stays_hidden():
    assert texts("<div><noscript><div>a</div><p>b</p></noscript><p>c</p></div>") == ["c"]
    assert texts("<div><textarea></div><p>a</textarea><p>b</p></div>") == ["b"]
    assert texts("<div><script>if (a </div> b) x</script><p>c</p></div>") == ["c"]


@pytest.mark.parametrize("html", [
    "".join(f"</x{i}>" for i in range(100_000)), "<div>" * 30_000 + "</p>" * 100_000, "<p>" * 100_000,
    "<ul><li>" * 20_000, "".join(f"<b{i}></c{i}>" for i in range(50_000)), "<svg>" * 50_000 + "</g>" * 50_000])
def test_many_tags_take_linear_time(html):
    began = time.process_time()
    extract.parse(html)
    assert time.process_time() - began < 5
