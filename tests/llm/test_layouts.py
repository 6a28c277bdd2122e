"""Elements inside paragraphs, forms, and pages of layouts that the training grammar does not write."""

import pytest

from corpusloom.llm import htmlcrf
from corpusloom.llm.htmlblocks import blocks

PROSE = [
    "The river rose in the night and the lower town was under water before the bells were rung.",
    "Nobody had expected it so early in the year, said the keeper of the bridge, who lost two boats.",
    "By noon the rain had stopped, and people came out to see what was left of the market.",
]
P = "".join(f"<p>{t}</p>" for t in PROSE)
TEXT = "\n".join(PROSE)


def texts(html):
    return [b.text for b in blocks(html)]


def main(html):
    return htmlcrf.main_text(html, htmlcrf.default_field())


def test_what_stands_inside_a_line_does_not_cut_it():
    assert texts("<p>x <math><mi>a</mi><mo>+</mo></math> y</p>") == ["x y"]
    assert texts("<p>x <svg><title>t</title><text>no</text></svg> y <unknown>in</unknown> <my-word>line</my-word></p>") == ["x y in line"]
    assert texts("<p>a <script>no()</script>b <button>no</button> c <select><option>no</select> d <object>no</object> e") == ["a b c d e"]
    assert texts("<p>a <custom>b<p>c") == ["a b", "c"]
    assert texts("<p>a <math><mi>no<p>b") == ["a", "b"]  # a paragraph ends foreign elements
    assert texts("<p>a <select><option>no<div>b</div>") == ["a", "b"]
    assert texts("<div>a<noscript><p>no</p></noscript>b</div>") == ["ab"]
    assert texts("<ul><li>a<li>b <tt>c</tt></ul><dl><dt>d<dd>e</dl><table><tr><td>f<td>g<tr><th>h</table>") == ["a", "b c", "d", "e", "f", "g", "h"]


@pytest.mark.parametrize("start, end", [
    ("<form action=x><article>", "</article></form>"),
    ("<article><form>", "</form></article>"),
    ('<form id="aspnetForm" method="post"><input type="hidden" name="v"><div class="content">', "</div></form>"),
    ("<form><main>", "</main>"),
])
def test_articles_in_forms(start, end):
    assert main(f"<html><body><nav><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li></ul></nav>{start}{P}{end}<footer>&copy; 2020 The Paper</footer></body></html>") == TEXT


LAYOUTS = {
    "wiki": f'<div id="mw-navigation"><ul><li><a href=#>Main page</a><li><a href=#>Contents</a></ul></div><div id="content" role="main"><h1 id="firstHeading">The flood</h1><div id="bodyContent">{P}</div></div><div id="footer" role="contentinfo"><ul><li>About this site<li><a href=#>Privacy</a></ul></div>',
    "blog": f'<div class="header-wrapper"><h2><a href=#>My days</a></h2></div><div class="navbar section"><a href=#>About</a> <a href=#>Archive</a></div><div class="post hentry"><h3 class="post-title">The flood</h3><div class="post-body entry-content">{P}</div></div><div id="comments"><h4>2 comments:</h4><dl><dt>Ann said</dt><dd>So sad to read this.</dd></dl></div><div class="sidebar"><h2>Archive</h2><ul><li><a href=#>May</a></li></ul></div>',
    "form": f'<header><a href=#>Paper</a></header><form class="search"><label>Search the paper</label><input type=text><button>Go</button></form><article><h1>The flood</h1>{P}</article><form id="newsletter"><p>Get our letter every morning.</p><input type=email><button>Subscribe</button></form>',
    "custom": f'<app-header><nav><a href=#>Home</a><a href=#>World</a></nav></app-header><main><story-body><h1>The flood</h1>{P}</story-body></main><app-footer><footer><p>All rights reserved.</p></footer></app-footer>',
    "table": f'<table><tr><td class="menu"><ul><li><a href=#>Home</a><li><a href=#>Links</a></ul></td><td class="content"><h1>The flood</h1>{P}</td></tr></table>',
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_outside_the_grammar(name):
    assert main(f"<html><head><title>T</title></head><body>{LAYOUTS[name]}</body></html>") == f"The flood\n{TEXT}"
