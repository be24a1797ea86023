"""Visible text of generated pages, whose visible words are known, and of pages at the limits."""

import random
import re

import pytest

from retroscope.llm import html_text

HIDERS = ['hidden', 'style="color:red; display : none"', "style='visibility:hidden'", 'class="big gone"', 'id="never"', 'class=box']
SHOWN = ['class="big"', 'style="display:block"', 'id="other"', 'class="gone" style="display:inline"', ""]
STYLE = "<style>/* p{display:none} */ .big{font-size:2em} .gone , h7 {display:none} #never{visibility:hidden;color:red} div.box, span.box, p.box, li.box {DISPLAY: NONE} .box.open{display:block} @media print { p, div { display:none } } a:hover{display:none} ul li:hover{display:none}</style>"


class Page:
    def __init__(self, seed):
        self.rng, self.n, self.words = random.Random(seed), 0, []

    def word(self, shown):
        self.n += 1
        if shown:
            self.words.append(f"w{self.n}")
        return f"w{self.n}"

    def text(self, shown):
        return " ".join(self.word(shown) + self.rng.choice(["", ",", " &amp; ", " <!-- no --> "]) for _ in range(self.rng.randint(1, 4)))

    def node(self, depth, shown, inline=False):
        rng = self.rng
        kind = rng.choice(["text", "inline", "script"] if inline or depth > 6 else ["text", "text", "inline", "block", "para", "list", "table", "script", "hide"])
        if kind == "text":
            return self.text(shown)
        if kind == "script":
            return rng.choice(["<script>if (a<b) { x = '</p>' }</script>", "<!-- <p>no</p> -->", "<template><p>no</p></template>", "<noscript>no</noscript>"])
        if kind == "inline":
            tag = rng.choice(["b", "i", "span", "em", "code"])
            return f"<{tag} {rng.choice(SHOWN)}>{self.nodes(depth, shown, True)}</{tag}>"
        if kind == "block":
            tag = rng.choice(["div", "section", "blockquote", "h2"])
            return f"<{tag} {rng.choice(SHOWN)}>{self.nodes(depth, shown)}</{tag}>"
        if kind == "para":
            return f"<p>{self.nodes(depth, shown, True)}" + rng.choice(["", "</p>"]) + f"<div>{self.text(shown)}</div>"
        if kind == "list":
            end = rng.choice(["", "</li>"])
            return f"<{rng.choice(['ul', 'ol'])}>" + "".join(f"<li>{self.nodes(depth, shown)}{end}" for _ in range(rng.randint(1, 3))) + "</ul></ol>"
        if kind == "table":
            end = rng.choice(["", "</td>"])
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.word(shown)}{end}" for _ in range(3)) for _ in range(rng.randint(1, 3))) + "</table>"
        tag = rng.choice(["div", "p", "span"])
        hider = rng.choice(HIDERS)
        return f"<{tag} {hider}>{self.nodes(depth + 4, False, True)}</{tag}>"

    def nodes(self, depth, shown, inline=False):
        return " ".join(self.node(depth + 1, shown, inline) for _ in range(self.rng.randint(1, 3)))


@pytest.mark.parametrize("seed", range(200))
def test_all_visible_words_in_order(seed):
    page = Page(seed)
    body = page.nodes(0, True)
    source = f"<!doctype html><html><head><title>no</title>{STYLE}</head><body>{body}</body></html>"
    assert re.findall(r"w\d+", html_text.visible_text(source)) == page.words
    assert "no" not in html_text.visible_text(source).split()


def test_beyond_the_deepest_element():
    deep = "<b>" * 3000
    source = f"{deep}one<script>no</script><span hidden>no<i>no</i></span><div>two</div></b>three{'</b>' * 3000}four<div style='display:none'>no</div>"
    assert html_text.visible_text(source).split() == ["one", "two", "threefour"]


def test_long_spans_keep_columns():
    rows = "".join(f"<tr><td>a{i}<td>b{i}" for i in range(1, 70))
    lines = html_text.visible_text(f"<table><tr><td rowspan=70>span<td>x<td>y{rows}</table>").split("\n")
    assert len(lines) == 70 and len({line.index("b") for line in lines[1:]}) == 1
    assert {line.index("a") for line in lines[1:]} == {lines[0].index("x")}
    wide = html_text.visible_text("<table><tr><td colspan=60>w<td>z<tr>" + "".join(f"<td>c{i}" for i in range(60)) + "<td>end</table>").split("\n")
    assert wide[0].index("z") == wide[1].index("end")
    assert html_text.visible_text("<table><tr><td rowspan=0>s<td>a<tr><td>b</table>") == "s  a\n   b"


def test_numbers_of_lists():
    assert html_text.visible_text("<ol start=12345678901><li>a</ol>") == "2147483647. a"
    assert html_text.visible_text("<ol start='-2'><li>a<li value=7>b<li>c</ol>") == "-2. a\n7. b\n8. c"


def test_empty_table_and_clashing_columns(spark):
    schema = "page_id bigint, url string, html string, text string, part int"
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0
    assert html_text.extract_text(spark.createDataFrame([(1, "u", "<p>x", "old", 3)], schema)).first().text == "x"


VISIBILITY = {
    '<p style="visibility:hidden">no<span style="visibility:visible">yes</span></p>': "yes",
    "<p hidden style='display:block'>yes</p><p hidden>no</p>": "yes",
    "<style>p.a{display:block}</style><p hidden class=a>yes</p>": "yes",
    "<style>div .q{display:none}</style><div><p>yes<b class=q>no</b></p></div><b class=q>too</b>": "yes\n\ntoo",
    "<style>p>b{display:none}</style><p>yes<b>no</b><i><b>too</b></i></p>": "yestoo",
    "<style>div p > b{visibility:hidden}</style><div><p><b>no</b>yes</p></div><p><b>too</b></p>": "yes\n\ntoo",
    "<style>@media screen{.x{display:none}}</style><p class=x>no</p>yes": "yes",
    "<style>@media only screen , print{.x{display:none}}</style><p class=x>no</p>yes": "yes",
    "<style>@media all{p{color:red}.x{display:none}}.y{display:none}</style><p class=x>no</p><p class=y>no</p>yes": "yes",
    "<style>@media print{.x{display:none}}</style><p class=x>yes</p>": "yes",
    "<style>@media screen and (max-width:9px){.x{display:none}}@supports (x:y){.x{display:none}}</style><p class=x>yes</p>": "yes",
    "<style media=print>p{display:none}</style><p>yes</p>": "yes",
    "<style>@import 'a.css';p{display:none}</style><p>no</p>yes": "yes",
    "<style>.x{display:none !important}</style><p class=x style='display:block'>no</p>yes": "yes",
    "<style>.x{display:none}</style><p class=x style='display:block'>yes</p>": "yes",
    "<style>#i{display:block}.x{display:none}p{display:none}</style><p id=i class=x>yes</p><p>no</p>": "yes",
    "<style>p:hover{display:none}p[a]{display:none}</style><p a=1>yes</p>": "yes",
    '<div style="visibility:hidden"><ol><li>no<li style="visibility:visible">yes</ol><img alt=no><q>no</q></div>': "2. yes",
    '<table><tr><td>a<td style="visibility:hidden">no<td>b<tr><td>c<td>dd<td>e</table>': "a      b\nc  dd  e",
    '<table><tr><td>a<td style="display:none">no<td>b<tr><td>c<td>d</table>': "a  b\nc  d",
    "<div style='display:none'><p style='display:block;visibility:visible'>no</p></div>yes": "yes",
    "<dialog>no</dialog><dialog style='display:block'>yes</dialog>": "yes",
}


@pytest.mark.parametrize("source", VISIBILITY)
def test_display_and_visibility(source):
    assert html_text.visible_text(source) == VISIBILITY[source]


def test_deep_selectors_end_in_time():
    import time

    page = "<style>" + "".join(f"{'div ' * 6}.c{i}{{display:none}}" for i in range(50)) + "</style>" + "<div>" * 400 + "<p class='c1 c2'>no</p>yes" + "</div>" * 400
    began = time.time()
    assert html_text.visible_text(page) == "yes" and time.time() - began < 2
