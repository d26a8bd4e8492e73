"""Layout by hand-made pages, and visible words against a second reader."""

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm.html_text import VISIBILITY, Node, Styles, tokens, tree, visible_text, visible_texts

CASES = [
    ("", ""), ("plain", "plain"), ("a <b>b</b>c\n d", "a bc d"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>t</title><style>x{}</style><script>if(a<b)'</p>'</script>v", "v"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=9><li>a<li value=3>b<li>c</ol>", "9. a\n3. b\n4. c"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n\n  - b\n- c"), ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("<table><td>x<table><td>in<td>ner</table><td>y</table>", "x        y\n\nin  ner"),
    ("<table>out<tr><td>in</table>", "out\n\nin"), ("<pre>\n a  b\n\tc</pre>", " a  b\n\tc"), ("<p hidden>a<p style='display: none'>b<p>c", "c"), ("<div style=visibility:hidden>a<b style=visibility:visible>b</b>c</div>d", "b\nd"),
    ("<style>.no, #x {display:none}</style><p class='yes no'>a<p id=x>b<p class=nope>c", "c"), ("&lt;b&gt; &amp; &eacute;&#8364;", "<b> & é€"), ("a<!-- b -->c<!--> d", "ac d"), ("<p>a</b></i>b</p>c", "ab\n\nc"),
    ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"), ("<select><option>a<option selected>b</select>", "b"), ("<input value=v><input type=hidden value=w>", "v"),
    ("<h1>a</h1>b<hr>c", "a\n\nb\n\nc"), ("<blockquote>a<p>b</blockquote>c", "  a\n\n  b\n\nc"), ("x < y <3 a<", "x < y <3 a<"), ("<a href='>'>q</a>", "q"), ("<p>" * 3 + "deep" + "</p>" * 9, "deep"), ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("<table><caption>cap <b>t</b></caption><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "cap t\nh\nb\nf"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<p>a&nbsp; b", "a\xa0 b"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_layout(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize(("page", "want"), [
    ("<table><form><tr><td>x</td></tr></form></table>", "x"), ("<table><tr><form><td>x</td><td>y</td></form></tr></table>", "x  y"), ("<table><tbody><form><tr><td>x<input value=v></form></table>z", "x v\n\nz"),
    ("<table><tr><table><tr><td>x</table>y", "x\n\ny"), ("<table><table><tr><td>x</table>", "x"), ("<table><textarea>x</textarea><tr><td>y</table>", "x\n\ny"), ("<table><input value=v><tr><td>y</table>", "v\n\ny"),
    ("<table><tr><td>a<table><tr><td>b</table>c</table>", "a\n\nb\n\nc"),
])
def test_forms_and_fields_in_tables(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize(("css", "want"), [
    ("@media print { .nav { display:none } }", "x"), ("@media (max-width:600px){.nav{display:none}}", "x"), ("@media screen and (max-width:9px){.nav{display:none}} p{}", "x"), ("@page{margin:0} .nav{display:none}", ""),
    ("@media screen{.a{color:red} .nav{display:none}}", ""), ("@import 'a;b}';@media print{.a{x:y}} .nav{display:none}", ""), (".nav{display:none} .nav{display:block}", "x"), (".nav{display:block} .nav{display:none}", ""),
    (".nav{display:none!important} .nav{display:block}", ""), ("/* .nav{display:none} */ .b{}", "x"), (".nav{display:none} #i{display:block}", "x"), ("div.nav{display:none}", ""), ("p.nav, .nav.other{display:none}", "x"), ("div.nav#i{display:none} .nav{display:block}", ""), ("p .nav{display:none}", "x"), ("@media not print{.nav{display:none", ""),
])
def test_rules_of_style_sheets(css, want):
    assert visible_text(f"<style>{css}</style><div class=nav id=i>x</div>") == want
    assert visible_text(f"<style media=print>{css}</style><div class=nav id=i>x</div>") == "x"


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>t</title>Hello <p>x", "Hello\n\nx"), ("<head> <meta x><br>a", "a"), ("<head><img src=q>a<br>b", "a\nb"), ("<head><title>t</title>\n<link x>\n<style>b</style><input value=v>w", "v w"),
    ("<head><iframe></iframe>a", "a"), ("\u0130<SCRIPT>no</SCRIPT>yes<STYLE>no</STYLE><TITLE>no</Title>end", "\u0130yesend"), ("<style>a</\u017ftyle>b</style>c", "c"),
])
def test_heads_end_and_raw_text_ends(page, want):
    assert visible_text(page) == want


def test_null_and_depth():
    assert visible_text(None) is None
    assert visible_text("<div>" * 20_000 + "x").strip() == "x"
    assert visible_text("<ul><li>" * 3_000 + "x").endswith("x")
    assert visible_text("<table><tr><td>" * 1_000 + "x").strip() == "x"


@pytest.mark.parametrize("deep", [250, 20_000])
def test_deep_elements_are_like_others(deep):
    up, down = "<div>" * deep, "</div>" * deep
    for inside in ("<script>no</script>", "<style>no</style>", "<p hidden>no</p>", "<i style=display:none>no<b>no</b></i>"):
        assert visible_text(f"{up}a {inside}b{down}c") in ("a b\nc", "a\nb\nc")
    assert visible_text(f"{up}<ul><li>a</li><li>b</li></ul>{down}<p>c") == "- a\n- b\n\nc"
    assert visible_text(f"<table><tr><td>x{up}y{down}z</td><td>w</table>") == "x  w\ny\nz"
    assert visible_text("<b>" * deep + "a" + "</i>" * deep + "</b>" * deep + "b") == "ab"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.out.append(" " if tag in ("p", "div", "td", "li", "br", "h1", "nav", "article", "tr", "table", "ul", "footer") else "")
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.handle_starttag(tag, [])
        self.skip -= 2 * (tag in ("script", "style", "title"))

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_words_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("url", "text")
    got = {r["page_id"]: r["text"] for r in visible_texts(pages).collect()}
    for r in pages.collect():
        reader = Plain()
        reader.feed(r["html"])
        want = "".join(reader.out).split()
        assert len(got[r["page_id"]].split()) >= 0.98 * len(want)
        assert {w for w in want if w.isalpha()} <= set(got[r["page_id"]].replace("-", " ").split()) | {w for w in want if len(w) > 40}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "<td colspan=3>", "<td rowspan=0>", "</td>", "<ul>", "<li>", "</ul>", "<p>", "</p>", "<pre>", "</pre>", "<b>", "</b>", "<select>", "<option>", "<style>", "</style>", "<!--", "-->", "<a b='", '"', "'", ">", "<", "&amp;", "word ", "\n", "é", "</br>", "<body>", "<caption>", "<thead>", "<textarea>"]), max_size=40).map("".join))
def test_any_page(page):
    assert isinstance(visible_text(page), str)


def shown(root):
    """Text nodes that nothing hides, by a walk over the tree."""
    hidden, out = Styles(root), []

    def walk(node, visible):
        if hidden.undisplayed(node) or node.tag in ("select", "details", "input", "colgroup", "col"):
            return
        if found := VISIBILITY.search(node.attrs.get("style", "")):
            visible = found[1].lower() == "visible"
        for child in node.children:
            if isinstance(child, Node):
                walk(child, visible)
            elif visible:
                out.append(child)

    walk(root, True)
    return out


TAGS = ["table", "tbody", "thead", "tr", "td", "th", "caption", "form", "ul", "ol", "li", "p", "div", "b", "a", "h1", "dl", "dt", "dd", "blockquote", "pre", "span", "button", "label", "fieldset", "legend", "center", "section", "textarea", "body", "head", "p hidden", "div style='display:none'", "i style='visibility:hidden'"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS]), st.sampled_from([f"</{t.split()[0]}>" for t in TAGS]), st.just("WORD ")), max_size=50))
def test_no_text_vanishes(pieces):
    """Every word is in the tree, and every word of the tree that nothing hides is in the output, once."""
    page = "".join(p if p != "WORD " else f"w{i}x " for i, p in enumerate(pieces))
    written = [w for kind, text, _ in tokens(page) if kind == "text" for w in text.split()]
    in_tree, todo = [], [tree(page)]
    while todo:
        node = todo.pop()
        in_tree += [w for c in node.children if isinstance(c, str) for w in c.split()]
        todo += [c for c in node.children if isinstance(c, Node)]
    assert sorted(in_tree) == sorted(written)
    got = [w for w in visible_text(page).split() if w not in ("-",) and not w.rstrip(".").isdigit()]
    assert sorted(got) == sorted(w for text in shown(tree(page)) for w in text.split())


def test_wide_characters_are_aligned():
    assert visible_text("<table><tr><td>漢字<td>a<tr><td>abcde<td>b</table>") == "漢字   a\nabcde  b"


def test_tables_of_pages(spark):
    """No rows, nulls, rows that repeat, a very long page and columns of any name."""
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, "<b>x", None), (2, None, "t"), (3, "", "t"), (4, "<p>word " * 60_000 + "<table>" + "<tr><td>c" * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {(r["page_id"], r["text"] if r["page_id"] != 4 else r["text"].count("word") + r["text"].count("c")) for r in visible_texts(pages).collect()}
    assert got == {(1, "a"), (None, "x"), (2, None), (3, ""), (4, 80_000)} and visible_texts(pages).count() == 6
    assert visible_texts(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<span style="display:block">a</span><span style="display:block">b</span>', "a\nb"),
        ("<style>.b{display:block}</style>x<span class=b>a</span><span class=b>b</span>y", "x\na\nb\ny"),
        ("<style>div.i{display:inline}</style><div class=i>a </div><div class=i>b</div><div>c</div>", "a b\nc"),
        ("<style>.h{visibility:hidden} .h b{visibility:visible}</style><p>a<span class=h>hid<b>seen</b></span>b", "aseenb"),
        ("<style>nav a{display:none}</style><nav><ul><li>x <a>gone</a></ul></nav><a>kept</a>", "- x\n\nkept"),
        ("<style>.a > p{display:none}</style><div class=a><p>gone</p><div><p>kept</p></div></div>", "kept"),
        ("<style>.a .b > i{display:none}</style><div class=a><p class=b>x<u><i>kept</i></u><i>gone</i></p></div>", "xkept"),
        ("<style>#m p{display:none} div p.s{display:block}</style><div id=m><p class=s>gone</p></div>", ""),
        ("<style>p.s{display:none !important} #m p{display:block}</style><div id=m><p class=s>gone</p>x</div>", "x"),
        ("<style>p:hover, a + b, [x] {display:none}</style><p>a<b x>b</b></p>", "ab"),
        ("<style>.h{display:none}</style><div class=h style='display:block'>kept</div>", "kept"),
    ],
)
def test_computed_display(page, text):
    assert visible_text(page) == text


def test_long_ways_down_deep_trees():
    page = "<style>" + "".join(f"div div div div.x{k} > p {{display:none}}" for k in range(50)) + "</style>" + "<div class='x1'>" * 600 + "<p>gone</p><i>kept</i>"
    assert visible_text(page) == "kept"
