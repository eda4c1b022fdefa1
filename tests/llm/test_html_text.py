import pytest

from ehrseq.llm.html_text import extract_text, render

from ..conftest import SMALL

CASES = {
    # Implied ends of paragraphs, list items and cells.
    "<p>a <b>b</b>c\n d<p>e<div>f<br>g</div>": "a bc d\n\ne\n\nf\ng",
    "<ul><li>one<li>two<ul><li>x<li>y</ul><li>three</ul>end": "- one\n- two\n  - x\n  - y\n- three\n\nend",
    "<ol start=3><li>q<li>w</ol>": "3. q\n4. w",
    "<dl><dt>t<dd>d<dt>t2<dd>d2</dl>": "t\n  d\nt2\n  d2",
    "<td>loose<td>cells": "loose\ncells",
    # Tables: aligned columns, spans, captions, nesting.
    "<table><caption>C</caption><tr><th>Name<th>Age<tr><td>Al<td>5</table>z": "C\nName  Age\nAl    5\n\nz",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>": "wide     z\n1     2  3",
    "<table><tr><td>x<table><tr><td>in1<td>in2</table></table>": "x\n\nin1  in2",
    "<table><tr><td>one<br>two<td>b</table>": "one  b\ntwo",
    # Visibility.
    "<head><title>T</title><style>x</style></head><body>a<span hidden>no <span>no</span> no</span>b": "ab",
    "<div style='color:red; display : NONE'>n<p>o</p></div>ok<!-- c --><script>'<p>'</script><p hidden>gone<p>there": "ok\n\nthere",
    "<noscript>seen</noscript><template>t</template>": "seen",
    # White space and preformatted text.
    "  a\n\t b  <b> c</b> ": "a b c",
    "<pre>  a\n    b\n\nc</pre>d": "  a\n    b\n\nc\n\nd",
    "a&nbsp;&amp; &#233;&eacute;": "a\xa0& éé",
    # Broken markup.
    "": "", "<": "<", "a < b": "a < b", "</p></table>x</td>": "x", "<!-- never closed": "", "<script>never closed": "", "<b><i>x</b>y</i>": "xy",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert render(html) == CASES[html]


def test_nothing_recurses():
    assert render("<div>" * 20_000 + "x").strip() == "x"
    assert render("<table><tr><td>" * 2_000 + "x").strip() == "x"
    assert render("<ul><li>" * 2_000 + "x").strip().endswith("x")


def test_every_visible_word_of_the_pages_is_there_in_order(spark):
    """Text between tags, but for head, script and style, without the layout."""
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = {r.page_id: r.text for r in extract_text(pages).collect()}
    for page in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", page.html)
        plain = html.unescape(re.sub(r"<(?:[a-zA-Z/!][^>]*)(?:>|$)", "\n", body))
        words = [w for w in texts[page.page_id].split() if w != "-"]
        assert words == [w for w in plain.split() if w != "-"]


def test_odd_and_empty_tables(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "<p>a", "x"), (1, "<p>a", "x"), (2, "<p>w " * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = extract_text(pages).collect()
    assert sorted((str(r.page_id), r.text[:3]) for r in out) == [("1", ""), ("1", "a"), ("1", "a"), ("2", "w\n\n"), ("None", "")]
    assert extract_text(pages.limit(0)).collect() == []


def test_an_end_tag_alone_is_an_empty_paragraph():
    assert render("<p>a<div>b</p>c") == "a\n\nb\n\nc"
    assert render("x</p>y") == "x\n\ny"
    assert render("<p>a</p>b") == "a\n\nb"


def test_cells_of_any_length_keep_their_columns():
    long = "word " * 9 + "end"
    rows = [("a", "bb", "c"), (long, "dd", "e"), ("f", long, long), ("g", "", "h")]
    lines = render("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>").split("\n")
    # Columns begin at 0, 3 and 7, in every row.
    assert lines == ["a  bb  c", long, "   dd  e", "f  " + long, "       " + long, "g      h"]
    assert " ".join(" ".join(lines).split()) == " ".join(c for r in rows for c in r if c)
