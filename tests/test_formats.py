import csv
import io
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import formats, html

from .helpers import column_values


def test_csv_rules(spark):
    text = 'a,b,c\r\n1,"x, y"\n\n1,2,3,4\n"he said ""hi""",|,\n'
    got = column_values(spark, [text], formats.csv_to_markdown)[0]
    assert got["error"] is None
    assert got["markdown"].split("\n") == [
        "| a | b | c |",
        "| --- | --- | --- |",
        "| 1 | x, y |  |",
        "| 1 | 2 | 3 |",
        '| he said "hi" | \\| |  |',
    ]


def test_csv_quotes_as_programs_write_them(spark):
    text = 'size,n\n5" pipe,"x" ,3\n"a ""b"" c" d,"1\n2"\n'
    got = column_values(spark, [text, 'a,b\nx "y",2'], formats.csv_to_markdown)
    assert [r["markdown"] for r in got] == [
        '| size | n |\n| --- | --- |\n| 5" pipe | x  |\n| a "b" c d | 1<br>2 |', '| a | b |\n| --- | --- |\n| x "y" | 2 |',
    ]


@pytest.mark.parametrize(
    "text, error",
    [
        (None, "csv error: no text"),
        ("", "csv error: empty file"),
        (" \n\n", "csv error: empty file"),
        ('a\n"x\ny\n', "csv error: quoted field without end"),
        ('a,b\nx "y","2', "csv error: quoted field without end"),
    ],
)
def test_csv_errors(spark, text, error):
    got = column_values(spark, [text], formats.csv_to_markdown)[0]
    assert (got["markdown"], got["error"]) == (None, error)


def test_csv_as_spreadsheets_write_it(spark):
    texts = [
        '\ufeffa,b\r\n1,2\r\n',
        'a,b\r1,2\r',
        'a,b\n"x\r\ny, z",2\n',
        'a\n""\n\n" "\n""""\n',
        '"a,\nb",c\n1,"2"\r\n"3",4',
    ]
    got = [r["markdown"] for r in column_values(spark, texts, formats.csv_to_markdown)]
    assert got == [
        "| a | b |\n| --- | --- |\n| 1 | 2 |",
        "| a | b |\n| --- | --- |\n| 1 | 2 |",
        "| a | b |\n| --- | --- |\n| x<br>y, z | 2 |",
        '| a |\n| --- |\n|  |\n|   |\n| " |',
        "| a,<br>b | c |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |",
    ]


def test_csv_width_has_no_limit(spark):
    text = ",".join(f"c{i}" for i in range(700)) + "\n" + ",".join("x" * 700)
    lines = column_values(spark, [text], formats.csv_to_markdown)[0]["markdown"].split("\n")
    assert lines[0].endswith("| c699 |") and lines[2].count("x") == 700


_cell = st.text(st.one_of(st.characters(blacklist_categories=["Cs", "Cc"]), st.sampled_from('\n",|')), max_size=6)
_table = st.lists(st.lists(_cell, min_size=2, max_size=5), min_size=1, max_size=5)


@settings(max_examples=8, deadline=None)
@given(tables=st.lists(_table, min_size=25, max_size=25))
def test_csv_agrees_with_a_csv_reader(spark, tables):
    texts, expected = [], []
    for table in tables:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(table)
        texts.append(out.getvalue())
        width = len(table[0])
        rows = [[c.replace("|", "\\|").replace("\n", "<br>") for c in (r + [""] * width)[:width]] for r in table]
        rows.insert(1, ["---"] * width)
        expected.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
    got = column_values(spark, texts, formats.csv_to_markdown)
    assert [r["markdown"] for r in got] == expected


VALID_JSON = ['{"k": 1}', "null", '"x"', "true", "1e5", '  {"a": [1, {"b": null}]}\n', '{"a": 1, "a": 2}']
INVALID_JSON = [
    "{bad", '{"k": 1} more', "", " ", "1, 2", "1],[2", "1},{2", '1,"b":2', "NaN", "{'a': 1}",
    '{"a": 01}', '{"a": 1,}', '{"a": "line\nbreak"}', "// c\n1", "1}", "1]",
]


def test_json(spark):
    got = column_values(spark, VALID_JSON + INVALID_JSON, formats.json_to_markdown)
    assert [r["markdown"] for r in got] == VALID_JSON + [None] * len(INVALID_JSON)
    assert {r["error"] for r in got[len(VALID_JSON):]} == {"json error: not valid JSON"}


_json = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(st.characters(blacklist_categories=["Cs"]), max_size=5),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("abc", max_size=2), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=5, deadline=None)
@given(values=st.lists(_json, min_size=40, max_size=40), cut=st.integers(1, 3))
def test_json_against_a_json_reader(spark, values, cut):
    texts = [json.dumps(v) for v in values]
    texts += [t[:-cut] for t in texts] + [t + t for t in texts]

    def valid(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    got = column_values(spark, texts, formats.json_to_markdown)
    assert [r["error"] is None for r in got] == [valid(t) for t in texts]


GOOD_XML = [
    "<a><b>1</b></a>",
    '<?xml version="1.0"?><a>é&amp;</a>',
    '<a b="1"><c/></a>\n',
    "<a><!-- c --></a>",
    "<a/>",
    """ <?xml version="1.0"?><!-- x --><a b="x>y" c='/>'/> <!-- </x> -->""".strip(),
    "<a>1</a><!-- </x> --> <?pi x?>\n",
    "<a><![CDATA[</x> & <]]></a>",
    "<a><a>1</a><a>2</a></a>",
    "<x:a xmlns:x='u'><x:b/></x:a>",
    '<!DOCTYPE a [<!ENTITY who "me">]><a>&who; &amp; you</a>',
    '<!DOCTYPE a SYSTEM "a.dtd" [<!ELEMENT a EMPTY>]><a/>',
    '<?xml version="1.0"?><!DOCTYPE a><a><b/></a>',
]
BAD_XML = [
    "<a><b>1", "plain", "<a x=1></a>", "<a>&foo;</a>", "", "  ", "<a><c></a></c>", "<p>x<br>y</p>",
    "<a>1</a>more", "<a/><b/>", "<a>1</a><b>2</b>", "<a/><b></b>", "<a></a><b/>", "<a/>more", None,
    "<a>1</a><a>2</a>", "<a/>x/>", "more<a>1</a>", "<!DOCTYPE a []><a>&who;</a>",
    '<!DOCTYPE a [<!ENTITY who "me">]><a>&who;</b>',
]


def test_xml(spark):
    got = column_values(spark, GOOD_XML + BAD_XML, formats.xml_to_markdown)
    told = dict(zip(GOOD_XML + BAD_XML, (r["error"] is None for r in got)))
    assert told == {**dict.fromkeys(GOOD_XML, True), **dict.fromkeys(BAD_XML, False)}
    assert [r["markdown"] for r in got[: len(GOOD_XML)]] == GOOD_XML


def test_byte_order_marks(spark):
    got = column_values(spark, ["\ufeff<a/>", "\ufeff"], formats.xml_to_markdown)
    assert [r["error"] for r in got] == [None, "xml error: not well-formed"]
    got = column_values(spark, ["\ufeffhi".encode(), "hi\ufeff".encode()], formats.decode_text, "binary")
    assert [r["text"] for r in got] == ["hi", "hi\ufeff"]


def test_text_and_bytes(spark):
    contents = ["é".encode(), b"\xffA", b"", None]
    got = column_values(spark, contents, formats.decode_text, "binary")
    assert [(r["text"], r["error"]) for r in got] == [
        ("é", None),
        (None, "text error: not valid UTF-8"),
        ("", None),
        (None, "text error: no content"),
    ]
    broken = column_values(spark, [b"\xffA"], lambda c: formats.text_to_markdown(c.cast("string")), "binary")[0]
    assert broken["error"] == "text error: not valid UTF-8"


PAGE = """<!DOCTYPE html><html><head><title>t</title></head><body>
<!-- gone --><script>var t="</p>";</script><style>p{}</style>
<header>top</header><H1 class="x">One</H1><h2>Two</h2><p>a <b>bold</b> &amp; <a href="/x">link</a><br/>next</p>
<ul><LI>first</LI><li>second</li></ul><link rel="x"><i>it</i>&lt;p&gt; &nbsp;</body></html>"""


def test_html_page(spark):
    got = column_values(spark, [PAGE], html.html_to_markdown)[0]
    assert got["error"] is None
    assert got["markdown"] == (
        "top\n\n# One\n\n## Two\n\na **bold** & [link](/x)\nnext\n\n* first\n* second\n\nit<p> \u00a0"
    )


def test_html_properties_on_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = html.html_to_markdown(F.col("html"))["markdown"]
    done = pages.select("html", text.alias("m"))
    assert done.filter(F.col("m").contains("\n\n\n")).count() == 0
    assert done.filter(~F.col("html").contains("&lt;") & F.col("m").rlike("<[a-z/]")).count() == 0
    assert done.filter(F.col("m").isNull() | (F.col("m") == "")).count() == 0


def test_long_blank_runs_stay_linear(spark):
    run = "<p>x" + " " * 200_000 + "y\n" + " \n" * 50_000 + "z</p></html>"
    got = column_values(spark, [run], html.html_to_markdown)[0]["markdown"]
    assert got.endswith("y\n\nz") and got.startswith("x  ")


UNFINISHED = ['<a href="', "<a ", "<a href=\"x\" ", "<p ", "<head>", "</head><head>", "<!--", "<script", "<script ", "<style ", "<b>", "<a x>", "<h1 ", "< "]


@pytest.mark.parametrize("shape", UNFINISHED)
def test_unfinished_tags_stay_linear(spark, shape):
    seconds = []
    for size in (250_000, 1_000_000):
        page = shape * (size // len(shape))
        start = time.perf_counter()
        got = column_values(spark, [page], lambda text: F.struct(html.html_to_markdown(text), html.strip_tags(text)))
        seconds.append(time.perf_counter() - start)
        assert len(got) == 1
    assert seconds[1] < 5 and seconds[1] < 8 * seconds[0] + 1


def test_one_tag_of_many_addresses_stays_linear(spark):
    page = "<a " + 'href="x" ' * 100_000 + "<p>y</p>" + "<a " + 'data-href="x" ' * 100_000 + ">z</a>"
    start = time.perf_counter()
    assert column_values(spark, [page], html.html_to_markdown)[0]["markdown"].endswith("z")
    assert time.perf_counter() - start < 5


def test_heads_and_links(spark):
    texts = [
        "<HEAD><title>t</title></HEAD>a</head>b<head lang='x'>c<head>d</head>e<head>f",
        '<a class="k" data-href="/no" href="/x" href="/y">in</a><a href="/z"\n>out</a>',
        "<header>a</header>",
    ]
    got = [r["markdown"] for r in column_values(spark, texts, html.html_to_markdown)]
    assert got == ["abef", "[in](/x)[out](/z)", "a"]


def test_closing_tag_test(spark):
    texts = ["<p></html>", "<p></HTML> \n", "<p>", "</html> x", "", None]
    assert column_values(spark, texts, html.html_is_closed) == [True, True, False, False, False, None]


def test_open_comments_and_marks(spark):
    texts = ["a <h>b<hL>c <1> d < e<BR>><Hb>f<!-- open <p>x", "<p>x</p><script>if (a<b)", "<h2>a<HL>b</h2>c"]
    got = [r["markdown"] for r in column_values(spark, texts, html.html_to_markdown)]
    assert got == ["a bc <1> d < e\n>f", "x", "## ab\n\nc"]


def test_tags_are_stripped_to_words(spark):
    cut = "<div><script>x()</script><p>one <b>two</b></p><p>three &amp; fo"
    got = column_values(spark, [cut], html.strip_tags)[0]
    assert got["markdown"] == "one\ntwo\nthree & fo"


STRUCTURES = {
    "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><ol start=3><li>x</li><li>y <b>z</b><ol><li>q</ol></ol>end": "* a\n    * b\n    * c\n* d\n\n3. x\n4. y **z**\n    1. q\n\nend",
    "<ul><li>a<ol><li>b</ol>c</ul>": "* a\n    1. b\n\n    c",
    "<ol><li><p>a</p><p>b</p></li><li></ol>": "1. a\n\n    b\n2.",
    "<p>t</p><table><caption>cap</caption><thead><tr><th>a</th><th>b|c</th></tr></thead><tr><td>1<td><p>2</p>x<br>y<tr><td>only</table>after": (
        "t\n\ncap\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 x y |\n| only | |\n\nafter"
    ),
    "<table><tr><td>a<table><tr><td>in</table></td></tr></table>": "| a in |\n| --- |",
    "<pre>\n  def f(x):\n\n    return &lt;b&gt; <b>no</b><br>z\n</pre>x": "```\n  def f(x):\n\n    return <b> no\nz\n\n```\n\nx",
    "<blockquote><p>one</p><p>two<br>three</p><blockquote>in</blockquote></blockquote>out": "> one\n>\n> two\n> three\n>\n> > in\n>\nout",
    "a<hr>b": "a\n\n---\n\nb",
    "<a href='/x'>s</a> <a href=/y><b>t</b>\n<i>u</i></a> <a name=z>w</a> <a href='x'>open": "[s](/x) [**t** u](/y) w open",
    "<img alt=\"al\" src='i.png'><IMG src=b> <a href=\"/q\"><img src=a alt=b></a><img": "![al](i.png)![](b) [![b](a)](/q)<img",
    "it&#39;s &#x41;&#128512;&amp;#39; &#0;&#55296; &mdash;&apos;": "it's A😀&#39; &#0;&#55296; —'",
}


def test_html_structure(spark):
    got = [r["markdown"] for r in column_values(spark, list(STRUCTURES), html.html_to_markdown)]
    assert got == list(STRUCTURES.values())


NESTED = ["<ul><li>a", "<table><tr><td>x", "<ol><li>a</li>", "<tr><td>x", "<pre>a\n", "<blockquote>a", "<ol><a href='x'>", '<ol><img alt="', "&#39;", "<li><ul>"]


@pytest.mark.parametrize("shape", NESTED)
def test_nested_pages_stay_linear(spark, shape):
    seconds = []
    for size in (50_000, 200_000):
        page = "<ol>" + shape * (size // len(shape))
        start = time.perf_counter()
        assert len(column_values(spark, [page], html.html_to_markdown)) == 1
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * seconds[0] + 1


def test_deep_lists_lose_no_text(spark):
    page = "<ul><li>x" * 300 + "</ul>" * 300 + "<ol><li>end</ol>"
    got = column_values(spark, [page], html.html_to_markdown)[0]["markdown"]
    assert got.count("* x") == 300 and got.endswith("\n1. end")
