"""Text, URL, HTML and line rules against fixed cases and a plain-Python reading of the same rule."""


import pytest
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.functions import html, linearize, metrics, text, urls

SPACES = ["a\xa0b", "a\x1cb", "a\x85b", "a​b", "", " a  b　", "\x0b\x1fa \t b\n\nc", "one", "  "]


@pytest.mark.parametrize("sample", SPACES)
def test_word_count(value, sample):
    assert value(text.word_count, t=sample) == len(sample.split())


@pytest.mark.parametrize("sample", SPACES)
def test_strip(value, sample):
    assert value(text.strip, t=sample) == sample.strip()


def test_fold_whitespace(spark):
    """Expected texts written out: runs of whitespace become one space, ends are cut."""
    expected = {
        "": "", " ": "", "\n": "", " \t\n ": "", "a": "a", " a ": "a", "a b": "a b", "a  b": "a b", "a\nb": "a b", "a\r\nb": "a b", "a \n b": "a b",
        "\n\na\n\n\nb c\n": "a b c", "a\x0bb": "a b", "a\x0cb": "a b", "a\x1cb": "a b", "a\x1db": "a b", "a\x1eb": "a b", "a\x85b": "a b",
        "a\u2028b": "a b", "a\u2029b": "a b", "a\tb": "a\tb", "a\t b": "a b", "a \tb": "a b", "\ta\t": "a", "a\xa0b": "a\xa0b", "a\xa0 b": "a b",
        "a \xa0b": "a b", "\xa0a\xa0": "a", "a\u3000b": "a\u3000b", "a \u3000 b": "a b", "a\x1fb": "a\x1fb", "a\x1f b": "a b", "a\u200bb": "a\u200bb",
        "a  b \n\n c\r\rd ": "a b c d", "é 😀\n": "é 😀",
    }
    rows = spark.createDataFrame(list(enumerate(expected)), "i int, t string")
    for row in rows.select("t", text.fold_whitespace(F.col("t")).alias("v")).collect():
        assert row["v"] == expected[row["t"]], repr(row["t"])


def test_counts(value):
    assert value(text.token_estimate, t="1234567") == 1
    assert value(text.token_estimate, t="123") == 0
    assert value(text.byte_size, t="\xe9") == 2
    assert value(text.char_count, t="\U0001f600a") == 2


def test_when_zero(value):
    def given(n):
        return lambda t: schemas.when_zero(F.lit(n), text.word_count(t))

    assert [value(given(n), t="two words") for n in (9, 0, None)] == [9, 2, 2]


@pytest.mark.parametrize("sample", ["they're", "foo_bar a1b", "\xe9COLE x", "\xdfa", "", "ǆa"])
def test_title_case(value, sample):
    assert value(text.title_case, t=sample) == sample.title()


@pytest.mark.parametrize(
    "source,kind",
    [("A.PDF", "pdf"), ("x.tar.gz", None), (".txt", None), ("noext", None), ("https://h/x.pdf", "url"),
     ("dir.md/readme", None), ("d/e.Html", "html"), ("HTTP://h/", "url")],
)
def test_document_type(value, source, kind):
    assert value(urls.document_type, s=source) == kind


@pytest.mark.parametrize(
    "url,title",
    [
        ("http://h/a/b-c?q=1", "B C - A"),
        ("http://h/", "Web Document from h"),
        ("https://h:80//x//y.html#z", "Y.Html - X"),
        ("http://h", "Web Document from h"),
        ("http://h/a;p=1", "A"),
    ],
)
def test_url_title(value, url, title):
    assert value(urls.url_title, u=url) == title


def test_file_names(value):
    assert value(urls.file_stem, p="a/b.tar.gz") == "b.tar"
    assert value(urls.file_stem, p="a/.hidden") == ".hidden"
    assert value(urls.file_extension, p="a/B.TXT") == ".TXT"


PAGES = {
    "plain": ("<p>a</p><p>b</p><script>x</script>", "ab", "a b", ""),
    "article": ("<body>x<article> a <b>b</b></article></body>", "x a b", "a b", ""),
    "main": ("<title> T </title><body><nav>n</nav><main>m<br>k</main></body>", "T nmk", "m k", "T"),
    "body": ("<title>T</title><body>only <i>body</i></body>", "Tonly body", "only body", "T"),
    "comment": ("a<!-- <article>no</article> -->b<style>p{}</style>", "ab", "a b", ""),
    "rare entity": ("<body><p>caf&eacute; &#8212; x</p></body>", "caf\xe9 — x", "caf\xe9 — x", ""),
    "nested": ("<article>a<article>b</article>c</article>d", "abcd", "a b c", ""),
    "quoted": ('<article><a title="x > y">t</a></article>', "t", "t", ""),
    "unclosed": ("<body><article>a<p>b</body>", "ab", "a b", ""),
    "two": ("<article>a</article><article>b</article>", "ab", "a", ""),
    "less": ("<body>1 < 2 &amp;&amp; 3</body>", "1 < 2 && 3", "1 < 2 && 3", ""),
    "empty": ("", "", "", ""),
}


@pytest.mark.parametrize("mode", ["auto", "arrow"])
def test_html(spark, mode):
    rows = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "name string, html string")
    rows = html.with_html_text(rows, "html", "text", mode)
    rows = html.with_main_content(rows, "html", "main", mode)
    rows = html.with_html_title(rows, "html", "title", mode)
    for row in rows.collect():
        assert (row["text"], row["main"], row["title"]) == PAGES[row["name"]][1:], row["name"]


def test_html_native_and_parser_agree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for add in (html.with_html_text, html.with_main_content, html.with_html_title):
        both = add(add(pages, "html", "native", "native"), "html", "arrow", "arrow")
        assert both.where(~F.col("native").eqNullSafe(F.col("arrow"))).count() == 0


BODIES = {
    '{"b":1,"a":"x"}': "b: 1\na: x",
    '[1,"a"]': "Item 1: 1\nItem 2: a",
    "3": "",
    "{}": "",
    "[]": "",
    '{"a":{"k":[true,null]},"f":1e5}': "a: {'k': [True, None]}\nf: 100000.0",
    '{"a":1,"b":2,"a":3}': "a: 3\nb: 2",
    '{"t":true,"n":null}': "t: True\nn: None",
    "{'a':1}": None,
    '{"a":1,}': None,
    "": None,
    '{"q":"x \\" y"}': 'q: x " y',
    '{"big":123456789012345678901234567890}': "big: 123456789012345678901234567890",
}


@pytest.mark.parametrize("mode", ["auto", "arrow"])
def test_json_text(spark, mode):
    rows = spark.createDataFrame([(b,) for b in BODIES], "body string")
    for row in linearize.with_json_text(rows, "body", "text", mode).collect():
        assert row["text"] == BODIES[row["body"]], row["body"]


@pytest.mark.parametrize(
    "body,lines",
    [
        ("a,b\n1,2\n3\n4,5\n", "Headers: a, b\n\nRow 1: a: 1 | b: 2\nRow 3: a: 4 | b: 5"),
        ("", ""),
        ("\n1,2\n", ""),
        ('a,b\r\n"x, y","p\r\nq"\r\n', "Headers: a, b\n\nRow 1: a: x, y | b: p\r\nq"),
        ("a\n", "Headers: a\n"),
    ],
)
def test_csv_text(value, body, lines):
    assert value(linearize.csv_text, b=body) == lines


def test_metrics(value):
    assert value(lambda t: metrics.diversity(text.words(t)), t="A a b c") == 0.75
    assert value(lambda t: metrics.diversity(text.words(t)), t=" ") is None
    assert value(lambda t: metrics.coherence(text.filled_lines(t)), t="x\n\nx \r\ny") == 2 / 3
    assert value(lambda a, b: metrics.relevance(text.words(a), text.words(b)), a="the cat", b="the Cat sat sat") == 2 / 3
    assert value(lambda t: metrics.bias(text.words(t), ["Bad"]), t="bad good bad ok") == 0.5
    assert value(lambda t: metrics.toxicity(text.words(t), ["bad"], F.lit(1)), t="fine") == 1.0
