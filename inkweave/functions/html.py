"""Text, main content and title of HTML, as built-in expressions with an Arrow-batched parser beside them.

Each function adds a column to a frame, in steps that are computed once per row.

``mode``
    ``native``  expressions only: no Python, for well-formed markup with the common entities;
    ``arrow``   the standard library's HTML parser for every row;
    ``auto``    native, and the parser for just the rows whose markup the expressions cannot read exactly
                (rare entities, quoted ``>``, nested or unclosed elements). The parser sees null for the rest.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkweave.functions.text import fold_whitespace, strip
from inkweave.operators.staging import compute_once

# The entities the native expressions decode. The ampersand comes last, so that what it
# uncovers is not decoded a second time.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&copy;": "\xa9",
    "&middot;": "\xb7",
    "&amp;": "&",
}

# A noncharacter stands for removed markup; real text does not contain it.
_MARK = "\ufdd0"
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_TAG = r"(?s)</?[a-zA-Z][^>]*>|<[!?][^>]*>"

_RARE_ENTITY = r"&(?!(?:lt|gt|quot|apos|#39|nbsp|copy|middot|amp);)[#a-zA-Z]"
_ODD_MARKUP = (
    r"(?i)<!--|<!\[|</(?![a-z])|<(?:script|style|textarea|template|plaintext|xmp|iframe|noembed|noframes)\b"
    r"|<[a-z][^<>]*=\s*(?:\"[^\"<>]*[<>]|'[^'<>]*[<>])"
)


def _visible(html: Column) -> Column:
    """The markup with comments, scripts and styles replaced by the mark."""
    return F.regexp_replace(html, _HIDDEN, _MARK)


def _decode_entities(text: Column) -> Column:
    decoded = text
    for entity, char in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _odd(visible: Column) -> Column:
    return visible.rlike(_RARE_ENTITY) | visible.rlike(_ODD_MARKUP)


def _native_text(visible: Column) -> Column:
    bare = F.regexp_replace(F.replace(visible, F.lit(_MARK), F.lit("")), _TAG, "")
    return fold_whitespace(_decode_entities(bare))


def _element(visible: Column, name: str) -> Column:
    return F.regexp_extract(visible, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)


def _has(visible: Column, name: str) -> Column:
    return visible.rlike(rf"(?i)<{name}\b")


def _region(visible: Column) -> Column:
    """Inner markup of the first article, else the first main element, else the body, else all of it."""
    body = F.regexp_extract(visible, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return (
        F.when(_has(visible, "article"), _element(visible, "article"))
        .when(_has(visible, "main"), _element(visible, "main"))
        .when(_has(visible, "body"), body)
        .otherwise(visible)
    )


def _region_odd(visible: Column, region: Column) -> Column:
    """True where the element that holds the content is nested, or empty, which may mean that it is not closed."""
    named = visible.rlike(r"(?i)<(?:article|main)\b")
    return region.rlike(r"(?i)<(?:article|main|body)\b") | (named & (region == ""))


def _native_main(region: Column) -> Column:
    nodes = _decode_entities(F.regexp_replace(region, _TAG, _MARK))
    joined = F.regexp_replace(nodes, rf"(?U)[\s\x1c-\x1f]*+{_MARK}[\s\x1c-\x1f{_MARK}]*+", " ")
    return strip(joined)


def _native_title(title: Column) -> Column:
    return strip(_decode_entities(F.replace(title, F.lit(_MARK), F.lit(""))))


# Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REGIONS = ("article", "main", "body", "title")


class _TextNodes(HTMLParser):
    """Collects the visible text nodes of a page, noting which of the elements of interest each lies in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, frozenset[str]]] = []
        self.seen: set[str] = set()
        self._open: list[tuple[str, bool]] = []
        self._pending: list[str] = []

    def _end_node(self) -> None:
        if self._pending:
            inside = frozenset(name for name, first in self._open if first)
            self.nodes.append(("".join(self._pending), inside))
            self._pending.clear()

    def handle_starttag(self, tag, attrs):
        self._end_node()
        if tag not in _VOID:
            self._open.append((tag, tag in _REGIONS and tag not in self.seen))
            self.seen.add(tag)

    def handle_startendtag(self, tag, attrs):
        self._end_node()
        self.seen.add(tag)

    def handle_endtag(self, tag):
        self._end_node()
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                del self._open[at:]
                break

    def handle_comment(self, data):
        self._end_node()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not any(name in ("script", "style") for name, _ in self._open):
            self._pending.append(data)

    @classmethod
    def of(cls, html: str) -> "_TextNodes":
        walk = cls()
        walk.feed(html)
        walk.close()
        walk._end_node()
        return walk

    def inside(self, region: str) -> list[str]:
        return [text for text, names in self.nodes if region in names]


def _per_page(rule):
    """An Arrow-batched function that applies a rule to each page's text nodes; null stays null."""

    @F.pandas_udf(StringType())
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else rule(_TextNodes.of(page)))

    return parse


def _all_text(walk: _TextNodes) -> str:
    return "".join(text for text, _ in walk.nodes)


def _content_text(walk: _TextNodes) -> str:
    region = next((r for r in ("article", "main", "body") if r in walk.seen), None)
    texts = walk.inside(region) if region else [text for text, _ in walk.nodes]
    return " ".join(t for t in (text.strip() for text in texts) if t)


def _title_text(walk: _TextNodes) -> str:
    texts = walk.inside("title")
    return texts[0].strip() if len(texts) == 1 else ""


def _add(rows: DataFrame, html: str, into: str, mode: str, part, odd, native, rule, finish=lambda text: text) -> DataFrame:
    """Add a column by the native expressions, the parser, or each where it is called for.

    ``part`` picks the markup the expressions work on, ``odd`` tells where they would be wrong.
    """
    page = F.col(html)
    if mode == "arrow":
        return rows.withColumn(into, finish(_per_page(rule)(page)))
    if mode not in ("native", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    seen = compute_once(rows, {"_visible": _visible(page)}).withColumn("_part", part(F.col("_visible")))
    if mode == "native":
        return compute_once(seen, {into: native(F.col("_part"))}).drop("_visible", "_part")
    unclear = F.coalesce(odd(F.col("_visible"), F.col("_part")), F.lit(False))
    made = compute_once(seen, {"_odd": unclear, "_native": native(F.col("_part"))})
    parsed = finish(_per_page(rule)(F.when(F.col("_odd"), page)))
    chosen = F.when(F.col("_odd"), parsed).otherwise(F.col("_native"))
    return made.withColumn(into, chosen).drop("_visible", "_part", "_odd", "_native")


def with_html_text(rows: DataFrame, html: str, into: str, mode: str = "auto") -> DataFrame:
    """Add all text outside scripts and styles, nothing put between tags, whitespace folded. The title stays in."""
    return _add(
        rows, html, into, mode, lambda v: v, lambda v, _: _odd(v), _native_text, _all_text, finish=fold_whitespace
    )


def with_main_content(rows: DataFrame, html: str, into: str, mode: str = "auto") -> DataFrame:
    """Add the text of the first article, else main, else body, else all; text nodes stripped, joined with a space."""
    return _add(
        rows, html, into, mode, _region, lambda v, r: _odd(v) | _region_odd(v, r), _native_main, _content_text
    )


def with_html_title(rows: DataFrame, html: str, into: str, mode: str = "auto") -> DataFrame:
    """Add the stripped text of the first title element, or an empty string."""

    def odd(_: Column, title: Column) -> Column:
        return title.rlike(r"<[a-zA-Z/]") | title.rlike(_RARE_ENTITY)

    return _add(rows, html, into, mode, lambda v: _element(v, "title"), odd, _native_title, _title_text)
