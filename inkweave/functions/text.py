"""Text expressions: counting, trimming, whitespace folding, title case, newline handling.

All are built-in Spark expressions, so they run inside the scan stage without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace in the documents' text rules.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_WORD = r"(?U)[^\s\x1c-\x1f]+"
_LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
_SEPARATORS = r"[ \n-\r\x1c-\x1e\x85\u2028\u2029]"
_OTHER_WHITESPACE = r"[\t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_ANY_WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Most characters are no whitespace, and fail two cheap classes: the frequent separators one by one, then
# whatever may open a run of the rarer kinds.
_FOLD = (
    rf"[ \n\x0b\f\r\x1c\x1d\x1e\x85]{_ANY_WHITESPACE}*+"
    rf"|(?=[\t\x1f\xa0\u1680-\u3000]){_OTHER_WHITESPACE}*+{_SEPARATORS}{_ANY_WHITESPACE}*+"
)
_CASED_RUNS = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.char_length(text).cast("bigint")


def byte_size(text: Column) -> Column:
    """Number of bytes of the text in UTF-8."""
    return F.octet_length(text).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Rough token count: a quarter of the characters, rounded down (shifting right by two divides by four)."""
    return F.shiftright(F.char_length(text), 2)


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def fold_whitespace(text: Column) -> Column:
    """Split at line ends and spaces, drop empty pieces, join with one space.

    A whitespace run holding a line end or a space becomes one space. A run of only tabs or no-break
    spaces inside a phrase stays as it is.
    """
    return F.regexp_replace(strip(text), _FOLD, " ")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def title_case(text: Column) -> Column:
    """Upper-case the first of every run of cased letters and lower-case the rest ("they're" -> "They'Re")."""
    runs = F.regexp_extract_all(text, F.lit(_CASED_RUNS), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def words(text: Column) -> Column:
    """The lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def filled_lines(text: Column) -> Column:
    """The lines that are not blank, stripped."""
    pieces = F.split(text, _LINE_END)
    return F.filter(F.transform(pieces, strip), lambda line: line != "")
