"""Expressions over sources: URL parts, file names, suffixes, titles and document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions.text import title_case
from inkweave.schemas import DOCUMENT_TYPES

# The generic URI split of RFC 3986, appendix B: scheme, authority, path.
_URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"
_LEADING_CONTROL = "".join(chr(c) for c in range(0x21))


def _clean_url(url: Column) -> Column:
    return F.translate(F.ltrim(url, F.lit(_LEADING_CONTROL)), "\t\r\n", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean_url(url), _URI, 1))


def url_host(url: Column) -> Column:
    """The authority part as written, port and user included."""
    return F.regexp_extract(_clean_url(url), _URI, 2)


def url_path(url: Column) -> Column:
    """The path, without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean_url(url), _URI, 3), r";[^/]*$", "")


def has_web_scheme(source: Column) -> Column:
    return url_scheme(source).isin("http", "https")


def is_url(source: Column) -> Column:
    return source.rlike(r"(?i)^https?://")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_extension(path: Column) -> Column:
    """The last suffix with its dot and case kept, or an empty string. A leading dot starts no suffix."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_suffix(path: Column) -> Column:
    """The last suffix, lower-cased and without the dot."""
    return F.lower(F.ltrim(file_extension(path), F.lit(".")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent_folder(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def document_type(source: Column) -> Column:
    """``url`` for web addresses, else the suffix where it names a known type, else null."""
    suffix = file_suffix(source)
    return F.when(is_url(source), F.lit("url")).when(suffix.isin(*DOCUMENT_TYPES), suffix)


def url_title(url: Column) -> Column:
    """Title made from the address: path segments in title case, last first, or the host."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    titles = F.transform(segments, lambda s: title_case(F.translate(s, "-", " ")))
    return F.when(F.size(segments) > 0, F.array_join(F.reverse(titles), " - ")).otherwise(
        F.concat(F.lit("Web Document from "), url_host(url))
    )
