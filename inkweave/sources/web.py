"""Fetched web pages: main content, titles, and preferring scraped text where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text, urls
from inkweave.functions.html import with_html_title, with_main_content
from inkweave.operators.joins import hot_key_join
from inkweave.sources.documents import make_documents

# The tags that tell scraped text from text taken out of the fetched page.
SCRAPED = "webLoader.Decodo.API"
FETCHED = "webLoader.Fallback.HTTPX_BS4"
#: Addresses with usable scraped text up to which their list is sent to every executor.
BROADCAST_ADDRESSES = 100_000


def with_page_title(rows: DataFrame, html: str, url: str, into: str, mode: str = "auto") -> DataFrame:
    """Add the page's title element where it has text, else a title made from the address."""
    titled = with_html_title(rows, html, "_title", mode)
    given = F.nullif(F.col("_title"), F.lit(""))
    return titled.withColumn(into, F.coalesce(given, urls.url_title(F.col(url)))).drop("_title")


def content_or_fallback(pages: DataFrame, scraped: DataFrame, *, row_id: str, mode: str = "auto") -> DataFrame:
    """Add ``content`` and ``extraction_method`` to pages(url, html, ...): scraped(url, content) text where it
    is present and not blank, else the page's main content.

    ``scraped`` holds one row per address. The main content is taken out where the pages are read, so that texts and no
    HTML are shuffled (a caller who keeps ``html`` sends it along). As long as the addresses with usable text are few
    enough to be sent to every executor, their pages are not parsed at all. Addresses fetched again and again are salted.
    """
    given = scraped.where(~text.is_blank(F.col("content"))).select("url", F.col("content").alias("scraped_text"))
    usable = given.select(F.col("url").alias("_usable"))
    if usable.limit(BROADCAST_ADDRESSES + 1).count() <= BROADCAST_ADDRESSES:
        known = pages.join(F.broadcast(usable), pages["url"] == F.col("_usable"), "left")
        marked = known.withColumn("_page", F.when(F.col("_usable").isNull(), F.col("html"))).drop("_usable")
    else:
        marked = pages.withColumn("_page", F.col("html"))
    read = with_main_content(marked, "_page", "_main", mode).drop("_page")
    joined = hot_key_join(read, given, on=["url"], salt_on=row_id, how="left", counted_on=pages)
    found = F.col("scraped_text").isNotNull()
    return joined.withColumns(
        {
            "content": F.when(found, F.col("scraped_text")).otherwise(F.col("_main")),
            "extraction_method": F.when(found, F.lit(SCRAPED)).otherwise(F.lit(FETCHED)),
        }
    ).drop("_main")


def web_documents(pages: DataFrame, mode: str = "auto", carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents of fetched pages(url, html), by the main-content rule, with the columns ``carry`` of the pages.

    The title is looked for in the extracted content, as that is all a loader hands on, so it is the
    address that names the document unless the text itself carries a title element.
    """
    fetched = with_main_content(pages, "html", "content", mode)
    return documents_of_content(fetched.withColumn("extraction_method", F.lit(FETCHED)), mode, carry)


def documents_of_content(pages: DataFrame, mode: str = "auto", carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents of pages(url, content, extraction_method, and the columns ``carry``)."""
    return make_documents(
        with_page_title(pages, "content", "url", "_named", mode),
        content=F.col("content"),
        source=F.col("url"),
        title=F.col("_named"),
        doc_type=F.lit("url"),
        extraction_method=F.col("extraction_method"),
        carry=carry,
    )
