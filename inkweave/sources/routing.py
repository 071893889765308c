"""Which loader reads a source, whether a source can be read, and what became of the requested ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import urls
from inkweave.operators.joins import hot_key_join
from inkweave.schemas import DOCUMENT_TYPES, FILE_TYPES


def loader_for(source: Column, exists: Column) -> Column:
    """``web``, ``pdf`` or ``document``; null where nothing reads the source or the file is missing."""
    suffix = urls.file_suffix(source)
    return (
        F.when(urls.has_web_scheme(source), F.lit("web"))
        .when(~exists, F.lit(None).cast("string"))
        .when(suffix == "pdf", F.lit("pdf"))
        .when(suffix.isin(*[t for t in FILE_TYPES if t != "pdf"]), F.lit("document"))
    )


def with_existence(sources: DataFrame, listing: DataFrame, *, source: str, row_id: str) -> DataFrame:
    """Add ``exists``: whether the listing of files holds the source."""
    present = listing.select(F.col(source)).distinct().withColumn("exists", F.lit(True))
    joined = hot_key_join(sources, present, on=[source], salt_on=row_id, how="left")
    return joined.withColumn("exists", F.coalesce("exists", F.lit(False)))


def route_sources(sources: DataFrame, listing: DataFrame, *, source: str = "source", row_id: str) -> DataFrame:
    found = with_existence(sources, listing, source=source, row_id=row_id)
    return found.withColumn("loader", loader_for(F.col(source), F.col("exists")))


def validate_sources(
    sources: DataFrame,
    listing: DataFrame,
    *,
    source: str = "source",
    row_id: str,
    supported: tuple[str, ...] = DOCUMENT_TYPES,
) -> DataFrame:
    """Add ``valid``: a web address where the loader takes those, else an existing file of a supported type."""
    found = with_existence(sources, listing, source=source, row_id=row_id)
    suffix = urls.file_suffix(F.col(source))
    file_ok = F.col("exists") & suffix.isin(*DOCUMENT_TYPES) & suffix.isin(*supported)
    valid = F.when(urls.is_url(F.col(source)), F.lit("url" in supported)).otherwise(file_ok)
    return found.withColumn("valid", F.coalesce(valid, F.lit(False)))


def load_failures(requested: DataFrame, loaded: DataFrame, source: str = "source") -> DataFrame:
    """Requested sources that were not loaded, with how often each was asked for.

    Requests are counted per source before the join, so a source asked for over and over is one row there.
    """
    asked = requested.groupBy(source).agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(loaded.select(source).distinct(), source, "left_anti")


def load_report(requested: DataFrame, loaded: DataFrame, source: str = "source") -> DataFrame:
    """One row: how many sources were requested, loaded and lost."""
    asked = requested.groupBy(source).agg(F.count(F.lit(1)).alias("requests"))
    got = loaded.select(source).distinct().withColumn("got", F.lit(True))
    met = asked.join(got, source, "left")
    return met.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requested"),
        F.coalesce(F.sum(F.when(F.col("got"), F.col("requests"))), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum(F.when(F.col("got").isNull(), F.col("requests"))), F.lit(0)).alias("failed"),
    )
