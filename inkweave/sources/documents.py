"""The standard document projection, source metadata, and the registry of loaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkweave import schemas
from inkweave.functions import text, urls
from inkweave.operators.ordering import row_digest


def document_id(source: Column) -> Column:
    """A stable id: loading the same source again names the same document."""
    return F.md5(source)


def source_metadata(
    source: Column, size_on_disk: Column | None = None, modified_time: Column | None = None
) -> Column:
    """Metadata known from the source alone: its kind and, for files, name, extension, size and time."""
    empty = F.lit(None).cast("string")
    size = empty if size_on_disk is None else size_on_disk.cast("string")
    modified = empty if modified_time is None else F.unix_micros(modified_time).cast("string")
    web = F.create_map(F.lit("source"), source, F.lit("source_type"), F.lit("url"))
    file = F.create_map(
        F.lit("source"), source,
        F.lit("source_type"), F.lit("file"),
        F.lit("filename"), urls.file_name(source),
        F.lit("extension"), urls.file_extension(source),
        F.lit("size"), size,
        F.lit("modified_time"), modified,
    )
    known = F.map_filter(file, lambda _, value: value.isNotNull())
    return F.when(urls.is_url(source), web).otherwise(known)


def override(base: Column, extra: Column | None) -> Column:
    """Both maps as one; where a key is in both, the second map's value stands."""
    if extra is None:
        return base
    given = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda key, _: ~F.map_contains_key(given, key)), given)


def make_documents(
    rows: DataFrame,
    *,
    content: Column,
    source: Column,
    title: Column,
    doc_type: Column,
    language: Column | None = None,
    encoding: Column | None = None,
    extraction_method: Column | None = None,
    metadata: Column | None = None,
    size_on_disk: Column | None = None,
    modified_time: Column | None = None,
    word_count: Column | None = None,
    char_count: Column | None = None,
    created_at: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Project rows to documents: a narrow select that stays in the scan stage.

    ``size`` is the UTF-8 size of the content. Word and character counts are derived unless given as
    other than 0. Given metadata wins over what the source tells. A document type outside the domain ends the job.
    ``created_at`` is when the documents are loaded, unless it is given. ``carry`` names columns of the rows to keep.
    """
    staged = rows.select(
        content.alias("content"),
        source.alias("source"),
        title.alias("title"),
        schemas.checked(doc_type, schemas.DOCUMENT_TYPES, "doc_type").alias("doc_type"),
        (F.lit("en") if language is None else language).alias("language"),
        (F.lit("utf-8") if encoding is None else encoding).alias("encoding"),
        (F.lit(None).cast("string") if extraction_method is None else extraction_method).alias(
            "extraction_method"
        ),
        (F.lit(0) if word_count is None else word_count).cast("bigint").alias("given_words"),
        (F.lit(0) if char_count is None else char_count).cast("bigint").alias("given_chars"),
        override(source_metadata(source, size_on_disk, modified_time), metadata).alias("metadata"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        *carry,
    )
    body = F.col("content")
    kept = StructType([*schemas.DOCUMENT.fields, *[staged.schema[c] for c in carry]])
    return schemas.conform(
        staged.select(
            "*",
            document_id(F.col("source")).alias("id"),
            text.byte_size(body).alias("size"),
            schemas.when_zero(F.col("given_words"), text.word_count(body)).alias("word_count"),
            schemas.when_zero(F.col("given_chars"), text.char_count(body)).alias("char_count"),
        ),
        kept,
    )


def filter_doc_types(documents: DataFrame, doc_types: list[str] | None) -> DataFrame:
    """Keep the given document types; None keeps all."""
    if doc_types is None:
        return documents
    unknown = set(doc_types) - set(schemas.DOCUMENT_TYPES)
    if unknown:
        raise ValueError(f"unknown document types: {sorted(unknown)}")
    return documents.where(F.col("doc_type").isin(*doc_types))


def document_registry(documents: DataFrame, order_by: str, key: str = "id") -> DataFrame:
    """One row per id, the last write winning: the greatest order, a null one being the least; of equal orders the one
    with the greatest hash, so that reruns agree.

    Every task keeps the last write of each id among its own rows before they are sent (a limit of one row by group).
    So the documents are read and hashed once, the content is in no aggregate and is shuffled once at most, and an id
    that was written again and again sends one row from each task.
    """
    rest = [name for name in documents.columns if name != key]
    marked = documents.withColumn("_digest", row_digest(documents, rest))
    last = Window.partitionBy(key).orderBy(F.desc(order_by), F.desc("_digest"))
    return marked.withColumn("_place", F.row_number().over(last)).where("_place = 1").select(*documents.columns)
