"""Cleaning documents and cutting them into overlapping chunks with their context.

A text is cut once into blocks of one step each, and a chunk is its own block plus the start of the blocks
after it. The work is linear in the text's length; taking every chunk by its offset would count characters
from the start of the text again for each one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.functions.text import fold_whitespace, token_estimate

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CONTEXT_CHARS = 100
#: Chunks of one document that a window looks through together.
SEGMENT_CHUNKS = 4096


def clean_documents(documents: DataFrame) -> DataFrame:
    """Fold the whitespace of the content. Sizes and counts keep describing the loaded content."""
    return documents.withColumn("content", fold_whitespace(F.col("content")))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.md5(F.concat_ws("|", document_id, chunk_index.cast("string")))


def chunk_documents(
    documents: DataFrame,
    *,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    context: int = CONTEXT_CHARS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Chunks of ``size`` characters, each starting ``size - overlap`` after the one before.

    Offsets are 0-based and half-open; the last chunk ends where the text ends; an empty text has none.
    ``carry`` names document columns to keep on the chunks (as ``document_<name>``), which saves joining
    them back. Narrow throughout: chunks are made in the scan stage.
    """
    if not 0 <= overlap < size or context < 0:
        raise ValueError("need 0 <= overlap < size and context >= 0")
    step = size - overlap
    after = math.ceil((overlap + context) / step)
    before = math.ceil(context / step)
    carried = [F.col(name).alias(f"document_{name}") for name in carry]

    blocks = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = documents.select(
        F.col("id").alias("document_id"), *carried, F.char_length("content").alias("chars"), blocks.alias("blocks")
    )
    count = F.when(
        F.col("chars") > 0,
        F.floor(F.greatest(F.col("chars") - overlap - 1, F.lit(0)) / F.lit(step)) + 1,
    ).otherwise(0)

    own = F.col("blocks")
    length = F.greatest(F.size(own), F.lit(1))
    columns = [own.alias("own")]
    for i in range(1, after + 1):
        columns.append(F.slice(own, i + 1, length).alias(f"next{i}"))
    for i in range(1, before + 1):
        columns.append(F.concat(F.array_repeat(F.lit(None).cast("string"), i), own).alias(f"prev{i}"))
    rows = F.slice(F.arrays_zip(*columns), F.lit(1), count.cast("int"))
    kept = ["document_id", *[f"document_{name}" for name in carry], "chars"]
    exploded = cut.select(*kept, F.posexplode(rows).alias("chunk_index", "piece"))

    tail = F.concat_ws("", *[F.col(f"piece.next{i}") for i in range(1, after + 1)]) if after else F.lit("")
    lead = F.concat_ws("", *[F.col(f"piece.prev{i}") for i in range(before, 0, -1)]) if before else F.lit("")
    own_text = F.col("piece.own")
    start = F.col("chunk_index") * step
    pieces = exploded.select(
        *kept,
        "chunk_index",
        start.cast("int").alias("start_index"),
        F.least(start + size, F.col("chars")).cast("int").alias("end_index"),
        F.concat(own_text, F.substring(tail, 1, overlap)).alias("content"),
        F.right(lead, F.lit(context)).alias("preceding_context"),
        F.substring(tail, overlap + 1, context).alias("following_context"),
    )
    blank_to_null = {c: F.nullif(F.col(c), F.lit("")) for c in ("preceding_context", "following_context")}
    full = pieces.withColumns(blank_to_null).withColumns(
        {
            "id": chunk_id(F.col("document_id"), F.col("chunk_index")),
            "token_count": token_estimate(F.col("content")),
            "embeddings": F.lit(None).cast("array<float>"),
            "topics": F.array().cast("array<string>"),
        }
    )
    return full.select(*schemas.CHUNK.fieldNames(), *[f"document_{name}" for name in carry])


def neighbour_context(
    chunks: DataFrame,
    *,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    context: int = CONTEXT_CHARS,
    segment: int = SEGMENT_CHUNKS,
) -> DataFrame:
    """Fill in ``preceding_context`` and ``following_context`` from the neighbouring chunks, where the text is not at hand.

    A neighbour's own step of text lies next to the chunk, so a few neighbours hold all of its context. A document is
    cut into segments of ``segment`` chunks, and each segment gets the edges of the chunks next to it as a halo, without
    their content: a document of any length spreads over the tasks. Where a neighbour is missing, context ends there.
    Chunks must be cut as ``chunk_documents`` cuts them by the given size and overlap, and ids be unique.
    """
    if not 0 <= overlap < size or context < 0:
        raise ValueError("need 0 <= overlap < size and context >= 0")
    step = size - overlap
    reach = math.ceil(context / step)
    at, own = F.col("chunk_index"), F.floor(F.col("chunk_index") / segment)
    if segment < max(reach, 1):
        raise ValueError("a segment must be as long as the context reaches")
    segments = F.array_compact(
        F.array(own, F.when((own > 0) & (at - own * segment < reach), own - 1), F.when((own + 1) * segment - at <= reach, own + 1))
    )
    rest = [c for c in chunks.columns if c not in ("document_id", "chunk_index", "preceding_context", "following_context")]
    edged = chunks.select(
        "document_id",
        "chunk_index",
        F.struct(*rest).alias("own"),
        F.struct(at.alias("at"), F.substring("content", 1, step).alias("head"), F.substring(F.col("content"), F.lit(overlap + 1), F.char_length("content")).alias("tail")).alias("edge"),
        F.explode(segments).alias("segment"),
    )
    mine = F.col("segment") == F.floor(at / segment)
    placed = edged.withColumn("own", F.when(mine, F.col("own")))
    order = Window.partitionBy("document_id", "segment").orderBy("chunk_index")

    def piece(k: int, part: str) -> Column:
        found = F.lag("edge", k).over(order) if k > 0 else F.lead("edge", -k).over(order)
        return F.when(found["at"] == at - k, found[part])

    def joined(pieces: list[Column]) -> list[Column]:
        """The pieces up to the first missing one: nothing beyond it is next to the chunk."""
        whole, out = F.lit(True), []
        for p in pieces:
            whole = whole & p.isNotNull()
            out.append(F.when(whole, p))
        return out

    lead = F.concat_ws("", *reversed(joined([piece(k, "head") for k in range(1, reach + 1)]))) if reach else F.lit("")
    tail = F.concat_ws("", *joined([piece(-k, "tail") for k in range(1, reach + 1)])) if reach else F.lit("")
    found = placed.select(
        "document_id", "chunk_index", "own",
        F.nullif(F.right(lead, F.lit(context)), F.lit("")).alias("preceding_context"),
        F.nullif(F.substring(tail, 1, context), F.lit("")).alias("following_context"),
    ).where(F.col("own").isNotNull())
    return found.select("*", "own.*").select(*[c for c in chunks.columns if c not in ("preceding_context", "following_context")], "preceding_context", "following_context")
