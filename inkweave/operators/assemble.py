"""Ordered parts and split records put back together as text, one row per document.

A document's text is one cell everywhere in this model, so gathering its parts makes a group no larger than the
document itself. Where documents are too large for a cell, ``segment`` names a column of the caller's that cuts them:
every (document, segment) then is a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text
from inkweave.functions.linearize import csv_header_lines, csv_record_line


def _keys(document: str, segment: str | None) -> list[str]:
    return [document] if segment is None else [document, segment]


def _ordered(seq: Column, piece: Column) -> Column:
    """The group's pieces in order; a null piece is left out."""
    kept = F.collect_list(F.when(piece.isNotNull(), F.struct(seq.alias("seq"), piece.alias("piece"))))
    return F.transform(F.array_sort(kept), lambda p: p["piece"])


def assemble_parts(
    parts: DataFrame, *, document: str, seq: str, part: str, separator: str = "\n", segment: str | None = None
) -> DataFrame:
    """Join each document's parts that are not blank, in order. Paragraphs take a line end as separator,
    pages an empty line. Gives (document, [segment,] content)."""
    kept = F.when(~text.is_blank(F.col(part)), F.col(part))
    return parts.groupBy(*_keys(document, segment)).agg(
        F.array_join(_ordered(F.col(seq), kept), separator).alias("content")
    )


def csv_rows_text(
    records: DataFrame, headers: DataFrame, *, document: str, row_num: str, cells: str, segment: str | None = None
) -> DataFrame:
    """The CSV text of records already split into cells, numbered in ``row_num``.

    ``headers`` holds a row (document, ``cells``) per document, so a document without records has its header lines
    and gaps in the numbers do not matter. Records of another width than the header, or without one, are left out but
    keep their number. Of several headers of one document the least is taken. Gives (document, [segment,] content);
    with segments, each has its own header row.
    """
    keys = _keys(document, segment)
    # header and records meet in the group, not in a join, so a document of very many records is one shuffle
    head = headers.select(*keys, F.lit(None).cast("bigint").alias("_row"), F.col(cells).alias("_cells"))
    body = records.select(*keys, F.col(row_num).cast("bigint").alias("_row"), F.col(cells).alias("_cells"))
    record = F.when(F.col("_row").isNotNull(), F.struct("_row", "_cells"))
    gathered = head.unionByName(body).groupBy(*keys).agg(
        F.min(F.when(F.col("_row").isNull(), F.col("_cells"))).alias("_headers"),
        F.array_sort(F.collect_list(record)).alias("_records"),
    )
    lines = F.transform("_records", lambda r: csv_record_line(r["_row"], F.col("_headers"), r["_cells"]))
    kept = F.filter(lines, lambda line: line.isNotNull())
    content = F.when(F.size("_headers") > 0, F.array_join(F.concat(csv_header_lines(F.col("_headers")), kept), "\n"))
    return gathered.select(*keys, F.coalesce(content, F.lit("")).alias("content"))
