"""Numbers of rows in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.session import written


def row_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A hash of a row's columns; maps, which Spark does not hash, as JSON text."""
    names = rows.columns if columns is None else columns
    maps = {f.name for f in rows.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{n}`"))) if n in maps else F.col(f"`{n}`") for n in names])


def dense_number(rows: DataFrame, order_by: Sequence[str | Column], into: str = "seq", start: int = 0) -> DataFrame:
    """Add ``into``: the row's place in the ascending order (nulls first) of columns or expressions, without gaps, from
    ``start``.

    Rows are cut into ranges and sorted within them; a row's number is the count of all rows in the ranges before its
    own, and its place within it. Only the counts of the ranges, one number for each, pass through the driver. Rows of
    equal order follow the hash of their columns, and a range may be cut among them, so a value that a third of the
    rows share fills no single task; wholly equal rows are numbered in any order, which nobody can tell. The numbered
    rows are a written table, so that the ranges, whose borders are sampled, are the same for every reader.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    keyed = rows.select("*", *[k.alias(f"_key{i}") for i, k in enumerate(keys)], row_digest(rows).alias("_tie"))
    order = [*(f"_key{i}" for i in range(len(keys))), "_tie"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    # the upper bits are the range's number, the lower 33 the place within it
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, total = [], start
    for number in sorted(counts):
        before.append((number, total))
        total += counts[number]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))  # a row per range
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(into))


def number_documents(documents: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """The documents with ``doc_seq``, their place in the order of their sources."""
    columns = documents.columns
    return dense_number(documents.drop("doc_seq"), order_by, "doc_seq").select(*columns)


def ordered_examples(examples: DataFrame, into: str = "seq") -> DataFrame:
    """The examples with ``into``, their place in the order document, task, chunk, in which a sequential run makes them."""
    return dense_number(examples, ["doc_seq", "task_position", "chunk_index"], into)
