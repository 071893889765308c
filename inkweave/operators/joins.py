"""Equi-joins that stay spread out when a few keys hold most of the rows, and example lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.session import written


def hot_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys that hold more than an even partition's share of the rows, and how many salts each is split into.

    There are fewer of them than shuffle partitions, as their shares add up to the whole, so the list is short
    whatever the input, and a key outside it fits one partition. Rows are counted with a map-side combine.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    share = counted.agg(F.sum("_rows")).scalar() / F.lit(parts)
    return counted.where(F.col("_rows") > share).select(*on, F.ceil(F.col("_rows") / share).cast("int").alias("_salts"))


def hot_key_join(
    left: DataFrame, right: DataFrame, *, on: Sequence[str], salt_on: str | Sequence[str], how: str = "inner", counted_on: DataFrame | None = None
) -> DataFrame:
    """Inner or left join of many rows to few per key, exact also when one key holds a third of the left side.

    Left rows of a hot key get one of its salts by the hash of ``salt_on``, columns that tell rows apart;
    right rows of a hot key are repeated once per salt. The salt is a pure function of the row, so a task
    that runs again after a lost executor sends each row to the same place. Keep the right side narrow. ``counted_on``
    is a frame with the left side's keys that is cheaper to count than the left side itself.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can repeat the right side")
    salt_columns = [salt_on] if isinstance(salt_on, str) else list(salt_on)
    keys = list(on)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys((left if counted_on is None else counted_on).where(_all_set(keys)), keys))
    # A row without a key matches nothing, so it may go anywhere; left together they would fill one task.
    ways = F.when(~_all_set(keys), F.lit(parts)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    spread = F.pmod(F.xxhash64(*salt_columns), ways).cast("int")
    salted = left.join(hot, keys, "left").withColumn("_salt", spread).drop("_salts")
    repeated = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    order = [*left.columns, *[c for c in right.columns if c not in keys]]
    return salted.join(repeated, [*keys, "_salt"], how).select(*order)


def _all_set(keys: Sequence[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def example_lineage(examples: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The lineage of examples: id, task_type, source_document_id and source_chunk_id, the position of their chunk, and
    the title, source and type of their document.

    The ids of the examples are written once, so that neither counting the hot documents nor joining runs the examples'
    own pipeline again. A document may have any number of examples, so that join is salted, and comes first; a chunk has
    one example per template at most, so the chunk join is plain. Only narrow columns are joined.
    """
    narrow = written(examples.select("id", "task_type", "source_document_id", "source_chunk_id"), "lineage")
    positions = chunks.select(
        F.col("id").alias("source_chunk_id"), "chunk_index", "start_index", "end_index"
    )
    origins = documents.select(
        F.col("id").alias("source_document_id"),
        F.col("title").alias("document_title"),
        F.col("source").alias("document_source"),
        "doc_type",
    )
    titled = hot_key_join(narrow, origins, on=["source_document_id"], salt_on="id", how="left")
    return titled.join(positions, "source_chunk_id", "left")
