"""Written intermediate tables in the folder that every executor reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkweave.session import scratch_path


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lost executors cost no second computation."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
