"""Computing costly columns once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add the columns so that later filters read them instead of computing them again.

    Catalyst moves a filter below a projection by copying the projection's expressions into it, whatever
    they cost. It moves none below a generator that makes the column, so a projection computes the columns,
    sharing common parts, and a one-element ``inline`` hands them on within the same generated code.
    """
    kept = [name for name in rows.columns if name not in columns]
    computed = rows.select(*kept, *[column.alias(f"once:{name}") for name, column in columns.items()])
    entry = F.struct(*[F.col(f"`once:{name}`").alias(name) for name in columns])
    return computed.select(*kept, F.inline(F.array(entry)))
