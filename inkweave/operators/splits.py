"""Repeatable train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 2**32


def split_hash(key: Column) -> Column:
    """32 bits of the key's hash as a number: the same on every run and every cluster."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def split_name(key: Column, train: float = 0.8, validation: float = 0.1, test: float = 0.1) -> Column:
    """The split whose range of hashes holds the key's. A share above 0 has a range, however small it is."""
    if min(train, validation, test) < 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("split shares must not be negative and must add up to 1")
    last = HASHES - (max(1, round(test * HASHES)) if test > 0 else 0)
    middle = last - (max(1, round(validation * HASHES)) if validation > 0 else 0)
    number = split_hash(key)
    return F.when(number < middle, "train").when(number < last, "validation").otherwise("test")


def split_examples(
    examples: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, key: str = "id"
) -> DataFrame:
    """Add ``split``. A narrow projection: nothing is shuffled or sampled."""
    return examples.withColumn("split", split_name(F.col(key), train, validation, test))
