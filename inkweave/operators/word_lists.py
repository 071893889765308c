"""Shares of listed words, the list being a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of so many words at most is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_WORDS = 200_000


def listed_share(rows: DataFrame, listed: DataFrame, *, key: str, tokens: str = "tokens", word: str = "word", into: str = "score") -> DataFrame:
    """(key, into): the share of each row's ``tokens`` that the list holds, compared in lower case; null without tokens.

    Rows with one key are taken together. The distinct words of a row meet the list by a semi join, of which the list is
    the small side as long as it is counted to be; occurrences are counted per row and word before, so a word that is in
    every row is one entry of each. Null and repeated words of the list change nothing.
    """
    wanted = listed.select(F.lower(F.col(word)).alias("_word")).where("_word is not null").distinct()
    small = wanted.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    said = rows.select(F.col(key), F.explode(F.col(tokens)).alias("_word"))
    counted = said.select(key, F.lower("_word").alias("_word")).groupBy(key, "_word").agg(F.count(F.lit(1)).alias("_n"))
    met = counted.join(F.broadcast(wanted) if small else wanted, "_word", "left_semi")
    hits = met.groupBy(key).agg(F.sum("_n").alias("_hits"))
    sizes = rows.groupBy(key).agg(F.sum(F.size(F.coalesce(F.col(tokens), F.array().cast("array<string>")))).alias("_all"))
    found = sizes.join(hits, sizes[key].eqNullSafe(hits[key]), "left").select(sizes[key], "_all", F.coalesce("_hits", F.lit(0)).alias("_hits"))
    return found.select(key, F.try_divide(F.col("_hits").cast("double"), F.col("_all").cast("double")).alias(into))
