"""The corpus pipeline: quality, near duplicates, benchmark decontamination, pseudonyms, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of ``documents``; the last adds what the mix takes of each document. ``run`` writes every stage's rows to the shared
folder and reads them back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import decontamination, mixing, near_dedup, pseudonyms, quality_trees
from inkweave.llm.store import written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
#: A list of rows' numbers this long at most is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000
#: SQL cannot express trees, signatures, keyed permutations and fitted budgets; tests compare with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The documents with a number of their own each, and that column's name, which no column of theirs has.

    They are written, so that a row has the same number for every reader. Verdicts are given by row: a document without
    an id is judged like any other, and rows that share an id are judged each.
    """
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def _without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The documents whose number is not among ``gone(id)``."""
    gone = written(gone.select(F.col("id").alias("left_out")), "left-out")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(gone, keyed[row] == gone["left_out"], "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees, learned from the labels of documents at hand, do not reject.

    A null text is judged as an empty one; without labels of both kinds nothing is rejected by what was not learned
    (see quality_trees.train).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_trees.train(docs, labels, F.lit(True))
    # other columns travel in one, so that theirs may be the names of the score's
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    scored = quality_trees.score(docs.select("doc_id", "text", others), model, also=("text", "others"))
    back = [F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns]
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Every row is a document: of repeated rows one stays, and texts that share an id are compared like any others. A
    document without an id stays only where its group has none with one; of several rows with the least id the first
    that was written stays. Documents without words are no one's duplicates and stay.
    """
    keyed, row = _keyed(docs, "numbered")
    found = written(near_dedup.near_duplicates(keyed, id_col=row, shingle=5, percent=80), "duplicates")
    grouped = found.where("n_shingles > 0").select("id", "component_id")
    # a group of one is left as it is; only the others look for their least id
    several = written(grouped.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id"), "groups")
    members = written(grouped.join(several, "component_id", "left_semi"), "members")
    named = keyed.select(F.col(row).alias("id"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    order = F.struct("unnamed", "doc_id", "id")
    stays = members.join(named, "id").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = stays.select(F.col("first.id").alias("id"))
    return _without(keyed, row, members.join(kept, "id", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item, whether or not they have an id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, row = _keyed(docs, "numbered")
    found = decontamination.find_contamination(keyed, benchmark, id_col=row, window=10)
    return _without(keyed, row, found.where("contaminated"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the new text where the text was changed."""
    found = "found"
    while found.lower() in (c.lower() for c in docs.columns):
        found += "_"
    changed = pseudonyms.pseudonymise(docs, key="inkweave", found_col=found)
    n_chars = F.when(F.size(found) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's size and target, and the words taken."""
    return mixing.mix(docs, weights=(5, 2, 1)).where("mix_taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonymise", pseudonymise),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
