"""Statistics of documents, examples, jobs and datasets. Every one is an aggregate with a map-side combine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.operators.quality import moments_map

ALL = "all"


def document_statistics(documents: DataFrame) -> DataFrame:
    """Documents and bytes per type, with a total row, in one pass."""
    per_type = documents.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"))
    # The roll-up runs on the few per-type rows rather than on every document twice.
    return (
        per_type.rollup("doc_type")
        .agg(
            F.sum("documents").alias("documents"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size"),
            F.grouping("doc_type").alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, F.lit(ALL)).otherwise(F.col("doc_type")).alias("doc_type"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            "total_size",
        )
    )


def example_counts(examples: DataFrame) -> DataFrame:
    """Examples per dataset, task type and approval: the small table the example statistics start from."""
    return examples.groupBy("dataset_id", "task_type", "quality_approved").agg(F.count(F.lit(1)).alias("examples"))


def example_statistics(counts: DataFrame) -> DataFrame:
    """Examples and datasets per task type, with a total row; from ``example_counts``."""
    per_type = counts.rollup("task_type").agg(
        F.sum("examples").alias("examples"),
        F.countDistinct("dataset_id").alias("datasets"),
        F.grouping("task_type").alias("_total"),
    )
    return per_type.select(
        F.when(F.col("_total") == 1, F.lit(ALL)).otherwise(F.col("task_type")).alias("task_type"),
        F.coalesce("examples", F.lit(0)).alias("examples"),
        "datasets",
    )


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs per status with a total row, and how many of them are active."""
    per_status = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))
    return (
        per_status.rollup("status")
        .agg(
            F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"),
            F.coalesce(F.sum(F.when(F.col("status") == "processing", F.col("jobs"))), F.lit(0)).alias("active"),
            F.grouping("status").alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, F.lit(ALL)).otherwise(F.col("status")).alias("status"), "jobs", "active"
        )
    )


def quality_statistics(counts: DataFrame) -> DataFrame:
    """Approved and all examples; an example without a verdict is not approved. From ``example_counts``."""
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("quality_approved"), F.col("examples"))), F.lit(0)).alias("approved_examples"),
        F.coalesce(F.sum("examples"), F.lit(0)).alias("total_examples"),
    )


def dataset_summary(
    examples: DataFrame, name_prefix: str = "Generated Dataset", exports: DataFrame | None = None, metrics: Sequence[str] = schemas.QUALITY_METRICS
) -> DataFrame:
    """One row per dataset: its number of examples, the counts per task type and the statistics of every metric.

    One aggregate, whose state is a few numbers per dataset whatever its size. ``exports`` (the ledger) adds the last
    export of each dataset; of exports at one time the one with the greatest path. Datasets that were never exported
    have none.
    """
    counts = F.map_from_arrays(
        F.array(*[F.lit(t) for t in schemas.TASK_TYPES]), F.array(*[F.count_if(F.col("task_type") == t) for t in schemas.TASK_TYPES])
    )
    rows = examples if "quality_scores" in examples.columns else examples.withColumn("quality_scores", F.create_map().cast("map<string,double>"))
    per_dataset = rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.map_filter(counts, lambda _, n: n > 0).alias("task_type_counts"),
        moments_map(F.col("quality_scores"), metrics).alias("quality_stats"),
    )
    if exports is not None:
        order = F.struct("exported_at", "export_path", "export_format")
        last = exports.groupBy("dataset_id").agg(F.max(order).alias("export"))
        per_dataset = per_dataset.join(last, "dataset_id", "left").select("*", "export.*").drop("export")
    named = per_dataset.select(
        F.col("dataset_id").alias("id"),
        F.concat_ws(" ", F.lit(name_prefix), F.col("dataset_id")).alias("name"),
        F.lit("1.0.0").alias("version"),
        F.lit(0.8).alias("train_split"),
        F.lit(0.1).alias("validation_split"),
        F.lit(0.1).alias("test_split"),
        *[c for c in per_dataset.columns if c != "dataset_id"],
    )
    return schemas.conform(named, schemas.DATASET)


def _sections(rows: DataFrame, *entries) -> DataFrame:
    """(section, key, value) rows of a small table: each of its rows gives the entries whose condition holds."""
    made = [
        F.when(holds, F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("bigint").alias("value")))
        for section, key, value, holds in entries
    ]
    return rows.select(F.inline(F.filter(F.array(*made), lambda entry: entry.isNotNull())))


def statistics_report(documents: DataFrame, examples: DataFrame, jobs: DataFrame) -> DataFrame:
    """All statistics as (section, key, value). Each entity is aggregated once, and its sections come from that row set."""
    total, always = F.lit("total"), F.lit(True)

    def key(column: str, prefix: str, of_all: str) -> tuple:
        is_all = F.col(column) == ALL
        return F.when(is_all, F.lit(of_all)).otherwise(F.concat(F.lit(prefix), F.col(column))), is_all

    by_type, all_types = key("doc_type", "type:", "total")
    by_task, all_tasks = key("task_type", "task:", "total_examples")
    by_status, all_states = key("status", "status:", "total")
    counts = example_counts(examples)
    approved = F.sum(F.when(F.col("quality_approved"), F.col("examples")))
    tasks = counts.rollup("task_type").agg(
        F.coalesce(F.sum("examples"), F.lit(0)).alias("examples"),
        F.countDistinct("dataset_id").alias("datasets"),
        F.coalesce(approved, F.lit(0)).alias("approved"),
        F.grouping("task_type").alias("_total"),
    )
    tasks = tasks.withColumn("task_type", F.when(F.col("_total") == 1, F.lit(ALL)).otherwise(F.col("task_type")))
    sections = [
        _sections(
            document_statistics(documents),
            ("documents", by_type, F.col("documents"), always),
            ("documents", F.lit("total_size"), F.col("total_size"), all_types),
        ),
        _sections(
            tasks,
            ("datasets", by_task, F.col("examples"), always),
            ("datasets", total, F.col("datasets"), all_tasks),
            ("quality", F.lit("approved_examples"), F.col("approved"), all_tasks),
            ("quality", F.lit("total_examples"), F.col("examples"), all_tasks),
        ),
        _sections(
            job_statistics(jobs),
            ("jobs", by_status, F.col("jobs"), always),
            ("jobs", F.lit("active"), F.col("active"), all_states),
        ),
    ]
    return reduce(DataFrame.unionByName, sections)


def statistics_json(report: DataFrame) -> DataFrame:
    """The report as one nested JSON text; it has only as many rows as there are types and states."""
    per_section = report.groupBy("section").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values")
    )
    sections = [
        F.first(F.when(F.col("section") == name, F.col("values")), ignorenulls=True).alias(name)
        for name in ("documents", "datasets", "jobs", "quality")
    ]
    return per_section.agg(*sections).select(F.to_json(F.struct("*")).alias("statistics"))
