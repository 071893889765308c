"""Documents to a dataset of examples, and the whole way from sources to an export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents, clean_documents
from inkweave.operators.jobs import JobLog, dataset_id, job_id, new_run_id
from inkweave.operators.quality import PREPARED, Evaluator, moments_map, quality_gate
from inkweave.operators.tasks import (
    RUNNER_CARRY,
    TaskRunner,
    TaskTemplate,
    example_items,
    execute_tasks,
    templates_for,
)
from inkweave.session import written
from inkweave.sinks.export import export_dataset
from inkweave.sources.documents import filter_doc_types
from inkweave.sources.files import FileLoader
from inkweave.sources.load import load_sources

# The names of a dataset, its description, and a job's name.
DATASET_NAME, DATASET_DESCRIPTION, JOB_NAME = "Generated Dataset %d", "Dataset generated from %d document", "Process %d documents"


class NoDocumentsError(Exception):
    """There is nothing to process."""


@dataclass
class ProcessedRun:
    """The frames of one run. All are lazy unless it was materialized; then they read one written table, and
    ``totals`` has what was counted while it was written."""

    run_id: str
    name: str
    task_types: list[str]
    quality_filter: bool
    documents: DataFrame
    chunks: DataFrame
    results: DataFrame
    items: DataFrame
    examples: DataFrame
    rejected: DataFrame
    metrics: tuple[str, ...] = schemas.QUALITY_METRICS
    totals: dict | None = None

    @property
    def dataset_id(self) -> str:
        return dataset_id(self.run_id)

    @property
    def job_id(self) -> str:
        return job_id(self.run_id)

    def counts(self) -> DataFrame:
        """One row: documents, items by outcome, and kept examples by task type."""
        if self.totals is not None:
            made = ", ".join(f"made_{i} long" for i in range(len(self.task_types)))
            schema = f"documents long, total_items long, processed_items long, failed_items long, {made}"
            names = [f.split()[0] for f in schema.split(", ")]
            return self.items.sparkSession.createDataFrame([tuple(self.totals[n] for n in names)], schema)
        counted = self.items.agg(*_item_counts(self.task_types))
        return counted.withColumn("documents", self.documents.agg(F.count(F.lit(1))).scalar())

    def _made(self) -> Column:
        """Task type -> kept examples, without the types that have none."""
        types = {}
        for i, t in enumerate(self.task_types):  # several templates may share a type
            types[t] = types[t] + F.col(f"made_{i}") if t in types else F.col(f"made_{i}")
        counts = F.map_from_arrays(F.array(*[F.lit(t) for t in types]), F.array(*types.values()))
        return F.map_filter(counts, lambda _, n: n > 0)

    def dataset(self, export_format: str | None = None, export_path: str | None = None) -> DataFrame:
        """The dataset's row; with where and how it was exported, if it was."""
        made = F.map_values("task_type_counts")
        counted = self.counts().withColumn("task_type_counts", self._made())
        named = counted.select(
            F.lit(self.dataset_id).alias("id"),
            F.lit(self.name).alias("name"),
            F.format_string(DATASET_DESCRIPTION, F.col("documents")).alias("description"),
            F.lit("1.0.0").alias("version"),
            F.aggregate(made, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("total_examples"),
            "task_type_counts",
            self.items.agg(moments_map(F.col("quality_scores"), self.metrics, F.col("kept"))).scalar().alias("quality_stats"),
            F.lit(0.8).alias("train_split"),
            F.lit(0.1).alias("validation_split"),
            F.lit(0.1).alias("test_split"),
            F.lit(export_format).cast("string").alias("export_format"),
            F.lit(export_path).cast("string").alias("export_path"),
            (F.current_timestamp() if export_path else F.lit(None).cast("timestamp")).alias("exported_at"),
            F.current_timestamp().alias("created_at"),
        )
        return schemas.conform(named, schemas.DATASET)

    def job(self, status: str = "completed") -> DataFrame:
        """The job's row: items in all, processed and failed. A rejected example still counts as processed."""
        made = F.aggregate(F.map_values(self._made()), F.lit(0).cast("bigint"), lambda total, n: total + n)
        gate = F.lit(str(self.quality_filter).lower())
        named = self.counts().select(
            F.lit(self.job_id).alias("id"),
            F.format_string(JOB_NAME, F.col("documents")).alias("name"),
            F.lit("document_processing").alias("job_type"),
            schemas.checked(F.lit(status), schemas.JOB_STATES, "status").alias("status"),
            "total_items",
            "processed_items",
            "failed_items",
            F.create_map(
                F.lit("document_count"), F.col("documents").cast("string"),
                F.lit("task_types"), F.lit(",".join(self.task_types)),
                F.lit("quality_filter"), gate,
            ).alias("input_data"),
            F.create_map(
                F.lit("dataset_id"), F.lit(self.dataset_id),
                F.lit("examples_generated"), made.cast("string"),
                F.lit("quality_filtered"), gate,
            ).alias("output_data"),
        )
        return schemas.conform(named, schemas.JOB)


def _item_counts(task_types: Sequence[str]) -> list[Column]:
    status, task = F.col("status"), F.col("task_position")
    return [
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(status == "completed").alias("processed_items"),
        F.count_if(status == "failed").alias("failed_items"),
        *[F.count_if(F.col("kept") & (task == i)).alias(f"made_{i}") for i in range(len(task_types))],
    ]


def process_documents(
    documents: DataFrame,
    task_types: Sequence[str] | None = None,
    *,
    quality_filter: bool = True,
    templates: Sequence[TaskTemplate] | None = None,
    runners: Mapping[str, TaskRunner] | None = None,
    evaluator: Evaluator | None = None,
    name: str | None = None,
    run_id: str | None = None,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    price_per_token: float | None = None,
    materialize: bool | None = None,
    jobs_path: str | None = None,
    datasets_path: str | None = None,
) -> ProcessedRun:
    """Clean, chunk, cross with tasks, execute, build examples, and gate them.

    From the documents to the gate there is no shuffle: all of it runs in the scan stage. With ``materialize`` that
    stage is written once to the shared folder, and results, examples, rejects and the rows of job and dataset are read
    from there; documents and items are counted while it is written. Runs with Python runners always are, so that
    counting does not call the runner again and a lost executor cannot change results, and so are recorded runs.

    ``jobs_path`` names the log that the states of this run are appended to (see operators.jobs), ``datasets_path`` the
    table of datasets. Job and dataset are named by ``run_id``, drawn anew for each run unless it is given; the dataset
    is the next one of the table unless it has a ``name``.
    """
    settings = {k: v for k, v in locals().items() if k not in ("documents", "task_types", "jobs_path", "datasets_path", "run_id", "name")}
    log = JobLog(documents.sparkSession, jobs_path, run_id or new_run_id())
    log.add("pending")
    with log:
        run = _processed(documents, task_types, log=log, name=name or next_dataset_name(documents.sparkSession, datasets_path), recorded=bool(jobs_path or datasets_path), **settings)
        if datasets_path:
            _append(run.dataset(), datasets_path)
    return run


def next_dataset_name(spark: SparkSession, datasets_path: str | None) -> str:
    """``Generated Dataset n``, n being one more than the datasets of the table; 1 without a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(datasets_path) if datasets_path else None
    there = path is not None and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return DATASET_NAME % ((spark.read.schema(schemas.DATASET).parquet(datasets_path).select("id").distinct().count() if there else 0) + 1)


def _append(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)


def _processed(
    documents: DataFrame,
    task_types: Sequence[str] | None,
    *,
    log: JobLog,
    name: str,
    recorded: bool,
    quality_filter: bool,
    templates: Sequence[TaskTemplate] | None,
    runners: Mapping[str, TaskRunner] | None,
    evaluator: Evaluator | None,
    chunk_size: int,
    chunk_overlap: int,
    price_per_token: float | None,
    materialize: bool | None,
) -> ProcessedRun:
    chosen = list(templates) if templates is not None else templates_for(task_types)
    types = [t.task_type for t in chosen]
    if materialize is None:
        materialize = recorded or any(r.python for r in (runners or {}).values())
    if not materialize and documents.isEmpty():
        raise NoDocumentsError("no documents to process")
    seen, counted = Observation(), Observation()
    read = documents.observe(seen, F.count(F.lit(1)).alias("documents")) if materialize else documents
    chunks = chunk_documents(clean_documents(read), size=chunk_size, overlap=chunk_overlap, context=0, carry=RUNNER_CARRY)
    prepared = PREPARED if quality_filter else {}
    results = execute_tasks(chunks, chosen, runners, price_per_token=price_per_token, prepared=prepared)

    judge = evaluator or Evaluator(templates=chosen)
    # one row per item: the result as it was reported, and the verdict on its example
    wide = results.withColumns({"output_text": F.col("output"), "reported_scores": F.col("quality_scores")})
    if quality_filter:
        wide = judge.evaluate(wide)
    done = F.col("status") == "completed"
    wide = wide.withColumn("kept", done & (F.col("passed") if quality_filter else F.lit(True)))
    totals = None
    if materialize:
        wide = written(wide.observe(counted, *_item_counts(types)), "items")
        totals = {**seen.get, **counted.get}
        if not totals["documents"]:
            raise NoDocumentsError("no documents to process")
    verdict = ["passed", "reasons"] if quality_filter else []
    items = example_items(wide, dataset_id=F.lit(dataset_id(log.run_id)), keep=(*verdict, "kept"))
    kept, rejected = quality_gate(items.where(done).drop("kept"), quality_filter)
    run = ProcessedRun(
        run_id=log.run_id,
        name=name,
        task_types=types,
        quality_filter=quality_filter,
        documents=documents,
        chunks=chunks,
        results=wide.withColumn("quality_scores", F.col("reported_scores")).select(*[c for c in results.columns if c not in prepared]),
        items=items,
        examples=schemas.conform(kept, schemas.EXAMPLE),
        rejected=rejected,
        metrics=(*schemas.QUALITY_METRICS, *judge.extra),
        totals=totals,
    )
    if log.path:
        row = run.job("processing").first()
        log.known.update({k: row[k] for k in ("name", "total_items", "processed_items", "failed_items", "input_data", "output_data")})
    return run


def quick_process(
    spark: SparkSession,
    sources: str | list[str] | DataFrame,
    output_path: str,
    task_types: Sequence[str] | None = None,
    *,
    export_format: str = "jsonl",
    pages: DataFrame | None = None,
    loader: FileLoader | None = None,
    ledger_path: str | None = None,
    quarantine_path: str | None = None,
    jobs_path: str | None = None,
    datasets_path: str | None = None,
    doc_types: list[str] | None = None,
    recursive: bool = True,
    exclude_name_contains: tuple[str, ...] = (),
    split_data: bool = True,
    run_id: str | None = None,
    name: str | None = None,
    **options,
) -> ProcessedRun:
    """Load, process and export in one call. ``sources`` are paths and addresses, or a frame of documents.

    Files that could not be loaded are appended to the table at ``quarantine_path``, if one is named. The items are
    written once, so export, job and dataset do not run the pipeline again. The job is completed, and the dataset's row
    written, when the export is done; where loading, processing or the export fails, the job has failed.
    """
    log = JobLog(spark, jobs_path, run_id or new_run_id())
    log.add("pending")
    with log:
        if isinstance(sources, DataFrame):
            documents = filter_doc_types(sources, doc_types)
        else:
            loaded = load_sources(
                spark, sources, pages=pages, loader=loader, doc_types=doc_types, recursive=recursive,
                exclude_name_contains=exclude_name_contains, once=bool(quarantine_path),
            )
            documents = loaded.documents
            if quarantine_path:
                loaded.quarantine.write.mode("append").parquet(quarantine_path)
        settings = {**_DEFAULTS, "materialize": True, **options}
        run = _processed(documents, task_types, log=log, name=name or next_dataset_name(spark, datasets_path), recorded=bool(jobs_path or datasets_path), **settings)
        export_dataset(
            run.examples,
            output_path,
            export_format=export_format,
            split_data=split_data,
            dataset_id=run.dataset_id,
            ledger_path=ledger_path,
        )
        if datasets_path:
            _append(run.dataset(export_format, output_path), datasets_path)
    return run


_DEFAULTS = {
    "quality_filter": True, "templates": None, "runners": None, "evaluator": None, "chunk_size": CHUNK_SIZE,
    "chunk_overlap": CHUNK_OVERLAP, "price_per_token": None,
}
