"""The log of job states: events are only ever appended, and a job's state is the last of its events."""

from __future__ import annotations

import datetime
import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave import schemas

#: States after which nothing more happens to a job.
FINAL_STATES = ("completed", "failed", "cancelled")


def new_run_id() -> str:
    """An id that no other run has."""
    return uuid.uuid4().hex


def _named(kind: str, run_id: str) -> str:
    return hashlib.md5(f"{kind}|{run_id}".encode()).hexdigest()


def job_id(run_id: str) -> str:
    return _named("job", run_id)


def dataset_id(run_id: str) -> str:
    return _named("dataset", run_id)


def _order(events: DataFrame, rest: list[str]) -> Column:
    """Later events are greater; events of one time and number in the order of their content, so that reruns agree."""
    return F.struct(F.col("at"), F.col("seq"), F.to_json(F.struct(*rest)))


def latest_jobs(events: DataFrame) -> DataFrame:
    """One row per job: its last event's columns, when it was created and last changed, and how many events it has.

    An event without a time counts as the earliest. A state outside the domain ends the job that reads it. Events are
    reduced before the shuffle, so a job with very many events never gathers in one task. An event that was written
    twice is one: appending is safe to repeat.
    """
    rest = [c for c in events.columns if c not in ("id", "seq", "at")]
    stated = events.withColumn("status", schemas.checked(F.col("status"), schemas.JOB_STATES, "status"))
    reduced = stated.groupBy("id").agg(
        F.max_by(F.struct(*rest), _order(stated, rest)).alias("last"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    return reduced.select("id", "last.*", "created_at", "updated_at")


def job_events(spark: SparkSession, path: str) -> DataFrame:
    """The log at a path."""
    return spark.read.schema(schemas.JOB_EVENT).parquet(path)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of the log at a path, each in its last state."""
    return schemas.conform(latest_jobs(job_events(spark, path)), schemas.JOB)


@dataclass
class JobLog:
    """Writes what happens to one run: pending, processing, and how it ended. Without a path nothing is written.

    As a context manager it writes ``processing`` on entry, ``completed`` at the end, ``failed`` with the message where
    an error ends the block, and ``cancelled`` where the user interrupts it. The error goes on to the caller.
    """

    spark: SparkSession
    path: str | None
    run_id: str
    job_type: str = "document_processing"
    known: dict = field(default_factory=dict)
    seq: int = 0

    def add(self, status: str, **known) -> None:
        """Append an event: ``status`` and all that is known of the job by now."""
        if status not in schemas.JOB_STATES:
            raise ValueError(f"unknown job state: {status}")
        self.known.update(known)
        if self.path:
            at = datetime.datetime.now(datetime.timezone.utc)
            event = {"id": job_id(self.run_id), "job_type": self.job_type, "status": status, "seq": self.seq, "at": at, **self.known}
            row = tuple(event.get(f.name) for f in schemas.JOB_EVENT.fields)
            self.spark.createDataFrame([row], schemas.JOB_EVENT).coalesce(1).write.mode("append").parquet(self.path)
        self.seq += 1

    def __enter__(self) -> JobLog:
        self.add("processing")
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is None:
            self.add("completed")
        elif isinstance(error, KeyboardInterrupt):
            self.add("cancelled")
        else:
            self.add("failed", error_message=str(error))
        return False
