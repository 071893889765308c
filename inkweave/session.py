"""Session helpers: a local session for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app_name: str = "inkweave") -> SparkSession:
    """A single-JVM session for tests and the bench. On a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session that names none gets a temporary folder of its own; on a cluster a machine-local
    folder would be lost with its executor, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="inkweave-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/inkweave/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> int:
    """Remove the scratch tables that the frames read, when the caller is done with them; how many were removed.

    Only folders that ``written`` has made are touched: those of this library's own part of the shared folder.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/inkweave")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = files.makeQualified(root)
    found = {spark._jvm.org.apache.hadoop.fs.Path(f).getParent().toString() for frame in frames for f in frame.inputFiles()}
    own = [p for p in (spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(found)) if p.getParent() is not None and files.makeQualified(p.getParent()).equals(root)]
    return sum(bool(files.delete(p, True)) for p in own)
