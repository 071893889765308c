"""A stream of documents from a watched directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkweave import schemas
from inkweave.sources.files import FileLoader, suffix_glob


def file_stream(
    spark: SparkSession, directory: str, *, recursive: bool = True, max_files_per_trigger: int = 10_000
) -> DataFrame:
    """New supported files of a directory as they arrive: path, modification time, length, bytes."""
    return (
        spark.readStream.format("binaryFile")
        .schema(schemas.FILE)
        .option("pathGlobFilter", suffix_glob())
        .option("recursiveFileLookup", str(recursive).lower())
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(directory)
    )


def extracted_stream(files: DataFrame, loader: FileLoader | None = None) -> DataFrame:
    """Extracted rows with ``state``: loaded or failed. The transforms are the batch ones, without state."""
    extracted = (loader or FileLoader()).extract(files)
    return extracted.select(
        "path",
        "modificationTime",
        "length",
        "doc_type",
        "body",
        "error_class",
        F.when(F.col("error_class").isNull(), F.lit("loaded")).otherwise(F.lit("failed")).alias("state"),
    )


def stream_documents(
    files: DataFrame,
    output_path: str,
    checkpoint_path: str,
    *,
    loader: FileLoader | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream into a Parquet table with one folder per state, so that loaded documents and
    failures come from one pass over the files. The file sink and the checkpoint give each file once."""
    writer = (
        extracted_stream(files, loader)
        .writeStream.format("parquet")
        .partitionBy("state")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streamed_documents(spark: SparkSession, output_path: str, loader: FileLoader | None = None) -> DataFrame:
    """The documents a stream has written so far, in the standard projection."""
    loaded = spark.read.parquet(output_path).where(F.col("state") == "loaded")
    return (loader or FileLoader()).documents(loaded)
