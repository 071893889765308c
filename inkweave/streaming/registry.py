"""A registry of documents that a stream keeps up to date: each batch is written once, however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkweave import schemas
from inkweave.sources.documents import document_registry
from inkweave.sources.files import FileLoader
from inkweave.streaming.documents import extracted_stream


def upsert_batch(documents: DataFrame, batch_id: int, registry_path: str, order_by: str = "created_at") -> None:
    """Write what a batch makes of its documents, one row per id, into the batch's own folder of the registry.

    The folder is overwritten, so a batch that is replayed after a failure leaves what it left before.
    """
    reduced = document_registry(documents, order_by)
    reduced.write.mode("overwrite").parquet(f"{registry_path}/batch_id={batch_id}")


def registered(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry as it stands: of each id the document of the latest batch that wrote it."""
    schema = T.StructType([*schemas.DOCUMENT.fields, T.StructField("batch_id", T.LongType())])
    log = spark.read.schema(schema).option("basePath", registry_path).parquet(registry_path)
    return document_registry(log, order_by="batch_id").drop("batch_id")


def stream_registry(
    files: DataFrame,
    registry_path: str,
    checkpoint_path: str,
    *,
    loader: FileLoader | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep a registry of the documents of a stream of files (see ``streaming.documents.file_stream``).

    Later batches win over earlier ones, as later loads do in a batch registry. The batch's number comes with the
    checkpoint, which belongs to this registry alone. Documents are made in the stream's own plan, which is analysed once
    and not with every batch; they are dated by their batch, so that one that is replayed has its dates again.
    """
    reader = loader or FileLoader()
    documents = reader.documents(extracted_stream(files, reader).where(F.col("state") == "loaded"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, registry_path)

    writer = documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
