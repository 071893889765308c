"""Entity schemas and the closed value domains of their string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Document types, task types, quality metrics, job states, export formats.
DOCUMENT_TYPES = ("pdf", "docx", "txt", "md", "html", "json", "csv", "url")
TASK_TYPES = (
    "qa_generation",
    "classification",
    "summarization",
    "named_entity_recognition",
    "red_teaming",
    "instruction_response",
)
QUALITY_METRICS = ("toxicity", "bias", "diversity", "coherence", "relevance")
JOB_STATES = ("pending", "processing", "completed", "failed", "cancelled")
EXPORT_FORMATS = ("jsonl", "csv", "parquet", "huggingface", "openai")

# What a processing call runs when it names no task types.
DEFAULT_TASK_TYPES = ("qa_generation", "classification")

FILE_TYPES = tuple(t for t in DOCUMENT_TYPES if t != "url")

_scores = T.MapType(T.StringType(), T.DoubleType())
_texts = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


FILE = _struct(
    path=T.StringType(), modificationTime=T.TimestampType(), length=T.LongType(), content=T.BinaryType()
)

DOCUMENT = _struct(
    id=T.StringType(),
    title=T.StringType(),
    content=T.StringType(),
    source=T.StringType(),
    doc_type=T.StringType(),
    language=T.StringType(),
    encoding=T.StringType(),
    size=T.LongType(),
    word_count=T.LongType(),
    char_count=T.LongType(),
    extraction_method=T.StringType(),
    processing_time=T.DoubleType(),
    metadata=_texts,
    created_at=T.TimestampType(),
    doc_seq=T.LongType(),
)

CHUNK = _struct(
    id=T.StringType(),
    document_id=T.StringType(),
    content=T.StringType(),
    start_index=T.IntegerType(),
    end_index=T.IntegerType(),
    chunk_index=T.IntegerType(),
    token_count=T.IntegerType(),
    preceding_context=T.StringType(),
    following_context=T.StringType(),
    embeddings=T.ArrayType(T.FloatType()),
    topics=T.ArrayType(T.StringType()),
)

TEMPLATE = _struct(
    id=T.StringType(),
    name=T.StringType(),
    task_type=T.StringType(),
    prompt_template=T.StringType(),
    parameters=_texts,
    min_output_length=T.IntegerType(),
    max_output_length=T.IntegerType(),
    quality_thresholds=_scores,
    task_position=T.IntegerType(),
)

EXAMPLE = _struct(
    id=T.StringType(),
    dataset_id=T.StringType(),
    input_text=T.StringType(),
    output_text=T.StringType(),
    task_type=T.StringType(),
    source_document_id=T.StringType(),
    source_chunk_id=T.StringType(),
    template_id=T.StringType(),
    quality_scores=_scores,
    quality_approved=T.BooleanType(),
    instruction=T.StringType(),
    context=T.StringType(),
    category=T.StringType(),
    doc_seq=T.LongType(),
    task_position=T.IntegerType(),
    chunk_index=T.IntegerType(),
)

DATASET = _struct(
    id=T.StringType(),
    name=T.StringType(),
    description=T.StringType(),
    version=T.StringType(),
    total_examples=T.LongType(),
    task_type_counts=T.MapType(T.StringType(), T.LongType()),
    quality_stats=T.MapType(T.StringType(), _scores),
    train_split=T.DoubleType(),
    validation_split=T.DoubleType(),
    test_split=T.DoubleType(),
    export_format=T.StringType(),
    exported_at=T.TimestampType(),
    export_path=T.StringType(),
    created_at=T.TimestampType(),
)

JOB = _struct(
    id=T.StringType(),
    name=T.StringType(),
    job_type=T.StringType(),
    status=T.StringType(),
    total_items=T.LongType(),
    processed_items=T.LongType(),
    failed_items=T.LongType(),
    input_data=_texts,
    output_data=_texts,
    error_message=T.StringType(),
)

# What happened to a job: its row as it was then, the event's number within the run, and when.
JOB_EVENT = T.StructType([*JOB.fields, T.StructField("seq", T.LongType()), T.StructField("at", T.TimestampType())])

LEDGER = _struct(
    dataset_id=T.StringType(),
    export_format=T.StringType(),
    export_path=T.StringType(),
    exported_at=T.TimestampType(),
    exported_rows=T.LongType(),
)

QUARANTINE = _struct(
    source=T.StringType(), stage=T.StringType(), error_class=T.StringType(), message=T.StringType()
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the schema's columns in its order; a column the frame lacks comes out null."""
    return df.to(schema)


def in_domain(column: Column, domain: tuple[str, ...]) -> Column:
    """True where the column holds one of the domain's values (null counts as outside)."""
    return F.coalesce(column.isin(*domain), F.lit(False))


def checked(column: Column, domain: tuple[str, ...], name: str) -> Column:
    """The column, ending the job at a value outside the domain; null passes."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} outside its domain: "), column)).cast("string")
    return F.when(column.isNull() | in_domain(column, domain), column).otherwise(wrong)


def when_zero(given: Column | None, derived: Column) -> Column:
    """The given count, or the derived one where the given is 0 or null."""
    if given is None:
        return derived
    return F.when(F.coalesce(given, F.lit(0)) == 0, derived).otherwise(given)
