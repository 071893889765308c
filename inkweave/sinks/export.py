"""Writing examples as JSONL, CSV, Parquet, a hub-style Parquet layout or chat JSONL, and the export ledger.

Each export is one pass over the examples and writes from the tasks; nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.operators.splits import split_examples

MAX_ROWS_PER_FILE = 1_000_000
# CSV files with quoted line ends cannot be split on reading, so each is kept to a task's size.
MAX_ROWS_PER_CSV_FILE = 100_000
SPLITS = ("train", "validation", "test")

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# An empty text is written as two quotes and a null as nothing; reading, an unquoted nothing becomes this mark, which
# stands for null, and quoted nothing stays empty.
_CSV_WRITE = {**_CSV_OPTIONS, "nullValue": "", "emptyValue": '""'}
_CSV_READ = {**_CSV_OPTIONS, "nullValue": "\x00null", "emptyValue": "", "multiLine": "true"}


def chat_message(role: str, content: Column) -> Column:
    return F.when(
        content.isNotNull(), F.struct(F.lit(role).alias("role"), content.alias("content"))
    )


def chat_json(instruction: Column, context: Column, input_text: Column, output_text: Column) -> Column:
    """``{"messages": [...]}``: instruction and context as the system turn, input as user, output as assistant."""
    system = F.nullif(F.concat_ws("\n\n", instruction, context), F.lit(""))
    turns = F.array(
        chat_message("system", system), chat_message("user", input_text), chat_message("assistant", output_text)
    )
    return F.to_json(F.struct(F.filter(turns, lambda turn: turn.isNotNull()).alias("messages")))


def _flat(examples: DataFrame) -> DataFrame:
    """Maps and arrays as JSON text, for formats without nested values."""
    nested = {
        f.name: F.to_json(F.col(f.name))
        for f in examples.schema.fields
        if f.dataType.typeName() in ("map", "array", "struct")
    }
    return examples.withColumns(nested) if nested else examples


def _dataset_card() -> str:
    lines = ["---", "configs:", "- config_name: default", "  data_files:"]
    for split in SPLITS:
        lines += [f"  - split: {split}", f'    path: "data/split={split}/*.parquet"']
    return "\n".join([*lines, "---", ""])


def _write_text_file(spark: SparkSession, path: str, body: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(location, True)
    try:
        stream.write(bytearray(body, "utf-8"))
    finally:
        stream.close()


def export_dataset(
    examples: DataFrame,
    output_path: str,
    *,
    export_format: str = "jsonl",
    split_data: bool = True,
    dataset_id: str | None = None,
    ledger_path: str | None = None,
    mode: str = "error",
    max_rows_per_file: int | None = None,
    shares: tuple[float, float, float] = (0.8, 0.1, 0.1),
) -> str:
    """Write the examples, record the export in the ledger if one is named, and return the path.

    With ``split_data`` the files lie in one folder per split (``split=train/...``). Existing output is
    left alone and raises, unless ``mode`` says otherwise.
    """
    if export_format not in schemas.EXPORT_FORMATS:
        raise ValueError(f"unknown export format: {export_format}")
    spark = examples.sparkSession
    counted = Observation()
    rows = examples.observe(counted, F.count(F.lit(1)).alias("rows"))
    if split_data:
        rows = split_examples(rows, *shares)
    splits = ["split"] if split_data else []

    if export_format == "openai":
        line = chat_json(F.col("instruction"), F.col("context"), F.col("input_text"), F.col("output_text"))
        rows = rows.select(line.alias("value"), *splits)
    elif export_format == "csv":
        rows = _flat(rows)

    most = max_rows_per_file or (MAX_ROWS_PER_CSV_FILE if export_format == "csv" else MAX_ROWS_PER_FILE)
    writer = rows.write.mode(mode).option("maxRecordsPerFile", most)
    if splits:
        writer = writer.partitionBy(*splits)
    if export_format == "jsonl":
        writer.option("ignoreNullFields", "false").json(output_path)
    elif export_format == "csv":
        writer.options(**_CSV_WRITE).csv(output_path)
    elif export_format == "parquet":
        writer.parquet(output_path)
    elif export_format == "huggingface":
        writer.parquet(f"{output_path}/data")
        if splits:
            _write_text_file(spark, f"{output_path}/README.md", _dataset_card())
    else:
        writer.text(output_path)

    if ledger_path:
        append_ledger(spark, ledger_path, dataset_id, export_format, output_path, counted.get["rows"])
    return output_path


def append_ledger(
    spark: SparkSession, ledger_path: str, dataset_id: str | None, export_format: str, path: str, rows: int
) -> None:
    """Add the export's one row to the ledger table."""
    entry = spark.range(1).select(
        F.lit(dataset_id).cast("string").alias("dataset_id"),
        F.lit(export_format).alias("export_format"),
        F.lit(path).alias("export_path"),
        F.current_timestamp().alias("exported_at"),
        F.lit(rows).cast("bigint").alias("exported_rows"),
    )
    schemas.conform(entry, schemas.LEDGER).coalesce(1).write.mode("append").parquet(ledger_path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """An exported JSONL dataset with its declared types."""
    schema = schemas.EXAMPLE
    return spark.read.schema(schema).json(path) if not _has_splits(spark, path) else spark.read.schema(
        f"{schema.toDDL()}, split string"
    ).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV dataset. Quoted line ends need whole-file reading, so files are kept bounded."""
    columns = ", ".join(
        f"{f.name} {'boolean' if f.dataType.typeName() == 'boolean' else 'string'}" for f in schemas.EXAMPLE.fields
    )
    split = ", split string" if _has_splits(spark, path) else ""
    return spark.read.options(**_CSV_READ).schema(columns + split).csv(path)


def _has_splits(spark: SparkSession, path: str) -> bool:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/split=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(files.globStatus(pattern)) > 0
