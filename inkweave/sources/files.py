"""File scans: directory listing, decoding, per-type text extraction, good rows and quarantined rows."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkweave import schemas
from inkweave.functions import linearize, text, urls
from inkweave.functions.html import with_html_text
from inkweave.operators.staging import compute_once
from inkweave.session import scratch_path
from inkweave.sources.documents import make_documents

# How each file type's documents name the way they were read.
EXTRACTION_METHODS = {
    "txt": "DocumentLoader.txt",
    "md": "DocumentLoader.md",
    "html": "DocumentLoader.html",
    "json": "DocumentLoader.json",
    "csv": "DocumentLoader.csv",
    "docx": "DocumentLoader.docx",
    "pdf": "PDFLoader.pymupdf4llm",
}

def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def suffix_glob(types: Iterable[str] = schemas.FILE_TYPES) -> str:
    """File name glob of the supported suffixes in any case; files it drops are never opened."""
    return "*.{" + ",".join(_any_case(t) for t in types) + "}"


def scan_directory(
    spark: SparkSession,
    directory: str | list[str],
    *,
    recursive: bool = True,
    exclude_name_contains: Iterable[str] = (),
    types: Iterable[str] = schemas.FILE_TYPES,
) -> DataFrame:
    """Path, modification time, length and bytes of the supported files in a directory.

    Suffixes are matched by the listing and names by ``_metadata``, both before a file is opened.
    A missing directory is an error; one without supported files gives an empty frame.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", suffix_glob(types))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(directory)
    )
    for part in exclude_name_contains:
        found = found.where(~F.contains(F.col("_metadata.file_name"), F.lit(part)))
    return found.select("path", "modificationTime", "length", "content")


def _decoder(encoding: str):
    codecs.lookup(encoding)

    def decode_one(body):
        try:
            return None if body is None else bytes(body).decode(encoding)
        except UnicodeDecodeError:
            return None

    @F.pandas_udf(StringType())
    def decode_all(bodies: pd.Series) -> pd.Series:
        return bodies.map(decode_one)

    return decode_all


def decode_strict(body: Column, encoding: str = "utf-8") -> Column:
    """The text of the bytes, or null where they are malformed in the encoding."""
    name = codecs.lookup(encoding).name
    if name == "utf-8":
        return F.try_validate_utf8(body.cast("string"))
    if name == "iso8859-1":
        return F.decode(body, "ISO-8859-1")
    return _decoder(encoding)(body)


@dataclass
class LoadedFiles:
    """``documents`` that were read, and the ``quarantine`` rows (source, stage, error class, message).

    ``counted`` has the numbers of both where the files were read once and written (see ``FileLoader.load_once``).
    """

    documents: DataFrame
    quarantine: DataFrame
    counted: tuple[int, int] | None = None

    def report(self) -> DataFrame:
        """One row: how many were loaded and how many were lost."""
        if self.counted is not None:
            return self.documents.sparkSession.createDataFrame([self.counted], "loaded long, failed long")
        loaded = self.documents.agg(F.count(F.lit(1)).alias("loaded"))
        return loaded.withColumn("failed", self.quarantine.agg(F.count(F.lit(1))).scalar())


@dataclass
class FileLoader:
    """Turns scanned files into documents.

    ``parsers`` maps further file types (pdf, docx) to an expression over the raw bytes, which may be a
    pandas UDF; a parser gives null where it cannot read a file.
    """

    encoding: str = "utf-8"
    parsers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    html_mode: str = "auto"
    json_mode: str = "auto"

    def extract(self, files: DataFrame, types: Iterable[str] = schemas.FILE_TYPES) -> DataFrame:
        """Add doc_type, body (the extracted text) and error_class, null where all is well.

        ``types`` are the file types that may turn up; without a type its reader is left out of the plan.
        """
        kind, path = F.col("doc_type"), F.col("path")
        decoded = decode_strict(F.col("content"), self.encoding)
        rows = compute_once(files, {"doc_type": urls.document_type(path), "decoded": decoded})
        rows = rows.withColumn("plain", text.universal_newlines(F.col("decoded")))
        readers = {t: F.col("plain") for t in ("txt", "md") if t in types}
        if "html" in types:
            rows = rows.withColumn("_page", F.when(kind == "html", F.col("plain")))
            rows = with_html_text(rows, "_page", "_html", self.html_mode)
            readers["html"] = F.col("_html")
        if "json" in types:
            rows = rows.withColumn("_body", F.when(kind == "json", F.col("plain")))
            rows = linearize.with_json_text(rows, "_body", "_json", self.json_mode)
            readers["json"] = F.col("_json")
        if "csv" in types:
            readers["csv"] = linearize.csv_text(F.when(kind == "csv", F.col("decoded")))
        parsed = {t: parse(F.when(kind == t, F.col("content"))) for t, parse in self.parsers.items()}
        body = F.lit(None).cast("string")
        for name, column in {**readers, **parsed}.items():
            body = F.when(kind == name, column).otherwise(body)
        needs_text = kind.isin(*[t for t in readers if t not in parsed])
        known = [*readers, *parsed]
        made = compute_once(rows, {"body": body}).withColumn(
            "error_class",
            F.when(kind.isNull() | (kind == "url"), F.lit("unsupported_format"))
            .when(~kind.isin(*known), F.lit("parser_missing"))
            .when(needs_text & F.col("decoded").isNull(), F.lit("malformed_encoding"))
            .when(F.col("body").isNull(), F.concat(F.lit("malformed_"), kind)),
        )
        return made.select(*files.columns, "doc_type", "body", "error_class")

    def load(
        self, files: DataFrame, mode: str = "permissive", types: Iterable[str] = schemas.FILE_TYPES
    ) -> LoadedFiles:
        """Permissive: unreadable files go to quarantine. Failfast: the first of them ends the job."""
        extracted = self.extract(files, types)
        if mode == "failfast":
            failure = F.concat(F.lit("failed to load "), F.col("path"), F.lit(": "), F.col("error_class"))
            checked = F.when(F.col("error_class").isNull(), F.col("body")).otherwise(
                F.raise_error(failure).cast("string")
            )
            extracted = extracted.withColumn("body", checked)
            good = extracted
        elif mode == "permissive":
            good = extracted.where(F.col("error_class").isNull())
        else:
            raise ValueError(f"unknown mode: {mode}")
        return LoadedFiles(self.documents(good), quarantine_rows(extracted))

    def load_once(self, files: DataFrame, types: Iterable[str] = schemas.FILE_TYPES) -> LoadedFiles:
        """As ``load`` permissively, in one pass: what was read and what was lost is written to the shared folder, a
        folder for each, and counted while it is written. The raw bytes are not kept."""
        counted, bad = Observation(), F.col("error_class").isNotNull()
        extracted = self.extract(files, types).drop("content").withColumn("state", F.when(bad, F.lit("failed")).otherwise(F.lit("loaded")))
        seen = extracted.observe(counted, F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("failed"))
        path = scratch_path(files.sparkSession, "loaded")
        seen.write.partitionBy("state").parquet(path)
        read = files.sparkSession.read.schema(extracted.schema).parquet(path)
        totals = counted.get
        documents = self.documents(read.where(F.col("state") == "loaded").drop("state"))
        return LoadedFiles(documents, quarantine_rows(read.where(F.col("state") == "failed")), (totals["loaded"], totals["failed"]))

    def outcomes(self, files: DataFrame, types: Iterable[str] = schemas.FILE_TYPES) -> DataFrame:
        """Every file once: source, state (loaded or failed), error_class, and the text. One pass for good and bad."""
        bad = F.col("error_class").isNotNull()
        return self.extract(files, types).select(
            F.col("path").alias("source"),
            F.when(bad, F.lit("failed")).otherwise(F.lit("loaded")).alias("state"),
            "error_class",
            F.when(~bad, F.col("body")).alias("content"),
        )

    def documents(self, extracted: DataFrame) -> DataFrame:
        """The standard projection of extracted rows."""
        methods = F.create_map(*[F.lit(x) for pair in EXTRACTION_METHODS.items() for x in pair])
        return make_documents(
            extracted,
            content=F.col("body"),
            source=F.col("path"),
            title=urls.file_stem(F.col("path")),
            doc_type=F.col("doc_type"),
            encoding=F.lit(self.encoding),
            extraction_method=F.element_at(methods, F.col("doc_type")),
            size_on_disk=F.col("length"),
            modified_time=F.col("modificationTime"),
        )


def quarantine_rows(extracted: DataFrame) -> DataFrame:
    bad = extracted.where(F.col("error_class").isNotNull())
    return bad.select(
        F.col("path").alias("source"),
        F.when(F.col("error_class").isin("unsupported_format", "parser_missing"), F.lit("route"))
        .otherwise(F.lit("extract"))
        .alias("stage"),
        "error_class",
        F.concat(F.lit("cannot load "), F.col("path")).alias("message"),
    )


def too_long(files: DataFrame) -> DataFrame:
    """Quarantine rows of files that are longer than a cell can be."""
    return files.select(
        F.col("path").alias("source"),
        F.lit("extract").alias("stage"),
        F.lit("file_too_long").alias("error_class"),
        F.concat(F.lit("cannot load "), F.col("path")).alias("message"),
    )


def scan_text(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """One document per plain-text or Markdown file; both keep their markup."""
    texts = files.where(urls.file_suffix(F.col("path")).isin("txt", "md"))
    return FileLoader(encoding=encoding).load(texts, types=("txt", "md")).documents


def extraction_fallback(primary: Column, fallback: Column, minimum: int = 50) -> tuple[Column, Column]:
    """Text and tier: the fallback, even an empty one, where the stripped primary text is below the minimum."""
    thin = F.coalesce(F.char_length(text.strip(primary)) < minimum, F.lit(True))
    chosen = F.when(thin, F.coalesce(fallback, F.lit(""))).otherwise(primary)
    return chosen, F.when(thin, F.lit("fallback")).otherwise(F.lit("primary"))
