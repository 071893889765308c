"""JSON and CSV bodies as readable text lines."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkweave.operators.staging import compute_once

# One flat object without escapes, nested values, or any number but a plain integer.
_FLAT_OBJECT = r"^[ \t\n\r]*\{[^{}\[\]\\]*\}[ \t\n\r]*$"
_OTHER_VALUE = r":\s*(?:[tfnNI]|-[I0]|-?\d+[.eE])"


# How lines of JSON and CSV bodies read.
_ITEM, _HEADERS, _ROW = "Item ", "Headers: ", "Row "
_IS, _NEXT, _BETWEEN = ": ", ", ", " | "

_ENTRIES = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))
_RECORDS = ArrayType(ArrayType(StringType()))


@F.pandas_udf(_ENTRIES)
def _json_entries(bodies: pd.Series) -> pd.Series:
    """The members of a JSON body: (key, value) of an object, (null, value) of an array, none of a scalar."""

    def members(body: str | None):
        try:
            data = None if body is None else json.loads(body)
        except (ValueError, RecursionError):
            return None
        if body is None:
            return None
        named = data.items() if isinstance(data, dict) else ((None, item) for item in data) if isinstance(data, list) else ()
        return [{"name": name, "value": str(value)} for name, value in named]

    return bodies.map(members)


@F.pandas_udf(_RECORDS)
def _csv_records(bodies: pd.Series) -> pd.Series:
    """The records of a CSV body, each as its cells; null where it cannot be split."""

    def split(body: str | None):
        try:
            return None if body is None else list(csv.reader(io.StringIO(body, newline="")))
        except csv.Error:
            return None

    return bodies.map(split)


def _entry_lines(entries: Column) -> Column:
    numbered = F.transform(
        entries, lambda e, i: F.concat(F.coalesce(e["name"], F.concat(F.lit(_ITEM), (i + 1).cast("string"))), F.lit(_IS), e["value"])
    )
    return F.array_join(numbered, "\n")


def with_json_text(rows: DataFrame, body: str, into: str, mode: str = "auto") -> DataFrame:
    """Add ``key: value`` lines of an object, ``Item n: value`` lines of an array, nothing for a scalar.

    Null where the body is no valid JSON. Flat objects of strings and integers are read by ``from_json``;
    in ``auto`` mode the rest goes through the standard library's parser, in ``native`` mode it is null.
    """
    text = F.col(body)
    if mode == "arrow":
        return rows.withColumn(into, _entry_lines(_json_entries(text)))
    if mode not in ("native", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    flat = text.rlike(_FLAT_OBJECT) & ~text.rlike(_OTHER_VALUE)
    fields = F.from_json(F.when(flat, text), "map<string,string>", {"allowSingleQuotes": "false"})
    read = compute_once(rows, {"_fields": fields})
    keys = F.map_keys("_fields")
    lines = F.transform(F.map_entries("_fields"), lambda e: F.concat(e["key"], F.lit(_IS), e["value"]))
    unique = F.size(keys) == F.size(F.array_distinct(keys))
    made = compute_once(read, {"_native": F.when(unique, F.array_join(lines, "\n"))}).drop("_fields")
    native = F.col("_native")
    if mode == "auto":
        native = F.coalesce(native, _entry_lines(_json_entries(F.when(native.isNull(), text))))
    return made.withColumn(into, native).drop("_native")


def csv_text(body: Column) -> Column:
    """Header line, empty line, then ``Row n: header: cell | ...``; null where the body cannot be split.

    Records whose width differs from the header's are left out, yet count in the numbering. Python only splits the
    body; the first record names the cells of the others.
    """

    def lines(records: Column) -> Column:
        headers = F.get(records, F.lit(0))
        made = F.transform(records, lambda cells, i: F.when(i > 0, csv_record_line(i, headers, cells)))
        whole = F.concat(csv_header_lines(headers), F.filter(made, lambda line: line.isNotNull()))
        return F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.array_join(whole, "\n")).otherwise(F.lit(""))

    # handed on as a one-element array, so that the body is split once
    return F.get(F.transform(F.array(_csv_records(body)), lambda records: F.when(records.isNotNull(), lines(records))), F.lit(0))


def csv_header_lines(headers: Column) -> Column:
    """The two lines that open the text: the headers, and an empty one."""
    return F.array(F.concat(F.lit(_HEADERS), F.array_join(headers, _NEXT)), F.lit(""))


def csv_record_line(row_num: Column, headers: Column, cells: Column) -> Column:
    """The line of one already split record; null where its width differs from the header's."""
    pairs = F.zip_with(headers, cells, lambda header, cell: F.concat(header, F.lit(_IS), cell))
    return F.when(
        F.size(headers) == F.size(cells),
        F.concat(F.lit(_ROW), row_num.cast("string"), F.lit(_IS), F.array_join(pairs, _BETWEEN)),
    )
