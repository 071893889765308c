"""CSV bodies as rows: a table function in a lateral join."""

from __future__ import annotations

import csv
import io
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Records:
    def eval(self, body: str):
        if body is None:
            return
        csv.field_size_limit(sys.maxsize)
        try:
            for number, cells in enumerate(csv.reader(io.StringIO(body, newline=""))):
                yield number, cells
        except csv.Error:
            return


#: (row_num, cells) of a CSV body, the header being row 0; empty and short records count. Arrow carries the cells.
csv_records = F.udtf(_Records, returnType="row_num int, cells array<string>", useArrow=True)


def with_csv_records(rows: DataFrame, body: str) -> DataFrame:
    """A row per record: the given columns without the body, ``row_num`` and ``cells``. A null or empty body has none.

    Records are streamed out of their body, so that a large body is never one array of all its records.
    """
    parts = rows.lateralJoin(csv_records(F.col(f"`{body}`").outer()))
    return parts.drop(body)
