"""Results as files, tables of bounded size, or text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import line_protocol
from ..operators.pages import PAGE_MAX


def write_result(result: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result of any size as Parquet, CSV with header, or JSON lines."""
    writer = result.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}")


def to_arrow(result: DataFrame, max_rows: int | None = None) -> pa.Table:
    """Arrow table of a result that the driver can hold, e.g. the bars of a request.

    With ``max_rows`` a larger result is refused, never cut.  For results of any
    size take :func:`arrow_batches`, or write a file.
    """
    if max_rows is None:
        return result.toArrow()
    table = result.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; use arrow_batches or write_result")
    return table


def arrow_batches(result: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """A result of any size in batches; the driver holds one partition of it at a time."""
    schema = to_arrow_schema(result.schema)
    found = result.toLocalIterator(prefetchPartitions=True)
    while held := list(islice(found, rows)):
        columns = [pa.array(column, field.type) for column, field in zip(zip(*held), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def json_array(result: DataFrame, max_rows: int | None = PAGE_MAX) -> str:
    """JSON array of objects; a result of more than ``max_rows`` rows (None: no bound) is refused."""
    packed = result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    return "[" + ",".join(to_arrow(packed, max_rows)["row"].to_pylist()) + "]"


def csv_text(result: DataFrame, max_rows: int | None = PAGE_MAX) -> str:
    """CSV with header, NULLs as nothing; bounded like :func:`json_array`."""
    table = to_arrow(result, max_rows)
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerow(table.column_names)
    lines.writerows(zip(*(column.to_pylist() for column in table.columns)))
    return out.getvalue()


def show(result: DataFrame, n: int = 20) -> None:
    """Print the first rows and the size of a result."""
    result.show(n, truncate=False)
    print(f"{result.count()} rows × {len(result.columns)} columns")


def line_protocol_rows(ticks: DataFrame) -> DataFrame:
    """One line of text per tick, under ``value``."""
    return ticks.select(line_protocol(F.col("symbol")).alias("value"))


def write_lines(ticks: DataFrame, path: str) -> None:
    line_protocol_rows(ticks).write.mode("overwrite").text(path)
