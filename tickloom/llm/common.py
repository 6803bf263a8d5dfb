"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_dir

#: Rows of an Arrow batch that are Python objects at a time: whole batches of long texts would fill the workers.
ROWS = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it by name; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        base = os.path.join(os.path.realpath(tempfile.mkdtemp()), root.name)
        context.addPyFile(shutil.make_archive(base, "zip", root.parent, root.name))
        _SHIPPED.add(context.applicationId)


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of every row; a NULL text counts as the empty text."""
    return docs.select(
        column(id_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the cluster's shared folder and read again: lost executors cost no recomputation.

    Unlike a checkpoint the result has no known partitioning, so that a join on
    it shuffles both sides and AQE can split its hot keys.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(
    rows: DataFrame, make: Callable[[], Callable[[list], list]], fields: list[T.StructField], at_once: int = ROWS
) -> DataFrame:
    """(id, text) rows to (id, *fields): make() gives each task a function from texts to columns of values."""
    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["id"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in slices(batches, at_once):
            values = judge(batch.column("text").to_pylist())
            columns = [pa.array(v, f.type) for v, f in zip(values, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow[0].type), *columns], schema=arrow)

    return rows.select("id", "text").mapInArrow(run, schema)


def numbered_columns(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: whatever they are called, Python functions can be given all of them."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def keep_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of docs, with all their columns, for whose text the function of make() says True."""
    ship(docs.sparkSession)
    at, rows = docs.columns.index(text_col), numbered_columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in slices(batches):
            said = judge([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(said, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
