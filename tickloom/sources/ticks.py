"""Scans of the Parquet tick layouts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..functions.clock import as_date
from ..operators.filters import for_symbol
from ..schema import EXPORT_PARTITIONS, TABLE_PARTITIONS, TICK, TICK_COLUMNS, TIME_FIELDS, TIMES
from . import commits, folders

Day = str | dt.date


def read_ticks(
    spark: SparkSession,
    root: str,
    partitions: T.StructType = TABLE_PARTITIONS,
    dates: list[dt.date] | None = None,
    below: str = "",
) -> DataFrame:
    """Every ``.parquet`` file under a root as one frame of ticks.

    The schema is given, not inferred, so partition values keep their types; one
    footer is read to see that the tick columns are there.  With ``dates`` only
    their folders are listed: years of 15-minute folders would cost more to list
    than a day costs to read.  Dates without a folder are skipped, a missing
    root is an error.  ``below`` leads to folders above the dates.  Tables in
    daily folders have no ``hour``.  ``ts_event`` and ``ts_recv`` are the times
    as timestamps, cut to microseconds.  Of a table with a log only committed
    loads are read (see :mod:`.commits`).
    """
    names = folders.require(spark, root)
    path = root.rstrip("/")
    if below:
        path = f"{path}/{below}"
        names = folders.children(spark, path)
    fields = [f for f in partitions.fields if f.name != "hour" or _hourly(spark, path, names or [])]
    if dates is None:
        paths = [] if names is None else [path]
    else:
        wanted = {f"date={day.isoformat()}" for day in dates}
        paths = [f"{path}/{name}" for name in sorted(wanted.intersection(names or ()))]
    stored = folders.columns_of(spark, paths[0]) if paths else None
    above = {part.partition("=")[0] for part in below.split("/")}  # partition columns, in no file
    missing = [name for name in TICK_COLUMNS if stored is not None and name not in stored and name not in above]
    if missing:
        raise ValueError(f"files under {root} lack the columns {', '.join(missing)}")
    timed = stored is not None and all(name in stored for name in TIMES)
    schema = T.StructType([*TICK.fields, *(TIME_FIELDS if timed else ()), *fields])
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", root)
    rows = reader.parquet(*paths) if paths else spark.createDataFrame([], schema)
    if paths and commits.LOG in names:
        rows = _counting(spark, root, rows)
    if timed:
        return rows
    derived = [clock.timestamp_of(F.col(f"{name}_ns")).alias(name) for name in TIMES]
    return rows.select(*TICK_COLUMNS, *derived, *(f.name for f in fields))


def _counting(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows of the loads that count, by their folders; ``load`` without the number of the attempt."""
    hidden, numbered = commits.hidden(spark, root)
    if hidden:
        rows = rows.where(~F.col("load").isin(hidden))
    if numbered:
        rows = rows.withColumn("load", F.regexp_replace("load", commits.NUMBERED, ""))
    return rows


def _hourly(spark: SparkSession, path: str, names: list[str]) -> bool:
    """Whether the dates of a table are cut into hours; of an empty one, yes."""
    days = [name for name in names if name.startswith("date=")]
    return not days or any(name.startswith("hour=") for name in folders.children(spark, f"{path}/{days[0]}") or ())


def selected_dates(
    date: Day | None = None, start: Day | None = None, end: Day | None = None
) -> list[dt.date] | None:
    """One date, else those of [start, end) if both are given, else None for all."""
    if date is not None:
        return [as_date(date)]
    if start is None or end is None:
        return None
    first, last = as_date(start), as_date(end)
    return [first + dt.timedelta(days=i) for i in range((last - first).days)]


def _of_dates(rows: DataFrame, dates: list[dt.date] | None) -> DataFrame:
    if dates is None:
        return rows
    if not dates:
        return rows.where(F.lit(False))
    day = F.col("date")
    return rows.where((day >= F.lit(dates[0])) & (day <= F.lit(dates[-1])))


def scan_table(
    spark: SparkSession,
    root: str,
    date: Day | None = None,
    start: Day | None = None,
    end: Day | None = None,
    symbol: str | None = None,
) -> DataFrame:
    """Scan of the loaded tick table; dates prune folders, a symbol pages."""
    dates = selected_dates(date, start, end)
    rows = _of_dates(read_ticks(spark, root, TABLE_PARTITIONS, dates), dates)
    return rows if symbol is None else for_symbol(rows, symbol)


def scan_exports(
    spark: SparkSession,
    root: str,
    date: Day | None = None,
    start: Day | None = None,
    end: Day | None = None,
    symbol: str | None = None,
    symbol_root: str | None = None,
) -> DataFrame:
    """Scan of exported slots.

    With dates, a symbol and a ``symbol_root`` of per-symbol exports, each date
    is read from the symbol's own export if that has it, else from the general
    one.  Which dates it has is seen from its folders; those dates are left out
    of the general scan before it starts.
    """
    dates = selected_dates(date, start, end)
    if symbol is None or symbol_root is None or dates is None:
        rows = _of_dates(read_ticks(spark, root, EXPORT_PARTITIONS, dates), dates)
        return rows if symbol is None else for_symbol(rows, symbol)
    own = _of_dates(read_symbol_exports(spark, symbol_root, symbol, dates), dates)
    names = folders.children(spark, f"{symbol_root.rstrip('/')}/symbol={folders.folder_name(symbol)}") or ()
    present = {day for day in dates if f"date={day.isoformat()}" in names}
    absent = [day for day in dates if day not in present]
    general = for_symbol(_of_dates(read_ticks(spark, root, EXPORT_PARTITIONS, absent), absent), symbol)
    if present:
        general = general.where(~F.col("date").isin(list(present)))
    return own.select(*general.columns).unionByName(general)


def read_symbol_exports(
    spark: SparkSession, root: str, symbol: str, dates: list[dt.date] | None = None
) -> DataFrame:
    """Exports of one symbol; the symbol is their first partition column."""
    rows = read_ticks(spark, root, EXPORT_PARTITIONS, dates, below=f"symbol={folders.folder_name(symbol)}")
    return for_symbol(rows, symbol)


def union_ticks(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of many frames with the tick columns, duplicates kept."""
    return reduce(DataFrame.unionByName, (frame.select(*TICK_COLUMNS) for frame in frames))
