"""Symbols, ranges and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from .filters import When, for_symbol, time_range

# Fixed value: the symbol asked for when a range request names none.
DEFAULT_SYMBOL = "NVDA"


def symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").where(F.col("symbol").isNotNull()).distinct().orderBy("symbol")


def _range() -> list:
    return [
        clock.timestamp_of(F.min("ts_event_ns")).alias("start"),
        clock.timestamp_of(F.max("ts_event_ns")).alias("end"),
        F.count("*").alias("total_ticks"),
    ]


def data_range(ticks: DataFrame, symbol: str = DEFAULT_SYMBOL) -> DataFrame:
    """First and last time and row count of a symbol; NULLs and 0 if unknown."""
    return for_symbol(ticks, symbol).agg(*_range())


def data_ranges(ticks: DataFrame) -> DataFrame:
    """The same for every symbol."""
    return ticks.groupBy("symbol").agg(*_range())


def _date(ticks: DataFrame) -> Column:
    # a partition column of that name costs no read
    return F.col("date") if "date" in ticks.columns else clock.date_of(F.col("ts_event_ns")).alias("date")


def count_by_date(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy(_date(ticks)).agg(F.count("*").alias("cnt"))


def count_by_date_hour(ticks: DataFrame) -> DataFrame:
    # not from the hour folder: a table in daily folders has only one
    hour = clock.hour_of(F.col("ts_event_ns")).alias("hour")
    return ticks.groupBy(_date(ticks), hour).agg(F.count("*").alias("cnt"))


def count_between(ticks: DataFrame, symbol: str, start: When, end: When) -> DataFrame:
    """Rows of a symbol in the closed range [start, end]."""
    return time_range(for_symbol(ticks, symbol), start, end, closed=True).agg(F.count("*").alias("cnt"))


def count_by_symbol(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "symbol")


def shape(result: DataFrame) -> tuple[int, int]:
    """Rows and columns of a result."""
    return result.count(), len(result.columns)
