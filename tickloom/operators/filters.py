"""Row filters that reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import as_ns, date_of_ns, hour_of_ns, slot_of_ns
from ..schema import TRADE

When = int | str | dt.date | dt.datetime


def for_symbol(ticks: DataFrame, symbol: str) -> DataFrame:
    return ticks.where(F.col("symbol") == symbol)


def for_order(ticks: DataFrame, *order_ids: int) -> DataFrame:
    """Ticks of some orders; a table loaded with Bloom filters on ``order_id`` skips the row groups without them."""
    return ticks.where(F.col("order_id").isin(*order_ids))


def trades(ticks: DataFrame) -> DataFrame:
    return ticks.where(F.col("action") == TRADE)


def of_rtypes(raw: DataFrame, rtypes: tuple[str, ...]) -> DataFrame:
    return raw.where(F.col("rtype").isin(*rtypes))


def time_range(
    rows: DataFrame, start: When | None = None, end: When | None = None, closed: bool = False
) -> DataFrame:
    """Rows with start <= ts_event_ns < end, or <= end when ``closed``.

    The nanosecond bounds are literals, so Parquet statistics can use them.  A
    physical ``date``, ``hour`` or ``slot`` partition or ``ts_event`` timestamp,
    where the rows have one, gets the matching coarser bound: it prunes folders
    or row groups and never decides the result.
    """
    ns = F.col("ts_event_ns")
    keep: list[Column] = []
    if start is not None:
        first = as_ns(start)
        keep += [ns >= first, *_coarse(rows, first, lower=True)]
    if end is not None:
        last = as_ns(end) if closed else as_ns(end) - 1
        keep += [ns <= last if closed else ns < last + 1, *_coarse(rows, last, lower=False)]
    for condition in keep:
        rows = rows.where(condition)
    return rows


def _coarse(rows: DataFrame, ns: int, lower: bool) -> list[Column]:
    kinds = {field.name: type(field.dataType) for field in rows.schema.fields}
    found = []

    def bound(column: Column, value: Column) -> Column:
        return column >= value if lower else column <= value

    if kinds.get("date") is T.DateType:
        day = F.lit(date_of_ns(ns))
        found.append(bound(F.col("date"), day))
        parts = {"hour": (T.IntegerType, hour_of_ns(ns)), "slot": (T.StringType, slot_of_ns(ns))}
        for name, (kind, value) in parts.items():
            if kinds.get(name) is kind:
                found.append((F.col("date") != day) | bound(F.col(name), F.lit(value)))
    if kinds.get("ts_event") is T.TimestampType:
        found.append(bound(F.col("ts_event"), F.timestamp_micros(F.lit(ns // 1_000))))
    return found


def raw_range(raw: DataFrame, start: When, end: When, rtypes: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Raw records of the given types in the closed range [start, end], in order."""
    return of_rtypes(time_range(raw, start, end, closed=True), rtypes).orderBy(*order)
