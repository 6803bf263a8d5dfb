"""OHLCV bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..schema import BAR_ORDER
from .filters import When, for_symbol, time_range, trades

BAR_VALUES = ("open", "high", "low", "close", "volume", "trades")


def order_key(rows: DataFrame, order: Sequence[str]) -> Column:
    """One comparable column for a list of order columns.

    One column stands for itself.  Two integer columns are packed into a
    DECIMAL(38), which keeps the aggregate a hash aggregate (19 digits each; the
    second must not be negative).  Longer lists become a struct: exact for any
    types, but Spark then sorts each partition before the partial aggregate.
    """
    if len(order) == 1:
        return F.col(order[0])
    whole = (T.LongType, T.IntegerType, T.ShortType)
    if len(order) == 2 and all(isinstance(rows.schema[name].dataType, whole) for name in order):
        first, second = (F.col(name).cast("decimal(38,0)") for name in order)
        # a NULL second comes before 0; a NULL key would drop the row
        return first * F.lit(str(10**19)).cast("decimal(20,0)") + F.coalesce(second, F.lit(-1))
    return F.struct(*order)


def bars(
    ticks: DataFrame,
    every: str,
    by: Sequence[str] = ("symbol",),
    trades_only: bool = True,
    order: Sequence[str] = BAR_ORDER,
    count_col: str | None = None,
) -> DataFrame:
    """Bars of fixed width ``every`` (``N`` with unit s, m, h or d) per ``by``.

    Buckets are aligned to the epoch, closed on the left and labelled by their
    start in milliseconds; empty buckets yield no row.  ``order`` decides open
    and close: it must rank the ticks of a bucket up to equal prices.  ``trades``
    counts rows, or non-NULL values of ``count_col``.  The partial aggregate
    leaves at most one row per task and bucket for the shuffle, so neither a hot
    symbol nor a hot bucket gathers in one task.
    """
    rows = trades(ticks) if trades_only else ticks
    key = order_key(rows, order)
    bucket = clock.floor_to(F.col("ts_event_ns"), clock.width_ns(every)).alias("_bucket")
    grouped = rows.groupBy(*by, bucket).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"),
        F.count(count_col or "*").alias("trades"),
    )
    return grouped.select(*by, clock.epoch_ms(F.col("_bucket")).alias("ts"), *BAR_VALUES)


def bars_for(
    ticks: DataFrame,
    symbol: str,
    start: When,
    end: When,
    resolution: str = "auto",
    order: Sequence[str] = BAR_ORDER,
) -> DataFrame:
    """Bars of one symbol over [start, end), in time order.

    ``auto`` picks the resolution from the length of the range; unknown
    resolutions mean one minute.
    """
    if resolution == "auto":
        every = clock.pick_resolution(start, end)
    else:
        every = clock.resolution_or_default(resolution)
    rows = time_range(for_symbol(ticks, symbol), start, end)
    return with_defaults(bars(rows, every, by=(), order=order)).orderBy("ts")


def merged_bars(ticks: DataFrame, interval: str, order: Sequence[str] = BAR_ORDER) -> DataFrame:
    """Bars of any ``N{s,m,h}`` interval with all symbols merged into one series.

    The key is the bucket start as ``datetime``; ``trades`` counts non-NULL
    prices.  Filter the symbol first for a series of one symbol.
    """
    series = bars(ticks, clock.parse_interval(interval), by=(), order=order, count_col="price")
    return series.select(F.timestamp_millis("ts").alias("datetime"), *BAR_VALUES).orderBy("datetime")


def with_defaults(series: DataFrame) -> DataFrame:
    """NULL bar values as 0, for output only (never before aggregating)."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(0).cast(series.schema[name].dataType)) for name in BAR_VALUES
    }
    return series.withColumns(filled)
