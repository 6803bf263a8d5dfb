"""Maintained bars: each load notes the partial bars of its own rows, and wider bars are rolled up from them.

A partial bar keeps, beside its open and close, the order keys they were chosen
by, so that partial bars of several loads merge to what their ticks together
would give.  They are written before a load is committed and read by the attempt
that counts: a load that is run again replaces its bars along with its rows.
Bars of whole tables then open no file of ticks, and loads outside a time range
none of bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..operators.bars import BAR_VALUES, order_key, with_defaults
from ..operators.filters import When, trades
from ..schema import BAR_ORDER, TICK
from ..sources import commits, folders
from . import facts

BARS = "_bars"

_KEY = T.StructType([TICK[name] for name in BAR_ORDER])
_VALUE = TICK["price"].dataType
PARTIAL = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bucket_ns", T.LongType()),
        T.StructField("open", _VALUE),
        T.StructField("open_key", _KEY),
        T.StructField("high", _VALUE),
        T.StructField("low", _VALUE),
        T.StructField("close", _VALUE),
        T.StructField("close_key", _KEY),
        *(T.StructField(name, T.LongType()) for name in ("volume", "trades", "priced")),
    ]
)


def path_of(base: str, done: commits.Commit) -> str:
    return f"{base}/{BARS}/{folders.folder_name(done.value)}"


def partial_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Bars of trades by symbol that can still be merged; ``priced`` counts the trades with a price."""
    rows = trades(ticks)
    key = order_key(rows, BAR_ORDER)
    bucket = clock.floor_to(F.col("ts_event_ns"), clock.width_ns(every)).alias("bucket_ns")
    return rows.groupBy("symbol", bucket).agg(
        F.min_by("price", key).alias("open"),
        F.min(key).alias("open_key"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.max(key).alias("close_key"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trades"),
        F.count("price").alias("priced"),
    )


def write(spark: SparkSession, base: str, done: commits.Commit, every: str) -> None:
    """Note the partial bars of an attempt that has written its rows and is not committed yet."""
    found = partial_bars(facts.rows_of(spark, base, done), every).sortWithinPartitions("symbol", "bucket_ns")
    found.write.mode("overwrite").option("compression", "zstd").parquet(path_of(base, done))


def _overlaps(done: commits.Commit, start: int | None, end: int | None) -> bool:
    if done.rows == 0:
        return False
    if done.first_ns is None or done.last_ns is None:
        return True  # not known
    return (end is None or done.first_ns < end) and (start is None or done.last_ns >= start)


def table_partials(
    spark: SparkSession,
    root: str,
    every: str,
    symbol: str | None = None,
    start: When | None = None,
    end: When | None = None,
) -> DataFrame:
    """Partial bars, at most as wide as ``every``, of every committed load; several rows where loads share a bucket.

    Loads that noted no bars, or bars of a width that does not divide ``every``,
    have theirs made from their ticks.  The range is
    half-open and must begin and end with a bucket of ``every``.
    """
    folders.require(spark, root)
    base, width = root.rstrip("/"), clock.width_ns(every)
    first, last = (None if edge is None else clock.as_ns(edge) for edge in (start, end))
    if any(edge is not None and edge % width for edge in (first, last)):
        raise ValueError(f"the range must begin and end with a bucket of {every}")
    loads = [done for done in commits.committed(spark, base) if _overlaps(done, first, last)]
    fits = [done.bars is not None and width % clock.width_ns(done.bars) == 0 for done in loads]
    noted = [path_of(base, done) for done, fit in zip(loads, fits) if fit]
    parts = [spark.read.schema(PARTIAL).parquet(*noted)] if noted else []
    parts += [partial_bars(facts.rows_of(spark, base, done), every) for done, fit in zip(loads, fits) if not fit]
    rows = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], PARTIAL))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    if first is not None:
        rows = rows.where(F.col("bucket_ns") >= first)
    return rows if last is None else rows.where(F.col("bucket_ns") < last)


def rolled_up(partials: DataFrame, every: str, by: Sequence[str] = ("symbol",), counted: str = "trades") -> DataFrame:
    """Bars of ``every`` from partial bars no wider than that; as :func:`..operators.bars.bars`."""
    bucket = clock.floor_to(F.col("bucket_ns"), clock.width_ns(every)).alias("_bucket")
    grouped = partials.groupBy(*by, bucket).agg(
        F.min_by("open", "open_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_key").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(counted).alias("trades"),
    )
    return grouped.select(*by, clock.epoch_ms(F.col("_bucket")).alias("ts"), *BAR_VALUES)


def table_bars(spark: SparkSession, root: str, every: str) -> DataFrame:
    """Bars of every symbol of a table."""
    return rolled_up(table_partials(spark, root, every), every)


def bars_for(
    spark: SparkSession, root: str, symbol: str, start: When, end: When, resolution: str = "auto"
) -> DataFrame:
    """As :func:`..operators.bars.bars_for`, of a table; the range must begin and end with a bar."""
    every = clock.pick_resolution(start, end) if resolution == "auto" else clock.resolution_or_default(resolution)
    found = table_partials(spark, root, every, symbol, start, end)
    return with_defaults(rolled_up(found, every, by=())).orderBy("ts")


def merged_bars(spark: SparkSession, root: str, interval: str) -> DataFrame:
    """As :func:`..operators.bars.merged_bars`, of a table."""
    every = clock.parse_interval(interval)
    series = rolled_up(table_partials(spark, root, every), every, by=(), counted="priced")
    return series.select(F.timestamp_millis("ts").alias("datetime"), *BAR_VALUES).orderBy("datetime")
