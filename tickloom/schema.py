"""Column lists, schemas and the total order of ticks."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per order-book event.  Spark timestamps stop at microseconds, so both
# times are kept as exact nanosecond integers.
TICK = T.StructType(
    [
        T.StructField("ts_event_ns", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("instrument_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("price_raw", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("channel_id", T.ShortType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("ts_recv_ns", T.LongType()),
        T.StructField("ts_in_delta", T.IntegerType()),
        T.StructField("sequence", T.LongType()),
    ]
)
TICK_COLUMNS = TICK.fieldNames()

# Both times as timestamps, cut to microseconds, stored beside the exact ones so
# that conditions on them reach the statistics of the files.
TIMES = ("ts_event", "ts_recv")
TIME_FIELDS = tuple(T.StructField(name, T.TimestampType()) for name in TIMES)

# Decoded raw records of every type; prices are unscaled, codes are numeric.
RAW = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("rtype", T.StringType()),
        T.StructField("ts_event_ns", T.LongType()),
        T.StructField("ts_recv_ns", T.LongType()),
        T.StructField("instrument_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("price_raw", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("channel_id", T.ShortType()),
        T.StructField("action_code", T.IntegerType()),
        T.StructField("side_code", T.IntegerType()),
        T.StructField("ts_in_delta", T.IntegerType()),
        T.StructField("sequence", T.LongType()),
    ]
)

# What records say beyond the common columns; prices are unscaled.  A record has
# what its family has, the rest is NULL.
LEVEL = T.StructType(
    [
        *(T.StructField(name, T.LongType()) for name in ("bid_px", "ask_px", "bid_sz", "ask_sz")),
        *(T.StructField(name, T.IntegerType()) for name in ("bid_ct", "ask_ct")),
    ]
)
BAR = T.StructType([T.StructField(name, T.LongType()) for name in ("open", "high", "low", "close", "volume")])
PAYLOADS = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        T.StructField("levels", T.ArrayType(LEVEL)),
        T.StructField("bar", BAR),
        # dozens of attributes that differ by kind of instrument and by version of the feed
        T.StructField("definition", T.VariantType()),
    ]
)

# Half-open validity [start_date, end_date) of a symbol for an instrument.
SYMBOL_MAP = T.StructType(
    [
        T.StructField("instrument_id", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)

# The record families a raw range read returns.
RAW_RTYPES = (
    "mbo",
    "mbp0",
    "mbp1",
    "mbp10",
    "ohlcv_1s",
    "ohlcv_1m",
    "ohlcv_1h",
    "ohlcv_1d",
    "ohlcv_eod",
    "instrument_def",
)

# Which payload the families have; an order event has none.
FAMILY_PAYLOADS = {
    "depth": ("mbp0", "mbp1", "mbp10"),
    "levels": ("mbp1", "mbp10"),
    "bar": ("ohlcv_1s", "ohlcv_1m", "ohlcv_1h", "ohlcv_1d", "ohlcv_eod"),
    "definition": ("instrument_def",),
}

TRADE = "T"

# Storage order alone would leave open, close and page edges to chance when
# times tie.  TICK_ORDER ranks any two ticks of a symbol that differ in what a
# page shows; BAR_ORDER ends with the price, so whichever of two full ties wins,
# open and close come out the same.
TICK_ORDER = ("ts_event_ns", "sequence", "order_id", "instrument_id", "action", "side", "size", "price")
BAR_ORDER = ("ts_event_ns", "sequence", "order_id", "price")
RAW_ORDER = ("ts_event_ns", "sequence", "order_id", "rtype", "instrument_id")

# Partition columns of the two Parquet layouts.
TABLE_PARTITIONS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("load", T.StringType()),
    ]
)
EXPORT_PARTITIONS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("slot", T.StringType()),
    ]
)
