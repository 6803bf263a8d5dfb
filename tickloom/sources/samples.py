"""The driver's tables in the shapes the engine works on.

``events`` stands for ticks with distinct times, ``lineitem`` for ticks with
many equal times.  All views are lazy projections of whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..schema import BAR, LEVEL, TICK

# The timestamp is declared with zone, so time filters on it reach the scan.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

LINES = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_shipdate", T.TimestampType()),
    ]
)

# Fixed values of the stand-in views.
ACTIONS = {"purchase": "T", "view": "A", "click": "M", "signup": "F", "error": "C"}
SIDES = ("B", "A", "N")
SYMBOL_CHANGE = dt.date(2024, 1, 10)
MAP_START = dt.date(2023, 1, 1)
MAP_END = dt.date(2026, 1, 1)
ODD_CODE = 7


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def user_symbol(user_id: Column, prefix: str = "S") -> Column:
    digits = user_id.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def _choose(index: Column, *values: Column | str) -> Column:
    chosen = F.when(index == 0, values[0])
    for position, value in enumerate(values[1:], 1):
        chosen = chosen.when(index == position, value)
    return chosen


def _action(event_type: Column) -> Column:
    (kind, action), *rest = ACTIONS.items()
    chosen = F.when(event_type == kind, action)
    for kind, action in rest:
        chosen = chosen.when(event_type == kind, action)
    return chosen


def _k() -> Column:
    """The one number in ``props``; a pattern costs a quarter of a JSON parser."""
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int")


def _typed(rows: DataFrame, columns: dict[str, Column], *extra: Column) -> DataFrame:
    return rows.select(
        *(columns[field.name].cast(field.dataType).alias(field.name) for field in TICK.fields), *extra
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks, plus the microsecond ``ts_event`` it is stored by."""
    ns = clock.micros_to_ns(F.col("ts"))
    delta = F.pmod("event_id", F.lit(1_000))
    columns = {
        "ts_event_ns": ns,
        "symbol": user_symbol(F.col("user_id")),
        "instrument_id": F.col("user_id"),
        "order_id": F.col("event_id"),
        "price_raw": F.round(F.col("value") * 1e9),
        "price": F.col("value"),
        "size": _k(),
        "flags": F.pmod("event_id", F.lit(256)),
        "channel_id": F.pmod("user_id", F.lit(4)),
        "action": _action(F.col("event_type")),
        "side": _choose(F.pmod("user_id", F.lit(3)), *SIDES),
        "ts_recv_ns": ns + delta * F.lit(1_000),
        "ts_in_delta": delta,
        "sequence": F.col("event_id"),
    }
    return _typed(events(spark, sf_dir), columns, F.col("ts").alias("ts_event"))


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as ticks: day-granular times, so most of them tie."""
    ns = clock.micros_to_ns(F.col("l_shipdate"))
    columns = {
        "ts_event_ns": ns,
        "symbol": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        "instrument_id": F.col("l_partkey"),
        "order_id": F.col("l_orderkey"),
        "price_raw": F.round(F.col("l_extendedprice") * 1e9),
        "price": F.col("l_extendedprice"),
        "size": F.col("l_quantity"),
        "flags": F.lit(0),
        "channel_id": F.lit(0),
        "action": F.when(F.col("l_returnflag") == "R", "T").otherwise("A"),
        "side": F.lit("N"),
        "ts_recv_ns": ns,
        "ts_in_delta": F.lit(0),
        "sequence": F.col("l_linenumber"),
    }
    return _typed(spark.read.schema(LINES).parquet(f"{sf_dir}/lineitem.parquet"), columns)


# The order key of FIXTURES.md for lineitem: time, order, line, price.
LINE_ORDER = ("ts_event_ns", "order_id", "sequence", "price")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as decoded raw records of several types, one file per day."""
    ticks = event_ticks(spark, sf_dir)
    event_id = F.col("order_id")
    odd = F.pmod(event_id, F.lit(101)) == 0

    def code(name: str) -> Column:
        return F.when(odd, ODD_CODE).otherwise(F.ascii(F.col(name)))

    rtype = (
        F.when(F.pmod(event_id, F.lit(10)) == 0, "mbp1")
        .when(F.pmod(event_id, F.lit(37)) == 0, "status")
        .otherwise("mbo")
    )
    day = F.regexp_replace(clock.date_of(F.col("ts_event_ns")).cast("string"), "-", "")
    return ticks.select(
        F.concat(F.lit("feed-"), day, F.lit(".mbo.parquet")).alias("source_file"),
        rtype.alias("rtype"),
        "ts_event_ns",
        "ts_recv_ns",
        "instrument_id",
        "order_id",
        "price_raw",
        "size",
        "flags",
        "channel_id",
        code("action").alias("action_code"),
        code("side").alias("side_code"),
        "ts_in_delta",
        "sequence",
    )


# Fixed values of the stand-in view: families by the last digit of the event.
FAMILIES = ("mbp1", "mbp0", "mbp10", "ohlcv_1s", "ohlcv_1d", "ohlcv_eod", "instrument_def", "status", "mbo", "mbo")


def raw_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as decoded raw records of every family, with their payloads."""
    records = raw_records(spark, sf_dir)
    event, price, size = F.col("order_id"), F.col("price_raw"), F.col("size").cast("long")
    rtype = _choose(F.pmod(event, F.lit(len(FAMILIES))), *map(F.lit, FAMILIES))
    books = F.when(rtype == "mbp1", 1).when(rtype == "mbp10", 10).otherwise(0)

    def level(k: Column) -> Column:
        step = k * F.lit(10_000_000).cast("long")
        values = (price - step, price + step + 1, size + k, size + 2 * k, k.cast("int"), (k + 1).cast("int"))
        return F.struct(*(v.alias(f.name) for v, f in zip(values, LEVEL.fields)))

    levels = F.transform(F.sequence(F.lit(1).cast("long"), books.cast("long")), level)
    bar = F.struct(*(v.alias(f.name) for v, f in zip((price, price + size, price - size, price + 1, size), BAR.fields)))
    named = F.to_json(F.struct(user_symbol(F.col("instrument_id")).alias("raw_symbol"), size.alias("min_price_increment")))
    columns = {
        "rtype": rtype,
        "depth": F.when(rtype.startswith("mbp"), F.pmod(event, F.lit(7)).cast("int")),
        "levels": F.when(books > 0, levels),
        "bar": F.when(rtype.startswith("ohlcv"), bar),
        "definition": F.when(rtype == "instrument_def", F.parse_json(named)),
    }
    return records.withColumns(columns)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id").distinct()


def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping of users to symbols.

    Multiples of 13 are unmapped; multiples of 5 change their symbol once.
    """
    changes = F.pmod("user_id", F.lit(5)) == 0

    def span(prefix: str, start: dt.date, end: dt.date) -> Column:
        return F.struct(
            user_symbol(F.col("user_id"), prefix).alias("symbol"),
            F.lit(start).alias("start_date"),
            F.lit(end).alias("end_date"),
        )

    spans = F.when(
        changes, F.array(span("S", MAP_START, SYMBOL_CHANGE), span("T", SYMBOL_CHANGE, MAP_END))
    ).otherwise(F.array(span("S", MAP_START, MAP_END)))
    return (
        _users(spark, sf_dir)
        .where(F.pmod("user_id", F.lit(13)) != 0)
        .select(F.col("user_id").alias("instrument_id"), F.inline(spans))
    )


def allowlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an allow-list file: even users, in mixed case and with padding."""
    symbol = user_symbol(F.col("user_id"))
    lines = F.when(
        F.pmod("user_id", F.lit(2)) == 0,
        F.array(
            F.when(F.pmod("user_id", F.lit(4)) == 0, F.concat(F.lower(symbol), F.lit(" \r"))).otherwise(symbol)
        ),
    ).otherwise(F.array(F.concat(F.lit("# "), symbol), F.lit("  ")))
    return _users(spark, sf_dir).select(F.explode(lines).alias("value"))


def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names offered to a load.

    One per day with events, one per such day 20 days on (mostly not loaded
    yet), and one without a date for each.
    """
    day = clock.date_of(clock.micros_to_ns(F.col("ts")))
    days = events(spark, sf_dir).select(day.alias("day")).distinct()

    def named(date: Column) -> Column:
        return F.concat(F.lit("feed-"), F.regexp_replace(date.cast("string"), "-", ""), F.lit(".mbo.parquet"))

    names = F.array(
        named(F.col("day")),
        named(F.date_add("day", 20)),
        F.concat(F.lit("replay-"), F.substring(F.col("day").cast("string"), 6, 5), F.lit(".mbo.parquet")),
    )
    return days.select(F.explode(names).alias("file_name")).distinct()


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in every accepted form, and in one that is not."""
    ts = F.col("ts")
    nanos = F.lpad(F.pmod("event_id", F.lit(1_000)).cast("string"), 3, "0")
    text = _choose(
        F.pmod("event_id", F.lit(6)),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), nanos, F.lit("+05:30")),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-08:00'"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(ts, "yyyy-MM-dd"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return events(spark, sf_dir).select("event_id", text.alias("text"))


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval and resolution texts: usual, odd and unreadable ones."""
    k = _k()
    unit = _choose(F.pmod("event_id", F.lit(6)), "s", "m", "H", "d", "S", "M ")
    number = F.when(k > 80, F.lit("x")).otherwise(k.cast("string"))
    usual = _choose(F.pmod("event_id", F.lit(9)), *clock.RESOLUTIONS, "auto")
    return events(spark, sf_dir).select(
        "event_id",
        F.concat(number, unit).alias("text"),
        F.coalesce(usual, F.concat(k.cast("string"), F.lit("m"))).alias("resolution"),
    )
