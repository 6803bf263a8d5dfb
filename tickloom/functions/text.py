"""Text and price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_SCALE = 1_000_000_000

# The raw price that stands for "undefined", the measurement of
# line-protocol rows, and the first part of an export's file name.
UNDEFINED_PRICE = 2**63 - 1
MEASUREMENT = "mbo_ticks"
EXPORT_NAME = "mbo_"


def scale_price(price_raw: Column, null_undefined: bool = False) -> Column:
    """Raw integer price to a float."""
    price = price_raw.cast("double") / F.lit(float(PRICE_SCALE))
    return F.when(price_raw != UNDEFINED_PRICE, price) if null_undefined else price


def exact_price(price_raw: Column) -> Column:
    """Raw integer price to an exact DECIMAL with nine places."""
    return (price_raw.cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(28,9)")


def price_text(price_raw: Column) -> Column:
    """Shortest decimal text of the float price, never with an exponent.

    Up to 15 digits the exact decimal is that text; beyond, the float has lost
    digits and its own text, rewritten without the exponent, is used.
    """
    whole = F.call_function("div", F.abs(price_raw), F.lit(PRICE_SCALE).cast("bigint"))
    fraction = F.lpad((F.abs(price_raw) % F.lit(PRICE_SCALE)).cast("string"), 9, "0")
    sign = F.when(price_raw < 0, "-").otherwise("")
    exact = F.concat(sign, whole.cast("string"), F.lit("."), fraction)
    beyond = scale_price(price_raw).cast("string").try_cast("decimal(28,9)").cast("string")
    digits = F.when(price_raw.between(1 - 10**15, 10**15 - 1), exact).otherwise(beyond)
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def ascii_code(code: Column) -> Column:
    """Printable character of a numeric code, ``_`` for anything else."""
    return F.when(code.between(33, 126), F.chr(code)).otherwise("_")


def escape_tag(text: Column) -> Column:
    """Backslash before comma, blank and equals sign."""
    for char in (",", " ", "="):
        text = F.replace(text, F.lit(char), F.lit(f"\\{char}"))
    return text


def date_from_filename(name: Column) -> Column:
    """First eight digits in a row as ``YYYY-MM-DD`` (unchecked), else NULL."""
    digits = F.nullif(F.regexp_extract(name, r"([0-9]{8})", 1), F.lit(""))
    parts = [F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)]
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])


def slot_filename(date: Column, slot: Column, symbol: Column | None = None) -> Column:
    """Name of a slot's export: ``mbo[_SYMBOL]_DATE_HH-MM.parquet``."""
    owner = [] if symbol is None else [symbol, F.lit("_")]
    return F.concat(F.lit(EXPORT_NAME), *owner, date.cast("string"), F.lit("_"), slot, F.lit(".parquet"))


def clean_symbols(text: Column) -> Column:
    """Trimmed, upper-cased allow-list entry; NULL for blanks and comments."""
    entry = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when((F.length(entry) > 0) & ~entry.startswith("#"), entry)


def line_protocol(symbol: Column) -> Column:
    """One tick as a line: three tags, ten fields, nanosecond time.

    A tag, field or time that is NULL is left out; the line stays.
    """

    def whole(name: str, column: str | None = None) -> Column:
        return F.concat(F.lit(f"{name}="), F.col(column or name).cast("string"), F.lit("i"))

    tags = (
        F.concat(F.lit("symbol="), escape_tag(symbol)),
        F.concat(F.lit("action="), F.col("action")),
        F.concat(F.lit("side="), F.col("side")),
    )
    fields = (
        *(whole(name) for name in ("instrument_id", "order_id", "price_raw")),
        F.concat(F.lit("price="), price_text(F.col("price_raw"))),
        *(whole(name) for name in ("size", "flags", "channel_id", "ts_in_delta", "sequence")),
        whole("ts_recv", "ts_recv_ns"),
    )
    # concat_ws leaves out what is NULL, and an array without elements
    some = F.array_remove(F.array(F.concat_ws(",", *fields)), "")
    return F.concat_ws(" ", F.concat_ws(",", F.lit(MEASUREMENT), *tags), some, F.col("ts_event_ns").cast("string"))
