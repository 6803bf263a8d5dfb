"""Pages and listings of ticks."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..schema import TICK_COLUMNS, TICK_ORDER
from .filters import When, for_symbol, time_range

PAGE_DEFAULT = 10_000
PAGE_MAX = 50_000

# Rows a task may send on to serve a page by plain top-k: with thousands of
# tasks, what reaches the last one is thousands of times as much.  Larger and
# deeper pages first look for the time at which they begin and end.
DIRECT_ROWS = 20_000
SLICES = 1_024


def clamp_limit(limit: int = PAGE_DEFAULT) -> int:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit, PAGE_MAX)


def ticks_page(
    ticks: DataFrame,
    symbol: str,
    start: When,
    end: When,
    limit: int = PAGE_DEFAULT,
    offset: int = 0,
    after: Mapping[str, object] | None = None,
    keyed: bool = False,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """One page of a symbol's ticks in [start, end), in time order.

    Skips ``offset`` rows and returns up to ``limit`` (at most 50,000), each with
    the page's ``count`` and ``has_more``.  To read on without counting rows
    again, ask for ``keyed`` pages and pass the last row's ``key.asDict()`` as
    ``after``.  A key holds the order columns and, as rows may be equal in all of
    them, how many such rows have been shown.
    """
    limit = clamp_limit(limit)
    rows = _page_rows(ticks, symbol, start, end, limit, offset, after, direct_rows)
    seen = F.count("*").over(Window.partitionBy())  # at most 50,001 rows, in one partition already
    counted = rows.withColumn("_seen", seen).orderBy(*TICK_ORDER).limit(limit)
    return counted.select(
        clock.epoch_ms(F.col("ts_event_ns")).alias("ts"),
        F.col("ts_event_ns").alias("ts_ns"),
        *(F.coalesce(F.col(name), F.lit(default)).alias(name) for name, default in _SHOWN.items()),
        F.least(F.col("_seen"), F.lit(limit).cast("bigint")).alias("count"),
        (F.col("_seen") > limit).alias("has_more"),
        *([_key(after).alias("key")] if keyed else []),
    )


def page_summary(
    ticks: DataFrame,
    symbol: str,
    start: When,
    end: When,
    limit: int = PAGE_DEFAULT,
    offset: int = 0,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``count`` and ``has_more`` of a page in one row, also when it is empty."""
    limit = clamp_limit(limit)
    rows = _page_rows(ticks, symbol, start, end, limit, offset, None, direct_rows)
    seen = F.count("*")
    return rows.agg(
        F.least(seen, F.lit(limit).cast("bigint")).alias("count"), (seen > limit).alias("has_more")
    )


# Shown columns besides the times, with the value that stands for NULL.
_SHOWN = {"price": 0.0, "size": 0, "side": "", "action": "", "order_id": 0}


def _page_rows(
    ticks: DataFrame,
    symbol: str,
    start: When,
    end: When,
    limit: int,
    offset: int,
    after: Mapping[str, object] | None,
    direct_rows: int,
) -> DataFrame:
    """The page plus one row of lookahead, in order."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows = time_range(for_symbol(ticks, symbol), start, end)
    if after is not None:
        rows, offset = rows.where(_not_before(after)), offset + after[_SHOWN_EQUAL]
    if offset + limit + 1 > direct_rows:
        rows, offset = _skip_ahead(rows, offset, limit + 1, clock.as_ns(start), clock.as_ns(end), direct_rows)
    columns = list(dict.fromkeys([*TICK_ORDER, *_SHOWN]))
    return rows.select(*columns).orderBy(*TICK_ORDER).offset(offset).limit(limit + 1)


_SHOWN_EQUAL = "shown_equal"


def _same(last: Mapping[str, object], names: Sequence[str] = TICK_ORDER) -> Column:
    return reduce(Column.__and__, (F.col(name).eqNullSafe(F.lit(last[name])) for name in names), F.lit(True))


def _key(after: Mapping[str, object] | None) -> Column:
    """Order columns of a row, and its place among the rows equal in all of them."""
    place = F.row_number().over(Window.partitionBy(*TICK_ORDER).orderBy("ts_event_ns"))
    if after is not None:
        place = place + F.when(_same(after), after[_SHOWN_EQUAL]).otherwise(0)
    return F.struct(*TICK_ORDER, place.alias(_SHOWN_EQUAL))


def _not_before(last: Mapping[str, object]) -> Column:
    """Rows equal to ``last`` or after it in tick order (NULLs come first)."""
    missing = [name for name in (*TICK_ORDER, _SHOWN_EQUAL) if name not in last]
    if missing:
        raise ValueError(f"missing in the key: {missing}")
    greater = [
        F.col(name).isNotNull() if last[name] is None else F.col(name) > F.lit(last[name]) for name in TICK_ORDER
    ]
    ahead = [_same(last, TICK_ORDER[:i]) & greater[i] for i in range(len(TICK_ORDER))]
    # the first condition follows from the rest, and reaches the scan
    return (F.col("ts_event_ns") >= F.lit(last["ts_event_ns"])) & reduce(Column.__or__, ahead, _same(last))


# Order columns by which a page's beginning is narrowed down; both are integers.
_SLICED = ("ts_event_ns", "sequence")


def _skip_ahead(
    rows: DataFrame, skip: int, keep: int, low: int, high: int, direct_rows: int
) -> tuple[DataFrame, int]:
    """Rows from shortly before a deep page on, and how many of them to skip.

    A top-k of offset + limit rows per task does not hold for deep offsets, and
    one over a wide range sends on far more rows than the page has.  Each round
    counts the rows in up to 1,024 slices of the range (a hash aggregate over a
    pruned scan; 1,024 numbers reach the driver), moves into the slice in which
    the page begins and cuts off slices beyond its last row, until at most
    ``direct_rows`` rows are left to skip.  If all that is left is one
    nanosecond, its rows are sliced by sequence.  No row of the page is ever
    outside, and the rows still to skip are counted, so the page is the same as
    without this.
    """
    fixed: list[tuple[str, int]] = []
    first, stop = low, high
    conditions: list[Column] = []
    for name in _SLICED:
        group = time_range(rows, first, first + 1) if fixed else rows
        if fixed:
            bounds = group.agg(
                F.min(name).alias("low"), F.max(name).alias("high"), F.count_if(F.col(name).isNull()).alias("nulls")
            ).first()
            if bounds["nulls"] > skip:
                break
            low, high, skip = bounds["low"], bounds["high"] + 1, skip - bounds["nulls"]
        while True:
            width = -(-(high - low) // SLICES)
            inside = group.where((F.col(name) >= low) & (F.col(name) < high)) if fixed else time_range(group, low, high)
            begin, passed, end = _locate(_slice_counts(inside, name, low, width), skip, keep)
            if begin is None:
                return rows.where(F.lit(False)), 0
            cut = None if end is None else low + (end + 1) * width
            low, high = low + begin * width, min(high, low + (begin + 1) * width)
            skip -= passed
            if not fixed:
                first, stop = low, stop if cut is None else min(stop, cut)
            else:
                later = F.col("ts_event_ns") > first
                conditions.append(later | (F.col(name) >= low))
                if cut is not None:
                    conditions.append(~later & (F.col(name) < cut))
            if width == 1 or skip <= direct_rows:
                break
        if skip <= direct_rows:
            break
        fixed.append((name, low))
    narrowed = time_range(rows, first, stop)
    for condition in conditions:
        narrowed = narrowed.where(condition)
    return narrowed, skip


def _slice_counts(rows: DataFrame, name: str, low: int, width: int) -> list[tuple[int, int]]:
    """Row counts of the slices in order: at most SLICES pairs."""
    index = clock.floor_div(F.col(name) - F.lit(low), width).alias("slice")
    return [(r["slice"], r["count"]) for r in rows.groupBy(index).count().orderBy("slice").collect()]


def _locate(slices: Sequence[tuple[int, int]], skip: int, keep: int) -> tuple[int | None, int, int | None]:
    """Slice of the first row after ``skip``, rows before it, slice of the last row kept."""
    begin, passed, before = None, 0, 0
    for index, count in slices:
        if begin is None and before + count > skip:
            begin, passed = index, before
        before += count
        if before >= skip + keep:
            return begin, passed, index
    return begin, passed, None


def head(ticks: DataFrame, n: int = 20, ordered: bool = False) -> DataFrame:
    """Any ``n`` ticks, read no further than needed; the first by time if ``ordered``."""
    return (ticks.orderBy(*TICK_ORDER) if ordered else ticks).limit(n)


def latest(
    ticks: DataFrame,
    symbol: str,
    n: int = 20,
    within_ns: int = clock.MINUTE,
    anchor_ns: Column | int | None = None,
) -> DataFrame:
    """Newest ``n`` ticks of a symbol later than ``anchor - within``, newest first.

    The anchor is the current time unless given.  A known time prunes partitions;
    a column, such as a scalar subquery, only filters rows.
    """
    rows = for_symbol(ticks, symbol)
    if anchor_ns is None:
        anchor_ns = time.time_ns()
    if isinstance(anchor_ns, int):
        recent = time_range(rows, anchor_ns - within_ns + 1)
    else:
        recent = rows.where(F.col("ts_event_ns") > anchor_ns - F.lit(within_ns))
    return recent.select(*TICK_COLUMNS).orderBy(*(F.col(name).desc() for name in TICK_ORDER)).limit(n)


def slice_ticks(ticks: DataFrame, start: When, end: When, symbol: str | None = None) -> DataFrame:
    """All tick columns in [start, end), optionally of one symbol, in time order."""
    rows = ticks if symbol is None else for_symbol(ticks, symbol)
    return time_range(rows, start, end).select(*TICK_COLUMNS).orderBy(*TICK_ORDER)
