"""What each load holds: rows, first and last time of every symbol and date.

A load may note its facts before it is committed; they are read by the attempt
that counts, so they always belong to the rows that scans see.  Ranges and
counts of whole tables then open no file of ticks.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import pages
from ..operators.catalog import DEFAULT_SYMBOL
from ..operators.filters import When, time_range
from ..schema import TICK
from ..sources import commits, folders
from ..sources import ticks as tick_source

FACTS = "_facts"

FIELDS = "date date, symbol string, cnt long, first_ns long, last_ns long"


def path_of(base: str, done: commits.Commit) -> str:
    return f"{base}/{FACTS}/{folders.folder_name(done.value)}"


def _of_rows(rows: DataFrame) -> DataFrame:
    ns = F.col("ts_event_ns")
    return rows.groupBy(clock.date_of(ns).alias("date"), "symbol").agg(
        F.count("*").alias("cnt"), F.min(ns).alias("first_ns"), F.max(ns).alias("last_ns")
    )


def rows_of(spark: SparkSession, base: str, done: commits.Commit) -> DataFrame:
    """Ticks of one attempt, from its own folders."""
    own = f"load={folders.folder_name(done.value)}"
    if done.parts is None:
        paths = [*folders.matching(spark, f"{base}/date=*/{own}"), *folders.matching(spark, f"{base}/date=*/hour=*/{own}")]
    else:
        dates = sorted({date or "__HIVE_DEFAULT_PARTITION__" for date, _ in done.parts})
        paths = [path for date in dates for path in _below(spark, f"{base}/date={date}", own)]
    files = spark.read.schema(TICK).option("pathGlobFilter", "*.parquet")
    return files.parquet(*paths) if paths else spark.createDataFrame([], TICK)


def _below(spark: SparkSession, day: str, own: str) -> list[str]:
    names = folders.children(spark, day) or []
    if own in names:
        return [f"{day}/{own}"]
    return folders.matching(spark, f"{day}/hour=*/{own}")


def write(spark: SparkSession, base: str, done: commits.Commit) -> None:
    """Note the facts of an attempt that has written its rows and is not committed yet."""
    _of_rows(rows_of(spark, base, done)).write.mode("overwrite").parquet(path_of(base, done))


def table_facts(spark: SparkSession, root: str) -> DataFrame:
    """(date, symbol, cnt, first_ns, last_ns) of every committed load; several rows where loads share a symbol's date.

    Loads that noted no facts have theirs counted from their rows.
    """
    folders.require(spark, root)
    base = root.rstrip("/")
    loads = [done for done in commits.committed(spark, base) if done.rows != 0]
    noted = [path_of(base, done) for done in loads if done.facts]
    found = [spark.read.schema(FIELDS).parquet(*noted)] if noted else []
    found += [_of_rows(rows_of(spark, base, done)) for done in loads if not done.facts]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], FIELDS))


def _range() -> list:
    return [
        clock.timestamp_of(F.min("first_ns")).alias("start"),
        clock.timestamp_of(F.max("last_ns")).alias("end"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total_ticks"),
    ]


def data_range(facts: DataFrame, symbol: str = DEFAULT_SYMBOL) -> DataFrame:
    """As :func:`..operators.catalog.data_range`, of a table's facts."""
    return facts.where(F.col("symbol") == symbol).agg(*_range())


def data_ranges(facts: DataFrame) -> DataFrame:
    return facts.groupBy("symbol").agg(*_range())


def count_by_date(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date").agg(F.sum("cnt").alias("cnt"))


def count_by_symbol(facts: DataFrame) -> DataFrame:
    return facts.groupBy("symbol").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "symbol")


def symbols(facts: DataFrame) -> DataFrame:
    return facts.select("symbol").where(F.col("symbol").isNotNull()).distinct().orderBy("symbol")


def row_count(spark: SparkSession, root: str) -> int | None:
    """Rows of a table from its log alone; None if a load does not say."""
    counts = [done.rows for done in commits.committed(spark, root.rstrip("/"))]
    return None if None in counts else sum(counts)


def ticks_page(
    spark: SparkSession,
    root: str,
    symbol: str,
    start: When,
    end: When,
    limit: int = pages.PAGE_DEFAULT,
    offset: int = 0,
) -> DataFrame:
    """As :func:`..operators.pages.ticks_page`, of a table; the days before a deep page are skipped by their counts.

    Only the days that hold the page are scanned, whatever the offset.  A first
    day that the range cuts is counted, which reads that day of the symbol.
    """
    low, high, skip = _days_of_page(spark, root, symbol, clock.as_ns(start), clock.as_ns(end), offset, pages.clamp_limit(limit) + 1)
    days = (clock.date_of_ns(low), clock.date_of_ns(max(low, high - 1)) + dt.timedelta(days=1))
    rows = tick_source.scan_table(spark, root, start=days[0], end=days[1])
    return pages.ticks_page(rows, symbol, low, high, limit, skip)


def _days_of_page(
    spark: SparkSession, root: str, symbol: str, start: int, end: int, skip: int, keep: int
) -> tuple[int, int, int]:
    """The times between which the rows from ``skip`` on lie, and how many rows to skip from there."""
    rows = table_facts(spark, root).where((F.col("symbol") == symbol) & (F.col("last_ns") >= start) & (F.col("first_ns") < end))
    days = rows.groupBy("date").agg(
        F.sum("cnt").alias("cnt"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")
    )
    low, found = None, 0
    for day in days.orderBy("date").collect():  # one row for each day of the range
        midnight = clock.as_ns(day["date"])
        count, cut = day["cnt"], day["last_ns"] >= end
        if day["first_ns"] < start and low is None and skip:
            one = tick_source.scan_table(spark, root, date=day["date"], symbol=symbol)
            count = time_range(one, start, end).count()
        elif day["first_ns"] < start:
            cut = True
        if low is None and not cut and skip >= count:
            skip -= count
            continue
        low = max(start, midnight) if low is None else low
        # what a cut day holds is not known, and it may hold nothing
        found += 0 if cut else count
        if found >= skip + keep:
            return low, min(end, midnight + clock.DAY), skip
    return (end, end, 0) if low is None else (low, end, skip)
