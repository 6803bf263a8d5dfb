"""Lookups of ticks in small tables: symbol mapping, allow-list, loaded dates.

The large side must not be shuffled for a table of a few thousand rows, yet the
table may grow.  So its size in bytes is summed first, by one aggregate.  Within
the bound the table is broadcast.  Beyond it both sides shuffle on key and salt:
every table row is repeated once per salt, each tick goes to one salt, so a key
with a third of all ticks still spreads over ``SALTS`` tasks, and the result is
the same.  Exact copies of one event share a salt; AQE's skew join splits those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import date_of

BROADCAST_BYTES = 64 << 20
SALTS = 16
_SALT = "_salt"

# Bytes of a row in memory beyond its texts: the row itself, and each column.
_ROW_BYTES, _COLUMN_BYTES = 32, 16


def _size(table: DataFrame) -> Column:
    """Estimated bytes of a table, as an aggregate."""
    fixed = F.lit(_ROW_BYTES + _COLUMN_BYTES * len(table.columns))
    texts = [F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) for name in table.columns]
    return F.coalesce(F.sum(sum(texts, fixed).cast("bigint")), F.lit(0))


def fits(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table takes at most ``max_bytes``; one row reaches the driver."""
    return table.agg(_size(table)).first()[0] <= max_bytes


def prepared_map(symbol_map: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The map with disjoint intervals, and whether it takes at most ``max_bytes``.

    Intervals of an instrument that meet or overlap and give the same symbol (and
    the same of all other columns) become one, as when the maps of several raw
    files are united.  Intervals that overlap and differ are an error.  One job
    checks all; a map of disjoint intervals is used as it is.
    """
    keys = [name for name in ("source_file", "instrument_id") if name in symbol_map.columns]
    said = [name for name in symbol_map.columns if name not in (*keys, "start_date", "end_date")]
    # one exchange, by the instrument, serves all that follows
    rows = symbol_map.where(F.col("start_date") < F.col("end_date")).repartition(*keys).distinct()
    so_far = Window.partitionBy(*keys, *said).orderBy("start_date", "end_date")
    reached = F.max("end_date").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached >= F.col("start_date"), 0).otherwise(1)
    runs = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(so_far))
    united = runs.groupBy(*keys, *said, "_run").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    clashes = F.max("end_date").over(before) > F.col("start_date")
    found = (
        united.withColumn("_clash", clashes)
        .agg(
            F.count_if("_clash").alias("n"),
            F.min(F.when(F.col("_clash"), F.col("instrument_id"))).alias("at"),
            F.max("_n").alias("joined"),
            _size(united.drop("_n", "_run")).alias("bytes"),
        )
        .first()
    )
    if found.n:
        raise ValueError(f"mappings of instrument {found.at} overlap, {found.n} in all")
    if (found.joined or 1) > 1:
        symbol_map = united.select(*symbol_map.columns)
    return symbol_map, found.bytes <= max_bytes


def lookup(
    rows: DataFrame,
    table: DataFrame,
    condition: Callable[[DataFrame, DataFrame], Column],
    how: str,
    small: bool,
    spread: tuple[str, ...] = ("ts_event_ns", "sequence", "order_id"),
) -> DataFrame:
    """Join ``rows`` to ``table`` by broadcast if that is ``small``, else salted.

    ``small`` must come from :func:`fits`.  ``spread`` names columns of ``rows``
    that differ within a hot key.  ``condition`` must hold an equality, so that
    neither way is a nested loop.
    """
    if small:
        return rows.join(F.broadcast(table), condition(rows, table), how)
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(copies, condition(salted, copies) & (salted[_SALT] == copies["_copy"]), how)
    return joined.drop(_SALT, "_copy")


def map_symbols(
    records: DataFrame,
    symbol_map: DataFrame,
    at: str = "ts_recv_ns",
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """Symbol valid for a record's instrument on the record's date.

    The date is that of ``at``, the receive time, by which the feed indexes its
    order-book records.  Records without a valid mapping are dropped (``how`` =
    "left" keeps them with a NULL symbol).  Repeated rows of the map count once,
    intervals of one symbol are united, and those of an instrument that overlap
    otherwise are an error.  A map with a ``source_file`` column holds the mappings
    of each raw file and applies to the records of that file only.  Other columns
    of the map come along.  A caller that has a :func:`prepared_map` may pass it
    with what was said of its size as ``small``.
    """
    if small is None:
        symbol_map, small = prepared_map(symbol_map, max_bytes)
    keys = [name for name in ("source_file", "instrument_id") if name in symbol_map.columns]
    table = symbol_map.dropDuplicates([*keys, "start_date", "end_date"]).withColumnsRenamed(
        {"instrument_id": "_instrument", "start_date": "_start", "end_date": "_end", "source_file": "_file"}
    )

    def valid(r: DataFrame, t: DataFrame) -> Column:
        same = (r["instrument_id"] == t["_instrument"]) & (r["_day"] >= t["_start"]) & (r["_day"] < t["_end"])
        return same & (r["source_file"] == t["_file"]) if "_file" in t.columns else same

    joined = lookup(records.withColumn("_day", date_of(F.col(at))), table, valid, how, small)
    return joined.drop("_day", "_instrument", "_start", "_end", "_file")


def _listed(ticks: DataFrame, allowlist: DataFrame, how: str, max_bytes: int) -> DataFrame:
    table = allowlist.select(F.col("symbol").alias("_listed"))
    return lookup(
        ticks,
        table,
        lambda r, t: F.upper(r["symbol"]) == t["_listed"],
        how,
        fits(table, max_bytes),
    )


def allowed(ticks: DataFrame, allowlist: DataFrame | None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Ticks whose symbol is listed in any case; all of them without a list."""
    return ticks if allowlist is None else _listed(ticks, allowlist, "left_semi", max_bytes)


def rejected(ticks: DataFrame, allowlist: DataFrame | None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Counterpart of :func:`allowed`."""
    return ticks.where(F.lit(False)) if allowlist is None else _listed(ticks, allowlist, "left_anti", max_bytes)


def flag_allowed(symbol_map: DataFrame, allowlist: DataFrame | None) -> DataFrame:
    """Symbol map with a ``keep`` column: the allow-list applied to the map.

    Filtering a few thousand map rows instead of every tick saves a second join
    in the load, and lets one pass count kept and skipped records.
    """
    if allowlist is None:
        return symbol_map.withColumn("keep", F.lit(True))
    listed = allowlist.select(F.col("symbol").alias("_listed")).distinct()
    return symbol_map.join(listed, F.upper(symbol_map["symbol"]) == listed["_listed"], "left").select(
        *symbol_map.columns, F.col("_listed").isNotNull().alias("keep")
    )
