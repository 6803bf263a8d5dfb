"""Load: raw records to the partitioned tick table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators.filters import of_rtypes
from ..operators.lookup import BROADCAST_BYTES, flag_allowed, map_symbols, prepared_map
from ..schema import TABLE_PARTITIONS, TICK, TICK_COLUMNS, TIME_FIELDS, TIMES
from ..sources import commits, folders
from ..sources.raw import read_raw_files
from . import facts, rollup

CONCURRENT_FILES = 2


def mapped(
    raw: DataFrame,
    symbol_map: DataFrame,
    allowlist: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """Order-book records with their symbol and whether the allow-list keeps them."""
    return _flagged(of_rtypes(raw, ("mbo",)), symbol_map, allowlist, "inner", max_bytes, small)


def _flagged(
    records: DataFrame,
    symbol_map: DataFrame,
    allowlist: DataFrame | None,
    how: str,
    max_bytes: int,
    small: bool | None = None,
) -> DataFrame:
    if small is None:
        # flagging adds no rows to the map, so the plain one is checked
        symbol_map, small = prepared_map(symbol_map, max_bytes)
    return map_symbols(records, flag_allowed(symbol_map, allowlist), how=how, small=small)


def as_ticks(records: DataFrame, null_undefined: bool = False) -> DataFrame:
    """Tick columns of mapped records."""
    derived = {
        "price": text.scale_price(F.col("price_raw"), null_undefined),
        "action": text.ascii_code(F.col("action_code")),
        "side": text.ascii_code(F.col("side_code")),
    }
    return records.select(
        *(
            derived.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
            for field in TICK.fields
        )
    )


def normalize(
    raw: DataFrame,
    symbol_map: DataFrame,
    allowlist: DataFrame | None = None,
    null_undefined: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Raw records to ticks: type filter, symbol mapping, allow-list, scaling."""
    return as_ticks(mapped(raw, symbol_map, allowlist, max_bytes).where(F.col("keep")), null_undefined)


def ingest_summary(
    raw: DataFrame, symbol_map: DataFrame, allowlist: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows kept and skipped by the allow-list per source file.

    Unmapped and other records count as neither, but their file is listed.
    """
    book = F.col("rtype") == "mbo"
    known = _flagged(raw, symbol_map, allowlist, "left", max_bytes)
    return known.groupBy("source_file").agg(
        F.count_if(book & F.col("keep")).alias("rows_kept"),
        F.count_if(book & ~F.col("keep")).alias("rows_skipped"),
    )


def ingest_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.coalesce(F.sum("rows_kept"), F.lit(0).cast("bigint")).alias("total_rows"),
        F.coalesce(F.sum("rows_skipped"), F.lit(0).cast("bigint")).alias("total_skipped"),
        F.count("*").alias("files"),
    )


def pending_files(files: DataFrame, ticks: DataFrame) -> DataFrame:
    """Files of dates that have no ticks yet; files without a date are always pending.

    One tick of any symbol marks its date as loaded.  :func:`pending_loads` is
    the stricter rule, by file.  Only the candidates' own dates, a calendar's
    worth at most, are looked for, which leaves other folders unread.
    """
    dated = files.withColumn("_date", text.date_from_filename(F.col("file_name")))
    days = [row["_date"] for row in dated.select("_date").where(F.col("_date").isNotNull()).distinct().collect()]
    date = (F.col("date") if "date" in ticks.columns else clock.date_of(F.col("ts_event_ns"))).cast("string")
    loaded = ticks.where(date.isin(sorted(days))).select(date.alias("_loaded")).distinct()
    return dated.join(F.broadcast(loaded), dated["_date"] == loaded["_loaded"], "left_anti").drop("_date")


# Hexadecimal digits of the path's hash that tell files of one name apart.
_PATH_DIGITS = 12


def load_name(spark: SparkSession, path: str) -> str:
    """Name of a file's load: its own, and a hash of its full path."""
    full = folders.qualified(spark, path)
    return f"{full.rsplit('/', 1)[-1]}-{hashlib.sha256(full.encode()).hexdigest()[:_PATH_DIGITS]}"


def pending_loads(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files (with their full ``path``) of which no rows are in the table, by the ``load`` partition column.

    Where all files carry a date in their name and loads keep to it, filter the
    table to those dates first.
    """
    loaded = table.select(F.col("load").alias("_load")).distinct()
    named = files.withColumn(
        "_name", F.concat("file_name", F.lit("-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, _PATH_DIGITS))
    )
    return named.join(loaded, named["_name"] == loaded["_load"], "left_anti").drop("_name")


def pending_in_log(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Files (with their full ``path``) that no committed load of the table has loaded; no tick is read.

    A file of which nothing was kept is loaded too.  A table that is not there
    yet has loaded nothing.
    """
    names = [
        (folders.plain_name(name),) for name, kinds in (commits.entries(spark, root) or {}).items() if kinds["version"]
    ]
    loaded = spark.createDataFrame(names, "_load string")
    path = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, _PATH_DIGITS)
    named = files.withColumn("_name", F.concat("file_name", F.lit("-"), path))
    return named.join(loaded, named["_name"] == loaded["_load"], "left_anti").drop("_name")


def with_partitions(ticks: DataFrame) -> DataFrame:
    """Tick columns, the times as timestamps, and the table's ``date`` and ``hour``."""
    ns = F.col("ts_event_ns")
    times = [clock.timestamp_of(F.col(f"{name}_ns")).alias(name) for name in TIMES]
    return ticks.select(*TICK_COLUMNS, *times, clock.date_of(ns).alias("date"), clock.hour_of(ns).alias("hour"))


# Hours since the epoch, modulo the bits of one of Spark's bitmaps, mark what a load has written.
_BITS = 32_768
_NO_PART = "__HIVE_DEFAULT_PARTITION__"


def append_ticks(
    ticks: DataFrame,
    root: str,
    load: str,
    hourly: bool = True,
    max_records_per_file: int = 0,
    time_ordered: bool = False,
    table: str | None = None,
    with_facts: bool = False,
    bars_every: str | None = None,
    bloom: Sequence[str] = (),
) -> None:
    """Append ticks to the table under ``root`` as the load named ``load``.

    Rows go to ``date=/hour=/load=`` folders; unless ``hourly``, to
    ``date=/load=`` folders, which suits tables of few rows a day.  A table keeps
    to one of the two.  The load counts from its commit on (see
    :mod:`..sources.commits`): scans see all of it or nothing, whenever its job
    dies.  A load that is run again replaces what it gave before, also in folders
    that it gives no rows any more, and nothing else.  Of two attempts at one
    load that run at the same time the second to finish is an error, and leaves
    nothing behind.  Rows are sorted by symbol and time inside each file, so the
    column index finds a symbol's pages.  A ``table`` of the catalog over this
    root (see :func:`ensure_table`) learns of the load's own folders.
    ``with_facts`` reads the written symbols and times once more, to note what
    the load holds (see :mod:`.facts`); ``bars_every``, say ``1m``, reads the
    trades for partial bars of that width (see :mod:`.rollup`).  Columns named by
    ``bloom`` get Bloom filters, at most 1 MB for each column of a row group: a
    search for one value (see :func:`..operators.filters.for_order`) skips row
    groups whose values the files' order leaves mixed.

    The rebalance lets AQE cut a hot hour into several tasks and merge thin ones.
    If the rows come in feed order, each task holds a short stretch of time
    already: ``time_ordered`` then saves the exchange, and a hot hour is spread
    as its bytes are.  With rows in any other order it would leave many small
    files.
    """
    spark = ticks.sparkSession
    parts = ["date", "hour"] if hourly else ["date"]
    base = root.rstrip("/")
    _check_layout(spark, base, hourly)
    attempt, version = commits.begin(spark, base, load)
    value = commits.value_of(load, attempt)
    ns = F.col("ts_event_ns")
    hour = F.pmod(clock.floor_div(ns, clock.HOUR), F.lit(_BITS)) + 1
    seen = Observation()
    rows = with_partitions(ticks).observe(
        seen,
        F.count("*").alias("rows"),
        F.count_if(ns.isNull()).alias("untimed"),
        F.min(ns).alias("first_ns"),
        F.max(ns).alias("last_ns"),
        F.hex(F.bitmap_construct_agg(F.bitmap_bit_position(hour))).alias("hours"),
    )
    if not hourly:
        rows = rows.drop("hour")
    rows = rows.withColumn("load", F.lit(value))
    if not time_ordered:
        rows = rows.hint("rebalance", *(F.col(name) for name in parts))
    blooms = {f"parquet.bloom.filter.enabled#{name}": "true" for name in bloom}
    if blooms:
        blooms["parquet.bloom.filter.adaptive.enabled"] = "true"
    # the folders are the attempt's own; this mode also keeps what several writers have not put in place yet apart
    (
        rows.sortWithinPartitions(*parts, "load", "symbol", "ts_event_ns", "sequence")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .options(**blooms)
        .partitionBy(*parts, "load")
        .parquet(root)
    )
    done = commits.Commit(load, version, attempt, **_written(seen, hourly))
    if with_facts and done.rows:
        facts.write(spark, base, done)
        done = replace(done, facts=True)
    if bars_every and done.rows:
        rollup.write(spark, base, done, bars_every)
        done = replace(done, bars=bars_every)
    try:
        commits.commit(spark, base, done)
    except RuntimeError:
        _remove(spark, base, done, hourly)
        raise
    earlier = {c.attempt: c for c in commits.versions(spark, base, load)} if version else {}
    stale = commits.unremoved(spark, base, done)
    if table is not None:
        register(spark, table, [done], [earlier.get(k, commits.Commit(load, -1, k, None)) for k in stale], hourly)
    for k in stale:
        _remove(spark, base, earlier.get(k, commits.Commit(load, -1, k, None)), hourly)
        commits.removed(spark, base, load, k)


def _check_layout(spark: SparkSession, base: str, hourly: bool) -> None:
    """An error if the table has the other layout; a table without a log gets one."""
    names = folders.children(spark, base) or ()
    days = [name for name in names if name.startswith("date=")]
    if not days:
        return
    inside = folders.children(spark, f"{base}/{days[0]}") or ()
    if any(name.startswith("load=" if hourly else "hour=") for name in inside):
        raise ValueError(f"the table under {base} is {'not ' if hourly else ''}cut into hours")
    if commits.LOG not in names:
        there = folders.matching(spark, f"{base}/date=*/{'hour=*/' if hourly else ''}load=*")
        commits.adopt(spark, base, sorted({folders.plain_name(path.rpartition("/load=")[2]) for path in there}))


def _written(seen: Observation, hourly: bool) -> dict:
    """What a write was observed to hold, and the (date, hour) folders it may have made."""
    try:
        found = seen.get
    except Py4JJavaError:  # nothing was left to write, and the observed plan was dropped with it
        return {"parts": [], "rows": 0}
    spans: list[tuple[str | None, int | None]] = []
    if found["first_ns"] is not None:
        bits = bytes.fromhex(found["hours"])
        first, last = found["first_ns"] // clock.HOUR, found["last_ns"] // clock.HOUR
        for n in range(first, last + 1):
            place = n % _BITS
            if bits[place // 8] >> place % 8 & 1:
                spans.append((clock.date_of_ns(n * clock.HOUR).isoformat(), n % 24 if hourly else None))
    if found["untimed"]:
        spans.append((None, None))
    parts = list(dict.fromkeys(spans))
    return {"parts": parts, "rows": found["rows"], "first_ns": found["first_ns"], "last_ns": found["last_ns"]}


def _folders(spark: SparkSession, base: str, done: commits.Commit, hourly: bool) -> list[str]:
    """The folders that an attempt wrote; of one whose folders are not known, those that a search of the table finds."""
    own = f"load={folders.folder_name(done.value)}"
    if done.parts is None:
        return folders.matching(spark, f"{base}/date=*/{'hour=*/' if hourly else ''}{own}")
    return [f"{base}/{_part(date, hour, hourly)}/{own}" for date, hour in done.parts]


def _part(date: str | None, hour: int | None, hourly: bool) -> str:
    day = f"date={date or _NO_PART}"
    return f"{day}/hour={_NO_PART if hour is None else hour}" if hourly else day


def _remove(spark: SparkSession, base: str, done: commits.Commit, hourly: bool) -> None:
    for path in [*_folders(spark, base, done, hourly), facts.path_of(base, done), rollup.path_of(base, done)]:
        folders.delete(spark, path)


def register(
    spark: SparkSession, table: str, new: Sequence[commits.Commit], old: Sequence[commits.Commit], hourly: bool
) -> None:
    """Add the folders of new versions to a catalog table, and take out those of attempts that no longer count."""

    def text(value: object) -> str:
        return "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    for done in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (load={text(done.value)})")
    for done in new:
        specs = [
            ", ".join([f"date={text(date)}", *([f"hour={text(hour)}"] if hourly else []), f"load={text(done.value)}"])
            for date, hour in done.parts or ()
        ]
        for at in range(0, len(specs), 100):
            some = " ".join(f"PARTITION ({spec})" for spec in specs[at : at + 100])
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {some}")


def ensure_table(spark: SparkSession, name: str, root: str, hourly: bool = True) -> None:
    """Create the tick table over ``root`` in the session catalog if absent, with what is there already.

    Before the first load there is no folder yet: the table has no rows then.
    """
    parts = [field for field in TABLE_PARTITIONS.fields if hourly or field.name != "hour"]
    columns = ", ".join(
        f"{field.name} {field.dataType.simpleString()}" for field in [*TICK.fields, *TIME_FIELDS, *parts]
    )
    by = ", ".join(field.name for field in parts)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({by}) LOCATION :root",
        args={"root": root},
    )
    if folders.children(spark, root) is None:
        return
    spark.catalog.recoverPartitions(name)
    for value in commits.hidden(spark, root.rstrip("/"))[0]:
        register(spark, name, [], [commits.Commit(re.sub(commits.NUMBERED, "", value), -1, _attempt(value), None)], hourly)


def _attempt(value: str) -> int:
    return int(value.rpartition(commits.AGAIN)[2]) if re.search(commits.NUMBERED, value) else 0


@dataclass(frozen=True)
class FileLoad:
    """Outcome of one file: rows kept and skipped, or the error."""

    file: str
    rows_kept: int = 0
    rows_skipped: int = 0
    error: str | None = None


def load_file(
    spark: SparkSession,
    path: str,
    root: str,
    symbol_map: DataFrame,
    allowlist: DataFrame | None = None,
    hourly: bool = True,
    time_ordered: bool = False,
    small: bool | None = None,
    table: str | None = None,
    with_facts: bool = False,
    bars_every: str | None = None,
    bloom: Sequence[str] = (),
) -> FileLoad:
    """Load one raw file (or folder of part files) in one pass.

    Kept and skipped rows are counted while the file is written, not by a
    second read.  A load counts once it is committed; one that dies before is
    as if it had not been, and is run again.  ``time_ordered`` says that the file
    is in feed order (see :func:`append_ticks`).
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    counts = [F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("skipped")]
    seen = Observation()
    try:
        if small is None:
            symbol_map, small = prepared_map(symbol_map)
        records = mapped(read_raw_files(spark, [path]), symbol_map, allowlist, small=small)
        kept = records.observe(seen, *counts).where(F.col("keep"))
        # a salted mapping loses the order of the file
        load = load_name(spark, path)
        append_ticks(
            as_ticks(kept),
            root,
            load,
            hourly,
            time_ordered=time_ordered and small,
            table=table,
            with_facts=with_facts,
            bars_every=bars_every,
            bloom=bloom,
        )
        try:
            found = seen.get
        except Py4JJavaError:  # nothing was kept, and the observed plan was dropped with it
            found = records.agg(*counts).first().asDict()
    except Exception as failure:  # one file's failure must not stop the others
        return FileLoad(name, error=(str(failure) or repr(failure)).splitlines()[0])
    return FileLoad(name, found["kept"], found["skipped"])


def load_files(
    spark: SparkSession,
    paths: Sequence[str],
    root: str,
    symbol_map: DataFrame,
    allowlist: DataFrame | None = None,
    hourly: bool = True,
    time_ordered: bool = False,
    concurrency: int = CONCURRENT_FILES,
    table: str | None = None,
    with_facts: bool = False,
    bars_every: str | None = None,
    bloom: Sequence[str] = (),
) -> list[FileLoad]:
    """Load files as separate Spark jobs, a few at a time, and report on each.

    A file may not be listed twice: its two loads would replace each other.
    """
    if len({load_name(spark, path) for path in paths}) < len(paths):
        raise ValueError("a file is listed twice")
    symbol_map, small = prepared_map(symbol_map)

    def one(path: str) -> FileLoad:
        return load_file(
            spark, path, root, symbol_map, allowlist, hourly, time_ordered, small, table, with_facts, bars_every, bloom
        )

    with ThreadPoolExecutor(max_workers=concurrency) as jobs:
        return list(jobs.map(one, paths))


def load_totals(loads: Sequence[FileLoad]) -> dict[str, int]:
    """Rows loaded, files that succeeded, files that failed."""
    failed = sum(1 for load in loads if load.error is not None)
    return {
        "total_rows": sum(load.rows_kept for load in loads),
        "files_ok": len(loads) - failed,
        "files_failed": failed,
    }

