"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import clock, text
from .operators import bars as bar_ops
from .operators import catalog, filters, lookup, pages
from .plans import adhoc, batches, export, facts, load, outputs, rollup
from .schema import RAW_ORDER, RAW_RTYPES, TICK, TICK_COLUMNS
from .session import work_dir
from .sources import folders, samples
from .sources import raw as raw_source
from .sources import ticks as tick_source
from .streaming.load import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Arguments of the sample queries.
SYMBOL = "S00007"
PART = "P7"
START, END = "2024-01-05", "2024-01-20"
DAY = "2024-01-09"
MID = "2024-01-15T12:00:00Z"

# (time, sequence) is unique among event ticks; see FIXTURES.md.
EVENT_ORDER = ("ts_event_ns", "sequence")


def query(build: Query) -> Query:
    """Register a query under its function's name.

    Results carry timestamps without zone, as the same SQL elsewhere would.
    """

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        result = build(spark, sf_dir)
        zoned = [f.name for f in result.schema.fields if isinstance(f.dataType, T.TimestampType)]
        return result.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned}) if zoned else result

    QUERIES[build.__name__] = run
    return run


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.event_ticks(spark, sf_dir)


def _allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_source.clean_allowlist(samples.allowlist_lines(spark, sf_dir))


# Tables written once per application and input, in the shared work folder.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        root = work_dir(spark, name)
        write(_ticks(spark, sf_dir), root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def _table(spark: SparkSession, sf_dir: str) -> str:
    """The event ticks as a loaded tick table, in daily folders."""
    return _written(
        spark, sf_dir, "table", lambda ticks, root: load.append_ticks(ticks, root, load="events", hourly=False)
    )


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of the event ticks loaded into the hourly layout, the usual one."""
    root = _written(spark, sf_dir, "hourly", lambda ticks, root: load.append_ticks(ticks, root, load="events"))
    return tick_source.scan_table(spark, root)


def _exports(spark: SparkSession, sf_dir: str) -> str:
    return _written(spark, sf_dir, "exports", export.export_slots)


def _own_exports(spark: SparkSession, sf_dir: str) -> str:
    """Exports of one symbol for some dates, told apart by their flags."""

    def write(ticks: DataFrame, root: str) -> None:
        marked = ticks.withColumn("flags", F.lit(999))
        export.export_slots(marked, root, "2024-01-07", "2024-01-12", symbol=SYMBOL)

    return _written(spark, sf_dir, "own-exports", write)


# --- scans ----------------------------------------------------------------


@query
def scan_ticks(spark, sf_dir):
    return tick_source.scan_table(spark, _table(spark, sf_dir)).select(*TICK_COLUMNS)


@query
def scan_by_date(spark, sf_dir):
    # a single date wins over a range
    rows = tick_source.scan_table(spark, _table(spark, sf_dir), date=DAY, start=START, end=END)
    return rows.select(*TICK_COLUMNS)


@query
def scan_by_date_range(spark, sf_dir):
    # the range reaches beyond the data; missing dates are skipped
    rows = tick_source.scan_table(spark, _table(spark, sf_dir), start="2024-01-25", end="2024-03-01")
    return rows.select("date", *TICK_COLUMNS)


@query
def scan_symbol_preferred(spark, sf_dir):
    rows = tick_source.scan_exports(
        spark,
        _exports(spark, sf_dir),
        start=START,
        end=END,
        symbol=SYMBOL,
        symbol_root=_own_exports(spark, sf_dir),
    )
    return rows.select("date", "slot", *TICK_COLUMNS)


@query
def slice_ticks(spark, sf_dir):
    return pages.slice_ticks(_ticks(spark, sf_dir), START, END)


@query
def slice_ticks_symbol(spark, sf_dir):
    return pages.slice_ticks(_ticks(spark, sf_dir), START, END, SYMBOL)


@query
def union_days(spark, sf_dir):
    return tick_source.union_ticks([_ticks(spark, sf_dir), samples.line_ticks(spark, sf_dir)])


@query
def raw_mbo_only(spark, sf_dir):
    return filters.of_rtypes(samples.raw_records(spark, sf_dir), ("mbo",))


@query
def raw_range_read(spark, sf_dir):
    start, end = clock.as_ns("2024-01-10T06:00:00Z"), clock.as_ns("2024-01-10T18:00:00Z")
    return filters.raw_range(samples.raw_records(spark, sf_dir), start, end, RAW_RTYPES, RAW_ORDER)


@query
def raw_range_payloads(spark, sf_dir):
    """Records of all families in a range, read from raw files with what each family says."""
    key = (spark.sparkContext.applicationId, sf_dir, "families")
    if key not in _WRITTEN:
        folder = work_dir(spark, "families")
        records = samples.raw_families(spark, sf_dir).drop("source_file")
        records.write.parquet(f"{folder}/feed.mbo.parquet")
        _WRITTEN[key] = folder
    raw = raw_source.read_raw(spark, _WRITTEN[key], payloads=True)
    start, end = clock.as_ns("2024-01-10T06:00:00Z"), clock.as_ns("2024-01-12T18:00:00Z")
    rows = filters.raw_range(raw, start, end, RAW_RTYPES, RAW_ORDER)
    level, last = F.col("levels")[0], F.element_at("levels", -1)
    return rows.select(
        "source_file",
        "rtype",
        "ts_event_ns",
        "order_id",
        "price_raw",
        "depth",
        F.when(F.col("levels").isNotNull(), F.size("levels")).alias("n_levels"),
        level["bid_px"].alias("best_bid"),
        level["ask_px"].alias("best_ask"),
        last["ask_px"].alias("last_ask"),
        last["bid_sz"].alias("last_size"),
        *(F.col(f"bar.{name}").alias(name) for name in ("open", "high", "low", "close", "volume")),
        F.variant_get("definition", "$.raw_symbol", "string").alias("raw_symbol"),
        F.variant_get("definition", "$.min_price_increment", "bigint").alias("min_price_increment"),
    )


@query
def load_allowlist(spark, sf_dir):
    return _allowlist(spark, sf_dir)


# --- filters and pages ----------------------------------------------------


@query
def filter_symbol(spark, sf_dir):
    return filters.for_symbol(_ticks(spark, sf_dir), SYMBOL).select(*TICK_COLUMNS)


@query
def filter_trades(spark, sf_dir):
    return filters.trades(_ticks(spark, sf_dir)).select(*TICK_COLUMNS)


@query
def filter_time_range(spark, sf_dir):
    rows = filters.time_range(_ticks(spark, sf_dir), "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return rows.select(*TICK_COLUMNS)


@query
def ticks_page(spark, sf_dir):
    return pages.ticks_page(_ticks(spark, sf_dir), SYMBOL, START, END, limit=20)


@query
def ticks_page_offset(spark, sf_dir):
    return pages.ticks_page(_ticks(spark, sf_dir), SYMBOL, START, END, limit=10, offset=5)


@query
def ticks_page_ties(spark, sf_dir):
    return pages.ticks_page(samples.line_ticks(spark, sf_dir), PART, "1990-01-01", "2010-01-01", limit=5, offset=10)


@query
def ticks_page_deep(spark, sf_dir):
    # a small bound makes the page look for its beginning first
    lines = samples.line_ticks(spark, sf_dir)
    return pages.ticks_page(lines, PART, "1990-01-01", "2010-01-01", limit=5, offset=10, direct_rows=8)


@query
def ticks_page_after(spark, sf_dir):
    lines = samples.line_ticks(spark, sf_dir)
    first = pages.ticks_page(lines, PART, "1990-01-01", "2010-01-01", limit=10, keyed=True).select("key").collect()
    return pages.ticks_page(lines, PART, "1990-01-01", "2010-01-01", limit=5, after=first[-1]["key"].asDict())


@query
def page_summary(spark, sf_dir):
    return pages.page_summary(_ticks(spark, sf_dir), SYMBOL, START, END, limit=10)


@query
def head_n(spark, sf_dir):
    return pages.head(_ticks(spark, sf_dir).select(*TICK_COLUMNS), ordered=True)


@query
def latest_n(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    newest = ticks.agg(F.max("ts_event_ns").alias("newest")).scalar()
    return pages.latest(ticks, SYMBOL, within_ns=5 * clock.DAY, anchor_ns=newest)


# --- bars -----------------------------------------------------------------


def _bars_query(resolution: str) -> None:
    def build(spark, sf_dir):
        return bar_ops.bars(_ticks(spark, sf_dir), resolution, order=EVENT_ORDER)

    build.__name__ = f"bars_{resolution}"
    query(build)


for _resolution in clock.RESOLUTIONS:
    _bars_query(_resolution)


@query
def bars_1d_ties(spark, sf_dir):
    return bar_ops.bars(samples.line_ticks(spark, sf_dir), "1d", order=samples.LINE_ORDER)


@query
def bars_auto(spark, sf_dir):
    return bar_ops.bars_for(_ticks(spark, sf_dir), SYMBOL, START, END, order=EVENT_ORDER)


@query
def bars_for_5m(spark, sf_dir):
    return bar_ops.bars_for(_ticks(spark, sf_dir), SYMBOL, START, END, "5m", order=EVENT_ORDER)


@query
def bars_all_symbols(spark, sf_dir):
    return bar_ops.merged_bars(_ticks(spark, sf_dir), "1h", order=EVENT_ORDER)


@query
def bars_interval_7m(spark, sf_dir):
    return bar_ops.merged_bars(_ticks(spark, sf_dir), "7M", order=EVENT_ORDER)


@query
def bars_defaults(spark, sf_dir):
    # prices of up to 20 count as missing, so some bars have none at all
    ticks = _ticks(spark, sf_dir).withColumn("price", F.when(F.col("price") > 20, F.col("price")))
    return bar_ops.with_defaults(bar_ops.bars(ticks, "1d", order=EVENT_ORDER, count_col="price"))


# --- catalog --------------------------------------------------------------


@query
def symbols(spark, sf_dir):
    return catalog.symbols(_ticks(spark, sf_dir))


@query
def data_range(spark, sf_dir):
    return catalog.data_range(_ticks(spark, sf_dir), SYMBOL)


@query
def data_range_missing(spark, sf_dir):
    return catalog.data_range(_ticks(spark, sf_dir))


@query
def data_range_all(spark, sf_dir):
    return catalog.data_ranges(_ticks(spark, sf_dir))


@query
def count_by_date(spark, sf_dir):
    return catalog.count_by_date(_ticks(spark, sf_dir))


@query
def count_by_date_hour(spark, sf_dir):
    return catalog.count_by_date_hour(_ticks(spark, sf_dir))


@query
def count_symbol_between(spark, sf_dir):
    return catalog.count_between(_ticks(spark, sf_dir), SYMBOL, "2024-01-08T00:00:00Z", "2024-01-16T00:00:00Z")


@query
def count_by_symbol(spark, sf_dir):
    return catalog.count_by_symbol(_ticks(spark, sf_dir))


# --- ad-hoc SQL -----------------------------------------------------------


@query
def sql_count_by_symbol(spark, sf_dir):
    text_ = "SELECT symbol, COUNT(*) AS cnt FROM df GROUP BY symbol ORDER BY cnt DESC"
    return adhoc.sql(tick_source.scan_table(spark, _table(spark, sf_dir)), text_)


@query
def sql_filtered_view(spark, sf_dir):
    text_ = (
        "SELECT date, action, COUNT(*) AS cnt, MAX(price) AS high FROM df "
        "WHERE date >= :start AND date < :end GROUP BY date, action"
    )
    args = {"start": clock.as_date(START), "end": clock.as_date(END)}
    return adhoc.sql(tick_source.scan_table(spark, _table(spark, sf_dir)), text_, symbol=SYMBOL, args=args)


# --- load -----------------------------------------------------------------


@query
def map_symbols(spark, sf_dir):
    raw = samples.raw_records(spark, sf_dir)
    mapped = lookup.map_symbols(raw, samples.symbol_map(spark, sf_dir))
    return mapped.select("source_file", "rtype", "ts_event_ns", "instrument_id", "order_id", "symbol")


@query
def allowlist_semi(spark, sf_dir):
    return lookup.allowed(_ticks(spark, sf_dir).select(*TICK_COLUMNS), _allowlist(spark, sf_dir))


@query
def allowlist_anti(spark, sf_dir):
    return lookup.rejected(_ticks(spark, sf_dir).select(*TICK_COLUMNS), _allowlist(spark, sf_dir))


def _load_inputs(spark, sf_dir):
    return (
        samples.raw_records(spark, sf_dir),
        samples.symbol_map(spark, sf_dir),
        _allowlist(spark, sf_dir),
    )


@query
def normalize_ticks(spark, sf_dir):
    return load.normalize(*_load_inputs(spark, sf_dir))


@query
def ingest_summary(spark, sf_dir):
    return load.ingest_summary(*_load_inputs(spark, sf_dir))


@query
def ingest_totals(spark, sf_dir):
    return load.ingest_totals(load.ingest_summary(*_load_inputs(spark, sf_dir)))


@query
def pending_files(spark, sf_dir):
    return load.pending_files(samples.candidate_files(spark, sf_dir), _ticks(spark, sf_dir))


@query
def map_symbols_overlap(spark, sf_dir):
    # maps of several files united hold a mapping more than once
    symbol_map = samples.symbol_map(spark, sf_dir)
    mapped = lookup.map_symbols(samples.raw_records(spark, sf_dir), symbol_map.union(symbol_map))
    return mapped.select("source_file", "rtype", "ts_event_ns", "instrument_id", "order_id", "symbol")


@query
def map_symbols_extended(spark, sf_dir):
    # another file's map has longer intervals of the same symbols, or goes on where they end
    symbol_map = samples.symbol_map(spark, sf_dir)
    longer = symbol_map.withColumn(
        "start_date", F.when(F.col("symbol").startswith("S"), F.date_sub("start_date", 40)).otherwise(F.col("start_date"))
    ).withColumn("end_date", F.when(F.col("symbol").startswith("T"), F.date_add("end_date", 40)).otherwise(F.col("end_date")))
    cut = F.to_date(F.lit("2024-01-05"))
    halves = symbol_map.withColumn("end_date", cut).union(symbol_map.withColumn("start_date", F.greatest("start_date", cut)))
    mapped = lookup.map_symbols(samples.raw_records(spark, sf_dir), symbol_map.union(longer).union(halves))
    return mapped.select("source_file", "rtype", "ts_event_ns", "instrument_id", "order_id", "symbol")


@query
def export_partial_slot(spark, sf_dir):
    """Two days exported, then part of one again, bounds within slots; the second export is told apart by its flags."""

    def write(ticks: DataFrame, root: str) -> None:
        export.export_slots(ticks, root, DAY, "2024-01-11")
        export.export_slots(ticks.withColumn("flags", F.lit(999)), root, f"{DAY}T10:05:00Z", f"{DAY}T13:20:00Z")

    root = _written(spark, sf_dir, "partial-exports", write)
    return tick_source.scan_exports(spark, root).select("date", "slot", *TICK_COLUMNS)


def _facts_root(spark: SparkSession, sf_dir: str) -> str:
    """A table of two loads with facts, one of which was run again with fewer rows."""

    def write(ticks: DataFrame, root: str) -> None:
        morning = clock.hour_of(F.col("ts_event_ns")) < 12
        load.append_ticks(ticks, root, load="feed", hourly=False, with_facts=True)
        load.append_ticks(ticks.where(morning), root, load="feed", hourly=False, with_facts=True)
        load.append_ticks(ticks.where(~morning), root, load="late", hourly=False, with_facts=True)

    return _written(spark, sf_dir, "facts", write)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table_facts(spark, _facts_root(spark, sf_dir))


@query
def facts_data_range(spark, sf_dir):
    return facts.data_range(_facts(spark, sf_dir), SYMBOL)


@query
def facts_data_range_all(spark, sf_dir):
    return facts.data_ranges(_facts(spark, sf_dir))


@query
def facts_count_by_date(spark, sf_dir):
    return facts.count_by_date(_facts(spark, sf_dir))


@query
def facts_count_by_symbol(spark, sf_dir):
    return facts.count_by_symbol(_facts(spark, sf_dir))


@query
def ticks_page_deep_indexed(spark, sf_dir):
    return facts.ticks_page(spark, _facts_root(spark, sf_dir), SYMBOL, START, END, limit=10, offset=12)


@query
def ticks_page_cut_indexed(spark, sf_dir):
    # bounds within days
    root = _facts_root(spark, sf_dir)
    return facts.ticks_page(spark, root, SYMBOL, f"{START}T07:30:00Z", f"{END}T13:20:00Z", limit=10, offset=9)


def _rollup(spark: SparkSession, sf_dir: str) -> str:
    """A table of three loads: one run again with fewer rows, two with partial bars of different widths, one with none."""

    def write(ticks: DataFrame, root: str) -> None:
        part = F.pmod("order_id", F.lit(3))
        load.append_ticks(ticks, root, load="feed", hourly=False, bars_every="1m")
        load.append_ticks(ticks.where(part == 0), root, load="feed", hourly=False, bars_every="1m")
        load.append_ticks(ticks.where(part == 1), root, load="late", hourly=False, bars_every="5m", bloom=("order_id",))
        load.append_ticks(ticks.where(part == 2), root, load="plain", hourly=False, bloom=("order_id",))

    return _written(spark, sf_dir, "rollup", write)


@query
def bars_rollup_1h(spark, sf_dir):
    return rollup.table_bars(spark, _rollup(spark, sf_dir), "1h")


@query
def bars_rollup_for_5m(spark, sf_dir):
    return rollup.bars_for(spark, _rollup(spark, sf_dir), SYMBOL, START, END, "5m")


@query
def bars_rollup_merged(spark, sf_dir):
    return rollup.merged_bars(spark, _rollup(spark, sf_dir), "1h")


@query
def bars_rollup_merged_7m(spark, sf_dir):
    # no multiple of five minutes: those bars are made from ticks
    return rollup.merged_bars(spark, _rollup(spark, sf_dir), "7m")


@query
def lookup_order(spark, sf_dir):
    rows = tick_source.scan_table(spark, _rollup(spark, sf_dir))
    return filters.for_order(rows, 302, 555, 700).select(*TICK_COLUMNS)


@query
def pending_in_log(spark, sf_dir):
    """Candidate files that no load of the table's log has loaded: here the feed's days up to the middle of the month."""

    def write(_, root):
        raw, symbol_map, _ = _load_inputs(spark, sf_dir)
        folder = work_dir(spark, "raw")
        for day in (f"202401{n:02d}" for n in (3, 9)):
            path = f"{folder}/feed-{day}.mbo.parquet"
            raw.where(F.col("source_file").contains(day)).drop("source_file").coalesce(1).write.parquet(path)
            load.load_file(spark, path, root, symbol_map, hourly=False)
        spark.createDataFrame([(folder,)], "folder string").write.parquet(f"{root}-folder")

    root = _written(spark, sf_dir, "logged", write)
    folder = spark.read.parquet(f"{root}-folder").first()[0]
    full = folders.qualified(spark, folder)
    files = samples.candidate_files(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{full}/"), "file_name"))
    return load.pending_in_log(spark, files, root).select("file_name")


@query
def load_two_folders(spark, sf_dir):
    """Two raw files of one name, in different folders."""

    def write(_, root):
        raw, symbol_map, allowlist = _load_inputs(spark, sf_dir)
        paths = [f"{work_dir(spark, 'raw')}/feed.mbo.parquet" for _ in range(2)]
        for part, path in enumerate(paths):
            raw.where(F.pmod("order_id", F.lit(2)) == part).drop("source_file").write.parquet(path)
        load.load_files(spark, paths, root, symbol_map, allowlist, hourly=False)

    return tick_source.scan_table(spark, _written(spark, sf_dir, "two-folders", write)).select(*TICK_COLUMNS)


@query
def load_again_fewer_hours(spark, sf_dir):
    """A load that is run again with the morning only."""

    def write(ticks, root):
        load.append_ticks(ticks, root, load="feed")
        load.append_ticks(ticks.where(clock.hour_of(F.col("ts_event_ns")) < 12), root, load="feed")

    rows = tick_source.scan_table(spark, _written(spark, sf_dir, "again", write))
    return rows.select("date", "hour", *TICK_COLUMNS)


# --- the loaded table, with default orders --------------------------------


@query
def table_hourly(spark, sf_dir):
    return _hourly(spark, sf_dir).select("date", "hour", *TICK_COLUMNS)


@query
def table_bars_1h(spark, sf_dir):
    return bar_ops.bars(_hourly(spark, sf_dir), "1h")


@query
def table_bars_auto(spark, sf_dir):
    return bar_ops.bars_for(_hourly(spark, sf_dir), SYMBOL, START, END)


@query
def table_merged_bars(spark, sf_dir):
    return bar_ops.merged_bars(_hourly(spark, sf_dir), "1h")


@query
def table_page(spark, sf_dir):
    return pages.ticks_page(_hourly(spark, sf_dir), SYMBOL, START, END, limit=10, offset=5)


@query
def table_range(spark, sf_dir):
    return catalog.data_range(_hourly(spark, sf_dir), SYMBOL)


@query
def table_count_by_date(spark, sf_dir):
    return catalog.count_by_date(_hourly(spark, sf_dir))


@query
def table_trades(spark, sf_dir):
    return filters.trades(_hourly(spark, sf_dir)).select(*TICK_COLUMNS)


@query
def filter_one_hour(spark, sf_dir):
    rows = filters.time_range(_hourly(spark, sf_dir), "2024-01-10T06:00:00Z", "2024-01-10T07:00:00Z")
    return rows.select("date", "hour", *TICK_COLUMNS)


@query
def sql_count_between(spark, sf_dir):
    text_ = (
        "SELECT COUNT(*) AS cnt FROM df WHERE symbol = :symbol "
        "AND ts_event BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-16 00:00:00'"
    )
    return adhoc.sql(_hourly(spark, sf_dir), text_, args={"symbol": SYMBOL})


@query
def sql_latest(spark, sf_dir):
    text_ = (
        "SELECT symbol, action, price, ts_event, ts_recv FROM df "
        "WHERE ts_event > (SELECT MAX(ts_event) FROM df) - INTERVAL 1 HOUR"
    )
    return adhoc.sql(_hourly(spark, sf_dir), text_)


@query
def pending_in_table(spark, sf_dir):
    return load.pending_files(samples.candidate_files(spark, sf_dir), _hourly(spark, sf_dir))


# --- export ---------------------------------------------------------------


@query
def export_roundtrip(spark, sf_dir):
    return tick_source.scan_exports(spark, _exports(spark, sf_dir)).select("date", "slot", *TICK_COLUMNS)


@query
def export_roundtrip_symbol(spark, sf_dir):
    rows = tick_source.read_symbol_exports(spark, _own_exports(spark, sf_dir), SYMBOL)
    return rows.select("date", "slot", *TICK_COLUMNS)


@query
def export_manifest(spark, sf_dir):
    return export.export_manifest(spark, _exports(spark, sf_dir))


@query
def export_totals(spark, sf_dir):
    return export.export_totals(export.export_manifest(spark, _exports(spark, sf_dir)))


@query
def export_one_slot(spark, sf_dir):
    slots = tick_source.scan_exports(spark, _exports(spark, sf_dir))
    rows = filters.time_range(slots, "2024-01-10T06:15:00Z", "2024-01-10T06:30:00Z")
    return rows.select("date", "slot", *TICK_COLUMNS)


@query
def line_protocol(spark, sf_dir):
    return outputs.line_protocol_rows(_ticks(spark, sf_dir))


def _line_batches(spark, sf_dir, file, **bounds):
    order = [F.col(name) for name in EVENT_ORDER]
    lines = batches.batched_lines(_ticks(spark, sf_dir), file, order, text.line_protocol(F.col("symbol")), **bounds)
    whole = batches.batch_texts(lines)
    return whole.select("file", "batch", "rows", "bytes", F.md5("text").alias("text_md5"))


@query
def line_batches(spark, sf_dir):
    """All ticks as one file, in batches of the usual size."""
    return _line_batches(spark, sf_dir, F.lit("events"))


@query
def line_batches_daily(spark, sf_dir):
    """One file a day, in batches that both bounds end; slices are shorter than days."""
    day = clock.date_of(F.col("ts_event_ns"))
    return _line_batches(spark, sf_dir, day, max_bytes=4_000, max_rows=21, slice_rows=50)


# --- raw folders, the catalog and results as files ------------------------


def _raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """All raw records in a folder, one raw file (of part files) for each day, and files that are not raw ones."""

    def write(_, root):
        raw = samples.raw_records(spark, sf_dir).withColumn("feed", F.col("source_file")).drop("source_file")
        raw.repartition("feed").write.partitionBy("feed").parquet(root)

    return _written(spark, sf_dir, "raw-folder", write)


@query
def raw_files(spark, sf_dir):
    return raw_source.raw_files(spark, _raw_folder(spark, sf_dir)).select("file_name")


@query
def stream_load(spark, sf_dir):
    """Every raw file loaded once, eight a batch, by two runs of one stream."""

    def write(_, root):
        _, symbol_map, allowlist = _load_inputs(spark, sf_dir)
        folder, checkpoint = _raw_folder(spark, sf_dir), work_dir(spark, "stream")
        for _ in range(2):
            stream = ingest_stream(spark, folder, root, checkpoint, symbol_map, allowlist, hourly=False, max_files=8)
            stream.awaitTermination()

    root = _written(spark, sf_dir, "streamed", write)
    return tick_source.scan_table(spark, root).select(*TICK_COLUMNS)


@query
def catalog_table(spark, sf_dir):
    """The loaded table by its name: registered empty, told of a load, then of the load's repetition."""

    def write(ticks, root):
        name = f"ticks_{root.rsplit('-', 1)[1]}"
        load.ensure_table(spark, name, root, hourly=False)
        for _ in range(2):
            load.append_ticks(ticks, root, load="events", hourly=False, table=name)

    name = f"ticks_{_written(spark, sf_dir, 'catalog', write).rsplit('-', 1)[1]}"
    return spark.table(name).select("date", "ts_event", *TICK_COLUMNS)


def _result_query(fmt: str) -> None:
    def build(spark, sf_dir):
        rows = _ticks(spark, sf_dir).select(*TICK_COLUMNS)
        root = _written(spark, sf_dir, fmt, lambda _, path: outputs.write_result(rows, path, fmt))
        return spark.read.format(fmt).schema(TICK).option("header", True).load(root)

    build.__name__ = f"result_{fmt}"
    query(build)


for _format in ("csv", "json", "parquet"):
    _result_query(_format)


@query
def result_shape(spark, sf_dir):
    trades = filters.trades(_ticks(spark, sf_dir).select(*TICK_COLUMNS))
    return spark.createDataFrame([catalog.shape(trades)], "n_rows long, n_columns long")


@query
def bars_arrow(spark, sf_dir):
    """A request's bars as an Arrow table, and back."""
    found = bar_ops.bars_for(_ticks(spark, sf_dir), SYMBOL, START, END, "1d", order=EVENT_ORDER)
    return spark.createDataFrame(outputs.to_arrow(found, pages.PAGE_MAX))


@query
def ticks_arrow(spark, sf_dir):
    """A symbol's ticks in Arrow batches, and back."""
    found = filters.for_symbol(_ticks(spark, sf_dir), SYMBOL).select(*TICK_COLUMNS)
    return spark.createDataFrame(pa.Table.from_batches(outputs.arrow_batches(found, rows=7)))


@query
def page_clamped(spark, sf_dir):
    """A page of all ticks as one symbol, of which more are asked for than a page may have."""
    lines = samples.line_ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    return pages.ticks_page(lines, "ALL", "1990-01-01", "2010-01-01", limit=10**9)


# --- functions ------------------------------------------------------------


@query
def to_epoch_ns(spark, sf_dir):
    texts = samples.time_texts(spark, sf_dir).withColumn("seconds", clock.seconds_of(F.col("text")))
    return texts.select(
        "event_id",
        clock.to_epoch_ns(F.col("text"), F.col("seconds")).alias("timestamp_ns"),
        clock.to_utc_text(F.col("text"), F.col("seconds")).alias("datetime_utc"),
    )


@query
def from_epoch_ns(spark, sf_dir):
    ns = F.col("ts_event_ns") + F.pmod("order_id", F.lit(1_000))
    return _ticks(spark, sf_dir).select(
        "order_id", ns.alias("timestamp_ns"), clock.from_epoch_ns(ns).alias("datetime_utc")
    )


@query
def to_epoch_ms(spark, sf_dir):
    texts = samples.time_texts(spark, sf_dir)
    return texts.select("event_id", clock.to_epoch_ms(F.col("text")).alias("ts"))


@query
def range_duration_ms(spark, sf_dir):
    texts = samples.time_texts(spark, sf_dir)
    return texts.select("event_id", clock.duration_ms(F.col("text"), F.lit(MID)).alias("duration_ms"))


@query
def auto_resolution(spark, sf_dir):
    # durations on every scale: distance to mid-January over a growing divisor
    ns = F.abs(F.col("ts_event_ns") - F.lit(clock.as_ns(MID)))
    ms = clock.floor_div(ns, 1_000_000)
    scaled = F.call_function("div", ms, F.col("size") * F.col("size") + F.lit(1).cast("bigint"))
    rows = _ticks(spark, sf_dir).select("order_id", scaled.alias("duration_ms"))
    return rows.withColumn("resolution", clock.auto_resolution(F.col("duration_ms")))


@query
def normalize_resolution(spark, sf_dir):
    texts = samples.request_texts(spark, sf_dir)
    return texts.select("event_id", clock.normalize_resolution(F.col("resolution")).alias("resolution"))


@query
def parse_interval(spark, sf_dir):
    texts = samples.request_texts(spark, sf_dir)
    return texts.select("event_id", "text", clock.interval_text(F.col("text")).alias("interval"))


@query
def ns_to_ms(spark, sf_dir):
    return _ticks(spark, sf_dir).select("order_id", clock.ns_to_ms(F.col("ts_event_ns")).alias("datetime"))


@query
def scale_price(spark, sf_dir):
    price_raw = F.col("price_raw") + F.pmod("order_id", F.lit(1_000))
    return _ticks(spark, sf_dir).select(
        "order_id",
        text.scale_price(price_raw).alias("price"),
        text.exact_price(price_raw).alias("price_exact"),
        text.price_text(price_raw).alias("price_text"),
    )


@query
def ascii_code(spark, sf_dir):
    code = (F.pmod("order_id", F.lit(256)) - 128).cast("int")
    return _ticks(spark, sf_dir).select("order_id", text.ascii_code(code).alias("code"))


@query
def escape_tag(spark, sf_dir):
    tag = F.concat_ws(",", "event_type", "props", F.lit("a=b"))
    return samples.events(spark, sf_dir).select("event_id", text.escape_tag(tag).alias("tag"))


@query
def date_from_filename(spark, sf_dir):
    files = samples.candidate_files(spark, sf_dir)
    return files.select("file_name", text.date_from_filename(F.col("file_name")).alias("date_text"))


def _spans(spark, sf_dir):
    day = clock.date_of(F.col("ts_event_ns"))
    return _ticks(spark, sf_dir).groupBy("symbol").agg(F.min(day).alias("start"), F.max(day).alias("end"))


@query
def date_series(spark, sf_dir):
    series = F.explode(clock.date_series(F.col("start"), F.col("end"))).alias("date")
    return _spans(spark, sf_dir).select("symbol", series)


@query
def slot_series(spark, sf_dir):
    days = _ticks(spark, sf_dir).select(clock.date_of(F.col("ts_event_ns")).alias("date")).distinct()
    return days.select("date", F.inline(clock.slot_series(F.col("date"))))


@query
def slot_filename(spark, sf_dir):
    slots = export.with_slots(_ticks(spark, sf_dir)).select("symbol", "date", "slot").distinct()
    name = text.slot_filename(F.col("date"), F.col("slot"), F.col("symbol"))
    return slots.select("symbol", name.alias("file_name"))


def flagship(spark: SparkSession) -> DataFrame:
    return QUERIES["bars_1h"](spark, "/root/testdata/sf0.001")
