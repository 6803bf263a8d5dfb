import datetime as dt
import json
import os

import pytest
import rows
from conftest import TESTDATA
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import catalog, filters, lookup
from tickloom.plans import load
from tickloom.schema import BAR, FAMILY_PAYLOADS, RAW, TICK_COLUMNS
from tickloom.sources import raw as raw_source
from tickloom.sources import samples, ticks as tick_source
from tickloom.streaming.load import ingest_stream

SF = f"{TESTDATA}/sf0.001"
JAN = dt.date(2024, 1, 1)
MIDNIGHT = clock.as_ns("2024-01-10")
ALWAYS = dt.date(2100, 1, 1)


def test_mapping_is_by_receive_date_and_half_open(spark):
    mapping = rows.symbol_map(
        spark, (1, "OLD", JAN, dt.date(2024, 1, 10)), (1, "NEW", dt.date(2024, 1, 10), ALWAYS)
    )
    records = rows.raw(
        spark,
        dict(order_id=1, ts_event_ns=MIDNIGHT - 9, ts_recv_ns=MIDNIGHT - 1),
        dict(order_id=2, ts_event_ns=MIDNIGHT - 9, ts_recv_ns=MIDNIGHT),
        dict(order_id=3, ts_recv_ns=clock.as_ns("2023-12-31")),
        dict(order_id=4, ts_recv_ns=MIDNIGHT, instrument_id=2),
    )
    got = lookup.map_symbols(records, mapping)
    assert {(r.order_id, r.symbol) for r in got.collect()} == {(1, "OLD"), (2, "NEW")}
    left = lookup.map_symbols(records, mapping, how="left")
    assert {(r.order_id, r.symbol) for r in left.collect()} == {(1, "OLD"), (2, "NEW"), (3, None), (4, None)}


def test_mappings_may_differ_by_file(spark):
    mapping = spark.createDataFrame(
        [("a", 1, "AA", JAN, ALWAYS), ("b", 1, "BB", JAN, ALWAYS)],
        "source_file string, instrument_id bigint, symbol string, start_date date, end_date date",
    )
    records = rows.raw(spark, *(dict(source_file=f, ts_recv_ns=MIDNIGHT) for f in "abc"))
    for max_bytes in (0, 10_000):
        got = load.mapped(records, mapping, max_bytes=max_bytes)
        assert {(r.source_file, r.symbol) for r in got.collect()} == {("a", "AA"), ("b", "BB")}
        assert load.normalize(records, mapping, max_bytes=max_bytes).columns == TICK_COLUMNS


def test_small_maps_are_broadcast(spark):
    joined = lookup.map_symbols(samples.raw_records(spark, SF), samples.symbol_map(spark, SF))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_tables_are_salted_with_the_same_result(spark):
    raw, mapping = samples.raw_records(spark, SF), samples.symbol_map(spark, SF)
    allow = raw_source.clean_allowlist(samples.allowlist_lines(spark, SF))
    ticks = samples.event_ticks(spark, SF)
    pairs = [
        (load.normalize(raw, mapping, allow), load.normalize(raw, mapping, allow, max_bytes=0)),
        (load.ingest_summary(raw, mapping, allow), load.ingest_summary(raw, mapping, allow, max_bytes=0)),
        (lookup.allowed(ticks, allow), lookup.allowed(ticks, allow, max_bytes=0)),
        (lookup.rejected(ticks, allow), lookup.rejected(ticks, allow, max_bytes=0)),
    ]
    for broadcast, salted in pairs:
        assert broadcast.columns == salted.columns
        assert sorted(broadcast.collect()) == sorted(salted.collect())
    assert "_salt" in pairs[0][1]._jdf.queryExecution().optimizedPlan().toString()


def test_fits(spark):
    assert lookup.fits(spark.range(10), 1_000)
    assert not lookup.fits(spark.range(1_000), 1_000)
    assert lookup.fits(spark.range(0), 0)
    # bytes count, not rows
    assert not lookup.fits(spark.range(1).selectExpr("repeat('x', 5000) AS x"), 1_000)


def test_repeated_mappings_count_once_and_overlaps_are_an_error(spark):
    mapping = rows.symbol_map(spark, (1, "AA", JAN, ALWAYS))
    records = rows.raw(spark, dict(ts_recv_ns=MIDNIGHT))
    for max_bytes in (0, 10_000):
        assert lookup.map_symbols(records, mapping.union(mapping), max_bytes=max_bytes).count() == 1
    clash = mapping.union(rows.symbol_map(spark, (1, "BB", dt.date(2024, 1, 5), ALWAYS)))
    with pytest.raises(ValueError, match="instrument 1 overlap"):
        lookup.map_symbols(records, clash)


def test_maps_of_several_files_are_united(spark):
    """Intervals that meet, overlap or lie within each other; against every day of every interval."""
    day = lambda n: JAN + dt.timedelta(days=n)
    spans = [(1, "AA", 0, 5), (1, "AA", 3, 8), (1, "AA", 8, 9), (1, "AA", 1, 2), (1, "BB", 9, 12), (1, "AA", 12, 15), (1, "BB", 10, 11)]
    spans += [(2, "CC", 0, 4), (2, "CC", 6, 9), (2, "DD", 4, 6), (3, "EE", 5, 5), (3, "EE", 9, 2)]
    mapping = rows.symbol_map(spark, *((i, s, day(a), day(b)) for i, s, a, b in spans))
    united, small = lookup.prepared_map(mapping)
    days = {(i, s, day(n)) for i, s, a, b in spans for n in range(a, b)}
    found = [(r.instrument_id, r.symbol, r.start_date + dt.timedelta(days=n)) for r in united.collect() for n in range((r.end_date - r.start_date).days)]
    assert small and sorted(found) == sorted(days)
    records = rows.raw(spark, *(dict(order_id=n, instrument_id=i, ts_recv_ns=clock.as_ns(day(n))) for i in (1, 2, 3) for n in range(16)))
    for max_bytes in (0, 10_000):
        got = lookup.map_symbols(records, mapping, max_bytes=max_bytes)
        assert sorted((r.instrument_id, r.symbol, day(r.order_id)) for r in got.collect()) == sorted(days)
    # what comes along must agree, too
    told = mapping.withColumn("keep", F.col("start_date") == day(3))
    with pytest.raises(ValueError, match="instrument 1 overlap"):
        lookup.prepared_map(told)
    assert lookup.prepared_map(mapping.limit(0))[1]


def test_allowlist_keeps_case_and_absent_list_keeps_all(spark):
    ticks = rows.ticks(spark, dict(symbol="aBc"), dict(symbol="XYZ"))
    allow = spark.createDataFrame([("ABC",)], "symbol string")
    assert rows.values(lookup.allowed(ticks, allow), "symbol") == [("aBc",)]
    assert rows.values(lookup.rejected(ticks, allow), "symbol") == [("XYZ",)]
    assert lookup.allowed(ticks, None).count() == 2
    assert lookup.rejected(ticks, None).count() == 0


def test_allowlist_file(spark, tmp_path):
    path = tmp_path / "symbols.txt"
    path.write_bytes(b"aapl\r\n# note\r\n\r\n  BF.B \r\nAAPL\r\n")
    assert sorted(rows.values(raw_source.read_allowlist(spark, str(path)))) == [("AAPL",), ("BF.B",)]
    path.write_bytes(b"# nothing\r\n\r\n")
    assert raw_source.read_allowlist(spark, str(path)) is None
    assert raw_source.read_allowlist(spark, str(tmp_path / "missing.txt")) is None


def test_normalize(spark):
    mapping = rows.symbol_map(spark, (1, "aa", JAN, ALWAYS), (2, "BB", JAN, ALWAYS))
    allow = spark.createDataFrame([("AA",)], "symbol string")
    records = rows.raw(
        spark,
        dict(order_id=1, ts_recv_ns=MIDNIGHT, price_raw=2_500_000_000, side_code=7),
        dict(order_id=2, ts_recv_ns=MIDNIGHT, rtype="mbp1"),
        dict(order_id=3, ts_recv_ns=MIDNIGHT, instrument_id=2),
        dict(order_id=4, ts_recv_ns=MIDNIGHT, instrument_id=3),
    )
    got = load.normalize(records, mapping, allow)
    assert got.columns == TICK_COLUMNS
    assert rows.values(got, "order_id", "symbol", "price", "action", "side") == [(1, "aa", 2.5, "T", "_")]
    summary = load.ingest_summary(records, mapping, allow)
    assert rows.values(summary) == [("f", 1, 1)]
    assert load.normalize(records, mapping).count() == 2


def test_summary_lists_files_without_book_records(spark):
    mapping = rows.symbol_map(spark, (1, "AA", JAN, ALWAYS))
    records = rows.raw(spark, dict(source_file="empty", rtype="mbp1", ts_recv_ns=MIDNIGHT))
    assert rows.values(load.ingest_summary(records, mapping)) == [("empty", 0, 0)]
    assert rows.values(load.ingest_totals(load.ingest_summary(records, mapping))) == [(0, 0, 1)]


def test_kept_and_skipped_are_the_mapped_records(spark):
    raw, mapping = samples.raw_records(spark, SF), samples.symbol_map(spark, SF)
    allow = raw_source.clean_allowlist(samples.allowlist_lines(spark, SF))
    total = load.ingest_totals(load.ingest_summary(raw, mapping, allow)).first()
    assert total.total_rows + total.total_skipped == load.mapped(raw, mapping, allow).count()
    assert total.total_rows == load.normalize(raw, mapping, allow).count()


def test_append_is_repeatable_and_prunes(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = samples.event_ticks(spark, SF)
    for name in ("a", "b", "a"):
        load.append_ticks(ticks, root, load=name)
    assert tick_source.scan_table(spark, root).count() == 2 * ticks.count()
    once = tick_source.scan_table(spark, root).where("load = 'a'")
    assert sorted(once.select(*TICK_COLUMNS).collect()) == sorted(ticks.select(*TICK_COLUMNS).collect())

    some = tick_source.scan_table(spark, root, start="2024-01-05", end="2024-01-07", symbol="S00007")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(symbol,S00007)" in plan
    request = filters.time_range(tick_source.scan_table(spark, root), "2024-01-05T06:00:00Z", "2024-01-07")
    plan = request._jdf.queryExecution().executedPlan().toString()
    # the plan's text cuts the list short
    dates = request._jdf.queryExecution().sparkPlan().collectLeaves().head().partitionFilters().toString()
    assert ">= 2024-01-05" in dates and "<= 2024-01-06" in dates
    assert f"GreaterThanOrEqual(ts_event_ns,{clock.as_ns('2024-01-05T06:00:00Z')})" in plan
    two_days = ticks.where("symbol = 'S00007' AND ts_event >= '2024-01-05' AND ts_event < '2024-01-07'")
    assert some.count() == 2 * two_days.count() > 0
    assert tick_source.scan_table(spark, root, date="2031-01-01").count() == 0


@pytest.mark.parametrize("hourly", [True, False])
def test_counts_of_hourly_and_daily_tables(spark, tmp_path, hourly):
    root = str(tmp_path / "table")
    ticks = rows.ticks(spark, dict(at="2024-01-02 09:00:00"), dict(at="2024-01-02 10:00:00"), dict(at="2024-01-03"))
    load.append_ticks(ticks, root, load="a", hourly=hourly)
    table = tick_source.scan_table(spark, root)
    assert sorted(rows.values(catalog.count_by_date_hour(table))) == [
        (dt.date(2024, 1, 2), 9, 1),
        (dt.date(2024, 1, 2), 10, 1),
        (dt.date(2024, 1, 3), 0, 1),
    ]
    assert sorted(rows.values(catalog.count_by_date(table))) == [(dt.date(2024, 1, 2), 2), (dt.date(2024, 1, 3), 1)]


def test_time_ordered_append_needs_no_exchange(spark, tmp_path):
    source, root = str(tmp_path / "ordered"), str(tmp_path / "table")
    samples.event_ticks(spark, SF).repartitionByRange(4, "ts_event_ns").sortWithinPartitions(
        "ts_event_ns"
    ).select(*TICK_COLUMNS).write.parquet(source)
    ticks = spark.read.parquet(source)
    load.append_ticks(ticks, root, load="a", hourly=False, time_ordered=True)
    table = tick_source.scan_table(spark, root)
    assert sorted(table.select(*TICK_COLUMNS).collect()) == sorted(ticks.collect())
    days = table.select("date").distinct().count()
    assert len(list(tmp_path.joinpath("table").rglob("*.parquet"))) <= days + 3
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    write = [plan for plan in plans if "Execute InsertInto" in plan][-1]
    assert "Exchange" not in write and write.count("* Sort (") == 1


def test_files_are_sorted_by_symbol_and_time(spark, tmp_path):
    root = str(tmp_path / "table")
    load.append_ticks(samples.event_ticks(spark, SF), root, load="a", hourly=False)
    file = next(tmp_path.joinpath("table").rglob("*.parquet"))
    got = rows.values(spark.read.parquet(str(file)), "symbol", "ts_event_ns", "sequence")
    assert len(got) > 10 and got == sorted(got)


def test_table_ddl(spark, tmp_path):
    root = str(tmp_path / "table")
    load.append_ticks(samples.event_ticks(spark, SF), root, load="a", hourly=False)
    for _ in range(2):
        load.ensure_table(spark, "ticks_ddl", root, hourly=False)
    try:
        found = spark.table("ticks_ddl").where("date = '2024-01-05'").count()
        assert found > 0
        # a later load shows at once
        load.append_ticks(samples.event_ticks(spark, SF), root, load="b", hourly=False, table="ticks_ddl")
        assert spark.table("ticks_ddl").where("date = '2024-01-05'").count() == 2 * found
    finally:
        spark.sql("DROP TABLE ticks_ddl")


def test_table_before_the_first_load(spark, tmp_path):
    root = str(tmp_path / "table")
    for _ in range(2):
        load.ensure_table(spark, "ticks_new", root)
    try:
        assert spark.table("ticks_new").count() == 0
        for _ in range(2):
            load.append_ticks(rows.ticks(spark, dict(at="2024-01-02")), root, load="a", table="ticks_new")
            assert spark.table("ticks_new").count() == 1
    finally:
        spark.sql("DROP TABLE ticks_new")


@pytest.fixture
def raw_folder(spark, tmp_path):
    """Three daily raw files, named as the feed names them."""
    folder = tmp_path / "raw"
    folder.mkdir()
    records = samples.raw_records(spark, SF)
    for day in ("20240105", "20240106", "20240107"):
        part = tmp_path / f"part-{day}"
        records.where(F.col("source_file").contains(day)).drop("source_file").coalesce(1).write.parquet(str(part))
        os.rename(next(part.glob("*.parquet")), folder / f"feed-{day}.mbo.parquet")
    (folder / "notes.txt").write_text("x")
    return folder


def expected(spark, days):
    raw = samples.raw_records(spark, SF).where(F.substring("source_file", 6, 8).isin(days))
    return load.normalize(raw, samples.symbol_map(spark, SF))


def test_read_raw(spark, raw_folder):
    records = raw_source.read_raw(spark, str(raw_folder))
    assert records.columns == RAW.fieldNames()
    assert records.select("source_file").distinct().count() == 3
    names = rows.values(raw_source.raw_files(spark, str(raw_folder)), "file_name")
    assert names == [(f"feed-2024010{i}.mbo.parquet",) for i in (5, 6, 7)]


def test_records_of_every_family_are_whole(spark, tmp_path):
    """What raw files hold of each family comes back; other columns, and files without them, are NULL."""
    folder = str(tmp_path / "raw")
    records = samples.raw_families(spark, SF)
    records.drop("source_file").write.parquet(f"{folder}/feed.mbo.parquet")
    samples.raw_records(spark, SF).limit(5).drop("source_file").write.parquet(f"{folder}/old.mbo.parquet")
    got = raw_source.read_raw(spark, folder, payloads=True)
    assert raw_source.read_raw(spark, folder).columns == RAW.fieldNames()
    assert got.where("source_file LIKE 'old%' AND coalesce(depth, size(levels), bar.open) IS NOT NULL").count() == 0
    whole = {r.order_id: json.loads(r.value) for r in got.where("source_file LIKE 'feed%'").select("order_id", F.to_json(F.struct("*")).alias("value")).collect()}
    kinds = {"levels": set(), "bar": set(), "definition": set(), "depth": set()}
    for r in records.select("order_id", "rtype", "price_raw", "size", "instrument_id").collect():
        record = whole[r.order_id]
        for name, found in kinds.items():
            if name in record:
                found.add(record["rtype"])
        if r.rtype == "mbp10":
            assert [x["bid_px"] for x in record["levels"]] == [r.price_raw - k * 10**7 for k in range(1, 11)]
        if r.rtype == "instrument_def":
            assert record["definition"]["min_price_increment"] == r.size
    assert kinds == {name: set(of) & set(samples.FAMILIES) for name, of in FAMILY_PAYLOADS.items()}
    # a decoder may fill what a family does not have
    mixed = records.withColumn("bar", F.struct(*(F.lit(1).cast("long").alias(f.name) for f in BAR.fields)))
    mixed.drop("source_file").write.parquet(str(tmp_path / "mixed" / "x.mbo.parquet"))
    kept = raw_source.read_raw(spark, str(tmp_path / "mixed"), payloads=True).where("bar IS NOT NULL")
    assert {r.rtype for r in kept.select("rtype").distinct().collect()} == {"ohlcv_1s", "ohlcv_1d", "ohlcv_eod"}
    lines = raw_source.record_json(kept.limit(3)).collect()
    assert all("levels" not in json.loads(line.value) and json.loads(line.value)["bar"]["open"] == 1 for line in lines)


def test_scans_start_no_job(spark, tmp_path):
    root = str(tmp_path / "table")
    load.append_ticks(samples.event_ticks(spark, SF), root, load="a", hourly=False)
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("scan-only")
    spark.sparkContext.setJobGroup("scan-only", "scans")
    try:
        table = tick_source.scan_table(spark, root, date="2024-01-05")
        assert list(jobs()) == []
        assert table.count() > 0 and len(jobs()) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_load_files_isolates_failures(spark, raw_folder, tmp_path):
    (raw_folder / "feed-20240106.mbo.parquet").write_bytes(b"not parquet at all")
    root = str(tmp_path / "table")
    mapping = samples.symbol_map(spark, SF)
    paths = [r.path for r in raw_source.raw_files(spark, str(raw_folder)).collect()]
    loads = load.load_files(spark, paths, root, mapping, hourly=False)
    good = expected(spark, ["20240105", "20240107"])
    assert [bool(done.error) for done in loads] == [False, True, False]
    assert load.load_totals(loads) == {"total_rows": good.count(), "files_ok": 2, "files_failed": 1}
    table = tick_source.scan_table(spark, root)
    assert sorted(table.select(*TICK_COLUMNS).collect()) == sorted(good.collect())
    pending = load.pending_loads(raw_source.raw_files(spark, str(raw_folder)), table)
    assert rows.values(pending, "file_name") == [("feed-20240106.mbo.parquet",)]


def test_load_file_counts_skipped_rows(spark, raw_folder, tmp_path):
    allow = raw_source.clean_allowlist(samples.allowlist_lines(spark, SF))
    mapping = samples.symbol_map(spark, SF)
    done = load.load_file(
        spark, str(raw_folder / "feed-20240105.mbo.parquet"), str(tmp_path / "t"), mapping, allow, hourly=False
    )
    assert done.error is None
    assert done.rows_kept + done.rows_skipped == expected(spark, ["20240105"]).count()
    assert done.rows_kept > 0 and done.rows_skipped > 0


def test_load_file_of_which_nothing_is_kept(spark, raw_folder, tmp_path):
    mapping = samples.symbol_map(spark, SF)
    path, root = str(raw_folder / "feed-20240105.mbo.parquet"), str(tmp_path / "t")
    nobody = spark.createDataFrame([("NOBODY",)], "symbol string")
    done = load.load_file(spark, path, root, mapping, nobody, hourly=False)
    assert (done.error, done.rows_kept) == (None, 0)
    assert done.rows_skipped == expected(spark, ["20240105"]).count()


def test_raw_file_may_be_a_folder_of_part_files(spark, tmp_path):
    records = samples.raw_records(spark, SF)
    folder = tmp_path / "raw"
    records.drop("source_file").repartition(3).write.parquet(str(folder / "feed-all.mbo.parquet"))
    assert rows.values(raw_source.raw_files(spark, str(folder)), "file_name") == [("feed-all.mbo.parquet",)]
    assert rows.values(raw_source.read_raw(spark, str(folder)).select("source_file").distinct()) == [
        ("feed-all.mbo.parquet",)
    ]
    path = raw_source.raw_files(spark, str(folder)).first().path
    done = load.load_file(spark, path, str(tmp_path / "t"), samples.symbol_map(spark, SF), hourly=False)
    good = load.normalize(records, samples.symbol_map(spark, SF))
    assert (done.file, done.rows_kept) == ("feed-all.mbo.parquet", good.count())
    query = ingest_stream(
        spark, str(folder), str(tmp_path / "s"), str(tmp_path / "c"), samples.symbol_map(spark, SF), hourly=False
    )
    assert query.awaitTermination(120)
    assert tick_source.scan_table(spark, str(tmp_path / "s")).count() == good.count()


def test_pending_files_by_date(spark):
    files = spark.createDataFrame(
        [("feed-20240110.mbo.parquet",), ("feed-20240111.mbo.parquet",), ("feed.mbo.parquet",)], "file_name string"
    )
    ticks = rows.ticks(spark, dict(ts_event_ns=MIDNIGHT))
    got = load.pending_files(files, ticks)
    assert sorted(rows.values(got)) == [("feed-20240111.mbo.parquet",), ("feed.mbo.parquet",)]
    assert load.pending_files(files, rows.ticks(spark)).count() == 3


def test_stream_loads_new_files_once(spark, raw_folder, tmp_path):
    late = raw_folder / "feed-20240107.mbo.parquet"
    hidden = tmp_path / "late.parquet"
    os.rename(late, hidden)
    root, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    mapping = samples.symbol_map(spark, SF)

    def run(name="stream"):
        query = ingest_stream(
            spark, str(raw_folder), root, checkpoint, mapping, name=name, hourly=False, max_files=1
        )
        assert query.awaitTermination(120)
        return sorted(tick_source.scan_table(spark, root).select(*TICK_COLUMNS).collect())

    assert run() == sorted(expected(spark, ["20240105", "20240106"]).collect())
    assert run() == sorted(expected(spark, ["20240105", "20240106"]).collect())
    os.rename(hidden, late)
    os.utime(late)
    assert run() == sorted(expected(spark, ["20240105", "20240106", "20240107"]).collect())
    loads = {r.load for r in tick_source.scan_table(spark, root).select("load").distinct().collect()}
    assert {name[:7] + name[-9:] for name in loads} == {"stream-000000000", "stream-000000001", "stream-000000002"}


def test_stream_may_skip_corrupt_files(spark, raw_folder, tmp_path):
    (raw_folder / "feed-20240106.mbo.parquet").write_bytes(b"not parquet at all")
    root = str(tmp_path / "table")
    query = ingest_stream(
        spark, str(raw_folder), root, str(tmp_path / "c"), samples.symbol_map(spark, SF), hourly=False,
        ignore_corrupt=True,
    )
    assert query.awaitTermination(120)
    assert tick_source.scan_table(spark, root).count() == expected(spark, ["20240105", "20240107"]).count()


def test_repeated_batch_does_not_double_rows(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = rows.ticks(spark, dict(at="2024-01-02"), dict(at="2024-01-03"))
    for _ in range(2):
        load.append_ticks(ticks, root, load="stream-000000000")
    assert tick_source.scan_table(spark, root).count() == 2


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    mapping = rows.symbol_map(spark, (1, "AA", JAN, ALWAYS))
    paths = [str(tmp_path / folder / "x.mbo.parquet") for folder in "ab"]
    for n, path in enumerate(paths):
        rows.raw(spark, dict(order_id=n, ts_recv_ns=MIDNIGHT)).drop("source_file").write.parquet(path)
    root = str(tmp_path / "table")
    assert load.load_totals(load.load_files(spark, paths, root, mapping))["total_rows"] == 2
    table = tick_source.scan_table(spark, root)
    assert sorted(rows.values(table, "order_id")) == [(0,), (1,)]
    files = spark.createDataFrame([("x.mbo.parquet", f"file:{path}") for path in paths], "file_name string, path string")
    assert load.pending_loads(files, table).count() == 0
    assert load.pending_loads(files, table.where("order_id = 0")).count() == 1
    with pytest.raises(ValueError, match="twice"):
        load.load_files(spark, [paths[0], f"file:{paths[0]}"], root, mapping)


def test_a_repeated_load_leaves_no_stale_rows(spark, tmp_path):
    root = str(tmp_path / "table")
    hours = [dict(at=f"2024-01-02 {hour:02d}:00:00") for hour in (9, 10)]
    load.append_ticks(rows.ticks(spark, *hours), root, load="a")
    load.append_ticks(rows.ticks(spark, *hours), root, load="b")
    load.append_ticks(rows.ticks(spark, hours[0]), root, load="a")
    assert sorted(rows.values(tick_source.scan_table(spark, root), "load", "hour")) == [("a", 9), ("b", 9), ("b", 10)]


def test_daily_tables_have_no_hour(spark, tmp_path):
    root = str(tmp_path / "table")
    load.append_ticks(rows.ticks(spark, dict(at="2024-01-02 10:00:00")), root, load="a", hourly=False)
    assert "hour" not in tick_source.scan_table(spark, root).columns
    with pytest.raises(ValueError, match="hours"):
        load.append_ticks(rows.ticks(spark, dict(at="2024-01-02 10:00:00")), root, load="b")


def test_two_streams_share_a_table(spark, tmp_path):
    mapping = rows.symbol_map(spark, (1, "AA", JAN, ALWAYS))
    root = str(tmp_path / "table")
    for n, name in enumerate("ab"):
        source = tmp_path / name
        rows.raw(spark, dict(order_id=n, ts_recv_ns=MIDNIGHT)).drop("source_file").write.parquet(str(source / "x.mbo.parquet"))
        assert ingest_stream(spark, str(source), root, str(tmp_path / f"c{name}"), mapping).awaitTermination(120)
    assert sorted(rows.values(tick_source.scan_table(spark, root), "order_id")) == [(0,), (1,)]


def test_a_missing_root_or_column_is_an_error(spark, tmp_path):
    for end in ("2024-01-02", "2026-01-01"):
        with pytest.raises(FileNotFoundError):
            tick_source.scan_table(spark, str(tmp_path / "typo"), start="2024-01-01", end=end)
    root = str(tmp_path / "table")
    ticks = rows.ticks(spark, dict(at="2024-01-02")).withColumnRenamed("ts_event_ns", "ts_event")
    ticks.selectExpr("*", "'2024-01-02' AS date").write.partitionBy("date").parquet(root)
    with pytest.raises(ValueError, match="ts_event_ns"):
        tick_source.scan_table(spark, root)


def test_one_hour_reads_one_folder(spark, tmp_path):
    root = str(tmp_path / "table")
    load.append_ticks(samples.event_ticks(spark, SF), root, load="a")
    hour = filters.time_range(tick_source.scan_table(spark, root), "2024-01-10T06:00:00Z", "2024-01-10T07:00:00Z")
    assert len(hour.inputFiles()) > 1  # before filters
    scan = hour._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.selectedPartitions().totalNumberOfFiles() <= 1
    assert {r.hour for r in hour.collect()} <= {6}
    timed = tick_source.scan_table(spark, root).where("ts_event > TIMESTAMP '2024-01-10 06:00:00'")
    assert "GreaterThan(ts_event," in timed._jdf.queryExecution().executedPlan().toString()
