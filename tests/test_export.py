import json

import pytest
import rows
from conftest import TESTDATA
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import bars as bar_ops
from tickloom.operators import catalog, pages
from tickloom.plans import adhoc, export, outputs
from tickloom.schema import BAR_ORDER, TICK_COLUMNS
from tickloom.sources import samples
from tickloom.sources import ticks as tick_source

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def ticks(spark):
    return samples.event_ticks(spark, SF)


def of_day(ticks, day="2024-01-05"):
    return ticks.where(F.to_date("ts_event") == day)


def test_export_reads_back_and_repeats(spark, ticks, tmp_path):
    root = str(tmp_path / "out")
    for _ in range(2):
        export.export_slots(ticks, root, "2024-01-05", "2024-01-06")
    got = tick_source.scan_exports(spark, root)
    assert sorted(got.select(*TICK_COLUMNS).collect()) == sorted(of_day(ticks).select(*TICK_COLUMNS).collect())
    # another day leaves the first alone
    export.export_slots(ticks, root, "2024-01-06", "2024-01-07")
    assert tick_source.scan_exports(spark, root, date="2024-01-05").count() == of_day(ticks).count()


@pytest.mark.parametrize("symbol", [None, "S00007"])
def test_a_range_within_slots_leaves_the_rest_of_them(spark, ticks, tmp_path, symbol):
    """Against plain Python: after any exports every slot holds the newest rows of each instant that an export gave it."""
    root, at = str(tmp_path / "out"), clock.as_ns
    rows_of = [dict(ts_event_ns=at("2024-01-05") + k * 60 * 10**9, order_id=k, symbol="S00007") for k in range(180)]
    minutes = rows.ticks(spark, *rows_of)

    def run(first, last, mark):
        begin, end = (None if m is None else at("2024-01-05") + m * 60 * 10**9 for m in (first, last))
        export.export_slots(minutes.withColumn("flags", F.lit(mark)), root, begin, end, symbol)
        for k in range(first or 0, 180 if last is None else last):
            want[k] = mark

    def check():
        scan = tick_source.scan_exports(spark, root) if symbol is None else tick_source.read_symbol_exports(spark, root, symbol)
        assert {r.order_id: r.flags for r in scan.collect()} == want and scan.count() == len(want)

    want = {}
    for mark, (first, last) in enumerate([(0, 100), (7, 8), (40, 75), (44, 46), (90, 130), (None, 3), (127, None), (60, 60)]):
        run(first, last, mark)
        check()
    # the slot is touched only if the range has ticks for it
    export.export_slots(minutes.where("order_id > 1000"), root, at("2024-01-05") + 10**9, at("2024-01-05T01:01:01Z"), symbol)
    check()


def test_export_layout(spark, ticks, tmp_path):
    root = tmp_path / "out"
    export.export_slots(ticks, str(root), "2024-01-05", "2024-01-06")
    manifest = export.export_manifest(spark, str(root))
    files = list(root.rglob("*.parquet"))
    assert len(files) == manifest.count()
    assert all(".zstd." in f.name for f in files)
    slots = {(r.date.isoformat(), r.slot) for r in manifest.collect()}
    assert {(f.parent.parent.name[5:], f.parent.name[5:]) for f in files} == slots
    for file in files:
        times = rows.values(spark.read.parquet(str(file)), "ts_event_ns")
        assert times == sorted(times)
    totals = export.export_totals(manifest).first()
    assert tuple(totals) == (of_day(ticks).count(), len(files))


def test_max_records_split_a_slot(spark, tmp_path):
    root = tmp_path / "out"
    hot = rows.ticks(spark, *(dict(at="2024-01-05", order_id=i) for i in range(10)))
    export.export_slots(hot, str(root), max_records_per_file=4)
    assert len(list(root.rglob("*.parquet"))) == 3
    # the report names what was written
    manifest = export.export_manifest(spark, str(root))
    assert rows.values(manifest, "cnt", "n_files") == [(10, 3)]
    assert tuple(export.export_totals(manifest).first()) == (10, 3)
    assert tick_source.scan_exports(spark, str(root)).count() == 10


def test_dates_prune_folders(spark, ticks, tmp_path):
    root = str(tmp_path / "out")
    export.export_slots(ticks, root, "2024-01-05", "2024-01-08")
    one = tick_source.scan_exports(spark, root, date="2024-01-06", start="2024-01-05", end="2024-01-08")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows.values(one.select("date").distinct())[0][0].isoformat() == "2024-01-06"
    # an end alone selects nothing in particular
    assert tick_source.scan_exports(spark, root, end="2024-01-06").count() == tick_source.scan_exports(spark, root).count()
    assert tick_source.scan_exports(spark, root, start="2025-01-01", end="2025-02-01").count() == 0
    assert tick_source.scan_exports(spark, root, start="2024-01-07", end="2024-01-05").count() == 0
    # only the folders of the selected dates are listed
    assert {f.split("date=")[1][:10] for f in one.inputFiles()} == {"2024-01-06"}
    # a range too long to list by date is filtered instead
    wide = tick_source.scan_exports(spark, root, start="2020-01-01", end="2024-01-07")
    assert {r.date.isoformat() for r in wide.select("date").distinct().collect()} == {"2024-01-05", "2024-01-06"}


def test_symbol_exports_are_preferred_per_date(spark, ticks, tmp_path):
    root, own = str(tmp_path / "out"), str(tmp_path / "own")
    export.export_slots(ticks, root, "2024-01-05", "2024-01-08")
    export.export_slots(ticks.withColumn("flags", F.lit(-1)), own, "2024-01-06", "2024-01-07", symbol="S00007")

    def flags(**args):
        got = tick_source.scan_exports(spark, root, symbol="S00007", symbol_root=own, **args)
        return {(r.date.isoformat(), r.flags == -1) for r in got.select("date", "flags").collect()}

    assert flags(start="2024-01-05", end="2024-01-08") == {
        ("2024-01-05", False),
        ("2024-01-06", True),
        ("2024-01-07", False),
    }
    assert flags(date="2024-01-07") == {("2024-01-07", False)}
    assert flags(date="2024-01-06") == {("2024-01-06", True)}
    assert tick_source.read_symbol_exports(spark, own, "S00099").count() == 0
    # without dates only the general export is read
    assert not any(own_row for _, own_row in flags())


def test_symbols_with_special_characters(spark, tmp_path):
    own = str(tmp_path / "own")
    odd = ["BF.B", "A/B=C", "X %[1]{2}^", "Q:?*#"]
    ticks = rows.ticks(spark, *(dict(at="2024-01-05", symbol=s) for s in odd))
    for symbol in odd:
        export.export_slots(ticks, own, symbol=symbol)
    for symbol in odd:
        got = tick_source.scan_exports(spark, own, date="2024-01-05", symbol=symbol, symbol_root=own)
        assert rows.values(got, "symbol") == [(symbol,)]


def test_line_protocol(spark):
    tick = rows.ticks(
        spark,
        dict(ts_event_ns=5, symbol="A B", instrument_id=2, order_id=3, price_raw=1_250_000_000, size=4, flags=130,
             channel_id=1, action="A", side="N", ts_recv_ns=6, ts_in_delta=-7, sequence=8),
    )
    assert rows.values(outputs.line_protocol_rows(tick)) == [
        (
            "mbo_ticks,symbol=A\\ B,action=A,side=N instrument_id=2i,order_id=3i,price_raw=1250000000i,"
            "price=1.25,size=4i,flags=130i,channel_id=1i,ts_in_delta=-7i,sequence=8i,ts_recv=6i 5",
        )
    ]


def test_outputs(spark, ticks, tmp_path, capsys):
    bars = bar_ops.bars_for(ticks, "S00007", "2024-01-01", "2024-02-01", "1d")
    n = bars.count()
    for fmt, read in {
        "csv": lambda p: spark.read.option("header", True).option("inferSchema", True).csv(p),
        "json": lambda p: spark.read.json(p),
        "parquet": lambda p: spark.read.parquet(p),
    }.items():
        path = str(tmp_path / fmt)
        outputs.write_result(bars, path, fmt)
        got = read(path)
        assert set(got.columns) == set(bars.columns) and got.count() == n
    with pytest.raises(ValueError):
        outputs.write_result(bars, str(tmp_path / "x"), "xml")
    lines = str(tmp_path / "lines")
    outputs.write_lines(of_day(ticks), lines)
    assert spark.read.text(lines).count() == of_day(ticks).count()

    assert [r["ts"] for r in json.loads(outputs.json_array(bars))] == [r.ts for r in bars.collect()]
    assert outputs.csv_text(bars).splitlines()[0] == ",".join(bars.columns)
    outputs.show(bars)
    assert f"{n} rows × 7 columns" in capsys.readouterr().out
    assert catalog.shape(bars) == (n, 7)


def test_arrow_types_and_bound(spark, ticks):
    bars = outputs.to_arrow(bar_ops.bars_for(ticks, "S00007", "2024-01-01", "2024-02-01", "1d"))
    assert [str(t) for t in bars.schema.types] == ["int64"] + ["double"] * 4 + ["int64"] * 2
    page = outputs.to_arrow(pages.ticks_page(ticks, "S00007", "2024-01-01", "2024-02-01"))
    assert [str(t) for t in page.schema.types[:7]] == [
        "int64", "int64", "double", "int32", "string", "string", "int64",
    ]
    with pytest.raises(ValueError):
        outputs.to_arrow(ticks, max_rows=10)


def test_sql_view(spark, ticks, tmp_path):
    root = str(tmp_path / "out")
    export.export_slots(ticks, root, "2024-01-05", "2024-01-08")
    frame = tick_source.scan_exports(spark, root)
    got = adhoc.sql(frame, "SELECT order_id FROM df WHERE date = :d AND price > 5", symbol="S00007",
                    args={"d": clock.as_date("2024-01-06")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,S00007)" in plan and "GreaterThan(price,5.0)" in plan
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ts_in_delta" not in plan.split("ReadSchema")[1]
    assert not spark.catalog.tableExists("df")
    assert adhoc.sql(ticks, "SELECT COUNT(*) AS n FROM df").first().n == ticks.count()


def test_default_symbol_and_unknown_symbol(spark):
    ticks = rows.ticks(spark, dict(symbol="NVDA", ts_event_ns=1_500), dict(symbol=None))
    assert catalog.data_range(ticks).first().total_ticks == 1
    unknown = catalog.data_range(ticks, "ZZ").first()
    assert tuple(unknown) == (None, None, 0)
    assert rows.values(catalog.symbols(ticks)) == [("NVDA",)]


def test_counts_use_partition_columns(spark, ticks, tmp_path):
    root = str(tmp_path / "out")
    export.export_slots(ticks, root, "2024-01-05", "2024-01-08")
    counts = catalog.count_by_date(tick_source.scan_exports(spark, root))
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().executedPlan().toString()
    assert dict(rows.values(counts)) == dict(
        rows.values(catalog.count_by_date(ticks.where("ts_event >= '2024-01-05' AND ts_event < '2024-01-08'")))
    )


def test_no_python_in_any_plan(spark, ticks):
    from tickloom.registry import QUERIES

    for name, build in QUERIES.items():
        plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_bar_order_ends_with_price():
    assert BAR_ORDER[-1] == "price"


def test_text_results_keep_integers_and_rows(spark):
    times = spark.createDataFrame([(1_761_130_860_010_235_508, "a,b"), (None, None)], "ns bigint, x string")
    assert outputs.csv_text(times) == 'ns,x\n1761130860010235508,"a,b"\n,\n'
    many = spark.range(60_000)
    assert outputs.to_arrow(many).num_rows == 60_000
    assert sum(batch.num_rows for batch in outputs.arrow_batches(many, 7_000)) == 60_000
    with pytest.raises(ValueError):
        outputs.to_arrow(many, max_rows=50_000)


def test_line_protocol_leaves_out_nulls(spark):
    tick = rows.ticks(spark, dict(ts_event_ns=5, symbol="A", size=None, side=None))
    (line,) = rows.values(outputs.line_protocol_rows(tick))[0]
    assert line.startswith("mbo_ticks,symbol=A,action=T instrument_id=1i,") and line.endswith(" 5")
    assert "size" not in line and "side" not in line and ",," not in line


def test_time_text_does_not_follow_the_session_zone(spark):
    from tickloom.functions import clock

    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = spark.range(1).select(
                clock.from_epoch_ns(F.lit(0).cast("bigint")), clock.to_utc_text(F.lit("2024-03-10T02:30:00Z"))
            ).first()
            assert tuple(got) == ("1970-01-01 00:00:00.000000000 UTC", "2024-03-10 02:30:00 UTC")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
