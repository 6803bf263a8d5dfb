"""Bars kept by loads, and lookups of single orders."""

import glob

import pytest
import rows
from conftest import TESTDATA
from pyspark.sql import functions as F

from tickloom.operators import bars, filters
from tickloom.plans import load, rollup
from tickloom.sources import commits, samples
from tickloom.sources import ticks as tick_source

SF = f"{TESTDATA}/sf0.001"


def same(found, wanted):
    assert found.schema.names == wanted.schema.names
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))


def test_bars_of_loads_are_those_of_their_ticks(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = samples.event_ticks(spark, SF)
    part = F.pmod("order_id", F.lit(3))
    load.append_ticks(ticks, root, load="a", hourly=False, bars_every="1m")
    load.append_ticks(ticks.where(part == 0), root, load="b", hourly=False, bars_every="5m")
    load.append_ticks(ticks.where(part == 1), root, load="c", hourly=False)
    load.append_ticks(ticks.limit(0), root, load="d", hourly=False, bars_every="1m")
    # run again with fewer rows: its earlier bars go with its rows
    load.append_ticks(ticks.where(part == 2), root, load="a", hourly=False, bars_every="1m")
    scan = tick_source.scan_table(spark, root)
    for every in ("1m", "5m", "7m", "1h", "1d"):
        same(rollup.table_bars(spark, root, every), bars.bars(scan, every))
        same(rollup.merged_bars(spark, root, every), bars.merged_bars(scan, every))
    for start, end in (("2024-01-05", "2024-01-20"), ("2023-01-01", "2023-01-02")):
        same(rollup.bars_for(spark, root, "S00007", start, end), bars.bars_for(scan, "S00007", start, end))
    with pytest.raises(ValueError):
        rollup.bars_for(spark, root, "S00007", "2024-01-05T00:00:30Z", "2024-01-20", "5m")
    assert len(glob.glob(f"{root}/_bars/*")) == 2


def test_noted_bars_open_no_ticks_and_no_load_outside_the_range(spark, tmp_path):
    root = str(tmp_path / "table")
    for day in ("02", "03", "04"):
        ticks = rows.ticks(spark, *(dict(at=f"2024-01-{day} {hour:02d}:30:00", sequence=hour) for hour in range(5)))
        load.append_ticks(ticks, root, load=day, bars_every="1m")
    found = rollup.table_partials(spark, root, "1h", start="2024-01-03", end="2024-01-04")
    assert all("/_bars/03/" in path for path in found.inputFiles()) and found.inputFiles()
    assert all("/_bars/" in path for path in rollup.table_partials(spark, root, "1h").inputFiles())
    assert {done.bars for done in commits.committed(spark, root)} == {"1m"}


def test_ties_nulls_and_times_before_the_epoch(spark, tmp_path):
    root = str(tmp_path / "table")
    one = [
        dict(at="1969-12-31 23:59:30", price=None, sequence=1),
        dict(at="1969-12-31 23:59:30", price=7.0, sequence=1),
        dict(at="2024-01-02 09:00:00", price=2.0, sequence=1),
        dict(at="2024-01-02 09:00:00", price=1.0, sequence=1),
    ]
    two = [
        dict(at="2024-01-02 09:00:00", price=3.0, sequence=0),
        dict(at="2024-01-02 09:00:00", price=4.0, sequence=None, symbol=None),
        dict(at="2024-01-02 09:59:59", price=None, sequence=9),
        dict(at="2024-01-02 09:10:00", price=9.0, action="A"),
        dict(ts_event_ns=None, price=5.0),
    ]
    load.append_ticks(rows.ticks(spark, *one), root, load="one", bars_every="1m")
    load.append_ticks(rows.ticks(spark, *two), root, load="two", bars_every="1m")
    scan = tick_source.scan_table(spark, root)
    for every in ("1m", "1h", "1d"):
        same(rollup.table_bars(spark, root, every), bars.bars(scan, every))
        same(rollup.merged_bars(spark, root, every), bars.merged_bars(scan, every))


def rows_scanned(frame):
    """Rows that the scans of a frame gave to what follows them."""
    frame.collect()
    found, plans = 0, [frame._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().startswith("Scan parquet"):
            found += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return found


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """Orders in no order: the bounds of a row group hold all ids, its filter tells which it has."""
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    ticks = rows.ticks(spark, {}).drop("order_id", "ts_event_ns").crossJoin(spark.range(200_000))
    ticks = ticks.withColumn("order_id", mixed).withColumn("ts_event_ns", F.col("id") * 1_000_000_000)
    plain, bloomed = str(tmp_path / "plain"), str(tmp_path / "bloomed")
    load.append_ticks(ticks, plain, load="a", hourly=False)
    load.append_ticks(ticks, bloomed, load="a", hourly=False, bloom=("order_id",))
    wanted = [r.order_id for r in ticks.where("id in (5, 150000)").select("order_id").collect()]
    frames = [filters.for_order(tick_source.scan_table(spark, root), *wanted) for root in (plain, bloomed)]
    assert sorted(r.ts_event_ns for r in frames[1].collect()) == [5 * 10**9, 150_000 * 10**9]
    # three daily files: all of them, and the two that hold an order
    assert rows_scanned(frames[1]) < rows_scanned(frames[0])
    assert filters.for_order(tick_source.scan_table(spark, bloomed), -1).count() == 0
