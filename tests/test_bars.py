import pytest
import rows
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import bars as ops
from tickloom.sources import samples
from conftest import TESTDATA

T0 = clock.as_ns("2024-01-02T09:30:00Z")


def test_ties_are_broken_by_sequence_then_order_then_price(spark):
    ticks = rows.ticks(
        spark,
        dict(ts_event_ns=T0, sequence=2, price=5.0),
        dict(ts_event_ns=T0, sequence=1, order_id=9, price=7.0),
        dict(ts_event_ns=T0, sequence=1, order_id=8, price=4.0),
        dict(ts_event_ns=T0, sequence=1, order_id=8, price=3.0),
        dict(ts_event_ns=T0 + 5, sequence=1, price=2.0),
        dict(ts_event_ns=T0 + 5, sequence=1, price=6.0),
    )
    bar = ops.bars(ticks, "1m").collect()[0]
    assert (bar.open, bar.close, bar.high, bar.low) == (3.0, 6.0, 7.0, 2.0)
    assert (bar.ts, bar.volume, bar.trades) == (T0 // 1_000_000, 6, 6)


def test_bucket_edges_are_closed_left(spark):
    ticks = rows.ticks(
        spark,
        dict(ts_event_ns=T0 - 1, price=1.0),
        dict(ts_event_ns=T0, price=2.0),
        dict(ts_event_ns=T0 + clock.MINUTE - 1, price=3.0),
        dict(ts_event_ns=T0 + clock.MINUTE, price=4.0),
    )
    got = {r.ts: (r.open, r.close) for r in ops.bars(ticks, "1m").collect()}
    minute = T0 // 1_000_000
    assert got == {minute - 60_000: (1.0, 1.0), minute: (2.0, 3.0), minute + 60_000: (4.0, 4.0)}


def test_buckets_before_the_epoch(spark):
    ticks = rows.ticks(spark, dict(ts_event_ns=-1), dict(ts_event_ns=0))
    assert sorted(r.ts for r in ops.bars(ticks, "1s").collect()) == [-1000, 0]


def test_only_trades_and_no_gap_filling(spark):
    ticks = rows.ticks(
        spark,
        dict(ts_event_ns=T0, action="A", price=99.0),
        dict(ts_event_ns=T0, price=1.0),
        dict(ts_event_ns=T0 + 3 * clock.HOUR, price=2.0),
    )
    assert [r.open for r in ops.bars(ticks, "1h").orderBy("ts").collect()] == [1.0, 2.0]


def test_empty_input(spark):
    assert ops.bars(rows.ticks(spark), "1m").count() == 0
    assert ops.bars_for(rows.ticks(spark), "AA", "2024-01-01", "2024-01-02").count() == 0


def test_null_prices(spark):
    ticks = rows.ticks(spark, dict(ts_event_ns=T0, price=None), dict(ts_event_ns=T0 + 1, price=2.0))
    server = ops.bars_for(ticks, "AA", "2024-01-02", "2024-01-03", "1h").collect()[0]
    assert (server.open, server.high, server.close, server.trades) == (0.0, 2.0, 2.0, 2)
    merged = ops.merged_bars(ticks, "1h").collect()[0]
    assert (merged.open, merged.close, merged.trades) == (None, 2.0, 1)


def test_merged_series_ignores_symbols(spark):
    ticks = rows.ticks(
        spark, dict(ts_event_ns=T0, symbol="AA", price=1.0), dict(ts_event_ns=T0 + 1, symbol="BB", price=2.0)
    )
    bar = ops.merged_bars(ticks, "1H").collect()[0]
    assert (bar.open, bar.close, bar.trades) == (1.0, 2.0, 2)


def test_range_is_half_open_and_auto_picks_a_resolution(spark):
    ticks = rows.ticks(
        spark, dict(at="2024-01-02T09:59:59Z"), dict(at="2024-01-02T09:00:00Z"), dict(at="2024-01-02T10:00:00Z")
    )
    got = ops.bars_for(ticks, "AA", "2024-01-02T09:00:00Z", "2024-01-02T10:00:00Z")
    # one hour is not longer than one hour: one-minute bars
    assert [r.ts for r in got.collect()] == [
        clock.as_ns(t) // 1_000_000 for t in ("2024-01-02T09:00:00Z", "2024-01-02T09:59:00Z")
    ]


def test_unknown_resolution_means_one_minute(spark):
    ticks = rows.ticks(spark, dict(ts_event_ns=T0 + 61 * clock.SECOND))
    got = ops.bars_for(ticks, "AA", "2024-01-02", "2024-01-03", "2h").collect()
    assert [r.ts for r in got] == [(T0 + clock.MINUTE) // 1_000_000]


@pytest.mark.parametrize("every", ["0m", "m", "5", "5x", ""])
def test_bad_width(spark, every):
    with pytest.raises(ValueError):
        ops.bars(rows.ticks(spark), every)


def test_packed_key_plans_as_hash_aggregate_and_equals_the_struct(spark):
    ticks = samples.event_ticks(spark, f"{TESTDATA}/sf0.001")
    packed = ops.bars(ticks, "1h", order=("ts_event_ns", "sequence"))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    general = ops.bars(ticks, "1h")
    assert sorted(packed.collect()) == sorted(general.collect())


def test_packed_key_orders_the_full_range(spark):
    big = 2**63 - 1
    ticks = rows.ticks(
        spark,
        dict(ts_event_ns=T0, sequence=big, price=1.0),
        dict(ts_event_ns=T0 + 1, sequence=0, price=2.0),
        dict(ts_event_ns=T0, sequence=0, price=3.0),
    )
    bar = ops.bars(ticks, "1h", order=("ts_event_ns", "sequence")).collect()[0]
    assert (bar.open, bar.close) == (3.0, 2.0)
    gaps = rows.ticks(
        spark, dict(ts_event_ns=T0, price=1.0), dict(ts_event_ns=T0, sequence=None, price=2.0),
        dict(ts_event_ns=T0 - 1, sequence=big, price=3.0),
    )
    for order in (("ts_event_ns", "sequence"), ("ts_event_ns", "sequence", "price")):
        bars = {b.ts: (b.open, b.close) for b in ops.bars(gaps, "1s", order=order).collect()}
        assert bars == {T0 // 1_000_000: (2.0, 1.0), T0 // 1_000_000 - 1000: (3.0, 3.0)}


@pytest.mark.parametrize("every", ["1s", "15m", "1d"])
def test_bars_account_for_every_trade(spark, every):
    ticks = samples.line_ticks(spark, f"{TESTDATA}/sf0.001")
    series = ops.bars(ticks, every)
    trades = ticks.where("action = 'T'").agg(F.count("*"), F.sum("size")).first()
    assert tuple(series.agg(F.sum("trades"), F.sum("volume")).first()) == tuple(trades)
    assert series.where("low > open OR low > close OR high < open OR high < close").count() == 0
