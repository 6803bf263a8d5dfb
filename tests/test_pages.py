import random

import pytest
import rows
from conftest import TESTDATA
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import filters, pages
from tickloom.schema import TICK_ORDER
from tickloom.sources import samples

START, END = "2024-01-02", "2024-01-03"
T0 = clock.as_ns("2024-01-02T09:30:00Z")


@pytest.fixture(scope="module")
def five(spark):
    return rows.ticks(
        spark,
        *(dict(ts_event_ns=T0 + 7, sequence=i, order_id=i) for i in range(4)),
        dict(at="2024-01-03", order_id=9),
        dict(at="2024-01-02", order_id=4),
        dict(ts_event_ns=T0, symbol="BB", order_id=5),
    ).cache()


def page(ticks, **args):
    got = pages.ticks_page(ticks, "AA", START, END, **args).collect()
    return [r.order_id for r in got], {(r["count"], r.has_more) for r in got}


def test_pages(five):
    assert page(five) == ([4, 0, 1, 2, 3], {(5, False)})
    assert page(five, limit=2) == ([4, 0], {(2, True)})
    assert page(five, limit=2, offset=3) == ([2, 3], {(2, False)})
    assert page(five, limit=2, offset=4) == ([3], {(1, False)})
    assert page(five, limit=2, offset=5) == ([], set())
    assert page(five, limit=0) == ([], set())


def test_summary_of_empty_pages(five):
    summary = lambda **a: tuple(pages.page_summary(five, "AA", START, END, **a).first())
    assert summary(limit=0) == (0, True)
    assert summary(offset=5) == (0, False)
    assert summary(limit=5) == (5, False)
    assert tuple(pages.page_summary(five, "ZZ", START, END).first()) == (0, False)


def test_limits():
    assert pages.clamp_limit() == 10_000
    assert pages.clamp_limit(60_000) == 50_000
    with pytest.raises(ValueError):
        pages.clamp_limit(-1)


def test_nulls_become_defaults_and_times_keep_nanoseconds(spark):
    ticks = rows.ticks(spark, dict(ts_event_ns=T0 + 1_999_999, price=None, side=None, size=None))
    got = pages.ticks_page(ticks, "AA", START, END).first()
    assert (got.ts, got.ts_ns) == (T0 // 1_000_000 + 1, T0 + 1_999_999)
    assert (got.price, got.size, got.side) == (0.0, 0, "")


def test_keyset_pages_follow_each_other(five):
    seen, after = [], None
    while True:
        got = pages.ticks_page(five, "AA", START, END, limit=2, after=after, keyed=True).collect()
        seen += [r.order_id for r in got]
        if not got or not got[-1].has_more:
            break
        after = got[-1].key.asDict()
    assert seen == [4, 0, 1, 2, 3]


@pytest.mark.parametrize("limit", [1, 3, 4, 5, 11])
def test_keyset_pages_with_nulls_and_equal_rows(spark, limit):
    ticks = rows.ticks(
        spark,
        *(dict(ts_event_ns=T0, size=i, price=price) for i in (None, 0, 1) for price in (None, 0.0, None, -1.0)),
        *(dict(ts_event_ns=T0 + 1) for _ in range(6)),
    )
    order = rows.values(ticks.orderBy(*TICK_ORDER), "size", "price")
    seen, after = [], None
    while True:
        got = pages.ticks_page(ticks, "AA", START, END, limit=limit, after=after, keyed=True).collect()
        seen += [(r.key.size, r.key.price) for r in got]
        if not got[-1].has_more:
            break
        after = got[-1].key.asDict()
    assert seen == order


def test_keyset_needs_the_whole_key(five):
    with pytest.raises(ValueError):
        pages.ticks_page(five, "AA", START, END, after={"ts_event_ns": 1})


def test_deep_pages_equal_plain_ones(spark):
    """Ties on one nanosecond, hot slices, sparse stretches and pages past the end."""
    random.seed(3)
    spread = [dict(ts_event_ns=T0 + random.randrange(10**12), order_id=i, sequence=i) for i in range(150)]
    burst = [dict(ts_event_ns=T0 + 5 * 10**11, order_id=1000 + i, sequence=random.randrange(40)) for i in range(300)]
    same = [dict(ts_event_ns=T0 + 6 * 10**11, order_id=2000 + i, sequence=7) for i in range(60)]
    ticks = rows.ticks(spark, *spread, *burst, *same).repartition(8).cache()
    order = [r.order_id for r in ticks.orderBy(*TICK_ORDER).select("order_id").collect()]
    for offset in (0, 3, 70, 120, 333, 444, 480, 505, 509, 600):
        got = pages.ticks_page(ticks, "AA", START, END, limit=9, offset=offset, direct_rows=20).collect()
        assert [r.order_id for r in got] == order[offset : offset + 9], offset
        assert all(r.has_more == (offset + 9 < 510) for r in got)


def test_concatenated_pages_are_the_slice(spark):
    ticks = samples.line_ticks(spark, f"{TESTDATA}/sf0.001").withColumn("symbol", F.lit("AA")).cache()
    whole = pages.slice_ticks(ticks, "1990-01-01", "2010-01-01", "AA").select("order_id", "ts_event_ns", "price")
    parts = []
    for offset in range(0, 6_000, 2_000):
        got = pages.ticks_page(ticks, "AA", "1990-01-01", "2010-01-01", limit=2_000, offset=offset, direct_rows=2_500)
        parts += rows.values(got, "order_id", "ts_ns", "price")
    assert parts == rows.values(whole)


def test_latest_is_newest_first_and_strictly_within(spark):
    now = T0 + clock.MINUTE
    ticks = rows.ticks(
        spark, *(dict(ts_event_ns=t, order_id=i) for i, t in enumerate([T0, T0 + 1, now - 1, now]))
    )
    got = pages.latest(ticks, "AA", anchor_ns=now).collect()
    assert [r.order_id for r in got] == [3, 2, 1]
    assert [r.order_id for r in pages.latest(ticks, "AA", n=1, anchor_ns=now).collect()] == [3]
    assert pages.latest(ticks, "AA").count() == 0


def test_head(five):
    assert [r.order_id for r in pages.head(five, 2, ordered=True).collect()] == [4, 5]
    assert pages.head(five, 3).count() == 3
    assert pages.head(five).count() == five.count()


@pytest.mark.parametrize("closed,expected", [(False, [0, 1]), (True, [0, 1, 2])])
def test_time_range_ends(spark, closed, expected):
    ticks = rows.ticks(spark, *(dict(ts_event_ns=T0 + i, order_id=i) for i in range(-1, 4)))
    got = filters.time_range(ticks, T0, T0 + 2, closed)
    assert sorted(r.order_id for r in got.collect()) == expected


def test_time_filters_reach_the_scan(spark):
    ticks = samples.event_ticks(spark, f"{TESTDATA}/sf0.001")
    plan = filters.time_range(ticks, START, END)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-02" in plan
