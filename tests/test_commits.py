"""The log of loads: what a scan sees while loads die, repeat and race; and what the log answers."""

import glob
import os
import threading

import pytest
import rows
from conftest import TESTDATA
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import catalog, pages
from tickloom.plans import facts, load
from tickloom.schema import TICK_COLUMNS
from tickloom.sources import commits, folders, samples
from tickloom.sources import ticks as tick_source

SF = f"{TESTDATA}/sf0.001"


def at_hours(spark, *hours, mark=0):
    return rows.ticks(spark, *(dict(at=f"2024-01-02 {hour:02d}:30:00", order_id=hour, flags=mark) for hour in hours))


def seen(spark, root):
    return sorted(rows.values(tick_source.scan_table(spark, root), "load", "order_id", "flags"))


class Killed(BaseException):
    """Ends a load as the death of its driver would: nothing cleans up."""


@pytest.mark.parametrize("hourly", [True, False])
def test_a_load_that_dies_is_not_seen(spark, tmp_path, monkeypatch, hourly):
    root = str(tmp_path / "table")

    def die(*_):
        raise Killed

    def killed(mark):
        with monkeypatch.context() as patch:
            patch.setattr(commits, "commit", die)
            with pytest.raises(Killed):
                load.append_ticks(at_hours(spark, 9, 11, mark=mark), root, load="a", hourly=hourly)

    # first of all loads: its folders are there, and do not count
    killed(1)
    assert glob.glob(f"{root}/date=*/**/*.parquet", recursive=True) and seen(spark, root) == []
    load.append_ticks(at_hours(spark, 9, 10, mark=2), root, load="a", hourly=hourly)
    load.append_ticks(at_hours(spark, 9, mark=2), root, load="b", hourly=hourly)
    want = [("a", 9, 2), ("a", 10, 2), ("b", 9, 2)]
    assert seen(spark, root) == want
    # a repetition that dies leaves the load as it was; half of its folders in place make no difference
    killed(3)
    assert seen(spark, root) == want
    half = sorted(glob.glob(f"{root}/date=*/**/load=a~2", recursive=True))[0]
    folders.delete(spark, half)
    assert seen(spark, root) == want
    # the next one replaces all, and removes what no longer counts
    load.append_ticks(at_hours(spark, 10, 12, mark=4), root, load="a", hourly=hourly)
    assert seen(spark, root) == [("a", 10, 4), ("a", 12, 4), ("b", 9, 2)]
    left = {os.path.basename(path) for path in glob.glob(f"{root}/date=*/**/load=*", recursive=True)}
    assert left == {"load=a~3", "load=b"}


def test_of_two_attempts_at_once_one_counts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    load.append_ticks(at_hours(spark, 9), root, load="a")
    both, outcomes = threading.Barrier(2, timeout=120), []
    commit = commits.commit

    def together(*args):
        both.wait()
        commit(*args)

    monkeypatch.setattr(commits, "commit", together)

    def attempt(mark):
        try:
            load.append_ticks(at_hours(spark, 10, 10 + mark, mark=mark), root, load="a")
            outcomes.append(mark)
        except RuntimeError as failure:
            outcomes.append(str(failure))

    threads = [threading.Thread(target=attempt, args=(mark,)) for mark in (1, 2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    (won,) = [mark for mark in outcomes if isinstance(mark, int)]
    assert sum("committed by another" in str(o) for o in outcomes) == 1
    assert seen(spark, root) == [("a", 10, won), ("a", 10 + won, won)]
    assert len(glob.glob(f"{root}/date=*/**/load=a*", recursive=True)) == 2


def test_an_attempt_that_began_later_is_left_alone(spark, tmp_path):
    root = str(tmp_path / "table")
    first, version = commits.begin(spark, root, "a")
    second, same = commits.begin(spark, root, "a")
    assert (first, second, version, same) == (0, 1, 0, 0)
    done = commits.Commit("a", version, second)
    commits.commit(spark, root, done)
    third, later = commits.begin(spark, root, "a")
    assert (third, later) == (2, 1) and commits.unremoved(spark, root, done) == [0]
    with pytest.raises(RuntimeError):
        commits.commit(spark, root, commits.Commit("a", version, first))
    with pytest.raises(ValueError):
        commits.begin(spark, root, "a~1")


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "x" / "one")
    assert folders.put_if_absent(spark, path, "é1") and not folders.put_if_absent(spark, path, "2")
    assert folders.content(spark, path) == "é1" and folders.children(spark, str(tmp_path / "x")) is not None
    many = str(tmp_path / "x" / "many")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(folders.put_if_absent(spark, many, str(k)))) for k in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert any(won) and folders.content(spark, many) in set("01234567")


def test_no_load_searches_the_table(spark, tmp_path, monkeypatch):
    """Appends, repetitions and registrations list the log, the root and one date; never all folders."""
    root = str(tmp_path / "table")
    load.append_ticks(samples.event_ticks(spark, SF), root, load="a")
    load.ensure_table(spark, "ticks_log", root)
    searched, listed = [], []
    children = folders.children
    monkeypatch.setattr(folders, "matching", lambda _, pattern: searched.append(pattern) or [])
    monkeypatch.setattr(folders, "children", lambda s, path: listed.append(path) or children(s, path))
    try:
        load.append_ticks(at_hours(spark, 9), root, load="b", table="ticks_log")
        load.append_ticks(at_hours(spark, 10, 11), root, load="b", table="ticks_log")
        assert searched == [] and len(listed) <= 16
        found = rows.values(spark.table("ticks_log").where("load LIKE 'b%'"), "load", "hour")
        assert sorted(found) == [("b~1", 10), ("b~1", 11)]
    finally:
        spark.sql("DROP TABLE ticks_log")


def test_tables_from_before_the_log(spark, tmp_path):
    root = str(tmp_path / "table")
    old = load.with_partitions(at_hours(spark, 9, 10))
    for name in ("a", "o'dd %"):
        old.withColumn("load", F.lit(name)).write.mode("append").partitionBy("date", "hour", "load").parquet(root)
    assert len(seen(spark, root)) == 4
    load.append_ticks(at_hours(spark, 10, mark=1), root, load="a")
    assert seen(spark, root) == [("a", 10, 1), ("o'dd %", 9, 0), ("o'dd %", 10, 0)]
    load.append_ticks(at_hours(spark, 11, mark=2), root, load="o'dd %")
    assert seen(spark, root) == [("a", 10, 1), ("o'dd %", 11, 2)]


def test_what_a_commit_says(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = rows.ticks(spark, dict(at="1969-12-31 23:00:00"), dict(at="2024-01-02 09:59:59"), dict(at="2024-01-02 09:00:00"), dict(ts_event_ns=None))
    load.append_ticks(ticks, root, load="a")
    (done,) = commits.committed(spark, root)
    assert (done.rows, done.first_ns, done.last_ns) == (4, clock.as_ns("1969-12-31T23:00:00Z"), clock.as_ns("2024-01-02T09:59:59Z"))
    # hours are marked modulo 32,768; only marked ones in the range are named
    assert {("1969-12-31", 23), ("2024-01-02", 9), (None, None)} <= set(done.parts) and len(done.parts) < 40
    load.append_ticks(ticks.limit(0), root, load="empty")
    assert facts.row_count(spark, root) == 4 == tick_source.scan_table(spark, root).count()
    load.append_ticks(ticks.limit(0), root, load="a")
    assert tick_source.scan_table(spark, root).count() == 0
    assert not glob.glob(f"{root}/date=*/**/*.parquet", recursive=True)


def test_facts_answer_as_scans_do(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = samples.event_ticks(spark, SF)
    load.append_ticks(ticks, root, load="a", with_facts=True, hourly=False)
    load.append_ticks(ticks.where("symbol < 'S00008'"), root, load="b", hourly=False)  # notes no facts
    load.append_ticks(ticks.where("action = 'T'"), root, load="a", with_facts=True, hourly=False)
    load.append_ticks(ticks.limit(0), root, load="c", with_facts=True, hourly=False)
    scan, noted = tick_source.scan_table(spark, root), facts.table_facts(spark, root)
    for ask in ("data_ranges", "count_by_date", "count_by_symbol", "symbols"):
        assert sorted(getattr(facts, ask)(noted).collect()) == sorted(getattr(catalog, ask)(scan).collect())
    for symbol in ("S00007", "none"):
        assert facts.data_range(noted, symbol).collect() == catalog.data_range(scan, symbol).collect()
    # no file of ticks is opened where all loads have noted theirs
    load.append_ticks(ticks.where("symbol < 'S00008'"), root, load="b", with_facts=True, hourly=False)
    noted = facts.table_facts(spark, root)
    assert all("/_facts/" in path for path in noted.inputFiles()) and noted.inputFiles()
    scan = tick_source.scan_table(spark, root)  # the files of the earlier one are gone
    assert sorted(facts.count_by_date(noted).collect()) == sorted(catalog.count_by_date(scan).collect())
    assert len(os.listdir(f"{root}/_facts")) == 2
    assert list(tick_source.scan_table(spark, root).select(*TICK_COLUMNS).columns) == TICK_COLUMNS


def test_pages_by_the_counts_of_days(spark, tmp_path):
    root = str(tmp_path / "table")
    ticks = samples.event_ticks(spark, SF)
    morning = clock.hour_of(F.col("ts_event_ns")) < 12
    load.append_ticks(ticks, root, load="a", with_facts=True, hourly=False)
    load.append_ticks(ticks.where(morning), root, load="a", with_facts=True, hourly=False)
    load.append_ticks(ticks.where(~morning), root, load="b", with_facts=True, hourly=False)
    scan = tick_source.scan_table(spark, root)
    ranges = (("2024-01-05", "2024-01-20"), ("2024-01-05T11:30:00Z", "2024-01-20T12:00:00Z"), ("2024-01-09T03:00:00Z", "2024-01-09T21:00:00Z"))
    for start, end in (*ranges, ("2023-01-01", "2025-01-01"), ("2025-01-01", "2025-01-02")):
        for offset in (0, 1, 7, 20, 500):
            wanted = pages.ticks_page(scan, "S00007", start, end, 5, offset).collect()
            assert facts.ticks_page(spark, root, "S00007", start, end, 5, offset).collect() == wanted
    # only the days of the page are read
    days = {path.split("date=")[1][:10] for path in facts.ticks_page(spark, root, "S00007", "2023-01-01", "2025-01-01", 2, 30).inputFiles()}
    assert 0 < len(days) <= 8
    assert facts.ticks_page(spark, root, "none", "2023-01-01", "2025-01-01").count() == 0


def test_pending_files_from_the_log(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "table")
    mapping = rows.symbol_map(spark, (1, "AA", clock.as_date("2024-01-01"), clock.as_date("2100-01-01")))
    for name, instrument in (("x", 1), ("nothing-kept", 2), ("y", 1)):
        tick = dict(ts_recv_ns=clock.as_ns("2024-01-10"), instrument_id=instrument)
        rows.raw(spark, tick).drop("source_file").write.parquet(str(raw / f"{name}.mbo.parquet"))
    files = spark.createDataFrame(
        [(path.name, f"file:{path}") for path in raw.iterdir()], "file_name string, path string"
    )
    assert load.pending_in_log(spark, files, root).count() == 3
    for name in ("x", "nothing-kept"):
        assert load.load_file(spark, str(raw / f"{name}.mbo.parquet"), root, mapping).error is None
    assert rows.values(load.pending_in_log(spark, files, root), "file_name") == [("y.mbo.parquet",)]
    plan = load.pending_in_log(spark, files, root)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
