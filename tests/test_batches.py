import random

import pytest
from pyspark.sql import functions as F

from tickloom.plans import batches


def plain(lines, max_bytes, max_rows):
    """Batches of lines (file, place, value), one line after another."""
    files = {}
    for file, place, value in sorted(lines, key=lambda line: (line[0] is not None, line[0], line[1])):
        files.setdefault(file, []).append(value or "")
    found = []
    for file, values in files.items():
        batch, number = "", 0
        for i, value in enumerate(values):
            batch += value + "\n"
            if len(batch.encode()) >= max_bytes or batch.count("\n") >= max_rows or i == len(values) - 1:
                found.append((file, number, batch.count("\n"), len(batch.encode()), batch))
                batch, number = "", number + 1
    return sorted(found, key=str)


def batched(spark, lines, **bounds):
    frame = spark.createDataFrame(lines, "at string, batch long, value string").repartition(5)
    made = batches.batched_lines(frame, F.col("at"), [F.col("batch")], F.col("value"), **bounds)
    return sorted((tuple(row) for row in batches.batch_texts(made).collect()), key=str)


def some_lines(seed, *counts):
    rng = random.Random(seed)
    return [
        (f"f{f}" if f else None, i, rng.choice(["", "é", "x" * rng.randrange(90), None, "long " * 30]))
        for f, count in enumerate(counts)
        for i in range(count)
    ]


@pytest.mark.parametrize(
    "bounds",
    [
        dict(max_bytes=300, max_rows=10, slice_rows=7),  # a slice is shorter than a batch
        dict(max_bytes=1_000, max_rows=12, slice_rows=100),
        dict(max_bytes=10_000, max_rows=200, slice_rows=20),  # many slices without an end
        dict(max_bytes=1, max_rows=5, slice_rows=50),
        dict(max_bytes=10**9, max_rows=1, slice_rows=50),
        dict(max_bytes=10**9, max_rows=10**6),
    ],
)
def test_batches_of_files(spark, bounds):
    """One file holds most lines; one has no name; tables go up two levels and down again."""
    lines = some_lines(bounds["max_rows"], 40, 1500, 1, 90)
    assert batched(spark, lines, **bounds) == plain(lines, bounds["max_bytes"], bounds["max_rows"])


@pytest.mark.parametrize("stretch", [(4, 10**6), (256, 5)])  # the latter is shorter than a batch
def test_batches_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(batches, "STRETCH_BATCHES", stretch[0])
    monkeypatch.setattr(batches, "STRETCH_ROWS", stretch[1])
    lines = some_lines(7, 40, 960, 1, 90)
    bounds = dict(max_bytes=700, max_rows=12, slice_rows=7)
    assert batched(spark, lines, **bounds) == plain(lines, 700, 12)


def test_links_that_are_doubled(spark, monkeypatch, tmp_path):
    """Links of lines are written once, and few in all rounds together, also where batches and slices are small."""
    monkeypatch.setattr(batches, "work_dir", lambda spark, name: str(tmp_path / name))
    lines = [("a", i, "x" * (i % 7)) for i in range(6000)]
    bounds = dict(max_bytes=12, max_rows=3, slice_rows=50)
    assert batched(spark, lines, **bounds) == plain(lines, 12, 3)
    written = sum(spark.read.parquet(str(links)).count() for links in tmp_path.glob("batches/links*"))
    assert len(lines) < written < 1.5 * len(lines)


def test_no_lines(spark):
    assert batched(spark, []) == []


def test_bounds_are_positive(spark):
    with pytest.raises(ValueError):
        batched(spark, [], max_rows=0)


def test_lines_of_a_batch(spark):
    """The lines come with their places, whatever other columns there are."""
    frame = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, "three")], "key string, node long, size string")
    made = batches.batched_lines(frame, F.col("key"), [F.col("node")], F.col("size"), max_rows=2)
    assert [tuple(r) for r in made.orderBy("file", "at").select("file", "batch", "value").collect()] == [
        ("a", 0, "one"),
        ("a", 0, "two"),
        ("a", 1, "three"),
    ]
