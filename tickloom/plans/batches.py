"""Lines cut into batches by bytes and rows, file by file.

A batch ends with the line that brings it to ``max_bytes`` or ``max_rows``, and
the next one begins behind it: where a batch ends depends on every line before.
For each line the beginning of the batch after the one that begins there follows
from running sums alone.  Within stretches, each longer than some batches, those
links are followed to their ends at once.  What leads from stretch to stretch, for the few
lines of each at which a batch from before may end, is doubled round by round into links
over 2, 4, 8, ... stretches; from the longest down they then reach the first
beginning in every stretch, and from there all others are within it.  No task reads more than
a slice, a block or a stretch, also where one file holds most lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

# The bounds of a batch.
MAX_BYTES = 3_000_000
MAX_ROWS = 50_000

# Lines of a slice, and bytes of a block for each of them.
SLICE_ROWS = 262_144
LINE_BYTES = 64

# A stretch is that many of the longest batches, up to that many lines.
STRETCH_BATCHES = 256
STRETCH_ROWS = 262_144

# What numbers rows within partitions leaves 33 bits for the row.
_ROW_BITS = 33

# A link within a stretch: its line's place, and in that many bits how many lines it leads over.
_LINK_BITS = 40


def _before(frame: DataFrame, place: str, **sums: str) -> DataFrame:
    """(key, place, and for each of ``sums`` its total over the places before); one small row for each place."""
    earlier = Window.partitionBy("key").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    totals = frame.groupBy("key", place).agg(*(F.sum(column).alias(name) for name, column in sums.items()))
    return totals.select("key", place, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums))


def _rounds(size: int) -> Column:
    """An array with one element for each doubling up to ``size``."""
    return F.sequence(F.lit(1), F.lit(max(size - 1, 1).bit_length()))


def _over(jump: Column, size: Column) -> Column:
    """Of links within a stretch of ``size`` lines, those over twice as many batches; what leads out of it stays."""
    return F.transform(jump, lambda to: F.when(to < size, F.get(jump, to.cast("int"))).otherwise(to))


def _stretches(links: DataFrame, length: int, begins: DataFrame | None = None) -> DataFrame:
    """(key, first, size, jump, begin): links by their line's place in its stretch, to places counted from its first line.

    ``begin`` is the first place of a row of ``begins`` in the stretch.
    """
    place, none = F.col("n") % length, F.lit(None).cast("long")
    link = F.shiftleft(place, _LINK_BITS) + F.col("to") - F.col("n")
    rows = links.select("key", "n", link.alias("link"), none.alias("begin"))
    if begins is not None:
        rows = rows.union(begins.select("key", "n", none, place))
    found = rows.groupBy("key", (F.col("n") - place).alias("first")).agg(
        F.count("link").alias("size"), F.sort_array(F.collect_list("link")).alias("links"), F.min("begin").alias("begin")
    )
    jump = F.transform("links", lambda link: F.shiftright(link, _LINK_BITS) + link.bitwiseAND((1 << _LINK_BITS) - 1))
    return found.select("key", "first", "size", jump.alias("jump"), "begin")


def _through(links: DataFrame, length: int) -> DataFrame:
    """(key, n, to) from lines at which a batch of an earlier stretch may end to the first beginning in a later one."""
    size = F.col("size")
    # later lines' links lead no less far, so all lead out where the first one does
    last = F.aggregate(
        _rounds(length), F.col("jump"), lambda jump, _: F.when(F.get(jump, F.lit(0)) >= size, jump).otherwise(_over(jump, size))
    )
    ends = F.slice(last, F.lit(1), F.least(F.get("jump", F.lit(0)) + 1, size).cast("int"))
    found = _stretches(links, length).select("key", "first", F.posexplode(ends).alias("place", "to"))
    return found.select("key", (F.col("first") + F.col("place")).alias("n"), (F.col("first") + F.col("to")).alias("to"))


def _within(links: DataFrame, length: int, begins: DataFrame) -> DataFrame:
    """(key, n, batch) of all beginnings, from the first in each stretch; ``batch`` numbers them within a key."""
    size = F.col("size")

    def further(found: Column, _: Column) -> Column:
        begun = F.transform(found["path"], lambda place: F.get(found["jump"], place.cast("int")))
        path = F.concat(found["path"], F.filter(begun, lambda place: place < size))
        twice = F.struct(path.alias("path"), _over(found["jump"], size).alias("jump"))
        return F.when(F.get(found["jump"], F.lit(0)) >= size, found).otherwise(twice)

    start = F.struct(F.array("begin").alias("path"), F.col("jump").alias("jump"))
    path = F.aggregate(_rounds(length), start, further, lambda found: found["path"])
    # a file's end may be among them
    paths = _stretches(links, length, begins).where("begin < size").select("key", "first", path.alias("path"))
    earlier = Window.partitionBy("key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    paths = paths.withColumn("more", F.coalesce(F.sum(F.size("path")).over(earlier), F.lit(0)))
    found = paths.select("key", "first", "more", F.posexplode("path").alias("batch", "place"))
    return found.select("key", (F.col("first") + F.col("place")).alias("n"), (F.col("more") + F.col("batch")).alias("batch"))


def batched_lines(
    lines: DataFrame,
    file: Column,
    order: Sequence[Column],
    value: Column,
    max_bytes: int = MAX_BYTES,
    max_rows: int = MAX_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every line with its batch: ``file``, ``batch`` (from 0 in each file), ``at`` (rises within a file), ``value``.

    A line counts its UTF-8 bytes and one for the line feed; a NULL line is an empty one.  Rows without a file make up
    one file.  ``order`` must tell the lines of a file apart, equal places come in any order.  No lines give no rows.
    The lines are sorted and written once to the work folder: later steps must see the same order.
    """
    if min(max_bytes, max_rows, slice_rows) < 1:
        raise ValueError("bounds of batches and slices must be positive")
    spark = lines.sparkSession
    root = work_dir(spark, "batches")

    def saved(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    name = file.cast("string")
    # the texts are made behind the exchange: what deals the lines reads its input twice
    placed = lines.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    text = F.coalesce(value.cast("string"), F.lit(""))
    written = saved(placed.select(name.alias("file"), text.alias("value"), F.monotonically_increasing_id().alias("at")), "lines")

    # each line's number in its file, and the bytes before it
    row = F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = written.select(
        F.coalesce(F.concat(F.lit("="), F.col("file")), F.lit("")).alias("key"),
        (F.col("at") - row % slice_rows).alias("slice"),
        "at",
        (F.octet_length("value") + 1).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"),
    )
    so_far = Window.partitionBy("key", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = sizes.withColumns({"lines": F.sum("one").over(so_far) - 1, "bytes": F.sum("size").over(so_far) - F.col("size")})
    numbered = numbered.join(_before(sizes, "slice", more="one", more_bytes="size"), ["key", "slice"]).select(
        "key", "slice", "at", (F.col("lines") + F.col("more")).alias("n"), (F.col("bytes") + F.col("more_bytes")).alias("before")
    )
    numbered = saved(numbered, "numbered")

    # the next batch begins with the first line before which there are max_bytes more
    spots = numbered.select("key", "n", F.col("before").alias("spot"), F.lit(1).cast("long").alias("line")).union(
        numbered.select("key", "n", F.col("before") + max_bytes, F.lit(0).cast("long"))
    )
    block = max(max_bytes, slice_rows * LINE_BYTES)
    spots = spots.withColumn("block", F.floor(F.col("spot") / block))
    # of equal spots the sought one comes first, so that it counts the lines before it only
    so_far = Window.partitionBy("key", "block").orderBy("spot", "line").rowsBetween(Window.unboundedPreceding, 0)
    found = spots.withColumn("lines", F.sum("line").over(so_far)).where("line = 0")
    found = found.join(_before(spots, "block", more="line"), ["key", "block"])
    to = F.least(F.col("lines") + F.col("more"), F.col("n") + max_rows)
    each = saved(found.select("key", "n", to.alias("to")), "links")
    longest = each.agg(F.max(F.col("to") - F.col("n"))).first()[0] or 1
    length = min(longest * STRETCH_BATCHES, STRETCH_ROWS)
    links = [saved(_through(each, length), "links-0")]
    while True:
        last = links[-1]
        after = last.select("key", F.col("n").alias("to"), F.col("to").alias("beyond"))
        twice = last.join(after, ["key", "to"]).select("key", "n", F.col("beyond").alias("to"))
        twice = saved(twice, f"links-{len(links)}")
        if twice.where("n = 0").isEmpty():
            break
        links.append(twice)

    begins = links[0].where("n = 0").select("key", "n")
    for level in reversed(range(len(links))):
        further = begins.join(links[level], ["key", "n"]).select("key", F.col("to").alias("n"))
        begins = saved(begins.union(further), f"begins-{level}")

    # a line is in the last batch that began
    begun = numbered.join(_within(each, length, begins), ["key", "n"], "left")
    so_far = Window.partitionBy("key", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = begun.groupBy("key", "slice").agg(F.max("batch").alias("last"))
    slices = slices.select("key", "slice", F.max("last").over(earlier).alias("open"))
    marks = begun.withColumn("batch", F.max("batch").over(so_far)).join(slices, ["key", "slice"])
    marks = marks.select("at", F.coalesce("batch", "open").alias("batch"))
    return written.join(marks, "at").select("file", "batch", "at", "value")


def batch_texts(batched: DataFrame) -> DataFrame:
    """One row for each batch: ``file``, ``batch``, ``rows``, ``bytes``, ``text``.

    A text has at most the batch's bound and one more line, so that collecting a batch into a row is bounded.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda line: line["value"])
    return (
        batched.groupBy("file", "batch")
        .agg(F.count("*").alias("rows"), F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))
        .select("file", "batch", "rows", F.octet_length("text").cast("long").alias("bytes"), "text")
    )
