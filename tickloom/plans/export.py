"""Export of ticks as 15-minute Parquet slots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators.filters import When, for_symbol, time_range
from ..schema import EXPORT_PARTITIONS, TICK, TICK_COLUMNS, TICK_ORDER
from ..session import work_dir
from ..sources import folders


def with_slots(ticks: DataFrame) -> DataFrame:
    ns = F.col("ts_event_ns")
    return ticks.select(*TICK_COLUMNS, clock.date_of(ns).alias("date"), clock.slot_of(ns).alias("slot"))


def export_slots(
    ticks: DataFrame,
    root: str,
    start: When | None = None,
    end: When | None = None,
    symbol: str | None = None,
    max_records_per_file: int = 0,
) -> None:
    """Write ticks of [start, end) to ``date=/slot=`` folders, zstd, sorted by time.

    Exporting a slot again replaces it, as far as the range goes: of a slot in
    which the range begins or ends, the exported rows outside it stay.  Slots for
    which the range has no ticks are not touched.  With a symbol only its ticks
    are written, below ``symbol=``.  The rebalance gathers thin slots in one task
    and cuts a hot slot (an opening auction with a third of the day) into several
    files, each sorted.
    """
    rows = time_range(ticks if symbol is None else for_symbol(ticks, symbol), start, end)
    parts = ["date", "slot"] if symbol is None else ["symbol", "date", "slot"]
    slotted = with_slots(rows)
    for kept in _outside(rows, root, start, end, symbol):
        slotted = slotted.unionByName(with_slots(kept))
    (
        slotted.hint("rebalance", F.col("date"), F.col("slot"))
        .sortWithinPartitions(*parts, *TICK_ORDER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*parts)
        .parquet(root)
    )


def _outside(
    rows: DataFrame, root: str, start: When | None, end: When | None, symbol: str | None
) -> Iterator[DataFrame]:
    """Exported rows before start, or from end on, of the two slots at most that the range cuts and has ticks for.

    They are copied first: the write must not replace what it still has to read.
    """
    spark = rows.sparkSession
    first, last = (None if bound is None else clock.as_ns(bound) for bound in (start, end))
    if first is not None and last is not None and last <= first:
        return
    base = root.rstrip("/") + ("" if symbol is None else f"/symbol={folders.folder_name(symbol)}")
    for slot in sorted({bound - bound % clock.SLOT for bound in (first, last) if bound is not None and bound % clock.SLOT}):
        path = f"{base}/date={clock.date_of_ns(slot).isoformat()}/slot={clock.slot_of_ns(slot)}"
        if folders.children(spark, path) is None or time_range(rows, slot, slot + clock.SLOT).isEmpty():
            continue
        there = spark.read.schema(TICK).option("pathGlobFilter", "*.parquet").parquet(path)
        if symbol is not None:
            there = there.withColumn("symbol", F.lit(symbol))  # its folder has it
        ns = F.col("ts_event_ns")
        outside = [ns < first] if first is not None else []
        outside += [ns >= last] if last is not None else []
        copy = work_dir(spark, "export-rest")
        there.where(reduce(Column.__or__, outside)).write.parquet(copy)
        yield spark.read.schema(TICK).parquet(copy)


def export_manifest(spark: SparkSession, root: str, symbol: str | None = None) -> DataFrame:
    """What lies in an export: for every slot its rows, its files, and the name it goes by.

    Rows are counted from the footers of the files that were written.
    """
    folders.require(spark, root)
    where = "" if symbol is None else f"/symbol={folders.folder_name(symbol)}"
    files = spark.read.schema(EXPORT_PARTITIONS).option("pathGlobFilter", "*.parquet").option("basePath", root)
    each = files.parquet(root.rstrip("/") + where).groupBy("date", "slot", "_metadata.file_path").count()
    counted = each.groupBy("date", "slot").agg(F.sum("count").alias("cnt"), F.count("*").alias("n_files"))
    name = text.slot_filename(F.col("date"), F.col("slot"), None if symbol is None else F.lit(symbol))
    return counted.withColumn("file_name", name)


def export_totals(manifest: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return manifest.agg(
        F.coalesce(F.sum("cnt"), none).alias("total_rows"), F.coalesce(F.sum("n_files"), none).alias("total_files")
    )
