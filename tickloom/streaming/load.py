"""Incremental load: only raw files not seen before."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import prepared_map
from ..plans.load import append_ticks, as_ticks, mapped
from ..sources import folders
from ..sources.raw import RAW_FILES, raw_columns, with_source_file


def ingest_stream(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    symbol_map: DataFrame,
    allowlist: DataFrame | None = None,
    name: str = "stream",
    hourly: bool = True,
    max_files: int | None = None,
    max_bytes: str | None = None,
    max_records_per_file: int = 0,
    time_ordered: bool = False,
    ignore_corrupt: bool = False,
) -> StreamingQuery:
    """Load new raw files of a folder into the tick table, then stop.

    The checkpoint remembers the files.  Each micro-batch is one load of the
    table, named by stream, checkpoint and batch number: a batch repeated after a failure
    replaces its own rows, which makes the load exactly-once.  Writing through
    a batch job also keeps the rebalance of :func:`append_ticks`.  ``max_files``
    or ``max_bytes`` bounds a batch; ``time_ordered`` is for files in feed order.
    A file that cannot be read stops the load unless ``ignore_corrupt`` skips it.
    """
    symbol_map, small = prepared_map(symbol_map)
    # streams with another checkpoint number their batches anew: they must not share names
    where = hashlib.sha256(folders.qualified(spark, checkpoint).encode()).hexdigest()[:12]

    reader = spark.readStream.schema(raw_columns()).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    raw = with_source_file(reader.parquet(f"{source.rstrip('/')}/{RAW_FILES}"))

    def write(batch: DataFrame, number: int) -> None:
        kept = mapped(batch, symbol_map, allowlist, small=small).where(F.col("keep"))
        load = f"{name}-{where}-{number:09d}"
        append_ticks(as_ticks(kept), root, load, hourly, max_records_per_file, time_ordered and small)

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
