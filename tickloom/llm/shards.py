"""Token-id output in training order: fixed-stride shards of permuted sequences.

Texts are encoded and cut into sequences of ``length`` ids; each becomes a
record of fixed size: the number of ids, then the ids, padded, all as
little-endian unsigned 16-bit integers.  The records are written once, and
numbered 0 to n - 1 as they lie there.  A keyed Feistel network over the next
even number of bits, walked on until it falls below n, turns the numbers into
slots: a permutation that every task computes for itself, without any table.

Slot s belongs to shard s // shard_size and lies at byte
(s % shard_size) * stride of it.  Shards are range partitions of the slots; a
task sorts its records and puts them out as consecutive blocks of bytes.  A
reader goes through a shard block by block, and resumes at any slot by its
shard, block and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_file
from .common import saved, ship, table, texts
from .lengths import rank_ids

LENGTH = 256  # ids of a sequence
SHARD = 1 << 16  # sequences of a shard
BLOCK = 1 << 12  # sequences of a block
MOST_TASKS = 20_000  # beyond so many shards a task writes several, one after another
ROUNDS = 6


def stride(length: int) -> int:
    """Bytes of a record."""
    return 2 * (length + 1)


def mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit values."""
    x = values + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(values: np.ndarray, half: int, key: int) -> np.ndarray:
    """A permutation of the numbers below 4 ** half."""
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = values >> bits, values & mask
    for k in range(ROUNDS):
        round_key = (key * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % (1 << 64)
        left, right = right, left ^ (mixed(right, round_key) & mask)
    return (left << bits) | right


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers: a permutation of 0 to n - 1 chosen by the key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = feistel(numbers.astype(np.uint64), half, key)
    while (outside := out >= n).any():
        out[outside] = feistel(out[outside], half, key)
    return out.astype(np.int64)


def records(ids: list[int], length: int) -> list[bytes]:
    """Records of a text's ids; none for no ids."""
    out = []
    for at in range(0, len(ids), length):
        part = ids[at : at + length]
        record = np.zeros(length + 1, "<u2")
        record[0] = len(part)
        record[1 : len(part) + 1] = part
        out.append(record.tobytes())
    return out


def sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, record): the sequences of every text, each text ended by end_id.

    A NULL text counts as empty: one sequence with end_id alone.
    """
    rows = texts(docs, id_col, text_col)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [records([*encode(t), end_id], length) for t in part.column(1).to_pylist()]
                which = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(which)),
                        pa.array([k for c in cut for k in range(len(c))], pa.int32()),
                        pa.array([r for c in cut for r in c], pa.binary()),
                    ],
                    names=["id", "part", "record"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part int, record binary")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows of a written table with a number, 0 to n - 1, and n.

    The number is the row's place in its file after all rows of the files
    before it; nothing is sorted or shuffled.  There is one file for each task
    that wrote the table, so that the files' counts are a small table.
    """
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    counts = rows.groupBy("file").count()
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))), "sequence-counts")
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(counts.select("file", "first")), "file")
    return rows.withColumn("number", F.col("first") + F.col("place")).drop("file", "place", "first"), n


def shard_blocks(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    key: int = 0,
    length: int = LENGTH,
    shard_size: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(shard, first_slot, n_sequences, bytes): all shards, in blocks of records in slot order.

    Every sequence has one slot, every slot from 0 on one sequence.  The order
    depends on the key and on how the input is split into files.  A NULL text
    counts as empty; empty texts and repeated rows are sequences like any
    other; without rows there are no shards.  Ids above 65,535 do not fit.
    """
    ship(docs.sparkSession)
    rows, n = numbered(saved(sequences(docs, tokenizer, end_id, length, id_col, text_col), "sequences"))

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(), n, key))

    shards = max(1, -(-n // shard_size))
    tasks = min(shards, MOST_TASKS)
    rows = rows.select(slot("number").alias("slot"), "record")
    shard = F.floor(F.col("slot") / shard_size)
    ranged = rows.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot")
    block = min(BLOCK, shard_size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        first = 0

        def out():
            columns = [[first // shard_size], [first], [len(held)], [b"".join(held)]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "first_slot", "n_sequences", "bytes"]
            )

        for batch in batches:
            for at, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # blocks begin at multiples of their size within each shard
                if held and (at % shard_size) % block == 0:
                    yield out()
                    held = []
                if not held:
                    first = at
                held.append(record)
        if held:
            yield out()

    return ranged.mapInArrow(pack, "shard long, first_slot long, n_sequences int, bytes binary")


BLOCKS = "first_slot long, n_sequences int, bytes binary, shard long"


def write_shards(blocks: DataFrame, path: str) -> None:
    """Blocks as a folder for each shard, and what they are in path/_layout (see layout()); blocks lie in slot order in their file."""
    spark = blocks.sparkSession
    blocks.write.partitionBy("shard").parquet(path)
    rows = spark.read.schema(BLOCKS).parquet(path)
    of_block = F.octet_length("bytes") / F.col("n_sequences")
    found = rows.agg(
        F.coalesce(F.sum("n_sequences"), F.lit(0)).alias("n"),
        F.max(of_block).cast("int").alias("stride"),
        # the first slot of the second shard; NULL if one shard holds all
        F.min(F.when(F.col("shard") == 1, F.col("first_slot"))).alias("shard_size"),
    )
    found.coalesce(1).write.parquet(f"{path}/_layout")


def layout(spark: SparkSession, path: str) -> tuple[int, int | None, int | None]:
    """(sequences, bytes of a record, sequences of a shard) of a written output; None where nothing shows them."""
    return tuple(spark.read.parquet(f"{path}/_layout").first())


def read_slots(spark: SparkSession, path: str, start: int, stop: int, length: int = LENGTH, shard_size: int = SHARD) -> DataFrame:
    """(slot, ids) of the slots from start to before stop; only their shards and blocks are read.

    Slots outside the output are no rows; an empty output has none.  A length or
    shard size other than that of the output is an error.
    """
    _, of_record, of_shard = layout(spark, path)
    if of_record not in (None, stride(length)) or of_shard not in (None, shard_size):
        raise ValueError(f"{path} has records of {of_record} bytes and shards of {of_shard} sequences")
    rows = spark.read.schema(BLOCKS).parquet(path)
    rows = rows.filter(F.col("shard").between(start // shard_size, max(start, stop - 1) // shard_size))
    rows = rows.filter((F.col("first_slot") < stop) & (F.col("first_slot") + F.col("n_sequences") > start))
    ship(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                all_ids = np.frombuffer(data, "<u2").reshape(n, length + 1)
                picked = range(max(start, first), min(stop, first + n))
                ids = [all_ids[s - first, 1 : 1 + all_ids[s - first, 0]].astype("int32") for s in picked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(picked), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "ids"]
                )

    return rows.select("first_slot", "n_sequences", "bytes").mapInArrow(cut, "slot long, ids array<int>")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_blocks(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), end_id=50256, key=20_240_607)
