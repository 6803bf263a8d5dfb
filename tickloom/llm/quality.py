"""Quality rules: counts of repetition and noise, and a likelihood ratio against a trusted target.

Two multinomials over hashed word n-grams (one and two words) are compared: one
of the trusted documents, one of the raw corpus, which is every document.  A
document's score is the mean of log p_target - log p_raw over its n-grams, so
that length does not count.  Documents whose score lies below a fixed threshold
are rejected: what they are made of hardly occurs in trusted text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, keep_rows, map_texts, ship, slices, table, texts

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

BUCKETS = 1 << 16  # of hashed n-grams; both models have so many numbers, whatever the corpus
TRUSTED = 50_000  # most labelled documents the target model is fitted on
THRESHOLD = -0.15  # lowest score kept, in nats for each n-gram
PRIOR = 10  # occurrences, at the corpus's own rate, that each bucket of the target is given beforehand


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more, its first place included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, until = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + WINDOW - max(at, until)
            until = at + WINDOW
    return covered


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def ngrams(text: str, buckets: int) -> np.ndarray:
    """Buckets of a text's words and word pairs, repeats included."""
    words = text.encode().lower().split()
    crc = zlib.crc32
    ones = [crc(w) for w in words]
    twos = [crc(b, a) for a, (_, b) in zip(ones, pairwise(words))]
    return np.array(ones + twos, np.int64) % buckets


def trusted_ids(labels: DataFrame, most: int, id_col: str, quality_col: str) -> DataFrame:
    """Ids labelled 1, at most ``most`` of them, chosen by a hash of the id; an id also labelled otherwise is left out."""
    ids = labels.groupBy(column(id_col).alias("id")).agg(F.min(column(quality_col).cast("int")).alias("quality"))
    return ids.filter("quality = 1 AND id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(most).select("id")


def log_ratios(rows: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket, from all (id, text) rows.

    The target is smoothed towards the corpus, so that a bucket which few
    trusted documents could hold anyway says little.

    Each task counts into two arrays and hands on one row for each bucket, so
    that the shuffle does not depend on the length of texts; the driver gets
    one row for each bucket.  Without trusted rows every ratio is 0.
    """

    ship(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                grams = ngrams(text, buckets)
                np.add.at(raw, grams, 1)
                if good:
                    np.add.at(target, grams, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
        )

    # at most TRUSTED ids: a small table, whatever the corpus
    marked = rows.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "id", "left")
    marked = marked.select("text", F.coalesce("good", F.lit(0)).alias("good"))
    counted = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").sum("raw", "target")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, m in counted.collect():
        raw[bucket], target[bucket] = n, m
    if not target.any():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def score(text: str, ratios: np.ndarray) -> float:
    grams = ngrams(text, len(ratios))
    return float(ratios[grams].mean()) if len(grams) else 0.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> np.ndarray:
    return log_ratios(texts(docs, id_col, text_col), trusted_ids(labels, TRUSTED, id_col, quality_col))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, counts, base_failed, score, kept) of every row.

    A NULL text counts as empty; a text without words scores 0 and fails the
    base rules.  Repeated rows are judged alike; rows without an id are judged
    too but never trusted.  Without trusted labels all scores are 0, and the
    base rules alone decide.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def make():
        ratios = shared.value

        def judge(batch):
            counts = [base_counts(t) for t in batch]
            failed = [base_failed(c[0], c[4]) for c in counts]
            scores = [score(t, ratios) for t in batch]
            kept = [not f and s >= threshold for f, s in zip(failed, scores)]
            return [*([c[k] for c in counts] for k in range(5)), failed, scores, kept]

        return judge

    long = T.LongType()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(n, long) for n in names] + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    return map_texts(texts(docs, id_col, text_col), make, fields)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def make():
        ratios = shared.value

        def good(text: str) -> bool:
            words = text.encode().split()
            return not base_failed(len(words), repeated_words(words)) and score(text, ratios) >= threshold

        return lambda batch: [good(t) for t in batch]

    return keep_rows(docs, text_col, make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")
