"""Benchmark decontamination: windows of the size of an item, found by SimHash and verified by shingles.

For every benchmark item, windows of as many words as the item slide over every
document.  A window and an item are the same passage if the weighted Jaccard
similarity of their five-word shingles (weight: how often a shingle occurs) is
at least ``similarity``.

*Fingerprints.*  Windows and items get 64-bit SimHash fingerprints of their
words.  Item fingerprints of one length are indexed by radius + 1 blocks of
bits: a window within the radius agrees with the item in one block at least, so
that looking up each block of the window finds every item within the radius.
At a similarity of 0.8 at most about one word in fifteen differs, which turns
8 bits on average; the default radius of 18 lies four deviations above that.

*Places.*  Passages that share no shingle have similarity 0.  Windows are
therefore fingerprinted only where a shingle of an item occurs, and there all
windows of the item's size that hold it; and they are compared with those items
alone, of that size, that a shingle there belongs to.  Blocks of three or four
bits would let most pairs pass; sharing a shingle is what leaves few.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower
case, so that punctuation, case and spacing do not hide a copy.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, keep_rows, map_texts, table, texts

SHINGLE = 5
BLOCK_BYTES = 16 << 20  # most benchmark text held by a task at a time
PAIRS = 1 << 21  # windows and items that are compared at a time

# Bytes of words as they are (A-Z in lower case), all other ASCII as blanks.
FOLD = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(128)).lower() + bytes(range(128, 256))
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of SHINGLE words; a shorter text is one run, an empty one has none."""
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(SHINGLE))))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def word_bits(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash fingerprints of all windows of ``size`` words."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """Benchmark items, indexed by their shingles and, for each length, by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[object, str]], radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.sizes = [len(w) for w in words]
        self.weights = [Counter(shingles(w)) for w in words]
        # shingle -> length -> which items of that length have it
        self.places: dict[tuple[bytes, ...], dict[int, list[int]]] = {}
        self.lengths: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            for s in self.weights[k]:
                self.places.setdefault(s, {}).setdefault(len(w), []).append(len(self.lengths[len(w)]))
            if w:
                self.lengths[len(w)].append(k)
        self.short = sorted({len(s) for s in self.places if len(s) < SHINGLE})
        self.cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.prints, self.blocks = {}, {}
        for size, of in self.lengths.items():
            prints = np.array(
                [window_prints(np.array([word_bits(x) for x in words[k]], np.uint64), size)[0] for k in of], np.uint64
            )
            self.prints[size] = prints
            # blocks[i][value]: which items have the value in block i
            self.blocks[size] = [
                np.arange(1 << (b - a))[:, None] == self.block(prints, a, b)[None, :] for a, b in zip(self.cuts, self.cuts[1:])
            ]

    @staticmethod
    def block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray, size: int, items: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all windows within the radius of one of these items of this length."""
        step = max(1, PAIRS // len(items))
        own = [block[:, items] for block in self.blocks[size]]
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            found = np.zeros((len(part), len(items)), bool)
            for block, a, b in zip(own, self.cuts, self.cuts[1:]):
                found |= block[self.block(part, a, b)]
            window, item = np.nonzero(found)
            close = np.bitwise_count(part[window] ^ self.prints[size][items[item]]) <= self.radius
            yield from zip((window[close] + at).tolist(), (self.lengths[size][k] for k in items[item[close]].tolist()))

    def passages(self, text: str) -> list[tuple[object, int, int, float]]:
        """(item id, first word, words, similarity) of the best window for each item found in a text."""
        words = words_of(text)
        runs = shingles(words)
        if len(words) >= SHINGLE and not self.short and self.places.keys().isdisjoint(runs):
            return []
        spots: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # item length -> first words of shared shingles, whose they are
        for size in sorted({SHINGLE if len(words) >= SHINGLE else len(words), *self.short}):
            for at, run in enumerate(zip(*(words[k:] for k in range(size))) if size else ()):
                for length, items in self.places.get(run, {}).items():
                    spots[length].append((at, items))
        best: dict[int, tuple[float, int, int]] = {}
        for length, places in spots.items():
            size = min(length, len(words))  # a text shorter than the item is one window
            places.sort(key=lambda place: place[0])
            starts = [at for at, _ in places]
            for first, last in self.stretches(starts, size, len(words)):
                here = places[bisect_left(starts, first) : bisect_left(starts, last + size)]
                items = np.array(sorted({k for _, of in here for k in of}), np.int64)
                hashes = np.array([word_bits(w) for w in words[first : last + size]], np.uint64)
                for at, k in self.near(window_prints(hashes, size), length, items):
                    start = first + at
                    same = weighted_similarity(Counter(shingles(words[start : start + size])), self.weights[k])
                    if same >= self.similarity and (k not in best or same > best[k][0]):
                        best[k] = (same, start, size)
        return [(self.ids[k], start, size, same) for k, (same, start, size) in sorted(best.items())]

    @staticmethod
    def stretches(places: list[int], size: int, n: int) -> Iterator[tuple[int, int]]:
        """First and last starts of windows that hold one of the places, in runs that do not overlap."""
        first = last = None
        for place in places:  # in order
            a, b = max(0, place - size + 1), min(place, n - size)
            if last is not None and a <= last + 1:
                last = max(last, b)
            else:
                if last is not None:
                    yield first, last
                first, last = a, b
        if last is not None and first <= last:
            yield first, last


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size, one at a time, each small enough to be sent to every task.

    One block for usual benchmarks; a larger one makes more passes over the
    documents and never more memory, of the driver or of a task.
    """
    rows = items.select(column(item_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.id, r.text) for r in rows.filter(part == k).orderBy("id", "text").collect()]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    radius: int = 18,
    similarity: float = 0.8,
) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): one row for each item found in each row of docs.

    An item comes with its most similar window (of equal ones the first).  NULL
    texts count as empty and are clean; items without words match nothing;
    repeated items are each listed; without items there are no rows.  Repeated
    rows and rows without an id are judged like any other.
    """
    kind = T.StructType(
        [
            T.StructField("item_id", items.schema[item_col].dataType),
            T.StructField("first_word", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    rows, result = texts(docs, id_col, text_col), None
    for block in item_blocks(items, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast((block, radius, similarity))

        def make(shared=shared):
            index = Items(*shared.value)
            names = [f.name for f in kind]
            return lambda batch: [[[dict(zip(names, p)) for p in index.passages(t)] for t in batch]]

        found = map_texts(rows, make, [T.StructField("passages", T.ArrayType(kind))])
        found = found.select("id", F.explode("passages").alias("passage")).select("id", "passage.*")
        result = found if result is None else result.union(found)
    return result


def keep_clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", radius: int = 18, similarity: float = 0.8
) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of an item; cases as in contaminated."""
    for block in item_blocks(items, item_col, "text"):
        shared = docs.sparkSession.sparkContext.broadcast((block, radius, similarity))

        def make(shared=shared):
            index = Items(*shared.value)
            return lambda batch: [not index.passages(t) for t in batch]

        docs = keep_rows(docs, text_col, make)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "item_id", F.col("first_word").cast("long"), F.col("n_words").cast("long"), "similarity"
    )
