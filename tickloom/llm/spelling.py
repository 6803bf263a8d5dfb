"""Spelling variants: words one edit apart, found by K-d trees over letter counts.

A word's vector counts its letters, folded into 32 dimensions.  One inserted,
deleted or replaced letter raises at most one count by one and lowers at most
one by one, so that near words lie at an L1 distance of two at most, and of one
if their lengths differ.  Words of each length form a K-d tree; every word
searches the tree of its own length and that of the next one.  A search keeps
what it may still raise and lower, and leaves out a branch whose box is further
away.  The letter order of what it finds is verified, so the links are exact.

*Cells.*  The upper levels of the trees are fitted to at most SAMPLE words and
sent to all tasks.  They cut the words into cells; a word lies in one cell and
is sent as a probe to every cell that its search enters, of its own length only
to later cells, which finds each pair once.  A cell that holds far more words
than meant (equal vectors are never split) is cut into tiles, each of which gets
the probes: no task holds more than a tile, and probes stream past it.  Within
a tile the words form the lower levels.

*Results* leave a tile as one row for each word and probe with something near:
how many near words, and the best of them.  Pairs are never put out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column, saved, ship, table, texts

DIMENSIONS = 32
LONGEST = 64  # words from this length on share a tree
CELL = 4096  # words meant for a cell
MOST_CELLS = 16_384  # the trees that every task gets have no more leaves
SAMPLE = 262_144  # words to which they are fitted
TILE = 4 * CELL
MOST_TASKS = 4096  # beyond so many, a task searches several cells, one after another
LEAF = 24
PAIRS = 1 << 20  # candidates compared at a time

#: Letters of spelling variants: maximal runs of this class.
LETTERS = "A-Za-zÀ-ÿ"


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of DIMENSIONS counts for each word; counts over 255 stay at 255, which brings no vectors further apart."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at = np.repeat(np.arange(len(words)), lengths) * DIMENSIONS + points % DIMENSIONS
    counts = np.bincount(at, minlength=len(words) * DIMENSIONS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, DIMENSIONS)


def split_at(vectors: np.ndarray) -> tuple[int, int] | None:
    """(dimension, limit) that cuts vectors into those up to the limit and those above; None if all are equal."""
    dimension = int(vectors.var(axis=0, dtype=np.float32).argmax())
    counts = vectors[:, dimension]
    low, high = int(counts.min()), int(counts.max())
    if low == high:
        return None
    return dimension, min(max(int(np.median(counts)), low), high - 1)


class Tree:
    """A K-d tree as a list of nodes: (dimension, limit, lower child, upper child), or (-1, leaf number, 0, 0)."""

    def __init__(self, vectors: np.ndarray, leaves: int | None = None):
        """Split down to LEAF vectors, or, if leaves is given, into about so many leaves; self.members has each leaf's."""
        self.nodes: list[tuple[int, int, int, int]] = []
        self.members: list[np.ndarray] = []
        work = [(np.arange(len(vectors)), leaves, -1, 0)]
        while work:
            rows, wanted, parent, side = work.pop()
            at = len(self.nodes)
            if parent >= 0:
                d, limit, *children = self.nodes[parent]
                children[side] = at
                self.nodes[parent] = (d, limit, *children)
            full = len(rows) <= LEAF if wanted is None else wanted <= 1
            cut = None if full or not len(rows) else split_at(vectors[rows])
            if cut is None:
                self.nodes.append((-1, len(self.members), 0, 0))
                self.members.append(rows)
                continue
            self.nodes.append((*cut, 0, 0))
            upper = vectors[rows, cut[0]] > cut[1]
            above = None if wanted is None else min(max(1, round(wanted * upper.mean())), wanted - 1)
            work.append((rows[upper], above, at, 1))
            work.append((rows[~upper], None if wanted is None else wanted - above, at, 0))

    def search(
        self, vectors: np.ndarray, rows: np.ndarray, raises: np.ndarray, lowers: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(leaf, rows, raises, lowers): the leaves that may hold a vector in reach of vectors[rows], and what is left there.

        raises and lowers (0 or 1) say by how much a row's counts may go up and
        down in all.  A count that moves has used up its allowance, and no box
        further down can ask it for the same move again, so that what is
        subtracted is the distance to the box.
        """
        work = [(0, rows, raises, lowers)]
        while work:
            at, rows, up, down = work.pop()
            dimension, limit, lower, upper = self.nodes[at]
            if dimension < 0:
                yield limit, rows, up, down
                continue
            over = vectors[rows, dimension].astype(np.int16) - limit
            left = down - np.maximum(over, 0)
            if (go := left >= 0).any():
                work.append((lower, rows[go], up[go], left[go]))
            right = up - np.maximum(1 - over, 0)
            if (go := right >= 0).any():
                work.append((upper, rows[go], right[go], down[go]))


def home(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    out, none = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int16)
    for leaf, rows, _, _ in tree.search(vectors, np.arange(len(vectors)), none, none):
        out[rows] = leaf
    return out


def codes(vectors: np.ndarray) -> np.ndarray:
    """64 bits of each vector: which counts are over 0, and which over 1.  They differ in no more bits than the L1 distance."""
    bits = np.concatenate([vectors > 0, vectors > 1], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_edit(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair of words whether exactly one inserted, deleted or replaced letter tells them apart."""
    out = np.zeros(len(a), bool)
    lengths = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    shapes = lengths[0] * 2 + (lengths[1] != lengths[0])
    out_of_reach = np.abs(lengths[0] - lengths[1]) > 1
    for shape in np.unique(shapes[~out_of_reach]):
        which = np.flatnonzero((shapes == shape) & ~out_of_reach)
        size, step = int(shape) // 2, max(1, PAIRS // (int(shape) // 2 + 1))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            if shape % 2 == 0:
                out[some] = (letters(a, some, size) != letters(b, some, size)).sum(axis=1) == 1
                continue
            for longer, sign in ((b, 1), (a, -1)):  # a's length is size, b's is one more or one less
                these = some[lengths[1][some] - size == sign]
                short, n = (a, size) if sign > 0 else (b, size - 1)
                if len(these):
                    little, large = letters(short, these, n), letters(longer, these, n + 1)
                    head = np.logical_and.accumulate(little == large[:, :n], axis=1).sum(axis=1)
                    tail = np.logical_and.accumulate((little == large[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    out[these] = head + tail >= n
    return out


def letters(words: list[str], which: np.ndarray, size: int) -> np.ndarray:
    joined = "".join([words[k] for k in which]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4").reshape(len(which), size)


class Tile:
    """Words of one cell, or of a part of it; collects what is near each."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.vectors = letter_counts(words)
        self.codes = codes(self.vectors)
        self.tree = Tree(self.vectors)
        self.n_near = [0] * len(words)
        self.best: list[tuple[int, str] | None] = [None] * len(words)
        if self.words:
            both = np.ones(len(words), np.int16)
            for a, b in self.near(words, self.vectors, both, both, itself=True):
                self.note(self.n_near, self.best, a, words, counts, b)
                self.note(self.n_near, self.best, b, words, counts, a)

    @staticmethod
    def note(n_near: list, best: list, a: list[int], words: list[str], counts: list[int], b: list[int]) -> None:
        """Word b[k] is near the one whose results are at a[k]; the best has the largest count, then comes first."""
        for i, j in zip(a, b):
            n_near[i] += 1
            key = (-counts[j], words[j])
            if best[i] is None or key < best[i]:
                best[i] = key

    def near(
        self, words: list[str], vectors: np.ndarray, raises: np.ndarray, lowers: np.ndarray, itself: bool = False
    ) -> Iterator[tuple[list[int], list[int]]]:
        """Positions of near words, of words and of the tile; among the tile's own words each pair once."""
        marks = codes(vectors)
        found_a, found_b = [], []
        for leaf, rows, _, _ in self.tree.search(vectors, np.arange(len(words)), raises, lowers):
            members = self.tree.members[leaf]
            step = max(1, PAIRS // max(1, len(members)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                close = np.bitwise_count(marks[some][:, None] ^ self.codes[members][None, :]) <= 2
                if itself:
                    close &= some[:, None] < members[None, :]
                i, j = np.nonzero(close)
                found_a.append(some[i])
                found_b.append(members[j])
                if sum(map(len, found_a)) >= PAIRS:
                    yield self.verified(words, np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b = [], []
        if found_a:
            yield self.verified(words, np.concatenate(found_a), np.concatenate(found_b))

    def verified(self, words: list[str], a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        right = one_edit([words[k] for k in a], [self.words[k] for k in b])
        return a[right].tolist(), b[right].tolist()

    def probe(self, words: list[str], counts: list[int], raises: np.ndarray, lowers: np.ndarray) -> tuple[list, list]:
        """(n_near, best) of each probe; the tile's own words note the probes."""
        n_near, best = [0] * len(words), [None] * len(words)
        if self.words:
            for a, b in self.near(words, letter_counts(words), raises, lowers):
                self.note(n_near, best, a, self.words, self.counts, b)
                self.note(self.n_near, self.best, b, words, counts, a)
        return n_near, best


def length_class(word: Column) -> Column:
    return F.least(F.char_length(word), F.lit(LONGEST))


class Cells:
    """The upper levels: a tree for each length, whose leaves are numbered throughout."""

    def __init__(self, sizes: dict[int, int], sample: dict[int, list[str]]):
        total = sum(sizes.values())
        meant = max(CELL, -(-total // MOST_CELLS))
        self.trees: dict[int, Tree] = {}
        self.first: dict[int, int] = {}
        self.n = 0
        for length in sorted(sizes):
            tree = Tree(letter_counts(sample.get(length, [])), -(-sizes[length] // meant))
            self.first[length], self.n = self.n, self.n + len(tree.members)
            tree.members = []
            self.trees[length] = tree

    def of(self, words: list[str]) -> np.ndarray:
        """The cell of each word."""
        out = np.zeros(len(words), np.int64)
        for length, rows, vectors in self.by_length(words):
            out[rows] = self.first[length] + home(self.trees[length], vectors)
        return out

    def by_length(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONGEST)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            yield length, rows, letter_counts([words[k] for k in rows])

    def entered(self, words: list[str], cells: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, cell, raises, lowers): the other cells that the searches of the words enter."""
        out = []
        for length, rows, vectors in self.by_length(words):
            every, one, none = np.arange(len(rows)), np.ones(len(rows), np.int16), np.zeros(len(rows), np.int16)
            for other, lowers in ((length, one), (length + 1, none)):
                if other not in self.trees:
                    continue
                for leaf, some, up, down in self.trees[other].search(vectors, every, one, lowers):
                    cell = self.first[other] + leaf
                    later = cells[rows[some]] < cell
                    some = some[later]
                    out.append((rows[some], np.full(len(some), cell), up[later], down[later]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(part) for part in zip(*out))


def upper_levels(words: DataFrame) -> Cells:
    """Cells fitted to at most SAMPLE words, chosen by their hash; one count for each length reaches the driver."""
    sizes = {length: n for length, n in words.groupBy(length_class(F.col("word"))).count().collect()}
    total = sum(sizes.values())
    kept = words.select("word")
    if total > SAMPLE:
        kept = kept.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(0.95 * SAMPLE / total * (1 << 30)))
    sample: dict[int, list[str]] = {}
    # the vectors need no more of a very long word than its letters; its length is bounded here, its search is not
    for (word,) in kept.select(F.substring("word", 1, 1024)).limit(SAMPLE).collect():
        sample.setdefault(min(len(word), LONGEST), []).append(word)
    return Cells(sizes, sample)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of every word with a near one how many it has, and the best.

    words: (word, n) with each word once, and no NULLs.
    """
    spark = words.sparkSession
    ship(spark)
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    levels = spark.sparkContext.broadcast(upper_levels(words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = levels.value.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["word", "n", "cell"])

    words = saved(words.mapInArrow(place, "word string, n long, cell long"), "spelling-cells")
    # at most MOST_CELLS and a few rows
    crowded = {
        cell: -(-n // TILE) for cell, n in words.groupBy("cell").count().filter(F.col("count") > TILE).collect()
    }

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word's own tile gets it as is_probe = false, other tiles that it has to search as a probe."""
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                names, cells = part.column(0).to_pylist(), part.column(2).to_numpy()
                row, cell, up, down = levels.value.entered(names, cells)
                row, cell = np.concatenate([np.arange(len(names)), row]), np.concatenate([cells, cell])
                full = np.ones(len(names), np.int64)
                up, down = np.concatenate([full, up]), np.concatenate([full, down])
                probe = np.arange(len(row)) >= len(names)
                tile = np.zeros(len(row), np.int64)
                for dense in set(np.unique(cell).tolist()) & crowded.keys():
                    n = crowded[dense]
                    here = np.flatnonzero(cell == dense)
                    own = here[~probe[here]]
                    tile[own] = [int.from_bytes(names[k].encode("utf-8", "surrogatepass")[-8:], "little") % 1_000_003 % n for k in row[own]]
                    # a word also searches the later tiles of its own cell, a probe all of them
                    again = [(k, t) for k in here for t in range(tile[k] + 1, n)]
                    if again:
                        k, t = np.array(again).T
                        row, cell, up, down = (np.concatenate([x, x[k]]) for x in (row, cell, up, down))
                        probe, tile = np.concatenate([probe, np.ones(len(k), bool)]), np.concatenate([tile, t])
                take = part.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell),
                        pa.array(tile),
                        pa.array(probe),
                        *take.columns,
                        pa.array(up.astype(np.int8)),
                        pa.array(down.astype(np.int8)),
                    ],
                    names=["cell", "tile", "is_probe", "word", "n", "raises", "lowers"],
                )

    sent = words.mapInArrow(send, "cell long, tile long, is_probe boolean, word string, n long, raises byte, lowers byte")
    tasks = min(max(1, levels.value.n // 2), MOST_TASKS)
    dealt = sent.repartitionById(tasks, ((F.col("cell") + F.col("tile")) % tasks).cast("int"))
    dealt = dealt.sortWithinPartitions("cell", "tile", "is_probe", "word")
    found = dealt.mapInArrow(search_tiles, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.word").alias("best"))


def search_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, its own words first, to what is near each word and each probe."""
    key, tile, words, counts = None, None, [], []

    def rows(words: list[str], n_near: list[int], best: list) -> pa.RecordBatch:
        some = [k for k, n in enumerate(n_near) if n]
        columns = [[words[k] for k in some], [n_near[k] for k in some], [-best[k][0] for k in some], [best[k][1] for k in some]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["word", "n_near", "best_n", "best"]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    for batch in batches:
        cell, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        probe = batch.column(2).to_numpy(zero_copy_only=False)
        names, sizes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        up, down = batch.column(5).to_numpy().astype(np.int16), batch.column(6).to_numpy().astype(np.int16)
        change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | np.diff(probe)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            if key != (cell[start], number[start]):
                if key is not None:
                    tile = tile or Tile(words, counts)
                    yield rows(tile.words, tile.n_near, tile.best)
                key, tile, words, counts = (cell[start], number[start]), None, [], []
            if not probe[start]:
                words += names[start:stop]
                counts += sizes[start:stop]
                continue
            tile = tile or Tile(words, counts)
            for at in range(start, stop, 4096):
                end = min(stop, at + 4096)
                result = tile.probe(names[at:end], sizes[at:end], up[at:end], down[at:end])
                yield rows(names[at:end], *result)
    if key is not None:
        tile = tile or Tile(words, counts)
        yield rows(tile.words, tile.n_near, tile.best)


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Every word of (word, n) with its form and its root.

    word, n       the word and how often it occurs
    n_near        words that exactly one inserted, deleted or replaced letter tells from it
    form, form_n  the near word of largest n (of several the first in code-point order), if that is at least
                  ratio times the word's own n; else NULL
    root          the last word when forms are followed; the word itself without a form

    Words are compared by code points.  Repeated words, and rows with a NULL
    word or n, are the caller's to merge: each word has to come once.  The
    empty word is a word of length 0; no words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its variants")
    found = near_words(words)
    known = words.select("word", F.col("n").cast("long").alias("n"))
    rows = known.join(found, "word", "left")
    frequent = F.col("best_n") >= F.col("n") * ratio
    rows = saved(
        rows.select(
            "word",
            F.when(frequent, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # each step multiplies n by the ratio, so chains are short; every round doubles what is followed
    steps = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    longest, reach = 0, 1
    while most >= ratio ** (longest + 1):
        longest += 1
    while reach < longest:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        steps = saved(steps, "spelling-roots")
        reach *= 2
    return rows.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def letter_runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): maximal runs of at least ``least`` letters, A-Z in lower case, of every whole text; NULL texts have none."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = texts(docs, id_col, text_col).select("id", F.explode(runs).alias("word"))
    return rows.select("id", ascii_lower(F.col("word")).alias("word"))


def with_slips(runs: DataFrame, every: int = 31) -> DataFrame:
    """Runs of (id, word), of which about one in ``every`` loses a letter: which one and where, crc32 of id:word says.

    A NULL id counts as the empty text.
    """
    key = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    rows = runs.select("word", key.alias("key"))
    place = (F.col("key") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.char_length("word")))
    return rows.select(F.when(F.col("key") % every == 0, shorter).otherwise(F.col("word")).alias("word"))


def word_counts(words: DataFrame, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n) of the words of at least this length that occur at least this often."""
    counts = words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_n)


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of all texts' words, with the slips of with_slips; columns as in variants().

    NULL and empty texts have no words, rows count as often as they occur, other
    columns of docs are ignored, and an empty table gives no rows.
    """
    if id_col == text_col:
        raise ValueError("the id and the text are two columns")
    runs = letter_runs(docs.select(column(id_col), column(text_col)), 7, id_col, text_col)
    return variants(saved(word_counts(with_slips(runs)), "spelling-counts"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_variants(table(spark, sf_dir, "documents"))


#: The same by the texts that remain without one letter: near words share one, or one is the other's; crc32 bit by bit.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), kept AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
         count(*) AS n
  FROM runs GROUP BY ALL
), keyed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           flatten(list_transform(string_split(head || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))),
         lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
         CAST(4294967295 AS BIGINT)) AS key
  FROM kept
), slipped AS (
  SELECT CASE WHEN key % 31 = 0 THEN substr(run, 1, key % length(run)) || substr(run, key % length(run) + 2) ELSE run END AS word, n FROM keyed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS k, substr(word, 1, k - 1) AS a, substr(word, k + 1) AS b FROM words
), near AS (
  SELECT s.word, t.word AS other, t.n FROM shorter s JOIN shorter t ON s.k = t.k AND s.a = t.a AND s.b = t.b AND s.word <> t.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.a || s.b
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.a || s.b
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n,
         (SELECT min(other) FROM near o WHERE o.word = w.word AND o.n = best_n AND best_n >= 10 * w.n) AS form
  FROM words w LEFT JOIN best USING (word)
), followed(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT f.word, x.form FROM followed f JOIN formed x ON x.word = f.root WHERE x.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT f.word, root FROM followed f JOIN formed x ON x.word = f.root WHERE x.form IS NULL) USING (word)
"""
