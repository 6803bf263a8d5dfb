"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components.

Every text gets a 64-bit fingerprint; fingerprints that differ in at most
``radius`` bits are linked, and the linked ones form components.

*Shards.*  Cut into ``blocks`` blocks, two fingerprints within the radius agree
in at least blocks - radius of them.  Each distinct fingerprint is therefore
dealt to one shard for every choice of that many blocks, named by the choice
and its bits: any link lies whole within a shard.  With 6 blocks and radius 4
that is 15 shards for each fingerprint, keyed by 21 bits; a much larger corpus
takes more blocks (8: 70 shards, 32 bits).

*BK-trees.*  A shard's fingerprints go into a BK-tree, the children of a node
keyed by their Hamming distance to it.  A new fingerprint d bits from a node
has its neighbours below the edges d - radius to d + radius only.  It is joined
to neighbours by union-find, and a branch known to lie within its own component
is passed over, so that a shard of n near-copies gives at most n - 1 links and
far fewer than n * n comparisons.  A shard over ``tile`` fingerprints is cut
into tiles, and each pair of tiles becomes a shard of its own: the tree of one
tile goes to all tasks that hold another tile, and no task gets more than two.

*Components.*  The links are reduced to stars around the smallest fingerprint
of each component, in rounds of joins whose results are written to the shared
folder.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, numbered_columns, saved, ship, slices, table, texts

BITS = 64
#: Rows to drop that are sent to every task: a file name and a place, some 100 bytes each.
BROADCAST_ROWS = 500_000


def fingerprint(text: str, words: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles, repeats included; 0 for no words."""
    parts = text.encode().lower().split()  # bytes: A-Z in lower case, cut at blanks and \x09-\x0d
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(parts) - size + 1
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for at in range(0, n, 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(rows: DataFrame, words: int = 4) -> DataFrame:
    """(id, fp) of (id, text) rows; fp holds the 64 bits as a signed long."""
    return map_texts(
        rows, lambda: lambda batch: [[signed(fingerprint(t, words)) for t in batch]], [T.StructField("fp", T.LongType())]
    )


class BkTree:
    """Fingerprints as they come, and the links that join their components."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # union-find
        self.mixed: list[bool] = []  # may the branch below hold more than one component

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = node = self.parent[self.parent[node]]
        return node

    def add(self, value: int) -> list[tuple[int, int]]:
        """Insert a value; its links to components it was not yet part of."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        self.mixed.append(False)
        if not new:
            return []
        links, stack, mine = [], [0], new
        while stack:
            node = stack.pop()
            theirs = self.root(node)
            if theirs == mine and not self.mixed[node]:
                continue
            apart = (value ^ self.values[node]).bit_count()
            if apart <= self.radius and theirs != mine:
                links.append((value, self.values[node]))
                self.parent[mine] = theirs
                mine = theirs
            below = self.children[node]
            if len(below) > 2 * self.radius + 1:
                near = (below.get(k) for k in range(apart - self.radius, apart + self.radius + 1))
                stack += [child for child in near if child is not None]
            else:
                stack += [child for k, child in below.items() if abs(k - apart) <= self.radius]
        node = 0
        while True:
            # components may still merge later; a branch once mixed is simply searched
            if self.root(node) != mine:
                self.mixed[node] = True
            apart = (value ^ self.values[node]).bit_count()
            child = self.children[node].get(apart)
            if child is None:
                self.children[node][apart] = new
                return links
            node = child


def shard_links(values: Iterable[int], radius: int) -> list[tuple[int, int]]:
    """Links (smaller, larger) that join the components of one shard."""
    tree = BkTree(radius)
    return [(min(a, b), max(a, b)) for value in values for a, b in tree.add(value)]


def shard_keys(fp, blocks: int, radius: int):
    """The shards of a fingerprint, as an array of longs: the choice of blocks in the top bits, their bits below."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for choice, picked in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(choice).cast("long")
        for k in picked:
            size = cuts[k + 1] - cuts[k]
            part = F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            key = F.shiftleft(key, size).bitwiseOR(part)
        keys.append(key)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, tile: int = 20_000) -> DataFrame:
    """(a, b), a < b: links of distinct fingerprints (fp) that join all their components."""
    if not radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    dealt = prints.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"))
    large = saved(
        dealt.groupBy("shard").count().filter(F.col("count") > tile).select(
            "shard", F.ceil(F.col("count") / tile).cast("int").alias("tiles")
        ),
        "simhash-large-shards",
    )
    tiles = F.coalesce("tiles", F.lit(1))
    dealt = dealt.join(large, "shard", "left").withColumn("own", F.pmod(F.xxhash64("fp", F.lit("tile")), tiles).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))
    )
    dealt = dealt.select("shard", "fp", F.explode(pairs).alias("pair")).select("shard", "pair.i", "pair.j", "fp")

    ship(prints.sparkSession)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last shard seen, which may go on in the next batch
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            ends = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            last = ends[-1] if len(ends) else 0
            yield from trees(rows[:, :last], ends)
            rest = rows[:, last:]
        if rest is not None:
            yield from trees(rest, np.array([rest.shape[1]]))

    def trees(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        starts = np.concatenate([[0], ends[:-1]])
        several = ends - starts > 1
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            found += shard_links(np.unique(rows[3, a:b]).view(np.uint64).tolist(), radius)
        if found:
            ab = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    ranged = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return ranged.mapInArrow(grow, out).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that is not the smallest of its component.

    Rounds of two steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  The rounds end when each node
    has one root and no root has a root; their number grows with the logarithm
    of the longest chain.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")), "simhash-links")
    while True:
        several = edges.groupBy("node").count().filter("count > 1").select("node")
        chained = edges.select("node").join(edges.select(F.col("root").alias("node")), "node", "left_semi")
        if several.union(chained).isEmpty():
            return edges
        both = edges.union(edges.select("root", "node")).toDF("node", "other")
        least = saved(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "simhash-least")
        edges = both.filter("other > node").join(least, "node").select(F.col("other").alias("node"), "root").distinct()
        edges = saved(edges, "simhash-large-star")
        least = saved(edges.groupBy("node").agg(F.min("root").alias("least")), "simhash-least")
        moved = edges.join(least, "node").select(F.explode(F.array("root", "node")).alias("node"), F.col("least").alias("root"))
        edges = saved(moved.filter("node != root").distinct(), "simhash-small-star")


def components(prints: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """(fp, root, component_id) of (id, fp) rows: root, a fingerprint, names all that is linked in any number of
    steps; component_id is the smallest id there."""
    first = saved(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = stars(links(first, radius, blocks))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only members of components with links need a look at others
    rooted = saved(rooted, "simhash-roots")
    best = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-best")
    return saved(rooted.join(best, "root").select("fp", "root", "component_id"), "simhash-components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int = 6
) -> DataFrame:
    """(id, fp, component_id) of every row.

    A NULL text counts as empty; texts without words have fingerprint 0 and are
    linked like any other.  Repeated rows each keep their row.  Rows without an
    id belong to components too; component_id is NULL only where none of the
    linked rows has an id.  Other columns are ignored.
    """
    prints = saved(fingerprints(texts(docs, id_col, text_col), words), "simhash-prints")
    return prints.join(components(prints, radius, blocks), "fp", "left").select("id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest id.

    Of rows equal in id and fingerprint any one stays.  Where no row of a
    component has an id, one row of its smallest fingerprint stays.

    Rows are fingerprinted once and written with their fingerprints; from then on
    a row is its place in its file.  Only places are joined and shuffled, and the
    rows to drop are broadcast as far as their number allows.
    """
    ship(docs.sparkSession)
    rows = numbered_columns(docs)
    at, own = docs.columns.index(text_col), f"c{docs.columns.index(id_col)}"
    schema = T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([signed(fingerprint(t or "", words)) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, "fp"])

    marked = saved(rows.mapInArrow(run, schema), "simhash-rows")
    marked = marked.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    prints = saved(marked.select(F.col(own).alias("id"), "fp", "file", "place"), "simhash-prints")
    found = components(prints.select("id", "fp"), radius, blocks)
    # by root: an id that rows of different texts share can be the smallest of several components
    first = F.col("id").eqNullSafe(F.col("component_id"))
    best = F.min(F.struct("fp", "file", "place")).alias("best")
    chosen = prints.join(found, "fp").filter(first).groupBy("root", "component_id").agg(best)
    chosen = chosen.select("best.file", "best.place")
    gone = saved(prints.select("file", "place").join(chosen, ["file", "place"], "left_anti"), "simhash-dropped")
    few = gone.count() <= BROADCAST_ROWS
    kept = marked.join(F.broadcast(gone) if few else gone, ["file", "place"], "left_anti")
    return kept.select(*rows.columns).toDF(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
