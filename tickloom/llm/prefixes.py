"""A trie of conversation prefixes, with subtree totals by centroid decomposition.

*Trie.*  Every turn is hashed with its place to 128 bits; the XOR of the first d
hashes names the sequence of the first d turns.  Running XORs go in chunks of
CHUNK turns, so that one endless conversation is spread over tasks.  Grouping by
name gives the nodes; a node is called by its smallest member and its depth.

*Rollup.*  The parent edges below the root form a forest.  A component weighs
what its nodes have in members; its centroid is the deepest node that has more
than half of that at or below it.  Without the centroid the component falls into
the subtrees of its children and an upper part, each of half the weight at most.
What lies at and below the centroid is summed, which completes the centroid, and
the sum is added to every node on the path from the centroid to the top of the
component: all that the upper part needs to know of what was taken away.  After
at most log2(weight) rounds no component is heavier than LOCAL; those go on in
the same way, each within a task.

Who lies below a centroid, and who on its path, follows from the members: a
node is below it if its smallest member passes through the centroid, and the
path is the centroid's smallest member's.  Both are joins on (member, depth),
whose keys are unique on one side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, saved, ship, table

CHUNK = 4096  # turns of a running XOR
LOCAL = 1024  # weight up to which a component is finished within a task
ENDS = 1024  # width of the id ranges that are joined to one text before they are hashed
HEAD = 9  # heads of rebuilt conversations have fewer turns

EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, place, h1, h2, bytes): each conversation's turns from place 1 on, as hashes of role and text, and the text's bytes.

    Ordered by turn, NULL first; equal turns by role, then by hash.  NULL roles
    and texts count as empty.  Rows without a conv_id belong to no conversation
    and are left out.  Places are counted within range partitions first, so that
    a conversation may span many of them.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    role = F.coalesce(column(role_col).cast("string"), F.lit(""))
    rows = conversations.select(
        column(id_col).cast("long").alias("conv_id"), column(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    ).filter("conv_id IS NOT NULL")
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(7), "text", "role").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    rows = saved(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = rows.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    # most conversations lie within one part
    rows = rows.join(first.filter("first > 0"), ["conv_id", "part"], "left")
    place = F.col("place") + F.coalesce("first", F.lit(0))
    return rows.select("conv_id", place.cast("long").alias("place"), "h1", "h2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared heads: (conv_id, n), and their turns (conv_id, n, depth, h1, h2, bytes).

    Conversation c has the first h turns of conversation c - c % 5 (all, if
    that has fewer; none, if there is no such conversation), then its own turns
    after its first h; h is crc32 of c's decimal digits, modulo HEAD.
    """
    sizes = saved(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "conversations")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("head")
    convs = sizes.select("conv_id", "own", head, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left")
    taken = F.least("head", F.coalesce("of_base", F.lit(0))).alias("taken")
    convs = convs.select("conv_id", "base", "head", taken, F.greatest(F.col("own") - F.col("head"), F.lit(0)).alias("rest"))
    convs = saved(convs.withColumn("n", F.col("taken") + F.col("rest")), "heads")
    heads = turns.filter(F.col("place") < HEAD).withColumnRenamed("conv_id", "base")
    heads = convs.join(heads, "base").filter(F.col("place") <= F.col("taken"))
    heads = heads.select("conv_id", "n", F.col("place").alias("depth"), "h1", "h2", "bytes")
    rest = turns.join(convs, "conv_id").filter(F.col("place") > F.col("head"))
    rest = rest.select("conv_id", "n", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "h1", "h2", "bytes")
    return convs.select("conv_id", "n"), heads.unionByName(rest)


def named_prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, n, depth, h1, h2, bytes) with x1, x2, the name of the prefix that ends there, and p1, p2, that of the one before."""
    mixed = turns.select(
        "conv_id",
        "n",
        "depth",
        "bytes",
        F.xxhash64(F.lit(1), "depth", "h1", "h2").alias("m1"),
        F.xxhash64(F.lit(2), "depth", "h2", "h1").alias("m2"),
        F.floor(F.col("depth") / CHUNK).alias("chunk"),
    )
    mixed = saved(mixed, "mixed-turns")
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = mixed.withColumns({"r1": F.bit_xor("m1").over(upto), "r2": F.bit_xor("m2").over(upto)})
    long = mixed.filter(F.col("n") >= CHUNK).groupBy("conv_id", "chunk")
    totals = long.agg(F.bit_xor("m1").alias("t1"), F.bit_xor("m2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "chunk", F.bit_xor("t1").over(before).alias("t1"), F.bit_xor("t2").over(before).alias("t2"))
    rows = rows.join(totals.filter("t1 IS NOT NULL"), ["conv_id", "chunk"], "left")
    x1 = F.col("r1").bitwiseXOR(F.coalesce("t1", F.lit(0).cast("long")))
    x2 = F.col("r2").bitwiseXOR(F.coalesce("t2", F.lit(0).cast("long")))
    rows = rows.withColumns({"x1": x1, "x2": x2})
    before_it = {"p1": F.col("x1").bitwiseXOR(F.col("m1")), "p2": F.col("x2").bitwiseXOR(F.col("m2"))}
    return rows.withColumns(before_it).select("conv_id", "n", "depth", "bytes", "x1", "x2", "p1", "p2")


def trie(rows: DataFrame) -> DataFrame:
    """Nodes below the root: (depth, x1, x2, conv_id, parent_conv_id, n_convs, n_children, weight, saved); parent_conv_id is NULL at depth 1.

    weight counts the members of all nodes at and below; saved is what the node
    itself saves, (n_convs - 1) times the bytes of its text.
    """
    nodes = saved(
        rows.groupBy("depth", "x1", "x2").agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.sum(F.col("n") - F.col("depth") + 1).alias("weight"),
            F.max("bytes").alias("bytes"),
            F.first("p1").alias("p1"),
            F.first("p2").alias("p2"),
        ),
        "nodes",
    )
    above = nodes.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2")
    )
    nodes = saved(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "edges")
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left")
    return nodes.select(
        "depth",
        "x1",
        "x2",
        "conv_id",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "weight",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )


def passages(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent): the nodes through which the smallest members pass; called by their smallest members."""
    smallest = nodes.select("conv_id").distinct()
    names = nodes.select("depth", "x1", "x2", F.col("conv_id").alias("node"), F.col("parent_conv_id").alias("parent"))
    passing = rows.select("conv_id", "depth", "x1", "x2").join(smallest, "conv_id", "left_semi")
    return passing.join(names, ["depth", "x1", "x2"]).select("conv_id", "depth", "node", "parent")


def finished_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components, sorted by top and then by depth, to the totals of their nodes."""
    names = ["conv_id", "depth", "n_leaves", "saved_tokens"]
    top, rows = None, []

    def out() -> pa.RecordBatch:
        place = {(row[0], row[1]): k for k, row in enumerate(rows)}
        parents = [place.get((row[2], row[1] - 1), -1) for row in rows]
        totals = subtree_totals(parents, [(row[3], row[4]) for row in rows])
        columns = [[r[0] for r in rows], [r[1] for r in rows]]
        columns += [[t[k] + r[5 + k] for t, r in zip(totals, rows)] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for *key, conv_id, depth, parent, leaf, saving, more_leaves, more_saving in zip(*columns):
            if key != top:
                if rows:
                    yield out()
                top, rows = key, []
            rows.append((conv_id, depth, parent, leaf, saving, more_leaves, more_saving))
    if rows:
        yield out()


def subtree_totals(parents: list[int], values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The sums of values at and below each node of a tree, by centroid decomposition; parents come before their children, the top's is -1."""
    # what has been taken away at and below each node, so far
    totals = [(0, 0)] * len(parents)
    work = [list(range(len(parents)))]
    size, heavy, label = ([0] * len(parents) for _ in range(3))
    while work:
        part = work.pop()
        for k in part:
            size[k], heavy[k] = 1, -1
        for k in reversed(part[1:]):
            size[parents[k]] += size[k]
        for k in part[1:]:
            if 2 * size[k] > len(part):
                heavy[parents[k]] = k
        centroid = part[0]
        while heavy[centroid] >= 0:
            centroid = heavy[centroid]
        # the pieces: the upper one, called by its top, and one for each child of the centroid, called by the child
        pieces: dict[int, list[int]] = {}
        first = second = 0
        for k in part:
            if k == centroid:
                label[k] = -1
            elif k == part[0]:
                label[k] = k
            else:
                label[k] = k if label[parents[k]] == -1 else label[parents[k]]
            if label[k] >= 0:
                pieces.setdefault(label[k], []).append(k)
            if label[k] != part[0]:
                first, second = first + values[k][0], second + values[k][1]
        k = centroid
        totals[k] = (totals[k][0] + first, totals[k][1] + second)
        while k != part[0]:
            k = parents[k]
            totals[k] = (totals[k][0] + first, totals[k][1] + second)
        work.extend(pieces.values())
    return totals


def rollup(nodes: DataFrame, passing: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node below the root.

    nodes as from trie(), passing as from passages().  Each round writes the
    components that are still too heavy; those light enough wait for the end.
    """
    ship(nodes.sparkSession)
    tops = passing.filter("depth = 1").select("conv_id", F.col("node").alias("top"), F.lit(1).cast("long").alias("top_depth"))
    none = F.lit(0).cast("long")
    live = nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        "saved",
        none.alias("more_leaves"),
        none.alias("more_saved"),
        "weight",
    ).join(tops, "conv_id")
    live = saved(live, "components")
    light, done = [], []
    while True:
        weights = live.groupBy("top", "top_depth").agg(F.max("weight").alias("all"))
        weights = saved(weights.filter(F.col("all") > local), "heavy-components")
        light.append(live.join(weights, ["top", "top_depth"], "left_anti"))
        if weights.isEmpty():
            break
        heavy = saved(live.join(weights, ["top", "top_depth"]), "heavy-nodes")
        deepest = F.max_by(F.struct("conv_id", "depth", "weight"), "depth")
        centroids = heavy.filter(F.col("weight") * 2 > F.col("all")).groupBy("top", "top_depth").agg(deepest.alias("c"))
        centroids = saved(
            centroids.select(
                "top",
                "top_depth",
                F.col("c.conv_id").alias("c"),
                F.col("c.depth").alias("c_depth"),
                F.col("c.weight").alias("c_weight"),
            ),
            "centroids",
        )
        # where each node's smallest member is one step below the centroid's depth
        below = passing.select(
            "conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"), F.col("parent").alias("child_of")
        )
        placed = heavy.join(centroids, ["top", "top_depth"])
        placed = placed.join(below, ["conv_id", "c_depth"], "left")
        is_centroid = (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("c_depth"))
        under = (F.col("depth") > F.col("c_depth")) & (F.col("child_of") == F.col("c"))
        where = F.when(is_centroid, 0).when(under, 1).otherwise(-1)
        placed = saved(placed.withColumn("side", where).drop("child_of"), "split-nodes")
        sums = placed.filter("side >= 0").groupBy("top", "top_depth")
        sums = sums.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("tokens"))
        sums = saved(centroids.join(sums, ["top", "top_depth"]), "centroid-sums")
        done.append(
            placed.filter("side = 0")
            .join(sums.select("top", "top_depth", "leaves", "tokens"), ["top", "top_depth"])
            .select(
                "conv_id",
                "depth",
                (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"),
                (F.col("tokens") + F.col("more_saved")).alias("saved_tokens"),
            )
        )
        path = sums.join(passing.withColumnRenamed("conv_id", "c"), "c")
        path = path.filter((F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("c_depth")))
        path = path.select(F.col("node").alias("conv_id"), "depth", "leaves", "tokens", F.col("c_weight").alias("gone"))
        kept = ["conv_id", "depth", "parent_conv_id", "leaf", "saved"]
        upper = placed.filter("side = -1").join(path, ["conv_id", "depth"], "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        upper = upper.select(
            *kept,
            plus("more_leaves", "leaves"),
            plus("more_saved", "tokens"),
            (F.col("weight") - F.coalesce("gone", F.lit(0))).alias("weight"),
            "top",
            "top_depth",
        )
        lower = placed.filter("side = 1").select(
            *kept, "more_leaves", "more_saved", "weight", F.col("child").alias("top"), (F.col("c_depth") + 1).alias("top_depth")
        )
        live = saved(upper.unionByName(lower), "components")
    rest = light[0]
    for more in light[1:]:
        rest = rest.unionByName(more)
    rest = rest.select(
        "top", "top_depth", "conv_id", "depth", "parent_conv_id", "leaf", "saved", "more_leaves", "more_saved"
    )
    rest = rest.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "conv_id")
    totals = rest.mapInArrow(finished_locally, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for more in done:
        totals = totals.unionByName(more)
    return totals


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of (conv_id, depth, x1, x2): SHA-256 of the ids that end there, ascending, comma-joined.

    Ids are joined by ranges first; the texts of the ranges then stream, in
    order, through one hash for each node.
    """
    ship(ends.sparkSession)
    ranges = ends.groupBy("depth", "x1", "x2", F.floor(F.col("conv_id") / ENDS).alias("range"))
    texts = ranges.agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select("depth", "x1", "x2", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, found = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            columns.append(pa.array([f[3] for f in found], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["depth", "x1", "x2", "ends_sha256"])

        for batch in batches:
            for depth, x1, x2, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key == (depth, x1, x2):
                    digest.update(b"," + text.encode())
                    continue
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = (depth, x1, x2), hashlib.sha256(text.encode())
            yield out()
            found = []
        if key is not None:
            found.append((*key, digest.hexdigest()))
            yield out()

    texts = texts.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "range")
    return texts.select("depth", "x1", "x2", "text").mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """Every distinct sequence of first turns, as a node.

    convs: (conv_id, n) with all conversations, also those without turns; turns:
    (conv_id, n, depth, h1, h2, bytes), depth from 1 to n.

    conv_id, depth    the smallest member, and how many turns the node stands for (the root: 0)
    parent_conv_id    the parent's conv_id; the root's is NULL
    n_convs           members: conversations that begin with these turns
    n_children        nodes one turn longer
    n_leaves          childless nodes at and below
    saved_tokens      bytes of text that need not be processed again, at and below
    ends_sha256       SHA-256 of the members that end here, ascending, comma-joined

    Conversations without turns are members of the root alone.  Without
    conversations there are no rows.
    """
    rows = saved(named_prefixes(turns), "prefixes")
    nodes = saved(trie(rows), "trie")
    passing = saved(passages(rows, nodes), "passages")
    totals = saved(rollup(nodes, passing, local), "subtree-totals")
    nought = F.lit(0).cast("long")
    ends = rows.filter(F.col("depth") == F.col("n")).select("conv_id", "depth", "x1", "x2")
    turnless = convs.filter("n = 0").select("conv_id", nought.alias("depth"), nought.alias("x1"), nought.alias("x2"))
    ends = saved(end_hashes(ends.unionByName(turnless)), "ends")
    smallest, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    # totals of the trees below the root
    trees = totals.filter("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    n_children, n_leaves, tokens = trees[0], trees[1] or 1, trees[2] or 0
    rest = nodes.join(totals, ["conv_id", "depth"])
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(smallest).cast("long")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "x1", "x2"]
    root = [(smallest, 0, None, n_convs, n_children, n_leaves, tokens, 0, 0)] if n_convs else []
    root = convs.sparkSession.createDataFrame(root, ", ".join(f"{name} long" for name in names))
    every = rest.select(*names).unionByName(root)
    return every.join(ends, ["depth", "x1", "x2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The prefix trie of conversations with shared heads (see rebuilt); columns as in prefix_trie().

    Order, NULLs and ties as in ordered_turns(): rows that repeat are turns like
    any other.  Other columns are ignored; an empty table gives no rows.
    """
    turns = saved(ordered_turns(conversations, id_col, turn_col, role_col, text_col), "ordered-turns")
    convs, rows = rebuilt(turns)
    return prefix_trie(convs, rows)


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: The same with cumulated texts for prefixes and every node's ancestors for the totals; crc32 bit by bit.
OP12_SQL = f'''
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(digits) + 1), lambda i: CAST(ascii(digits[i]) AS BIGINT))),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
             CAST(4294967295 AS BIGINT)) % {HEAD} AS head
  FROM ids
), built AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= head
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > head
), deep AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, md5(role) || md5(text) AS said, strlen(text) AS bytes
  FROM built
), members AS (
  SELECT conv_id, depth, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name, bytes FROM deep
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), linked AS (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM members
), nodes AS (
  SELECT depth, name, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY depth, name
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.name) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.name = n.above
), totals AS (
  SELECT m.depth, m.name, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.name
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN totals USING (depth, name)
'''
