"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded once and aggregated by their length in tokens.  The
histogram has one row for each length that occurs; its size follows the longest
document, never the number of documents.  Suffix sums over it give, for every
limit, how many documents are longer and what they hold, hence how many tokens
remain if every document is cut at the limit, and quantiles of the length.

Sums run in two levels, blocks of lengths and the lengths within a block, so
that no task orders the whole histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BLANK, tokenizer_file
from .common import map_texts, saved, table, texts

#: Lengths in a block of the histogram.
BLOCK = 4096

#: Runs of white space from this length on are encoded apart: the library's own splitting needs a stack as deep as a run.
LONG_RUN = re.compile(f"[{BLANK}]{{4096,}}")

_LOADED: dict[str, object] = {}


def rank_encoder(path: str):
    """The encoder of a rank file; one for each Python worker, kept between its tasks."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _LOADED.clear()
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def rank_ids(path: str) -> Callable[[str], list[int]]:
    """The function from a text to its ids under a rank file; the ids are the library's, and no text is too long for it.

    The splitting rule gives a run of white space one piece, without its last
    character if something follows; that character goes with what follows, or
    is a piece of its own.  Nothing before the run depends on the run's length.
    """
    encoding = rank_encoder(path)

    def ids(text: str) -> list[int]:
        if len(text) < 4096 or not (run := LONG_RUN.search(text)):
            return encoding.encode_ordinary(text)
        out, at = [], 0
        while run:
            start, end = run.span()
            end -= end < len(text)
            out += encoding.encode_ordinary(text[at:start])
            out += encoding._encode_single_piece(text[start:end])
            at, run = end, LONG_RUN.search(text, end + 1)
        return out + encoding.encode_ordinary(text[at:])

    return ids


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; a NULL text counts as empty and has no tokens."""

    def make():
        encode = rank_ids(tokenizer)
        return lambda batch: [[len(encode(t)) for t in batch]]

    return map_texts(texts(docs, id_col, text_col), make, [T.StructField("n_tokens", T.LongType())])


def length_histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of rows with n_tokens."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    n_tokens, n_docs        the length and how many documents have it
    docs_up_to, docs_over   documents of at most this length, and longer ones
    tokens_over             tokens of the longer ones
    tokens_kept             tokens that remain when documents are cut at this length
    tokens_total            tokens of all documents
    share_up_to             share of documents of at most this length

    Limits between two lengths follow from the rows: see at_limits.  An empty
    histogram gives no rows.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # one row for each BLOCK lengths: small enough for one task
    every = Window.partitionBy(F.lit(0)).orderBy("block")
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(1, Window.unboundedFollowing)
    nought = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "block",
        nought(F.sum("docs").over(before)).alias("docs_before"),
        nought(F.sum("docs").over(after)).alias("docs_after"),
        nought(F.sum("tokens").over(after)).alias("tokens_after"),
        F.sum("tokens").over(Window.partitionBy(F.lit(0))).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    upto, over = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(upto)).alias("docs_up_to"),
        (F.col("docs_after") + nought(F.sum("n_docs").over(over))).alias("docs_over"),
        (F.col("tokens_after") + nought(F.sum(tokens).over(over))).alias("tokens_over"),
        "tokens_total",
    )
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    share = F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_over"))
    return rows.withColumns({"tokens_kept": kept, "share_up_to": share})


def at_limits(limits: DataFrame, *wanted: int) -> DataFrame:
    """(limit, docs_over, tokens_kept) of any context limits: the suffix sums at the largest length not above each."""
    total, docs = F.max("tokens_total"), F.max(F.col("docs_up_to") + F.col("docs_over"))
    rows = []
    for limit in wanted:
        at = F.max_by(F.struct("docs_over", "tokens_over"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens")))
        docs_over, tokens_over = F.coalesce(at["docs_over"], docs), F.coalesce(at["tokens_over"], total)
        kept = total - tokens_over + F.lit(limit) * docs_over
        rows.append(F.struct(F.lit(limit).cast("long").alias("limit"), docs_over.alias("docs_over"), kept.alias("tokens_kept")))
    return limits.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quantiles(limits: DataFrame, *shares: float) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    least = lambda s: F.min(F.when(F.col("share_up_to") >= s, F.col("n_tokens")))
    rows = [F.struct(F.lit(s).alias("share"), least(s).alias("n_tokens")) for s in shares]
    return limits.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def op4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return limit_table(saved(length_histogram(counts), "length-histogram"))
