"""License scans: phrases by their words, and blocks by a set-similarity join with license templates.

A block of a text states a license if it holds at least ``threshold`` of the
distinct words of one of its templates.  Blocks are all runs of consecutive words
of a paragraph that are half as long again as the template: in longer runs, words
of other sentences would make up a short one.  Line breaks within a paragraph
count as blanks, as notices are wrapped; lines without words end a paragraph.
The join finds all such blocks:

* words are ordered by how many texts of the corpus hold them, rarest first;
* *prefix filter*: a block that holds need = ceil(threshold * n) of a template's
  n words holds one of its n - need + 1 rarest; only blocks with such a word
  meet the templates filed under it;
* *length filter*: the block must have need words;
* *positional filter*: a word that is the i-th of the template and the j-th of
  the block leaves at most min(i, j) + 1 + min(words after both) in common;
* what remains is verified by counting the common words.

Words that no template has cannot be shared, so a block's order runs over its
template words only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, saved, table

#: Anything but ASCII letters and digits and characters beyond ASCII, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A gap with a line that has no words.
PARAGRAPH = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"

#: Phrases and labels of the base scan (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Lines by which licenses are usually stated.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8


def lowered(text: Column) -> Column:
    """A-Z in lower case; other capitals too, but no character becomes an ASCII one.

    The two that would are private characters here: part of a word, as before.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def word_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that hold a word, rarest first."""
    held = rows.select(F.explode(F.array_intersect(F.split("low", GAP), strings(vocabulary))).alias("word"))
    counts = dict(held.groupBy("word").count().collect())  # one row for each word of the templates
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def starts_of(words: Column, phrase: str) -> Column:
    """Places (from 0) at which the words of a phrase stand one after another."""
    parts = phrase.split()
    none = F.array().cast("array<int>")
    places = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(none)

    def here(at):
        same = F.lit(True)
        for k, part in enumerate(parts):
            same &= F.get(words, at + k) == part
        return same

    return F.filter(places, here)


def run_width(template: str) -> int:
    """Words of the runs in which a template is looked for."""
    return len(template.split()) * 3 // 2


def stretches(low: Column, widest: int, least: int, vocabulary: list[str], prefix: list[str]) -> Column:
    """The distinct runs of ``widest`` words that begin with a template word and hold a prefix word and ``least`` template words.

    As texts, with single blanks, in which other words are empty.  A run that
    begins with another word holds no more than one that begins later.
    """

    def meets(words):
        held = F.array_intersect(words, strings(vocabulary))
        return (F.size(held) >= least) & F.arrays_overlap(held, strings(prefix))

    def runs(words):
        starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda at: F.get(words, at - 1) != "")
        found = F.filter(F.transform(starts, lambda at: F.slice(words, at, widest)), meets)
        return F.transform(found, lambda run: F.array_join(run, " "))

    known = lambda part: F.transform(F.split(part, GAP), lambda w: F.when(w.isin(vocabulary), w).otherwise(""))
    paragraphs = F.filter(F.transform(F.split(low, PARAGRAPH), known), meets)
    return F.array_distinct(F.flatten(F.transform(paragraphs, runs)))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    labels joins the phrases' labels and those of templates that a block
    contains; score is the largest containment of a template that reaches the
    threshold, 1 where a phrase stands, else 0.  A NULL text counts as empty
    and has no words, places or labels.  Repeated rows and rows without an id
    each keep their row.  Other columns are ignored.
    """
    low = lowered(F.coalesce(column(text_col).cast("string"), F.lit("")))
    rows = docs.select(column(id_col).alias("id"), low.alias("low"))
    sets = [(label, sorted(set(text.split())), run_width(text)) for label, text in templates]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    order = word_order(rows, vocabulary)
    rank = {w: k for k, w in enumerate(order)}
    index: dict[str, list] = {}  # prefix word -> templates filed under it
    fewest: dict[int, int] = {}  # width of runs -> words that one of its templates asks for
    for label, words, width in sets:
        words = sorted(words, key=rank.__getitem__)
        need = ceil(threshold * len(words) - 1e-9)
        for i, word in enumerate(words[: len(words) - need + 1]):
            index.setdefault(word, []).append((label, i, need, width, words))
        fewest[width] = min(need, fewest.get(width, need))
    prefix = sorted(index)

    # each row by itself: base scan, and the stretches of texts that hold a prefix word
    rows = rows.select("id", "low", F.split("low", GAP).alias("words"))
    edges = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size("words") > 1) & (F.element_at("words", -1) == ""), 1
    ).otherwise(0)  # a gap at the start or the end of a text leaves an empty piece
    firsts = sorted({phrase.split()[0] for phrase, _ in PHRASES})
    none = F.array().cast("array<string>")
    words = F.when(F.arrays_overlap("words", strings(firsts)), F.filter("words", lambda w: w != "")).otherwise(none)
    widest, least = max(fewest, default=1), min(fewest.values(), default=1)
    blocks = stretches("low", widest, least, vocabulary, prefix)
    rows = rows.select(
        "id",
        F.xxhash64("low").alias("print"),
        F.length("low").alias("size"),
        (F.size("words") - edges).cast("long").alias("n_words"),
        words.alias("base_words"),
        F.when(F.arrays_overlap("words", strings(prefix)), blocks).otherwise(none).alias("blocks"),
    )
    places = F.array(*(starts_of(F.col("base_words"), phrase) for phrase, _ in PHRASES))
    rows = saved(rows.select("id", "print", "size", "n_words", places.alias("places"), "blocks"), "license-blocks")

    # the join: blocks meet the templates filed under their prefix words
    filed = docs.sparkSession.range(1).select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(word).alias("word"),
                        F.array(
                            *(
                                F.struct(
                                    F.lit(label).alias("label"),
                                    F.lit(i).alias("i"),
                                    F.lit(need).alias("need"),
                                    F.lit(width).alias("width"),
                                    F.array(*map(F.lit, words)).alias("words"),
                                )
                                for label, i, need, width, words in of
                            )
                        ).alias("templates"),
                    )
                    for word, of in sorted(index.items())
                )
            )
        )
    )
    # of each stretch the first words, as many as some template's blocks have
    found = rows.select("id", "print", "size", F.explode("blocks").alias("stretch")).withColumn("stretch", F.split("stretch", " "))
    block = lambda w: F.struct(F.lit(w).alias("width"), F.array_intersect(F.slice("stretch", 1, w), strings(order)).alias("words"))
    found = found.select("id", "print", "size", F.inline(F.array(*map(block, sorted(fewest)))))
    need = F.element_at(F.create_map(*(F.lit(x) for pair in fewest.items() for x in pair)), F.col("width"))
    ordered = F.filter(F.array(*map(F.lit, order)), lambda w: F.array_contains("words", w))
    found = found.filter(F.size("words") >= need).select("id", "print", "size", "width", ordered.alias("block"))
    found = found.select("*", F.posexplode("block").alias("j", "word")).filter(F.col("word").isin(prefix))
    found = found.join(F.broadcast(filed), "word").withColumn("t", F.explode("templates"))  # a row for each word of the templates
    n_block, n_template, i, j = F.size("block"), F.size("t.words"), F.col("t.i"), F.col("j")
    found = found.filter((F.col("width") == F.col("t.width")) & (n_block >= F.col("t.need")))
    found = found.filter(F.least(i, j) + 1 + F.least(n_template - i - 1, n_block - j - 1) >= F.col("t.need"))
    common = F.size(F.array_intersect("block", "t.words"))
    found = found.filter(common >= F.col("t.need"))
    found = found.groupBy("id", "print", "size").agg(
        F.collect_set("t.label").alias("own"), F.max(common / n_template).alias("best")
    )

    # equal rows have equal blocks: the key is their id and text, and a row keeps its place
    left, right = rows.alias("l"), found.alias("r")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.print") == F.col("r.print")) & (F.col("l.size") == F.col("r.size"))
    joined = left.join(right, same, "left").select("l.*", "r.own", "r.best")
    base = F.sort_array(F.array_compact(F.array(*(F.when(F.size(F.col("places")[k]) > 0, label) for k, (_, label) in enumerate(PHRASES)))))
    every = F.flatten("places")
    own = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        "id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _op10_sql() -> str:
    """The same by comparing every run of words with every template."""
    sets = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}], {run_width(text)})" for label, text in TEMPLATES
    )
    phrases = ", ".join(f"('{label}', [{', '.join(map(repr, p.split()))}])" for p, label in PHRASES)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), templates(label, words, width) AS (VALUES {sets}
), phrases(label, words) AS (VALUES {phrases}
), worded AS (
  SELECT doc_id, list_filter(string_split_regex(low, '{gap}'), lambda w: w != '') AS words FROM low
), places AS (
  SELECT doc_id, label, len(words) AS k, unnest(list_filter(range(len(w) - len(words) + 1), lambda i: w[i + 1 : i + len(words)] = words)) AS start
  FROM (SELECT doc_id, worded.words AS w, phrases.label, phrases.words FROM worded, phrases
        WHERE list_contains(worded.words, phrases.words[1]))
), base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), paragraphs AS (
  SELECT doc_id, list_filter(string_split_regex(paragraph, '{gap}'), lambda w: w != '') AS words
  FROM (SELECT doc_id, unnest(string_split_regex(low, '{PARAGRAPH}')) AS paragraph FROM low)
), held AS (
  SELECT doc_id, p.words AS words, t.label, t.words AS template, t.width, ceil({THRESHOLD} * len(t.words) - 1e-9) AS need
  FROM paragraphs p, templates t WHERE len(list_intersect(p.words, t.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9)
), runs AS (
  SELECT doc_id, label, len(template) AS n, need,
         list_max(list_transform(range(1, len(words) + 1), lambda i: len(list_intersect(words[i : i + width - 1], template)))) AS most
  FROM held
), own AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(most / n) AS best FROM runs WHERE most >= need GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM worded w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN own ON w.doc_id = own.doc_id
"""


OP10_SQL = _op10_sql()
