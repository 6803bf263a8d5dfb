"""Quality, toxicity, decontamination and near-duplicates against plain Python."""

import itertools
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import benchmark, documents, labels, no_rows, odd  # noqa: F401

from tickloom.llm import decontam, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(frame, key="id"):
    return {row[key]: row.asDict() for row in frame.collect()}


# --- quality ---------------------------------------------------------------


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            hit.update(range(i, i + 5))
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == plain_repeats(words)


def test_base_counts():
    text = "one two  three\n\n \none two  three\n#*$ x|\n#*$ x|\x0b"
    assert quality.base_counts(text) == (10, 27 + 5, 8, 1, 0)
    assert quality.base_counts("") == (0, 0, 0, 0, 0)


def test_ratios_follow_their_definition(spark, documents, labels):
    ratios = quality.fit(documents, labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for row in documents.collect():
        grams = np.bincount(quality.ngrams(row.text, quality.BUCKETS), minlength=quality.BUCKETS)
        raw += grams
        target += grams * (row.doc_id in good)
    expected = raw * target.sum() / raw.sum()
    assert np.allclose(ratios, np.log((target + quality.PRIOR) / (expected + quality.PRIOR)))
    found = rows_of(quality.quality_rules(documents, labels))
    for row in documents.collect():
        n, chars, symbols, dup, repeats = quality.base_counts(row.text)
        got = found[row.doc_id]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert repeats == plain_repeats(row.text.encode().split())
        assert got["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert got["kept"] == (not got["base_failed"] and quality.score(row.text, ratios) >= quality.THRESHOLD)


def test_quality_tells_junk_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = rows_of(quality.quality_rules(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(marks[i], r["kept"]) for i, r in found.items() if i in marks and not r["base_failed"]]
    assert all(kept for good, kept in judged if good)
    assert sum(not kept for good, kept in judged if not good) >= 0.8 * sum(not good for good, _ in judged)


def test_quality_cases(odd, no_rows, labels):
    found = quality.quality_rules(odd, labels)
    assert found.count() == odd.count() and not any(r.kept for r in found.where("id IN (1, 2, 4)").collect())
    assert quality.quality_rules(no_rows, labels).count() == 0
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns
    assert {r.id for r in quality.quality_rules(odd, labels.limit(0)).where("kept").collect()} == {r.doc_id for r in kept.collect()}


# --- near duplicates -------------------------------------------------------


def plain_fingerprint(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(prints))]


def test_near_duplicates_are_the_components(spark, documents):
    found = simhash.near_duplicates(documents)
    rows = found.collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.fp == simhash.signed(plain_fingerprint(texts[r.id])) for r in rows)
    roots = plain_components([r.fp & (1 << 64) - 1 for r in rows])
    least = {}
    for row, root in zip(rows, roots):
        least[root] = min(least.get(root, row.id), row.id)
    assert [r.component_id for r in rows] == [least[root] for root in roots]
    kept = simhash.deduplicate(documents)
    assert {r.doc_id for r in kept.collect()} == set(least.values()) and kept.columns == documents.columns


def test_links_join_dense_and_chained_groups(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    values = set(base)
    for center in base[:3]:  # dense groups, and chains of steps of four bits
        for _ in range(150):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            values.add(center ^ sum(1 << int(b) for b in flips))
        step = center
        for k in range(0, 60, 4):
            step ^= 0b1111 << k
            values.add(step)
    values = sorted(values)
    rows = spark.createDataFrame([(k, simhash.signed(v)) for k, v in enumerate(values)], "id long, fp long")
    roots = plain_components(values)
    for tile in (20_000, 40):  # the second cuts large shards into tiles
        edges = simhash.links(rows.select("fp"), tile=tile)
        got = {r.node: r.root for r in simhash.stars(edges).collect()}
        group = [got.get(simhash.signed(v), simhash.signed(v)) for v in values]
        assert len(set(zip(roots, group))) == len(set(roots)) == len(set(group))


def test_bk_tree_links_what_brute_force_links():
    rng = np.random.default_rng(1)
    values = sorted({int(x) for x in rng.integers(0, 1 << 16, 800)})
    links = simhash.shard_links(values, 2)
    roots = plain_components(values, 2)
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert len(links) == len(values) - len(set(roots))


def test_one_id_in_two_components(spark):
    rows = [(1, "a b c d e f"), (1, "quite another text with other words"), (2, "A B c d  e f"), (1, "a b c d e f")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:2])


def test_near_copies_without_ids(spark):
    words = [f"w{k}" for k in range(100)]
    near = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]])]
    prints = [simhash.fingerprint(t) for t in near]
    assert len(set(prints)) == 3 and all((prints[0] ^ p).bit_count() <= 4 for p in prints)
    other = "quite another text with other words"
    rows = [(None, t) for t in [*near, near[0], other, other]]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 2 and sum(r.text == other for r in kept) == 1 and all(r.doc_id is None for r in kept)
    named = simhash.deduplicate(spark.createDataFrame([*rows, (7, near[1])], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in named) == [("7", near[1]), ("None", other)]


def test_near_duplicate_cases(odd, no_rows):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.id in (1, 2, 4)} == {1} and {r.fp for r in rows if r.id == 1} == {0}
    assert [r.component_id for r in rows if r.id is None] == [None]
    kept = simhash.deduplicate(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"] and kept.columns == odd.columns
    assert simhash.near_duplicates(no_rows).count() == 0 and simhash.deduplicate(no_rows).count() == 0


# --- decontamination -------------------------------------------------------


def plain_passages(text, items):
    words = decontam.words_of(text)
    found = {}
    for item, passage in items:
        wanted = decontam.words_of(passage)
        size = min(len(wanted), len(words))
        weights = Counter(decontam.shingles(wanted))
        for at in range(len(words) - size + 1) if size else ():
            same = decontam.weighted_similarity(Counter(decontam.shingles(words[at : at + size])), weights)
            if same >= 0.8 and same > found.get(item, (0, 0))[0]:
                found[item] = (same, at)
    return found


def test_decontamination_finds_all_windows(spark, documents, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    long = max(items, key=lambda item: len(item[1]))[1].split()
    altered = long[:30] + ["changed"] + long[31:]
    extra = [
        (10_001, " ".join(long)),
        (10_002, "Before. " + " -- ".join(w.upper() if w.isascii() else w for w in long) + " after"),
        (10_003, "x y z " + " ".join(altered)),
        (10_004, " ".join(long[: len(long) // 2])),
    ]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {}
    for r in decontam.contaminated(docs, benchmark).collect():
        got.setdefault(r.id, {})[r.item_id] = (r.similarity, r.first_word)
    want = {r.doc_id: p for r in docs.collect() if (p := plain_passages(r.text, items))}
    assert got == want and {10_001, 10_002} <= set(got) and 10_004 not in got
    assert {r.doc_id for r in decontam.keep_clean(docs, benchmark).collect()} == {r.doc_id for r in docs.collect()} - set(want)


def test_many_items_of_one_length(spark):
    """The index against a search of all windows, where items share shingles; and its memory with 100,000 items of a length."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    common = "at the end of the day it is".split()
    items = [(k, " ".join([*rng.choice(vocabulary, 12), *common, *rng.choice(vocabulary, 12)])) for k in range(60)]
    texts = []
    for k in range(40):
        words = [*rng.choice(vocabulary, 30), *items[k][1].split(), *common, *rng.choice(vocabulary, 20), *items[-k - 1][1].split()]
        for at in rng.integers(0, len(words), k % 4):
            words[at] = "other"
        texts.append(" ".join(words))
    index = decontam.Items(items, 18, 0.8)
    total = 0
    for text in texts:
        got = {item: (same, first) for item, first, _, same in index.passages(text)}
        assert got == plain_passages(text, items)
        total += len(got)
    assert total > 40
    many = [(k, " ".join(f"x{v}" for v in rng.integers(0, 10**6, 8))) for k in range(100_000)]
    tracemalloc.start()
    index = decontam.Items(many, 18, 0.8)
    text = " ".join(rng.choice(vocabulary, 5000).tolist() + [many[7][1], many[99_999][1]])
    assert [p[0] for p in index.passages(text)] == [7, 99_999]
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_decontamination_in_blocks(spark, monkeypatch, documents, benchmark):
    whole = sorted(decontam.contaminated(documents, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3_000)
    assert len(list(decontam.item_blocks(benchmark, "item_id", "text"))) > 1
    assert sorted(decontam.contaminated(documents, benchmark).collect()) == whole


def test_decontamination_cases(spark, odd, no_rows, benchmark):
    assert decontam.contaminated(no_rows, benchmark).count() == 0
    assert decontam.keep_clean(odd, benchmark).count() == odd.count()
    assert decontam.keep_clean(odd, benchmark.limit(0)).count() == odd.count()
    items = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "WITHOUT an id")], "item_id long, text string")
    found = sorted((str(r.id), str(r.item_id), r.first_word) for r in decontam.contaminated(odd, items).collect())
    assert found == [("None", "3", 0), ("None", "3", 0), ("None", "None", 2)]


# --- toxicity --------------------------------------------------------------


INSULTS = {"idiot": 5.0, "moron": 5.0}


@pytest.mark.parametrize(
    "more, less",
    [
        ("you are an idiot", "that idiot came"),  # a target
        ("he is an idiot", "he is not an idiot"),  # negation
        ("you idiot", "she said you idiot"),  # reported speech
        ("you idiot", "the sign says nothing, but « idiot » was on it"),  # quotation
        ("i will kill you", "i will kill time"),  # a threat needs a target
        ("you idiot and moron", "you idiot"),
    ],
)
def test_grammar(more, less):
    assert sum(toxicity.features(more, INSULTS)) > sum(toxicity.features(less, INSULTS))


def test_negation_does_not_cross_clauses():
    assert toxicity.features("not now. you idiot", INSULTS) == toxicity.features("you idiot", INSULTS)
    assert toxicity.features("", INSULTS) == toxicity.features("nothing here", INSULTS) == (0.0, 0.0)


def plain_weight(kinds, weights):
    """The weight of a clause, by looking for each mark at the words around it."""
    total = 0.0
    for i, (kind, weight) in enumerate(zip(kinds, weights)):
        aimed = "target" in kinds[i + 1 : i + 1 + toxicity.THREAT_REACH]
        if kind == "insult" or (kind == "threat" and aimed):
            negated = "negation" in kinds[max(0, i - toxicity.NEGATION_REACH) : i]
            told = "report" in kinds[:i] or kinds[:i].count("quote") % 2 == 1
            total += weight * (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if told else 1)
    return total * (toxicity.TARGETED if "target" in kinds else 1)


def test_the_composed_machine_against_every_short_clause():
    for length in range(6):
        for kinds in itertools.product(toxicity.CLASSES, repeat=length):
            weights = [1.0 + k for k in range(length)]
            assert toxicity.weigh(list(kinds), weights) == pytest.approx(plain_weight(kinds, weights))
    rng = np.random.default_rng(8)
    for _ in range(2000):
        kinds = [str(k) for k in rng.choice(toxicity.CLASSES, rng.integers(6, 40))]
        weights = list(rng.random(len(kinds)))
        assert toxicity.weigh(kinds, weights) == pytest.approx(plain_weight(kinds, weights))
    assert len(toxicity.GRAMMAR.ends) == 4 * 4 * 2 and len(toxicity.THREAT.ends) == toxicity.THREAT_REACH + 1


@pytest.mark.parametrize(
    "more, less",
    [
        ("du idiot", "der idiot kam"),
        ("er ist ein idiot", "er ist kein idiot"),
        ("tu es un idiot", "tu n'est pas un idiot"),
        ("usted idiot", "dijo usted idiot"),
        ("voy a matar a todos", "voy a matar el tiempo"),
    ],
)
def test_grammar_of_other_languages(more, less):
    assert sum(toxicity.features(more, INSULTS)) > sum(toxicity.features(less, INSULTS))


def test_scores_against_plain_python(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    insults, beta = toxicity.fit(documents, labels)
    assert insults
    found = {r.id: (r.held_out, r.score, r.predicted) for r in toxicity.toxicity(documents, labels).collect()}
    for row in documents.select("doc_id", "text").collect():
        weights = [0.0]
        for clause in re.split(r"[.!?;:\n]+", (row.text or "").lower()):
            words = toxicity.WORD.findall(clause)
            kinds = [toxicity.class_of(w, insults) for w in words]
            weights.append(plain_weight(kinds, [insults.get(w, toxicity.THREAT_WEIGHT) for w in words]))
        score = 1 / (1 + np.exp(-(beta[0] + beta[1] * np.log1p(max(weights)) + beta[2] * np.log1p(sum(weights)))))
        held_out = zlib.crc32(str(row.doc_id).encode()) % 5 == 0
        assert found[row.doc_id] == (held_out, pytest.approx(score), int(score >= 0.5))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    right = [(r.toxic, r.predicted) for r in found]
    assert sum(p for t, p in right if t) >= 0.85 * sum(t for t, _ in right)
    assert sum(p for t, p in right if not t) <= 0.01 * sum(1 - t for t, _ in right)


def test_scores_do_not_see_labels_of_the_held_out(spark, documents, labels):
    from pyspark.sql import functions as F

    first = toxicity.toxicity(documents, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(first.collect()) == sorted(toxicity.toxicity(documents, flipped).collect())


def test_the_toxicity_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat: the driver gets SAMPLE rows at most, of different texts."""
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    rows = [(1, f"you are a moron {k % 50}") for k in range(2000)] + [(2, "fine words")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(len(y)) or np.array([-4.0, 1.0, 1.0]))
    toxicity.fit(docs, marks)
    assert len(seen) <= 1 and all(n <= 10 for n in seen)


def test_toxicity_cases(spark, odd, no_rows, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id in (1, 2, 4)}) == 1
    assert toxicity.toxicity(no_rows, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
