"""Spelling variants, the conversation trie and languages against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, documents, no_rows, odd  # noqa: F401
from pyspark.sql import functions as F

from tickloom.llm import languages, prefixes, spelling

# --- spelling --------------------------------------------------------------

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_near(words):
    """Near words of each, by the texts that remain without one letter."""
    gaps, near = defaultdict(list), defaultdict(set)
    for word in words:
        for k in range(len(word)):
            gaps[word[:k], word[k + 1 :]].append(word)
            if (less := word[:k] + word[k + 1 :]) in words:
                near[word].add(less)
                near[less].add(word)
    for group in gaps.values():
        for word in group:
            near[word].update(set(group) - {word})
    return near


def plain_variants(counts, ratio=10):
    near, form = plain_near(counts), {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def found_variants(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def as_counts(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_variants_of_documents(spark, documents):
    counts = Counter()
    for row in documents.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = run.translate(SMALL)
            key = zlib.crc32(f"{row.doc_id}:{run}".encode())
            if key % 31 == 0:
                run = run[: key % len(run)] + run[key % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert found_variants(spelling.op11_spelling(spark, SF)) == plain_variants(counts)


@pytest.mark.parametrize("cell, tile", [(4096, 16_384), (16, 24), (4, 2)])
def test_cells_and_tiles_lose_no_pair(spark, monkeypatch, cell, tile):
    """Dense words of two letters, anagrams (equal vectors), and chains of forms, in many cells and tiles."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("ab"), rng.integers(5, 9))) for _ in range(250)}
    words |= {"".join(rng.permutation(list("abcdefg"))) for _ in range(200)}
    words |= {"ab" * 40, "ab" * 40 + "a", "ba" * 40, "ab" * 39 + "aé", "é", "", "x" * 63, "x" * 64, "x" * 65, "🙂bc", "🙂b"}
    counts = {w: int(10 ** rng.integers(0, 7)) for w in words}
    assert found_variants(spelling.variants(as_counts(spark, counts))) == plain_variants(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit(a, b):
    assert bool(spelling.one_edit([a], [b])[0]) == (b in plain_near({a, b})[a])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdé🙂", min_size=1, max_size=6), min_size=2, max_size=120, unique=True))
def test_searches_enter_every_leaf_in_reach(words):
    vectors = spelling.letter_counts(words)
    tree = spelling.Tree(vectors, 9)
    one = np.ones(len(words), np.int16)
    entered = {(r, leaf) for leaf, rows, _, _ in tree.search(vectors, np.arange(len(words)), one, one) for r in rows}
    own = spelling.home(tree, vectors)
    change = vectors[None].astype(int) - vectors[:, None]
    reach = (np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1)
    assert all((a, own[b]) in entered for a, b in zip(*np.nonzero(reach)))


def test_spelling_cases(spark, odd, no_rows):
    found = found_variants(spelling.document_variants(odd))
    assert found == {} or all(n >= 2 for _, _, n, _, _ in found.values())
    for empty in (no_rows, odd.where("text IS NULL")):
        assert spelling.document_variants(empty).collect() == []
    assert spelling.variants(as_counts(spark, {}).limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    # a very long word has near words like any other; a missing id counts as the empty text
    long = "y" * 300_000
    rows = [(None, f"{long} {long[1:]}")] * 2 + [(k, "Letter-runs LETTER") for k in range(3)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [r.word for r in spelling.letter_runs(texts, 7).collect()]
    assert sorted(map(len, runs)) == [299_999, 299_999, 300_000, 300_000]
    assert {len(w): v[3] for w, v in found_variants(spelling.variants(as_counts(spark, Counter(runs)))).items()} == {299_999: 1, 300_000: 1}


# --- conversations ---------------------------------------------------------


def plain_trie(rows):
    """All columns of the trie from (conv_id, turn, role, text) rows, turns unique within a conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = Counter(key[:-1] for key in members if key)
    leaves, tokens = Counter(), Counter()
    for key, ids in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            tokens[key[:d]] += (len(ids) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted(
        (
            ids[0],
            len(key),
            members[key[:-1]][0] if key else -1,
            len(ids),
            children[key],
            leaves[key],
            tokens[key],
            hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest(),
        )
        for key, ids in members.items()
    )


def found_trie(frame):
    return sorted(tuple(-1 if v is None else v for v in row) for row in frame.collect())


SPEECH = "conv_id long, turn long, role string, text string"


def trie_with(spark, rows, local):
    convs, turns = prefixes.rebuilt(prefixes.ordered_turns(spark.createDataFrame(rows, SPEECH)))
    return found_trie(prefixes.prefix_trie(convs, turns, local))


def test_trie_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(prefixes.op12_prefixes(spark, SF)) == plain_trie(rows)


@pytest.mark.parametrize("local", [1024, 20, 1])
def test_split_components_give_the_same_totals(spark, monkeypatch, local):
    """A bushy trie with copies, a long chain, turnless conversations, NULLs: finished in tasks, and split to single nodes."""
    monkeypatch.setattr(prefixes, "CHUNK", 4)
    monkeypatch.setattr(prefixes, "ENDS", 3)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bé", "ccc"])))
    rows += [(c, t, "user", "same") for c in (200, 205, 210, 215) for t in range(12)]
    rows += [(300, t, "user", f"step {t}") for t in range(40)] + [(305, t, "user", f"step {t}") for t in range(33)]
    rows += [(401, 1, "user", "no base"), (-7, 0, None, None), (77, None, "user", None), (77, 0, "user", "x")]
    assert trie_with(spark, rows, local) == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40))
def test_subtree_totals(choices):
    parents = [-1] + [choice % (k + 1) for k, choice in enumerate(choices)]
    values = [(k + 1, k % 3) for k in range(len(parents))]
    want = [list(v) for v in values]
    for k in range(len(parents) - 1, 0, -1):
        for j in (0, 1):
            want[parents[k]][j] += want[k][j]
    assert prefixes.subtree_totals(parents, values) == [tuple(w) for w in want]


def test_conversation_cases(spark):
    none = spark.createDataFrame([], SPEECH)
    assert prefixes.conversation_trie(none).collect() == []
    # rows without an id belong to no conversation; a turn and its repetition are two turns
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 1, "user", "long " * 100_000), (3, 1, "user", "long " * 100_000)]
    frame = spark.createDataFrame(rows, SPEECH)
    for name in ("n", "depth", "top", "x1", "part", "a.b", "node", "place"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = found_trie(prefixes.conversation_trie(frame))
    lone = [(3, 1, "user", "long " * 100_000)] * 2
    h = zlib.crc32(b"3") % 9
    kept = ([(3, 0, "", "")] + lone)[h:]
    assert len(found) == 1 + len(kept) and all(row[3] == 1 for row in found)
    assert found[-1][-1] == hashlib.sha256(b"3").hexdigest()


# --- languages -------------------------------------------------------------


def test_smallest_dictionary_wins(spark, documents):
    """The query's rows against compression of each whole text, and the accuracy on documents that were not learned from."""
    learned = documents.filter(~languages.held_out(F.col("doc_id")))
    judge = languages.Judge(languages.fit(learned))
    found = {r.doc_id: r for r in languages.op13_languages(spark, SF).collect()}
    right = total = 0
    for row in documents.collect():
        got = found[row.doc_id]
        assert got.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        sizes = [0] * len(judge.languages)
        for at in range(0, len(row.text), languages.BLOCK):
            block = row.text[at : at + languages.BLOCK].lower().encode()
            sizes = [n + len(e.compress(block)) for n, e in zip(sizes, judge.encoders)]
        assert got.lang_pred == judge.languages[sizes.index(min(sizes))] and 0 <= got.score <= 1
        if got.held_out and len(row.text) >= 30:
            right, total = right + (got.lang_pred == row.lang), total + 1
    assert len(found) == documents.count() and right >= 0.95 * total > 0


def test_held_out_rows_are_not_learned(spark, documents):
    swapped = F.when(languages.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))
    learned = documents.withColumn("lang", swapped).filter(~languages.held_out(F.col("doc_id")))
    assert languages.fit(learned) == languages.fit(documents.filter(~languages.held_out(F.col("doc_id"))))


def test_language_cases(spark, odd, no_rows, documents):
    model = languages.fit(documents)
    found = {r.id: r for r in languages.predict(odd, model).collect()}
    assert languages.predict(odd, model).count() == odd.count()
    assert [(found[k].lang_pred, found[k].score, found[k].accepted) for k in (1, 2, 4)] == [("und", 0.0, False)] * 3
    assert found[3].lang_pred in model.languages
    assert languages.predict(no_rows, model).collect() == []
    nothing = languages.fit(no_rows)
    assert nothing.languages == [] and {r.lang_pred for r in languages.predict(odd, nothing).collect()} == {"und"}
    # one language only, whose rows are copies of a single text: a small dictionary, and it is always chosen
    copies = spark.createDataFrame([("mm", "la la lo")] * 50 + [(None, "x"), ("mm", None), ("mm", "12")], "lang string, text string")
    one = languages.fit(copies)
    assert one.languages == ["mm"] and one.dictionaries == [b"la la lo\n"]
    assert {r.lang_pred for r in languages.predict(odd, one).collect()} == {"und", "mm"}


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(languages, "ROWS", 5)
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 2)
    rows = [(lang, f"{lang} word {k}") for lang, n in (("aa", 300), ("bb", 200), ("cc", 1)) for k in range(n)]
    model = languages.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["aa", "bb"] and all(1 <= d.count(b"\n") <= 5 for d in model.dictionaries)
