"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon makes each word of a clause an insult (with its learned weight), a
threat verb, a target, a negation, a reporting verb, a mark of quotation, or
nothing.  Four transducers, each a table of states and moves, read the classes:

1. *threat*, from right to left: a threat verb counts only with a target among
   the next words, and then as an insult of a fixed weight;
2. *negation*: after a negation the next words carry part of their weight;
3. *reported speech*: after a reporting verb, or within quotation marks, the
   rest of the clause carries part of its weight;
4. *target*: insults aimed at someone named in the clause weigh more; this is
   known at its end, as the weight of the state in which it ends.

The three that read from left to right are composed once into one machine, so a
clause is read twice, whatever its length.  Its weight is the sum of what comes
out; a text's features are its weightiest clause and the sum over its clauses.
The weights of insults and the logistic curve over the features are learned from
labelled rows, insults of all languages alike; the small words of the grammar
are those of English, German, French and Spanish, and are known in any text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_texts, saved, table, texts

# Word classes of the grammar (fixed values): English, German, French, Spanish.
TARGETS = frozenset(
    "you your yours yourself u he she him her you're they them their we us everyone people guys "
    "du dich dir dein deine ihr euch euer eure er sie ihn ihm ihnen alle leute "
    "tu toi ton ta tes vous votre vos il elle lui ils elles leur eux gens "
    "tú tu ti usted ustedes vosotros él ella ellos ellas te todos gente".split()
)
NEGATIONS = frozenset(
    "not no never nor neither without isn't aren't wasn't don't doesn't didn't won't can't "
    "nicht kein keine keinen nie niemals weder ohne "
    "pas jamais aucun aucune sans ni n'est n'a "
    "nunca jamás tampoco sin ningún ninguna".split()
)
REPORTS = frozenset(
    "said says say told claimed claims wrote writes called calls quoted reported alleged "
    "sagte sagt schrieb schreibt nannte nennt behauptete behauptet berichtete "
    "dit disait écrit écrivait appelle appelait affirme rapporte "
    "dijo dice escribió escribe llamó llama afirma afirmó".split()
)
THREATS = frozenset(
    "kill hurt destroy murder beat shoot stab burn strangle smash attack "
    "töte töten umbringen verprügeln erschießen abstechen erwürgen verbrennen "
    "tuer tuerai frapper poignarder étrangler brûler "
    "matar mataré golpear apuñalar estrangular quemar".split()
)
QUOTES = frozenset("\"“”«»")

NEGATED, REPORTED, TARGETED = 0.25, 0.5, 1.25  # factors on a weight
NEGATION_REACH, THREAT_REACH = 3, 4  # words
THREAT_WEIGHT = 4.0

SAMPLE = 20_000  # most labelled documents the model is fitted on
LEXICON = 2_000  # most insults kept
LEAST_CLAUSES = 6  # different toxic clauses that must hold a word before it counts as an insult
LEAST_ODDS = 2.5  # log-odds of a word in toxic clauses against others
CLAUSE_END = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")


def spoken(text: str) -> list[list[str]]:
    """Clauses as lists of lower-case words and quotation marks."""
    return [WORD.findall(clause) for clause in CLAUSE_END.split(text.lower())]


CLASSES = ("other", "insult", "threat", "target", "negation", "report", "quote")


def class_of(word: str, insults: dict[str, float]) -> str:
    if word in insults:
        return "insult"
    known = (("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", QUOTES), ("target", TARGETS))
    return next((kind for kind, words in known if word in words), "other")


class Machine(NamedTuple):
    """A transducer of classes: ``moves`` gives the next state, the class put out and its factor; ``ends`` the factor of a final state."""

    start: Hashable
    moves: dict[tuple[Hashable, str], tuple[Hashable, str, float]]
    ends: dict[Hashable, float]


def machine(start: Hashable, step: Callable, end: Callable = lambda state: 1.0) -> Machine:
    """The table of a step function, over the states that can be reached."""
    moves, ends, ahead = {}, {}, [start]
    while ahead:
        state = ahead.pop()
        if state in ends:
            continue
        ends[state] = end(state)
        for kind in CLASSES:
            moves[state, kind] = step(state, kind)
            ahead.append(moves[state, kind][0])
    return Machine(start, moves, ends)


def composed(first: Machine, second: Machine) -> Machine:
    """One machine that does what the second makes of the first's output."""

    def step(state, kind):
        left, between, factor = first.moves[state[0], kind]
        right, out, more = second.moves[state[1], between]
        return (left, right), out, factor * more

    return machine((first.start, second.start), step, lambda state: first.ends[state[0]] * second.ends[state[1]])


def _threat(reach, kind):
    """Read from the right: the words left in which a threat has its target."""
    put_out = kind if kind != "threat" else "insult" if reach else "other"
    return (THREAT_REACH if kind == "target" else max(0, reach - 1)), put_out, 1.0


def _negation(reach, kind):
    return (NEGATION_REACH if kind == "negation" else max(0, reach - 1)), kind, NEGATED if reach else 1.0


def _report(state, kind):
    told, quoted = state
    quoted = quoted != (kind == "quote")
    return (told or kind == "report", quoted), kind, REPORTED if told or quoted else 1.0


THREAT = machine(0, _threat)
GRAMMAR = composed(
    composed(machine(0, _negation), machine((False, False), _report)),
    machine(False, lambda seen, kind: (seen or kind == "target", kind, 1.0), lambda seen: TARGETED if seen else 1.0),
)


def weigh(kinds: list[str], weights: list[float]) -> float:
    """The weight of a clause of these classes, whose insults and threats have these weights."""
    state, read = THREAT.start, []
    for kind in reversed(kinds):
        state, kind, _ = THREAT.moves[state, kind]
        read.append(kind)
    state, total = GRAMMAR.start, 0.0
    for kind, weight in zip(reversed(read), weights, strict=True):
        state, kind, factor = GRAMMAR.moves[state, kind]
        if kind == "insult":
            total += weight * factor
    return total * GRAMMAR.ends[state]


def clause_weight(words: list[str], insults: dict[str, float]) -> float:
    return weigh([class_of(word, insults) for word in words], [insults.get(word, THREAT_WEIGHT) for word in words])


def features(text: str, insults: dict[str, float]) -> tuple[float, float]:
    """(weightiest clause, sum over clauses)."""
    marks = insults.keys() | THREATS
    if marks.isdisjoint(WORD.findall(text.lower())):
        return 0.0, 0.0
    weights = [clause_weight(words, insults) for words in spoken(text) if not marks.isdisjoint(words)]
    return max(weights), sum(weights)


def squashed(top, total):
    """Inputs of the logistic curve: both features on a scale where much more adds little."""
    return np.log1p(top), np.log1p(total)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.01) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method; x has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fold(id_column: Column) -> Column:
    """crc32 of the id's text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    ids = labels.groupBy(column(id_col).alias("id")).agg(F.max(column(label_col).cast("int")).alias("toxic"))
    ids = ids.filter((F.col("id").isNotNull()) & F.col("toxic").isin(0, 1) & (fold(F.col("id")) != 0))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, whatever the corpus
    return texts(docs, id_col, text_col).join(F.broadcast(ids), "id").select("text", "toxic")


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Weights of words that stand in many different toxic clauses and in few others.

    A clause counts once however often it is copied, so that the words of a
    widely copied passage do not pass for insults.
    """
    clause = F.explode(F.array_distinct(F.split(F.lower("text"), r"[.!?;:\n]+"))).alias("clause")
    clauses = sample.select("toxic", clause).filter("clause RLIKE '[^ ]'")
    sizes = clauses.groupBy("clause").agg(F.max("toxic").alias("toxic"))
    total, toxic = sizes.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return {}
    # in every clause of a toxic text a word gets the text's label
    words = sizes.select("toxic", F.explode(F.array_distinct(F.split("clause", r"[^\p{L}']+"))).alias("word"))
    counts = words.filter("word != ''").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    good = F.col("n") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((good + 0.5) / (total - toxic + 1.0))
    found = counts.withColumn("odds", odds).filter((F.col("bad") >= LEAST_CLAUSES) & (F.col("odds") >= LEAST_ODDS))
    best = found.orderBy(F.desc("odds"), "word").limit(LEXICON).collect()  # at most LEXICON rows
    return {row.word: min(row.odds, 10.0) for row in best if row.word not in TARGETS | NEGATIONS | REPORTS}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(weights of insults, coefficients of the curve) from a bounded sample of labelled rows."""
    sample = saved(labelled_sample(docs, labels, id_col, text_col, label_col, SAMPLE), "toxicity-sample")
    if (n := sample.count()) > SAMPLE:  # ids that repeat: equal texts count once, and a hash chooses among the rest
        hashed = F.pmod(F.xxhash64("text", "toxic"), F.lit(1 << 30))
        kept = sample.withColumn("hash", hashed).groupBy("hash", "toxic").agg(F.first("text").alias("text"))
        n = kept.count()
        sample = saved(kept.filter(F.col("hash") < int(min(1.0, 0.95 * SAMPLE / n) * (1 << 30))).drop("hash").limit(SAMPLE), "toxicity-rows")
    insults = learn_insults(sample)
    fields = [T.StructField("top", T.DoubleType()), T.StructField("total", T.DoubleType())]

    def make():
        def judge(batch):
            found = [features(t, insults) for t in batch]
            return [f[0] for f in found], [f[1] for f in found]

        return judge

    rows = map_texts(sample.withColumnRenamed("toxic", "id"), make, fields).collect()  # at most SAMPLE rows
    if not rows:
        return {}, np.array([-4.0, 1.0, 1.0])
    y, top, total = (np.array([row[k] for row in rows], float) for k in range(3))
    return insults, logistic(np.column_stack([np.ones(len(y)), *squashed(top, total)]), y)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(id, held_out, score, predicted) of every row; only texts enter a score.

    A NULL text counts as empty and scores what a text without any match
    scores.  Rows without an id are scored, count as not held out and never
    serve to learn; repeated rows score alike.  An id labelled both ways counts
    as toxic.  Without labels no word is an insult, and only threats count.
    """
    insults, beta = fit(docs, labels, id_col, text_col, label_col)

    def make():
        def judge(batch):
            found = np.array([features(t, insults) for t in batch], float).reshape(-1, 2)
            z = beta[0] + np.column_stack(squashed(found[:, 0], found[:, 1])) @ beta[1:]
            return [(1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()]

        return judge

    scored = map_texts(texts(docs, id_col, text_col), make, [T.StructField("score", T.DoubleType())])
    held_out = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return scored.select("id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")
