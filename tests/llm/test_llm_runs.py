"""Texts that are one long run: no operator may fail on a document, or drop it."""

import time

import corpus_pipeline
import public_tokenizers
import pytest
from llm_fixtures import SF, benchmark, labels, no_rows, odd  # noqa: F401
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, languages, licenses, quality, secrets, simhash, spelling, toxicity

LENGTH = 1_000_000
RUNS = [" " * LENGTH, "\n" * LENGTH, "a" * LENGTH, "7" * LENGTH, "-" * LENGTH, "é́" * (LENGTH // 2), "x " * (LENGTH // 2)]


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(k, text, "xx", "a") for k, text in enumerate(RUNS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)


WAYS = {
    "secrets": lambda docs, labels, benchmark: secrets.scan_secrets(docs),
    "redact": lambda docs, labels, benchmark: secrets.redact(docs),
    "quality": lambda docs, labels, benchmark: quality.quality_rules(docs, labels),
    "simhash": lambda docs, labels, benchmark: simhash.near_duplicates(docs),
    "toxicity": lambda docs, labels, benchmark: toxicity.toxicity(docs, labels),
    "bpe": lambda docs, labels, benchmark: bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")),
    "licenses": lambda docs, labels, benchmark: licenses.scan_licenses(docs),
    "languages": lambda docs, labels, benchmark: languages.predict(docs, languages.fit(docs)),
    "clean": lambda docs, labels, benchmark: decontam.keep_clean(docs, benchmark),
}


@pytest.mark.parametrize("name", sorted(WAYS))
def test_runs_of_one_character(runs, labels, benchmark, name):
    start = time.monotonic()
    assert WAYS[name](runs, labels, benchmark).count() == len(RUNS)
    assert time.monotonic() - start < 120


def test_words_of_a_million_letters(runs):
    found = {r.word[0]: r for r in spelling.document_variants(runs.union(runs)).collect()}
    assert {len(r.word) for r in found.values()} <= {LENGTH, LENGTH - 1} and found["a"].n == 2


def test_every_stage_takes_odd_rows_and_no_rows(spark, odd, no_rows):
    """Rows are produced, not only planned; the empty table stays empty to the end."""
    for docs in (odd, no_rows):
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, SF)
            assert len(kept.collect()) <= docs.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, no_rows, SF)
    assert rows.count() == 0 and {"ids", "n_tokens", "ids_sha256"} <= set(rows.columns)
    kept = corpus_pipeline.STAGES[3][1](spark, odd, SF)
    assert kept.where(F.col("doc_id") == 2).count() == 2
