"""A training corpus from raw documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept:

1. quality: documents that fail the quality rules go;
2. near_duplicates: of each group of near-duplicates one document stays;
3. decontamination: documents that hold a benchmark passage go;
4. secrets: live credentials are blanked out of the texts, copied examples stay;
5. tokens: each text becomes token ids, with the columns doc_id, source, lang,
   ids (little-endian unsigned 32-bit integers), n_tokens and ids_sha256.

All but the last return the columns of documents.  run() writes what each stage
returns to the cluster's shared folder and reads it again, so that a lost
executor never sets the work back by more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontam, quality, secrets, simhash
from tickloom.llm.common import saved, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, copies_once=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_rows(docs, bpe.tokenizer_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: SQL has neither the tokenizer nor XXH64; tests/llm compares run() with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": run}
