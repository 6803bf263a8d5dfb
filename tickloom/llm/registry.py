"""Named queries of the text operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe
from .decontam import op7_decontamination
from .languages import op13_languages
from .lengths import op4_lengths
from .licenses import OP10_SQL, op10_licenses
from .prefixes import OP12_SQL, op12_prefixes
from .quality import op5_quality
from .secrets import OP1_SQL, op1_secrets
from .shards import op3_shards
from .simhash import op6_simhash
from .spelling import OP11_SQL, op11_spelling
from .toxicity import op8_toxicity
from .urls import OP2_SQL, op2_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_urls": op2_urls,
    "op3_shards": op3_shards,
    "op4_lengths": op4_lengths,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_spelling": op11_spelling,
    "op12_prefixes": op12_prefixes,
    "op13_languages": op13_languages,
}

ORACLES: dict[str, str] = {"op1_secrets": OP1_SQL, "op2_urls": OP2_SQL, "op10_licenses": OP10_SQL, "op11_spelling": OP11_SQL, "op12_prefixes": OP12_SQL}
