"""Language by compression: the language whose dictionary makes a text smallest.

For each language the model keeps passages of labelled texts as a raw zstandard
dictionary.  A text is cut into blocks, so that a long one is measured against
the dictionaries all the way and not against its own beginning; each block is
compressed with every dictionary, and the bytes of all blocks are added.  The
smallest sum wins.  Where the runner-up needs hardly more, the text is rejected.

The model is a bounded sample: of at most MOST_LANGUAGES languages (the most
frequent ones) at most ROWS labelled texts each, cut into passages of which at
most DICTIONARY bytes are kept, spread over all the sampled texts.  It is sent
to all tasks once and every text is judged, whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_texts, saved, table, texts

MOST_LANGUAGES = 128
ROWS = 400  # labelled texts of a language
DICTIONARY = 1 << 17  # bytes of a dictionary
PASSAGE = 256  # characters
BLOCK = 2048  # characters of a text that are compressed together
LEVEL = 9

#: A runner-up within this share of the smallest size, or within so many bytes, is too close.
MARGIN, LEAST_BYTES = 0.01, 2

#: What is predicted of a text without letters, and of a rejected one.
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages in order of their share of the labelled rows, and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]


def encoded(text: str) -> bytes:
    """What is compressed: the text in lower case, so that capitals match."""
    return text.lower().encode("utf-8", "replace")


def dictionary(passages: list[str]) -> bytes:
    """Passages joined, up to DICTIONARY bytes; which ones, and their order, a hash of each decides."""
    out, size = [], 0
    for data in sorted({encoded(p) + b"\n" for p in passages}, key=lambda d: (xxhash.xxh64_intdigest(d), d)):
        if size + len(data) > DICTIONARY:
            break
        out.append(data)
        size += len(data)
    return b"".join(out)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of labelled rows; rows without a language, a text or a letter are left out, equal texts count once.

    Rows are chosen by a hash of their text: first so many that about twice ROWS
    of a language remain, then, of the distinct ones, the ROWS with the smallest
    hash.  The driver gets at most ROWS texts of MOST_LANGUAGES languages.
    """
    rows = labelled.select(column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    found = rows.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n"))
    found = found.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return Model([], [])
    spark = labelled.sparkSession
    bounds = [(lang, (1 << 40) if n <= 2 * ROWS else int((1 << 40) * 2 * ROWS / n)) for lang, n in found]
    bounds = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    some = rows.withColumn("hash", hashed).join(bounds, "lang").filter(F.col("hash") < F.col("bound"))
    some = saved(some.groupBy("lang", "hash").agg(F.first("text").alias("text")), "language-sample")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    some = some.withColumn("place", first).filter(F.col("place") <= ROWS).select("lang", "text")
    # of each text as many passages at most, so that long ones do not fill the dictionary
    passages: dict[str, list[str]] = {lang: [] for lang, _ in found}
    most = 8 * DICTIONARY // (PASSAGE * ROWS) + 1
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))
    spread = F.expr(f"slice(array_sort(transform(pieces, p -> struct(xxhash64(p) AS h, p AS p))), 1, {most})")
    some = some.select("lang", pieces.alias("pieces")).select("lang", F.explode(spread).alias("piece"))
    for lang, piece in some.select("lang", "piece.p").collect():
        passages[lang].append(piece)
    return Model([lang for lang, _ in found], [dictionary(passages[lang]) for lang, _ in found])


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


class Judge:
    def __init__(self, model: Model):
        self.languages = model.languages
        self.encoders = []
        for data in model.dictionaries:
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **options))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text under each language; equal blocks are compressed once."""
        blocks: dict[bytes, int] = {}
        for at in range(0, len(text), BLOCK):
            data = encoded(text[at : at + BLOCK])
            blocks[data] = blocks.get(data, 0) + 1
        return [sum(n * len(encoder.compress(data)) for data, n in blocks.items()) for encoder in self.encoders]

    def __call__(self, text: str) -> tuple[str, float, bool]:
        """(language, score, accepted): score falls from 1 as other languages need hardly more bytes."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        others = [size for k, size in enumerate(sizes) if k != best]
        score = 1 / (1 + sum(math.exp2(-min(size - sizes[best], 1000)) for size in others))
        ahead = min(others, default=math.inf) - sizes[best]
        return self.languages[best], score, ahead >= max(LEAST_BYTES, MARGIN * sizes[best])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row.

    lang_pred   the language of the smallest size; of equal ones the more frequent
    score       0 to 1: one over the sum of 2 ** -(bytes more than the smallest)
    accepted    whether the runner-up is clearly larger; a caller that wants no
                guesses takes UNKNOWN for the others

    A NULL text, one without letters, and any text under an empty model are
    UNKNOWN with score 0, not accepted.  Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]

    def make():
        judge = Judge(shared.value)

        def judged(batch: list[str]) -> list:
            return list(zip(*map(judge, batch)))

        return judged

    return map_texts(texts(docs, id_col, text_col), make, fields)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of five; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = predict(docs, model)
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")
