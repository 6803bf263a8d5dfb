"""Decoded raw records, their files, and symbol allow-lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_symbols
from ..schema import FAMILY_PAYLOADS, PAYLOADS, RAW

RAW_FILES = "*.mbo.parquet"

# A raw file is one Parquet file, or a folder of part files, of that name.
_RAW_NAME = r"([^/]+\.mbo\.parquet)(/[^/]+)?$"
_RAW_PATH = r"^(.*/[^/]+\.mbo\.parquet)(/[^/]+)?$"


def raw_columns(payloads: bool = False) -> T.StructType:
    """Columns stored in raw files; ``source_file`` is the name of the file itself."""
    common = [field for field in RAW.fields if field.name != "source_file"]
    return T.StructType(common + (PAYLOADS.fields if payloads else []))


def with_source_file(rows: DataFrame, payloads: bool = False) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), _RAW_NAME, 1)
    return rows.select(name.alias("source_file"), *raw_columns(payloads).fieldNames())


def read_raw(spark: SparkSession, folder: str, ignore_corrupt: bool = False, payloads: bool = False) -> DataFrame:
    """Decoded records of the raw files directly in a folder."""
    return read_raw_files(spark, [f"{folder.rstrip('/')}/{RAW_FILES}"], ignore_corrupt, payloads)


def read_raw_files(
    spark: SparkSession, paths: list[str], ignore_corrupt: bool = False, payloads: bool = False
) -> DataFrame:
    """Decoded records of given raw files, with ``payloads`` whole ones (see ``schema.PAYLOADS``).

    A file without a payload's column has it as NULL, as has a record of another
    family, whatever its decoder put there.
    """
    reader = spark.read.schema(raw_columns(payloads)).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    rows = with_source_file(reader.parquet(*paths), payloads)
    if not payloads:
        return rows
    own = {name: F.when(F.col("rtype").isin(*of), F.col(name)) for name, of in FAMILY_PAYLOADS.items()}
    return rows.withColumns(own)


def record_json(rows: DataFrame) -> DataFrame:
    """Each record as a JSON object, under ``value``: what its family has, and no more."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names and paths of the raw files directly in a folder, in name order.

    Only the listing is used; no content is read.
    """
    listed = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{RAW_FILES}")
    return (
        listed.select(
            F.regexp_extract("path", _RAW_NAME, 1).alias("file_name"),
            F.regexp_extract("path", _RAW_PATH, 1).alias("path"),
        )
        .distinct()
        .orderBy("file_name")
    )


def clean_allowlist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct symbols of allow-list lines: trimmed, upper-cased, no comments."""
    return lines.select(clean_symbols(F.col(column)).alias("symbol")).where(F.col("symbol").isNotNull()).distinct()


def read_allowlist(spark: SparkSession, path: str) -> DataFrame | None:
    """Allow-list of a text file; None, for no filter, if it is missing or empty."""
    try:
        symbols = clean_allowlist(spark.read.text(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if symbols.isEmpty() else symbols
