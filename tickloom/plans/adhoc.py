"""Ad-hoc SQL over a frame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..operators.filters import for_symbol

VIEW = "df"


def sql(
    frame: DataFrame,
    query: str,
    symbol: str | None = None,
    name: str = VIEW,
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Run a query over a frame under the view name ``df``, optionally of one symbol.

    The view is a plan, not data: filters, columns and partition predicates of
    the query reach the scan.  It is dropped once the query is resolved.  Pass
    values as ``args`` (``:name`` in the text), not in the text.
    """
    rows = frame if symbol is None else for_symbol(frame, symbol)
    spark = frame.sparkSession
    rows.createOrReplaceTempView(name)
    try:
        return spark.sql(query, args=dict(args) if args else None)
    finally:
        spark.catalog.dropTempView(name)
