"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(table):
    names = sorted(table.column_names)
    table = table.select(names)
    types = {}
    for field in table.schema:
        kind = field.type
        if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
            kind = pa.string()
        types[field.name] = str(kind)
    rows = sorted(zip(*(table[name].to_pylist() for name in names)), key=repr)
    return types, rows


def difference(result, sql, db):
    """None if equal, else a short description."""
    got_types, got = _plain(result.toArrow())
    want_types, want = _plain(db.sql(sql).to_arrow_table())
    if got_types != want_types:
        return f"schema: {got_types} / {want_types}"
    if len(got) != len(want):
        return f"rows: {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"values: {a} / {b}"
    return None
