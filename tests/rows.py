"""Inline ticks for micro-tests."""

from tickloom.functions import clock
from tickloom.schema import RAW, SYMBOL_MAP, TICK

DEFAULTS = {
    "ts_event_ns": 0,
    "symbol": "AA",
    "instrument_id": 1,
    "order_id": 0,
    "price_raw": 1_000_000_000,
    "price": 1.0,
    "size": 1,
    "flags": 0,
    "channel_id": 0,
    "action": "T",
    "side": "B",
    "ts_recv_ns": 0,
    "ts_in_delta": 0,
    "sequence": 0,
}


def ticks(spark, *rows):
    """Ticks from dicts; ``at`` is a time text for ts_event_ns."""
    full = []
    for row in rows:
        row = dict(row)
        if "at" in row:
            row["ts_event_ns"] = clock.as_ns(row.pop("at"))
        full.append({**DEFAULTS, **row})
    return spark.createDataFrame([tuple(r[f] for f in TICK.fieldNames()) for r in full], TICK)


def raw(spark, *rows):
    base = {
        "source_file": "f",
        "rtype": "mbo",
        "action_code": 84,
        "side_code": 66,
        **{k: v for k, v in DEFAULTS.items() if k not in ("symbol", "price", "action", "side")},
    }
    full = [{**base, **row} for row in rows]
    return spark.createDataFrame([tuple(r[f] for f in RAW.fieldNames()) for r in full], RAW)


def symbol_map(spark, *rows):
    return spark.createDataFrame(list(rows), SYMBOL_MAP)


def values(frame, *columns):
    return [tuple(row) for row in frame.select(*columns).collect()] if columns else [tuple(r) for r in frame.collect()]
