"""The same results as :mod:`tickloom.registry` in SQL, written for DuckDB.

Each text stands alone: it reads the driver's tables and derives the stand-in
views in common table expressions.
"""

from __future__ import annotations

import datetime as dt

# Arguments of the queries, and widths in nanoseconds.
SYMBOL, PART = "S00007", "P7"
START, END = "2024-01-05", "2024-01-20"
DAY, MID = "2024-01-09", "2024-01-15T12:00:00Z"
_SECOND, _MINUTE, _HOUR, _WHOLE_DAY = 1_000_000_000, 60_000_000_000, 3_600_000_000_000, 86_400_000_000_000
_WIDTHS = {
    "1s": _SECOND,
    "10s": 10 * _SECOND,
    "1m": _MINUTE,
    "5m": 5 * _MINUTE,
    "15m": 15 * _MINUTE,
    "1h": _HOUR,
    "1d": _WHOLE_DAY,
}

_COLUMNS = (
    "ts_event_ns, symbol, instrument_id, order_id, price_raw, price, size, flags, channel_id, "
    "action, side, ts_recv_ns, ts_in_delta, sequence"
)
_ORDER = "ts_event_ns, sequence, order_id, instrument_id, action, side, size, price"


def _symbol(prefix: str, column: str = "user_id") -> str:
    digits = f"CAST({column} AS VARCHAR)"
    return f"'{prefix}' || CASE WHEN length({digits}) < 5 THEN lpad({digits}, 5, '0') ELSE {digits} END"


_TICKS = f"""ticks AS (
  SELECT epoch_us(ts) * 1000 AS ts_event_ns,
         {_symbol("S")} AS symbol,
         user_id AS instrument_id,
         event_id AS order_id,
         CAST(round(value * 1e9) AS BIGINT) AS price_raw,
         value AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS size,
         CAST(event_id % 256 AS INTEGER) AS flags,
         CAST(user_id % 4 AS SMALLINT) AS channel_id,
         CASE event_type WHEN 'purchase' THEN 'T' WHEN 'view' THEN 'A' WHEN 'click' THEN 'M'
                         WHEN 'signup' THEN 'F' WHEN 'error' THEN 'C' END AS action,
         CASE user_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side,
         epoch_us(ts) * 1000 + (event_id % 1000) * 1000 AS ts_recv_ns,
         CAST(event_id % 1000 AS INTEGER) AS ts_in_delta,
         event_id AS sequence,
         ts
  FROM events)"""

_LINES = """lines AS (
  SELECT epoch_us(l_shipdate) * 1000 AS ts_event_ns,
         'P' || CAST(l_partkey AS VARCHAR) AS symbol,
         l_partkey AS instrument_id,
         l_orderkey AS order_id,
         CAST(round(l_extendedprice * 1e9) AS BIGINT) AS price_raw,
         l_extendedprice AS price,
         CAST(l_quantity AS INTEGER) AS size,
         0 AS flags,
         CAST(0 AS SMALLINT) AS channel_id,
         CASE WHEN l_returnflag = 'R' THEN 'T' ELSE 'A' END AS action,
         'N' AS side,
         epoch_us(l_shipdate) * 1000 AS ts_recv_ns,
         0 AS ts_in_delta,
         CAST(l_linenumber AS BIGINT) AS sequence
  FROM lineitem)"""

_RAW = f"""{_TICKS}, raw AS (
  SELECT 'feed-' || strftime(ts, '%Y%m%d') || '.mbo.parquet' AS source_file,
         CASE WHEN order_id % 10 = 0 THEN 'mbp1' WHEN order_id % 37 = 0 THEN 'status' ELSE 'mbo' END AS rtype,
         ts_event_ns, ts_recv_ns, instrument_id, order_id, price_raw, size, flags, channel_id,
         CASE WHEN order_id % 101 = 0 THEN 7 ELSE ascii(action) END AS action_code,
         CASE WHEN order_id % 101 = 0 THEN 7 ELSE ascii(side) END AS side_code,
         ts_in_delta, sequence
  FROM ticks)"""

_MAP = f"""users AS (SELECT DISTINCT user_id FROM events), symbol_map AS (
  SELECT user_id AS instrument_id, {_symbol("S")} AS symbol, DATE '2023-01-01' AS start_date,
         CASE WHEN user_id % 5 = 0 THEN DATE '2024-01-10' ELSE DATE '2026-01-01' END AS end_date
  FROM users WHERE user_id % 13 <> 0
  UNION ALL
  SELECT user_id, {_symbol("T")}, DATE '2024-01-10', DATE '2026-01-01'
  FROM users WHERE user_id % 13 <> 0 AND user_id % 5 = 0)"""

_ALLOWED = f"""allowlist AS (
  SELECT DISTINCT {_symbol("S")} AS symbol FROM events WHERE user_id % 2 = 0)"""

_MAPPED = f"""{_RAW}, {_MAP}, {_ALLOWED}, mapped AS (
  SELECT r.*, m.symbol, a.symbol IS NOT NULL AS keep
  FROM raw r
  LEFT JOIN symbol_map m ON r.instrument_id = m.instrument_id
       AND CAST(make_timestamp(r.ts_recv_ns // 1000) AS DATE) >= m.start_date
       AND CAST(make_timestamp(r.ts_recv_ns // 1000) AS DATE) < m.end_date
  LEFT JOIN allowlist a ON a.symbol = m.symbol)"""

_FILES = """days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), files AS (
  SELECT 'feed-' || strftime(day, '%Y%m%d') || '.mbo.parquet' AS file_name FROM days
  UNION SELECT 'feed-' || strftime(day + INTERVAL 20 DAY, '%Y%m%d') || '.mbo.parquet' FROM days
  UNION SELECT 'replay-' || strftime(day, '%m-%d') || '.mbo.parquet' FROM days)"""

_TEXTS = """texts AS (
  SELECT event_id,
         CASE event_id % 6
           WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || left(nanos, 6) || 'Z'
           WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || nanos || '+05:30'
           WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-08:00'
           WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
           WHEN 4 THEN strftime(ts, '%Y-%m-%d')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS text
  FROM (SELECT event_id, ts,
               lpad(CAST((epoch_us(ts) * 1000 + event_id % 1000) % 1000000000 AS VARCHAR), 9, '0') AS nanos
        FROM events)), parsed AS (
  SELECT event_id, text,
         regexp_matches(text, 'Z$|[+-][0-9]{2}:[0-9]{2}$') AND length(text) > 19 AS zoned,
         length(text) IN (10, 19) AND text NOT LIKE '%T%' AS plain,
         epoch_us(CAST(replace(left(text, 19), 'T', ' ') AS TIMESTAMP)) // 1000000
           - CASE WHEN text LIKE '%+05:30' THEN 19800 WHEN text LIKE '%-08:00' THEN -28800 ELSE 0 END AS seconds,
         CAST(rpad(regexp_extract(text, '[.]([0-9]+)', 1), 9, '0') AS BIGINT) AS nanos
  FROM texts)"""

_REQUESTS = """requests AS (
  SELECT event_id,
         CASE WHEN k > 80 THEN 'x' ELSE CAST(k AS VARCHAR) END
           || CASE event_id % 6 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'H' WHEN 3 THEN 'd'
                                WHEN 4 THEN 'S' ELSE 'M ' END AS text,
         CASE event_id % 9 WHEN 0 THEN '1s' WHEN 1 THEN '10s' WHEN 2 THEN '1m' WHEN 3 THEN '5m'
                           WHEN 4 THEN '15m' WHEN 5 THEN '1h' WHEN 6 THEN '1d' WHEN 7 THEN 'auto'
                           ELSE CAST(k AS VARCHAR) || 'm' END AS resolution,
         k
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def _ns(time: str) -> int:
    at = dt.datetime.fromisoformat(time.replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp()) * _SECOND


def _between(start: str, end: str) -> str:
    return f"ts_event_ns >= {_ns(start)} AND ts_event_ns < {_ns(end)}"


def _bars(
    width: int,
    source: str = "ticks",
    keys: str = "symbol, ",
    label: str = "ts",
    order: str = "{'t': ts_event_ns, 's': sequence}",
    count: str = "count(*)",
    where: str = "TRUE",
) -> str:
    start = f"(ts_event_ns // {width}) * {width}"
    shown = f"{start} // 1000000" if label == "ts" else f"make_timestamp({start} // 1000)"
    return f"""SELECT {keys}{shown} AS {label},
       arg_min_null(price, {order}) AS open, max(price) AS high, min(price) AS low,
       arg_max_null(price, {order}) AS close,
       CAST(sum(size) AS BIGINT) AS volume, {count} AS trades
FROM {source} WHERE action = 'T' AND {where} GROUP BY ALL"""


def _page(source: str, symbol: str, start: str, end: str, limit: int, offset: int) -> str:
    return f"""numbered AS (
  SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS n, count(*) OVER () AS total
  FROM {source} WHERE symbol = '{symbol}' AND {_between(start, end)})
SELECT ts_event_ns // 1000000 AS ts, ts_event_ns AS ts_ns, price, size, side, action, order_id,
       least(total - {offset}, {limit}) AS count, total > {offset + limit} AS has_more
FROM numbered WHERE n > {offset} AND n <= {offset + limit}"""


_SLOT = "strftime(make_timestamp((ts_event_ns // 900000000000) * 900000000), '%H-%M')"
_DATE = "CAST(make_timestamp(ts_event_ns // 1000) AS DATE)"
_RANGE = """make_timestamp(min(ts_event_ns) // 1000) AS start, make_timestamp(max(ts_event_ns) // 1000) AS "end",
       count(*) AS total_ticks"""
_MANIFEST = f"""{_TICKS}, manifest AS (
  SELECT {_DATE} AS date, {_SLOT} AS slot, count(*) AS cnt FROM ticks GROUP BY ALL)"""

_LINE = """'mbo_ticks,symbol=' || symbol || ',action=' || action || ',side=' || side
       || ' instrument_id=' || instrument_id || 'i,order_id=' || order_id || 'i,price_raw=' || price_raw
       || 'i,price=' || regexp_replace(CAST(price_raw / 1e9 AS VARCHAR), '[.]0$', '')
       || ',size=' || size || 'i,flags=' || flags || 'i,channel_id=' || channel_id
       || 'i,ts_in_delta=' || ts_in_delta || 'i,sequence=' || sequence
       || 'i,ts_recv=' || ts_recv_ns || 'i ' || ts_event_ns"""


def _line_batches(file: str, max_bytes: int, max_rows: int) -> str:
    """Batches one after another, each from the end of the one before."""
    return f"""WITH RECURSIVE {_TICKS}, sized AS (
  SELECT {file} AS file, {_LINE} AS value, ts_event_ns, sequence FROM ticks),
running AS (
  SELECT file, value,
         row_number() OVER (PARTITION BY file ORDER BY ts_event_ns, sequence) AS place,
         sum(octet_length(encode(value)) + 1) OVER (PARTITION BY file ORDER BY ts_event_ns, sequence) AS upto
  FROM sized),
ends AS (
  SELECT DISTINCT file, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place, CAST(0 AS HUGEINT) AS upto FROM running
  UNION ALL
  SELECT e.file, e.batch + 1, min(r.place), min(r.upto)
  FROM ends e JOIN running r ON r.file = e.file AND r.place > e.place
  WHERE r.upto - e.upto >= {max_bytes} OR r.place - e.place >= {max_rows}
  GROUP BY e.file, e.batch),
placed AS (
  SELECT r.*, e.batch FROM running r ASOF JOIN ends e ON r.file = e.file AND r.place > e.place)
SELECT file, batch, count(*) AS rows, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes,
       md5(string_agg(value || chr(10), '' ORDER BY place)) AS text_md5
FROM placed GROUP BY file, batch"""


ORACLES: dict[str, str] = {
    "scan_ticks": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks",
    "scan_by_date": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE CAST(ts AS DATE) = DATE '{DAY}'",
    "scan_by_date_range": f"""WITH {_TICKS} SELECT CAST(ts AS DATE) AS date, {_COLUMNS} FROM ticks
WHERE ts >= DATE '2024-01-25' AND ts < DATE '2024-03-01'""",
    "scan_symbol_preferred": f"""WITH {_TICKS} SELECT {_DATE} AS date, {_SLOT} AS slot,
       ts_event_ns, symbol, instrument_id, order_id, price_raw, price, size,
       CASE WHEN ts >= DATE '2024-01-07' AND ts < DATE '2024-01-12' THEN 999 ELSE flags END AS flags,
       channel_id, action, side, ts_recv_ns, ts_in_delta, sequence
FROM ticks WHERE symbol = '{SYMBOL}' AND {_between(START, END)}""",
    "slice_ticks": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE {_between(START, END)}",
    "slice_ticks_symbol": f"""WITH {_TICKS} SELECT {_COLUMNS} FROM ticks
WHERE symbol = '{SYMBOL}' AND {_between(START, END)}""",
    "union_days": f"""WITH {_TICKS}, {_LINES} SELECT {_COLUMNS} FROM ticks
UNION ALL SELECT {_COLUMNS} FROM lines""",
    "raw_mbo_only": f"WITH {_RAW} SELECT * FROM raw WHERE rtype = 'mbo'",
    "raw_range_read": f"""WITH {_RAW} SELECT * FROM raw WHERE rtype <> 'status'
AND ts_event_ns BETWEEN {_ns("2024-01-10T06:00:00Z")} AND {_ns("2024-01-10T18:00:00Z")}""",
    "load_allowlist": f"WITH {_ALLOWED} SELECT symbol FROM allowlist",
    "filter_symbol": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE symbol = '{SYMBOL}'",
    "filter_trades": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE action = 'T'",
    "filter_time_range": f"""WITH {_TICKS} SELECT {_COLUMNS} FROM ticks
WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
    "ticks_page": f"WITH {_TICKS}, {_page('ticks', SYMBOL, START, END, 20, 0)}",
    "ticks_page_offset": f"WITH {_TICKS}, {_page('ticks', SYMBOL, START, END, 10, 5)}",
    "ticks_page_ties": f"WITH {_LINES}, {_page('lines', PART, '1990-01-01', '2010-01-01', 5, 10)}",
    "ticks_page_deep": f"WITH {_LINES}, {_page('lines', PART, '1990-01-01', '2010-01-01', 5, 10)}",
    "ticks_page_after": f"WITH {_LINES}, {_page('lines', PART, '1990-01-01', '2010-01-01', 5, 10)}",
    "page_summary": f"""WITH {_TICKS} SELECT least(count(*), 10) AS count, count(*) > 10 AS has_more
FROM ticks WHERE symbol = '{SYMBOL}' AND {_between(START, END)}""",
    "head_n": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks ORDER BY {_ORDER} LIMIT 20",
    "latest_n": f"""WITH {_TICKS} SELECT {_COLUMNS} FROM ticks
WHERE symbol = '{SYMBOL}' AND ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY
ORDER BY ts_event_ns DESC, sequence DESC LIMIT 20""",
    **{
        f"bars_{name}": f"WITH {_TICKS} {_bars(width)}" for name, width in _WIDTHS.items()
    },
    "bars_1d_ties": f"""WITH {_LINES} {_bars(
        _WHOLE_DAY, "lines", order="{'t': ts_event_ns, 'o': order_id, 'l': sequence, 'p': price}")}""",
    # 15 days are more than a week, hence daily bars
    "bars_auto": f"""WITH {_TICKS} {_bars(
        _WHOLE_DAY, keys="", where=f"symbol = '{SYMBOL}' AND {_between(START, END)}")}""",
    "bars_for_5m": f"""WITH {_TICKS} {_bars(
        5 * _MINUTE, keys="", where=f"symbol = '{SYMBOL}' AND {_between(START, END)}")}""",
    "bars_all_symbols": f"""WITH {_TICKS} {_bars(
        _HOUR, keys="", label="datetime", count="count(price)")}""",
    "bars_interval_7m": f"""WITH {_TICKS} {_bars(
        7 * _MINUTE, keys="", label="datetime", count="count(price)")}""",
    "bars_defaults": f"""WITH {_TICKS}, gaps AS (
  SELECT * REPLACE (CASE WHEN price > 20 THEN price END AS price) FROM ticks), series AS (
{_bars(_WHOLE_DAY, "gaps", count="count(price)")})
SELECT symbol, ts, coalesce(open, 0) AS open, coalesce(high, 0) AS high, coalesce(low, 0) AS low,
       coalesce(close, 0) AS close, coalesce(volume, 0) AS volume, trades FROM series""",
    "symbols": f"WITH {_TICKS} SELECT DISTINCT symbol FROM ticks",
    "data_range": f"WITH {_TICKS} SELECT {_RANGE} FROM ticks WHERE symbol = '{SYMBOL}'",
    "data_range_missing": f"WITH {_TICKS} SELECT {_RANGE} FROM ticks WHERE symbol = 'NVDA'",
    "data_range_all": f"WITH {_TICKS} SELECT symbol, {_RANGE} FROM ticks GROUP BY symbol",
    "count_by_date": "SELECT CAST(ts AS DATE) AS date, count(*) AS cnt FROM events GROUP BY ALL",
    "count_by_date_hour": """SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS cnt
FROM events GROUP BY ALL""",
    "count_symbol_between": f"""WITH {_TICKS} SELECT count(*) AS cnt FROM ticks
WHERE symbol = '{SYMBOL}' AND ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-16'""",
    "count_by_symbol": f"WITH {_TICKS} SELECT symbol, count(*) AS cnt FROM ticks GROUP BY symbol",
    "sql_count_by_symbol": f"WITH {_TICKS} SELECT symbol, count(*) AS cnt FROM ticks GROUP BY symbol",
    "sql_filtered_view": f"""WITH {_TICKS} SELECT {_DATE} AS date, action, count(*) AS cnt, max(price) AS high
FROM ticks WHERE symbol = '{SYMBOL}' AND {_between(START, END)} GROUP BY ALL""",
    "map_symbols": f"""WITH {_MAPPED} SELECT source_file, rtype, ts_event_ns, instrument_id, order_id, symbol
FROM mapped WHERE symbol IS NOT NULL""",
    "allowlist_semi": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE instrument_id % 2 = 0",
    "allowlist_anti": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE instrument_id % 2 = 1",
    "normalize_ticks": f"""WITH {_MAPPED} SELECT ts_event_ns, symbol, instrument_id, order_id, price_raw,
       price_raw / 1e9 AS price, size, flags, channel_id,
       CASE WHEN action_code BETWEEN 33 AND 126 THEN chr(action_code) ELSE '_' END AS action,
       CASE WHEN side_code BETWEEN 33 AND 126 THEN chr(side_code) ELSE '_' END AS side,
       ts_recv_ns, ts_in_delta, sequence
FROM mapped WHERE rtype = 'mbo' AND keep""",
    "ingest_summary": f"""WITH {_MAPPED} SELECT source_file,
       count(*) FILTER (WHERE rtype = 'mbo' AND symbol IS NOT NULL AND keep) AS rows_kept,
       count(*) FILTER (WHERE rtype = 'mbo' AND symbol IS NOT NULL AND NOT keep) AS rows_skipped
FROM mapped GROUP BY source_file""",
    "ingest_totals": f"""WITH {_MAPPED} SELECT
       count(*) FILTER (WHERE rtype = 'mbo' AND symbol IS NOT NULL AND keep) AS total_rows,
       count(*) FILTER (WHERE rtype = 'mbo' AND symbol IS NOT NULL AND NOT keep) AS total_skipped,
       count(DISTINCT source_file) AS files
FROM mapped""",
    "pending_files": f"""WITH {_FILES} SELECT file_name FROM files
WHERE file_name NOT IN (SELECT 'feed-' || strftime(ts, '%Y%m%d') || '.mbo.parquet' FROM events)""",
    "export_roundtrip": f"WITH {_TICKS} SELECT {_DATE} AS date, {_SLOT} AS slot, {_COLUMNS} FROM ticks",
    "export_roundtrip_symbol": f"""WITH {_TICKS} SELECT {_DATE} AS date, {_SLOT} AS slot,
       ts_event_ns, symbol, instrument_id, order_id, price_raw, price, size, 999 AS flags,
       channel_id, action, side, ts_recv_ns, ts_in_delta, sequence
FROM ticks WHERE symbol = '{SYMBOL}' AND {_between("2024-01-07", "2024-01-12")}""",
    "export_manifest": f"""WITH {_MANIFEST} SELECT date, slot, cnt,
       1::BIGINT AS n_files, 'mbo_' || CAST(date AS VARCHAR) || '_' || slot || '.parquet' AS file_name FROM manifest""",
    "export_totals": f"""WITH {_MANIFEST} SELECT CAST(sum(cnt) AS BIGINT) AS total_rows, count(*) AS total_files
FROM manifest""",
    "line_protocol": f"WITH {_TICKS} SELECT {_LINE} AS value FROM ticks",
    "line_batches": _line_batches("'events'", 3_000_000, 50_000),
    "line_batches_daily": _line_batches("CAST(CAST(ts AS DATE) AS VARCHAR)", 4_000, 21),
    "to_epoch_ns": f"""WITH {_TEXTS} SELECT event_id,
       CASE WHEN zoned OR plain THEN seconds * 1000000000 + coalesce(nanos, 0) END AS timestamp_ns,
       CASE WHEN zoned OR plain
            THEN strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' END AS datetime_utc
FROM parsed""",
    "from_epoch_ns": """SELECT event_id AS order_id, epoch_us(ts) * 1000 + event_id % 1000 AS timestamp_ns,
       strftime(ts, '%Y-%m-%d %H:%M:%S.')
         || lpad(CAST((epoch_us(ts) * 1000 + event_id % 1000) % 1000000000 AS VARCHAR), 9, '0')
         || ' UTC' AS datetime_utc
FROM events""",
    "to_epoch_ms": f"""WITH {_TEXTS} SELECT event_id,
       CASE WHEN zoned THEN seconds * 1000 + coalesce(nanos, 0) // 1000000 ELSE 0 END AS ts
FROM parsed""",
    "range_duration_ms": f"""WITH {_TEXTS} SELECT event_id,
       abs({_ns(MID) // 1_000_000}
           - CASE WHEN zoned OR plain THEN seconds * 1000 + coalesce(nanos, 0) // 1000000 ELSE 0 END) AS duration_ms
FROM parsed""",
    "auto_resolution": f"""WITH {_TICKS}, spans AS (
  SELECT order_id, (abs(ts_event_ns - {_ns(MID)}) // 1000000) // (size * size + 1) AS duration_ms FROM ticks)
SELECT order_id, duration_ms,
       CASE WHEN duration_ms > 7 * 24 * 3600 * 1000 THEN '1d' WHEN duration_ms > 24 * 3600 * 1000 THEN '1h'
            WHEN duration_ms > 4 * 3600 * 1000 THEN '15m' WHEN duration_ms > 3600 * 1000 THEN '5m'
            WHEN duration_ms > 15 * 60 * 1000 THEN '1m' WHEN duration_ms > 5 * 60 * 1000 THEN '10s'
            ELSE '1s' END AS resolution
FROM spans""",
    "normalize_resolution": f"""WITH {_REQUESTS} SELECT event_id,
       CASE WHEN resolution IN ('1s', '10s', '1m', '5m', '15m', '1h', '1d') THEN resolution ELSE '1m' END
         AS resolution
FROM requests""",
    "parse_interval": f"""WITH {_REQUESTS} SELECT event_id, text,
       CASE WHEN event_id % 6 = 3 THEN '1m'
            WHEN k > 80 THEN '1' || lower(trim(substr(text, 2)))
            WHEN k > 0 THEN lower(trim(text)) END AS interval
FROM requests""",
    "ns_to_ms": "SELECT event_id AS order_id, date_trunc('millisecond', ts) AS datetime FROM events",
    "scale_price": f"""WITH {_TICKS}, prices AS (
  SELECT order_id, price_raw + order_id % 1000 AS p FROM ticks)
SELECT order_id, p / 1e9 AS price,
       CAST(CAST(p AS DECIMAL(19, 0)) * CAST(0.000000001 AS DECIMAL(9, 9)) AS DECIMAL(28, 9)) AS price_exact,
       rtrim(rtrim((p // 1000000000) || '.' || lpad(CAST(p % 1000000000 AS VARCHAR), 9, '0'), '0'), '.')
         AS price_text
FROM prices""",
    "ascii_code": """SELECT event_id AS order_id,
       CASE WHEN event_id % 256 - 128 BETWEEN 33 AND 126 THEN chr(CAST(event_id % 256 - 128 AS INTEGER))
            ELSE '_' END AS code
FROM events""",
    "escape_tag": r"""SELECT event_id,
       replace(replace(replace(event_type || ',' || props || ',a=b', ',', '\,'), ' ', '\ '), '=', '\=') AS tag
FROM events""",
    "date_from_filename": f"""WITH {_FILES} SELECT file_name,
       CASE WHEN file_name LIKE 'feed-%'
            THEN substr(file_name, 6, 4) || '-' || substr(file_name, 10, 2) || '-' || substr(file_name, 12, 2) END
         AS date_text
FROM files""",
    "date_series": f"""WITH {_TICKS}, spans AS (
  SELECT symbol, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM ticks GROUP BY symbol)
SELECT symbol, CAST(unnest(range(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans""",
    "slot_series": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), starts AS (
  SELECT date, unnest(range(96)) * 900000000000 + epoch_us(CAST(date AS TIMESTAMP)) * 1000 AS start_ns FROM days)
SELECT date, strftime(make_timestamp(start_ns // 1000), '%H-%M') AS slot, start_ns,
       start_ns + 900000000000 AS end_ns
FROM starts""",
    "slot_filename": f"""WITH {_TICKS} SELECT DISTINCT symbol,
       'mbo_' || symbol || '_' || CAST({_DATE} AS VARCHAR) || '_' || {_SLOT} || '.parquet' AS file_name
FROM ticks""",
}

# The same results from the loaded table, and loads that must not lose or double rows.
ORACLES |= {
    "table_hourly": f"WITH {_TICKS} SELECT {_DATE} AS date, CAST(hour(ts) AS INTEGER) AS hour, {_COLUMNS} FROM ticks",
    "table_bars_1h": ORACLES["bars_1h"],
    "table_bars_auto": ORACLES["bars_auto"],
    "table_merged_bars": ORACLES["bars_all_symbols"],
    "table_page": ORACLES["ticks_page_offset"],
    "table_range": ORACLES["data_range"],
    "table_count_by_date": ORACLES["count_by_date"],
    "table_trades": ORACLES["filter_trades"],
    "pending_in_table": ORACLES["pending_files"],
    "filter_one_hour": f"""WITH {_TICKS} SELECT {_DATE} AS date, CAST(hour(ts) AS INTEGER) AS hour, {_COLUMNS}
FROM ticks WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-10 07:00:00'""",
    "export_one_slot": f"""WITH {_TICKS} SELECT {_DATE} AS date, {_SLOT} AS slot, {_COLUMNS}
FROM ticks WHERE ts >= TIMESTAMP '2024-01-10 06:15:00' AND ts < TIMESTAMP '2024-01-10 06:30:00'""",
    "sql_count_between": ORACLES["count_symbol_between"],
    "sql_latest": f"""WITH {_TICKS} SELECT symbol, action, price, ts AS ts_event, make_timestamp(ts_recv_ns // 1000) AS ts_recv
FROM ticks WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "map_symbols_overlap": ORACLES["map_symbols"],
    "map_symbols_extended": ORACLES["map_symbols"],
    "export_partial_slot": f"""WITH {_TICKS} SELECT {_DATE} AS date, {_SLOT} AS slot,
       {_COLUMNS.replace(" flags,", f" CASE WHEN {_between(f'{DAY}T10:05:00Z', f'{DAY}T13:20:00Z')} THEN 999 ELSE flags END AS flags,")}
FROM ticks WHERE {_between(DAY, '2024-01-11')}""",
    "raw_range_payloads": f"""WITH {_RAW}, families AS (
  SELECT * REPLACE ('feed.mbo.parquet' AS source_file,
         CASE order_id % 10 WHEN 0 THEN 'mbp1' WHEN 1 THEN 'mbp0' WHEN 2 THEN 'mbp10' WHEN 3 THEN 'ohlcv_1s'
              WHEN 4 THEN 'ohlcv_1d' WHEN 5 THEN 'ohlcv_eod' WHEN 6 THEN 'instrument_def' WHEN 7 THEN 'status'
              ELSE 'mbo' END AS rtype)
  FROM raw),
books AS (SELECT *, CASE rtype WHEN 'mbp1' THEN 1 WHEN 'mbp10' THEN 10 END AS n,
                 rtype LIKE 'ohlcv%' AS is_bar, rtype = 'instrument_def' AS is_definition
          FROM families)
SELECT source_file, rtype, ts_event_ns, order_id, price_raw,
       CASE WHEN rtype LIKE 'mbp%' THEN CAST(order_id % 7 AS INTEGER) END AS depth,
       CAST(n AS INTEGER) AS n_levels,
       CASE WHEN n > 0 THEN price_raw - 10000000 END AS best_bid,
       CASE WHEN n > 0 THEN price_raw + 10000001 END AS best_ask,
       CASE WHEN n > 0 THEN price_raw + n * 10000000 + 1 END AS last_ask,
       CASE WHEN n > 0 THEN CAST(size AS BIGINT) + n END AS last_size,
       CASE WHEN is_bar THEN price_raw END AS open,
       CASE WHEN is_bar THEN price_raw + size END AS high,
       CASE WHEN is_bar THEN price_raw - size END AS low,
       CASE WHEN is_bar THEN price_raw + 1 END AS close,
       CASE WHEN is_bar THEN CAST(size AS BIGINT) END AS volume,
       CASE WHEN is_definition THEN {_symbol("S", "instrument_id")} END AS raw_symbol,
       CASE WHEN is_definition THEN CAST(size AS BIGINT) END AS min_price_increment
FROM books
WHERE rtype <> 'status' AND ts_event_ns BETWEEN {_ns("2024-01-10T06:00:00Z")} AND {_ns("2024-01-12T18:00:00Z")}""",
    "bars_rollup_1h": ORACLES["bars_1h"],
    "bars_rollup_for_5m": ORACLES["bars_for_5m"],
    "bars_rollup_merged": ORACLES["bars_all_symbols"],
    "bars_rollup_merged_7m": ORACLES["bars_interval_7m"],
    "lookup_order": f"WITH {_TICKS} SELECT {_COLUMNS} FROM ticks WHERE order_id IN (302, 555, 700)",
    "ticks_page_deep_indexed": f"WITH {_TICKS}, {_page('ticks', SYMBOL, START, END, 10, 12)}",
    "ticks_page_cut_indexed": f"WITH {_TICKS}, {_page('ticks', SYMBOL, f'{START}T07:30:00Z', f'{END}T13:20:00Z', 10, 9)}",
    "facts_data_range": ORACLES["data_range"],
    "facts_data_range_all": ORACLES["data_range_all"],
    "facts_count_by_date": ORACLES["count_by_date"],
    "facts_count_by_symbol": ORACLES["count_by_symbol"],
    "pending_in_log": f"""WITH {_FILES} SELECT file_name FROM files
WHERE file_name NOT IN ('feed-20240103.mbo.parquet', 'feed-20240109.mbo.parquet')""",
    "raw_files": f"WITH {_RAW} SELECT DISTINCT 'feed=' || source_file AS file_name FROM raw",
    "stream_load": ORACLES["normalize_ticks"],
    "catalog_table": f"WITH {_TICKS} SELECT {_DATE} AS date, ts AS ts_event, {_COLUMNS} FROM ticks",
    **{f"result_{fmt}": ORACLES["scan_ticks"] for fmt in ("csv", "json", "parquet")},
    "result_shape": f"""WITH {_TICKS} SELECT count(*) AS n_rows, CAST({_COLUMNS.count(",") + 1} AS BIGINT) AS n_columns
FROM ticks WHERE action = 'T'""",
    "bars_arrow": f"""WITH {_TICKS} {_bars(
        _WHOLE_DAY, keys="", where=f"symbol = '{SYMBOL}' AND {_between(START, END)}")}""",
    "ticks_arrow": ORACLES["filter_symbol"],
    "page_clamped": f"""WITH {_LINES}, merged AS (SELECT * REPLACE ('ALL' AS symbol) FROM lines),
{_page('merged', 'ALL', '1990-01-01', '2010-01-01', 50_000, 0)}""",
    "load_two_folders": ORACLES["normalize_ticks"],
    "load_again_fewer_hours": f"""WITH {_TICKS} SELECT {_DATE} AS date, CAST(hour(ts) AS INTEGER) AS hour, {_COLUMNS}
FROM ticks WHERE hour(ts) < 12""",
}
