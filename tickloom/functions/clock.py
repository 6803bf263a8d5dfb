"""Time columns and the driver-side rules that go with them.

Everything is integer arithmetic on nanoseconds since the epoch, so results do
not depend on the session time zone and keep all nine fraction digits.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
SLOT = 15 * MINUTE

# Bar resolutions on offer, and the one used for unknown text.
RESOLUTIONS = {
    "1s": SECOND,
    "10s": 10 * SECOND,
    "1m": MINUTE,
    "5m": 5 * MINUTE,
    "15m": 15 * MINUTE,
    "1h": HOUR,
    "1d": DAY,
}
FALLBACK_RESOLUTION = "1m"

# A range strictly longer than the milliseconds on the left gets
# the resolution on the right; anything shorter gets one second.
AUTO_STEPS = (
    (604_800_000, "1d"),
    (86_400_000, "1h"),
    (14_400_000, "15m"),
    (3_600_000, "5m"),
    (900_000, "1m"),
    (300_000, "10s"),
)
AUTO_FINEST = "1s"

_UNITS = {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}

# Accepted texts, most specific first.  Only the first form carries an offset.
_OFFSET_FORM = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_PLAIN_FORM = r"^\d{1,4}-\d{1,2}-\d{1,2} +\d{1,2}:\d{1,2}:\d{1,2}$"
_DATE_FORM = r"^\d{1,4}-\d{1,2}-\d{1,2}$"
_FRACTION = r"\.(\d{1,9})\d*"


# --- integer helpers ------------------------------------------------------


def floor_to(col: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket of ``width`` that holds ``col``."""
    return col - F.pmod(col, F.lit(width))


def floor_div(col: Column, by: int) -> Column:
    """Integer quotient rounded down, also for values before the epoch."""
    return F.call_function("div", floor_to(col, by), F.lit(by).cast("bigint"))


def _pad(col: Column, digits: int) -> Column:
    return F.lpad(col.cast("string"), digits, "0")


# --- parts of a nanosecond time -------------------------------------------


def date_of(ns: Column) -> Column:
    return F.date_from_unix_date(floor_div(ns, DAY).cast("int"))


def hour_of(ns: Column) -> Column:
    return floor_div(F.pmod(ns, F.lit(DAY)), HOUR).cast("int")


def slot_of(ns: Column) -> Column:
    """``HH-MM`` label of the 15-minute slot."""
    minute = floor_div(F.pmod(floor_to(ns, SLOT), F.lit(DAY)), MINUTE)
    return F.concat(_pad(floor_div(minute, 60), 2), F.lit("-"), _pad(F.pmod(minute, F.lit(60)), 2))


def timestamp_of(ns: Column) -> Column:
    """TIMESTAMP cut to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1_000))


def epoch_ms(ns: Column) -> Column:
    return floor_div(ns, 1_000_000)


def ns_to_ms(ns: Column) -> Column:
    """TIMESTAMP cut to milliseconds."""
    return F.timestamp_millis(epoch_ms(ns))


def micros_to_ns(ts: Column) -> Column:
    """Nanoseconds of a TIMESTAMP column."""
    return F.unix_micros(ts) * F.lit(1_000)


def _clock_text(ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session zone."""
    second = floor_div(F.pmod(ns, F.lit(DAY)), SECOND)
    parts = (floor_div(second, 3600), F.pmod(floor_div(second, 60), F.lit(60)), F.pmod(second, F.lit(60)))
    return F.concat(date_of(ns).cast("string"), F.lit(" "), F.concat_ws(":", *(_pad(part, 2) for part in parts)))


def from_epoch_ns(ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.nnnnnnnnn UTC``."""
    return F.concat(_clock_text(ns), F.lit("."), _pad(F.pmod(ns, F.lit(SECOND)), 9), F.lit(" UTC"))


# --- text to time ---------------------------------------------------------


def _instant(text: Column, offset_only: bool = False) -> Column:
    """TIMESTAMP of a text; NULL if no form fits.  Texts without an offset are UTC.

    The cast alone would also take texts that no form allows.
    """
    zoned = F.when(text.rlike(_OFFSET_FORM), F.upper(text))
    if offset_only:
        return zoned.try_cast("timestamp")
    # the cast wants four digits of the year
    padded = F.lpad(text, F.length(text) + F.lit(5) - F.instr(text, "-"), "0")
    spelled = zoned.when(
        text.rlike(_PLAIN_FORM), F.concat(F.regexp_replace(padded, " +", " "), F.lit("Z"))
    ).when(text.rlike(_DATE_FORM), F.concat(padded, F.lit(" 00:00:00Z")))
    return spelled.try_cast("timestamp")


def _nanos(text: Column) -> Column:
    """Nanoseconds of the fraction, which a TIMESTAMP would cut."""
    return F.rpad(F.regexp_extract(text, _FRACTION, 1), 9, "0").try_cast("bigint")


def seconds_of(text: Column) -> Column:
    """Whole seconds of a text's time, NULL when no form fits; as a column of its own it serves several results."""
    return F.unix_seconds(_instant(text))


def to_epoch_ns(text: Column, seconds: Column | None = None) -> Column:
    """Nanoseconds of a text: with offset, then plain UTC, then date only.

    NULL when no form fits, 0 when the time lies outside the 64-bit range.
    ``seconds`` are those of the text, if the caller has them (:func:`seconds_of`).
    """
    seconds = seconds_of(text) if seconds is None else seconds
    exact = F.try_add(F.try_multiply(seconds, F.lit(SECOND)), _nanos(text))
    return F.when(seconds.isNotNull(), F.coalesce(exact, F.lit(0).cast("bigint")))


def to_utc_text(text: Column, seconds: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC`` of the same texts."""
    seconds = seconds_of(text) if seconds is None else seconds
    days = F.date_from_unix_date(floor_div(seconds, DAY // SECOND).cast("int"))
    # the years reach beyond 64-bit nanoseconds: date and time of day apart
    time = _clock_text(F.pmod(seconds, F.lit(DAY // SECOND)) * F.lit(SECOND))
    return F.concat(days.cast("string"), F.substring(time, 11, 9), F.lit(" UTC"))


def _millis(text: Column, offset_only: bool = False) -> Column:
    ms = F.unix_seconds(_instant(text, offset_only)) * 1_000 + F.call_function(
        "div", _nanos(text), F.lit(1_000_000).cast("bigint")
    )
    return F.coalesce(ms, F.lit(0).cast("bigint"))


def to_epoch_ms(text: Column) -> Column:
    """Milliseconds of a text with offset; 0 for anything else."""
    return _millis(text, offset_only=True)


def duration_ms(start: Column, end: Column) -> Column:
    """Absolute distance of two texts; an unreadable one counts as the epoch."""
    return F.abs(_millis(end) - _millis(start))


# --- resolutions and intervals as columns ---------------------------------


def auto_resolution(ms: Column) -> Column:
    """Resolution for a range of ``ms`` milliseconds."""
    (limit, name), *rest = AUTO_STEPS
    chosen = F.when(ms > limit, name)
    for limit, name in rest:
        chosen = chosen.when(ms > limit, name)
    return chosen.otherwise(AUTO_FINEST)


def normalize_resolution(text: Column) -> Column:
    return F.when(text.isin(*RESOLUTIONS), text).otherwise(FALLBACK_RESOLUTION)


def interval_text(text: Column) -> Column:
    """Column form of :func:`parse_interval`; NULL where that one raises."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    unit = F.lower(F.right(trimmed, F.lit(1)))
    digits = F.substring(trimmed, F.lit(1), F.length(trimmed) - 1)
    number = F.coalesce(
        F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("bigint")), F.lit(1).cast("bigint")
    )
    return (
        F.when(~unit.isin("s", "m", "h") | (F.length(trimmed) == 0), FALLBACK_RESOLUTION)
        .when(number > 0, F.concat(number.cast("string"), unit))
    )


# --- series ---------------------------------------------------------------


def date_series(start: Column, end: Column) -> Column:
    """Array of the dates in [start, end); empty when start is not before end."""
    # sequence() would count down for a reversed range
    empty = F.array().cast("array<date>")
    return F.when(start < end, F.sequence(start, F.date_sub(end, 1))).otherwise(empty)


def slot_series(date: Column) -> Column:
    """Array of the 96 ``(slot, start_ns, end_ns)`` of a day."""
    midnight = F.unix_date(date).cast("bigint") * F.lit(DAY)
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(DAY // SLOT - 1).cast("bigint")),
        lambda i: F.struct(
            slot_of(midnight + i * F.lit(SLOT)).alias("slot"),
            (midnight + i * F.lit(SLOT)).alias("start_ns"),
            (midnight + (i + 1) * F.lit(SLOT)).alias("end_ns"),
        ),
    )


# --- driver side ----------------------------------------------------------


def parse_ns(text: str) -> int | None:
    """Driver-side twin of :func:`to_epoch_ns`, for request arguments."""

    def fits(form: str) -> bool:
        return re.match(form, text, re.ASCII) is not None

    fraction = re.search(_FRACTION, text, re.ASCII)
    try:
        if fits(_OFFSET_FORM):
            whole = re.sub(_FRACTION, "", text, flags=re.ASCII).upper().replace(" ", "T")
            instant = dt.datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S%z")
        elif fits(_PLAIN_FORM):
            instant = dt.datetime(*map(int, re.findall(r"\d+", text)), tzinfo=dt.timezone.utc)
        elif fits(_DATE_FORM):
            instant = dt.datetime(*map(int, text.split("-")), tzinfo=dt.timezone.utc)
        else:
            return None
    except ValueError:
        return None
    ns = as_ns(instant) + int((fraction[1] if fraction else "").ljust(9, "0"))
    return ns if -(2**63) <= ns < 2**63 else 0


def as_ns(value: int | str | dt.date | dt.datetime) -> int:
    """Nanoseconds of a request argument; datetimes and texts without zone are UTC."""
    if isinstance(value, int):
        return value
    if isinstance(value, dt.datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        delta = aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return (delta.days * 86_400 + delta.seconds) * SECOND + delta.microseconds * 1_000
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days * DAY
    ns = parse_ns(value)
    if ns is None:
        ns = parse_ns(f"{value}Z")
    if ns is None:
        raise ValueError(f"not a time: {value!r}")
    return ns


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def date_of_ns(ns: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=ns // DAY)


def hour_of_ns(ns: int) -> int:
    return ns % DAY // HOUR


def slot_of_ns(ns: int) -> str:
    minute = ns % DAY // SLOT * 15
    return f"{minute // 60:02d}-{minute % 60:02d}"


def pick_resolution(start: int | str | dt.date | dt.datetime, end: int | str | dt.date | dt.datetime) -> str:
    """Resolution for a request range; an unreadable text counts as the epoch."""

    def ms(value) -> int:
        ns = parse_ns(value) or 0 if isinstance(value, str) else as_ns(value)
        return ns // 1_000_000

    length = abs(ms(end) - ms(start))
    return next((name for limit, name in AUTO_STEPS if length > limit), AUTO_FINEST)


def resolution_or_default(text: str) -> str:
    return text if text in RESOLUTIONS else FALLBACK_RESOLUTION


def parse_interval(text: str) -> str:
    """``N`` with unit s, m or h in any case; other units mean one minute.

    An unreadable N counts as 1.  An interval must be positive.
    """
    trimmed = text.strip()
    unit = trimmed[-1:].lower()
    if unit not in ("s", "m", "h"):
        return FALLBACK_RESOLUTION
    digits = trimmed[:-1]
    number = int(digits) if re.fullmatch(r"[+-]?[0-9]+", digits) else 1
    if not -(2**63) <= number < 2**63:
        number = 1
    if number <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    return f"{number}{unit}"


def width_ns(every: str) -> int:
    """Nanoseconds of ``N`` with unit s, m, h or d."""
    match = re.fullmatch(r"([0-9]+)([smhd])", every)
    if not match or int(match[1]) == 0:
        raise ValueError(f"not a bucket width: {every!r}")
    return int(match[1]) * _UNITS[match[2]]
