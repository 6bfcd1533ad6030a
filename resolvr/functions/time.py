"""Date / time column expressions (P1-P3, P7-P14). All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text format of the request file's dates.
US_FORMAT = "MM/dd/yyyy hh:mm:ss a"
ISO_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_DATE_FORMAT = "yyyy-MM-dd"

MICROS_PER_DAY = 86_400_000_000.0

# Response-time bins, right-closed: (-1,1], (1,7], (7,30], (30,inf)
CATEGORY_EDGES = [-1, 1, 7, 30]
CATEGORY_LABELS = ["< 1 day", "< 7 days", "< 30 days", "> 30 days"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_lenient(c, fmt: str = US_FORMAT) -> Column:
    """Text -> TIMESTAMP_NTZ; text that does not match gives null."""
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("timestamp_ntz")


def parse_strict(c, fmt: str = US_FORMAT) -> Column:
    """Text -> TIMESTAMP_NTZ; a non-null text that does not match raises.

    ``to_timestamp`` raises under ANSI mode; the ``assert_true`` guard keeps
    the contract when ANSI is switched off too.
    """
    parsed = F.try_to_timestamp(_col(c), F.lit(fmt))
    ok = _col(c).isNull() | parsed.isNotNull()
    guard = F.assert_true(ok, F.concat(F.lit("unparseable timestamp: "), _col(c)))
    return F.when(guard.isNull(), parsed).cast("timestamp_ntz")


def parse_inferred(c, formats=(US_FORMAT, ISO_FORMAT, ISO_DATE_FORMAT),
                   strict: bool = False) -> Column:
    """Try several formats in turn (P3); lenient gives null, strict raises."""
    parsed = F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])
    if not strict:
        return parsed.cast("timestamp_ntz")
    ok = _col(c).isNull() | parsed.isNotNull()
    guard = F.assert_true(ok, F.concat(F.lit("unparseable timestamp: "), _col(c)))
    return F.when(guard.isNull(), parsed).cast("timestamp_ntz")


def response_interval(created="CREATED_DATE", closed="CLOSED_DATE") -> Column:
    """Closed minus created as a day-time interval."""
    return _col(closed) - _col(created)


def response_days(created="CREATED_DATE", closed="CLOSED_DATE") -> Column:
    """Fractional days between two timestamps (P8); null if either is null."""
    micros = F.timestamp_diff("MICROSECOND", _col(created), _col(closed))
    return micros / F.lit(MICROS_PER_DAY)


def response_whole_days(created="CREATED_DATE", closed="CLOSED_DATE") -> Column:
    """Whole days, floored also for negatives (P9): -6 h -> -1."""
    return F.floor(response_days(created, closed))


def response_category(whole_days) -> Column:
    """Right-closed bins over whole days (P10); outside every bin -> null."""
    d = _col(whole_days)
    e = CATEGORY_EDGES
    return (F.when((d > e[0]) & (d <= e[1]), F.lit(CATEGORY_LABELS[0]))
             .when((d > e[1]) & (d <= e[2]), F.lit(CATEGORY_LABELS[1]))
             .when((d > e[2]) & (d <= e[3]), F.lit(CATEGORY_LABELS[2]))
             .when(d > e[3], F.lit(CATEGORY_LABELS[3])))


def category_ordinal(whole_days) -> Column:
    """Sort position of the category (0..3), null where the category is."""
    d = _col(whole_days)
    e = CATEGORY_EDGES
    return (F.when((d > e[0]) & (d <= e[1]), F.lit(0))
             .when((d > e[1]) & (d <= e[2]), F.lit(1))
             .when((d > e[2]) & (d <= e[3]), F.lit(2))
             .when(d > e[3], F.lit(3)))


def created_hour(c="CREATED_DATE") -> Column:
    return F.hour(_col(c))


def created_day_of_week(c="CREATED_DATE") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(c))


def created_month(c="CREATED_DATE") -> Column:
    return F.month(_col(c))


def day_key(c="CREATED_DATE") -> Column:
    """Date-only key."""
    return F.to_date(_col(c))


def month_start(c="CREATED_DATE") -> Column:
    """First instant of the month."""
    return F.date_trunc("month", _col(c)).cast("timestamp_ntz")


def year_key(c="CREATED_DATE") -> Column:
    return F.year(_col(c))


# Weekday names for codes 0..6 (Monday = 0).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                 "Saturday", "Sunday"]


def weekday_name(code) -> Column:
    """Name by code, not by position (Q15)."""
    pairs = []
    for i, n in enumerate(WEEKDAY_NAMES):
        pairs += [F.lit(i), F.lit(n)]
    return F.create_map(*pairs)[_col(code)]
