"""Weather feature expressions (P20-P22). A missing value gives flag 0 and
deviation 0, never null (Q10); NaN never enters because ingest maps empty
text to SQL NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag thresholds (degrees F, inches, inches); comparisons are strict.
COLD_BELOW_F = 20
HEAVY_PRECIP_ABOVE_IN = 0.5
SNOW_ABOVE_IN = 0

# Monthly normal mean temperature (degrees F), month 1..12.
MONTHLY_NORMAL_F = {1: 27, 2: 30, 3: 41, 4: 52, 5: 63, 6: 72,
                    7: 77, 8: 75, 9: 68, 10: 56, 11: 43, 12: 31}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def extreme_cold(temp="temp_mean") -> Column:
    return _flag(_col(temp) < F.lit(COLD_BELOW_F))


def heavy_precipitation(precip="precipitation") -> Column:
    return _flag(_col(precip) > F.lit(HEAVY_PRECIP_ABOVE_IN))


def snow_day(snow="snowfall") -> Column:
    return _flag(_col(snow) > F.lit(SNOW_ABOVE_IN))


def temp_normal(month="CREATED_MONTH") -> Column:
    """Normal for the month; a month outside 1..12 gives null."""
    pairs = []
    for m, t in MONTHLY_NORMAL_F.items():
        pairs += [F.lit(m), F.lit(t)]
    return F.create_map(*pairs)[_col(month)]


def temp_deviation(temp="temp_mean", month="CREATED_MONTH") -> Column:
    """temp - normal, 0 when either is missing."""
    return F.coalesce(_col(temp) - temp_normal(month), F.lit(0.0)).cast("double")
