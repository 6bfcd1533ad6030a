"""String / label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_code(c) -> Column:
    """Category as text with null as the string 'nan' (P23, Q8)."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


# Chart label of the selected models.
DISPLAY_LABELS = {
    "Baseline_1_SR_TYPE": "Baseline (SR_TYPE)",
    "LightGBM_Ensemble": "LightGBM",
    "XGB_Conservative": "XGBoost",
    "RF_Conservative": "Random Forest",
}

# Chart series colour by name substring, first match wins.
SERIES_CLASSES = [
    ("Baseline", "#e74c3c"),
    ("XGB", "#3498db"),
    ("RF", "#2ecc71"),
    ("LightGBM", "#9b59b6"),
]
SERIES_DEFAULT = "#95a5a6"

# Model names the comparison chart keeps.
CHART_MODELS = ["XGB_Conservative", "RF_Conservative", "LightGBM_Ensemble", "Baseline_1_SR_TYPE"]


def mapping(d: dict) -> Column:
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def display_label(c) -> Column:
    """Map lookup; a name without a label gives null."""
    return mapping(DISPLAY_LABELS)[_col(c)]


def series_class(c) -> Column:
    """First substring that matches decides the class."""
    expr = None
    for sub, cls in SERIES_CLASSES:
        cond = _col(c).contains(sub)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return expr.otherwise(F.lit(SERIES_DEFAULT))


def round2(c) -> Column:
    """Two decimals, half to even as NumPy rounds."""
    return F.bround(_col(c), 2)
