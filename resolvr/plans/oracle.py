"""DuckDB SQL for every SQL-expressible driver key (same columns, same
rounding as ``registry``). Tables are the driver's pre-registered views."""

from __future__ import annotations

from .registry import CORR_FEATURES, CUTOFF, MODE_COLUMNS, PROFILE_COLUMNS

# Fixed values, written out here and not taken from the modules that the SQL checks: flag thresholds (degrees F, inches,
# inches), monthly normals, response categories (right-closed, whole days), weekdays from Monday, chart labels, colours
# and models, names of the baselines.
COLD, WET, SNOW = 20, 0.5, 0
NORMALS = {1: 27, 2: 30, 3: 41, 4: 52, 5: 63, 6: 72, 7: 77, 8: 75, 9: 68, 10: 56, 11: 43, 12: 31}
EDGES, CATEGORIES = [-1, 1, 7, 30], ["< 1 day", "< 7 days", "< 30 days", "> 30 days"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CLEAN_LABELS = {"Baseline_1_SR_TYPE": "Baseline (SR_TYPE)", "LightGBM_Ensemble": "LightGBM", "XGB_Conservative": "XGBoost",
                "RF_Conservative": "Random Forest"}
COLOURS, OTHER_COLOUR = [("Baseline", "#e74c3c"), ("XGB", "#3498db"), ("RF", "#2ecc71"), ("LightGBM", "#9b59b6")], "#95a5a6"
SELECTED = ["XGB_Conservative", "RF_Conservative", "LightGBM_Ensemble", "Baseline_1_SR_TYPE"]
BASELINE_NAMES = ["Baseline_0_Global", "Baseline_1_SR_TYPE", "Baseline_2_ZIP", "Baseline_3_SR_ZIP"]

REQ = """
requests AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS SR_NUMBER,
         p_brand AS SR_TYPE, c_mktsegment AS ORIGIN,
         CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS CREATED_DATE,
         CAST(l_shipdate AS TIMESTAMP) AS CLOSED_DATE,
         CAST(c_nationkey AS VARCHAR) AS ZIP_CODE,
         CAST(l_quantity AS DOUBLE) AS LATITUDE, CAST(l_extendedprice AS DOUBLE) AS LONGITUDE
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
req AS (
  SELECT *, CAST(hour(CREATED_DATE) AS INTEGER) AS CREATED_HOUR,
         CAST(isodow(CREATED_DATE) - 1 AS INTEGER) AS CREATED_DAY_OF_WEEK,
         CAST(month(CREATED_DATE) AS INTEGER) AS CREATED_MONTH,
         date_diff('microsecond', CREATED_DATE, CLOSED_DATE) / CAST(86400000000 AS DOUBLE) AS RESPONSE_TIME_DAYS
  FROM requests),
eda AS (SELECT * FROM req WHERE RESPONSE_TIME_DAYS IS NOT NULL)"""

WEATHER = """
wdays AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt,
                 date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS k FROM orders),
weather AS (
  SELECT dt AS date, CAST(5 + (k * 37) % 90 AS DOUBLE) AS temp_mean,
         CAST(((k * 13) % 100) / 100.0 AS DOUBLE) AS precipitation,
         CASE WHEN month(dt) IN (12, 1, 2) THEN CAST((k * 7) % 5 AS DOUBLE) ELSE 0.0 END AS snowfall
  FROM wdays WHERE k % 50 <> 0),
wj AS (SELECT req.*, CAST(CREATED_DATE AS DATE) AS CREATED_DAY, w.temp_mean, w.precipitation, w.snowfall
       FROM req LEFT JOIN weather w ON CAST(CREATED_DATE AS DATE) = w.date)"""

ORDER_COLS = ["SR_NUMBER", "SR_TYPE", "ORIGIN", "CLOSED_DATE", "ZIP_CODE", "LATITUDE", "LONGITUDE",
              "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH", "RESPONSE_TIME_DAYS"]
RANK_ORDER = "CREATED_DATE ASC NULLS LAST, " + ", ".join(f"{c} ASC NULLS LAST" for c in ORDER_COLS)

PERMUTED_ORDER = ", ".join(f"{c} ASC NULLS LAST" for c in [
    "SR_NUMBER", "SR_TYPE", "ORIGIN", "CREATED_DATE", "CLOSED_DATE", "ZIP_CODE", "LATITUDE", "LONGITUDE", "CREATED_HOUR",
    "CREATED_DAY_OF_WEEK", "CREATED_MONTH", "RESPONSE_TIME_DAYS"])
BASE = f"""
p99 AS (SELECT quantile_cont(RESPONSE_TIME_DAYS, 0.99) AS t FROM eda),
capped AS (SELECT eda.* FROM eda, p99 WHERE RESPONSE_TIME_DAYS <= t),
ranked AS (SELECT *, row_number() OVER (ORDER BY {RANK_ORDER}) AS row_rank FROM capped),
sizes AS (SELECT count(*) AS n,
                 CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test,
                 CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_val FROM capped),
split3 AS (SELECT r.*, CASE WHEN row_rank <= n - n_test - n_val THEN 'train'
                            WHEN row_rank <= n - n_test THEN 'val' ELSE 'test' END AS split
           FROM ranked r, sizes),
split2 AS (SELECT r.*, CASE WHEN row_rank <= n - n_test THEN 'train' ELSE 'test' END AS split
           FROM ranked r, sizes),
train AS (SELECT * FROM split3 WHERE split = 'train'),
test AS (SELECT * FROM split3 WHERE split = 'test'),
gm AS (SELECT CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS g FROM train),
m_type AS (SELECT SR_TYPE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM train GROUP BY SR_TYPE),
m_zip AS (SELECT ZIP_CODE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM train GROUP BY ZIP_CODE),
m_tz AS (SELECT SR_TYPE, ZIP_CODE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM train GROUP BY SR_TYPE, ZIP_CODE),
p0 AS (SELECT t.SR_NUMBER, t.RESPONSE_TIME_DAYS AS y_true, g AS y_pred FROM test t, gm),
p1 AS (SELECT t.SR_NUMBER, t.RESPONSE_TIME_DAYS AS y_true, coalesce(m.m, g) AS y_pred
       FROM test t LEFT JOIN m_type m ON t.SR_TYPE = m.SR_TYPE, gm),
p2 AS (SELECT t.SR_NUMBER, t.RESPONSE_TIME_DAYS AS y_true, coalesce(m.m, g) AS y_pred
       FROM test t LEFT JOIN m_zip m ON t.ZIP_CODE = m.ZIP_CODE, gm),
p3 AS (SELECT t.SR_NUMBER, t.RESPONSE_TIME_DAYS AS y_true, coalesce(m.m, g) AS y_pred
       FROM test t LEFT JOIN m_tz m ON t.SR_TYPE = m.SR_TYPE AND t.ZIP_CODE = m.ZIP_CODE, gm),
preds AS (SELECT '{BASELINE_NAMES[0]}' AS model_name, * FROM p0 UNION ALL
          SELECT '{BASELINE_NAMES[1]}', * FROM p1 UNION ALL
          SELECT '{BASELINE_NAMES[2]}', * FROM p2 UNION ALL
          SELECT '{BASELINE_NAMES[3]}', * FROM p3),
bmetrics AS (
  SELECT model_name, avg((y_true - y_pred) * (y_true - y_pred)) AS mse,
         sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
         avg(abs(y_true - y_pred)) AS mae,
         CASE WHEN var_pop(y_true) * count(*) > 0
              THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))
              WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
         count(*) AS n_samples
  FROM preds GROUP BY model_name)"""


def w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ROUNDED_METRICS = ("model_name, round(mse, 3) AS mse, round(rmse, 6) AS rmse, round(mae, 6) AS mae, "
                   "round(r2, 6) AS r2, n_samples")


def _case_map(col: str, d: dict) -> str:
    parts = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {parts} END"


def _series(col: str) -> str:
    parts = " ".join(f"WHEN contains({col}, '{s}') THEN '{c}'" for s, c in COLOURS)
    return f"CASE {parts} ELSE '{OTHER_COLOUR}' END"


_normals = " ".join(f"WHEN {m} THEN {t}" for m, t in NORMALS.items())
TEMP_NORMAL = f"(CASE CREATED_MONTH {_normals} END)"

US = "%m/%d/%Y %I:%M:%S %p"
ISO = "%Y-%m-%d %H:%M:%S"


def _hist_sql(expr_cte: str, bins: int = 50) -> str:
    return f"""
{expr_cte},
rng AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM vals),
cnt AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bucket,
               count(*) AS n FROM vals, rng GROUP BY 1)
SELECT CAST(b.range AS BIGINT) AS bucket,
       round(lo + b.range * ((hi - lo) / {bins}), 6) AS bin_start,
       round(lo + (b.range + 1) * ((hi - lo) / {bins}), 6) AS bin_end,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM range({bins}) b CROSS JOIN rng LEFT JOIN cnt ON cnt.bucket = b.range"""


def _hex_sql() -> str:
    import math
    nx = 30
    ny = int(nx / math.sqrt(3))
    return w(REQ, f"""
pts AS (SELECT LONGITUDE AS x, LATITUDE AS y, RESPONSE_TIME_DAYS AS v FROM eda
        WHERE LONGITUDE IS NOT NULL AND LATITUDE IS NOT NULL AND RESPONSE_TIME_DAYS IS NOT NULL),
ext AS (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM pts),
geo AS (SELECT xmin - (xmax - xmin) * 1e-9 AS x0, xmax + (xmax - xmin) * 1e-9 AS x1, ymin, ymax FROM ext),
sc AS (SELECT *, (x1 - x0) / {float(nx)} AS sx, (ymax - ymin) / {float(ny)} AS sy FROM geo),
ij AS (SELECT v, x0, ymin, sx, sy, (x - x0) / sx AS ix, (y - ymin) / sy AS iy FROM pts, sc),
cand AS (SELECT *, round_even(ix, 0) AS ix1, round_even(iy, 0) AS iy1,
                CAST(floor(ix) AS DOUBLE) AS ix2, CAST(floor(iy) AS DOUBLE) AS iy2 FROM ij),
pick AS (SELECT v, x0, ymin, sx, sy, ix1, iy1, ix2, iy2,
                ((ix - ix1) * (ix - ix1) + 3.0 * (iy - iy1) * (iy - iy1))
                < ((ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * (iy - iy2 - 0.5) * (iy - iy2 - 0.5)) AS first
         FROM cand),
cells AS (SELECT v,
            CASE WHEN first THEN 1 ELSE 2 END AS lattice,
            CAST(CASE WHEN first THEN ix1 ELSE ix2 END AS BIGINT) AS i,
            CAST(CASE WHEN first THEN iy1 ELSE iy2 END AS BIGINT) AS j,
            CASE WHEN first THEN x0 + ix1 * sx ELSE x0 + (ix2 + 0.5) * sx END AS cx,
            CASE WHEN first THEN ymin + iy1 * sy ELSE ymin + (iy2 + 0.5) * sy END AS cy
          FROM pick),
agg AS (SELECT lattice, i, j, any_value(cx) AS cx, any_value(cy) AS cy,
               sum(CAST(v AS DECIMAL(38,18))) AS sd, count(*) AS n FROM cells GROUP BY lattice, i, j),
ints AS (SELECT *, CAST(trunc(abs(sd)) AS HUGEINT) * CAST(1000000000000000000 AS HUGEINT)
                   + CAST((abs(sd) - trunc(abs(sd))) * 1000000000000000000 AS HUGEINT) AS an,
                 CAST(n AS HUGEINT) * CAST(1000000000000 AS HUGEINT) AS dn FROM agg)
SELECT CAST(lattice AS BIGINT) AS lattice, i, j, round(cx, 6) AS center_x, round(cy, 6) AS center_y,
       sign(sd) * CAST((2 * an + dn) // (2 * dn) AS DOUBLE) / 1000000.0 AS mean_value, n AS n_points
FROM ints""")


def _corr_sql() -> str:
    enc = """
enc AS (SELECT eda.*,
   dense_rank() OVER (ORDER BY coalesce(SR_TYPE, 'nan')) - 1 AS SR_TYPE_encoded,
   dense_rank() OVER (ORDER BY coalesce(ORIGIN, 'nan')) - 1 AS ORIGIN_encoded,
   dense_rank() OVER (ORDER BY coalesce(ZIP_CODE, 'nan')) - 1 AS ZIP_CODE_encoded
 FROM eda)"""
    parts = []
    for a in CORR_FEATURES:
        for b in CORR_FEATURES:
            if a == b:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST(1.0 AS DOUBLE) AS corr")
            else:
                x, y = sorted([a, b], key=CORR_FEATURES.index)
                parts.append(f"SELECT '{a}', '{b}', round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 6) FROM enc")
    return w(REQ, enc) + ",\nm AS (" + "\nUNION ALL ".join(parts) + ")"


def _profile_sql() -> str:
    parts = []
    types = {"LATITUDE": "double", "LONGITUDE": "double", "CREATED_HOUR": "int",
             "CREATED_DAY_OF_WEEK": "int", "CREATED_MONTH": "int", "RESPONSE_TIME_DAYS": "double"}
    for c in PROFILE_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, '{types[c]}' AS dtype, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM eda")
    return w(REQ) + "\n" + "\nUNION ALL ".join(parts)


def _modes_sql() -> str:
    parts = []
    for c in MODE_COLUMNS:
        parts.append(
            f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS mode, count(*) AS frequency "
            f"FROM eda WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)")
    return w(REQ) + "\n" + "\nUNION ALL ".join(parts)


def _null_counts_sql() -> str:
    cols = ["SR_NUMBER", "SR_TYPE", "ORIGIN", "CREATED_DATE", "CLOSED_DATE", "ZIP_CODE", "LATITUDE",
            "LONGITUDE", "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH", "RESPONSE_TIME_DAYS",
            "CREATED_DAY", "temp_mean", "precipitation", "snowfall"]
    parts = [f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count, "
             f"round(CAST(count_if({c} IS NULL) AS BIGINT) * 100.0 / count(*), 6) AS null_pct FROM wj" for c in cols]
    return w(REQ, WEATHER) + "\n" + "\nUNION ALL ".join(parts)


def _weather_stats_sql() -> str:
    feat = f"""
wf AS (SELECT *,
   CAST(coalesce(temp_mean < {COLD}, false) AS INTEGER) AS extreme_cold,
   CAST(coalesce(precipitation > {WET}, false) AS INTEGER) AS heavy_precipitation,
   CAST(coalesce(snowfall > {SNOW}, false) AS INTEGER) AS snow_day,
   CAST(coalesce(temp_mean - {TEMP_NORMAL}, 0.0) AS DOUBLE) AS temp_deviation FROM wj)"""
    cols = ["temp_mean", "precipitation", "snowfall", "extreme_cold", "heavy_precipitation", "snow_day",
            "temp_deviation"]
    parts = [f"SELECT '{c}' AS column_name, count({c}) AS non_null, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
             f"round(min(CAST({c} AS DOUBLE)), 6) AS min, round(max(CAST({c} AS DOUBLE)), 6) AS max FROM wf"
             for c in cols]
    return w(REQ, WEATHER, feat) + "\n" + "\nUNION ALL ".join(parts)


def _cv_trials_cte(k: int = 5) -> str:
    return f"""
ntr AS (SELECT count(*) AS n, count(*) // {k + 1} AS t FROM train),
folds AS (SELECT f.range AS fold, n - ({k} - f.range) * t AS train_end, n - ({k} - f.range - 1) * t AS val_end
          FROM range({k}) f, ntr),
asg AS (SELECT fo.fold, CASE WHEN row_rank <= train_end THEN 'train' ELSE 'val' END AS role, tr.*
        FROM train tr JOIN folds fo ON tr.row_rank <= fo.val_end),
ftr AS (SELECT * FROM asg WHERE role = 'train'),
fva AS (SELECT * FROM asg WHERE role = 'val'),
fg AS (SELECT fold, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS g FROM ftr GROUP BY fold),
f1 AS (SELECT fold, SR_TYPE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM ftr GROUP BY fold, SR_TYPE),
f2 AS (SELECT fold, ZIP_CODE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM ftr GROUP BY fold, ZIP_CODE),
f3 AS (SELECT fold, SR_TYPE, ZIP_CODE, CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) AS m FROM ftr GROUP BY fold, SR_TYPE, ZIP_CODE),
tp AS (
  SELECT '{BASELINE_NAMES[0]}' AS model, v.fold, v.RESPONSE_TIME_DAYS AS y_true, g AS y_pred
    FROM fva v JOIN fg USING (fold)
  UNION ALL
  SELECT '{BASELINE_NAMES[1]}', v.fold, v.RESPONSE_TIME_DAYS, coalesce(m.m, g)
    FROM fva v JOIN fg USING (fold) LEFT JOIN f1 m ON m.fold = v.fold AND m.SR_TYPE = v.SR_TYPE
  UNION ALL
  SELECT '{BASELINE_NAMES[2]}', v.fold, v.RESPONSE_TIME_DAYS, coalesce(m.m, g)
    FROM fva v JOIN fg USING (fold) LEFT JOIN f2 m ON m.fold = v.fold AND m.ZIP_CODE = v.ZIP_CODE
  UNION ALL
  SELECT '{BASELINE_NAMES[3]}', v.fold, v.RESPONSE_TIME_DAYS, coalesce(m.m, g)
    FROM fva v JOIN fg USING (fold) LEFT JOIN f3 m
      ON m.fold = v.fold AND m.SR_TYPE = v.SR_TYPE AND m.ZIP_CODE = v.ZIP_CODE),
trials AS (SELECT model, fold AS seed, avg(abs(y_true - y_pred)) AS mae,
                  sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse
           FROM tp GROUP BY model, fold)"""


def _ttest_sql() -> str:
    return w(REQ, BASE, _cv_trials_cte()) + """,
st AS (SELECT model, count(mae) AS n, avg(mae) AS m, var_samp(mae) AS v,
              row_number() OVER (ORDER BY model) AS pos FROM trials GROUP BY model),
pr AS (SELECT a.model AS Model_1, b.model AS Model_2, a.m - b.m AS Mean_Diff,
              a.n + b.n - 2 AS dof,
              sqrt(((a.n - 1) * coalesce(a.v, 0) + (b.n - 1) * coalesce(b.v, 0)) / (a.n + b.n - 2)
                   * (1.0 / a.n + 1.0 / b.n)) AS se
       FROM st a JOIN st b ON a.pos < b.pos),
tt AS (SELECT *, CASE WHEN dof > 0 AND se > 0 THEN Mean_Diff / se END AS t FROM pr),
th AS (SELECT *, atan(abs(t) / sqrt(dof)) AS theta FROM tt),
ser AS (
  SELECT Model_1, Model_2, Mean_Diff, t, dof, theta,
    CASE WHEN dof = 1 THEN 2 * theta / pi()
         WHEN dof % 2 = 0 THEN sin(theta) * (
           SELECT sum(c) FROM (SELECT exp(sum(ln((2.0 * jj - 1) / (2.0 * jj))) OVER (ORDER BY jj)) * pow(cos(theta), 2 * jj) AS c
                               FROM range(1, CAST((dof - 2) / 2 AS BIGINT) + 1) r(jj)
                               UNION ALL SELECT 1.0))
         ELSE 2 / pi() * (theta + sin(theta) * (
           SELECT sum(c) FROM (SELECT exp(sum(ln((2.0 * jj) / (2.0 * jj + 1))) OVER (ORDER BY jj)) * pow(cos(theta), 2 * jj + 1) AS c
                               FROM range(1, CAST((dof - 3) / 2 AS BIGINT) + 1) r(jj)
                               UNION ALL SELECT cos(theta))))
    END AS a
  FROM th)
SELECT Model_1, Model_2, round(Mean_Diff, 6) AS Mean_Diff, round(t, 6) AS t_statistic,
       round(CASE WHEN t IS NULL THEN NULL ELSE 1 - a END, 6) AS p_value,
       CASE WHEN t IS NOT NULL AND 1 - a < 0.05 THEN 'Yes' ELSE 'No' END AS Significant
FROM ser"""


def _box_sql() -> str:
    return w(REQ, BASE, _cv_trials_cte()) + """,
q AS (SELECT model, quantile_cont(mae, 0.25) AS q1, quantile_cont(mae, 0.5) AS median,
             quantile_cont(mae, 0.75) AS q3 FROM trials GROUP BY model),
qq AS (SELECT *, q3 - q1 AS iqr FROM q)
SELECT t.model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(min(CASE WHEN mae >= q1 - 1.5 * iqr THEN mae END), 6) AS whisker_low,
       round(max(CASE WHEN mae <= q3 + 1.5 * iqr THEN mae END), 6) AS whisker_high,
       round(avg(mae), 6) AS mean, round(stddev_pop(mae), 6) AS std,
       CAST(count_if(mae < q1 - 1.5 * iqr OR mae > q3 + 1.5 * iqr) AS BIGINT) AS n_outliers
FROM trials t JOIN qq USING (model) GROUP BY t.model, q1, median, q3, iqr"""


def _monthly_sql() -> str:
    return w(REQ) + """
SELECT CAST(date_trunc('month', CREATED_DATE) AS TIMESTAMP) AS month_start,
       round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE), 6) AS mean, round(quantile_cont(RESPONSE_TIME_DAYS, 0.5), 6) AS median,
       round(stddev_samp(RESPONSE_TIME_DAYS), 6) AS std,
       round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) - stddev_samp(RESPONSE_TIME_DAYS), 6) AS lower,
       round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE) + stddev_samp(RESPONSE_TIME_DAYS), 6) AS upper
FROM eda GROUP BY 1"""


def _dow_sql() -> str:
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(WEEKDAYS))
    return w(REQ) + f"""
SELECT CAST(CREATED_DAY_OF_WEEK AS BIGINT) AS CREATED_DAY_OF_WEEK,
       CASE CREATED_DAY_OF_WEEK {names} END AS day_name,
       round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE), 6) AS mean_days FROM eda GROUP BY CREATED_DAY_OF_WEEK"""


def _category_sql() -> str:
    e = EDGES
    lab = CATEGORIES
    return w(REQ) + f""",
cat AS (SELECT SR_NUMBER, CAST(floor(RESPONSE_TIME_DAYS) AS BIGINT) AS d FROM req)
SELECT SR_NUMBER, d AS RESPONSE_TIME_WHOLE_DAYS,
  CASE WHEN d > {e[0]} AND d <= {e[1]} THEN '{lab[0]}' WHEN d > {e[1]} AND d <= {e[2]} THEN '{lab[1]}'
       WHEN d > {e[2]} AND d <= {e[3]} THEN '{lab[2]}' WHEN d > {e[3]} THEN '{lab[3]}' END AS RESPONSE_TIME_CATEGORY,
  CAST(CASE WHEN d > {e[0]} AND d <= {e[1]} THEN 0 WHEN d > {e[1]} AND d <= {e[2]} THEN 1
       WHEN d > {e[2]} AND d <= {e[3]} THEN 2 WHEN d > {e[3]} THEN 3 END AS BIGINT) AS RESPONSE_TIME_CATEGORY_ORDINAL
FROM cat"""


def _target_summary_sql() -> str:
    return w(REQ) + """
SELECT round(avg(RESPONSE_TIME_DAYS), 6) AS mean, round(quantile_cont(RESPONSE_TIME_DAYS, 0.5), 6) AS median,
       round(stddev_samp(RESPONSE_TIME_DAYS), 6) AS std, round(skewness(RESPONSE_TIME_DAYS), 6) AS skew,
       round(min(RESPONSE_TIME_DAYS), 6) AS min, round(max(RESPONSE_TIME_DAYS), 6) AS max,
       count(RESPONSE_TIME_DAYS) AS n FROM eda"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["response_time_fractional"] = w(REQ) + """
SELECT SR_NUMBER, CREATED_DATE, CLOSED_DATE, round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM req"""
    q["response_time_floor"] = w(REQ) + """
SELECT SR_NUMBER, CAST(floor(RESPONSE_TIME_DAYS) AS BIGINT) AS RESPONSE_TIME_WHOLE_DAYS FROM req"""
    q["response_category"] = _category_sql()
    q["time_features"] = w(REQ) + """
SELECT SR_NUMBER, CAST(hour(CREATED_DATE) AS BIGINT) AS CREATED_HOUR,
       CAST(isodow(CREATED_DATE) - 1 AS BIGINT) AS CREATED_DAY_OF_WEEK,
       CAST(month(CREATED_DATE) AS BIGINT) AS CREATED_MONTH, CAST(CREATED_DATE AS DATE) AS CREATED_DAY,
       CAST(date_trunc('month', CREATED_DATE) AS TIMESTAMP) AS CREATED_MONTH_START,
       CAST(year(CREATED_DATE) AS BIGINT) AS CREATED_YEAR FROM req"""
    q["timestamp_parse_lenient"] = w(REQ) + f""",
t AS (SELECT SR_NUMBER, strftime(CREATED_DATE, '{US}') AS CREATED_TEXT, strftime(CLOSED_DATE, '{ISO}') AS CLOSED_TEXT,
             CASE WHEN ORIGIN = 'BUILDING' THEN 'not a date' ELSE strftime(CREATED_DATE, '{US}') END AS RAW_TEXT
      FROM req)
SELECT SR_NUMBER, CREATED_TEXT, try_strptime(CREATED_TEXT, '{US}') AS CREATED_PARSED,
       coalesce(try_strptime(CLOSED_TEXT, '{US}'), try_strptime(CLOSED_TEXT, '{ISO}'),
                try_strptime(CLOSED_TEXT, '%Y-%m-%d')) AS CLOSED_PARSED,
       RAW_TEXT, try_strptime(RAW_TEXT, '{US}') AS RAW_PARSED FROM t"""
    q["string_null_code"] = w(REQ, WEATHER) + """
SELECT SR_NUMBER, coalesce(CAST(ZIP_CODE AS VARCHAR), 'nan') AS ZIP_CODE_TEXT,
       coalesce(CAST(w.date AS VARCHAR), 'nan') AS WEATHER_DATE_TEXT
FROM wj LEFT JOIN weather w ON wj.CREATED_DAY = w.date"""
    q["flag_map"] = w(REQ, BASE) + f"""
SELECT model_name, {_case_map('model_name', CLEAN_LABELS)} AS clean_label, {_series('model_name')} AS series,
       round_even(mae, 2) AS mae_2dp, round_even(rmse, 2) AS rmse_2dp FROM bmetrics"""
    q["positive_only"] = w(REQ) + """
SELECT SR_NUMBER, round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM eda WHERE RESPONSE_TIME_DAYS > 0"""
    q["p99_filter"] = w(REQ, BASE) + """
SELECT SR_NUMBER, round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM capped"""
    q["p99_removed"] = w(REQ, BASE) + """
SELECT round(t, 6) AS threshold, count(*) AS n_before, CAST(count_if(RESPONSE_TIME_DAYS > t) AS BIGINT) AS n_removed,
       round(CAST(count_if(RESPONSE_TIME_DAYS > t) AS BIGINT) * 100.0 / count(*), 6) AS pct_removed FROM eda, p99 GROUP BY t"""
    q["weather_join"] = w(REQ, WEATHER) + """
SELECT SR_NUMBER, CREATED_DAY, temp_mean, precipitation, snowfall FROM wj"""
    q["weather_features"] = w(REQ, WEATHER) + f"""
SELECT SR_NUMBER,
   CAST(coalesce(temp_mean < {COLD}, false) AS BIGINT) AS extreme_cold,
   CAST(coalesce(precipitation > {WET}, false) AS BIGINT) AS heavy_precipitation,
   CAST(coalesce(snowfall > {SNOW}, false) AS BIGINT) AS snow_day,
   CAST({TEMP_NORMAL} AS BIGINT) AS temp_normal,
   round(CAST(coalesce(temp_mean - {TEMP_NORMAL}, 0.0) AS DOUBLE), 6) AS temp_deviation FROM wj"""
    q["weather_complete"] = w(REQ, WEATHER) + """
SELECT SR_NUMBER, CREATED_DAY FROM wj
WHERE temp_mean IS NOT NULL AND precipitation IS NOT NULL AND snowfall IS NOT NULL"""
    q["weather_missing_dates"] = w(REQ, WEATHER) + """
SELECT DISTINCT CAST(CREATED_DATE AS DATE) AS date FROM req
WHERE CREATED_DATE IS NOT NULL
  AND CAST(CREATED_DATE AS DATE) NOT IN (SELECT date FROM weather WHERE temp_mean IS NOT NULL)"""
    q["weather_year_coverage"] = w(REQ, WEATHER) + """
SELECT CAST(year(CREATED_DATE) AS BIGINT) AS year, count(SR_NUMBER) AS total_requests,
       count(temp_mean) AS with_weather,
       round_even(count(temp_mean) * 100.0 / count(SR_NUMBER), 2) AS pct_with_weather FROM wj GROUP BY 1"""
    q["weather_flag_counts"] = w(REQ, WEATHER) + f"""
SELECT CAST(count_if(temp_mean < {COLD}) AS BIGINT) AS extreme_cold_requests,
       CAST(count_if(precipitation > {WET}) AS BIGINT) AS heavy_precipitation_requests,
       CAST(count_if(snowfall > {SNOW}) AS BIGINT) AS snow_day_requests FROM wj"""
    q["weather_stats"] = _weather_stats_sql()
    q["date_range"] = w(REQ) + """
SELECT min(CAST(CREATED_DATE AS DATE)) AS min_date, max(CAST(CREATED_DATE AS DATE)) AS max_date,
       CAST(date_diff('day', min(CAST(CREATED_DATE AS DATE)), max(CAST(CREATED_DATE AS DATE))) + 1 AS BIGINT) AS days_needed
FROM req"""
    for k, p in [("baseline_global", "p0"), ("baseline_type", "p1"), ("baseline_zip", "p2"),
                 ("baseline_type_zip", "p3")]:
        q[k] = w(REQ, BASE) + f"""
SELECT SR_NUMBER, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM {p}"""
    q["partitioned_requests"] = w(REQ) + """
SELECT CAST(year(CREATED_DATE) * 100 + month(CREATED_DATE) AS INTEGER) AS CREATED_YM, count(*) AS n,
       count(DISTINCT SR_NUMBER) AS n_keys,
       round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE), 6) AS mean_days
FROM req WHERE CREATED_DATE >= TIMESTAMP '1996-03-01' AND CREATED_DATE < TIMESTAMP '1997-02-15' GROUP BY 1"""
    shifted = " UNION ALL ".join(f"""
SELECT '{c}' AS feature, {s} AS seed, t.*, coalesce(lead({c}) OVER o, first_value({c}) OVER o) AS other
FROM test t WINDOW o AS (ORDER BY md5(concat_ws(':', SR_NUMBER, '{s}')), {PERMUTED_ORDER}
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""" for c in ("SR_TYPE", "ZIP_CODE") for s in (42, 43))
    q["permutation_importance"] = w(REQ, BASE) + f""",
mixed AS ({shifted}),
scored AS (SELECT feature, seed, abs(x.RESPONSE_TIME_DAYS - coalesce(m.m, g)) AS e
           FROM (SELECT * EXCLUDE (SR_TYPE, ZIP_CODE), CASE feature WHEN 'SR_TYPE' THEN other ELSE SR_TYPE END AS SR_TYPE,
                        CASE feature WHEN 'ZIP_CODE' THEN other ELSE ZIP_CODE END AS ZIP_CODE FROM mixed) x
           LEFT JOIN m_tz m ON x.SR_TYPE = m.SR_TYPE AND x.ZIP_CODE = m.ZIP_CODE, gm),
base AS (SELECT avg(abs(y_true - y_pred)) AS mae, count(*) AS n_rows FROM p3),
per AS (SELECT feature, avg(m) AS permuted_mae FROM (SELECT feature, seed, avg(e) AS m FROM scored GROUP BY ALL) GROUP BY feature)
SELECT feature, round(mae, 6) AS mae, round(permuted_mae, 6) AS permuted_mae, round(permuted_mae - mae, 6) AS importance, n_rows
FROM per, base"""
    q["baseline_metrics"] = w(REQ, BASE) + f"\nSELECT {ROUNDED_METRICS} FROM bmetrics"
    q["baseline_valid_metrics"] = w(REQ, BASE) + """
SELECT 'BASELINE_PREDICTION_DAYS_' || substr(model_name, 10, 1) AS Baseline, round(mse, 3) AS MSE,
       round(mae, 6) AS MAE, n_samples AS Valid_Predictions FROM bmetrics"""
    q["baseline_ranking"] = w(REQ, BASE) + """
SELECT row_number() OVER (ORDER BY mae, model_name) AS position, model_name, round(r2, 6) AS r2,
       round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mse, 3) AS mse FROM bmetrics"""
    q["baseline_improvement"] = w(REQ, BASE) + """,
b AS (SELECT model_name, mae FROM bmetrics ORDER BY mae, model_name LIMIT 1),
bb AS (SELECT model_name, mae FROM bmetrics WHERE contains(model_name, 'Global') ORDER BY mae, model_name LIMIT 1)
SELECT b.model_name AS best_model, round(b.mae, 6) AS best_mae, bb.model_name AS best_baseline,
       round(bb.mae, 6) AS best_baseline_mae, round((bb.mae - b.mae) / bb.mae * 100.0, 6) AS improvement_pct
FROM b, bb"""
    q["monthly_trend"] = _monthly_sql()
    q["dow_trend"] = _dow_sql()
    q["hour_trend"] = w(REQ) + """
SELECT CAST(CREATED_HOUR AS BIGINT) AS CREATED_HOUR, round(CAST(avg(CAST(RESPONSE_TIME_DAYS AS DECIMAL(38,18))) AS DOUBLE), 6) AS mean_days
FROM eda GROUP BY CREATED_HOUR"""
    q["histogram"] = w(REQ) + _hist_sql(",\nvals AS (SELECT RESPONSE_TIME_DAYS AS x FROM eda)")
    q["log_histogram"] = w(REQ) + _hist_sql(
        ",\nvals AS (SELECT ln(1 + RESPONSE_TIME_DAYS) AS x FROM eda WHERE RESPONSE_TIME_DAYS > -1)")
    q["hexbin_mean"] = _hex_sql()
    q["target_summary"] = _target_summary_sql()
    q["correlation_matrix"] = _corr_sql() + "\nSELECT * FROM m"
    q["target_correlation"] = _corr_sql() + """
SELECT feature_a AS feature, corr FROM m WHERE feature_b = 'RESPONSE_TIME_DAYS' AND feature_a <> 'RESPONSE_TIME_DAYS'"""
    q["null_counts"] = _null_counts_sql()
    q["table_profile"] = _profile_sql()
    q["column_modes"] = _modes_sql()
    q["split_three_way"] = w(REQ, BASE) + "\nSELECT SR_NUMBER, CREATED_DATE, split FROM split3"
    q["split_two_way"] = w(REQ, BASE) + "\nSELECT SR_NUMBER, CREATED_DATE, split FROM split2"
    by_hash = "row_number() OVER (ORDER BY md5(SR_NUMBER || ':42'), " + RANK_ORDER + ") AS h"
    q["random_split"] = w(REQ, BASE) + f"""
SELECT SR_NUMBER, CASE WHEN h <= ceil((SELECT count(*) FROM capped) * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, {by_hash} FROM capped)"""
    q["exact_sample"] = w(REQ, BASE) + f"""
SELECT SR_NUMBER, CREATED_DATE FROM (SELECT *, {by_hash} FROM capped) WHERE h <= 5000"""
    q["proportional_sample"] = w(REQ, BASE) + f"""
SELECT SR_NUMBER, CREATED_DATE FROM (SELECT *, {by_hash} FROM test)
WHERE h <= (SELECT CAST(floor(count(*) * least(1.0, CAST(5000 AS DOUBLE) / count(*))) AS BIGINT) FROM test)"""
    q["split_summary"] = w(REQ, BASE) + """
SELECT coalesce(split, 'total') AS split, count(*) AS n_rows, min(CREATED_DATE) AS start, max(CREATED_DATE) AS "end"
FROM split3 GROUP BY ROLLUP (split)"""
    q["split_cutoff"] = w(REQ, BASE) + f"""
SELECT SR_NUMBER, CREATED_DATE,
       CASE WHEN CREATED_DATE < TIMESTAMP '{CUTOFF} 00:00:00' THEN 'train'
            WHEN CREATED_DATE >= TIMESTAMP '{CUTOFF} 00:00:00' THEN 'test' END AS split FROM capped"""
    q["cv_folds"] = w(REQ, BASE) + """,
ntr AS (SELECT count(*) AS n, count(*) // 6 AS t FROM train),
folds AS (SELECT f.range AS fold, n - (5 - f.range) * t AS train_end, n - (5 - f.range - 1) * t AS val_end
          FROM range(5) f, ntr)
SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN row_rank <= train_end THEN 'train' ELSE 'val' END AS role,
       SR_NUMBER, row_rank
FROM train JOIN folds ON row_rank <= val_end"""
    q["global_rank"] = w(REQ) + f"""
SELECT SR_NUMBER, row_number() OVER (ORDER BY {RANK_ORDER}) AS row_rank FROM req"""
    q["label_encode"] = w(REQ, BASE) + """
SELECT column_name, label, dense_rank() OVER (PARTITION BY column_name ORDER BY label) - 1 AS code FROM (
  SELECT DISTINCT 'SR_TYPE' AS column_name, coalesce(SR_TYPE, 'nan') AS label FROM train UNION
  SELECT DISTINCT 'ZIP_CODE', coalesce(ZIP_CODE, 'nan') FROM train UNION
  SELECT DISTINCT 'ORIGIN', coalesce(ORIGIN, 'nan') FROM train)"""
    q["label_encode_unseen"] = w(REQ, BASE) + """,
d AS (SELECT column_name, label, dense_rank() OVER (PARTITION BY column_name ORDER BY label) - 1 AS code FROM (
  SELECT DISTINCT 'SR_TYPE' AS column_name, coalesce(SR_TYPE, 'nan') AS label FROM train UNION
  SELECT DISTINCT 'ZIP_CODE', coalesce(ZIP_CODE, 'nan') FROM train UNION
  SELECT DISTINCT 'ORIGIN', coalesce(ORIGIN, 'nan') FROM train))
SELECT t.SR_NUMBER, coalesce(a.code, -1) AS SR_TYPE_code, coalesce(b.code, -1) AS ZIP_CODE_code,
       coalesce(c.code, -1) AS ORIGIN_code
FROM test t
LEFT JOIN d a ON a.column_name = 'SR_TYPE' AND a.label = coalesce(t.SR_TYPE, 'nan')
LEFT JOIN d b ON b.column_name = 'ZIP_CODE' AND b.label = coalesce(t.ZIP_CODE, 'nan')
LEFT JOIN d c ON c.column_name = 'ORIGIN' AND c.label = coalesce(t.ORIGIN, 'nan')"""
    q["trial_summary"] = w(REQ, BASE, _cv_trials_cte()) + """
SELECT model, round(avg(mae), 6) AS MAE_mean, round(stddev_pop(mae), 6) AS MAE_std, round(min(mae), 6) AS MAE_min,
       round(max(mae), 6) AS MAE_max, round(avg(rmse), 6) AS RMSE_mean, round(stddev_pop(rmse), 6) AS RMSE_std,
       count(*) AS n_trials FROM trials GROUP BY model"""
    q["ttest_pairs"] = _ttest_sql()
    q["trial_box_stats"] = _box_sql()
    q["weather_json_rows"] = w(WEATHER) + "\nSELECT date, temp_mean, precipitation, snowfall FROM weather"
    q["csv_roundtrip"] = w(REQ) + """
SELECT SR_NUMBER, SR_TYPE, ORIGIN, CREATED_DATE, CLOSED_DATE, ZIP_CODE, CAST(CREATED_HOUR AS BIGINT) AS CREATED_HOUR,
       LATITUDE, LONGITUDE FROM req"""
    q["first_rows"] = w(REQ) + f"""
SELECT SR_NUMBER, SR_TYPE, CREATED_DATE, CLOSED_DATE FROM req ORDER BY {RANK_ORDER} LIMIT 10"""
    q["keep_columns"] = w(REQ) + """
SELECT SR_TYPE, ORIGIN, CREATED_DATE, CLOSED_DATE, ZIP_CODE, CAST(CREATED_HOUR AS BIGINT) AS CREATED_HOUR,
       CAST(CREATED_DAY_OF_WEEK AS BIGINT) AS CREATED_DAY_OF_WEEK, CAST(CREATED_MONTH AS BIGINT) AS CREATED_MONTH,
       round(LATITUDE, 6) AS LATITUDE, round(LONGITUDE, 6) AS LONGITUDE,
       round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM req"""
    q["numeric_columns"] = w(REQ) + """
SELECT SR_NUMBER, round(LATITUDE, 6) AS LATITUDE, round(LONGITUDE, 6) AS LONGITUDE,
       round(CREATED_HOUR, 6) AS CREATED_HOUR, round(CREATED_DAY_OF_WEEK, 6) AS CREATED_DAY_OF_WEEK,
       round(CREATED_MONTH, 6) AS CREATED_MONTH, round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM req"""
    q["point_table"] = w(REQ) + """
SELECT LONGITUDE, LATITUDE, round(RESPONSE_TIME_DAYS, 6) AS RESPONSE_TIME_DAYS FROM req
WHERE LONGITUDE IS NOT NULL AND LATITUDE IS NOT NULL AND RESPONSE_TIME_DAYS IS NOT NULL"""
    chart = ", ".join(f"'{m}'" for m in SELECTED)
    q["model_filter"] = w(REQ, BASE) + f"""
SELECT {ROUNDED_METRICS} FROM bmetrics WHERE model_name IN ({chart}) OR contains(model_name, 'ZIP')"""
    q["result_union"] = w(REQ, BASE) + f"\nSELECT {ROUNDED_METRICS} FROM bmetrics"
    q["ablation_impact"] = w(REQ, BASE) + """,
ref AS (SELECT mae AS ref_mae FROM bmetrics WHERE model_name = 'Baseline_3_SR_ZIP')
SELECT model_name, round(mae, 6) AS mae, round(mae - ref_mae, 6) AS mae_impact,
       round((mae - ref_mae) / ref_mae * 100.0, 6) AS pct_change
FROM bmetrics, ref WHERE model_name <> 'Baseline_3_SR_ZIP'"""
    q["distinct_dates"] = w(REQ) + "\nSELECT DISTINCT CAST(CREATED_DATE AS DATE) AS CREATED_DAY FROM req"
    return q


ORACLE = build()
