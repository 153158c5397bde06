"""DuckDB SQL texts equivalent to the registered queries.

Written independently of the Spark code, against the raw tables
(pre-registered as views).  Each text starts with the shared CTEs it needs.
"""

from __future__ import annotations

from tidemark.sources.uploads import DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL
from tidemark.sources.warehouse import ACTIVITY_VIEW_SQL, DATASETS_VIEW_SQL, SALES_VIEW_SQL

ORACLE: dict[str, str] = {}


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SALES = with_ctes(SALES_VIEW_SQL)


def rnd(expr: str, places: int = 2) -> str:
    """Round through DECIMAL(38,6), as the Spark side does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


def _breakdown_sql(column: str) -> str:
    return SALES + f"""
, g AS (
  SELECT dataset_id, CAST({column} AS VARCHAR) AS label,
         sum(revenue) AS revenue, sum(quantity) AS units
  FROM sales WHERE {column} IS NOT NULL GROUP BY dataset_id, {column}
), t AS (SELECT dataset_id, sum(revenue) AS total FROM g GROUP BY dataset_id)
SELECT g.dataset_id, g.label, {rnd("g.revenue", 2)} AS revenue, {rnd("g.units", 2)} AS units,
       CASE WHEN t.total <> 0 THEN {rnd("g.revenue / t.total * 100", 2)} ELSE 0.0 END AS share_pct
FROM g JOIN t USING (dataset_id)"""


ORACLE["breakdown_category"] = _breakdown_sql("category")
ORACLE["breakdown_region"] = _breakdown_sql("region")
ORACLE["breakdown_product"] = _breakdown_sql("product")

ORACLE["top_products"] = SALES + f"""
, g AS (
  SELECT dataset_id, product AS label, sum(revenue) AS revenue, sum(quantity) AS units
  FROM sales WHERE product IS NOT NULL GROUP BY dataset_id, product
), t AS (SELECT dataset_id, sum(revenue) AS total FROM g GROUP BY dataset_id),
ranked AS (
  SELECT g.*, t.total,
         CAST(row_number() OVER (PARTITION BY g.dataset_id ORDER BY g.revenue DESC, g.label)
              AS BIGINT) AS rank
  FROM g JOIN t USING (dataset_id)
)
SELECT dataset_id, rank, label, {rnd("revenue", 2)} AS revenue, {rnd("units", 2)} AS units,
       CASE WHEN total <> 0 THEN {rnd("revenue / total * 100", 2)} ELSE 0.0 END AS share_pct
FROM ranked WHERE rank <= 10"""


def _trend_sql(bucket: str, step: str, month: bool = False) -> str:
    if month:
        cal = """SELECT dataset_id, last_day(CAST(m AS DATE)) AS bucket
  FROM (SELECT dataset_id, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
                                                   INTERVAL 1 MONTH)) AS m FROM bounds)"""
    else:
        cal = f"""SELECT dataset_id, CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS bucket
  FROM bounds"""
    return SALES + f"""
, b AS (
  SELECT dataset_id, {bucket} AS bucket, sum(revenue) AS revenue, sum(quantity) AS units
  FROM sales GROUP BY ALL
), bounds AS (
  SELECT dataset_id, CAST(min(bucket) AS TIMESTAMP) AS lo, CAST(max(bucket) AS TIMESTAMP) AS hi
  FROM b GROUP BY dataset_id
), cal AS (
  {cal}
)
SELECT cal.dataset_id, strftime(cal.bucket, '%Y-%m-%d') AS period,
       {rnd("coalesce(b.revenue, 0.0)", 2)} AS revenue, {rnd("coalesce(b.units, 0.0)", 2)} AS units
FROM cal LEFT JOIN b ON cal.dataset_id = b.dataset_id AND cal.bucket = b.bucket"""


ORACLE["trend_daily"] = _trend_sql("order_date", "INTERVAL 1 DAY")
# ISO weeks start Monday: the Sunday closing a week is Monday + 6 days.
ORACLE["trend_weekly"] = _trend_sql(
    "CAST(date_trunc('week', order_date) + INTERVAL 6 DAY AS DATE)", "INTERVAL 7 DAY")
ORACLE["trend_monthly"] = _trend_sql("last_day(order_date)", "", month=True)

ORACLE["overview"] = with_ctes(SALES_VIEW_SQL, DATASETS_VIEW_SQL) + f"""
SELECT d.dataset_id, d.original_filename, CAST(coalesce(s.n, 0) AS BIGINT) AS row_count,
       CASE WHEN s.n > 0 THEN 'processed' ELSE 'invalid' END AS status,
       coalesce({rnd("s.rev", 2)}, 0.0) AS total_revenue,
       CAST(coalesce(s.n, 0) AS BIGINT) AS total_orders
FROM datasets d LEFT JOIN (
  SELECT dataset_id, sum(revenue) AS rev, count(*) AS n FROM sales GROUP BY dataset_id
) s USING (dataset_id)"""

def daily_sql(keys: str = "dataset_id, region", name: str = "daily") -> str:
    on = " AND ".join(f"c.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    ckeys = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_raw AS (
  SELECT {keys}, order_date, sum(revenue) AS revenue, sum(quantity) AS quantity
  FROM sales GROUP BY ALL
), {name}_bounds AS (
  SELECT {keys}, CAST(min(order_date) AS TIMESTAMP) AS lo, CAST(max(order_date) AS TIMESTAMP) AS hi
  FROM {name}_raw GROUP BY ALL
), {name}_cal AS (
  SELECT {keys}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS order_date
  FROM {name}_bounds
), {name} AS (
  SELECT {ckeys}, c.order_date,
         coalesce(d.revenue, 0.0) AS revenue, coalesce(d.quantity, 0.0) AS quantity
  FROM {name}_cal c LEFT JOIN {name}_raw d ON {on} AND c.order_date = d.order_date
)"""


DAILY_SERIES_SQL = daily_sql()

ORACLE["daily_series"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL) + f"""
SELECT dataset_id, region, order_date, {rnd("revenue", 2)} AS revenue,
       {rnd("quantity", 2)} AS quantity FROM daily"""


# --- KPIs -------------------------------------------------------------------

def _growth_sql(keys: str) -> str:
    return f"""
m AS (
  SELECT {keys}, date_trunc('month', order_date) AS mon, sum(revenue) AS rev
  FROM sales GROUP BY ALL
), mb AS (
  SELECT {keys}, min(mon) AS lo_m, max(mon) AS hi_m FROM m GROUP BY ALL
), growth AS (
  SELECT {keys},
    CASE WHEN min(mb.lo_m) < min(mb.hi_m) THEN
      CASE WHEN coalesce(sum(rev) FILTER (WHERE mon = mb.hi_m - INTERVAL 1 MONTH), 0) = 0 THEN NULL
      ELSE {rnd("(sum(rev) FILTER (WHERE mon = mb.hi_m) - sum(rev) FILTER (WHERE mon = mb.hi_m - INTERVAL 1 MONTH)) / sum(rev) FILTER (WHERE mon = mb.hi_m - INTERVAL 1 MONTH) * 100", 2)} END
    END AS revenue_growth_mom_pct,
    CASE WHEN year(min(mb.lo_m)) < year(min(mb.hi_m)) THEN
      CASE WHEN coalesce(sum(rev) FILTER (WHERE year(mon) = year(mb.hi_m) - 1), 0) = 0 THEN NULL
      ELSE {rnd("(sum(rev) FILTER (WHERE year(mon) = year(mb.hi_m)) - sum(rev) FILTER (WHERE year(mon) = year(mb.hi_m) - 1)) / sum(rev) FILTER (WHERE year(mon) = year(mb.hi_m) - 1) * 100", 2)} END
    END AS revenue_growth_yoy_pct
  FROM m JOIN mb USING ({keys}) GROUP BY ALL
)"""


def _top_sql(name: str, column: str, keys: str) -> str:
    return f"""
{name} AS (
  SELECT {keys}, {column} AS top_{column} FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rev DESC, {column}) AS rn
    FROM (SELECT {keys}, {column}, sum(revenue) AS rev
          FROM sales WHERE {column} IS NOT NULL GROUP BY {keys}, {column})
  ) WHERE rn = 1
)"""


ORACLE["kpi_summary"] = with_ctes(
    SALES_VIEW_SQL, DATASETS_VIEW_SQL, _growth_sql("dataset_id"),
    _top_sql("tp", "product", "dataset_id"), _top_sql("tc", "category", "dataset_id"),
    _top_sql("tr", "region", "dataset_id"),
) + f"""
, base AS (
  SELECT dataset_id, sum(revenue) AS rev, sum(quantity) AS units, count(*) AS n,
         min(order_date) AS lo, max(order_date) AS hi
  FROM sales GROUP BY dataset_id
)
SELECT d.dataset_id,
  {rnd("coalesce(b.rev, 0.0)")} AS total_revenue,
  {rnd("coalesce(b.units, 0.0)")} AS total_units_sold,
  CASE WHEN coalesce(b.n, 0) > 0 THEN {rnd("b.rev / b.n")} ELSE 0.0 END AS average_order_value,
  CAST(coalesce(b.n, 0) AS BIGINT) AS total_orders,
  g.revenue_growth_mom_pct, g.revenue_growth_yoy_pct,
  CASE WHEN b.lo IS NOT NULL THEN {rnd("b.rev / greatest(date_diff('day', b.lo, b.hi) + 1, 1)")}
       ELSE 0.0 END AS average_daily_revenue,
  tp.top_product, tc.top_category, tr.top_region,
  CAST(NULL AS DOUBLE) AS forecast_accuracy_pct,
  CAST(NULL AS DOUBLE) AS sales_target_achievement_pct
FROM (SELECT DISTINCT dataset_id FROM datasets) d
LEFT JOIN base b USING (dataset_id)
LEFT JOIN growth g USING (dataset_id)
LEFT JOIN tp USING (dataset_id) LEFT JOIN tc USING (dataset_id) LEFT JOIN tr USING (dataset_id)"""

ORACLE["kpi_mom_yoy"] = with_ctes(SALES_VIEW_SQL, _growth_sql("dataset_id, region, category")) + """
SELECT * FROM growth"""

ORACLE["kpi_top_entities"] = with_ctes(
    SALES_VIEW_SQL, _top_sql("tp", "product", "dataset_id, region"),
    _top_sql("tc", "category", "dataset_id, region")) + """
SELECT tp.dataset_id, tp.region, tp.top_product, tc.top_category
FROM tp LEFT JOIN tc USING (dataset_id, region)"""

ORACLE["kpi_target"] = SALES + f"""
SELECT dataset_id, {rnd("sum(revenue)")} AS total_revenue,
       {rnd("sum(revenue) / 50000000.0 * 100")} AS sales_target_achievement_pct
FROM sales GROUP BY dataset_id"""


# --- Features ----------------------------------------------------------------

SERIES = "dataset_id, region"
W_SERIES = f"PARTITION BY {SERIES} ORDER BY order_date"


CALENDAR_SQL = """
  CAST(isodow(order_date) - 1 AS BIGINT) AS day_of_week,
  CAST(day(order_date) AS BIGINT) AS day_of_month,
  CAST(month(order_date) AS BIGINT) AS month,
  CAST(quarter(order_date) AS BIGINT) AS quarter,
  CAST(year(order_date) AS BIGINT) AS year,
  CAST(weekofyear(order_date) AS BIGINT) AS week_of_year,
  CAST(isodow(order_date) >= 6 AS BIGINT) AS is_weekend,
  CAST(day(order_date) = 1 AS BIGINT) AS is_month_start,
  CAST(order_date = last_day(order_date) AS BIGINT) AS is_month_end"""

def features_sql(keys: str = SERIES, src: str = "daily", name: str = "feats") -> str:
    w = f"PARTITION BY {keys} ORDER BY order_date"
    lags = ",\n".join(f"  lag(revenue, {n}) OVER ({w}) AS revenue_lag_{n}"
                       for n in (1, 2, 3, 7, 14, 30))
    rolls = ",\n".join(
        f"""  CASE WHEN row_number() OVER ({w}) > {n} THEN
    {stat}(revenue) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END
    AS revenue_roll_{nm}_{n}"""
        for n in (7, 14, 30) for nm, stat in (("mean", "avg"), ("std", "stddev_samp")))
    return f"""
{name}_all AS (
  SELECT {keys}, order_date, revenue, quantity,
  {CALENDAR_SQL},
{lags},
{rolls},
  CAST(row_number() OVER ({w}) - 1 AS BIGINT) AS time_index
  FROM {src}
), {name} AS (
  SELECT * FROM {name}_all
  WHERE revenue_lag_30 IS NOT NULL AND revenue_roll_std_30 IS NOT NULL
)"""

LAGS_SQL = ",\n".join(
    f"  lag(revenue, {n}) OVER ({W_SERIES}) AS revenue_lag_{n}" for n in (1, 2, 3, 7, 14, 30))

ROLL_SQL = ",\n".join(
    f"""  CASE WHEN row_number() OVER ({W_SERIES}) > {n} THEN
    {stat}(revenue) OVER ({W_SERIES} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END
    AS revenue_roll_{name}_{n}"""
    for n in (7, 14, 30) for name, stat in (("mean", "avg"), ("std", "stddev_samp")))

FEATURES_SQL = f"""
feats_all AS (
  SELECT {SERIES}, order_date, revenue, quantity,
  {CALENDAR_SQL},
{LAGS_SQL},
{ROLL_SQL},
  CAST(row_number() OVER ({W_SERIES}) - 1 AS BIGINT) AS time_index
  FROM daily
), feats AS (
  SELECT * FROM feats_all
  WHERE revenue_lag_30 IS NOT NULL AND revenue_roll_std_30 IS NOT NULL
    AND revenue_lag_1 IS NOT NULL AND revenue_roll_mean_7 IS NOT NULL
)"""

FEATURE_NAMES = ["day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year",
                 "is_weekend", "is_month_start", "is_month_end"] + [
    f"revenue_lag_{n}" for n in (1, 2, 3, 7, 14, 30)] + [
    f"revenue_roll_{k}_{n}" for n in (7, 14, 30) for k in ("mean", "std")] + ["time_index"]

ORACLE["calendar_features"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL) + f"""
SELECT {SERIES}, order_date, {CALENDAR_SQL} FROM daily"""

ORACLE["lag_features"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL) + f"""
SELECT {SERIES}, order_date, """ + ", ".join(
    f"{rnd(f'lag(revenue, {n}) OVER ({W_SERIES})')} AS revenue_lag_{n}"
    for n in (1, 2, 3, 7, 14, 30)) + " FROM daily"

ORACLE["rolling_features"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL, FEATURES_SQL) + f"""
SELECT {SERIES}, order_date, """ + ", ".join(
    f"{rnd(f'revenue_roll_{k}_{n}', 4)} AS revenue_roll_{k}_{n}"
    for n in (7, 14, 30) for k in ("mean", "std")) + " FROM feats_all"

ORACLE["feature_matrix"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL, FEATURES_SQL) + f"""
SELECT {SERIES}, order_date, """ + ", ".join(
    (f"{rnd(c, 4)} AS {c}" if ("lag" in c or "roll" in c or c in ("revenue", "quantity")) else c)
    for c in ["revenue", "quantity"] + FEATURE_NAMES) + " FROM feats"

ORACLE["chrono_split"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL, FEATURES_SQL) + f"""
, numbered AS (
  SELECT {SERIES}, order_date,
         row_number() OVER ({W_SERIES}) AS rn,
         count(*) OVER (PARTITION BY {SERIES}) AS n
  FROM feats
)
SELECT {SERIES}, order_date,
       rn <= CASE WHEN greatest(CAST(floor(n * 0.8) AS BIGINT), 1) >= n THEN n - 1
                  ELSE greatest(CAST(floor(n * 0.8) AS BIGINT), 1) END AS is_train
FROM numbered"""


# --- Metrics, registry, selection ------------------------------------------------

def _split_sql(keys: str, test_size: float, src: str = "feats") -> str:
    frac = 1.0 - test_size
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY order_date) AS rn,
         count(*) OVER (PARTITION BY {keys}) AS n
  FROM {src}
) WHERE rn > CASE WHEN greatest(CAST(floor(n * {frac!r}) AS BIGINT), 1) >= n THEN n - 1
                  ELSE greatest(CAST(floor(n * {frac!r}) AS BIGINT), 1) END"""


def _naive_metrics_sql(keys: str, test_size: float, name: str) -> str:
    preds = " UNION ALL ".join(
        f"SELECT {keys}, order_date, revenue, 'naive_lag_{k}' AS algorithm, "
        f"revenue_lag_{k} AS prediction FROM {name}_test" for k in (1, 7, 14))
    return f"""
{name}_test AS ({_split_sql(keys, test_size)}),
{name}_preds AS ({preds}),
{name}_mean AS (SELECT {keys}, algorithm, avg(revenue) AS mean_y FROM {name}_preds GROUP BY ALL),
{name} AS (
  SELECT {keys}, algorithm,
         avg(abs(revenue - prediction)) AS mae,
         sqrt(avg((revenue - prediction) * (revenue - prediction))) AS rmse,
         avg(CASE WHEN revenue <> 0 THEN abs((revenue - prediction) / revenue) END) * 100 AS mape,
         CASE WHEN sum((revenue - mean_y) * (revenue - mean_y)) > 0
              THEN 1 - sum((revenue - prediction) * (revenue - prediction))
                       / sum((revenue - mean_y) * (revenue - mean_y)) END AS r2
  FROM {name}_preds JOIN {name}_mean USING ({keys}, algorithm)
  GROUP BY ALL
)"""


def _metric_cols(prefix: str = "") -> str:
    return ", ".join(f"{rnd(prefix + m, 4)} AS {m}" for m in ("mae", "rmse", "mape", "r2"))


ORACLE["eval_metrics"] = with_ctes(
    SALES_VIEW_SQL, daily_sql(SERIES), features_sql(SERIES),
    _naive_metrics_sql(SERIES, 0.2, "m1")) + f"""
SELECT {SERIES}, algorithm, {_metric_cols()} FROM m1"""

CONFIDENCE_SQL = """CASE WHEN {m} IS NULL THEN 0.5
     ELSE """ + rnd("least(greatest(0.0, 1 - {m} / 100), 0.99)", 3) + " END"

ORACLE["confidence_score"] = with_ctes(
    SALES_VIEW_SQL, daily_sql("dataset_id", "dd"), features_sql("dataset_id", "dd", "fd"),
    _naive_metrics_sql("dataset_id", 0.2, "m1").replace("FROM feats", "FROM fd")) + f"""
SELECT dataset_id, algorithm, {rnd("mape", 4)} AS mape,
       {CONFIDENCE_SQL.format(m="mape")} AS confidence_score
FROM m1"""


def _registry_sql() -> str:
    runs = []
    for run, ts in ((1, 0.2), (2, 0.3)):
        runs.append(_naive_metrics_sql("dataset_id", ts, f"r{run}").replace("FROM feats", "FROM fd"))
    body = ",\n".join(runs)
    ranked = " UNION ALL ".join(
        f"""SELECT r{run}.*, {run} AS run,
       row_number() OVER (PARTITION BY dataset_id ORDER BY mae ASC NULLS LAST,
         CASE algorithm WHEN 'naive_lag_1' THEN 0 WHEN 'naive_lag_7' THEN 1 ELSE 2 END) = 1
       AND mae IS NOT NULL AS is_active
FROM r{run}""" for run in (1, 2))
    return body + f""",
last_day AS (SELECT dataset_id, max(order_date) AS last FROM fd GROUP BY dataset_id),
ranked AS ({ranked}),
reg0 AS (
  SELECT k.*, CAST(l.last AS TIMESTAMP) + to_hours(k.run) AS trained_at
  FROM ranked k JOIN last_day l USING (dataset_id)
),
registry AS (
  SELECT dataset_id,
         dataset_id || ':' || strftime(trained_at, '%Y%m%d%H%M%S') || '_'
           || substr(md5(dataset_id), 1, 6) || ':' || algorithm AS model_id,
         algorithm,
         strftime(trained_at, '%Y%m%d%H%M%S') || '_' || substr(md5(dataset_id), 1, 6) AS version,
         CAST(NULL AS VARCHAR) AS file_path, 'ready' AS status,
         mae, rmse, mape, r2,
         '{{"lag":' || regexp_extract(algorithm, '([0-9]+)$', 1) || '}}' AS hyperparameters,
         is_active, trained_at
  FROM reg0
),
latest AS (SELECT dataset_id, max(trained_at) AS latest FROM registry GROUP BY dataset_id),
registry_now AS (
  SELECT r.* REPLACE (r.is_active AND r.trained_at = l.latest AS is_active)
  FROM registry r JOIN latest l USING (dataset_id)
)"""


REGISTRY_CTES = with_ctes(
    SALES_VIEW_SQL, daily_sql("dataset_id", "dd"), features_sql("dataset_id", "dd", "fd"),
    _registry_sql())

REGISTRY_COLS = ("dataset_id, model_id, algorithm, version, file_path, status, "
                 + _metric_cols() + ", hyperparameters, is_active, trained_at")

ORACLE["pick_best"] = REGISTRY_CTES + f"""
SELECT {REGISTRY_COLS} FROM registry"""

ORACLE["compare_models"] = REGISTRY_CTES + f"""
SELECT {REGISTRY_COLS} FROM registry_now"""

ORACLE["resolve_model"] = REGISTRY_CTES + f"""
SELECT {REGISTRY_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY trained_at DESC, model_id DESC) AS k
  FROM registry_now WHERE status = 'ready' AND is_active
) WHERE k = 1"""

ORACLE["resolve_model_named"] = REGISTRY_CTES + f"""
SELECT {REGISTRY_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY trained_at DESC, model_id DESC) AS k
  FROM registry_now WHERE status = 'ready' AND algorithm = 'naive_lag_7'
) WHERE k = 1"""


# --- Forecast band on the seasonal-naive registry ------------------------------

ORACLE["forecast_band"] = REGISTRY_CTES + f"""
, active AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY trained_at DESC, model_id DESC) AS k
    FROM registry_now WHERE status = 'ready' AND is_active
  ) WHERE k = 1
), lastd AS (SELECT dataset_id, max(order_date) AS last FROM dd GROUP BY dataset_id),
steps AS (
  SELECT a.dataset_id, a.rmse, a.mape, CAST(regexp_extract(a.algorithm, '([0-9]+)$', 1) AS INT) AS lag,
         l.last, unnest(generate_series(1, 30)) AS step
  FROM active a JOIN lastd l USING (dataset_id)
), pts AS (
  SELECT s.*, CAST(s.last + to_days(CAST(s.step AS INT)) AS DATE) AS target_date,
         coalesce(d.revenue, 0.0) AS pred
  FROM steps s LEFT JOIN dd d ON d.dataset_id = s.dataset_id
   AND d.order_date = CAST(s.last + to_days(CAST(s.step - s.lag * ceil(s.step / s.lag) AS INT)) AS DATE)
), sd AS (SELECT dataset_id, stddev_samp(pred) AS sd FROM pts GROUP BY dataset_id),
banded AS (
  SELECT p.*, CASE WHEN p.rmse IS NOT NULL AND p.rmse <> 0 THEN p.rmse
                   WHEN sd.sd IS NOT NULL AND NOT isnan(sd.sd) AND sd.sd <> 0 THEN sd.sd
                   ELSE 1.0 END * sqrt(p.step) AS band
  FROM pts p JOIN sd USING (dataset_id)
)
SELECT dataset_id, CAST(step AS INT) AS step, target_date AS date,
       {rnd("pred")} AS predicted_revenue,
       {rnd("greatest(pred - band, 0.0)")} AS lower_bound,
       {rnd("pred + band")} AS upper_bound,
       {CONFIDENCE_SQL.format(m="mape")} AS confidence_score
FROM banded"""

ORACLE["kpi_forecast_accuracy"] = REGISTRY_CTES + f"""
, active AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY trained_at DESC, model_id DESC) AS k
    FROM registry_now WHERE status = 'ready' AND is_active
  ) WHERE k = 1
)
SELECT s.dataset_id, {rnd("sum(s.revenue)")} AS total_revenue,
       CASE WHEN any_value(a.mape) IS NULL THEN NULL
            ELSE {rnd("greatest(0.0, 100 - any_value(a.mape))")} END AS forecast_accuracy_pct
FROM sales s LEFT JOIN active a USING (dataset_id) GROUP BY s.dataset_id"""


# --- Ingest -----------------------------------------------------------------------

INGEST_SQL = """
fmt AS (
  SELECT dataset_id,
         CASE WHEN try_strptime(first_s, '%Y-%m-%d') IS NOT NULL THEN 1
              WHEN try_strptime(first_s, '%m/%d/%Y') IS NOT NULL THEN 6 END AS f
  FROM (SELECT dataset_id, arg_min(order_date_s, _row) AS first_s
        FROM raw WHERE order_date_s IS NOT NULL GROUP BY dataset_id)
), typed AS (
  SELECT r.*,
    CASE WHEN f.f = 1 THEN try_strptime(order_date_s, '%Y-%m-%d')
         WHEN f.f = 6 THEN try_strptime(order_date_s, '%m/%d/%Y')
         ELSE coalesce(try_strptime(order_date_s, '%Y-%m-%d'),
                       try_strptime(order_date_s, '%m/%d/%Y')) END AS ts,
    CASE WHEN rev IS NULL AND qty > 0 AND price > 0 THEN qty * price ELSE rev END AS rev2
  FROM raw r LEFT JOIN fmt f USING (dataset_id)
), filled AS (
  SELECT *, coalesce(qty, 1.0) AS q, coalesce(price, rev2) AS p, coalesce(rev2, 0.0) AS r
  FROM typed
)"""

ORACLE["ingest_clean"] = with_ctes(DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL, INGEST_SQL) + f"""
SELECT dataset_id, CAST(ts AS DATE) AS order_date,
       coalesce(product_s, 'Unknown Product') AS product,
       coalesce(category_s, 'Uncategorized') AS category,
       coalesce(region_s, 'Unknown Region') AS region,
       {rnd("q")} AS quantity, {rnd("p")} AS unit_price, {rnd("r")} AS revenue,
       CAST(NULL AS DOUBLE) AS cost
FROM filled WHERE ts IS NOT NULL AND r >= 0"""

ORACLE["ingest_report"] = with_ctes(DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL, INGEST_SQL) + """
, counts AS (
  SELECT dataset_id, count(*) AS total,
         count(*) FILTER (WHERE ts IS NULL) AS bad,
         count(*) FILTER (WHERE ts IS NOT NULL AND r < 0) AS neg
  FROM filled GROUP BY dataset_id
)
SELECT dataset_id, total - bad - neg > 0 AS is_valid, CAST(total AS BIGINT) AS total_rows,
       CAST(total - bad - neg AS BIGINT) AS valid_rows, CAST(bad + neg AS BIGINT) AS invalid_rows,
       concat_ws(' | ',
         CASE WHEN bad > 0 THEN 'Dropped ' || bad || ' row(s) with unparseable dates.' END,
         CASE WHEN neg > 0 THEN 'Dropped ' || neg || ' row(s) with negative revenue.' END)
         AS warnings,
       CAST(CASE WHEN total - bad - neg = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors
FROM counts"""

FALLBACK_SQL = """
fb AS (
  SELECT c_mktsegment AS dataset_id, _row,
         CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS order_date,
         l_extendedprice AS zeta,
         CASE WHEN _row % 211 = 0 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS alpha
  FROM base
)"""

ORACLE["ingest_fallback"] = with_ctes(DIRTY_BASE_SQL, FALLBACK_SQL) + f"""
SELECT dataset_id, order_date, 'Unknown Product' AS product, 'Uncategorized' AS category,
       'Unknown Region' AS region, CAST(1.0 AS DOUBLE) AS quantity,
       {rnd("zeta")} AS unit_price, {rnd("zeta")} AS revenue, CAST(NULL AS DOUBLE) AS cost
FROM fb WHERE zeta >= 0"""

ORACLE["ingest_fallback_report"] = with_ctes(DIRTY_BASE_SQL, FALLBACK_SQL) + """
SELECT dataset_id, count(*) FILTER (WHERE zeta >= 0) > 0 AS is_valid,
       CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE zeta >= 0) AS BIGINT) AS valid_rows,
       CAST(count(*) FILTER (WHERE zeta < 0) AS BIGINT) AS invalid_rows,
       'Revenue auto-mapped from numeric column ''Zeta''.' AS warnings,
       CAST(0 AS BIGINT) AS n_errors
FROM fb GROUP BY dataset_id"""


# --- Listings, activity, delete, JSON ------------------------------------------------

ORACLE["owner_filter"] = with_ctes(DATASETS_VIEW_SQL) + """
SELECT * FROM datasets WHERE owner_id = 1"""

ORACLE["recent_activity_user"] = with_ctes(ACTIVITY_VIEW_SQL) + """
SELECT user_id, rank, event_id, action, details, created_at FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC)
                 AS INT) AS rank
  FROM activity
) WHERE rank <= 200"""

ORACLE["recent_activity_all"] = with_ctes(ACTIVITY_VIEW_SQL) + """
SELECT user_id, event_id, action, details, ip_address, created_at
FROM activity ORDER BY created_at DESC, event_id DESC LIMIT 500"""

ORACLE["cascade_delete"] = with_ctes(SALES_VIEW_SQL, DATASETS_VIEW_SQL) + f"""
SELECT dataset_id, CAST(count(*) AS BIGINT) AS rows, {rnd("sum(revenue)")} AS revenue
FROM sales WHERE dataset_id NOT IN (SELECT dataset_id FROM datasets WHERE owner_id = 1)
GROUP BY dataset_id"""

ORACLE["json_roundtrip"] = with_ctes(DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL, INGEST_SQL) + """
, counts AS (
  SELECT dataset_id, count(*) AS total,
         count(*) FILTER (WHERE ts IS NULL) AS bad,
         count(*) FILTER (WHERE ts IS NOT NULL AND r < 0) AS neg
  FROM filled GROUP BY dataset_id
)
SELECT dataset_id, total - bad - neg > 0 AS is_valid, CAST(total AS BIGINT) AS total_rows,
       CAST(total - bad - neg AS BIGINT) AS valid_rows, CAST(bad + neg AS BIGINT) AS invalid_rows,
       CAST((bad > 0)::INT + (neg > 0)::INT AS BIGINT) AS n_warnings,
       'Total Sales' AS revenue_source, 'Qty' AS quantity_source
FROM counts"""


ORACLE["daily_ffill"] = with_ctes(SALES_VIEW_SQL, DAILY_SERIES_SQL) + f"""
, gaps AS (
  SELECT c.dataset_id, c.region, c.order_date, d.revenue, d.quantity
  FROM daily_cal c LEFT JOIN daily_raw d
    ON c.dataset_id = d.dataset_id AND c.region = d.region AND c.order_date = d.order_date
)
SELECT dataset_id, region, order_date,
  {rnd("last_value(revenue IGNORE NULLS) OVER (PARTITION BY dataset_id, region ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS revenue,
  {rnd("last_value(quantity IGNORE NULLS) OVER (PARTITION BY dataset_id, region ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS quantity
FROM gaps"""


ORACLE["derive_revenue"] = with_ctes(DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL, INGEST_SQL) + f"""
SELECT dataset_id,
       CASE WHEN rev IS NOT NULL THEN 'reported'
            WHEN qty > 0 AND price > 0 THEN 'derived'
            ELSE 'filled' END AS revenue_source,
       CAST(count(*) AS BIGINT) AS rows, {rnd("sum(r)")} AS revenue
FROM filled WHERE ts IS NOT NULL AND r >= 0
GROUP BY ALL"""


# --- SRC6, SRC3, FCT1, AGG5 -------------------------------------------------------

ORACLE["stream_ingest"] = with_ctes(DIRTY_BASE_SQL, DIRTY_UPLOAD_SQL, INGEST_SQL) + f"""
SELECT lower(dataset_id) AS segment, 'processed' AS status, count(*) AS row_count, count(*) AS stored_rows,
       {rnd("sum(r)")} AS revenue
FROM filled WHERE ts IS NOT NULL AND r >= 0 GROUP BY dataset_id"""

ORACLE["sales_scan"] = SALES + f"""
SELECT dataset_id, order_date, product, category, region, {rnd("quantity")} AS quantity,
       {rnd("unit_price")} AS unit_price, {rnd("revenue")} AS revenue
FROM sales WHERE dataset_id = 'BUILDING' AND region = 'ASIA'"""

ORACLE["segment_daily"] = SALES + f"""
SELECT dataset_id, 'category=' || coalesce(category, 'all') || ';region=' || coalesce(region, 'all') AS segment,
       order_date, {rnd("sum(revenue)")} AS revenue, {rnd("sum(quantity)")} AS quantity
FROM sales GROUP BY dataset_id, order_date, GROUPING SETS ((category, region), (category), (region), ())
HAVING (grouping(category) = 1 OR category IS NOT NULL) AND (grouping(region) = 1 OR region IS NOT NULL)"""

ORACLE["dashboard_sections"] = " UNION ALL ".join([
    f"SELECT dataset_id, 'revenue_trend' AS section, CAST(period AS VARCHAR) AS label, revenue, units, "
    f"CAST(NULL AS DOUBLE) AS share_pct FROM ({ORACLE['trend_monthly']})",
    *[f"SELECT dataset_id, '{section}' AS section, label, revenue, units, share_pct FROM ({ORACLE[name]})"
      for section, name in (("by_category", "breakdown_category"), ("by_region", "breakdown_region"), ("by_product", "top_products"))]])

ORACLE["latest_activity"] = ORACLE["recent_activity_all"]
