"""DuckDB SQL oracles, one per named query that SQL can express.

The views ``region nation customer supplier part orders lineitem events ...``
are registered by the checker. Every statement recomputes its inputs from the
raw tables with the same bindings as ``seriesspark.sources.bindings``.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- shared CTEs

ENRICHED = """
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_extendedprice AS price, round(l_extendedprice * l_tax, 4) AS freight_value,
         l_shipdate AS order_delivered_customer_date
  FROM lineitem),
pay AS (
  SELECT l_orderkey AS order_id,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS payment_value
  FROM lineitem GROUP BY 1),
rev AS (
  SELECT o_orderkey AS order_id, avg(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS review_score
  FROM orders GROUP BY 1),
enriched AS (
  SELECT i.*, i.price + i.freight_value AS item_total,
         o.o_custkey AS customer_id, o.o_orderstatus AS order_status,
         o.o_orderdate AS order_purchase_timestamp,
         pay.payment_value, rev.review_score,
         date_diff('second', o.o_orderdate, i.order_delivered_customer_date) AS delivery_secs,
         date_diff('second', o.o_orderdate, i.order_delivered_customer_date) / 86400.0 AS delivery_days,
         CAST(date_trunc('month', o.o_orderdate) AS TIMESTAMP) AS month
  FROM items i JOIN orders o ON i.order_id = o.o_orderkey
  LEFT JOIN pay ON pay.order_id = i.order_id
  LEFT JOIN rev ON rev.order_id = i.order_id
  WHERE o.o_orderstatus = 'F')
"""

SELLER_RAW = """
raw AS (
  SELECT seller_id, month,
         CAST(sum(CAST(item_total AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
         count(DISTINCT order_id) AS order_count,
         count(order_id) AS item_count,
         round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price), 6) AS avg_price,
         round(CAST(sum(CAST(freight_value AS DECIMAL(18,4))) AS DOUBLE) / count(freight_value), 6) AS avg_freight,
         round(CAST(sum(delivery_secs) AS DOUBLE) / count(delivery_secs) / 86400.0, 6) AS avg_delivery_days,
         round(avg(review_score), 6) AS avg_review_score,
         count(DISTINCT product_id) AS n_unique_products,
         count(DISTINCT customer_id) AS n_unique_customers
  FROM enriched WHERE seller_id IS NOT NULL AND month IS NOT NULL
  GROUP BY seller_id, month)
"""


def seller_panel_ctes(min_active: int) -> str:
    """CTE list ending in ``panel``: the gap-filled seller panel."""
    return f"""{ENRICHED.strip()},
{SELLER_RAW.strip()},
active AS (SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY seller_id) >= {min_active}),
grid AS (
  SELECT s.seller_id, CAST(g.month AS TIMESTAMP) AS month
  FROM (SELECT DISTINCT seller_id FROM active) s,
       (SELECT unnest(generate_series((SELECT min(month) FROM enriched),
                                      (SELECT max(month) FROM enriched), INTERVAL 1 MONTH)) AS month) g),
joined AS (SELECT g.seller_id, g.month, a.* EXCLUDE (seller_id, month)
           FROM grid g LEFT JOIN active a USING (seller_id, month)),
panel AS (SELECT seller_id, month,
  coalesce(revenue, 0) AS revenue, coalesce(order_count, 0) AS order_count,
  coalesce(item_count, 0) AS item_count,
  {', '.join(f'''coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY seller_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value({c} IGNORE NULLS) OVER (PARTITION BY seller_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}'''
             for c in ['avg_price', 'avg_freight', 'avg_delivery_days', 'avg_review_score'])},
  coalesce(n_unique_products, 0) AS n_unique_products,
  coalesce(n_unique_customers, 0) AS n_unique_customers
FROM joined)"""


def seller_panel_sql(min_active: int) -> str:
    return f"WITH {seller_panel_ctes(min_active)}\nSELECT * FROM panel"


ORACLES["enriched_items"] = f"""
WITH {ENRICHED.strip()}
SELECT e.order_id, e.product_id, e.seller_id, e.price, e.freight_value,
       e.order_delivered_customer_date, e.item_total, e.customer_id, e.order_status,
       e.order_purchase_timestamp, e.payment_value, e.review_score,
       p.p_type AS product_category_name, sn.n_name AS seller_state, cn.n_name AS customer_state,
       e.delivery_secs, e.delivery_days, e.month
FROM enriched e
LEFT JOIN part p ON p.p_partkey = e.product_id
LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) sn ON sn.s_suppkey = e.seller_id
LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) cn ON cn.c_custkey = e.customer_id
"""

ORACLES["monthly_series"] = f"""
WITH {ENRICHED.strip()}
SELECT month,
  CAST(sum(CAST(item_total AS DECIMAL(18,4))) AS DOUBLE) AS total_delivered_value,
  count(DISTINCT order_id) AS new_orders_created,
  count(order_id) AS delivered_count,
  round(CAST(sum(delivery_secs) AS DOUBLE) / count(delivery_secs) / 86400.0, 6) AS avg_delivery_days,
  round(avg(review_score), 6) AS avg_review_score,
  count(DISTINCT seller_id) AS n_unique_sellers,
  count(DISTINCT product_id) AS n_unique_products,
  round(CAST(sum(CAST(freight_value AS DECIMAL(18,4))) AS DOUBLE) / count(freight_value), 6) AS avg_freight
FROM enriched WHERE month IS NOT NULL GROUP BY month
"""

ORACLES["seller_monthly_panel"] = seller_panel_sql(8)
ORACLES["seller_monthly_panel_70"] = seller_panel_sql(70)


# ---------------------------------------------------------------- seller forecasting

SELLER_SPLIT = seller_panel_ctes(8) + """,
ranked AS (SELECT seller_id, month, revenue,
                  row_number() OVER (PARTITION BY seller_id ORDER BY month DESC) AS rn_desc
           FROM panel),
train AS (SELECT seller_id, month, revenue FROM ranked WHERE rn_desc > 3),
test AS (SELECT seller_id, month, revenue FROM ranked WHERE rn_desc <= 3),
tr AS (SELECT seller_id, month, revenue,
              row_number() OVER (PARTITION BY seller_id ORDER BY month DESC) AS rd,
              count(*) OVER (PARTITION BY seller_id) AS n,
              revenue - lag(revenue, 1) OVER (PARTITION BY seller_id ORDER BY month) AS e1,
              revenue - lag(revenue, 12) OVER (PARTITION BY seller_id ORDER BY month) AS em
       FROM train),
summ AS (SELECT seller_id, max(month) AS last_ds, count(*) AS n, arg_max(revenue, month) AS last_y,
                avg(e1 * e1) AS s2n, avg(em * em) AS s2s FROM tr GROUP BY seller_id),
hz AS (SELECT s.*, r.k, CAST(s.last_ds + to_months(CAST(r.k AS INTEGER)) AS TIMESTAMP) AS month
       FROM summ s, range(1, 4) r(k)),
fc AS (SELECT hz.seller_id, hz.month, hz.k, hz.last_y AS naive,
              CASE WHEN hz.n >= 12 THEN tr.revenue END AS snaive,
              sqrt(hz.s2n) * sqrt(hz.k) AS sd_n,
              sqrt(hz.s2s) * sqrt(floor((hz.k - 1) / 12) + 1) AS sd_s
       FROM hz LEFT JOIN tr ON tr.seller_id = hz.seller_id AND tr.rd = 12 - ((hz.k - 1) % 12)),
preds AS (SELECT seller_id, month, naive AS predictions, 'Naive' AS approach FROM fc
          UNION ALL SELECT seller_id, month, snaive, 'SeasonalNaive' FROM fc)
"""

ORACLES["holdout_split"] = "WITH " + SELLER_SPLIT + """
SELECT seller_id, month, revenue, CASE WHEN rn_desc <= 3 THEN 'test' ELSE 'train' END AS split FROM ranked
"""

ORACLES["first_n_per_series"] = "WITH " + seller_panel_ctes(8) + """
SELECT seller_id, month, revenue FROM panel
QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY month) <= 2
"""

METRIC_COLS = """
  round(avg(abs(t.revenue - p.predictions)), 6) AS mae,
  round(sqrt(avg((t.revenue - p.predictions) * (t.revenue - p.predictions))), 6) AS rmse,
  round(avg(CASE WHEN t.revenue > 0 THEN abs(t.revenue - p.predictions) / t.revenue END), 6) AS mape,
  count(DISTINCT t.seller_id) AS n_series, count(*) AS n_predictions"""

ORACLES["seller_forecast_metrics"] = "WITH " + SELLER_SPLIT + f"""
SELECT {METRIC_COLS}
FROM test t JOIN preds p ON p.seller_id = t.seller_id AND p.month = t.month AND p.approach = 'Naive'
"""

ORACLES["approach_comparison"] = "WITH " + SELLER_SPLIT + f"""
SELECT p.approach, {METRIC_COLS}
FROM test t JOIN preds p ON p.seller_id = t.seller_id AND p.month = t.month
WHERE p.predictions IS NOT NULL OR true
GROUP BY p.approach
"""

ORACLES["cross_rows"] = "WITH " + SELLER_SPLIT + """,
sample AS (SELECT DISTINCT seller_id FROM test ORDER BY seller_id LIMIT 50)
SELECT t.seller_id, t.month, t.revenue, p.predictions, p.approach
FROM test t JOIN preds p ON p.seller_id = t.seller_id AND p.month = t.month
WHERE t.seller_id IN (SELECT seller_id FROM sample)
"""

ORACLES["top_sellers"] = "WITH " + SELLER_SPLIT + """
SELECT seller_id, round(sum(revenue), 6) AS total,
       'Seller ' || substr(CAST(seller_id AS VARCHAR), 1, 8) || '...' AS label
FROM train GROUP BY seller_id ORDER BY total DESC, seller_id LIMIT 4
"""

ORACLES["naive_intervals"] = "WITH " + SELLER_SPLIT + """
SELECT seller_id, month,
  round(naive, 6) AS "Naive",
  round(naive - 1.2815515655446004 * sd_n, 6) AS "Naive-lo-80",
  round(naive + 1.2815515655446004 * sd_n, 6) AS "Naive-hi-80",
  round(snaive, 6) AS "SeasonalNaive",
  round(snaive - 1.2815515655446004 * sd_s, 6) AS "SeasonalNaive-lo-80",
  round(snaive + 1.2815515655446004 * sd_s, 6) AS "SeasonalNaive-hi-80"
FROM fc
"""

ORACLES["fitted_values"] = "WITH " + seller_panel_ctes(8) + """
SELECT seller_id, month, revenue,
  lag(revenue, 1) OVER (PARTITION BY seller_id ORDER BY month) AS "Naive",
  lag(revenue, 12) OVER (PARTITION BY seller_id ORDER BY month) AS "SeasonalNaive"
FROM panel
"""

ORACLES["quantile_forecast"] = "WITH " + SELLER_SPLIT + """,
res AS (SELECT seller_id,
          lead(revenue, 1) OVER w - revenue AS r1,
          lead(revenue, 2) OVER w - revenue AS r2,
          lead(revenue, 3) OVER w - revenue AS r3
        FROM train WINDOW w AS (PARTITION BY seller_id ORDER BY month)),
q AS (SELECT seller_id,
        [quantile_cont(r1, 0.1), quantile_cont(r1, 0.5), quantile_cont(r1, 0.9)] AS q1,
        [quantile_cont(r2, 0.1), quantile_cont(r2, 0.5), quantile_cont(r2, 0.9)] AS q2,
        [quantile_cont(r3, 0.1), quantile_cont(r3, 0.5), quantile_cont(r3, 0.9)] AS q3
      FROM res GROUP BY seller_id),
j AS (SELECT fc.seller_id, fc.month, fc.naive,
             CASE fc.k WHEN 1 THEN q.q1 WHEN 2 THEN q.q2 ELSE q.q3 END AS qq
      FROM fc JOIN q USING (seller_id))
SELECT seller_id, month,
  round(naive + qq[1], 6) AS "0.1", round(naive + qq[2], 6) AS "0.5",
  round(naive + qq[3], 6) AS "0.9", round(naive + qq[2], 6) AS predictions
FROM j
"""


# ---------------------------------------------------------------- daily panel and features

DAILY = """
daily AS (SELECT CAST(l_suppkey AS VARCHAR) AS unique_id, l_shipdate AS ds, sum(l_quantity) AS y
          FROM lineitem GROUP BY 1, 2),
dgrid AS (SELECT i.unique_id, CAST(unnest(generate_series((SELECT min(ds) FROM daily), (SELECT max(ds) FROM daily),
                                                        INTERVAL 1 DAY)) AS TIMESTAMP) AS ds
          FROM (SELECT DISTINCT unique_id FROM daily) i),
dpanel AS (SELECT g.unique_id, g.ds, coalesce(d.y, 0) AS y FROM dgrid g LEFT JOIN daily d USING (unique_id, ds))
"""

W_ID = "PARTITION BY unique_id ORDER BY ds"


def _lag(k: int) -> str:
    return f"lag(y, {k}) OVER ({W_ID}) AS lag{k}"


def _exp(k: int) -> str:
    return f"avg(y) OVER ({W_ID} ROWS BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING) AS expanding_mean_lag{k}"


def _roll(k: int, w: int) -> str:
    fr = f"({W_ID} ROWS BETWEEN {k + w - 1} PRECEDING AND {k} PRECEDING)"
    return f"CASE WHEN count(y) OVER {fr} = {w} THEN avg(y) OVER {fr} END AS rolling_mean_lag{k}_window_size{w}"


ORACLES["fill_gaps_global"] = "WITH " + DAILY.strip() + "\nSELECT * FROM dpanel"

_LAG_FEATS = ["lag1", "lag2", "lag3", "lag7", "lag14", "lag30", "lag360", "expanding_mean_lag7",
              "rolling_mean_lag14_window_size7", "rolling_mean_lag30_window_size14"]
ORACLES["lag_features"] = "WITH " + DAILY.strip() + f""",
attrs AS (SELECT CAST(s_suppkey AS VARCHAR) AS unique_id, n_name AS state_id, r_name AS cat_id
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT p.unique_id, p.ds, p.y, a.state_id, a.cat_id,
        {', '.join(_lag(k) for k in [1, 2, 3, 7, 14, 30, 360])},
        {_exp(7)}, {_roll(14, 7)}, {_roll(30, 14)}
      FROM dpanel p JOIN attrs a USING (unique_id))
SELECT * FROM f WHERE y IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in _LAG_FEATS)}
"""

_DIFF_FEATS = ["lag3", "lag6", "expanding_mean_lag3", "rolling_mean_lag3_window_size3",
               "expanding_mean_lag6", "rolling_mean_lag6_window_size6", "quarter", "daysinmonth"]
ORACLES["differenced_features"] = "WITH " + DAILY.strip() + f""",
dd AS (SELECT unique_id, ds, y - lag(y, 1) OVER ({W_ID}) AS y FROM dpanel),
f AS (SELECT unique_id, ds, y, {_lag(3)}, {_lag(6)}, {_exp(3)}, {_roll(3, 3)}, {_exp(6)}, {_roll(6, 6)},
        CAST(quarter(ds) AS INTEGER) AS quarter, CAST(day(last_day(ds)) AS INTEGER) AS daysinmonth
      FROM dd)
SELECT * FROM f WHERE y IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in _DIFF_FEATS)}
"""

# ---------------------------------------------------------------- 10-minute panel

TENMIN = """
ev AS (SELECT event_type AS unique_id, CAST(time_bucket(INTERVAL 10 MINUTE, ts) AS TIMESTAMP) AS ds,
              CAST((sum(CAST(round(value * 100) AS BIGINT)) * 200 + count(value)) // (2 * count(value)) AS DOUBLE)
                / 10000.0 AS y
       FROM events GROUP BY 1, 2),
qs AS (SELECT unique_id, quantile_cont(y, 0.05) AS q_lo, quantile_cont(y, 0.95) AS q_hi FROM ev GROUP BY 1),
clean AS (SELECT e.unique_id, e.ds,
             CASE WHEN e.unique_id NOT IN ('error')
                   AND (e.y < q_lo - 1.5 * (q_hi - q_lo) OR e.y > q_hi + 1.5 * (q_hi - q_lo))
                  THEN NULL ELSE e.y END AS y
          FROM ev e LEFT JOIN qs USING (unique_id)),
rgrid AS (SELECT unique_id, CAST(unnest(generate_series(lo, hi, INTERVAL 10 MINUTE)) AS TIMESTAMP) AS ds
          FROM (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM clean GROUP BY 1)),
rj AS (SELECT g.unique_id, g.ds, c.y FROM rgrid g LEFT JOIN clean c USING (unique_id, ds)),
reg AS (SELECT unique_id, ds,
          coalesce(last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
        FROM rj)
""".replace("{W}", W_ID)

# The event types, which are the columns of the wide panel.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

ORACLES["outlier_mask"] = "WITH " + TENMIN.strip() + "\nSELECT * FROM clean"
ORACLES["regular_grid"] = "WITH " + TENMIN.strip() + "\nSELECT * FROM reg"


def _rolling(w: int) -> str:
    fr = f"({W_ID} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT unique_id, ds, y, {w} AS window,
  CASE WHEN count(y) OVER {fr} = {w}
       THEN CAST(sum(CAST(y AS DECIMAL(18,4))) OVER {fr} AS DOUBLE) / count(y) OVER {fr} END AS rolling_mean,
  round(CASE WHEN count(y) OVER {fr} = {w} THEN stddev_samp(y) OVER {fr} END, 6) AS rolling_std,
  '{w // 144} days' AS window_label FROM reg"""


ORACLES["rolling_stats"] = "WITH " + TENMIN.strip() + "\n" + _rolling(144) + "\nUNION ALL\n" + _rolling(720)

_FULL = f"({W_ID} ROWS BETWEEN 72 PRECEDING AND 72 FOLLOWING)"
DECOMPOSE_SQL = "WITH " + TENMIN.strip() + f""",
st AS (SELECT unique_id, ds, y, count(*) OVER (PARTITION BY unique_id) AS n,
         (row_number() OVER ({W_ID}) - 1) % 144 AS phase,
         CASE WHEN count(y) OVER {_FULL} = 145
              THEN ((sum(y::DECIMAL(18,4)) OVER {_FULL})::DOUBLE - 0.5 * lag(y, 72) OVER ({W_ID}) - 0.5 * lead(y, 72) OVER ({W_ID})) / 144
         END AS trend
       FROM reg),
st2 AS (SELECT * FROM st WHERE n >= 288),
ph AS (SELECT unique_id, phase, avg(y - trend) AS s FROM st2 GROUP BY 1, 2),
ph2 AS (SELECT unique_id, phase, s - avg(s) OVER (PARTITION BY unique_id) AS s FROM ph)
SELECT st2.unique_id, st2.ds, round(st2.y, 6) AS y, round(st2.trend, 6) AS trend, round(ph2.s, 6) AS seasonal,
       round(st2.y - st2.trend - ph2.s, 6) AS resid
FROM st2 JOIN ph2 USING (unique_id, phase)
"""

ORACLES["acf"] = "WITH " + TENMIN.strip() + f""",
dv AS (SELECT unique_id, ds, y - avg(y) OVER (PARTITION BY unique_id) AS d FROM reg WHERE y IS NOT NULL),
pr AS (SELECT unique_id, d, {', '.join(f'd * lag(d, {k}) OVER ({W_ID}) AS p{k}' for k in range(1, 15))} FROM dv),
sm AS (SELECT unique_id, count(*) AS n, sum(d * d) AS p0, {', '.join(f'sum(p{k}) AS p{k}' for k in range(1, 15))}
       FROM pr GROUP BY 1)
""" + "\nUNION ALL\n".join(
    f"SELECT unique_id, {k} AS lag, round((p{k} / (n - {k})) / (p0 / n), 6) AS acf FROM sm" for k in range(15))

ORACLES["corr_matrix"] = "WITH " + TENMIN.strip() + """
SELECT t.unique_id AS target, s.unique_id, round(corr(s.y, t.y), 6) AS corr
FROM reg s JOIN reg t ON s.ds = t.ds GROUP BY 1, 2
"""

ORACLES["corr_top"] = "WITH " + TENMIN.strip() + """
SELECT 'click' AS target, s.unique_id, round(corr(s.y, t.y), 6) AS corr, round(abs(corr(s.y, t.y)), 6) AS abs_corr
FROM reg s JOIN (SELECT ds, y FROM reg WHERE unique_id = 'click') t ON s.ds = t.ds
GROUP BY s.unique_id ORDER BY abs_corr DESC, s.unique_id LIMIT 10
"""

ORACLES["wide_panel"] = "WITH " + TENMIN.strip() + "\nSELECT ds, " + ", ".join(
    f"max(y) FILTER (WHERE unique_id = '{e}') AS \"{e}\"" for e in EVENT_TYPES) + "\nFROM reg GROUP BY ds"

ORACLES["series_lengths"] = "WITH " + DAILY.strip() + """
SELECT unique_id, count(*) AS n_rows, count(y) AS n_obs FROM daily GROUP BY 1 HAVING count(*) >= 12
"""

ORACLES["length_histogram"] = "WITH " + DAILY.strip() + """,
l AS (SELECT unique_id, CAST(count(*) AS DOUBLE) AS x FROM daily GROUP BY 1),
bd AS (SELECT min(x) AS lo, max(x) AS hi FROM l),
bn AS (SELECT CASE WHEN hi = lo THEN 1
              ELSE least(30, CAST(floor((x - lo) / ((hi - lo) / 30)) AS INTEGER) + 1) END AS bin, lo, hi
       FROM l, bd)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) AS lo, round(lo + bin * ((hi - lo) / 30), 6) AS hi,
       count(*) AS count
FROM bn GROUP BY bin, bn.lo, bn.hi
"""

ORACLES["series_records"] = "WITH " + seller_panel_ctes(8) + """
SELECT seller_id,
  string_agg(printf('%.6f', revenue), ',' ORDER BY month) AS target,
  string_agg(printf('%.6f', CAST(order_count AS DOUBLE)), ',' ORDER BY month) AS order_count,
  string_agg(printf('%.6f', avg_price), ',' ORDER BY month) AS avg_price,
  string_agg(printf('%.6f', avg_freight), ',' ORDER BY month) AS avg_freight,
  string_agg(printf('%.6f', avg_delivery_days), ',' ORDER BY month) AS avg_delivery_days,
  string_agg(printf('%.6f', avg_review_score), ',' ORDER BY month) AS avg_review_score
FROM panel GROUP BY seller_id
"""

# ``decompose`` is checked rows-only: its centred 2 x 144 moving average of
# 2-place values lands exactly on 6-place rounding ties, which the two engines
# round differently. DECOMPOSE_SQL stays for manual comparison with a tolerance;
# tests/test_analysis.py checks the operator against a known answer.


# ---------------------------------------------------------------- windows and CV

SELLER_RANKED = seller_panel_ctes(8) + """,
rk AS (SELECT seller_id, month, revenue,
              row_number() OVER (PARTITION BY seller_id ORDER BY month) AS rn,
              count(*) OVER (PARTITION BY seller_id) AS n
       FROM panel)
"""

_WINS = SELLER_RANKED + """,
wl AS (SELECT c.seller_id, c.month AS cutoff, x.month, x.revenue,
              CASE WHEN x.rn <= c.rn THEN 'input' ELSE 'output' END AS data_type
       FROM rk c JOIN rk x ON x.seller_id = c.seller_id AND x.rn BETWEEN c.rn - 11 AND c.rn + 3
       WHERE c.rn >= 12 AND c.rn <= c.n - 3)
"""

ORACLES["window_arrays"] = "WITH " + _WINS + """
SELECT seller_id, cutoff,
  string_agg(CASE WHEN data_type = 'input' THEN printf('%.6f', revenue) END, ',' ORDER BY month) AS input,
  string_agg(CASE WHEN data_type = 'output' THEN printf('%.6f', revenue) END, ',' ORDER BY month) AS output
FROM wl GROUP BY seller_id, cutoff
"""

ORACLES["window_long"] = "WITH " + _WINS + "\nSELECT seller_id, month, revenue, cutoff, data_type FROM wl"
ORACLES["window_range_join"] = ORACLES["window_long"]

ORACLES["sequence_pairs"] = "WITH " + _WINS + """
SELECT seller_id, cutoff,
  string_agg(CASE WHEN data_type = 'input' THEN floor(revenue::FLOAT::DOUBLE * 1000 + 0.5)::BIGINT::VARCHAR END, ',' ORDER BY month) AS input,
  string_agg(CASE WHEN data_type = 'output' THEN floor(revenue::FLOAT::DOUBLE * 1000 + 0.5)::BIGINT::VARCHAR END, ',' ORDER BY month) AS output
FROM wl GROUP BY seller_id, cutoff
"""

_CV = SELLER_RANKED + """,
wins AS (SELECT DISTINCT seller_id, n FROM rk WHERE n - 3 - 9 >= 1),
wi AS (SELECT seller_id, n, i, n - 3 - 3 * (3 - i) AS c FROM wins, range(0, 4) r(i)),
hs AS (SELECT wi.seller_id, wi.i, wi.c, max(rk.month) AS cutoff, arg_max(rk.revenue, rk.month) AS last_y
       FROM wi JOIN rk ON rk.seller_id = wi.seller_id AND rk.rn <= wi.c GROUP BY 1, 2, 3),
fc AS (SELECT hs.seller_id, hs.cutoff, CAST(hs.cutoff + to_months(CAST(k.k AS INTEGER)) AS TIMESTAMP) AS month,
              hs.last_y AS "Naive", CASE WHEN hs.c >= 12 THEN s.revenue END AS "SeasonalNaive"
       FROM hs CROSS JOIN range(1, 4) k(k)
       LEFT JOIN rk s ON s.seller_id = hs.seller_id AND s.rn = hs.c - 12 + 1 + ((k.k - 1) % 12)),
cv AS (SELECT fc.seller_id, fc.month, fc.cutoff, rk.revenue, fc."Naive", fc."SeasonalNaive"
       FROM fc JOIN rk ON rk.seller_id = fc.seller_id AND rk.month = fc.month)
"""

ORACLES["cv_naive"] = "WITH " + _CV + "\nSELECT * FROM cv"


def _metric_sql(m: str, model: str) -> str:
    e = f'(revenue - "{model}")'
    if m == "mae":
        return f"avg(abs({e}))"
    if m == "rmse":
        return f"sqrt(avg({e} * {e}))"
    if m == "mape":
        return f"avg(CASE WHEN revenue <> 0 THEN abs({e}) / abs(revenue) END)"
    return (f'avg(CASE WHEN revenue IS NOT NULL AND "{model}" IS NOT NULL THEN '
            f'CASE WHEN abs(revenue) + abs("{model}") = 0 THEN 0.0 '
            f'ELSE abs({e}) / (abs(revenue) + abs("{model}")) END END)')


ORACLES["cv_metrics"] = "WITH " + _CV + ",\nper AS (\n" + "\nUNION ALL\n".join(
    f"SELECT seller_id, cutoff, '{m}' AS metric, {_metric_sql(m, 'Naive')} AS \"Naive\", "
    f"{_metric_sql(m, 'SeasonalNaive')} AS \"SeasonalNaive\" FROM cv GROUP BY seller_id, cutoff"
    for m in ("mae", "mape", "rmse", "smape")) + """)
SELECT metric, round(avg("Naive"), 6) AS "Naive", round(avg("SeasonalNaive"), 6) AS "SeasonalNaive"
FROM per GROUP BY metric
"""

ORACLES["best_model"] = "WITH " + _CV + """,
per AS (SELECT seller_id, cutoff, avg(abs(revenue - "Naive")) AS n_mae,
               avg(abs(revenue - "SeasonalNaive")) AS s_mae FROM cv GROUP BY 1, 2),
agg AS (SELECT seller_id, avg(n_mae) AS "Naive", avg(s_mae) AS "SeasonalNaive" FROM per GROUP BY 1),
ch AS (SELECT seller_id,
         CASE WHEN "SeasonalNaive" < "Naive" THEN 'SeasonalNaive' ELSE 'Naive' END AS best_model,
         least("Naive", "SeasonalNaive") AS best_value FROM agg),
last AS (SELECT seller_id, n, max(month) AS last_ds, arg_max(revenue, month) AS last_y FROM rk GROUP BY 1, 2),
f AS (SELECT l.seller_id, CAST(l.last_ds + to_months(CAST(k.k AS INTEGER)) AS TIMESTAMP) AS month,
             l.last_y AS nv, s.revenue AS sv
      FROM last l CROSS JOIN range(1, 4) k(k)
      LEFT JOIN rk s ON s.seller_id = l.seller_id AND s.rn = l.n - 12 + 1 + ((k.k - 1) % 12))
SELECT f.seller_id, f.month, ch.best_model, round(ch.best_value, 6) AS cv_mae,
       round(CASE WHEN ch.best_model = 'Naive' THEN nv ELSE sv END, 6) AS yhat
FROM f JOIN ch USING (seller_id)
"""


# ---------------------------------------------------------------- hierarchy

HIER = DAILY.strip() + """,
tree AS (SELECT CAST(s_suppkey AS VARCHAR) AS unique_id, r_name AS region, n_name AS nation
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
S AS (SELECT 'total' AS node, unique_id AS bottom, 1.0::DOUBLE AS weight FROM tree
      UNION ALL SELECT region, unique_id, 1.0 FROM tree
      UNION ALL SELECT region || '/' || nation, unique_id, 1.0 FROM tree
      UNION ALL SELECT unique_id, unique_id, 1.0 FROM tree),
bn AS (SELECT unique_id, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM dpanel GROUP BY 1),
bfc AS (SELECT unique_id, CAST(last_ds + INTERVAL (k) DAY AS TIMESTAMP) AS ds, last_y AS "Naive"
        FROM bn CROSS JOIN range(1, 8) r(k)),
bu AS (SELECT S.node AS unique_id, f.ds, sum(S.weight * f."Naive") AS "Naive"
       FROM bfc f JOIN S ON S.bottom = f.unique_id GROUP BY 1, 2)
"""

ORACLES["hier_levels"] = "WITH " + HIER + """,
g AS (SELECT region, nation, p.unique_id, ds, sum(y) AS y
      FROM dpanel p JOIN tree t USING (unique_id)
      GROUP BY GROUPING SETS ((region, nation, p.unique_id, ds), (region, nation, ds), (region, ds), (ds)))
SELECT CASE WHEN unique_id IS NOT NULL THEN unique_id
            WHEN nation IS NOT NULL THEN region || '/' || nation
            WHEN region IS NOT NULL THEN region ELSE 'total' END AS unique_id,
       ds, y,
       CASE WHEN unique_id IS NOT NULL THEN 'unique_id' WHEN nation IS NOT NULL THEN 'nation'
            WHEN region IS NOT NULL THEN 'region' ELSE 'total' END AS level
FROM g
"""

ORACLES["hier_summing"] = "WITH " + HIER + "\nSELECT * FROM S"
ORACLES["bottom_up"] = "WITH " + HIER + "\nSELECT * FROM bu"


# ---------------------------------------------------------------- small relational operators

ORACLES["item_projection"] = """
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS qty,
       l_extendedprice + round(l_extendedprice * l_tax, 4) AS item_total,
       round(sqrt(abs(l_extendedprice)), 6) AS price_sqrt,
       CAST(floor(l_discount * 100) AS BIGINT) AS discount_pct,
       greatest(l_tax, l_discount) AS max_rate, 'item' AS kind
FROM lineitem WHERE l_quantity > 0
"""

ORACLES["event_slice"] = """
SELECT event_id, ts, event_type, value FROM events
WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-15 00:00:00'
ORDER BY ts, event_id LIMIT 100
"""

ORACLES["parse_times"] = """
SELECT event_id,
  CAST(try_strptime(CASE WHEN event_type = 'error' THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
                    '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS lenient,
  CASE WHEN event_type <> 'error' THEN CAST(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) END AS strict
FROM events
"""

ORACLES["calendar_grid"] = """
SELECT CAST(m AS TIMESTAMP) AS month, CAST(quarter(m) AS INTEGER) AS quarter,
       CAST(day(last_day(m)) AS INTEGER) AS daysinmonth
FROM (SELECT unnest(generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM orders),
                                    (SELECT max(date_trunc('month', o_orderdate)) FROM orders),
                                    INTERVAL 1 MONTH)) AS m)
"""

ORACLES["panel_profile"] = "WITH " + seller_panel_ctes(8) + """
SELECT count(DISTINCT seller_id) AS n_series, count(*) AS n_rows, min(month) AS first_month,
       max(month) AS last_month, round(greatest(0.0, min(revenue) * 0.9), 6) AS axis_min,
       round(max(revenue) * 1.1, 6) AS axis_max, min(seller_id) AS first_seller
FROM panel
"""

ORACLES["ordered_split"] = "WITH " + DAILY.strip() + """
SELECT unique_id, ds,
  CASE WHEN row_number() OVER (PARTITION BY unique_id ORDER BY ds)
            <= floor(0.9 * count(*) OVER (PARTITION BY unique_id)) THEN 'train' ELSE 'valid' END AS split
FROM dpanel
"""

ORACLES["row_difference"] = "WITH " + SELLER_SPLIT + "\nSELECT seller_id, month, revenue FROM train"

ORACLES["model_metrics_long"] = "WITH " + SELLER_SPLIT + """,
j AS (SELECT t.seller_id, p.approach AS model, t.revenue AS y, p.predictions AS yhat
      FROM test t JOIN preds p ON p.seller_id = t.seller_id AND p.month = t.month),
m AS (SELECT seller_id, model,
        avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
        avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) AS mape,
        avg(CASE WHEN y > 0 THEN abs(y - yhat) / y END) AS mape_pos,
        avg(CASE WHEN y IS NOT NULL AND yhat IS NOT NULL THEN
              CASE WHEN abs(y) + abs(yhat) = 0 THEN 0.0 ELSE abs(y - yhat) / (abs(y) + abs(yhat)) END END) AS smape,
        avg(y - yhat) AS bias
      FROM j GROUP BY 1, 2)
SELECT seller_id, model, metric, round(value, 6) AS value
FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN (mae, rmse, mape, mape_pos, smape, bias))
"""

ORACLES["exog_horizon"] = "WITH " + DAILY.strip() + """,
lines AS (SELECT CAST(l_suppkey AS VARCHAR) AS unique_id, l_shipdate AS ds, count(*) AS n_lines
          FROM lineitem GROUP BY 1, 2),
tr AS (SELECT unique_id, ds FROM dpanel
       QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) > 7),
last AS (SELECT unique_id, max(ds) AS last_ds FROM tr GROUP BY 1),
hz AS (SELECT unique_id, CAST(last_ds + INTERVAL (k) DAY AS TIMESTAMP) AS ds, CAST(k AS INTEGER) AS k
       FROM last CROSS JOIN range(1, 8) r(k))
SELECT hz.unique_id, hz.ds, hz.k, l.n_lines, l.n_lines IS NULL AS missing_exog
FROM hz LEFT JOIN lines l USING (unique_id, ds)
"""

ORACLES["lag_features_blocked"] = ORACLES["lag_features"]
ORACLES["differenced_features_blocked"] = ORACLES["differenced_features"]
ORACLES["rolling_stats_blocked"] = ORACLES["rolling_stats"]
ORACLES["window_arrays_blocked"] = ORACLES["window_arrays"]
ORACLES["naive_intervals_blocked"] = ORACLES["naive_intervals"]
ORACLES["fill_gaps_global_blocked"] = ORACLES["fill_gaps_global"]
ORACLES["regular_grid_blocked"] = ORACLES["regular_grid"]

ORACLES["linear_one_feature"] = "WITH " + DAILY.strip() + """,
attrs AS (SELECT CAST(s_suppkey AS VARCHAR) AS unique_id FROM supplier),
f AS (SELECT p.unique_id, p.ds, p.y,
        lag(y, 1) OVER w AS lag1, lag(y, 2) OVER w AS lag2, lag(y, 3) OVER w AS lag3, lag(y, 7) OVER w AS lag7,
        lag(y, 14) OVER w AS lag14, lag(y, 30) OVER w AS lag30, lag(y, 360) OVER w AS lag360,
        avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING) AS em7,
        CASE WHEN count(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 20 PRECEDING AND 14 PRECEDING) = 7
             THEN 1 END AS r14,
        CASE WHEN count(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 43 PRECEDING AND 30 PRECEDING) = 14
             THEN 1 END AS r30
      FROM dpanel p JOIN attrs a USING (unique_id)
      WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
g AS (SELECT * FROM f WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL AND lag7 IS NOT NULL
        AND lag14 IS NOT NULL AND lag30 IS NOT NULL AND lag360 IS NOT NULL AND em7 IS NOT NULL
        AND r14 IS NOT NULL AND r30 IS NOT NULL)
SELECT round(regr_slope(y, lag7), 6) AS slope, round(regr_intercept(y, lag7), 6) AS intercept,
       regr_count(y, lag7) AS n FROM g
"""
ORACLES["acf_blocked"] = ORACLES["acf"]
ORACLES["cv_naive_blocked"] = ORACLES["cv_naive"]
ORACLES["holdout_split_blocked"] = ORACLES["holdout_split"]
ORACLES["fitted_values_blocked"] = ORACLES["fitted_values"]
ORACLES["quantile_forecast_blocked"] = ORACLES["quantile_forecast"]
ORACLES["ordered_split_blocked"] = ORACLES["ordered_split"]
ORACLES["first_n_per_series_blocked"] = ORACLES["first_n_per_series"]

# ---------------------------------------------------------------- samples, payloads, table function

ORACLES["sample_ids"] = "WITH " + DAILY.strip() + """
SELECT unique_id FROM (SELECT DISTINCT unique_id FROM daily) ORDER BY md5(unique_id || '|4'), unique_id LIMIT 5
"""

ORACLES["scoring_payload"] = "WITH lf AS (" + ORACLES["lag_features"] + """),
r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS rn FROM lf)
SELECT unique_id, CAST(rn AS INTEGER) AS pos, '""" + ",".join(_LAG_FEATS) + """' AS columns,
       """ + " || ',' || ".join(f"printf('%.6f', {c}::DOUBLE)" for c in _LAG_FEATS) + """ AS values
FROM r WHERE rn < 2
"""

ORACLES["forecast_table_fn"] = "WITH " + DAILY.strip() + f""",
d AS (SELECT unique_id, ds, y, y - lag(y) OVER ({W_ID}) AS dy FROM dpanel),
s AS (SELECT unique_id, max(ds) AS last_ds, arg_max(y, ds) AS last_y, sqrt(sum(dy * dy) / count(dy)) AS sigma FROM d GROUP BY 1),
g AS (SELECT *, unnest(range(1, greatest(date_diff('day', last_ds, TIMESTAMP '2001-11-12'), 1))) AS k FROM s)
SELECT unique_id AS grp, CAST(last_ds + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds, round(last_y::DOUBLE, 6) AS forecast,
       round(last_y - 1.2815515655446004 * sigma * sqrt(k), 6) AS lower, round(last_y + 1.2815515655446004 * sigma * sqrt(k), 6) AS upper
FROM g
"""

# ---------------------------------------------------------------- smoothing models

HW_SQL = """
hy AS (SELECT seller_id, list(revenue ORDER BY month) AS y, max(month) AS last_ds FROM train GROUP BY 1),
hgrid AS (SELECT a.v AS a, t.v AS t, g.v AS g, (a.i * 25 + t.i * 5 + g.i) AS i
         FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) a,
              (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) t,
              (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) g),
h0 AS (SELECT seller_id, y, last_ds, list_sum(y[1:12]) / 12 AS m1, list_sum(y[13:24]) / 12 AS m2 FROM hy WHERE len(y) >= 24),
hw AS (
  SELECT seller_id, i, a, t, g, y, last_ds, 0 AS n, m1 AS l, (m2 - m1) / 12 AS b, [x - m1 FOR x IN y[1:12]] AS s, 0.0::DOUBLE AS sse
  FROM h0, hgrid
  UNION ALL
  SELECT seller_id, i, a, t, g, y, last_ds, n + 1, nl, t * (nl - l) + (1 - t) * b, list_append(s[2:], g * (v - nl) + (1 - g) * s[1]),
         sse + (v - (l + b + s[1])) * (v - (l + b + s[1]))
  FROM (SELECT *, y[n + 1] AS v, a * (y[n + 1] - s[1]) + (1 - a) * (l + b) AS nl FROM hw WHERE n < len(y))),
hbest AS (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY sse, i) AS r FROM hw WHERE n = len(y)),
hfc AS (
  SELECT seller_id, last_ds, k, CASE WHEN len(y) >= 24 THEN l + k * b + s[k] ELSE y[len(y)] END AS yhat
  FROM (SELECT hy.seller_id, hy.last_ds, hy.y, l, b, s FROM hy LEFT JOIN (SELECT * FROM hbest WHERE r = 1) q ON hy.seller_id = q.seller_id),
       (SELECT unnest(range(1, 4)) AS k)),
hout AS (SELECT seller_id, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, yhat FROM hfc)
"""

ORACLES["holt_winters"] = "WITH RECURSIVE " + SELLER_SPLIT.strip() + "," + HW_SQL + """
SELECT seller_id, month, 'HoltWinters' AS model, round(yhat, 6) AS yhat FROM hout
"""


def adida_ctes(src: str, key: str, ds: str, y: str) -> str:
    """CTEs ending in ``ad(key, last_ds, f)``: the ADIDA level per row of every series."""
    return f"""
ay AS (SELECT {key} AS k0, list({y}::DOUBLE ORDER BY {ds}) AS y, max({ds}) AS last_ds FROM {src} GROUP BY 1),
ad0 AS (SELECT *, list_filter([CASE WHEN y[i] <> 0 THEN i END FOR i IN range(1, len(y) + 1)], lambda p: p IS NOT NULL) AS d FROM ay),
ad1 AS (SELECT *, greatest(1, floor(d[len(d)] / len(d) + 0.5))::BIGINT AS a FROM ad0),
ad2 AS (SELECT *, [list_sum(y[(len(y) % a) + j * a + 1:(len(y) % a) + j * a + a]) FOR j IN range(0, len(y) // a)] AS b
        FROM ad1 WHERE len(d) > 0 AND len(y) >= a),
ses AS (
  SELECT k0, b, a, p, 1 AS n, b[1] AS l, 0.0::DOUBLE AS sse FROM ad2, (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3])::DOUBLE AS p)
  UNION ALL
  SELECT k0, b, a, p, n + 1, p * b[n + 1] + (1 - p) * l, sse + (b[n + 1] - l) * (b[n + 1] - l) FROM ses WHERE n < len(b)),
abest AS (SELECT *, row_number() OVER (PARTITION BY k0 ORDER BY sse, p) AS r FROM ses WHERE n = len(b)),
ad AS (SELECT ay.k0, ay.last_ds, coalesce(q.l / q.a, 0) AS f FROM ay LEFT JOIN (SELECT * FROM abest WHERE r = 1) q ON ay.k0 = q.k0)"""


ORACLES["adida"] = "WITH RECURSIVE " + DAILY.strip() + "," + adida_ctes("dpanel", "unique_id", "ds", "y") + """
SELECT k0 AS unique_id, CAST(last_ds + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds, 'ADIDA' AS model, round(f, 6) AS yhat
FROM ad, (SELECT unnest(range(1, 8)) AS k)
"""

ORACLES["classic_forecasts"] = "WITH RECURSIVE " + SELLER_SPLIT.strip() + "," + HW_SQL.strip() + "," \
    + adida_ctes("train", "seller_id", "month", "revenue") + """,
trk AS (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY month) AS rn, count(*) OVER (PARTITION BY seller_id) AS n FROM train)
SELECT h.seller_id, h.month, round(l.y, 6) AS "Naive", round(s.revenue, 6) AS "SeasonalNaive", round(h.yhat, 6) AS "HoltWinters",
       round(ad.f, 6) AS "ADIDA"
FROM hout h JOIN ad ON ad.k0 = h.seller_id
JOIN (SELECT seller_id, arg_max(revenue, month) AS y, max(month) AS last_ds, max(n) AS n FROM trk GROUP BY 1) l ON l.seller_id = h.seller_id
LEFT JOIN trk s ON s.seller_id = h.seller_id AND s.rn = l.n - 12 + date_diff('month', l.last_ds, h.month)
"""

ORACLES["recursive_rule"] = "WITH RECURSIVE " + DAILY.strip() + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM dpanel),
df AS (SELECT unique_id, ds, y, y - lag(y, 1) OVER ({W_ID}) AS d, rn, n FROM rk WHERE rn <= n - 7),
ln AS (SELECT CAST(l_suppkey AS VARCHAR) AS unique_id, l_shipdate AS ds, count(*)::DOUBLE AS n_lines FROM lineitem GROUP BY 1, 2),
rc AS (
  SELECT unique_id, ds, 0 AS k, y::DOUBLE AS level, d::DOUBLE AS d1, d2::DOUBLE AS d2
  FROM (SELECT *, lag(d, 1) OVER ({W_ID}) AS d2 FROM df) WHERE rn = n - 7
  UNION ALL
  SELECT r.unique_id, CAST(r.ds + INTERVAL 1 DAY AS TIMESTAMP), k + 1,
         level + (0.5::DOUBLE * d1 - 0.25::DOUBLE * d2 + 0.125::DOUBLE * coalesce(ln.n_lines, 0) + 0.0625::DOUBLE * quarter(r.ds + INTERVAL 1 DAY)),
         0.5::DOUBLE * d1 - 0.25::DOUBLE * d2 + 0.125::DOUBLE * coalesce(ln.n_lines, 0) + 0.0625::DOUBLE * quarter(r.ds + INTERVAL 1 DAY), d1
  FROM rc r LEFT JOIN ln ON ln.unique_id = r.unique_id AND ln.ds = r.ds + INTERVAL 1 DAY WHERE k < 7)
SELECT unique_id, ds, round(level, 4) AS yhat FROM rc WHERE k > 0
"""

_H = "floor({} * 1e5 + 0.5) / 1e5"
_D = DECOMPOSE_SQL[:DECOMPOSE_SQL.rindex("SELECT st2.unique_id")]
ORACLES["decompose"] = _D + "SELECT st2.unique_id, st2.ds, " + ", ".join(f"{_H.format(e)} AS {n}" for e, n in (
    ("st2.y", "y"), ("st2.trend", "trend"), ("ph2.s", "seasonal"), ("(st2.y - st2.trend - ph2.s)", "resid"))) \
    + " FROM st2 JOIN ph2 USING (unique_id, phase)"
ORACLES["decompose_blocked"] = ORACLES["decompose"]

ORACLES["artifact_round_trip"] = "WITH " + SELLER_SPLIT + """
SELECT seller_id, month, revenue, 'test' AS part FROM test
UNION ALL SELECT seller_id, month, revenue, 'train' FROM train
"""
ORACLES["metrics_log"] = "WITH m AS (" + ORACLES["approach_comparison"] + """)
SELECT approach || '_' || metric AS metric, value, 'run-1' AS run FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (approach)) INTO NAME metric VALUE value)
"""
_CSV = {
    "orders": ("o_totalprice", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
    "lineitem": ("l_extendedprice", "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                                    "l_returnflag, l_linestatus, l_shipdate"),
    "customer": ("c_custkey", "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"),
    "supplier": ("s_suppkey", "s_suppkey, s_name, s_nationkey, s_acctbal"),
}
ORACLES["csv_set"] = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", count(*) AS n_rows, '{names}' AS columns, CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS total, 5 AS sampled FROM {t}"""
    for t, (c, names) in _CSV.items())
ORACLES["display_values"] = "WITH " + SELLER_SPLIT + """,
l AS (SELECT seller_id, arg_max(revenue, month) AS p FROM train GROUP BY 1),
v AS (SELECT seller_id, revenue AS x FROM test UNION ALL SELECT t.seller_id, l.p FROM test t JOIN l USING (seller_id))
SELECT seller_id, count(x) AS n_values, round(greatest(0.0::DOUBLE, min(x) * 0.9::DOUBLE), 6) AS axis_min, round(max(x) * 1.1::DOUBLE, 6) AS axis_max FROM v GROUP BY 1
"""

# Sums of naive forecasts are naive forecasts of the sums: the base is coherent, so MinT leaves it.


# ---------------------------------------------------------------- linear models by normal equations

def normal_equations(src: str, feats: list[str], y: str, p: str = "") -> str:
    """CTEs ending in ``{p}beta`` (``b``: intercept, then the coefficients) of least squares on ``src``: the
    moments as one list of rows, then Gauss-Jordan elimination, a recursion step per column."""
    k = len(feats) + 1
    x = ["1.0", *feats]
    row = lambda i: "[" + ", ".join(f"sum(({x[i]})::DOUBLE * ({e})::DOUBLE)" for e in [*x, y]) + "]"
    return f"""
{p}gram AS (SELECT [{', '.join(row(i) for i in range(k))}] AS m FROM {src}),
{p}elim AS (
  SELECT 1 AS c, m FROM {p}gram UNION ALL
  SELECT c + 1, list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda v: v / r[c])
                ELSE list_transform(r, lambda v, j: v - r[c] * m[c][j] / m[c][c]) END)
  FROM {p}elim WHERE c <= {k}),
{p}beta AS (SELECT list_transform(m, lambda r: r[{k + 1}]) AS b FROM {p}elim WHERE c = {k + 1})"""


def _linear(feats: list[str]) -> str:
    return "b[1] + " + " + ".join(f"b[{i + 2}] * {f}" for i, f in enumerate(feats))


_SPLIT_FEATS = "lf AS (" + ORACLES["lag_features"] + f"""),
lab AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 7 AS is_test FROM lf),
train AS (SELECT * FROM lab WHERE NOT is_test),""" + normal_equations("train", _LAG_FEATS, "y")
ORACLES["linear_forecast"] = "WITH RECURSIVE " + _SPLIT_FEATS + f"""
SELECT unique_id, ds, y, round({_linear(_LAG_FEATS)}, 3) AS prediction FROM lab, beta WHERE is_test"""
ORACLES["batch_score"] = ORACLES["linear_forecast"]

# The recursion holds each supplier's last 360 values as a list.
ORACLES["recursive_forecast"] = "WITH RECURSIVE " + DAILY.strip() + ", lf AS (" + ORACLES["lag_features"] + ")," \
    + normal_equations("lf", _LAG_FEATS, "y") + f""",
steps AS (
  SELECT unique_id, 0 AS k, max(ds) AS ds, list(y::DOUBLE ORDER BY ds) AS v, NULL::DOUBLE AS yhat FROM dpanel GROUP BY unique_id
  UNION ALL
  SELECT unique_id, k + 1, ds + INTERVAL 1 DAY, list_append(v, p), p FROM (
    SELECT s.*, {_linear([
        *[f"v[len(v) - {lag - 1}]" for lag in (1, 2, 3, 7, 14, 30, 360)],
        "list_sum(v[1:len(v) - 6]) / (len(v) - 6)", "list_sum(v[len(v) - 19:len(v) - 13]) / 7", "list_sum(v[len(v) - 42:len(v) - 29]) / 14"])} AS p
    FROM steps s, beta) WHERE k < 7)
SELECT unique_id, ds, round(yhat, 3) AS yhat FROM steps WHERE k > 0"""


# ---------------------------------------------------------------- smoothing: fitted values, intervals, cross validation

def hw_ctes(src: str, p: str, upto: str = "len(y)") -> str:
    """Holt-Winters on the first ``upto`` values of each seller of ``src``: ``{p}best`` (parameters, sse) and
    ``{p}path`` (state after each of all values, and the forecast before it)."""
    move = "t * (nl - l) + (1 - t) * b AS b, list_append(s[2:], g * (v - nl) + (1 - g) * s[1]) AS s"
    head = "[x - m1 FOR x IN y[1:12]] AS s"
    return f"""
{p}y AS (SELECT *, {upto} AS upto FROM (SELECT seller_id, list(revenue ORDER BY month) AS y, list(month ORDER BY month) AS ts, max(month) AS last_ds FROM {src} GROUP BY 1)),
{p}grid AS (SELECT a.v AS a, t.v AS t, g.v AS g, (a.i * 25 + t.i * 5 + g.i) AS i
         FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) a,
              (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) t,
              (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(0, 5)) AS i) g),
{p}0 AS (SELECT *, list_sum(y[1:12]) / 12 AS m1, list_sum(y[13:24]) / 12 AS m2 FROM {p}y WHERE upto >= 24),
{p}fit AS (
  SELECT seller_id, i, a, t, g, y, upto, 0 AS n, m1 AS l, (m2 - m1) / 12 AS b, {head}, 0.0::DOUBLE AS sse FROM {p}0, {p}grid
  UNION ALL
  SELECT seller_id, i, a, t, g, y, upto, n + 1, nl, {move}, sse + (v - (l + b + s[1])) * (v - (l + b + s[1]))
  FROM (SELECT *, y[n + 1] AS v, a * (y[n + 1] - s[1]) + (1 - a) * (l + b) AS nl FROM {p}fit WHERE n < upto)),
{p}best AS (SELECT * FROM {p}fit WHERE n = upto QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY sse, i) = 1),
{p}path AS (
  SELECT q.seller_id, a, t, g, q.y, ts, 0 AS n, m1 AS l, (m2 - m1) / 12 AS b, [x - m1 FOR x IN q.y[1:12]] AS s, NULL::DOUBLE AS fit
  FROM {p}0 q JOIN {p}best USING (seller_id)
  UNION ALL
  SELECT seller_id, a, t, g, y, ts, n + 1, nl, {move}, l + b + s[1]
  FROM (SELECT *, y[n + 1] AS v, a * (y[n + 1] - s[1]) + (1 - a) * (l + b) AS nl FROM {p}path WHERE n < len(y)))"""


_ADIDA_FIT = """
afit AS (SELECT r.seller_id, r.month, r.revenue, s.l / s.a AS fit, s.a, s.p
         FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY month) AS rn, count(*) OVER (PARTITION BY seller_id) AS n FROM train) r
         JOIN abest q ON q.k0 = r.seller_id AND q.r = 1
         LEFT JOIN ses s ON s.k0 = q.k0 AND s.p = q.p AND s.n = floor((r.rn - 1 - r.n % q.a) / q.a) AND r.rn - 1 >= r.n % q.a)"""
_SMOOTH = "WITH RECURSIVE " + SELLER_SPLIT.strip() + "," + hw_ctes("train", "w") + "," + adida_ctes("train", "seller_id", "month", "revenue") + "," + _ADIDA_FIT
ORACLES["smoothing_fitted"] = _SMOOTH + """
SELECT w.seller_id, w.ts[w.n] AS month, w.y[w.n] AS revenue, round(w.fit, 6) AS "HoltWinters", round(a.fit, 6) AS "ADIDA"
FROM wpath w JOIN afit a ON a.seller_id = w.seller_id AND a.month = w.ts[w.n] WHERE w.n > 0"""
ORACLES["smoothing_intervals"] = _SMOOTH + """,
f AS (SELECT seller_id, k, 'HoltWinters' AS model, l + k * b + s[k] AS yhat,
             sqrt(sse / len(y) * (1 + list_sum([0.0] || [(a * (1 + j * t) + CASE WHEN j % 12 = 0 THEN g * (1 - a) ELSE 0 END) ** 2 FOR j IN range(1, k)]))) AS sd
      FROM wbest, (SELECT unnest(range(1, 4)) AS k)
      UNION ALL
      SELECT ad.k0, k, 'ADIDA', ad.f, sqrt(e.s2 * (1 + (ceil(k / q.a) - 1) * q.p * q.p))
      FROM ad JOIN abest q ON q.k0 = ad.k0 AND q.r = 1
      JOIN (SELECT seller_id, avg((revenue - fit) ** 2) AS s2 FROM afit GROUP BY 1) e ON e.seller_id = ad.k0, (SELECT unnest(range(1, 4)) AS k))
SELECT f.seller_id, CAST(y.last_ds + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, model, round(yhat, 4) AS yhat,
       round(yhat - 1.2815515655446004 * sd, 4) AS "lo-80", round(yhat + 1.2815515655446004 * sd, 4) AS "hi-80"
FROM f JOIN wy y USING (seller_id)"""

# Sellers' panels are equally long; the earliest of four cutoffs lies 12 months before the end.
_CVS = hw_ctes("panel", "c", "len(y) - 12") + "," + adida_ctes("(SELECT * FROM rk WHERE rn <= n - 12)", "seller_id", "month", "revenue") + """,
aon AS (
  SELECT k0, a, p, l, y.y AS y, y.upto AS c, 0 AS n FROM (SELECT * FROM abest WHERE r = 1) q JOIN cy y ON y.seller_id = q.k0
  UNION ALL
  SELECT k0, a, p, p * list_sum(y[c + n * a + 1:c + (n + 1) * a]) + (1 - p) * l, y, c, n + 1 FROM aon WHERE (n + 1) * a <= 12),
cvs AS (
  SELECT h.seller_id, h.ts[h.n + k] AS month, h.ts[h.n] AS cutoff, h.y[h.n + k] AS revenue, h.l + k * h.b + h.s[k] AS hw,
         coalesce(a.l / a.a, 0) AS ad
  FROM (SELECT *, len(y) - 12 AS c0 FROM cpath) h CROSS JOIN (SELECT unnest(range(1, 4)) AS k)
  LEFT JOIN aon a ON a.k0 = h.seller_id AND a.n = floor((h.n - h.c0) / a.a)
  WHERE h.n >= h.c0 AND h.n < len(h.y) AND (h.n - h.c0) % 3 = 0)"""
ORACLES["cv_smoothing"] = "WITH RECURSIVE " + SELLER_RANKED.strip() + "," + _CVS + """
SELECT seller_id, month, cutoff, revenue, round(hw, 6) AS "HoltWinters", round(ad, 6) AS "ADIDA" FROM cvs"""

ORACLES["cv_short_series"] = "WITH " + DAILY.strip() + """
SELECT unique_id, count(*) AS n_rows, 533 AS needed FROM daily GROUP BY 1 HAVING count(*) < 533"""

ORACLES["cv_linear"] = "WITH RECURSIVE " + DAILY.strip() + f""",
rk AS (SELECT unique_id, ds, y::DOUBLE AS y, lag(y, 1) OVER ({W_ID}) AS x, row_number() OVER ({W_ID}) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM dpanel),
beta AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM rk WHERE rn <= n - 28 AND x IS NOT NULL),
f AS (SELECT unique_id, ds AS cutoff, rn, 0 AS k, y AS yhat FROM rk WHERE n - rn IN (28, 21, 14, 7)
      UNION ALL SELECT unique_id, cutoff, rn, k + 1, beta.b + beta.a * yhat FROM f, beta WHERE k < 7)
SELECT f.unique_id, rk.ds, f.cutoff, rk.y, round(f.yhat, 3) AS linear FROM f JOIN rk ON rk.unique_id = f.unique_id AND rk.rn = f.rn + f.k WHERE f.k > 0"""

_FULL_AD = adida_ctes("panel", "seller_id", "month", "revenue")
for _name in ("ay", "ad0", "ad1", "ad2", "ses", "abest", "ad"):  # a second set of the same names
    _FULL_AD = re.sub(rf"\b{_name}\b", f"z{_name}", _FULL_AD)
ORACLES["best_model_registry"] = "WITH RECURSIVE " + _CV.strip() + "," + _CVS + "," + hw_ctes("panel", "w") + "," + _FULL_AD + """,
per AS (
  SELECT seller_id, cutoff, 'Naive' AS model, avg(abs(revenue - "Naive")) AS e FROM cv GROUP BY 1, 2
  UNION ALL SELECT seller_id, cutoff, 'SeasonalNaive', avg(abs(revenue - "SeasonalNaive")) FROM cv GROUP BY 1, 2
  UNION ALL SELECT seller_id, cutoff, 'HoltWinters', avg(abs(revenue - hw)) FROM cvs GROUP BY 1, 2
  UNION ALL SELECT seller_id, cutoff, 'ADIDA', avg(abs(revenue - ad)) FROM cvs GROUP BY 1, 2),
ch AS (SELECT seller_id, model AS best_model, e FROM (SELECT seller_id, model, avg(e) AS e FROM per GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY e, model) = 1),
out AS (SELECT w.seller_id, w.k, y.last_ds, y.y[len(y.y)] AS nv, y.y[len(y.y) - 12 + 1 + (w.k - 1) % 12] AS sv, w.v AS hv, z.f AS av
        FROM (SELECT seller_id, k, l + k * b + s[k] AS v FROM wbest, (SELECT unnest(range(1, 4)) AS k)) w JOIN wy y USING (seller_id) JOIN zad z ON z.k0 = w.seller_id)
SELECT o.seller_id, CAST(o.last_ds + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, best_model, round(e, 4) AS cv_mae,
       round(CASE best_model WHEN 'Naive' THEN nv WHEN 'SeasonalNaive' THEN sv WHEN 'HoltWinters' THEN hv ELSE av END, 4) AS yhat
FROM out o JOIN ch USING (seller_id)"""

# ---------------------------------------------------------------- MinT: the dense system, solved by elimination

_MINT = "WITH RECURSIVE " + HIER.strip() + """,
ynode AS (SELECT S.node AS unique_id, p.ds, sum(p.y) AS y FROM dpanel p JOIN S ON S.bottom = p.unique_id GROUP BY 1, 2),""" \
    + adida_ctes("ynode", "unique_id", "ds", "y") + """,
res AS (SELECT r.unique_id AS node, r.ds, r.y - s.l / s.a AS r
        FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM ynode) r
        JOIN abest q ON q.k0 = r.unique_id AND q.r = 1
        JOIN ses s ON s.k0 = q.k0 AND s.p = q.p AND s.n = floor((r.rn - 1 - r.n % q.a) / q.a) AND r.rn - 1 >= r.n % q.a),
st AS (SELECT node, avg(r) AS m, greatest(stddev_samp(r), 1e-4) AS sd FROM res GROUP BY 1),
xz AS MATERIALIZED (SELECT node, ds, r - m AS x, (r - m) / sd AS z FROM res JOIN st USING (node)),
nt AS (SELECT count(DISTINCT ds)::DOUBLE AS n FROM xz),
pr AS (SELECT greatest(count(*), 2)::DOUBLE AS n, sum(a.z * b.z) AS w, sum(a.z * a.z * b.z * b.z) AS w2
       FROM xz a JOIN xz b ON a.ds = b.ds AND a.node < b.node GROUP BY a.node, b.node),
sh AS (SELECT greatest(1e-6, least(1, greatest(0, sum(n / (n - 1) ** 3 * (w2 - w * w / n)) / sum((w / (n - 1)) ** 2)))) AS a FROM pr),
co AS (SELECT a, (1 - a) / (n - 1) AS c FROM sh, nt),
dv AS (SELECT node, greatest(sum(x * x) / (any_value(n) - 1), 1e-8) AS d FROM xz, nt GROUP BY 1),
up AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT DISTINCT node FROM S WHERE node <> bottom)),
A AS (SELECT * FROM S WHERE node <> bottom),
xu AS MATERIALIZED (SELECT node, ds, sum(x) AS x FROM (SELECT xz.node, ds, x FROM xz JOIN up USING (node)
                    UNION ALL SELECT A.node, ds, -x FROM A JOIN xz ON xz.node = A.bottom) GROUP BY 1, 2),
k0 AS (SELECT a.node, b.node AS node2, co.c * sum(a.x * b.x) AS v FROM xu a JOIN xu b ON a.ds = b.ds, co GROUP BY 1, 2, co.c
       UNION ALL SELECT A.node, B.node, co.a * sum(d) FROM A JOIN A B ON A.bottom = B.bottom JOIN dv ON dv.node = A.bottom, co GROUP BY 1, 2, co.a
       UNION ALL SELECT node, node, co.a * d FROM dv JOIN up USING (node), co),
k1 AS (SELECT p.i, q.i AS j, sum(v) AS v FROM k0 JOIN up p ON p.node = k0.node JOIN up q ON q.node = k0.node2 GROUP BY 1, 2
       UNION ALL SELECT up.i, (SELECT count(*) + 1 FROM up), any_value(f.f) - sum(g.f)
       FROM up JOIN ad f ON f.k0 = up.node JOIN A ON A.node = up.node JOIN ad g ON g.k0 = A.bottom GROUP BY 1),
k2 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM k1 GROUP BY 1)),
el AS (SELECT 1 AS c, m FROM k2 UNION ALL
  SELECT c + 1, list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda v: v / r[c])
                ELSE list_transform(r, lambda v, j: v - r[c] * m[c][j] / m[c][c]) END) FROM el WHERE c <= len(m)),
zz AS (SELECT node, m[i][len(m) + 1] AS z FROM el, up WHERE c = len(m) + 1),
ut AS (SELECT ds, sum(x * z) AS u FROM xu JOIN zz USING (node) GROUP BY 1),
uz AS (SELECT node, z AS v FROM zz UNION ALL SELECT A.bottom, -sum(z) FROM A JOIN zz USING (node) GROUP BY 1),
rec AS (SELECT ad.k0 AS node, ad.last_ds, ad.f - co.a * dv.d * uz.v - co.c * xx.s AS f
        FROM ad JOIN dv ON dv.node = ad.k0 JOIN uz ON uz.node = ad.k0 JOIN (SELECT node, sum(x * u) AS s FROM xz JOIN ut USING (ds) GROUP BY 1) xx ON xx.node = ad.k0, co)"""
ORACLES["mint_shrink"] = _MINT + """
SELECT node AS unique_id, CAST(last_ds + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds, round(f, 4) AS "ADIDA"
FROM rec, (SELECT unnest(range(1, 8)) AS k)"""
ORACLES["coherence_gap"] = _MINT + """,
gaps AS (SELECT 'base' AS stage, f.k0 AS node, any_value(f.f) - sum(g.f) AS gap FROM ad f JOIN S ON S.node = f.k0 JOIN ad g ON g.k0 = S.bottom GROUP BY 2
         UNION ALL SELECT 'reconciled', f.node, any_value(f.f) - sum(g.f) FROM rec f JOIN S ON S.node = f.node JOIN rec g ON g.node = S.bottom GROUP BY 2)
SELECT stage, round(max(abs(gap)), 4) AS max_gap, 7 * count(*) AS n_checked FROM gaps GROUP BY 1"""


# ---------------------------------------------------------------- ARIMA(1,1,1) by two eliminations per seller

def _elimination(name: str, src: str, x: list[str], y: str, where: str, key: str = "seller_id") -> str:
    """CTEs ending in ``{name}`` (``key``, ``b``): least squares per ``key``."""
    k = len(x)
    row = lambda e: "[" + ", ".join(f"sum(({e}) * ({o}))" for o in [*x, y]) + "]"
    return f"""
{name}_g AS (SELECT {key}, 1 AS c, [{', '.join(row(e) for e in x)}] AS m FROM {src} WHERE {where} GROUP BY 1),
{name}_e AS (SELECT * FROM {name}_g UNION ALL
  SELECT {key}, c + 1, list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda v: v / r[c])
         ELSE list_transform(r, lambda v, j: v - r[c] * m[c][j] / m[c][c]) END) FROM {name}_e WHERE c <= {k}),
{name} AS (SELECT {key}, list_transform(m, lambda r: r[{k + 1}]) AS b FROM {name}_e WHERE c = {k + 1})"""


_TEN = [f"z{i}" for i in range(1, 11)]
ORACLES["arima"] = "WITH RECURSIVE " + SELLER_SPLIT.strip() + """,
zr AS (SELECT *, revenue - lag(revenue, 1) OVER w AS z0, row_number() OVER w AS rn FROM train WINDOW w AS (PARTITION BY seller_id ORDER BY month)),
zl AS (SELECT *, """ + ", ".join(f"lag(z0, {i}) OVER w AS z{i}" for i in range(1, 11)) + """ FROM zr WINDOW w AS (PARTITION BY seller_id ORDER BY month)),""" \
    + _elimination("long", "zl", ["1.0::DOUBLE", *_TEN], "z0", "rn > 11") + """,
ze AS (SELECT zl.*, CASE WHEN rn > 11 THEN z0 - (b[1] + """ + " + ".join(f"b[{i + 2}] * {z}" for i, z in enumerate(_TEN)) + """) ELSE 0.0 END AS e0
       FROM zl JOIN long USING (seller_id)),
zf AS (SELECT *, lag(e0, 1) OVER (PARTITION BY seller_id ORDER BY month) AS e1 FROM ze),""" \
    + _elimination("short", "zf", ["1.0::DOUBLE", "z1", "e1"], "z0", "rn > 12") + """,
fin AS (SELECT seller_id, max(month) AS last_ds, arg_max(revenue, month) AS y, arg_max(z0, month) AS z, arg_max(e0, month) AS e FROM zf GROUP BY 1),
ahead AS (SELECT seller_id, last_ds, 0 AS k, y, z, e, b FROM fin JOIN short USING (seller_id)
          UNION ALL SELECT seller_id, last_ds, k + 1, y + b[1] + b[2] * z + b[3] * e, b[1] + b[2] * z + b[3] * e, 0.0, b FROM ahead WHERE k < 3)
SELECT seller_id, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, 'ARIMA' AS model, round(y, 3) AS yhat FROM ahead WHERE k > 0"""
ORACLES["arima_blocked"] = ORACLES["arima"]

ORACLES["own_models"] = "WITH " + SELLER_SPLIT.strip() + """,
ends AS (SELECT seller_id, max(month) AS last_ds, arg_max(revenue, month) AS y, arg_min(revenue, month) AS y0, count(*) AS n FROM train GROUP BY 1)
SELECT seller_id, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, model,
       round(CASE model WHEN 'Last' THEN y ELSE y + k * (y - y0) / (n - 1) END, 4) AS yhat
FROM ends, (SELECT unnest(range(1, 4)) AS k), (SELECT unnest(['Last', 'Drift']) AS model)"""


# ---------------------------------------------------------------- partial autocorrelation: Durbin-Levinson over 14 lags

_ACF_CTES = ORACLES["acf"][:ORACLES["acf"].index("SELECT unique_id, 0 AS lag")]
ORACLES["pacf"] = _ACF_CTES.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
ra AS (SELECT unique_id, [""" + ", ".join(f"(p{k} / (n - {k})) / (p0 / n)" for k in range(15)) + """] AS r FROM sm),
dl AS (SELECT unique_id, r, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS v FROM ra
       UNION ALL
       SELECT unique_id, r, k + 1, list_append(list_transform(phi, lambda x, i: x - w * phi[len(phi) + 1 - i]), w), w
       FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(phi, lambda x, i: x * r[k + 2 - i])), 0))
                       / (1 - coalesce(list_sum(list_transform(phi, lambda x, i: x * r[i + 1])), 0)) AS w FROM dl WHERE k < 14))
SELECT unique_id, k AS lag, round(v, 5) AS pacf FROM dl"""
ORACLES["pacf_blocked"] = ORACLES["pacf"]


# ---------------------------------------------------------------- nearest neighbours, all pairs

_KNN = ["lag1", "lag7", "lag14", "expanding_mean_lag7"]
ORACLES["knn_forecast"] = "WITH lf AS (" + ORACLES["lag_features"] + """),
lab AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 7 AS is_test FROM lf),
st AS (SELECT """ + ", ".join(f"avg({f}) AS m{i}, 1.0::DOUBLE / stddev_pop({f}) AS s{i}" for i, f in enumerate(_KNN)) + """ FROM lab WHERE NOT is_test),
z AS MATERIALIZED (SELECT unique_id, ds, y, is_test, """ + ", ".join(f"({f} - m{i}) * s{i} AS x{i}" for i, f in enumerate(_KNN)) + """ FROM lab, st),
near AS (SELECT q.unique_id, q.ds, q.y, arg_min(t.y, {'d': round(sqrt(""" + " + ".join(f"(q.x{i} - t.x{i}) ** 2" for i in range(4)) + """), 9), 'u': t.unique_id, 't': t.ds}, 5) AS n
         FROM (SELECT * FROM z WHERE is_test) q, (SELECT * FROM z WHERE NOT is_test) t GROUP BY 1, 2, 3)
SELECT unique_id, ds, y, round(list_avg(n), 6) AS knn FROM near"""

ORACLES["forecast_table_fn_seasonal"] = "WITH " + SELLER_SPLIT.strip() + """,
g AS (SELECT s.*, unnest(range(1, date_diff('month', s.last_ds, TIMESTAMP '2001-12-01'))) AS k FROM summ s WHERE n >= 12)
SELECT CAST(g.seller_id AS VARCHAR) AS grp, CAST(g.last_ds + to_months(CAST(g.k AS INTEGER)) AS TIMESTAMP) AS ds, round(tr.revenue, 6) AS forecast,
       round(tr.revenue - 1.2815515655446004 * sqrt(s2s) * sqrt(floor((g.k - 1) / 12) + 1), 6) AS lower,
       round(tr.revenue + 1.2815515655446004 * sqrt(s2s) * sqrt(floor((g.k - 1) / 12) + 1), 6) AS upper
FROM g JOIN tr ON tr.seller_id = g.seller_id AND tr.rd = 12 - ((g.k - 1) % 12)"""


# ---------------------------------------------------------------- covariate quantile forecast: a least-squares fit per step, on centred features

_COV = ["revenue", "order_count", "avg_price", "avg_freight", "avg_delivery_days", "avg_review_score"]
_CEN = [f"c{i}" for i in range(len(_COV))]
ORACLES["quantile_forecast_covariates"] = "WITH RECURSIVE " + seller_panel_ctes(8) + """,
tc AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY month DESC) > 3),
st AS (SELECT seller_id, month, """ + ", ".join(f"{f}::DOUBLE - avg({f}) OVER () AS c{i}" for i, f in enumerate(_COV)) + """,
              """ + ", ".join(f"lead(revenue, {k}) OVER w::DOUBLE AS t{k}" for k in (1, 2, 3)) + """, lead(month) OVER w IS NULL AS is_last
       FROM tc WINDOW w AS (PARTITION BY seller_id ORDER BY month)),""" + ",".join(
    normal_equations(f"(SELECT * FROM st WHERE t{k} IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in _CEN)})", _CEN, f"t{k}", f"k{k}") for k in (1, 2, 3)) + """,
sc AS (""" + " UNION ALL ".join(f"SELECT seller_id, month, {k} AS k, t{k} AS t, is_last, {_linear(_CEN)} AS p FROM st, k{k}beta" for k in (1, 2, 3)) + """),
qs AS (SELECT seller_id, k, quantile_cont(t - p, [0.1, 0.5, 0.9]) AS q FROM sc WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT sc.seller_id, CAST(month + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS month, round(p, 2) AS predictions,
       round(p + q[1], 2) AS "0.1", round(p + q[2], 2) AS "0.5", round(p + q[3], 2) AS "0.9"
FROM sc JOIN qs USING (seller_id, k) WHERE is_last"""


# ---------------------------------------------------------------- STL with season 3, by tricube lines over the nearest 7 (or 3) values
# All panels are longer than seven cycles, so every smoother has its full span.

def _tricube_rows(span: int, beyond: int) -> str:
    """Weights of ``span`` neighbours for the local line at places ``-beyond .. span - 1 + beyond`` among them, as a SQL list."""
    rows = []
    for x0 in range(-beyond, span + beyond):
        top = max(abs(x0), abs(span - 1 - x0)) * 1.000001
        w = [(1 - (abs(i - x0) / top) ** 3) ** 3 for i in range(span)]
        mean = sum(a * i for i, a in enumerate(w)) / sum(w)
        spread = sum(a * (i - mean) ** 2 for i, a in enumerate(w))
        # the line through the weighted mean; flat if all weight lies on one place
        rows.append([a / sum(w) + (a * (i - mean) * (x0 - mean) / spread if spread > 1e-12 else 0.0) for i, a in enumerate(w)])
    return str(rows) + "::DOUBLE[][]"


def _smoothed(x: str, span: int, beyond: int) -> str:
    first = f"greatest(0, least(i - {span // 2}, len({x}) - {span}))"
    return (f"[list_sum([{x}[{first} + j] * w{span}_{beyond}[i - {first} + {beyond + 1}][j] FOR j IN range(1, {span + 1})]) "
            f"FOR i IN range({-beyond}, len({x}) + {beyond})]")


def _stl_round(k: int) -> str:
    ma = lambda x: f"[({x}[i] + {x}[i + 1] + {x}[i + 2]) / 3 FOR i IN range(1, len({x}) - 1)]"
    subs = ", ".join(f"[u[{p} + 3 * j] FOR j IN range(0, (len(u) - {p}) // 3 + 1)] AS v{p}" for p in (1, 2, 3))
    return f"""
q{k}a AS (SELECT *, [y[i] - trend[i] FOR i IN range(1, len(y) + 1)] AS u FROM q{k}),
q{k}b AS (SELECT *, {subs} FROM q{k}a),
q{k}c AS (SELECT *, {', '.join(_smoothed(f"v{p}", 7, 1) + f" AS m{p}" for p in (1, 2, 3))} FROM q{k}b, weights),
q{k}d AS (SELECT seller_id, ts, y, w3_0, w7_0, [CASE i % 3 WHEN 0 THEN m1[i // 3 + 1] WHEN 1 THEN m2[i // 3 + 1] ELSE m3[i // 3 + 1] END FOR i IN range(0, len(y) + 6)] AS c FROM q{k}c),
q{k}e AS (SELECT *, {ma('c')} AS a1 FROM q{k}d),
q{k}f AS (SELECT *, {ma('a1')} AS a2 FROM q{k}e),
q{k}g AS (SELECT *, {ma('a2')} AS a3 FROM q{k}f),
q{k}h AS (SELECT *, {_smoothed('a3', 3, 0)} AS low FROM q{k}g),
q{k}i AS (SELECT *, [c[i + 3] - low[i] FOR i IN range(1, len(y) + 1)] AS season FROM q{k}h),
q{k}j AS (SELECT *, [y[i] - season[i] FOR i IN range(1, len(y) + 1)] AS rest FROM q{k}i),
q{k + 1} AS (SELECT seller_id, ts, y, season, {_smoothed('rest', 7, 0)} AS trend FROM q{k}j)"""


ORACLES["stl_features"] = "WITH " + seller_panel_ctes(8) + f""",
weights AS (SELECT {_tricube_rows(7, 1)} AS w7_1, {_tricube_rows(7, 0)} AS w7_0, {_tricube_rows(3, 0)} AS w3_0),
q0 AS (SELECT seller_id, ts, y, [0.0::DOUBLE FOR v IN y] AS trend FROM (
         SELECT seller_id, list(month ORDER BY month) AS ts, list(revenue::DOUBLE ORDER BY month) AS y FROM panel GROUP BY 1)),""" \
    + _stl_round(0) + "," + _stl_round(1) + """
SELECT seller_id, unnest(ts) AS month, round(unnest(trend), 5) AS trend, round(unnest(season), 5) AS seasonal, 'history' AS part FROM q2
UNION ALL
SELECT seller_id, CAST(ts[len(ts)] + to_months(CAST(k AS INTEGER)) AS TIMESTAMP), round(trend[len(y)] + k * (trend[len(y)] - trend[len(y) - 3]) / 3, 5),
       round(season[len(y) - 3 + 1 + (k - 1) % 3], 5), 'future' FROM q2, (SELECT unnest(range(1, 4)) AS k)"""
ORACLES["stl_features_blocked"] = ORACLES["stl_features"]


# ---------------------------------------------------------------- ARIMA order search: every order's system out of the moments of its difference

_FIVE = ["1.0::DOUBLE", *[f"z{i}" for i in range(1, 6)], *[f"e{j}" for j in range(1, 6)]]


def _difference_ctes(d: int) -> str:
    """CTEs ending in ``gm{d}``: per seller the moments, and the last values and innovations (newest first)."""
    w = "WINDOW w AS (PARTITION BY seller_id ORDER BY month)"
    z = ["revenue::DOUBLE", "revenue - lag(revenue, 1) OVER w", "revenue - 2 * lag(revenue, 1) OVER w + lag(revenue, 2) OVER w"][d]
    every = [*_FIVE, "z0"]
    moments = "[" + ", ".join("[" + ", ".join(f"sum(({a}) * ({b}))" for b in every) + "]" for a in every) + "]"
    return f"""
zr{d} AS (SELECT *, {z} AS z0, revenue - lag(revenue, 1) OVER w AS d1, row_number() OVER w AS rn FROM train {w}),
zl{d} AS (SELECT *, {', '.join(f'lag(z0, {i}) OVER w AS z{i}' for i in range(1, 11))} FROM zr{d} {w}),""" \
        + _elimination(f"long{d}", f"zl{d}", ["1.0::DOUBLE", *_TEN], "z0", f"rn > {d + 10}") + f""",
ze{d} AS (SELECT zl{d}.*, CASE WHEN rn > {d + 10} THEN z0 - (b[1] + {' + '.join(f'b[{i + 2}] * {x}' for i, x in enumerate(_TEN))}) WHEN rn > {d} THEN 0.0 END AS e0
         FROM zl{d} JOIN long{d} USING (seller_id)),
zf{d} AS (SELECT *, {', '.join(f'lag(e0, {j}) OVER w AS e{j}' for j in range(1, 6))} FROM ze{d} {w}),
gm{d} AS (SELECT seller_id, {d} AS d, g, zs, es, y, d1, last_ds FROM (SELECT seller_id, {moments} AS g FROM zf{d} WHERE rn > 17 GROUP BY 1)
         JOIN (SELECT seller_id, [z0, z1, z2, z3, z4] AS zs, [e0, e1, e2, e3, e4] AS es, revenue AS y, d1, month AS last_ds FROM zf{d}
               QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY month DESC) = 1) USING (seller_id))"""


ORACLES["auto_arima"] = "WITH RECURSIVE " + SELLER_SPLIT.strip() + "," + ",".join(_difference_ctes(d) for d in range(3)) + """,
gm AS (SELECT * FROM gm0 UNION ALL SELECT * FROM gm1 UNION ALL SELECT * FROM gm2),
ca AS (SELECT p, q, [1] || [i + 1 FOR i IN range(1, p + 1)] || [j + 6 FOR j IN range(1, q + 1)] AS ix
       FROM (SELECT unnest(range(0, 6)) AS p), (SELECT unnest(range(0, 6)) AS q)),
se AS (SELECT seller_id, d, p, q, ix, 1 AS c, [list_append([g[i][j] FOR j IN ix], g[i][12]) FOR i IN ix] AS m FROM gm, ca
       UNION ALL
       SELECT seller_id, d, p, q, ix, c + 1, list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda v: v / r[c])
              ELSE list_transform(r, lambda v, j: v - r[c] * m[c][j] / m[c][c]) END) FROM se WHERE c <= len(m)),
sc AS (SELECT seller_id, d, p, q, ix, list_transform(m, lambda r: r[len(m) + 1]) AS b FROM se WHERE c = len(m) + 1),
sd AS (SELECT sc.*, gm.* EXCLUDE (seller_id, d), g[1][1] AS n, p + q + 1 AS k, g[12][12] - list_sum([b[i] * g[ix[i]][12] FOR i IN range(1, len(b) + 1)]) AS sse
       FROM sc JOIN gm USING (seller_id, d)),
win AS (SELECT * FROM sd WHERE sse > 0 AND n - k - 1 > 0
        QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY n * ln(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), d, p, q) = 1),
fw AS (SELECT seller_id, last_ds, d, p, q, b, 0 AS h, zs, es, y, d1 FROM win
       UNION ALL
       SELECT seller_id, last_ds, d, p, q, b, h + 1, [v] || zs, [0.0::DOUBLE] || es,
              CASE d WHEN 0 THEN v WHEN 1 THEN y + v ELSE y + d1 + v END, d1 + v
       FROM (SELECT *, b[1] + coalesce(list_sum([b[1 + i] * zs[i] FOR i IN range(1, p + 1)]), 0)
                       + coalesce(list_sum([b[1 + p + j] * es[j] FOR j IN range(1, q + 1)]), 0) AS v FROM fw WHERE h < 3))
SELECT seller_id, CAST(last_ds + to_months(CAST(h AS INTEGER)) AS TIMESTAMP) AS month, 'AutoARIMA' AS model, format('({},{},{})', p, d, q) AS "order",
       round(y, 3) AS yhat FROM fw WHERE h > 0"""
