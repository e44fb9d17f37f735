"""ANSI-SQL twins of the DataFrame plans, run by DuckDB over the same parquet tables.

``BASE`` rebuilds the retention tables (FIXTURES.md §3) as CTEs: ``cc`` (customer_churn),
``ds`` (data_sources), ``cp`` (churn_predictions) and ``scored`` (ACTIVE_SCORED, J1).
Every floating literal is cast to DOUBLE so both engines add the same binary values in the same
order.
"""

from __future__ import annotations


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


SCORE = f"""((((((({d(0.0)} + CASE WHEN lower(coalesce(contract_type, '')) IN ('month-to-month', 'month to month', 'monthly', 'm2m') THEN {d(0.2)}
            WHEN lower(coalesce(contract_type, '')) IN ('one year', '1 year', 'annual', 'yearly') THEN {d(0.05)}
            WHEN lower(coalesce(contract_type, '')) IN ('two year', '2 year', 'two-year', '2-year') THEN {d(-0.05)}
            ELSE {d(0.0)} END)
   + least({d(0.25)}, coalesce(CAST(support_tickets AS DOUBLE), {d(0)}) * {d(0.04)}))
   + least({d(0.25)}, coalesce(CAST(complaint_count AS DOUBLE), {d(0)}) * {d(0.08)}))
   + least({d(0.25)}, coalesce(CAST(payment_delays AS DOUBLE), {d(0)}) * {d(0.12)}))
   + greatest({d(0.0)}, ({d(5.0)} - coalesce(CAST(customer_satisfaction_score AS DOUBLE), {d(5)})) * {d(0.08)}))
   + CASE WHEN coalesce(CAST(tenure_months AS DOUBLE), {d(0)}) < 12 THEN {d(0.12)}
          WHEN coalesce(CAST(tenure_months AS DOUBLE), {d(0)}) < 24 THEN {d(0.06)} ELSE {d(0.0)} END)
   + CASE WHEN coalesce(CAST(product_usage AS DOUBLE), {d(0)}) < 20 THEN {d(0.1)} ELSE {d(0.0)} END)"""

CUSTOMER_SQL = """
o AS (
  SELECT o_custkey, sum(o_totalprice) AS tp, max(o_orderdate) AS last_o,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urg,
         sum(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS late
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey,
         sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS compl,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret, count(*) AS n_line
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey),
e AS (SELECT user_id, count(*) AS n_use FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
b AS (
  SELECT concat('C', lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(9, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')) AS customer_id,
         concat('src_', lower(c_mktsegment)) AS source_id,
         CAST((c_custkey * 37) % 73 AS BIGINT) AS tenure_months,
         round(tp / CAST(31600 AS DOUBLE), 2) AS monthly_charges,
         CASE c_nationkey % 4 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' WHEN 2 THEN 'Two year' END AS contract_type,
         CASE c_custkey % 3 WHEN 0 THEN 'Fiber optic' WHEN 1 THEN 'DSL' ELSE 'No' END AS internet_service,
         CASE c_custkey % 5 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer' WHEN 3 THEN 'Credit card' END AS payment_method,
         r_name AS region,
         CAST(urg AS BIGINT) AS support_tickets, CAST(late AS BIGINT) AS payment_delays,
         CAST(n_use AS DOUBLE) AS product_usage, CAST(compl AS BIGINT) AS complaint_count,
         CASE WHEN n_line IS NULL THEN NULL
              WHEN CAST(5 AS DOUBLE) - CAST(6 AS DOUBLE) * n_ret / n_line < 1 THEN CAST(1 AS DOUBLE)
              ELSE round(CAST(5 AS DOUBLE) - CAST(6 AS DOUBLE) * n_ret / n_line, 1) END AS customer_satisfaction_score,
         CAST(CASE WHEN last_o IS NULL THEN NULL WHEN last_o < TIMESTAMP '2000-11-01 00:00:00' THEN 1 ELSE 0 END AS BIGINT) AS churned
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey),
cc AS (
  SELECT customer_id, source_id, tenure_months, monthly_charges, round(monthly_charges * tenure_months, 2) AS total_charges,
         contract_type, internet_service, payment_method, region, support_tickets, payment_delays, product_usage,
         complaint_count, customer_satisfaction_score, churned
  FROM b)"""

BASE = f"""WITH {CUSTOMER_SQL.strip()},
ds AS (
  SELECT source_id, concat(source_id, '.csv') AS filename, count(*) AS row_count,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at,
         CASE WHEN source_id = 'src_furniture' THEN 0 ELSE 1 END AS is_active
  FROM cc GROUP BY source_id),
cp0 AS (SELECT customer_id, least({d(1.0)}, greatest({d(0.0)}, {SCORE})) AS predicted_probability FROM cc),
cp AS (
  SELECT customer_id, predicted_probability,
         CASE WHEN predicted_probability >= {d(0.6)} THEN 'high_risk' ELSE 'low_risk' END AS prediction_label,
         greatest({d(0.0)}, least({d(1.0)}, predicted_probability - {d(0.08)})) AS ci_lower,
         least({d(1.0)}, greatest({d(0.0)}, predicted_probability + {d(0.08)})) AS ci_upper,
         TIMESTAMP '2024-01-02 00:00:00' AS created_at
  FROM cp0),
scored AS (
  SELECT cp.customer_id, cp.predicted_probability, cp.prediction_label, cp.ci_lower, cp.ci_upper,
         cc.source_id, cc.tenure_months, cc.monthly_charges, cc.total_charges, cc.contract_type, cc.internet_service,
         cc.payment_method, cc.region, cc.support_tickets, cc.payment_delays, cc.product_usage, cc.complaint_count,
         cc.customer_satisfaction_score, cc.churned
  FROM cp JOIN cc ON cp.customer_id = cc.customer_id JOIN ds ON cc.source_id = ds.source_id
  WHERE ds.is_active = 1),
allscored AS (
  SELECT cp.customer_id, cp.predicted_probability, cp.prediction_label, cp.ci_lower, cp.ci_upper,
         cc.source_id, cc.tenure_months, cc.monthly_charges, cc.total_charges, cc.contract_type, cc.internet_service,
         cc.payment_method, cc.region, cc.support_tickets, cc.payment_delays, cc.product_usage, cc.complaint_count,
         cc.customer_satisfaction_score, cc.churned
  FROM cp LEFT JOIN cc ON cp.customer_id = cc.customer_id)"""


def q(body: str) -> str:
    """A query over the base CTEs."""
    return f"{BASE}\n{body.strip()}"
