"""The registered questions: name -> (Spark DataFrame function, DuckDB SQL twin or None).

Each Spark function takes ``(spark, sf_dir)``, reads the driver tables (through the stored
retention tables of :mod:`ebbtide.plans.warehouse`) and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG
from ebbtide.operators import aggregates as A
from ebbtide.plans.sql_twins import SCORE as SCORE_SQL, d, q
from ebbtide.plans.warehouse import warehouse
from ebbtide.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def W(spark, sf_dir):
    return warehouse(spark, sf_dir, DEFAULT_CONFIG)


# ---------------------------------------------------------------- model tables

@register("customer_model", q("SELECT * FROM cc"))
def _customer_model(spark, sf_dir):
    return W(spark, sf_dir).customers


@register("data_sources", q("SELECT * FROM ds"))
def _data_sources(spark, sf_dir):
    return W(spark, sf_dir).sources


@register("heuristic_predictions", q("""
SELECT customer_id, round(predicted_probability, 6) AS predicted_probability, prediction_label,
       round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, created_at
FROM cp"""))
def _predictions(spark, sf_dir):
    p = W(spark, sf_dir).predictions
    return p.select("customer_id", F.round("predicted_probability", 6).alias("predicted_probability"),
                    "prediction_label", F.round("ci_lower", 6).alias("ci_lower"),
                    F.round("ci_upper", 6).alias("ci_upper"), "created_at")


# ---------------------------------------------------------------- aggregates

_SEGMENT_UNION = " UNION ALL ".join(
    f"SELECT '{A._display(c)}' AS dimension, {c} AS value, predicted_probability AS p, "
    f"monthly_charges * predicted_probability AS loss FROM scored" for c in A.SEGMENT_DIMENSIONS)
SEGMENT_SQL = f"""
SELECT dimension, value, count(*) AS customers, round(avg(p), 3) AS avg_risk, round(sum(loss), 2) AS expected_loss
FROM ({_SEGMENT_UNION}) s WHERE value IS NOT NULL GROUP BY dimension, value"""


@register("segment_loss", q(SEGMENT_SQL))
def _segment_loss(spark, sf_dir):
    return A.segment_loss(W(spark, sf_dir).active_scored())


@register("top_segments", q(f"SELECT * FROM ({SEGMENT_SQL}) t ORDER BY expected_loss DESC, dimension, value LIMIT 2"))
def _top_segments(spark, sf_dir):
    return A.top_segments(W(spark, sf_dir).active_scored(), 2)


_SUMMARY = """SELECT prediction_label AS label, count(*) AS customers, round(avg(predicted_probability), 3) AS avg_probability
FROM {t} GROUP BY prediction_label"""


@register("risk_summary", q(_SUMMARY.format(t="scored")))
def _risk_summary(spark, sf_dir):
    return A.risk_summary(W(spark, sf_dir).active_scored())


@register("risk_summary_all", q(_SUMMARY.format(t="cp")))
def _risk_summary_all(spark, sf_dir):
    return A.risk_summary(W(spark, sf_dir).predictions)


_ACTIONS = DEFAULT_CONFIG.retention_actions


@register("business_summary", q(f"""
SELECT s.*, CASE label WHEN 'high_risk' THEN '{_ACTIONS['high_risk']}' WHEN 'low_risk' THEN '{_ACTIONS['low_risk']}'
                 ELSE 'Review customer engagement' END AS recommended_action
FROM ({_SUMMARY.format(t='cp')}) s"""))
def _business_summary(spark, sf_dir):
    return A.business_summary(W(spark, sf_dir).predictions)


@register("risk_mix", q("SELECT prediction_label, count(*) AS customers FROM scored GROUP BY prediction_label"))
def _risk_mix(spark, sf_dir):
    return A.risk_mix(W(spark, sf_dir).active_scored())


def _sig_sql(i, name, col, op, v):
    cond = f"coalesce(CAST({col} AS DOUBLE), 0) {'=' if op == '==' else op} {v}"
    return f"SELECT {i} AS ordinal, '{name}' AS signal, count(*) FILTER (WHERE {cond}) AS customers FROM scored"


@register("signals", q("SELECT * FROM (" + " UNION ALL ".join(_sig_sql(i, *s) for i, s in enumerate(A.SIGNALS))
                       + ") t WHERE customers > 0"))
def _signals(spark, sf_dir):
    return A.signals(W(spark, sf_dir).active_scored())


@register("role_counts", q("""
SELECT count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(support_tickets, 0) >= 3) AS ticket_heavy,
       count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(complaint_count, 0) >= 3) AS complaint_heavy,
       count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(customer_satisfaction_score, 0) <= 2) AS low_satisfaction,
       count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(payment_delays, 0) >= 1) AS payment_delayed
FROM allscored"""))
def _role_counts(spark, sf_dir):
    return A.role_counts(W(spark, sf_dir).all_scored())


def _kpi_sql(rate: float) -> str:
    return f"""
SELECT total_customers, high_risk_count, low_risk_count,
       round(coalesce(a, 0) * 100, 2) AS avg_probability_pct,
       round(coalesce(m, 0) * {d(rate)}, 2) AS total_mrr,
       round(coalesce(r, 0) * {d(rate)}, 2) AS risk_mrr,
       round(coalesce(r, 0) * {d(rate)} * 12, 2) AS risk_arr,
       round(CASE WHEN total_customers > 0 THEN high_risk_count / total_customers * 100 ELSE 0.0 END, 2) AS high_risk_pct
FROM (SELECT count(*) AS total_customers,
             count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_risk_count,
             count(*) FILTER (WHERE prediction_label = 'low_risk') AS low_risk_count,
             avg(predicted_probability) AS a, sum(monthly_charges) AS m,
             sum(CASE WHEN prediction_label = 'high_risk' THEN monthly_charges ELSE 0.0 END) AS r
      FROM scored) t"""


@register("kpis", q(_kpi_sql(1.0)))
def _kpis(spark, sf_dir):
    return A.kpis(W(spark, sf_dir).active_scored())


@register("kpis_eur", q(_kpi_sql(A.currency_rate("EUR"))))
def _kpis_eur(spark, sf_dir):
    return A.kpis(W(spark, sf_dir).active_scored(), rate=A.currency_rate("EUR"))


@register("exposure", q("""
SELECT total_customers, round(c, 2) AS total_charges, round(l, 2) AS expected_loss,
       CASE WHEN c > 0 THEN round(l / c * 100, 1) ELSE 0.0 END AS risk_exposure_pct
FROM (SELECT count(*) AS total_customers, coalesce(sum(monthly_charges), 0.0) AS c,
             coalesce(sum(monthly_charges * predicted_probability), 0.0) AS l FROM scored) t"""))
def _exposure(spark, sf_dir):
    return A.exposure(W(spark, sf_dir).active_scored())


@register("contract_breakdown", q("""
SELECT coalesce(contract_type, 'unknown') AS contract, contract_type IS NULL AS is_null_group, count(*) AS cnt,
       count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_risk_cnt
FROM scored GROUP BY contract_type"""))
def _contract_breakdown(spark, sf_dir):
    return A.contract_breakdown(W(spark, sf_dir).active_scored())


@register("contract_risk", q("""
SELECT cc.contract_type, count(*) AS cnt, round(avg(cp.predicted_probability), 12) AS risk
FROM cp JOIN cc ON cp.customer_id = cc.customer_id WHERE cc.contract_type IS NOT NULL GROUP BY cc.contract_type"""))
def _contract_risk(spark, sf_dir):
    w = W(spark, sf_dir)
    return A.contract_risk(w.predictions.join(w.customers, "customer_id"))


_TENURE_CASE = """CASE WHEN tenure_months <= 3 THEN '0-3 Months' WHEN tenure_months <= 6 THEN '4-6 Months'
     WHEN tenure_months <= 12 THEN '7-12 Months' WHEN tenure_months <= 24 THEN '13-24 Months' ELSE '25+ Months' END"""


@register("tenure_buckets", q(f"""
SELECT {_TENURE_CASE} AS tenure_bucket, count(*) AS cnt, round(avg(predicted_probability), 12) AS avg_prob
FROM scored GROUP BY 1"""))
def _tenure_buckets(spark, sf_dir):
    return A.tenure_buckets(W(spark, sf_dir).active_scored())


def _curve_sql(total: str, churned: str) -> str:
    return ", ".join(f"CAST(floor(({total} - {churned} * {d(f)}) / {total} * {d(100)} + {d(0.5)}) AS BIGINT) AS {n}"
                     for n, f in A.RETENTION_FACTORS)


_COHORT = "CASE WHEN contract_type IS NULL OR contract_type = '' THEN 'Month-to-month' ELSE contract_type END"
_CHURN = "(prediction_label = 'high_risk' OR coalesce(CAST(churned AS DOUBLE) = 1.0, false))"


@register("cohort_retention", q(f"""
SELECT cohort, total, churned, {_curve_sql('total', 'churned')}
FROM (SELECT {_COHORT} AS cohort, count(*) AS total, count(*) FILTER (WHERE {_CHURN}) AS churned
      FROM scored GROUP BY 1) t"""))
def _cohort_retention(spark, sf_dir):
    return A.cohort_retention(W(spark, sf_dir).active_scored())


DRILL_SELECTORS = ["all", "contract_Month-to-month", "contract_One year", "contract_Two year", "contract_Monthly",
                   "support_high", "support_low"]
_DRILL_VALUES = ", ".join(f"('{s}')" for s in DRILL_SELECTORS)


@register("retention_drilldown", q(f"""
, tagged AS (
  SELECT 'all' AS selector, {_CHURN} AS c FROM scored
  UNION ALL SELECT concat('contract_', {_COHORT}), {_CHURN} FROM scored
  UNION ALL SELECT CASE WHEN coalesce(CAST(support_tickets AS DOUBLE), 0) >= 3 THEN 'support_high' ELSE 'support_low' END,
                   {_CHURN} FROM scored),
g AS (SELECT selector, count(*) AS total, count(*) FILTER (WHERE c) AS high_risk_count FROM tagged GROUP BY selector),
j AS (SELECT w.selector, CAST(coalesce(g.total, 0) AS BIGINT) AS total, CAST(coalesce(g.high_risk_count, 0) AS BIGINT) AS hr
      FROM (VALUES {_DRILL_VALUES}) AS w(selector) LEFT JOIN g ON w.selector = g.selector)
SELECT selector, total, hr AS high_risk_count,
       {', '.join(f"CASE WHEN total > 0 THEN CAST(floor((total - hr * {d(f)}) / total * {d(100)} + {d(0.5)}) AS BIGINT) ELSE {e} END AS {n}" for (n, f), e in zip(A.RETENTION_FACTORS, A.EMPTY_CURVE))}
FROM j"""))
def _retention_drilldown(spark, sf_dir):
    return A.retention_drilldown(W(spark, sf_dir).active_scored(), DRILL_SELECTORS)


ROI_PARAMS = dict(threshold=0.5, discount=0.15, success=0.3)


@register("campaign_roi", q(f"""
SELECT targeted, round(rev, 2) AS revenue, round(cost, 4) AS cost, round(gross, 4) AS gross, round(gross - cost, 4) AS net,
       round(CASE WHEN cost > 0 THEN (gross - cost) / cost * 100 ELSE 0.0 END, 2) AS roi_pct,
       CASE WHEN CASE WHEN cost > 0 THEN (gross - cost) / cost * 100 ELSE 0.0 END >= 20 THEN 'success'
            WHEN CASE WHEN cost > 0 THEN (gross - cost) / cost * 100 ELSE 0.0 END >= 0 THEN 'warning'
            ELSE 'danger' END AS band
FROM (SELECT targeted, rev, rev * {d(ROI_PARAMS['discount'])} * {d(1.0)} AS cost, rev * {d(ROI_PARAMS['success'])} * {d(1.0)} AS gross
      FROM (SELECT count(*) AS targeted, coalesce(sum(coalesce(monthly_charges, {d(100)})), 0.0) AS rev
            FROM scored WHERE coalesce(predicted_probability, 0) >= {d(ROI_PARAMS['threshold'])}) a) b"""))
def _campaign_roi(spark, sf_dir):
    return A.campaign_roi(W(spark, sf_dir).active_scored(), **ROI_PARAMS)


SWEEP = dict(thresholds=[0.3, 0.5, 0.6, 0.8], discounts=[0.1, 0.2], successes=[0.25, 0.5])


def _sweep_sql() -> str:
    grid = " UNION ALL ".join(f"SELECT {d(t)} AS threshold, {d(x)} AS discount, {d(y)} AS success"
                              for t in SWEEP["thresholds"] for x in SWEEP["discounts"] for y in SWEEP["successes"])
    return q(f"""
, grid AS ({grid}),
agg AS (SELECT g.threshold, g.discount, g.success,
               count(s.customer_id) AS targeted,
               coalesce(sum(coalesce(s.monthly_charges, {d(100)})), 0.0) AS revenue
        FROM grid g LEFT JOIN scored s ON coalesce(s.predicted_probability, 0.0) >= g.threshold
        GROUP BY g.threshold, g.discount, g.success)
SELECT threshold, discount, success, targeted, round(revenue, 2) AS revenue,
       round(revenue * discount * {d(1.0)}, 4) AS cost, round(revenue * success * {d(1.0)}, 4) AS gross,
       round(revenue * success * {d(1.0)} - revenue * discount * {d(1.0)}, 4) AS net,
       round(CASE WHEN revenue * discount * {d(1.0)} > 0
                  THEN (revenue * success * {d(1.0)} - revenue * discount * {d(1.0)}) / (revenue * discount * {d(1.0)}) * 100
                  ELSE 0.0 END, 2) AS roi_pct,
       CASE WHEN (CASE WHEN revenue * discount * {d(1.0)} > 0
                  THEN (revenue * success * {d(1.0)} - revenue * discount * {d(1.0)}) / (revenue * discount * {d(1.0)}) * 100
                  ELSE 0.0 END) >= 20 THEN 'success'
            WHEN (CASE WHEN revenue * discount * {d(1.0)} > 0
                  THEN (revenue * success * {d(1.0)} - revenue * discount * {d(1.0)}) / (revenue * discount * {d(1.0)}) * 100
                  ELSE 0.0 END) >= 0 THEN 'warning' ELSE 'danger' END AS band
FROM agg""")


@register("campaign_roi_sweep", _sweep_sql())
def _campaign_roi_sweep(spark, sf_dir):
    return A.campaign_roi_sweep(W(spark, sf_dir).active_scored(), **SWEEP)


@register("exposure_tips", q(f"""
SELECT high_risk, round(at_risk, 2) AS charges_at_risk, ticket_heavy,
       CASE WHEN high_risk > 0 THEN round(a * 100, 1) ELSE 0.0 END AS avg_high_prob_pct, low_satisfaction,
       CAST(CASE WHEN high_risk > 0 THEN floor(low_satisfaction / high_risk * 100 + 0.5) ELSE 0 END AS BIGINT) AS low_satisfaction_pct,
       round(at_risk * 0.40, 2) AS projected_gross, round(at_risk * 0.20, 2) AS projected_cost,
       round(greatest(0.0, at_risk * 0.40 - at_risk * 0.20), 2) AS projected_net
FROM (SELECT count(*) AS high_risk, coalesce(sum(coalesce(monthly_charges, {d(100)})), 0.0) * {d(1.0)} AS at_risk,
             count(*) FILTER (WHERE coalesce(CAST(support_tickets AS DOUBLE), 0) >= 3) AS ticket_heavy,
             avg(coalesce(predicted_probability, 0)) AS a,
             count(*) FILTER (WHERE coalesce(CAST(customer_satisfaction_score AS DOUBLE), 5) <= 2) AS low_satisfaction
      FROM scored WHERE prediction_label = 'high_risk') t""".replace("0.40", d(0.40)).replace("0.20", d(0.20))))
def _exposure_tips(spark, sf_dir):
    return A.exposure_tips(W(spark, sf_dir).active_scored())


_SCORED_FIELDS = 21  # columns of ACTIVE_SCORED: 7 prediction + 14 customer columns


@register("executive_summary", q(f"""
SELECT total, high_risk, total - high_risk AS low_risk, round(coalesce(a, 0.0), 3) AS avg_probability,
       CAST({_SCORED_FIELDS} AS BIGINT) AS field_count
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_risk,
             avg(coalesce(predicted_probability, 0)) AS a FROM scored) t"""))
def _executive_summary(spark, sf_dir):
    return A.executive_summary(W(spark, sf_dir).active_scored())


@register("risk_trend", """
SELECT CAST(ts AS DATE) AS recorded_date,
       round(avg(least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), value / CAST(500.0 AS DOUBLE)))), 12) AS probability,
       count(*) AS snapshots
FROM events GROUP BY 1""")
def _risk_trend(spark, sf_dir):
    return A.risk_trend(fixtures.risk_history(spark, sf_dir))


@register("ab_outcomes", q("""
SELECT campaign_name, round(pr, 4) AS predicted_churn_rate, round(ac, 4) AS actual_churn_rate, sample_size,
       ac < pr AS won, round(pr - ac, 4) AS lift
FROM (SELECT contract_type AS campaign_name, avg(predicted_probability) AS pr, avg(CAST(churned AS DOUBLE)) AS ac,
             count(*) AS sample_size FROM scored WHERE contract_type IS NOT NULL GROUP BY contract_type) t"""))
def _ab_outcomes(spark, sf_dir):
    return A.ab_outcomes(A.ab_tests_from_scored(W(spark, sf_dir).active_scored()))


# ---------------------------------------------------------------- top-k lists (K1–K6)

from ebbtide.operators import campaigns as C  # noqa: E402
from ebbtide.operators import ingest as I  # noqa: E402
from ebbtide.operators import joins as J  # noqa: E402
from ebbtide.operators import operations as O  # noqa: E402
from ebbtide.operators import projections as PR  # noqa: E402
from ebbtide.operators import registry as R  # noqa: E402
from ebbtide.operators import topk as K  # noqa: E402
from ebbtide.sources import sinks as S  # noqa: E402

TITLE_SQL = "array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)'), lambda s: upper(s[1]) || s[2:]), '')"


def title_sql(x: str) -> str:
    return TITLE_SQL.format(x=x)


@register("top_vulnerable", q(f"""
SELECT customer_id, predicted_probability, prediction_label, monthly_charges, tenure_months, contract_type,
       payment_method, region,
       CASE WHEN prediction_label = 'high_risk' THEN '{K.HIGH_ACTION}' ELSE '{K.LOW_ACTION}' END AS action
FROM scored ORDER BY predicted_probability DESC, customer_id LIMIT 25"""))
def _top_vulnerable(spark, sf_dir):
    return K.top_vulnerable(W(spark, sf_dir).active_scored(), 25)


@register("top_risk", q("""
SELECT customer_id, predicted_probability, prediction_label, region, contract_type, tenure_months, churned,
       support_tickets, payment_delays, product_usage, complaint_count, customer_satisfaction_score
FROM scored ORDER BY predicted_probability DESC, customer_id LIMIT 15"""))
def _top_risk(spark, sf_dir):
    return K.top_risk(W(spark, sf_dir).active_scored(), 15)


@register("high_risk_list", q(f"""
SELECT customer_id, predicted_probability, monthly_charges,
       {title_sql("replace(coalesce(contract_type, 'unknown'), '_', ' ')")} AS contract_display
FROM allscored WHERE prediction_label = 'high_risk' ORDER BY predicted_probability DESC, customer_id LIMIT 8"""))
def _high_risk_list(spark, sf_dir):
    return K.high_risk_list(W(spark, sf_dir).all_scored(), 8)


_AUDIT_SQL = """SELECT event_id AS log_id, event_type AS user_role, props AS action,
       concat('C', lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0')) AS target_customer, ts AS "timestamp" FROM events"""


@register("recent_audit", f"""
SELECT * FROM ({_AUDIT_SQL}) a ORDER BY "timestamp" DESC, log_id DESC LIMIT 50""")
def _recent_audit(spark, sf_dir):
    return K.recent_audit(fixtures.audit_logs(spark, sf_dir), 50)


_LATEST_ASSIGN_SQL = """
SELECT customer_id, csm_name, status, notes, last_updated, update_seq FROM (
  SELECT concat('C', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(9, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')) AS customer_id, o_orderpriority AS csm_name,
         o_orderstatus AS status, concat('order ', CAST(o_orderkey AS VARCHAR)) AS notes, o_orderdate AS last_updated,
         o_orderkey AS update_seq,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders {where}) t WHERE rn = 1"""


@register("recent_assignments", f"""
SELECT customer_id, csm_name, status, notes, last_updated
FROM ({_LATEST_ASSIGN_SQL.format(where='')}) l ORDER BY last_updated DESC, customer_id DESC LIMIT 8""")
def _recent_assignments(spark, sf_dir):
    return K.recent_assignments(O.latest_assignments(fixtures.assignment_updates(spark, sf_dir)), 8)


# ---------------------------------------------------------------- projections and scans

_P1_COLS = ("customer_id, predicted_probability, prediction_label, '[]' AS risk_drivers, ci_lower, ci_upper, region, "
            "contract_type, tenure_months, churned, support_tickets, payment_delays, product_usage, complaint_count, "
            "customer_satisfaction_score")


@register("predictions_list", q(f"SELECT {_P1_COLS} FROM scored ORDER BY predicted_probability DESC, customer_id"))
def _predictions_list(spark, sf_dir):
    return PR.predictions_list(W(spark, sf_dir).active_scored())


@register("filter_predictions", q("""
SELECT customer_id, predicted_probability, prediction_label FROM scored
WHERE prediction_label = 'high_risk' AND contains(lower(customer_id), '12')"""))
def _filter_predictions(spark, sf_dir):
    return PR.filter_predictions(W(spark, sf_dir).active_scored(), "high_risk", " 12 ").select(
        "customer_id", "predicted_probability", "prediction_label")


_P1_NAMES = ["risk_drivers", "ci_lower", "ci_upper", "region", "contract_type", "tenure_months", "support_tickets",
             "payment_delays", "product_usage", "complaint_count", "customer_satisfaction_score"]


@register("visible_columns", q(f"""
, head AS (SELECT {_P1_COLS} FROM scored),
counts AS ({' UNION ALL '.join(f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS n FROM head" for i, c in enumerate(_P1_NAMES))})
SELECT ordinal, column_name FROM counts WHERE n > 0 ORDER BY ordinal LIMIT 7"""))
def _visible_columns(spark, sf_dir):
    return PR.visible_columns(PR.predictions_list(W(spark, sf_dir).active_scored()), limit=7)


def _payload_sql(table: str, key: str, col: str) -> str:
    sqli = " OR ".join(f"regexp_matches(lower({col}), '{p.replace(chr(39), chr(39) * 2)}')" for p in PR.SQLI_PATTERNS)
    xss = " OR ".join(f"regexp_matches(lower({col}), '{p.replace(chr(39), chr(39) * 2)}')" for p in PR.XSS_PATTERNS)
    return f"""
SELECT {key}, reason FROM (
  SELECT {key}, CASE WHEN {sqli} THEN '{PR.SQLI_REASON}' WHEN {xss} THEN '{PR.XSS_REASON}' END AS reason FROM {table}) t
WHERE reason IS NOT NULL"""


@register("payload_scan_documents", _payload_sql("documents", "doc_id", "text"))
def _payload_docs(spark, sf_dir):
    from ebbtide.sources.tables import table
    return PR.payload_scan(table(spark, sf_dir, "documents"), ["text"], "doc_id")


@register("payload_scan_pages", _payload_sql("pages", "page_id", "html"))
def _payload_pages(spark, sf_dir):
    from ebbtide.sources.tables import table
    return PR.payload_scan(table(spark, sf_dir, "pages"), ["html"], "page_id")


@register("payload_scan_conversations", _payload_sql("conversations", "conv_id, turn", "text").replace(
    "SELECT conv_id, turn, reason FROM", "SELECT conv_id, turn, reason FROM"))
def _payload_conv(spark, sf_dir):
    from ebbtide.sources.tables import table
    c = table(spark, sf_dir, "conversations")
    return PR.payload_scan(c.withColumn("_k", F.struct("conv_id", "turn")), ["text"], "_k").select(
        "_k.conv_id", "_k.turn", "reason")


@register("risk_band", q("""
SELECT customer_id, CASE WHEN predicted_probability * 100 >= 65 THEN 'high' WHEN predicted_probability * 100 >= 35
                         THEN 'watch' ELSE 'healthy' END AS risk_band FROM scored"""))
def _risk_band(spark, sf_dir):
    return PR.watch_band(W(spark, sf_dir).active_scored()).select("customer_id", "risk_band")


# ---------------------------------------------------------------- registry

@register("active_customers", q("SELECT cc.* FROM cc JOIN ds ON cc.source_id = ds.source_id WHERE ds.is_active = 1"))
def _active_customers(spark, sf_dir):
    w = W(spark, sf_dir)
    return R.active_customers(w.customers, w.sources)


@register("toggle_source", q("""
SELECT source_id, filename, row_count, created_at, CASE WHEN source_id = 'src_furniture' THEN 1 ELSE is_active END AS is_active
FROM ds"""))
def _toggle_source(spark, sf_dir):
    return R.toggle_source(W(spark, sf_dir).sources, "src_furniture", True)


@register("delete_source", q("""
SELECT prediction_label, count(*) AS customers FROM cp
WHERE customer_id NOT IN (SELECT customer_id FROM cc WHERE source_id = 'src_automobile') GROUP BY prediction_label"""))
def _delete_source(spark, sf_dir):
    w = W(spark, sf_dir)
    preds, _, _ = R.delete_source(w.predictions, w.customers, w.sources, "src_automobile")
    return preds.groupBy("prediction_label").agg(F.count(F.lit(1)).alias("customers"))


@register("set_mode_custom", q("""
SELECT source_id, filename, row_count, created_at, CASE WHEN source_id <> 'sample_data' THEN 1 ELSE 0 END AS is_active
FROM ds"""))
def _set_mode(spark, sf_dir):
    return R.set_mode(W(spark, sf_dir).sources, "custom")


@register("list_sources", q("""
SELECT source_id, filename, row_count, created_at, is_active,
       CASE WHEN is_active = 1 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status
FROM ds WHERE source_id <> 'sample_data'"""))
def _list_sources(spark, sf_dir):
    return R.list_sources(W(spark, sf_dir).sources)


@register("is_sample_only", q("""
SELECT count(*) AS active_sources, count(*) = 1 AND count(*) FILTER (WHERE source_id = 'sample_data') = 1 AS sample_only
FROM ds WHERE is_active = 1"""))
def _is_sample_only(spark, sf_dir):
    return R.is_sample_only(W(spark, sf_dir).sources)


# ---------------------------------------------------------------- joins

@register("all_scored", q("SELECT prediction_label, count(*) AS customers, count(source_id) AS matched FROM allscored GROUP BY 1"))
def _all_scored(spark, sf_dir):
    return W(spark, sf_dir).all_scored().groupBy("prediction_label").agg(
        F.count(F.lit(1)).alias("customers"), F.count("source_id").alias("matched"))


@register("customer_profile", q(f"""
, ids AS (SELECT DISTINCT upper(lower(customer_id)) AS k FROM cc WHERE churned = 1),
la AS ({_LATEST_ASSIGN_SQL.format(where='')})
SELECT cc.customer_id, cc.source_id, cc.monthly_charges, cc.contract_type, cp.predicted_probability, cp.prediction_label,
       la.csm_name, la.status AS assignment_status, la.last_updated
FROM cc JOIN ids ON upper(cc.customer_id) = ids.k
LEFT JOIN cp ON upper(cp.customer_id) = upper(cc.customer_id)
LEFT JOIN la ON upper(la.customer_id) = upper(cc.customer_id)"""))
def _customer_profile(spark, sf_dir):
    w = W(spark, sf_dir)
    ids = w.customers.where(F.col("churned") == 1).select(F.lower("customer_id").alias("lookup_id"))
    assign = O.latest_assignments(fixtures.assignment_updates(spark, sf_dir))
    prof = J.customer_profile(w.customers, w.predictions, assign, ids)
    return prof.select("customer_id", "source_id", "monthly_charges", "contract_type", "predicted_probability",
                       "prediction_label", "csm_name", "assignment_status", "last_updated")


@register("customers_without_orders", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def _anti(spark, sf_dir):
    from ebbtide.sources.tables import table
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_ids(cust, orders, "c_custkey")


@register("customers_with_urgent_orders", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _semi(spark, sf_dir):
    from ebbtide.sources.tables import table
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    urgent = (table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
              .select(F.col("o_custkey").alias("c_custkey")))
    return J.semi_ids(cust, urgent, "c_custkey")


# ---------------------------------------------------------------- exports and sink

@register("export_predictions", q("""
SELECT customer_id, predicted_probability, prediction_label, source_id, tenure_months, monthly_charges, total_charges,
       contract_type, internet_service, payment_method, region, support_tickets, payment_delays, product_usage,
       complaint_count, customer_satisfaction_score, churned
FROM scored ORDER BY predicted_probability DESC, customer_id"""))
def _export_predictions(spark, sf_dir):
    return S.export_predictions(W(spark, sf_dir).active_scored())


@register("export_audit", f"""
SELECT CAST("timestamp" AS VARCHAR) AS "Timestamp", user_role AS "User/Role", coalesce(target_customer, 'n/a') AS "Action Target",
       replace(action, '"', '{S.QUOTE_REPLACEMENT}') AS "Action Taken"
FROM ({_AUDIT_SQL}) a ORDER BY "timestamp" DESC, log_id DESC""")
def _export_audit(spark, sf_dir):
    return S.export_audit(fixtures.audit_logs(spark, sf_dir))


@register("merge_predictions", q(f"""
, fresh AS (SELECT customer_id, least(1.0, predicted_probability + 0.05) AS predicted_probability FROM cp
            WHERE customer_id IN (SELECT customer_id FROM cc WHERE source_id = 'src_building')),
kept AS (SELECT customer_id, predicted_probability FROM cp
         WHERE customer_id NOT IN (SELECT customer_id FROM cc JOIN ds USING (source_id) WHERE ds.is_active = 1)
           AND customer_id NOT IN (SELECT customer_id FROM fresh))
SELECT customer_id, round(predicted_probability, 6) AS predicted_probability, false AS is_new FROM kept
UNION ALL SELECT customer_id, round(predicted_probability, 6), true FROM fresh""".replace("0.05", d(0.05)).replace("least(1.0", f"least({d(1.0)}")))
def _merge_predictions(spark, sf_dir):
    w = W(spark, sf_dir)
    new = (w.predictions.join(w.customers.where(F.col("source_id") == "src_building").select("customer_id"), "customer_id",
                              "left_semi")
           .select("customer_id", F.least(F.lit(1.0), F.col("predicted_probability") + F.lit(0.05)).alias("predicted_probability")))
    merged = S.merge_predictions(w.predictions.select("customer_id", "predicted_probability"), new, w.customers, w.sources,
                                 stamp=fixtures._ntz("2024-01-03 00:00:00"))
    return merged.select("customer_id", F.round("predicted_probability", 6).alias("predicted_probability"),
                         (F.col("created_at").isNotNull()).alias("is_new"))


# ---------------------------------------------------------------- campaigns

_AUDIENCE_SQL = """
SELECT customer_id, CASE WHEN predicted_probability IS NULL OR predicted_probability = 0 THEN 0.0 ELSE predicted_probability END AS predicted_probability,
       CASE WHEN prediction_label IS NULL OR prediction_label = '' THEN 'low_risk' ELSE prediction_label END AS prediction_label,
       CASE WHEN monthly_charges IS NULL OR monthly_charges = 0 THEN 0.0 ELSE monthly_charges END AS monthly_charges,
       CASE WHEN contract_type IS NULL OR contract_type = '' THEN 'N/A' ELSE contract_type END AS contract_type,
       CASE WHEN tenure_months IS NULL OR tenure_months = 0 THEN 0 ELSE tenure_months END AS tenure_months,
       CASE WHEN support_tickets IS NULL OR support_tickets = 0 THEN 0 ELSE support_tickets END AS support_tickets,
       CASE WHEN payment_delays IS NULL OR payment_delays = 0 THEN 0 ELSE payment_delays END AS payment_delays,
       concat(lower(customer_id), '@example.com') AS email
FROM scored WHERE prediction_label = 'high_risk'"""


@register("audience_high_risk", q(_AUDIENCE_SQL))
def _audience(spark, sf_dir):
    return C.audience(W(spark, sf_dir).active_scored(), "high_risk")


@register("audience_preview", q(f"SELECT * FROM ({_AUDIENCE_SQL}) a ORDER BY predicted_probability DESC, customer_id LIMIT 20"))
def _audience_preview(spark, sf_dir):
    return C.audience_preview(C.audience(W(spark, sf_dir).active_scored(), "high_risk"), 20)


# A campaign template (configuration of the fixture campaign); it carries "$" and "\" on purpose.
TEMPLATE_SUBJECT = "{{Customer_Name}}, a note from {{company_name}} about your {{RISK_LABEL}} plan"
TEMPLATE_BODY = ("<p>Hi {{customer_name}} ({{customer_id}}),</p><p>Your {{contract_type}} plan at {{monthly_charges}} "
                 "after {{tenure_months}} months and {{support_tickets}} tickets scores {{risk_score}} ({{risk_label}}). "
                 "Save 20$ \\o/ with {{COMPANY_NAME}}.</p>")


def _render_sql(template: str) -> str:
    vals = {
        "customer_name": "'Valued Customer'",
        "company_name": f"'{DEFAULT_CONFIG.company_name}'",
        "risk_label": title_sql("replace(prediction_label, '_', ' ')"),
        "risk_score": "printf('%.1f%%', round_even(coalesce(predicted_probability, 0.0) * 100, 1))",
        "contract_type": "CAST(contract_type AS VARCHAR)",
        "monthly_charges": "printf('$%.2f', CAST(monthly_charges AS DOUBLE))",
        "tenure_months": "CAST(tenure_months AS VARCHAR)",
        "support_tickets": "CAST(support_tickets AS VARCHAR)",
        "customer_id": "CAST(customer_id AS VARCHAR)",
    }
    out = "'" + template.replace("'", "''") + "'"
    for name in C.PLACEHOLDERS:
        out = (f"list_reduce(string_split_regex({out}, '(?i)\\{{\\{{{name}\\}}\\}}'), "
               f"lambda a, b: a || coalesce({vals[name]}, '') || b)")
    return out


@register("render_messages", q(f"""
SELECT customer_id, email, {_render_sql(TEMPLATE_SUBJECT)} AS subject, {_render_sql(TEMPLATE_BODY)} AS body
FROM ({_AUDIENCE_SQL}) a"""))
def _render(spark, sf_dir):
    aud = C.audience(W(spark, sf_dir).active_scored(), "high_risk")
    return C.render(aud, TEMPLATE_SUBJECT, TEMPLATE_BODY).select("customer_id", "email", "subject", "body")


@register("send_plan", q(f"""
SELECT row_number() OVER w AS log_id, 'cmp_001' AS campaign_id, email AS recipient_email, customer_id,
       {_render_sql(TEMPLATE_SUBJECT)} AS subject, 'queued' AS status,
       substr(sha256(concat_ws(':', 'cmp_001', customer_id, 'fixture')), 1, 40) AS tracking_token,
       CAST((row_number() OVER w - 1) // 10 AS BIGINT) AS batch
FROM ({_AUDIENCE_SQL}) a WINDOW w AS (ORDER BY predicted_probability DESC, customer_id)"""))
def _send_plan(spark, sf_dir):
    aud = C.audience(W(spark, sf_dir).active_scored(), "high_risk")
    return C.send_plan(C.render(aud, TEMPLATE_SUBJECT, TEMPLATE_BODY), "cmp_001", salt="fixture")


@register("strip_tags_pages", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def _strip_tags(spark, sf_dir):
    from ebbtide.sources.tables import table
    return table(spark, sf_dir, "pages").select("page_id", C.strip_tags(F.col("html")).alias("text"))


_ENGAGEMENT_SQL = """
WITH ev AS (
  SELECT DISTINCT event_id, CAST(user_id AS VARCHAR) AS tracking_token,
         CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'open' WHEN 'click' THEN 'click' ELSE 'bounce' END AS kind, ts
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'error')),
g AS (
  SELECT tracking_token, bool_or(kind = 'sent') AS sent, bool_or(kind = 'bounce') AS bounced,
         min(ts) FILTER (WHERE kind = 'sent') AS sent_at, min(ts) FILTER (WHERE kind IN ('click', 'bounce')) AS until_ts,
         max(ts) FILTER (WHERE kind = 'click') AS clicked_at, count(*) FILTER (WHERE kind = 'click') AS clicks,
         min(ts) AS first_ts
  FROM ev GROUP BY tracking_token),
f AS (
  SELECT ev.tracking_token, min(ev.ts) AS opened_at FROM ev JOIN g ON ev.tracking_token = g.tracking_token
  WHERE kind = 'open' AND ev.ts >= sent_at AND (until_ts IS NULL OR ev.ts < until_ts) GROUP BY ev.tracking_token),
s AS (
  SELECT g.*, opened_at, opened_at IS NOT NULL AS opened FROM g LEFT JOIN f ON g.tracking_token = f.tracking_token)"""


@register("engagement", _ENGAGEMENT_SQL + """
SELECT tracking_token, sent, bounced, opened, opened_at, clicks, clicked_at,
       CASE WHEN clicks > 0 THEN 'clicked' WHEN opened THEN 'opened' WHEN bounced THEN 'failed' WHEN sent THEN 'sent'
            ELSE 'queued' END AS status
FROM s""")
def _engagement(spark, sf_dir):
    return C.engagement(fixtures.engagement_events(spark, sf_dir).dropDuplicates(["event_id"])).drop("first_ts")


_WEEK_SQL = "concat('cmp_', strftime(date_trunc('week', first_ts), '%Y-%m-%d'))"


@register("funnel", _ENGAGEMENT_SQL + f"""
SELECT {_WEEK_SQL} AS campaign_id, count(*) FILTER (WHERE sent) AS sent_count, count(*) FILTER (WHERE bounced) AS bounced_count,
       count(*) FILTER (WHERE opened) AS opened_count, count(*) FILTER (WHERE clicks > 0) AS clicked_recipients,
       CAST(sum(clicks) AS BIGINT) AS clicked_count
FROM s GROUP BY 1""")
def _funnel(spark, sf_dir):
    state = C.engagement(fixtures.engagement_events(spark, sf_dir).dropDuplicates(["event_id"]))
    return C.funnel(state, C.weekly_campaign(F.col("first_ts")))


@register("campaign_detail", _ENGAGEMENT_SQL + f"""
, logs AS (SELECT {_WEEK_SQL} AS campaign_id, first_ts,
                  CASE WHEN clicks > 0 THEN 'clicked' WHEN opened THEN 'opened' WHEN bounced THEN 'failed'
                       WHEN sent THEN 'sent' ELSE 'queued' END AS status FROM s)
SELECT campaign_id, concat('tpl_', campaign_id) AS template_id, concat('Retention outreach ', campaign_id) AS name,
       min(first_ts) AS created_at, 'Retention template' AS template_name, concat('Checking in (', campaign_id, ')') AS template_subject,
       count(*) AS total_recipients,
       count(*) FILTER (WHERE status IN ('sent', 'opened', 'clicked')) AS sent_count,
       count(*) FILTER (WHERE status = 'failed') AS bounced_count,
       count(*) FILTER (WHERE status IN ('opened', 'clicked')) AS opened_count,
       count(*) FILTER (WHERE status = 'clicked') AS clicked_count
FROM logs GROUP BY campaign_id""")
def _campaign_detail(spark, sf_dir):
    state = C.engagement(fixtures.engagement_events(spark, sf_dir).dropDuplicates(["event_id"]))
    logs = state.select(C.weekly_campaign(F.col("first_ts")).alias("campaign_id"), "status", "first_ts")
    camps = logs.groupBy("campaign_id").agg(F.min("first_ts").alias("created_at")).select(
        "campaign_id", F.concat(F.lit("tpl_"), F.col("campaign_id")).alias("template_id"),
        F.concat(F.lit("Retention outreach "), F.col("campaign_id")).alias("name"), "created_at")
    tpls = camps.select("template_id", F.lit("Retention template").alias("name"),
                        F.concat(F.lit("Checking in ("), F.col("campaign_id"), F.lit(")")).alias("subject"))
    return C.campaign_detail(camps, tpls, logs.drop("first_ts"))


# ---------------------------------------------------------------- operations

@register("merge_assignments", f"""
WITH old AS ({_LATEST_ASSIGN_SQL.format(where="WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")}),
upd AS ({_LATEST_ASSIGN_SQL.format(where="WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")})
SELECT customer_id, csm_name, status, notes, last_updated FROM old WHERE customer_id NOT IN (SELECT customer_id FROM upd)
UNION ALL SELECT customer_id, csm_name, status, notes, last_updated FROM upd""")
def _merge_assignments(spark, sf_dir):
    u = fixtures.assignment_updates(spark, sf_dir)
    cut = fixtures._ntz("1997-01-01 00:00:00")
    old = O.latest_assignments(u.where(F.col("last_updated") < cut))
    merged, _ = O.merge_assignments(old, u.where(F.col("last_updated") >= cut))
    return merged


@register("assignment_audit", f"""
SELECT 'CSM' AS user_role, printf('Assigned account to %s and marked status as %s', csm_name, status) AS action, customer_id AS target_customer,
       last_updated AS "timestamp"
FROM ({_LATEST_ASSIGN_SQL.format(where="WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")}) u""")
def _assignment_audit(spark, sf_dir):
    u = fixtures.assignment_updates(spark, sf_dir)
    cut = fixtures._ntz("1997-01-01 00:00:00")
    _, audit = O.merge_assignments(O.latest_assignments(u.where(F.col("last_updated") < cut)),
                                   u.where(F.col("last_updated") >= cut))
    return audit


@register("snapshot_history", q("""
SELECT customer_id, round(predicted_probability, 6) AS predicted_probability,
       CASE WHEN predicted_probability >= 0.5 THEN 'high_risk' ELSE 'low_risk' END AS prediction_label,
       DATE '2024-01-02' AS recorded_date FROM cp"""))
def _snapshot(spark, sf_dir):
    snap = O.snapshot_history(W(spark, sf_dir).predictions, F.lit("2024-01-02").cast("date"))
    return snap.withColumn("predicted_probability", F.round("predicted_probability", 6))


@register("sla_alerts", q(f"""
, la AS ({_LATEST_ASSIGN_SQL.format(where='')})
SELECT s.customer_id,
       printf('🚨 *HIGH-RISK CHURN ALERT*: Customer *%s* has a predicted churn rate of *%s%%*!', s.customer_id,
              printf('%.1f', s.predicted_probability * 100)) AS text,
       coalesce(la.csm_name, 'CSM Bot') AS csm, s.monthly_charges AS mrr, s.region, s.support_tickets AS tickets
FROM scored s LEFT JOIN la ON s.customer_id = la.customer_id WHERE s.prediction_label = 'high_risk'"""))
def _sla_alerts(spark, sf_dir):
    assign = O.latest_assignments(fixtures.assignment_updates(spark, sf_dir))
    alerts = O.sla_alerts(W(spark, sf_dir).active_scored(), assign)
    p = F.from_json("payload", "customer_id string, risk_pct string, mrr double, region string, csm string, tickets long")
    return alerts.select("customer_id", "text", p.alias("p")).select(
        "customer_id", "text", F.col("p.csm").alias("csm"), F.col("p.mrr").alias("mrr"), F.col("p.region").alias("region"),
        F.col("p.tickets").alias("tickets"))


# ---------------------------------------------------------------- ingest

def _raw_customers(spark, sf_dir):
    """The customer model before storage (re-derived from the driver tables)."""
    return fixtures.customer_churn(spark, sf_dir)


@register("quality_report", q("""
SELECT * FROM (
  SELECT 0 AS ordinal, 'monthly_charges' AS column_name, 'null' AS issue, count(*) FILTER (WHERE monthly_charges IS NULL OR isnan(monthly_charges)) AS n FROM cc
  UNION ALL SELECT 2, 'tenure_months', 'null', count(*) FILTER (WHERE tenure_months IS NULL) FROM cc
  UNION ALL SELECT 4, 'support_tickets', 'null', count(*) FILTER (WHERE support_tickets IS NULL) FROM cc
  UNION ALL SELECT 6, 'payment_delays', 'null', count(*) FILTER (WHERE payment_delays IS NULL) FROM cc
  UNION ALL SELECT 8, 'product_usage', 'null', count(*) FILTER (WHERE product_usage IS NULL OR isnan(product_usage)) FROM cc
  UNION ALL SELECT 10, 'complaint_count', 'null', count(*) FILTER (WHERE complaint_count IS NULL) FROM cc
  UNION ALL SELECT 12, 'customer_satisfaction_score', 'null', count(*) FILTER (WHERE customer_satisfaction_score IS NULL OR isnan(customer_satisfaction_score)) FROM cc
  UNION ALL SELECT 14, 'churned', 'null', count(*) FILTER (WHERE churned IS NULL) FROM cc) t
WHERE n > 0""".replace("FROM cc) t", "FROM cc) t").replace(
    "WHERE n > 0", "WHERE n > 0")).replace("SELECT * FROM (", "SELECT ordinal, column_name, issue, n, printf('Column ''%s'' contains %d missing/null values, which will be filled with standard medians.', column_name, n) AS message FROM ("))
def _quality_report(spark, sf_dir):
    return I.quality_report(W(spark, sf_dir).customers.select(*I.QUALITY_COLUMNS))


# Text versions of the features: the rule score must read numbers out of text exactly like a
# Python float() would (dirty-string path of I15).
_TEXT_FEATURES = ["tenure_months", "monthly_charges", "support_tickets", "payment_delays", "product_usage",
                  "complaint_count", "customer_satisfaction_score"]


@register("heuristic_target_text", q(f"""
SELECT customer_id, CASE WHEN {SCORE_SQL} >= {d(0.55)} THEN 1 ELSE 0 END AS churned_rule FROM cc"""))
def _heuristic_text(spark, sf_dir):
    from ebbtide.functions.scalars import heuristic_target
    c = W(spark, sf_dir).customers
    text = c.select("customer_id", "contract_type", *[F.col(x).cast("string").alias(x) for x in _TEXT_FEATURES])
    return text.select("customer_id", heuristic_target(text).alias("churned_rule"))


@register("target_encoders", q(f"""
SELECT customer_id,
       coalesce(CASE lower(trim(CAST(churned AS VARCHAR))) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in __import__('ebbtide.config', fromlist=['x']).TARGET_VOCABULARY.items())} END,
                CAST(trunc(TRY_CAST(CAST(churned AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS encoded,
       CASE WHEN lower(trim(CAST(churned AS VARCHAR))) IN ('1','true','yes','churned','churn','exited','left','cancelled') THEN 1 ELSE 0 END AS binarised,
       CASE WHEN lower(trim(CAST(churned AS VARCHAR))) IN ('1','true','yes','active') THEN 0 ELSE 1 END AS binarised_active,
       CAST(coalesce(CASE lower(trim(contract_type)) WHEN 'no' THEN 0 END, 0) AS BIGINT) AS encoded_contract
FROM cc"""))
def _target_encoders(spark, sf_dir):
    from ebbtide.functions.scalars import binarise_active, binarise_target, encode_target
    c = W(spark, sf_dir).customers
    return c.select("customer_id", encode_target(F.col("churned")).alias("encoded"),
                    binarise_target(F.col("churned")).alias("binarised"),
                    binarise_active(F.col("churned")).alias("binarised_active"),
                    encode_target(F.col("contract_type")).alias("encoded_contract"))


@register("generate_ids", """
SELECT concat('CUST_', CASE WHEN length(CAST(rn AS VARCHAR)) >= 5 THEN CAST(rn AS VARCHAR) ELSE lpad(CAST(rn AS VARCHAR), 5, '0') END) AS customer_id,
       c_custkey, c_mktsegment
FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) t""")
def _generate_ids(spark, sf_dir):
    from ebbtide.sources.tables import table
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return I.generate_ids(cust, order_cols=[F.col("c_custkey")]).select("customer_id", "c_custkey", "c_mktsegment")


@register("normalise_aliased_upload", q(f"""
SELECT customer_id, CAST(tenure_months AS DOUBLE) AS tenure_months, CAST(monthly_charges AS DOUBLE) AS monthly_charges,
       CAST(support_tickets AS DOUBLE) AS support_tickets, coalesce(contract_type, 'unknown') AS contract_type,
       'unknown' AS payment_method, CAST(NULL AS DOUBLE) AS total_charges,
       CAST(CASE WHEN churned = 1 THEN 1 ELSE 0 END AS BIGINT) AS churned
FROM cc"""))
def _normalise_aliased(spark, sf_dir):
    c = W(spark, sf_dir).customers
    upload = c.select("customer_id", F.col("tenure_months").alias("tenure"), F.col("monthly_charges").alias("monthly_fee"),
                      F.col("support_tickets").cast("string").alias("support_calls"), F.col("contract_type").alias("plan"),
                      F.when(F.col("churned") == 1, F.lit(" Churned")).when(F.col("churned") == 0, F.lit("Retained"))
                      .alias("status"))
    n = I.normalise_churn(upload)
    return n.select("customer_id", "tenure_months", "monthly_charges", "support_tickets", "contract_type", "payment_method",
                    "total_charges", "churned")


@register("import_append", q("""
SELECT source_id, count(*) AS customers, count(*) FILTER (WHERE support_tickets IS NULL) AS null_tickets FROM (
  SELECT * FROM cc WHERE source_id <> 'src_building'
  UNION ALL SELECT * FROM cc WHERE source_id = 'src_building') t GROUP BY source_id"""))
def _import_append(spark, sf_dir):
    c = W(spark, sf_dir).customers
    existing = c.where(F.col("source_id") != "src_building")
    # the incoming file: the new source plus a re-sent copy of existing rows (ignored by append)
    incoming = I.with_row_order(c.where(F.col("source_id").isin("src_building", "src_machinery")))
    out = I.import_append(existing, incoming)
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("customers"),
                                       F.count_if(F.col("support_tickets").isNull()).alias("null_tickets"))


@register("import_upsert", q("""
SELECT source_id, count(*) AS customers, CAST(sum(support_tickets) AS BIGINT) AS tickets FROM (
  SELECT customer_id, CASE WHEN source_id = 'src_automobile' THEN 'src_automobile_v2' ELSE source_id END AS source_id,
         CASE WHEN source_id = 'src_automobile' THEN coalesce(support_tickets, 0) + 2 ELSE support_tickets END AS support_tickets
  FROM cc) t GROUP BY source_id"""))
def _import_upsert(spark, sf_dir):
    c = W(spark, sf_dir).customers
    auto = c.where(F.col("source_id") == "src_automobile")
    v1 = auto.select("customer_id", F.lit("src_automobile_v1").alias("source_id"),
                     (F.coalesce("support_tickets", F.lit(0)) + 1).alias("support_tickets"), F.lit(0).alias("_row"))
    v2 = auto.select("customer_id", F.lit("src_automobile_v2").alias("source_id"),
                     (F.coalesce("support_tickets", F.lit(0)) + 2).alias("support_tickets"), F.lit(1).alias("_row"))
    out, mode = I.import_frame(c, v1.unionByName(v2))
    assert mode == "upsert"
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("customers"), F.sum("support_tickets").alias("tickets"))


@register("import_merge", q("""
SELECT source_id, count(*) AS customers, CAST(sum(support_tickets) AS BIGINT) AS tickets FROM (
  SELECT customer_id, CASE WHEN source_id = 'src_automobile' THEN 'src_automobile_v2' ELSE source_id END AS source_id,
         CASE WHEN source_id IN ('src_automobile', 'src_building') THEN coalesce(support_tickets, 0) + 2 ELSE support_tickets END AS support_tickets
  FROM cc) t GROUP BY source_id"""))
def _import_merge(spark, sf_dir):
    c = W(spark, sf_dir).customers
    existing = c.where(F.col("source_id") != "src_building")
    sent = c.where(F.col("source_id").isin("src_automobile", "src_building"))
    source = F.when(F.col("source_id") == "src_automobile", F.lit("src_automobile_v2")).otherwise(F.col("source_id"))
    v1, v2 = (sent.select("customer_id", source.alias("source_id"),
                          (F.coalesce("support_tickets", F.lit(0)) + n).alias("support_tickets"), F.lit(n).alias("_row")) for n in (1, 2))
    out, _ = I.import_frame(existing, v1.unionByName(v2), mode="merge")
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("customers"), F.sum("support_tickets").alias("tickets"))


@register("dedup_keep_first", """
SELECT customer_id, csm_name, status, last_updated FROM (
  SELECT concat('C', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(9, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')) AS customer_id, o_orderpriority AS csm_name,
         o_orderstatus AS status, o_orderdate AS last_updated,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t WHERE rn = 1""")
def _dedup(spark, sf_dir):
    u = fixtures.assignment_updates(spark, sf_dir)
    ordered = u.withColumn("_row", F.struct("last_updated", "update_seq"))
    return I.dedup_keep_first(ordered.select("customer_id", "csm_name", "status", "last_updated", "_row")).drop("_row")


@register("sync_feed", q(f"""
SELECT CASE WHEN source_id = 'src_household' THEN 'crm_sync_hubspot' ELSE source_id END AS source_id, prediction_label,
       count(*) AS customers, round(avg(p), 12) AS avg_p FROM (
  SELECT cc.source_id, CASE WHEN cc.source_id = 'src_household'
                            THEN CASE WHEN coalesce(cc.complaint_count, 0) > 1 THEN 0.85 ELSE 0.15 END
                            ELSE cp.predicted_probability END AS p,
         CASE WHEN cc.source_id = 'src_household'
              THEN CASE WHEN coalesce(cc.complaint_count, 0) > 1 THEN 'high_risk' ELSE 'low_risk' END
              ELSE cp.prediction_label END AS prediction_label
  FROM cc JOIN cp ON cc.customer_id = cp.customer_id) t GROUP BY 1, 2"""))
def _sync_feed(spark, sf_dir):
    w = W(spark, sf_dir)
    feed = w.customers.where(F.col("source_id") == "src_household")
    cust, preds = I.sync_feed(w.customers, w.predictions, feed, "hubspot")
    return (preds.join(cust.select("customer_id", "source_id"), "customer_id")
            .groupBy("source_id", "prediction_label")
            .agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("predicted_probability"), 12).alias("avg_p")))


@register("infer_target", """
WITH m AS (SELECT bool_or(regexp_matches(lower(lang), 'churn|retain|active|inactive|yes|no|true|false|1|0|attrit|retained|retention|status|label|outcome')) AS lang,
                  bool_or(regexp_matches(lower(source), 'churn|retain|active|inactive|yes|no|true|false|1|0|attrit|retained|retention|status|label|outcome')) AS source,
                  bool_or(regexp_matches(lower(text), 'churn|retain|active|inactive|yes|no|true|false|1|0|attrit|retained|retention|status|label|outcome')) AS text FROM documents)
SELECT CASE WHEN lang THEN 'lang' WHEN source THEN 'source' WHEN text THEN 'text' END AS column_name FROM m""")
def _infer_target(spark, sf_dir):
    """I14 on a file without any target name: all values of all its columns are looked at."""
    from ebbtide.sources.tables import table
    found = I.infer_target(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    return spark.createDataFrame([(found,)], "column_name string")


@register("evolve_schema", q("""
SELECT count(*) AS customers, count(region) AS with_region, count(csm_name) AS with_csm FROM (
  SELECT customer_id, region, NULL AS csm_name FROM cc
  UNION ALL SELECT concat('C', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(9, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')), NULL, o_orderpriority FROM orders) t"""))
def _evolve(spark, sf_dir):
    c = W(spark, sf_dir).customers.select("customer_id", "region")
    u = fixtures.assignment_updates(spark, sf_dir).select("customer_id", "csm_name")
    e = I.evolve_schema(c, u)
    return e.agg(F.count(F.lit(1)).alias("customers"), F.count("region").alias("with_region"),
                 F.count("csm_name").alias("with_csm"))


@register("register_source", q("""
SELECT source_id, filename, row_count, is_active FROM ds
UNION ALL SELECT 'src_upload', 'upload.csv', count(*), 1 FROM cc WHERE churned = 1"""))
def _register_source(spark, sf_dir):
    w = W(spark, sf_dir)
    reg = R.register_source(spark, w.sources, "src_upload", "upload.csv", w.customers.where(F.col("churned") == 1))
    return reg.select("source_id", "filename", "row_count", "is_active")


# ---------------------------------------------------------------- model

import threading  # noqa: E402

from ebbtide.session import scratch_path  # noqa: E402

from ebbtide.functions.scalars import clip01, heuristic_score  # noqa: E402
from ebbtide.operators import model as M  # noqa: E402

_MODEL_LOCK = threading.Lock()
_MODELS: dict = {}


def trained_model(spark, sf_dir, sources=None):
    """The churn model fitted on the active customers (one fit per session, input and registry)."""
    w = W(spark, sf_dir)
    active = (w.sources if sources is None else sources).where("is_active = 1").select("source_id")
    # the registry's content names the model: the number and a hash of the active sources
    content = tuple(active.agg(F.count(F.lit(1)), F.sum(F.xxhash64("source_id").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, sf_dir, *content)
    with _MODEL_LOCK:
        if key not in _MODELS:
            _MODELS[key] = M.train_active(w.customers, w.sources if sources is None else sources)
        return _MODELS[key]


def _scored_by_model(spark, sf_dir, sources=None):
    w = W(spark, sf_dir)
    src = w.sources if sources is None else sources
    model = trained_model(spark, sf_dir, sources)
    active = J.active_only(w.customers, src)
    scored = model.score(active)
    # driver statistics need only the raw features: read them from the input, not the scored batch
    stats = M.driver_stats(active, model.features)
    return scored.withColumn("risk_drivers", M.risk_drivers(scored, stats, model.importances))


@register("train_and_score")
def _train_and_score(spark, sf_dir):
    s = _scored_by_model(spark, sf_dir)
    return s.select("customer_id", F.round(P_COL, 6).alias("predicted_probability"), "prediction_label",
                    F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"),
                    F.to_json("risk_drivers").alias("risk_drivers"))


P_COL = "predicted_probability"


@register("predict_new_file")
def _predict_new_file(spark, sf_dir):
    """The inactive source's customers scored as a newly uploaded file (ids re-sent twice)."""
    w = W(spark, sf_dir)
    file_rows = w.customers.where(F.col("source_id") == fixtures.INACTIVE_SOURCE).drop("churned", "source_id")
    scored = M.predict_new(trained_model(spark, sf_dir), file_rows.unionByName(file_rows))
    return scored.select("customer_id", F.round(P_COL, 6).alias("predicted_probability"), "prediction_label",
                         F.to_json("risk_drivers").alias("risk_drivers"))


@register("feature_importance")
def _feature_importance(spark, sf_dir):
    return M.feature_importance(trained_model(spark, sf_dir))


@register("holdout_metrics")
def _holdout(spark, sf_dir):
    m = trained_model(spark, sf_dir)
    row = {k: (float(v) if v is not None else None) for k, v in m.metrics.items()}
    return spark.createDataFrame([row], "accuracy double, precision double, recall double, auc double, tn double, "
                                        "fp double, fn double, tp double")


@register("retrain_after_toggle")
def _retrain(spark, sf_dir):
    w = W(spark, sf_dir)
    toggled = R.toggle_source(w.sources, "src_furniture", True)
    s = _scored_by_model(spark, sf_dir, toggled)
    return s.groupBy("prediction_label").agg(F.count(F.lit(1)).alias("customers"))


@register("save_and_score", q("""
SELECT customer_id, true AS same_scores, true AS ordered_band, true AS label_by_rule, 1 AS version
FROM cc JOIN ds USING (source_id) WHERE ds.is_active = 1"""))
def _save_and_score(spark, sf_dir):
    """The trained model saved, loaded as another object and put to the active customers: its scores are those of
    the model in memory, the band lies in order between 0 and 1, the label follows the configured threshold."""
    w, root = W(spark, sf_dir), scratch_path(spark, "model-store")
    model = trained_model(spark, sf_dir)
    version = model.save(spark, root)
    active = J.active_only(w.customers, w.sources)
    held = model.score(active).select("customer_id", F.col(P_COL).alias("p"), F.col("ci_lower").alias("lo"), F.col("ci_upper").alias("hi"))
    s = M.ChurnModel.load(spark, root, version).score(active).join(held, "customer_id")
    return s.select("customer_id",
                    ((F.abs(F.col(P_COL) - F.col("p")) < 1e-9) & (F.abs(F.col("ci_lower") - F.col("lo")) < 1e-9) & (F.abs(F.col("ci_upper") - F.col("hi")) < 1e-9)).alias("same_scores"),
                    ((F.col("ci_lower") >= 0) & (F.col("ci_lower") <= F.col("ci_upper")) & (F.col("ci_upper") <= 1)).alias("ordered_band"),
                    (F.col("prediction_label") == F.when(F.col(P_COL) >= DEFAULT_CONFIG.risk_threshold, DEFAULT_CONFIG.high_label).otherwise(DEFAULT_CONFIG.low_label)).alias("label_by_rule"),
                    F.lit(version).alias("version"))


@register("stratified_split", q("""
SELECT CAST(churned AS DOUBLE) AS label, count(*) AS n, CAST((count(*) * 20 + 50) // 100 AS BIGINT) AS test_rows,
       CAST(count(*) - (count(*) * 20 + 50) // 100 AS BIGINT) AS train_rows
FROM cc JOIN ds USING (source_id) WHERE ds.is_active = 1 AND churned IS NOT NULL GROUP BY churned"""))
def _stratified_split(spark, sf_dir):
    w = W(spark, sf_dir)
    data = J.active_only(w.customers, w.sources).where("churned is not null").withColumn("label", F.col("churned").cast("double"))
    tr, te, _ = M.stratified_split(data)
    both = tr.select("label", F.lit(0).alias("t")).unionByName(te.select("label", F.lit(1).alias("t")))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("test_rows"), F.sum(1 - F.col("t")).alias("train_rows"))


@register("what_if_with_model", q("""
SELECT customer_id AS scenario_id, true AS label_by_rule, true AS advised FROM scored"""))
def _what_if_model(spark, sf_dir):
    """M17 through the trained model: every active customer's row as a scenario without open tickets."""
    scen = W(spark, sf_dir).active_scored().select(F.col("customer_id").alias("scenario_id"), F.lit(0).cast("bigint").alias("Support_Tickets"),
                                                   *[c for c in DEFAULT_CONFIG.feature_columns if c != "support_tickets"])
    model = trained_model(spark, sf_dir)
    out = M.score_scenarios(model.score, scen, model.features)
    high = F.col(P_COL) >= DEFAULT_CONFIG.risk_threshold
    return out.select("scenario_id", (F.col("prediction_label") == F.when(high, DEFAULT_CONFIG.high_label).otherwise(DEFAULT_CONFIG.low_label)).alias("label_by_rule"),
                      (F.col("recommendations")[0] == F.when(high, M.WHATIF_HIGH).otherwise(M.WHATIF_LOW)).alias("advised"))


_AUC_SQL = """
, r AS (SELECT CAST(churned AS DOUBLE) AS y, predicted_probability AS p,
               rank() OVER (ORDER BY predicted_probability) + (count(*) OVER (PARTITION BY predicted_probability) - 1) / 2.0 AS rk
        FROM scored WHERE churned IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE p >= 0.6 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.6 AND y <> 1) AS fp,
             count(*) FILTER (WHERE NOT p >= 0.6 AND y = 1) AS fn, count(*) FILTER (WHERE NOT p >= 0.6 AND y <> 1) AS tn,
             sum(rk) FILTER (WHERE y = 1) AS rsum FROM r)
SELECT round((tp + tn) / (tp + fp + fn + tn), 3) AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) ELSE 0.0 END AS recall,
       round((rsum - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (fp + tn)), 3) AS auc, tn, fp, fn, tp
FROM c""".replace("0.6", d(0.6))


@register("evaluate_scores", q(_AUC_SQL))
def _evaluate(spark, sf_dir):
    return M.evaluate(W(spark, sf_dir).active_scored())


@register("class_report", q("""
, r AS (SELECT CAST(churned AS INTEGER) AS y, CAST(predicted_probability >= 0.5 AS INTEGER) AS yhat FROM scored WHERE churned IS NOT NULL),
k AS (SELECT cls, count(*) FILTER (WHERE y = cls AND yhat = cls) AS tp, count(*) FILTER (WHERE yhat = cls) AS pred,
             count(*) FILTER (WHERE y = cls) AS support FROM r, (VALUES (0), (1)) v(cls) GROUP BY cls)
SELECT cls AS class, round(CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END, 4) AS precision,
       round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 4) AS recall,
       round(CASE WHEN (CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END) + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END) > 0
                  THEN 2 * (CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END) * (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END)
                       / ((CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END) + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END))
                  ELSE 0.0 END, 4) AS f1,
       CAST(support AS BIGINT) AS support
FROM k""".replace("0.5", d(0.5))))
def _class_report(spark, sf_dir):
    return M.class_report(W(spark, sf_dir).active_scored(), 0.5)


@register("prior_scores", q("""
SELECT customer_id, round((SELECT avg(CAST(churned AS DOUBLE)) FROM scored WHERE churned IS NOT NULL), 12) AS predicted_probability
FROM scored"""))
def _prior(spark, sf_dir):
    s = W(spark, sf_dir).active_scored()
    out = M.prior_scores(s.select("customer_id"), s.where(F.col("churned").isNotNull()))
    return out.withColumn(P_COL, F.round(P_COL, 12))


_NUMS = list(DEFAULT_CONFIG.numeric_features)


@register("preprocess_stats", q(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(coalesce({c}, med)), 9) AS mean, round(stddev_pop(coalesce({c}, med)), 9) AS std,
        med AS median FROM active, (SELECT CAST(median({c}) AS DOUBLE) AS med FROM active) m GROUP BY med"""
    for c in _NUMS).join(["\n, active AS (SELECT cc.* FROM cc JOIN ds USING (source_id) WHERE ds.is_active = 1)\n", ""])))
def _preprocess_stats(spark, sf_dir):
    w = W(spark, sf_dir)
    act = R.active_customers(w.customers, w.sources)
    pp = M.fit_preprocess(act, _NUMS, [])
    rows = [(c, pp.means[c], pp.stds[c], float(pp.medians[c])) for c in _NUMS]
    df = spark.createDataFrame(rows, "feature string, mean double, std double, median double")
    return df.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "median")


_DRIVER_SQL = """
, st AS (SELECT avg(support_tickets) AS m_t, stddev_samp(support_tickets) AS s_t, avg(tenure_months) AS m_n,
                stddev_samp(tenure_months) AS s_n, avg(monthly_charges) AS m_c, stddev_samp(monthly_charges) AS s_c FROM scored),
items AS (
  SELECT customer_id, list_filter([
    CASE WHEN support_tickets > 1 THEN {'s': 0.05 * abs(support_tickets - m_t) / CASE WHEN s_t > 0 THEN s_t ELSE 1 END, 'o': -7,
         'label': CASE WHEN support_tickets > 2 THEN 'support tickets>' || CAST(support_tickets AS BIGINT) ELSE 'support tickets>1' END} END,
    CASE WHEN tenure_months < 12 THEN {'s': 0.05 * abs(tenure_months - m_n) / CASE WHEN s_n > 0 THEN s_n ELSE 1 END, 'o': 0,
         'label': CASE WHEN tenure_months > 0 THEN 'tenure<' || CAST(tenure_months AS BIGINT) || 'mo' ELSE 'tenure<3mo' END} END,
    CASE WHEN monthly_charges > m_c THEN {'s': 0.05 * abs(monthly_charges - m_c) / CASE WHEN s_c > 0 THEN s_c ELSE 1 END, 'o': -1,
         'label': 'charges>$' || CAST(trunc(monthly_charges) AS BIGINT)} END], lambda x: x IS NOT NULL) AS fired
  FROM scored, st)
SELECT customer_id,
       CASE WHEN len(fired) > 0 THEN array_to_string(list_transform(list_reverse_sort(fired)[1:3], lambda x: x.label), '|')
            ELSE 'tenure<3mo|contract=month-to-month' END AS risk_drivers
FROM items"""


@register("risk_drivers", q(_DRIVER_SQL))
def _risk_drivers(spark, sf_dir):
    s = W(spark, sf_dir).active_scored()
    feats = list(DEFAULT_CONFIG.feature_columns)
    stats = M.driver_stats(s, feats)
    return s.select("customer_id", F.array_join(M.risk_drivers(s, stats, None), "|").alias("risk_drivers"))


@register("attention_rescale", q(f"""
, raw AS (SELECT customer_id, {SCORE_SQL} AS r FROM cc JOIN ds USING (source_id) WHERE ds.is_active = 1),
mm AS (SELECT min(r) AS lo, max(r) AS hi, count(*) AS n FROM raw)
SELECT customer_id, round(CASE WHEN n > 1 AND hi - lo > 1e-4 THEN {d(0.15)} + {d(0.7)} * ((r - lo) / (hi - lo)) ELSE r END, 6) AS p_att
FROM raw, mm"""))
def _attention_rescale(spark, sf_dir):
    w = W(spark, sf_dir)
    act = R.active_customers(w.customers, w.sources)
    raw = act.select("customer_id", F.array(heuristic_score(act)).alias("raw"))
    return M.rescale(raw, 1).select("customer_id", F.round("p_att", 6).alias("p_att"))


@register("confidence_band", q("""
SELECT customer_id,
       round(greatest(0.0, least(1.0, ci_lower + (predicted_probability - ci_lower) * 0.2)), 6) AS band_lo,
       round(greatest(0.0, least(1.0, predicted_probability + (ci_upper - predicted_probability) * 0.8)), 6) AS band_hi
FROM scored""".replace("0.2)", f"{d(0.2)})").replace("0.8)", f"{d(0.8)})")))
def _band(spark, sf_dir):
    s = W(spark, sf_dir).active_scored()
    lo, hi = M.band(F.array("ci_upper", "predicted_probability", "ci_lower"), F.col(P_COL))
    return s.select("customer_id", F.round(lo, 6).alias("band_lo"), F.round(hi, 6).alias("band_hi"))


def _whatif_sql():
    sc = SCORE_SQL
    subs = {"support_tickets": "CAST(0 AS BIGINT)",
            "tenure_months": "coalesce(tenure_months, 12)", "customer_satisfaction_score": "coalesce(customer_satisfaction_score, 4)",
            "product_usage": "coalesce(product_usage, 0.0)", "complaint_count": "coalesce(complaint_count, 0)",
            "payment_delays": "coalesce(payment_delays, 0.0)", "monthly_charges": "coalesce(monthly_charges, 0.0)"}
    return q(f"""
, s AS (SELECT customer_id AS scenario_id, {', '.join(f'{v} AS {k}' for k, v in subs.items())},
               coalesce(contract_type, 'No') AS contract_type, coalesce(payment_delays, 0) AS raw_delays FROM scored),
p AS (SELECT scenario_id, least({d(1.0)}, greatest({d(0.0)}, {sc})) AS pp, support_tickets, customer_satisfaction_score,
             raw_delays FROM s)
SELECT scenario_id, round(pp, 6) AS predicted_probability,
       CASE WHEN pp >= {d(0.6)} THEN 'high_risk' ELSE 'low_risk' END AS prediction_label,
       CASE WHEN pp >= {d(0.6)} THEN array_to_string(list_filter([
              '{M.WHATIF_HIGH}',
              CASE WHEN CAST(trunc(CAST(customer_satisfaction_score AS DOUBLE)) AS BIGINT) <= 2
                   THEN printf('{M.WHATIF_CSAT}', CAST(customer_satisfaction_score AS VARCHAR)) END,
              CASE WHEN CAST(trunc(CAST(raw_delays AS DOUBLE)) AS BIGINT) > 2
                   THEN printf('{M.WHATIF_DELAYS}', CAST(raw_delays AS VARCHAR)) END], lambda x: x IS NOT NULL), ' | ')
            ELSE '{M.WHATIF_LOW} | {M.WHATIF_LOYAL}' END AS recommendations
FROM p""")


@register("what_if_resolve_tickets", _whatif_sql())
def _what_if(spark, sf_dir):
    s = W(spark, sf_dir).active_scored()
    scen = s.select(F.col("customer_id").alias("scenario_id"), F.lit(0).cast("bigint").alias("Support_Tickets"),
                    *[c for c in DEFAULT_CONFIG.feature_columns if c != "support_tickets"])

    def scorer(df):
        return df.withColumn(P_COL, clip01(heuristic_score(df)))

    out = M.score_scenarios(scorer, scen, list(DEFAULT_CONFIG.feature_columns))
    return out.select("scenario_id", F.round(P_COL, 6).alias("predicted_probability"), "prediction_label",
                      F.array_join("recommendations", " | ").alias("recommendations"))


# ---------------------------------------------------------------- streaming (T1–T3), each against its batch twin

from ebbtide.streaming import jobs as T  # noqa: E402

ALL_FILES = 1 << 30


def _halves(df, by: str):
    """The rows before and after the middle of the time span, so that a stream gets them in two runs, in order."""
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    mid = lo + (hi - lo) / 2
    return df.where(F.col(by) < F.lit(mid)), df.where((F.col(by) >= F.lit(mid)) | F.col(by).isNull())


@register("stream_import", q("""
SELECT customer_id, source_id, CAST(tenure_months AS DOUBLE) AS tenure_months, monthly_charges, total_charges,
       coalesce(contract_type, 'unknown') AS contract_type, coalesce(internet_service, 'unknown') AS internet_service,
       coalesce(payment_method, 'unknown') AS payment_method, coalesce(region, 'unknown') AS region,
       CAST(support_tickets AS DOUBLE) AS support_tickets, CAST(payment_delays AS DOUBLE) AS payment_delays,
       product_usage, CAST(complaint_count AS DOUBLE) AS complaint_count, customer_satisfaction_score,
       CAST(coalesce(churned, 0) AS BIGINT) AS churned
FROM cc"""))
def _stream_import(spark, sf_dir):
    cust = W(spark, sf_dir).customers
    src = scratch_path(spark, "t1-src")
    root, ckpt = scratch_path(spark, "t1-table"), scratch_path(spark, "t1-ckpt")
    for part in (0, 1):  # two uploads: the second run picks up where the first stopped
        cust.where(F.pmod(F.xxhash64("customer_id"), F.lit(2)) == part).write.mode("append").option("header", True).option("escape", '"').csv(src)
        T.stream_import(spark, src, cust.schema, root, ckpt, files_per_batch=ALL_FILES)
    T.compact_import(spark, root)
    return T.imported_table(spark, root)


@register("stream_engagement", SQL["engagement"])
def _stream_engagement(spark, sf_dir):
    from ebbtide.sources.tables import table
    src, root, ckpt = scratch_path(spark, "t2-src"), scratch_path(spark, "t2-state"), scratch_path(spark, "t2-ckpt")
    for half in _halves(table(spark, sf_dir, "events"), "ts"):
        half.write.mode("append").parquet(src)
        T.stream_engagement(spark, src, root, ckpt, watermark="1 day", files_per_batch=ALL_FILES)
    return T.engagement_from_state(spark, root).drop("first_ts")


@register("stream_trend", SQL["risk_trend"])
def _stream_trend(spark, sf_dir):
    hist = fixtures.risk_history(spark, sf_dir)
    src, root, ckpt = scratch_path(spark, "t3-src"), scratch_path(spark, "t3-state"), scratch_path(spark, "t3-ckpt")
    for half in _halves(hist, "recorded_ts"):
        half.write.mode("append").parquet(src)
        T.stream_trend(spark, src, hist.schema, root, ckpt, width="1 day", watermark="1 day", files_per_batch=ALL_FILES)
    T.compact_trend(spark, root)
    return T.trend_from_state(spark, root).select(
        F.to_date("window_start").alias("recorded_date"), F.round("probability", 12).alias("probability"),
        F.col("n").alias("snapshots"))


# ---------------------------------------------------------------- narrative facts and role advice

from ebbtide.operators import insights as N  # noqa: E402

def _p1_order():
    return [F.col("predicted_probability").desc(), F.col("customer_id")]
_P1_ALL = ["customer_id", "predicted_probability", "prediction_label", "risk_drivers", "ci_lower", "ci_upper"] + _P1_NAMES[3:]


def _p1_rows(spark, sf_dir):
    return PR.predictions_list(W(spark, sf_dir).active_scored())


_NUMERIC_P1 = {"predicted_probability", "ci_lower", "ci_upper", "tenure_months", "support_tickets", "payment_delays",
               "product_usage", "complaint_count", "customer_satisfaction_score", "churned"}


def _txt_sql(c: str) -> str:
    if c in _NUMERIC_P1:
        return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN '' ELSE CAST({c} AS VARCHAR) END"
    return f"coalesce(CAST({c} AS VARCHAR), '')"


_A22_CANDS = [c for c in _P1_ALL if c.lower() not in N.SKIP]


def _a22_sql() -> str:
    cols = ", ".join(f"{_txt_sql(c)} AS t{i}" for i, c in enumerate(_A22_CANDS))
    stats = " UNION ALL ".join(
        f"""SELECT {i + 1} AS ordinal, '{c}' AS column_name,
            count(*) FILTER (WHERE t{i} NOT IN ('', 'nan', 'None')) AS n,
            count(DISTINCT CASE WHEN t{i} NOT IN ('', 'nan', 'None') THEN t{i} END) AS dc,
            count(*) FILTER (WHERE t{i} NOT IN ('', 'nan', 'None') AND TRY_CAST(t{i} AS DOUBLE) IS NOT NULL
                             AND NOT contains(replace(t{i}, '-', ''), '.')) AS k FROM txt"""
        for i, c in enumerate(_A22_CANDS))
    return q(f"""
, txt AS (SELECT {cols} FROM (SELECT {_P1_COLS} FROM scored) h),
st AS ({stats})
SELECT ordinal, column_name FROM st WHERE n > 0 AND dc <= greatest(20, n // 3) AND k < n * 0.6
ORDER BY ordinal LIMIT 4""")


@register("categorical_profile", _a22_sql())
def _categorical_profile(spark, sf_dir):
    return N.categorical_profile(_p1_rows(spark, sf_dir), 4)


_CATS = list(DEFAULT_CONFIG.categorical_features)


def _a23_sql() -> str:
    u = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(nullif(trim(coalesce({c}, '')), ''), 'unknown') AS value, "
        f"{{'np': -predicted_probability, 'id': customer_id}} AS fk FROM scored WHERE prediction_label = 'high_risk'"
        for c in _CATS)
    return f"""
, v AS ({u}),
g AS (SELECT column_name, value, count(*) AS customers, min(fk) AS fk FROM v GROUP BY column_name, value),
r AS (SELECT column_name, value, customers,
             CAST(row_number() OVER (PARTITION BY column_name ORDER BY customers DESC, fk) AS INTEGER) AS rank FROM g)"""


@register("risk_attributes", q(_a23_sql() + "\nSELECT column_name, value, customers, rank FROM r WHERE rank <= 3"))
def _risk_attributes(spark, sf_dir):
    return N.risk_attributes(W(spark, sf_dir).active_scored(), _CATS)


def _a24_sql() -> str:
    return q(_a23_sql() + f"""
, tops AS (SELECT list(value ORDER BY array_position({_CATS}, column_name)) AS vals,
                  list(replace(column_name, '_', ' ') ORDER BY array_position({_CATS}, column_name)) AS cols FROM r WHERE rank = 1),
f AS (SELECT count(*) AS total, count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_risk,
             count(*) FILTER (WHERE prediction_label = 'low_risk') AS low_risk,
             avg(coalesce(predicted_probability, 0.0)) AS a,
             min(CASE WHEN prediction_label = 'high_risk' THEN {{'k': -predicted_probability, 'id': customer_id, 'p': predicted_probability}} END) AS top,
             min(CASE WHEN prediction_label = 'low_risk' THEN {{'k': predicted_probability, 'id': customer_id, 'p': predicted_probability}} END) AS safe
      FROM scored)
SELECT printf('%d of %d records need retention attention', high_risk, total) AS headline,
       printf('Across %d analyzed records, the model estimates an overall churn probability of %d%%. ', total, CAST(round_even(a * 100, 0) AS BIGINT))
       || printf('%d records (%d%%) are flagged as high risk and %d (%d%%) as lower risk. ', high_risk,
                 CAST(round_even(100.0 * high_risk / total, 0) AS BIGINT), low_risk, CAST(round_even(100.0 * low_risk / total, 0) AS BIGINT))
       || CASE WHEN high_risk > 0 AND len(coalesce(tops.vals, [])) > 0
               THEN 'The highest-risk records are most associated with '
                    || array_to_string(list_transform(range(1, least(len(tops.vals), 2) + 1), lambda j: printf('''%s'' in %s', tops.vals[j], tops.cols[j])), ' and ')
                    || '. These patterns together drive the elevated churn likelihood observed in this dataset.'
               WHEN high_risk > 0 THEN 'A portion of records shows elevated churn likelihood worth prioritizing for retention.'
               ELSE 'No records currently meet the high-risk threshold, indicating a stable retention profile.' END AS narrative,
       total, high_risk, low_risk, round(a, 3) AS avg_probability,
       top.id AS top_record,
       CASE WHEN top IS NOT NULL THEN printf('%s carries a %d%% churn probability. Review its attributes to understand the dominant risk drivers in this dataset.', top.id, CAST(round_even(top.p * 100, 0) AS BIGINT)) END AS top_detail,
       safe.id AS stable_record,
       CASE WHEN safe IS NOT NULL THEN printf('%s shows only a %d%% churn probability, reflecting a healthy profile ideal for loyalty expansion.', safe.id, CAST(round_even(safe.p * 100, 0) AS BIGINT)) END AS stable_detail
FROM f, tops""")


@register("insight_facts", _a24_sql())
def _insight_facts(spark, sf_dir):
    return N.insight_facts(W(spark, sf_dir).active_scored(), _CATS)


def _a24_segments_sql() -> str:
    """The segments over the columns that A22 finds, not over a given list."""
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(nullif(trim({_txt_sql(c)}), ''), 'unknown') AS value, "
        f"{{'np': -predicted_probability, 'id': customer_id}} AS fk FROM (SELECT {_P1_COLS} FROM scored) h WHERE prediction_label = 'high_risk'"
        for c in _A22_CANDS)
    return _a22_sql().rsplit("SELECT ordinal, column_name FROM st", 1)[0] + f"""
, cats AS (SELECT column_name, row_number() OVER (ORDER BY ordinal) AS place FROM st
           WHERE n > 0 AND dc <= greatest(20, n // 3) AND k < n * 0.6 ORDER BY ordinal LIMIT 2),
cells AS ({cells}),
g AS (SELECT column_name, value, count(*) AS customers, min(fk) AS fk FROM cells JOIN cats USING (column_name) GROUP BY 1, 2),
r AS (SELECT column_name, value, customers, row_number() OVER (PARTITION BY column_name ORDER BY customers DESC, fk) AS rank FROM g),
f AS (SELECT min(CASE WHEN prediction_label = 'high_risk' THEN {{'k': -predicted_probability, 'id': customer_id, 'p': predicted_probability}} END) AS top,
             min(CASE WHEN prediction_label = 'low_risk' THEN {{'k': predicted_probability, 'id': customer_id, 'p': predicted_probability}} END) AS safe
      FROM scored)
SELECT 1 AS position, 'Highest-risk record' AS title, printf('%s carries a %d%% churn probability. Review its attributes to understand the dominant risk drivers in this dataset.', top.id, CAST(round_even(top.p * 100, 0) AS BIGINT)) AS detail
FROM f WHERE top IS NOT NULL
UNION ALL SELECT 2, 'Most stable record', printf('%s shows only a %d%% churn probability, reflecting a healthy profile ideal for loyalty expansion.', safe.id, CAST(round_even(safe.p * 100, 0) AS BIGINT))
FROM f WHERE safe IS NOT NULL
UNION ALL SELECT CAST(2 + place AS INTEGER), 'Risk by ' || replace(column_name, '_', ' '),
       'High risk is most associated with ' || string_agg(printf('%s (%d)', value, customers), ', ' ORDER BY rank)
       || '. Prioritize targeted retention for these ' || replace(column_name, '_', ' ') || ' segments.'
FROM r JOIN cats USING (column_name) WHERE rank <= 3 GROUP BY place, column_name"""


@register("insight_segments", _a24_segments_sql())
def _insight_segments(spark, sf_dir):
    rows = _p1_rows(spark, sf_dir)
    return N.insight_segments(rows, N.categorical_columns(rows, 4))


@register("context_summary", q("""
SELECT count(*) AS total_records, count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_risk FROM scored"""))
def _context_summary(spark, sf_dir):
    w = W(spark, sf_dir)
    return N.context_summary(w.active_scored(), w.sources)["totals"]


def _a7_sql() -> str:
    facts = """
, fx AS (SELECT count(*) FILTER (WHERE prediction_label = 'high_risk') AS high_count,
                count(*) FILTER (WHERE prediction_label = 'low_risk') AS low_count,
                round_even(round(avg(CASE WHEN prediction_label = 'high_risk' THEN predicted_probability END), 3) * 100, 1) AS avg_prob,
                count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(support_tickets, 0) >= 3) AS ticket_heavy,
                count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(complaint_count, 0) >= 3) AS complaint_heavy,
                count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(customer_satisfaction_score, 0) <= 2) AS low_satisfaction,
                count(*) FILTER (WHERE prediction_label = 'high_risk' AND coalesce(payment_delays, 0) >= 1) AS payment_delayed
         FROM allscored)"""
    parts = []
    for role, rules in N.ROLE_RULES.items():
        items, conds = [], []
        for cond, tmpl in rules:
            text = "'" + tmpl.replace("'", "''") + "'"
            for f in N.FACT_FIELDS:
                text = text.replace("{" + f + "}", f"' || CAST({f} AS VARCHAR) || '")
            if cond == "always":
                c = "true"
            elif cond == "none_above":
                c = "NOT (" + " OR ".join(conds) + ")" if conds else "true"
            else:
                c = f"{cond} > 0"
            conds.append(c)
            items.append(f"CASE WHEN {c} THEN {text} END")
        lst = f"CASE WHEN high_count > 0 THEN list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) ELSE ['{N.NO_ACTIVITY}'] END"
        parts.append(f"SELECT '{role}' AS role, {lst} AS recs FROM fx")
    return q(facts + f"""
, r AS ({' UNION ALL '.join(parts)})
SELECT role, CAST(j - 1 AS INTEGER) AS ordinal, recs[j] AS text FROM r, range(1, 7) t(j) WHERE j <= len(recs)""")


@register("role_recommendations", _a7_sql())
def _role_recommendations(spark, sf_dir):
    return N.role_recommendations(N.role_facts(W(spark, sf_dir).all_scored()))


# ---------------------------------------------------------------- remaining registrations

@register("recent_sends", q(f"""
SELECT * FROM (
  SELECT row_number() OVER w AS log_id, 'cmp_001' AS campaign_id, email AS recipient_email, customer_id, 'queued' AS status,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (row_number() OVER w) SECOND AS sent_at
  FROM ({_AUDIENCE_SQL}) a WINDOW w AS (ORDER BY predicted_probability DESC, customer_id)) s
ORDER BY sent_at DESC, log_id DESC LIMIT 20"""))
def _recent_sends(spark, sf_dir):
    aud = C.audience(W(spark, sf_dir).active_scored(), "high_risk")
    plan = C.send_plan(C.render(aud, TEMPLATE_SUBJECT, TEMPLATE_BODY), "cmp_001", salt="fixture")
    logs = plan.withColumn("sent_at", fixtures._ntz("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("log_id")))
    return K.recent_sends(logs, "cmp_001", 20)


@register("append_audit", f"""
SELECT user_role, count(*) AS entries FROM (
  SELECT user_role FROM ({_AUDIT_SQL}) a
  UNION ALL SELECT 'CSM' FROM ({_LATEST_ASSIGN_SQL.format(where="WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")}) u) t
GROUP BY user_role""")
def _append_audit(spark, sf_dir):
    u = fixtures.assignment_updates(spark, sf_dir)
    cut = fixtures._ntz("1997-01-01 00:00:00")
    _, rows = O.merge_assignments(O.latest_assignments(u.where(F.col("last_updated") < cut)), u.where(F.col("last_updated") >= cut))
    audit = O.append_audit(fixtures.audit_logs(spark, sf_dir), rows)
    return audit.groupBy("user_role").agg(F.count(F.lit(1)).alias("entries"))


@register("csv_roundtrip", q("SELECT source_id, count(*) AS customers, round(sum(monthly_charges), 2) AS charges FROM cc GROUP BY source_id"))
def _csv_roundtrip(spark, sf_dir):
    from ebbtide.sources.tables import read_customers
    path = scratch_path(spark, "s1-csv")
    S.write_csv(W(spark, sf_dir).customers, path)
    back = read_customers(spark, path, "csv")
    return back.groupBy("source_id").agg(F.count(F.lit(1)).alias("customers"),
                                         F.round(F.sum("monthly_charges"), 2).alias("charges"))


@register("json_roundtrip", q("SELECT contract_type, count(*) AS customers, CAST(sum(support_tickets) AS BIGINT) AS tickets FROM cc GROUP BY contract_type"))
def _json_roundtrip(spark, sf_dir):
    from ebbtide.sources.tables import read_customers
    path = scratch_path(spark, "s2-json")
    W(spark, sf_dir).customers.write.json(path)
    back = read_customers(spark, path, "json", json_array=False)
    return back.groupBy("contract_type").agg(F.count(F.lit(1)).alias("customers"), F.sum("support_tickets").alias("tickets"))


@register("detect_target_upload", q("""
SELECT customer_id, CASE WHEN churned = 1 THEN 1 ELSE 0 END AS churned FROM cc"""))
def _detect_target(spark, sf_dir):
    c = W(spark, sf_dir).customers
    upload = c.select(F.col("customer_id").alias("CustomerID"),
                      F.when(F.col("churned") == 1, F.lit("no")).otherwise(F.lit("Active")).alias("Is_Active"))
    df, _ = I.standardise_id(upload)
    df, kind = I.detect_target(df)
    assert kind == "active"
    return df.select("customer_id", "churned")


# ---------------------------------------------------------------- sources switched, deleted and in sample mode

def _of_registry(where: str) -> str:
    return q(f"""
SELECT prediction_label, count(*) AS customers, round(sum(predicted_probability), 6) AS total_risk
FROM cp JOIN cc USING (customer_id) WHERE {where} GROUP BY prediction_label""")


def _risk_of(w) -> DataFrame:
    return w.active_scored().groupBy("prediction_label").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("predicted_probability"), 6).alias("total_risk"))


@register("risk_after_toggle", _of_registry("source_id <> 'src_automobile'"))
def _risk_after_toggle(spark, sf_dir):
    """R2, then J1: the answer follows the registry, one source switched on and one off."""
    w = W(spark, sf_dir)
    on = w.with_sources(R.toggle_source(w.sources, "src_furniture", True))
    return _risk_of(on.with_sources(R.toggle_source(on.sources, "src_automobile", False)))


@register("risk_after_delete", _of_registry("source_id NOT IN ('src_furniture', 'src_automobile')"))
def _risk_after_delete(spark, sf_dir):
    """R3, then J1: a deleted source is out of every later answer."""
    return _risk_of(W(spark, sf_dir).without_source("src_automobile"))


@register("delete_source_frames", q("""
SELECT 'predictions' AS frame, source_id, count(*) AS n FROM cp JOIN cc USING (customer_id) WHERE source_id <> 'src_automobile' GROUP BY source_id
UNION ALL SELECT 'customers', source_id, count(*) FROM cc WHERE source_id <> 'src_automobile' GROUP BY source_id
UNION ALL SELECT 'sources', source_id, count(*) FROM ds WHERE source_id <> 'src_automobile' GROUP BY source_id"""))
def _delete_source_frames(spark, sf_dir):
    """What is left in each of the three tables, by source."""
    w = W(spark, sf_dir)
    preds, customers, sources = R.delete_source(w.predictions, w.customers, w.sources, "src_automobile")
    frames = {"predictions": preds.join(w.customers.select("customer_id", "source_id"), "customer_id"),
              "customers": customers, "sources": sources}
    parts = [f.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("frame"), "source_id", "n") for k, f in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _with_sample(spark, sf_dir):
    """The warehouse after the customers without a contract were registered as the sample source."""
    w = W(spark, sf_dir)
    sample = w.customers.where(F.col("contract_type").isNull())
    return w.with_sources(R.register_source(spark, w.sources, "sample_data", "sample.csv", sample))


@register("set_mode_sample", q("""
SELECT source_id, row_count, 0 AS is_active FROM ds
UNION ALL SELECT 'sample_data', (SELECT count(*) FROM cc WHERE contract_type IS NULL), 1"""))
def _set_mode_sample(spark, sf_dir):
    """Sample mode switches the sample source on and all others off."""
    return R.set_mode(_with_sample(spark, sf_dir).sources, "sample").select("source_id", "row_count", "is_active")


@register("is_sample_only_by_mode", """
SELECT 'custom' AS mode, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS active_sources, false AS sample_only FROM customer
UNION ALL SELECT 'sample', 1, true""")
def _is_sample_only_by_mode(spark, sf_dir):
    """R6 after R4 in both modes."""
    sources = _with_sample(spark, sf_dir).sources
    parts = [R.is_sample_only(R.set_mode(sources, m)).select(F.lit(m).alias("mode"), "active_sources", "sample_only") for m in ("custom", "sample")]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- rows of single operators

@register("alert_rows", q("""
SELECT customer_id, predicted_probability, prediction_label, source_id, region, monthly_charges
FROM cp JOIN cc USING (customer_id)"""))
def _alert_rows(spark, sf_dir):
    w = W(spark, sf_dir)
    return J.alert_rows(w.predictions, w.customers).select(
        "customer_id", "predicted_probability", "prediction_label", "source_id", "region", "monthly_charges")


@register("assignment_status", f"""
SELECT customer_id, csm_name, status, notes, last_updated FROM ({_LATEST_ASSIGN_SQL.format(where='')}) u""")
def _assignment_status(spark, sf_dir):
    return O.assignment_status(O.latest_assignments(fixtures.assignment_updates(spark, sf_dir)))


@register("payload_scan_page_parts", """
SELECT page_id, part, CASE WHEN regexp_matches(lower(body), '<script|javascript:|onload\\s*=|onerror\\s*=|alert\\(|document\\.cookie')
                           THEN 'Cross-Site Scripting Attempt Blocked' END AS reason
FROM (SELECT page_id, CAST(unnest(range(len(p))) AS INTEGER) AS part, unnest(p) AS body FROM (SELECT page_id, string_split(html, '>') AS p FROM pages) s) t
WHERE regexp_matches(lower(body), '<script|javascript:|onload\\s*=|onerror\\s*=|alert\\(|document\\.cookie')""")
def _payload_page_parts(spark, sf_dir):
    """P4 on the parts of every page between two tag ends: those that hold a payload, and by their absence those that hold none."""
    from ebbtide.sources.tables import table
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("part", "body"))
    return PR.payload_scan(parts.withColumn("_k", F.struct("page_id", "part")), ["body"], "_k").select("_k.page_id", "_k.part", "reason")


@register("charges_in_euros", q("""
SELECT customer_id, round(monthly_charges * CAST(0.92 AS DOUBLE), 2) AS monthly_charges, tenure_months, 'EUR' AS currency FROM scored"""))
def _charges_in_euros(spark, sf_dir):
    c = W(spark, sf_dir).active_scored().select("customer_id", "monthly_charges", "tenure_months")
    return A.convert_currency(c, "eur", ["monthly_charges"])


@register("context_summary_frames", q("""
SELECT 'breakdown' AS frame, prediction_label AS name, count(*) AS n FROM scored GROUP BY prediction_label
UNION ALL SELECT * FROM (SELECT 'top', customer_id, CAST(support_tickets AS BIGINT) FROM scored ORDER BY predicted_probability DESC, customer_id LIMIT 15) t
UNION ALL SELECT 'history', concat(source_id, ' ', CASE WHEN is_active = 1 THEN 'ACTIVE' ELSE 'INACTIVE' END), row_count FROM ds"""))
def _context_summary_frames(spark, sf_dir):
    """The three frames beside the totals."""
    w = W(spark, sf_dir)
    f = N.context_summary(w.active_scored(), w.sources)
    parts = [f["breakdown"].select(F.lit("breakdown").alias("frame"), F.col("label").alias("name"), F.col("customers").alias("n")),
             f["top"].select(F.lit("top").alias("frame"), F.col("customer_id").alias("name"), F.col("support_tickets").cast("bigint").alias("n")),
             f["history"].select(F.lit("history").alias("frame"), F.concat_ws(" ", "source_id", "status").alias("name"), F.col("row_count").alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("import_replace", """
SELECT CAST(o_orderkey AS VARCHAR) AS customer_id, o_totalprice AS amount, o_orderpriority AS "Service Level",
       CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS BIGINT) AS churned FROM orders""")
def _import_replace(spark, sf_dir):
    """A file of its own columns, with an id and a target under other names, becomes the table."""
    from ebbtide.sources.published import read_table, replace_table
    from ebbtide.sources.tables import table
    answer = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "P", "2.7").otherwise("no")
    upload = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("amount"),
                                                   F.col("o_orderpriority").alias("Service Level"), answer.alias("Is Churned?"))
    root = scratch_path(spark, "replaced")
    replace_table(I.import_replace(I.normalise(upload)), root)
    return read_table(spark, root)


# ---------------------------------------------------------------- files with awkward text

@register("csv_text_roundtrip", """
SELECT 'page' AS kind, page_id AS id, sha256(html) AS digest FROM pages WHERE html <> ''
UNION ALL SELECT 'document', doc_id, sha256(text) FROM documents WHERE text <> ''""")
def _csv_text_roundtrip(spark, sf_dir):
    """S4, then S1: whole texts with quotes, commas and line breaks come back as they were (CSV tells no empty text from none)."""
    from ebbtide.sources.tables import read_customers, table
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    rows, path = pages.unionByName(docs).where("body <> ''"), scratch_path(spark, "s1-text")
    S.write_csv(rows, path)
    back = read_customers(spark, path, "csv", schema="kind string, id long, body string", multi_line=True)
    return back.select("kind", "id", F.sha2("body", 256).alias("digest"))


@register("json_array_import", """
SELECT page_id, url, sha256(html) AS digest FROM pages""")
def _json_array_import(spark, sf_dir):
    """Files that hold an array of records each, as an upload does; here one per partition of the pages."""
    import pyarrow as pa

    from ebbtide.sources.tables import read_customers, table

    def arrays(batches):
        mark = "["
        for batch in batches:
            lines = [("," if i or mark != "[" else "[") + x for i, x in enumerate(batch.column(0).to_pylist())]
            if lines:
                mark = ","
                yield pa.RecordBatch.from_pydict({"value": lines})
        if mark != "[":
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    path = scratch_path(spark, "s2-array")
    records = table(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", "url", "html")))
    records.mapInArrow(arrays, "value string").write.text(path)
    back = read_customers(spark, path, "json", schema="page_id long, url string, html string")
    return back.select("page_id", "url", F.sha2("html", 256).alias("digest"))
