"""Account assignments, audit log, risk-history snapshots and SLA alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig

P = "predicted_probability"

# Audit texts of an assignment and of an SLA alert, and the alert headline format.
ASSIGN_ROLE = "CSM"
ASSIGN_ACTION = "Assigned account to %s and marked status as %s"
ALERT_TEXT = "🚨 *HIGH-RISK CHURN ALERT*: Customer *%s* has a predicted churn rate of *%s%%*!"
ALERT_AUDIT_ROLE = "System SLA Alert"
ALERT_AUDIT_ACTION = "Automated 24-hr SLA alert dispatched to notification channels"


def latest_assignments(updates: DataFrame) -> DataFrame:
    """Latest update per customer by (last_updated, update_seq): a struct max, combined map-side."""
    cols = [c for c in updates.columns if c not in ("customer_id", "last_updated", "update_seq")]
    best = updates.groupBy("customer_id").agg(F.max(F.struct("last_updated", "update_seq", *cols)).alias("_b"))
    return best.select("customer_id", *[F.col(f"_b.{c}").alias(c) for c in cols], F.col("_b.last_updated").alias(
        "last_updated"), F.col("_b.update_seq").alias("update_seq"))


def merge_assignments(old: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O1: the latest update per customer replaces its assignment; one audit row per applied update."""
    latest = latest_assignments(updates)
    cols = ["customer_id", "csm_name", "status", "notes", "last_updated"]
    merged = old.select(*cols).join(latest.select("customer_id"), "customer_id", "left_anti").unionByName(latest.select(*cols))
    audit = latest.select(F.lit(ASSIGN_ROLE).alias("user_role"),
                          F.format_string(ASSIGN_ACTION, F.col("csm_name"), F.col("status")).alias("action"),
                          F.col("customer_id").alias("target_customer"), F.col("last_updated").alias("timestamp"))
    return merged, audit


def assignment_status(assign: DataFrame) -> DataFrame:
    """O2."""
    return assign.select("customer_id", "csm_name", "status", "notes", "last_updated")


def append_audit(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """O3: append-only."""
    return audit.unionByName(rows, allowMissingColumns=True)


def snapshot_history(preds: DataFrame, date_col=None) -> DataFrame:
    """today's (or the given date's) probability and a label at the 0.5 cut, per customer."""
    d = date_col if date_col is not None else F.current_date()
    return preds.select("customer_id", P,
                        F.when(F.col(P) >= 0.5, F.lit("high_risk")).otherwise(F.lit("low_risk")).alias("prediction_label"),
                        d.alias("recorded_date"))


def sla_alerts(scored: DataFrame, assignments: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG,
               default_csm: str = "CSM Bot") -> DataFrame:
    """For every high-risk customer an alert text, a structured JSON payload and an audit row."""
    hi = scored.where(F.col("prediction_label") == F.lit(cfg.high_label))
    a = assignments.select("customer_id", "csm_name")
    j = hi.join(a, "customer_id", "left")
    csm = F.coalesce(F.col("csm_name"), F.lit(default_csm))
    pct = F.format_string("%.1f", F.col(P) * 100)
    text = F.format_string(ALERT_TEXT, F.col("customer_id"), pct)
    payload = F.to_json(F.struct(F.col("customer_id"), pct.alias("risk_pct"), F.col("monthly_charges").alias("mrr"),
                                 F.col("region"), csm.alias("csm"), F.col("support_tickets").alias("tickets")))
    return j.select("customer_id", text.alias("text"), payload.alias("payload"),
                    F.lit(ALERT_AUDIT_ROLE).alias("audit_role"), F.lit(ALERT_AUDIT_ACTION).alias("audit_action"))
