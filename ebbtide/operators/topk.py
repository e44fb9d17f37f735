"""K1–K6: ordered lists. Each is ORDER BY … LIMIT k (Spark's TakeOrderedAndProject: a per-partition
top-k and one k-row merge, no full sort), always with an id tiebreak so the cut is deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.scalars import underscore_title

P = "predicted_probability"

# Action text per label in the vulnerable-accounts report.
HIGH_ACTION = "Proactive 24h Phone Call & 20% Retention Offer"
LOW_ACTION = "Routine Engagement & Service Check"


def top_k(df: DataFrame, by: str, k: int, tiebreak: str = "customer_id", ascending: bool = False) -> DataFrame:
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, F.col(tiebreak).asc()).limit(k)


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def top_vulnerable(scored: DataFrame, k: int = 25, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """K1: the k most at-risk active customers with the action text for their label."""
    cols = ["customer_id", P, "prediction_label"] + _present(
        scored, ["monthly_charges", "tenure_months", "contract_type", "payment_method", "region"])
    action = F.when(F.col("prediction_label") == cfg.high_label, F.lit(HIGH_ACTION)).otherwise(F.lit(LOW_ACTION))
    return top_k(scored.select(*cols, action.alias("action")), P, k)


def top_risk(scored: DataFrame, k: int = 15) -> DataFrame:
    """K2: the k highest probabilities with the customer columns present."""
    cols = ["customer_id", P, "prediction_label"] + _present(
        scored, ["region", "contract_type", "tenure_months", "churned", "support_tickets", "payment_delays",
                 "product_usage", "complaint_count", "customer_satisfaction_score"])
    return top_k(scored.select(*cols), P, k)


def high_risk_list(all_scored: DataFrame, k: int = 8, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """K3: high-risk customers (no active filter), with a display contract name."""
    hi = all_scored.where(F.col("prediction_label") == cfg.high_label)
    return top_k(hi.select("customer_id", P, "monthly_charges",
                           underscore_title(F.coalesce(F.col("contract_type"), F.lit("unknown"))).alias("contract_display")),
                 P, k)


def recent(df: DataFrame, ts: str, k: int, tiebreak: str) -> DataFrame:
    """K4/K5/K6: newest k rows by a timestamp."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tiebreak).desc()).limit(k)


def recent_audit(audit: DataFrame, k: int = 50) -> DataFrame:
    return recent(audit.select("log_id", "user_role", "action", "target_customer", "timestamp"), "timestamp", k, "log_id")


def recent_assignments(assign: DataFrame, k: int = 8) -> DataFrame:
    return recent(assign.select("customer_id", "csm_name", "status", "notes", "last_updated"), "last_updated", k,
                  "customer_id")


def recent_sends(logs: DataFrame, campaign_id, k: int = 20) -> DataFrame:
    c = logs.where(F.col("campaign_id") == F.lit(campaign_id))
    return recent(c.select("log_id", "campaign_id", "recipient_email", "customer_id", "status", "sent_at"), "sent_at", k,
                  "log_id")
