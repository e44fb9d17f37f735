"""The joins of the retention model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import broadcast_if_small

# The registry holds one row per imported file; far below this bound in any deployment.
MAX_REGISTRY_ROWS = 1_000_000


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("is_active") == 1).select("source_id")


def active_scored(preds: DataFrame, customers: DataFrame, sources: DataFrame, registry_small: bool | None = None) -> DataFrame:
    """J1 ACTIVE_SCORED: predictions ⋈ customers ⋈ active sources (inner).

    The active-source filter is a broadcast semi join on the customer side (checked size, or the
    caller's earlier check in ``registry_small``), then predictions join customers on
    ``customer_id`` — co-bucketed when both are stored tables.
    """
    return preds.join(of_active(customers, sources, registry_small), "customer_id")


def of_active(rows: DataFrame, sources: DataFrame, registry_small: bool | None = None) -> DataFrame:
    """The rows (with ``source_id``) of active sources, columns as they are."""
    act = active_sources(sources)
    if registry_small is None:
        act = broadcast_if_small(act, MAX_REGISTRY_ROWS)
    elif registry_small:
        act = F.broadcast(act)
    return rows.join(act, "source_id", "left_semi").select(*rows.columns)


def active_only(customers: DataFrame, sources: DataFrame) -> DataFrame:
    """Customers of active sources (broadcast semi join; no ordering)."""
    return of_active(customers, sources)


def all_scored(preds: DataFrame, customers: DataFrame) -> DataFrame:
    """Predictions ⟕ customers, no active filter."""
    return preds.join(customers, "customer_id", "left")


def customer_profile(customers: DataFrame, preds: DataFrame, assignments: DataFrame, ids: DataFrame) -> DataFrame:
    """Customer ⟕ prediction ⟕ assignment for a set of ids, matched case-insensitively.

    ``ids`` has one column ``lookup_id``; it is reduced to distinct upper-case keys and semi-joined.
    """
    keys = ids.select(F.upper(F.col("lookup_id")).alias("_key")).distinct()
    c = customers.withColumn("_key", F.upper("customer_id")).join(keys, "_key", "left_semi")
    p = preds.select(F.upper("customer_id").alias("_key"), "predicted_probability", "prediction_label",
                     "risk_drivers", "ci_lower", "ci_upper")
    a = assignments.select(F.upper("customer_id").alias("_key"), "csm_name", F.col("status").alias("assignment_status"),
                           "notes", "last_updated")
    return c.join(p, "_key", "left").join(a, "_key", "left").drop("_key")


def anti_ids(df: DataFrame, existing: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``existing``."""
    return df.join(existing.select(key), key, "left_anti")


def semi_ids(df: DataFrame, keys: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (``IN (SELECT ...)``)."""
    return df.join(keys.select(key), key, "left_semi")


def alert_rows(preds: DataFrame, customers: DataFrame) -> DataFrame:
    """Prediction ⋈ customer, for alerting."""
    return preds.join(customers, "customer_id")
