"""Exports and the prediction sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.joins import MAX_REGISTRY_ROWS, active_sources
from ebbtide.session import broadcast_if_small

P = "predicted_probability"


def export_predictions(scored: DataFrame) -> DataFrame:
    """Id, probability, label, then every customer column but the id; probability desc.

    The sort is a range-partitioned sort: the writer emits ordered part files in parallel instead of
    funnelling everything through one task.
    """
    skip = {"customer_id", P, "prediction_label", "risk_drivers", "ci_lower", "ci_upper", "created_at"}
    rest = [c for c in scored.columns if c not in skip]
    return scored.select("customer_id", P, "prediction_label", *rest).orderBy(F.col(P).desc(), "customer_id")


# Header of the audit export and the replacement of a double quote in actions
# (the reference writes the text "39" in place of each double quote).
AUDIT_HEADER = ["Timestamp", "User/Role", "Action Target", "Action Taken"]
QUOTE_REPLACEMENT = "39"


def export_audit(audit: DataFrame) -> DataFrame:
    """Audit rows for CSV export, newest first; a NULL target is ``n/a``."""
    return (audit.select(F.col("timestamp").cast("string").alias(AUDIT_HEADER[0]),
                         F.col("user_role").alias(AUDIT_HEADER[1]),
                         F.coalesce(F.col("target_customer"), F.lit("n/a")).alias(AUDIT_HEADER[2]),
                         F.replace(F.col("action"), F.lit('"'), F.lit(QUOTE_REPLACEMENT)).alias(AUDIT_HEADER[3]),
                         F.col("timestamp").alias("_ts"), F.col("log_id").alias("_id"))
            .orderBy(F.desc("_ts"), F.desc("_id")).drop("_ts", "_id"))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    (df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def merge_predictions(old: DataFrame, new: DataFrame, customers: DataFrame, sources: DataFrame,
                      stamp=None) -> DataFrame:
    """Drop old predictions of active sources' customers (all of them when no source is active),
    then insert-or-replace the new ones by id (first new row per id wins), stamped ``created_at``.

    Returns the next version of the table; the caller writes it to a new directory.
    """
    act = active_sources(sources)
    ts = stamp if stamp is not None else F.current_timestamp().cast("timestamp_ntz")
    if act.limit(1).count() == 0:
        kept = old.limit(0)
    else:
        ids = customers.join(broadcast_if_small(act, MAX_REGISTRY_ROWS), "source_id", "left_semi").select("customer_id")
        kept = old.join(ids, "customer_id", "left_anti")
    # first new row per id: by file order when it was captured (``_row``), else by value — deterministic
    # either way, and combined map-side
    others = [c for c in new.columns if c not in ("customer_id", "_row")]
    lead = ["_row"] if "_row" in new.columns else []
    first = new.groupBy("customer_id").agg(F.min(F.struct(*lead, *others)).alias("_n"))
    fresh = first.select("customer_id", *[F.col(f"_n.{c}").alias(c) for c in others]).withColumn("created_at", ts)
    kept = kept.join(fresh.select("customer_id"), "customer_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
