"""The data-source registry (one row per imported file, with an active flag)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.operators.joins import MAX_REGISTRY_ROWS, active_sources
from ebbtide.session import broadcast_if_small


def active_customers(customers: DataFrame, sources: DataFrame) -> DataFrame:
    """Customers of active sources, ordered by id (the training load)."""
    act = broadcast_if_small(active_sources(sources), MAX_REGISTRY_ROWS)
    return customers.join(act, "source_id", "left_semi").orderBy("customer_id")


def toggle_source(sources: DataFrame, source_id: str, active: bool) -> DataFrame:
    """R2: switch one source on or off."""
    return sources.withColumn("is_active", F.when(F.col("source_id") == F.lit(source_id), F.lit(1 if active else 0))
                              .otherwise(F.col("is_active")))


def delete_source(preds: DataFrame, customers: DataFrame, sources: DataFrame, source_id: str):
    """Cascade — predictions of the source's customers, then its customers, then its registry row."""
    gone = customers.where(F.col("source_id") == F.lit(source_id)).select("customer_id")
    return (preds.join(gone, "customer_id", "left_anti"),
            customers.where(F.col("source_id") != F.lit(source_id)),
            sources.where(F.col("source_id") != F.lit(source_id)))


def set_mode(sources: DataFrame, mode: str, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """``sample`` activates exactly the sample source; ``custom`` activates all but it."""
    is_sample = F.col("source_id") == F.lit(cfg.sample_source_id)
    flag = is_sample if mode == "sample" else ~is_sample
    return sources.withColumn("is_active", F.when(flag, F.lit(1)).otherwise(F.lit(0)))


def list_sources(sources: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Sources except the sample, newest first, with ACTIVE/INACTIVE."""
    return (sources.where(F.col("source_id") != F.lit(cfg.sample_source_id))
            .select("source_id", "filename", "row_count", "created_at", "is_active",
                    F.when(F.col("is_active") == 1, F.lit("ACTIVE")).otherwise(F.lit("INACTIVE")).alias("status"))
            .orderBy(F.desc("created_at"), "source_id"))


def is_sample_only(sources: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Exactly one active source and it is the sample (one-row answer)."""
    act = sources.where(F.col("is_active") == 1)
    agg = act.agg(F.count(F.lit(1)).alias("active_sources"),
                  F.count_if(F.col("source_id") == F.lit(cfg.sample_source_id)).alias("_sample"))
    return agg.select("active_sources", ((F.col("active_sources") == 1) & (F.col("_sample") == 1)).alias("sample_only"))


def register_source(spark: SparkSession, sources: DataFrame, source_id: str, filename: str, rows: DataFrame) -> DataFrame:
    """Append a registry row for an import; the row count is counted by Spark, not the driver."""
    new = rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source_id).alias("source_id"), F.lit(filename).alias("filename"), "row_count",
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("is_active"))
    return sources.where(F.col("source_id") != F.lit(source_id)).unionByName(new)
