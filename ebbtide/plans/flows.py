"""The three end-to-end flows of the application, composed from the operators.

E1 ``upload``: file → id/quality/target checks → normalise → replace import → register → train →
predictions → custom mode. E2 ``dashboard_state``: every panel derived from one stored ACTIVE_SCORED.
E3 ``campaign_send_plan``: audience → personalised messages → queued send log. Each returns
DataFrames (plus small driver-side warning texts); nothing row-sized is collected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.operators import aggregates as A
from ebbtide.operators import campaigns as C
from ebbtide.operators import ingest as I
from ebbtide.operators import insights as N
from ebbtide.operators import model as M
from ebbtide.operators import projections as PR
from ebbtide.operators import registry as R
from ebbtide.operators.joins import active_scored, all_scored
from ebbtide.sources import sinks as S
from ebbtide.sources.tables import read_customers

# Fixed value: the upload warning when the file has no id column.
MISSING_ID_WARNING = ("Missing explicit 'customer_id' column. Unique identifiers (e.g. CUST_00001) were "
                      "auto-generated for analysis.")

REGISTRY_SCHEMA = "source_id string, filename string, row_count bigint, created_at timestamp_ntz, is_active int"
PREDICTION_SCHEMA = ("customer_id string, predicted_probability double, prediction_label string, "
                     "risk_drivers array<string>, ci_lower double, ci_upper double, created_at timestamp_ntz")


@dataclass
class Tables:
    customers: DataFrame
    sources: DataFrame
    predictions: DataFrame


@dataclass
class UploadResult:
    tables: Tables
    warnings: list[str]
    quality: DataFrame
    model: M.ChurnModel | None


def upload(spark: SparkSession, path: str, fmt: str, filename: str | None = None,
           cfg: RetentionConfig = DEFAULT_CONFIG, source_id: str | None = None) -> UploadResult:
    """E1 for one uploaded file (replace mode, as the upload screen does)."""
    raw = I.with_row_order(read_customers(spark, path, fmt))
    df, found = I.standardise_id(raw)
    warnings = []
    if not found:
        df = I.generate_ids(df)
        warnings.append(MISSING_ID_WARNING)
    quality = I.quality_report(df)
    df, _ = I.detect_target(df, cfg)
    norm = I.normalise(df, cfg)
    sid = source_id or f"src_{uuid.uuid4().hex[:12]}"
    customers = I.import_replace(I.dedup_keep_first(norm.withColumn("source_id", F.lit(sid))))
    empty_registry = spark.createDataFrame([], REGISTRY_SCHEMA)
    sources = R.register_source(spark, empty_registry, sid, filename or path.rsplit("/", 1)[-1], customers)
    model = M.train_active(customers, sources, cfg)
    old = spark.createDataFrame([], PREDICTION_SCHEMA)
    if model is None:
        preds = S.merge_predictions(old, old, customers, sources)
    else:
        active = customers.join(sources.where("is_active = 1").select("source_id"), "source_id", "left_semi")
        scored = model.score(active, cfg)
        stats = M.driver_stats(active, model.features)
        new = scored.select("customer_id", "predicted_probability", "prediction_label",
                            M.risk_drivers(scored, stats, None).alias("risk_drivers"), "ci_lower", "ci_upper")
        preds = S.merge_predictions(old, new, customers, sources)
    sources = R.set_mode(sources, "custom", cfg)
    return UploadResult(Tables(customers, sources, preds), warnings, quality, model)


def dashboard_state(tables: Tables, cfg: RetentionConfig = DEFAULT_CONFIG, role: str = "manager") -> dict[str, DataFrame]:
    """The dashboard's panels. Persist ``tables`` (or use the stored warehouse) — every panel reads
    the same ACTIVE_SCORED."""
    scored = active_scored(tables.predictions, tables.customers, tables.sources)
    rows = PR.predictions_list(scored)
    cats = N.categorical_columns(rows, 4)
    return {
        "summary": A.risk_summary(scored),
        "predictions": rows,
        "charts": A.risk_mix(scored),
        "signals": A.signals(scored),
        "insights": A.business_summary(tables.predictions, cfg),
        "recommendations": N.role_recommendations(N.role_facts(all_scored(tables.predictions, tables.customers), cfg),
                                                  [role]),
        "narrative": N.insight_facts(rows, cats, cfg),
        "segments": N.insight_segments(rows, cats, cfg),
        "metrics": M.evaluate(scored, cfg) if cfg.target_column in scored.columns else None,
    }


def campaign_send_plan(scored: DataFrame, segment: str, subject: str, body: str, campaign_id: str,
                       cfg: RetentionConfig = DEFAULT_CONFIG, salt: str = "") -> DataFrame:
    """E3 up to delivery: the queued send log (delivery itself happens outside Spark)."""
    aud = C.audience(scored, segment, cfg)
    return C.send_plan(C.render(aud, subject, body, cfg.company_name), campaign_id, salt)
