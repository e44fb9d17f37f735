"""Driver tables -> the retention data model.

The driver's TPC-H-like tables carry no customer-retention columns, so a deterministic mapping
derives them (FIXTURES.md §3). Attributes without a counterpart are stand-ins computed from keys.

Plan shape (what Catalyst runs):
  lineitem --partial agg by order--> shuffle(l_orderkey) --join orders (1:1 on the order key)-->
  partial agg by customer --> shuffle(o_custkey) --join customer (+broadcast geography)-->
  join per-user event counts (co-partitioned on the customer key).
Line items are pre-aggregated per order before the only shuffle they take part in, so a hot order
or customer key is combined map-side and never reaches one reducer as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.ingest import format_seq_id
from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.scalars import clip01, fixed_band, heuristic_score, risk_label
from ebbtide.session import broadcast_if_small
from ebbtide.sources.tables import table

# Fixed values of the mapping (FIXTURES.md §3).
CHURN_CUTOFF = "2000-11-01 00:00:00"
CHARGE_DIVISOR = 31600.0
REGISTRY_CREATED_AT = "2024-01-01 00:00:00"
INACTIVE_SOURCE = "src_furniture"
PREDICTIONS_CREATED_AT = "2024-01-02 00:00:00"

CUSTOMER_COLUMNS = ["customer_id", "source_id", "tenure_months", "monthly_charges", "total_charges",
                    "contract_type", "internet_service", "payment_method", "region", "support_tickets",
                    "payment_delays", "product_usage", "complaint_count", "customer_satisfaction_score",
                    "churned"]


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def customer_id_of(custkey) -> F.Column:
    """``C`` and the key, padded to 9 digits and never cut: longer keys stay whole."""
    return format_seq_id("C", custkey, 9)


def order_stats_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: order value, last order date, urgent and late counts, return-line counts."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = (table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_returnflag", "l_quantity")
             .groupBy("l_orderkey")
             .agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("compl"),
                  F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
                  F.count(F.lit(1)).alias("n_line")))
    per_order = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return per_order.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("tp"),
        F.max("o_orderdate").alias("last_o"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urg"),
        F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).alias("late"),
        # NULL when none of the customer's orders has line items (inner-join semantics)
        F.sum("compl").alias("compl"),
        F.sum("n_ret").alias("n_ret"),
        F.sum("n_line").alias("n_line"))


def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .where(F.col("event_type").isin("view", "click"))
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_use")))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # both sides are tiny in TPC-H-like data; Catalyst's size estimate picks the strategy
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")


def customer_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``customer_churn`` table (one row per customer) derived from the driver tables."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = broadcast_if_small(geography(spark, sf_dir), max_rows=100_000)
    stats = order_stats_by_customer(spark, sf_dir)
    usage = usage_by_user(spark, sf_dir)
    b = (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
         .join(stats, cust.c_custkey == stats.o_custkey, "left")
         .join(usage, cust.c_custkey == usage.user_id, "left"))
    k = F.col("c_custkey")
    raw_csat = F.lit(5.0) - F.lit(6.0) * F.col("n_ret") / F.col("n_line")
    monthly = F.round(F.col("tp") / F.lit(CHARGE_DIVISOR), 2)
    tenure = ((k * 37) % 73).cast("bigint")
    out = b.select(
        customer_id_of(k).alias("customer_id"),
        F.concat(F.lit("src_"), F.lower("c_mktsegment")).alias("source_id"),
        tenure.alias("tenure_months"),
        monthly.alias("monthly_charges"),
        F.round(monthly * tenure, 2).alias("total_charges"),
        F.when(F.col("c_nationkey") % 4 == 0, "Month-to-month").when(F.col("c_nationkey") % 4 == 1, "One year")
         .when(F.col("c_nationkey") % 4 == 2, "Two year").alias("contract_type"),
        F.when(k % 3 == 0, "Fiber optic").when(k % 3 == 1, "DSL").otherwise("No").alias("internet_service"),
        F.when(k % 5 == 0, "Electronic check").when(k % 5 == 1, "Mailed check").when(k % 5 == 2, "Bank transfer")
         .when(k % 5 == 3, "Credit card").alias("payment_method"),
        F.col("r_name").alias("region"),
        F.col("urg").cast("bigint").alias("support_tickets"),
        F.col("late").cast("bigint").alias("payment_delays"),
        F.col("n_use").cast("double").alias("product_usage"),
        F.col("compl").cast("bigint").alias("complaint_count"),
        F.when(F.col("n_line").isNull(), F.lit(None).cast("double"))
         .when(raw_csat < 1, F.lit(1.0)).otherwise(F.round(raw_csat, 1)).alias("customer_satisfaction_score"),
        F.when(F.col("last_o").isNull(), F.lit(None).cast("bigint"))
         .when(F.col("last_o") < _ntz(CHURN_CUTOFF), F.lit(1).cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("churned"),
    )
    return out


def data_sources(customers: DataFrame) -> DataFrame:
    """The source registry: one row per source, with its row count; one segment is switched off."""
    return (customers.groupBy("source_id").agg(F.count(F.lit(1)).alias("row_count"))
            .select("source_id",
                    F.concat("source_id", F.lit(".csv")).alias("filename"),
                    "row_count",
                    _ntz(REGISTRY_CREATED_AT).alias("created_at"),
                    F.when(F.col("source_id") == INACTIVE_SOURCE, F.lit(0)).otherwise(F.lit(1)).alias("is_active")))


def heuristic_predictions(customers: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """``churn_predictions`` from the rule score: p = clip(score), label at the threshold, p ± 0.08 band."""
    p = clip01(heuristic_score(customers))
    scored = customers.select("customer_id", p.alias("predicted_probability"))
    lo, hi = fixed_band(F.col("predicted_probability"))
    return scored.select(
        "customer_id", "predicted_probability",
        risk_label(F.col("predicted_probability"), cfg).alias("prediction_label"),
        F.array().cast("array<string>").alias("risk_drivers"),
        lo.alias("ci_lower"), hi.alias("ci_upper"),
        _ntz(PREDICTIONS_CREATED_AT).alias("created_at"))


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``risk_history`` snapshots from events: p = value / 500 clipped, label at the 0.5 cut."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    p = clip01(F.col("value") / F.lit(500.0))
    return ev.select(
        F.col("event_id").alias("history_id"),
        customer_id_of(F.col("user_id")).alias("customer_id"),
        p.alias("predicted_probability"),
        F.when(p >= F.lit(0.5), F.lit("high_risk")).otherwise(F.lit("low_risk")).alias("prediction_label"),
        F.to_date("ts").alias("recorded_date"),
        F.col("ts").alias("recorded_ts"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return ev.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("user_role"),
                     F.col("props").alias("action"), customer_id_of(F.col("user_id")).alias("target_customer"),
                     F.col("ts").alias("timestamp"))


def assignment_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return o.select(customer_id_of(F.col("o_custkey")).alias("customer_id"),
                    F.col("o_orderpriority").alias("csm_name"), F.col("o_orderstatus").alias("status"),
                    F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("notes"),
                    F.col("o_orderdate").alias("last_updated"), F.col("o_orderkey").alias("update_seq"))


ENGAGEMENT_KIND = {"signup": "sent", "view": "open", "click": "click", "error": "bounce"}


def engagement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email engagement log from events: token = user id; signup=sent, view=open, click=click, error=bounce."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = F.create_map(*[x for k, v in ENGAGEMENT_KIND.items() for x in (F.lit(k), F.lit(v))])
    return (ev.where(F.col("event_type").isin(*ENGAGEMENT_KIND))
            .select("event_id", F.col("user_id").cast("string").alias("tracking_token"),
                    F.element_at(kind, F.col("event_type")).alias("kind"), "ts"))
