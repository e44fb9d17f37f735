"""The aggregates a retention team asks for, each one scan + one (partial) aggregation.

Every function takes the scored frame (ACTIVE_SCORED, or all predictions where the name says
``_all``) and returns a small DataFrame; nothing is collected. Columns that the reference only
uses when present are checked against ``df.columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import (CURRENCY_RATES, DEFAULT_ACTION, DEFAULT_CONFIG, RetentionConfig)

P = "predicted_probability"
LABEL = "prediction_label"
SEGMENT_DIMENSIONS = ("contract_type", "payment_method", "internet_service", "region")
CHARGE_NAMES = ("monthly_charges", "monthlycharges", "charges", "monthly_charge", "monthly")


def num0(df: DataFrame, name: str) -> Column:
    """``value or 0`` as a double: NULL becomes 0, NaN stays NaN."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def cmp_true(c: Column, op: str, v: float) -> Column:
    """Comparison that is false for NaN, as in Python and JavaScript (Spark orders NaN last)."""
    ops = {">=": c >= v, "<=": c <= v, "==": c == v, "<": c < v, ">": c > v}
    return ops[op] & ~F.isnan(c)


def charges_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.lower() in CHARGE_NAMES), None)


def charge_or_100(df: DataFrame) -> Column:
    """Monthly charge with the browser's rule: a missing value counts as 100."""
    name = "monthly_charges" if "monthly_charges" in df.columns else None
    if name is None:
        return F.lit(100.0)
    return F.coalesce(F.col(name).cast("double"), F.lit(100.0))


def js_round(c: Column) -> Column:
    """JavaScript ``Math.round``: half rounds up (towards +inf)."""
    return F.floor(c + F.lit(0.5))


def is_high(cfg: RetentionConfig) -> Column:
    return F.col(LABEL) == F.lit(cfg.high_label)


# --- A1 / A2 / A3 / A4 -------------------------------------------------------------------------

def risk_summary(scored: DataFrame) -> DataFrame:
    """A1 (and A2 when given all predictions): customers and ROUND(AVG(p), 3) per label."""
    return (scored.groupBy(F.col(LABEL).alias("label"))
            .agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg(P), 3).alias("avg_probability"))
            .orderBy(F.desc("customers"), "label"))


def business_summary(preds: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """A3: A2 plus the configured retention action per label."""
    actions = F.create_map(*[x for k, v in cfg.retention_actions.items() for x in (F.lit(k), F.lit(v))])
    return risk_summary(preds).withColumn(
        "recommended_action", F.coalesce(F.try_element_at(actions, F.col("label")), F.lit(DEFAULT_ACTION)))


def risk_mix(scored: DataFrame) -> DataFrame:
    """A4: customers per label."""
    return scored.groupBy(LABEL).agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), LABEL)


# --- A5 / A6 ------------------------------------------------------------------------------------

# Signal names, the column each reads, and its rule (NULL counts as 0).
SIGNALS = [
    ("High support tickets (3+)", "support_tickets", ">=", 3),
    ("Low support tickets (0-1)", "support_tickets", "<=", 1),
    ("High complaints (3+)", "complaint_count", ">=", 3),
    ("Zero complaints", "complaint_count", "==", 0),
    ("Low satisfaction (1-2)", "customer_satisfaction_score", "<=", 2),
    ("High satisfaction (4-5)", "customer_satisfaction_score", ">=", 4),
    ("Payment delays (1+)", "payment_delays", ">=", 1),
    ("Loyal tenure (24mo+)", "tenure_months", ">=", 24),
]


def signals(scored: DataFrame) -> DataFrame:
    """A5: eight conditional counts in one aggregation, unpivoted; zero-valued signals dropped."""
    present = [(i, name, col, op, v) for i, (name, col, op, v) in enumerate(SIGNALS) if col in scored.columns]
    if not present:
        return scored.sparkSession.createDataFrame([], "ordinal int, signal string, customers long")
    counts = scored.agg(*[F.count_if(cmp_true(num0(scored, col), op, v)).alias(f"s{i}") for i, _, col, op, v in present])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("signal"), F.col(f"s{i}").alias("customers"))
                     for i, name, *_ in present])
    return counts.select(F.inline(rows)).where(F.col("customers") > 0)


def role_counts(all_scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Among high-risk rows, tickets ≥ 3, complaints ≥ 3, CSAT ≤ 2 (NULL is 0, so low), delays ≥ 1."""
    hi = is_high(cfg)

    def cnt(col: str, op: str, v: float) -> Column:
        if col not in all_scored.columns:
            return F.lit(0).cast("bigint")
        return F.count_if(hi & cmp_true(num0(all_scored, col), op, v))

    return all_scored.agg(
        cnt("support_tickets", ">=", 3).alias("ticket_heavy"),
        cnt("complaint_count", ">=", 3).alias("complaint_heavy"),
        cnt("customer_satisfaction_score", "<=", 2).alias("low_satisfaction"),
        cnt("payment_delays", ">=", 1).alias("payment_delayed"))


# --- A8 / A9 / A10 / A11 ------------------------------------------------------------------------

def kpis(scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG, rate: float = 1.0) -> DataFrame:
    """Customers, high, low, avg p, MRR, at-risk MRR, high %, at-risk ARR (×12), in one pass."""
    ch = charges_column(scored)
    charge = F.col(ch).cast("double") if ch else F.lit(100.0)
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(is_high(cfg)).alias("high_risk_count"),
        F.count_if(F.col(LABEL) == F.lit(cfg.low_label)).alias("low_risk_count"),
        F.avg(P).alias("_avg"),
        F.sum(charge).alias("_mrr"),
        F.sum(F.when(is_high(cfg), charge).otherwise(F.lit(0.0))).alias("_risk"))
    r = F.lit(float(rate))
    return agg.select(
        "total_customers", "high_risk_count", "low_risk_count",
        F.round(F.coalesce(F.col("_avg"), F.lit(0.0)) * 100, 2).alias("avg_probability_pct"),
        F.round(F.coalesce(F.col("_mrr"), F.lit(0.0)) * r, 2).alias("total_mrr"),
        F.round(F.coalesce(F.col("_risk"), F.lit(0.0)) * r, 2).alias("risk_mrr"),
        F.round(F.coalesce(F.col("_risk"), F.lit(0.0)) * r * 12, 2).alias("risk_arr"),
        F.round(F.when(F.col("total_customers") > 0, F.col("high_risk_count") / F.col("total_customers") * 100)
                .otherwise(F.lit(0.0)), 2).alias("high_risk_pct"))


def exposure(scored: DataFrame) -> DataFrame:
    """Customers, Σ charges, Σ charges·p, exposure % (0 when charges ≤ 0; no division by zero)."""
    ch = charges_column(scored)
    charge = F.col(ch).cast("double") if ch else F.lit(100.0)
    agg = scored.agg(F.count(F.lit(1)).alias("total_customers"),
                     F.coalesce(F.sum(charge), F.lit(0.0)).alias("_c"),
                     F.coalesce(F.sum(charge * F.col(P)), F.lit(0.0)).alias("_l"))
    return agg.select(
        "total_customers",
        F.round("_c", 2).alias("total_charges"),
        F.round("_l", 2).alias("expected_loss"),
        F.when(F.col("_c") > 0, F.round(F.col("_l") / F.col("_c") * 100, 1)).otherwise(F.lit(0.0)).alias("risk_exposure_pct"))


def _display(name: str) -> str:
    return name.replace("_", " ").title()


def segment_loss(scored: DataFrame) -> DataFrame:
    """A10: per dimension value — customers, avg risk (3 dp), expected loss (2 dp); loss desc.

    The four dimensions are unpivoted in one scan and aggregated by (dimension, value) in a single
    partial + final aggregation, instead of one scan per dimension.
    """
    dims = [c for c in SEGMENT_DIMENSIONS if c in scored.columns]
    ch = charges_column(scored)
    loss = (F.col(ch).cast("double") * F.col(P)) if ch else (F.lit(100.0) * F.col(P))
    segs = F.array(*[F.struct(F.lit(_display(c)).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dims])
    exploded = scored.select(F.col(P).alias("_p"), loss.alias("_loss"), F.inline(segs))
    return (exploded.where(F.col("value").isNotNull())
            .groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.round(F.avg("_p"), 3).alias("avg_risk"),
                 F.round(F.sum("_loss"), 2).alias("expected_loss"))
            .orderBy(F.desc("expected_loss"), "dimension", "value"))


def top_segments(scored: DataFrame, k: int = 2) -> DataFrame:
    """The k segments with the largest expected loss (a top-k report: the limit is the feature)."""
    return segment_loss(scored).orderBy(F.desc("expected_loss"), "dimension", "value").limit(k)


# --- A12 / A13 / A14 --------------------------------------------------------------------------

def contract_breakdown(scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Count and high count per raw contract value; NULL is displayed as ``unknown``."""
    return (scored.groupBy("contract_type")
            .agg(F.count(F.lit(1)).alias("cnt"), F.count_if(is_high(cfg)).alias("high_risk_cnt"))
            .select(F.coalesce("contract_type", F.lit("unknown")).alias("contract"),
                    (F.col("contract_type").isNull()).alias("is_null_group"), "cnt", "high_risk_cnt"))


def contract_risk(all_scored: DataFrame) -> DataFrame:
    """Count and mean p per non-NULL contract, risk desc; no active-source filter."""
    return (all_scored.where(F.col("contract_type").isNotNull())
            .groupBy("contract_type")
            .agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg(P), 12).alias("risk"))
            .orderBy(F.desc("risk"), "contract_type"))


def tenure_bucket(c: Column) -> Column:
    return (F.when(c <= 3, "0-3 Months").when(c <= 6, "4-6 Months").when(c <= 12, "7-12 Months")
            .when(c <= 24, "13-24 Months").otherwise("25+ Months"))


def tenure_buckets(scored: DataFrame) -> DataFrame:
    """Tenure buckets; a NULL tenure falls through to ``25+ Months``."""
    return (scored.groupBy(tenure_bucket(F.col("tenure_months")).alias("tenure_bucket"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg(P), 12).alias("avg_prob")))


# --- A15 / A16 / A17 / A18 / A19 / A20 --------------------------------------------------------

RETENTION_FACTORS = (("m1_pct", 0.12), ("m3_pct", 0.32), ("m6_pct", 0.62), ("m12_pct", 1.0))
EMPTY_CURVE = (98, 85, 72, 58)


def _curve_terms(total: Column, churned: Column) -> list[tuple[str, Column]]:
    return [(n, js_round((total - churned * F.lit(f)) / total * F.lit(100.0)).cast("bigint")) for n, f in RETENTION_FACTORS]


def _curve(total: Column, churned: Column) -> list[Column]:
    return [c.alias(n) for n, c in _curve_terms(total, churned)]


def _cohort_contract(df: DataFrame) -> Column:
    c = F.col("contract_type") if "contract_type" in df.columns else F.lit(None).cast("string")
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit("Month-to-month")).otherwise(c.cast("string"))


def _churned_eq1(df: DataFrame) -> Column:
    if "churned" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("churned").cast("double") == 1.0, F.lit(False))


def cohort_retention(scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per contract cohort, total and churned (high risk or churned = 1), M1/M3/M6/M12 %."""
    churn = is_high(cfg) | _churned_eq1(scored)
    agg = (scored.groupBy(_cohort_contract(scored).alias("cohort"))
           .agg(F.count(F.lit(1)).alias("total"), F.count_if(churn).alias("churned")))
    return agg.select("cohort", "total", "churned", *_curve(F.col("total"), F.col("churned")))


def retention_drilldown(scored: DataFrame, selectors: list[str], cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """The retention curve for each selector (``all``, ``contract_<X>``, ``support_high``,
    ``support_low``) in one scan: each row is tagged with the selectors it matches, then grouped.
    An empty selection gives the fixed curve 98/85/72/58."""
    tickets = F.coalesce(F.col("support_tickets").cast("double"), F.lit(0.0)) if "support_tickets" in scored.columns else F.lit(0.0)
    tickets = F.nanvl(tickets, F.lit(0.0))
    tags = F.array(F.lit("all"), F.concat(F.lit("contract_"), _cohort_contract(scored)),
                   F.when(tickets >= 3, F.lit("support_high")).otherwise(F.lit("support_low")))
    churn = is_high(cfg) | _churned_eq1(scored)
    # only the requested tags are counted; zero rows for every requested selector make empty selections
    # appear without a join against the (driver-side) selector list
    counted = (scored.select(F.explode(tags).alias("selector"), churn.alias("_c"))
               .where(F.col("selector").isin(*selectors))
               .groupBy("selector").agg(F.count(F.lit(1)).alias("total"), F.count_if("_c").alias("high_risk_count")))
    zeros = scored.sparkSession.createDataFrame([(x, 0, 0) for x in selectors],
                                                "selector string, total bigint, high_risk_count bigint")
    j = (counted.unionByName(zeros).groupBy("selector")
         .agg(F.sum("total").alias("total"), F.sum("high_risk_count").alias("high_risk_count")))
    total = F.col("total").cast("bigint")
    hr = F.col("high_risk_count").cast("bigint")
    curve = [F.when(total > 0, c).otherwise(F.lit(e).cast("bigint")).alias(n)
             for (n, c), e in zip(_curve_terms(total, hr), EMPTY_CURVE)]
    return j.select("selector", total.alias("total"), hr.alias("high_risk_count"), *curve)


def campaign_roi(scored: DataFrame, threshold: float = 0.6, discount: float = 0.15, success: float = 0.3,
                 rate: float = 1.0) -> DataFrame:
    """Campaign simulation over customers with p ≥ threshold; missing charge counts as 100."""
    p = F.nanvl(F.coalesce(F.col(P).cast("double"), F.lit(0.0)), F.lit(0.0))
    agg = scored.where(p >= F.lit(float(threshold))).agg(
        F.count(F.lit(1)).alias("targeted"), F.coalesce(F.sum(charge_or_100(scored)), F.lit(0.0)).alias("_rev"))
    cost = F.col("_rev") * F.lit(float(discount)) * F.lit(float(rate))
    gross = F.col("_rev") * F.lit(float(success)) * F.lit(float(rate))
    out = agg.select("targeted", F.col("_rev").alias("revenue"), cost.alias("cost"), gross.alias("gross"))
    out = out.select("targeted", "revenue", "cost", "gross", (F.col("gross") - F.col("cost")).alias("net"))
    roi = F.when(F.col("cost") > 0, F.col("net") / F.col("cost") * 100).otherwise(F.lit(0.0))
    # the colour band is decided on the unrounded ROI
    band = F.when(roi >= 20, "success").when(roi >= 0, "warning").otherwise("danger")
    # revenue is a sum of cents; cost/gross/net are products with 2-dp parameters, exact at 4 dp (so no
    # rounding tie can depend on summation order)
    return out.select("targeted", F.round("revenue", 2).alias("revenue"),
                      *[F.round(c, 4).alias(c) for c in ("cost", "gross", "net")],
                      F.round(roi, 2).alias("roi_pct"), band.alias("band"))


def exposure_tips(scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG, rate: float = 1.0) -> DataFrame:
    """Diagnostics over the high-risk rows (missing charge 100, missing CSAT 5)."""
    hi = scored.where(is_high(cfg))
    tickets = num0(scored, "support_tickets")
    csat = F.coalesce(F.col("customer_satisfaction_score").cast("double"), F.lit(5.0)) \
        if "customer_satisfaction_score" in scored.columns else F.lit(5.0)
    p = F.nanvl(F.coalesce(F.col(P).cast("double"), F.lit(0.0)), F.lit(0.0))
    agg = hi.agg(F.count(F.lit(1)).alias("high_risk"),
                 (F.coalesce(F.sum(charge_or_100(scored)), F.lit(0.0)) * F.lit(float(rate))).alias("_at_risk"),
                 F.count_if(cmp_true(tickets, ">=", 3)).alias("ticket_heavy"),
                 F.avg(p).alias("_avg"),
                 F.count_if(cmp_true(csat, "<=", 2)).alias("low_satisfaction"))
    at_risk = F.col("_at_risk")
    return agg.select(
        "high_risk", F.round(at_risk, 2).alias("charges_at_risk"), "ticket_heavy",
        F.when(F.col("high_risk") > 0, F.round(F.col("_avg") * 100, 1)).otherwise(F.lit(0.0)).alias("avg_high_prob_pct"),
        "low_satisfaction",
        F.when(F.col("high_risk") > 0, js_round(F.col("low_satisfaction") / F.col("high_risk") * 100))
         .otherwise(F.lit(0)).cast("bigint").alias("low_satisfaction_pct"),
        F.round(at_risk * 0.40, 2).alias("projected_gross"),
        F.round(at_risk * 0.20, 2).alias("projected_cost"),
        F.round(F.greatest(F.lit(0.0), at_risk * 0.40 - at_risk * 0.20), 2).alias("projected_net"))


def executive_summary(scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """high/low counts, average probability to 3 dp, and the number of distinct fields."""
    p = F.nanvl(F.coalesce(F.col(P).cast("double"), F.lit(0.0)), F.lit(0.0))
    agg = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_high(cfg)).alias("high_risk"), F.avg(p).alias("_avg"))
    return agg.select("total", "high_risk", (F.col("total") - F.col("high_risk")).alias("low_risk"),
                      F.round(F.coalesce("_avg", F.lit(0.0)), 3).alias("avg_probability"),
                      F.lit(len(set(scored.columns))).cast("bigint").alias("field_count"))


def currency_rate(code: str | None) -> float:
    return CURRENCY_RATES.get((code or "USD").upper(), CURRENCY_RATES["USD"])


def convert_currency(df: DataFrame, code: str, columns: list[str]) -> DataFrame:
    """Multiply money columns by a fixed rate; an unknown code means USD."""
    r = F.lit(currency_rate(code))
    return df.select(*[(F.round(F.col(c) * r, 2).alias(c) if c in columns else F.col(c)) for c in df.columns],
                     F.lit((code or "USD").upper() if (code or "USD").upper() in CURRENCY_RATES else "USD").alias("currency"))


# --- A26 / A27 -----------------------------------------------------------------------------

def risk_trend(history: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Mean probability per recorded date, ascending; or one customer's own series."""
    if customer_id is not None:
        return (history.where(F.col("customer_id") == F.lit(customer_id))
                .select("recorded_date", F.col(P).alias("probability")).orderBy("recorded_date"))
    return (history.groupBy("recorded_date").agg(F.round(F.avg(P), 12).alias("probability"),
                                                 F.count(F.lit(1)).alias("snapshots"))
            .orderBy("recorded_date"))


def ab_tests_from_scored(scored: DataFrame) -> DataFrame:
    """The ``ab_tests`` table of the fixture: per contract, predicted = mean p, actual = mean churned."""
    return (scored.where(F.col("contract_type").isNotNull())
            .groupBy(F.col("contract_type").alias("campaign_name"))
            .agg(F.avg(P).alias("predicted_churn_rate"), F.avg(F.col("churned").cast("double")).alias("actual_churn_rate"),
                 F.count(F.lit(1)).alias("sample_size")))


def ab_outcomes(ab: DataFrame) -> DataFrame:
    """Each test with a win flag (actual below predicted) and the lift."""
    return ab.select(
        "campaign_name", F.round("predicted_churn_rate", 4).alias("predicted_churn_rate"),
        F.round("actual_churn_rate", 4).alias("actual_churn_rate"), "sample_size",
        (F.col("actual_churn_rate") < F.col("predicted_churn_rate")).alias("won"),
        F.round(F.col("predicted_churn_rate") - F.col("actual_churn_rate"), 4).alias("lift"))


def campaign_roi_sweep(scored: DataFrame, thresholds: list[float], discounts: list[float], successes: list[float],
                       rate: float = 1.0) -> DataFrame:
    """A17 over a parameter grid in one scan: a targeted count and revenue per threshold (conditional
    sums in one aggregation), then the discount × success grid expanded from literals on that single
    row — no join with the grid, so nothing is multiplied by the data."""
    p = F.nanvl(F.coalesce(F.col(P).cast("double"), F.lit(0.0)), F.lit(0.0))
    charge = charge_or_100(scored)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = p >= F.lit(float(t))
        aggs += [F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, charge)), F.lit(0.0)).alias(f"r{i}")]
    agg = scored.agg(*aggs)
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(dd)).alias("discount"),
                              F.lit(float(ss)).alias("success"), F.col(f"n{i}").alias("targeted"),
                              F.col(f"r{i}").alias("revenue"))
                     for i, t in enumerate(thresholds) for dd in discounts for ss in successes])
    g = agg.select(F.inline(grid))
    cost = F.col("revenue") * F.col("discount") * F.lit(float(rate))
    gross = F.col("revenue") * F.col("success") * F.lit(float(rate))
    roi = F.when(cost > 0, (gross - cost) / cost * 100).otherwise(F.lit(0.0))
    return g.select("threshold", "discount", "success", "targeted", F.round("revenue", 2).alias("revenue"),
                    F.round(cost, 4).alias("cost"), F.round(gross, 4).alias("gross"), F.round(gross - cost, 4).alias("net"),
                    F.round(roi, 2).alias("roi_pct"),
                    F.when(roi >= 20, "success").when(roi >= 0, "warning").otherwise("danger").alias("band"))
