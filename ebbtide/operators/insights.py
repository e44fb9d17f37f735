"""Role recommendations and narrative facts, computed set-wise.

The reference builds these from prediction rows in Python; here each number is an aggregation and
only the final one-row facts are formatted into text with ``format_string``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.indexing import top_k_per_group
from ebbtide.functions.scalars import parse_float_text
from ebbtide.operators import aggregates as A

P = "predicted_probability"
SKIP = {"predicted_probability", "prediction_label", "created_at", "churned"}


def _text_or_empty(df: DataFrame, c: str) -> Column:
    """``str(value or "")``: NULL, 0, 0.0, false and "" become empty."""
    v = F.col(c)
    s = v.cast("string")
    falsy = v.isNull() | (s == "")
    dt = df.schema[c].dataType.simpleString()
    if dt in ("bigint", "int", "double", "float", "smallint", "tinyint") or dt.startswith("decimal"):
        falsy = falsy | (v.cast("double") == 0)
    if dt == "boolean":
        falsy = falsy | ~v
    return F.when(falsy, F.lit("")).otherwise(s)


MIN_VALUES = 20  # so many distinct values are few in any column
NEAR = 0.2  # a sketched count this close to the limit (ten times the sketch's error) is counted exactly


def categorical_profile(rows: DataFrame, max_cols: int | None = None, sample: int | None = None, order: list | None = None) -> DataFrame:
    """Categorical columns — non-empty, few distinct values (≤ max(20, n/3)) and under 60 % of the non-empty values
    integer-like; as (ordinal, column_name) rows, the first ``max_cols`` of them.

    One aggregation over all rows counts every column, distinct values by a mergeable sketch; only columns whose sketch
    is near the limit are counted exactly, by one distinct of their (column, value) pairs. ``sample`` looks at the first
    rows only (in ``order``).
    """
    if sample is not None:
        rows = rows.orderBy(*(order or [])).limit(sample)
    cands = [c for c in rows.columns if c.lower() not in SKIP]
    texts = rows.select(*[_text_or_empty(rows, c).alias(c) for c in cands])
    value = {c: F.when(~F.col(c).isin("", "nan", "None"), F.col(c)) for c in cands}
    aggs = []
    for i, c in enumerate(cands):
        intlike = parse_float_text(value[c]).isNotNull() & ~F.regexp_replace(value[c], "-", "").contains(".")
        aggs += [F.count(value[c]).alias(f"n{i}"), F.approx_count_distinct(value[c], 0.02).alias(f"d{i}"), F.count_if(intlike).alias(f"k{i}")]
    agg = texts.agg(*aggs).first()
    limit = {c: max(MIN_VALUES, agg[f"n{i}"] // 3) for i, c in enumerate(cands)}
    distinct = {c: agg[f"d{i}"] for i, c in enumerate(cands)}
    near = [c for c in cands if abs(distinct[c] - limit[c]) <= NEAR * limit[c]]
    if near:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), value[c].alias("v")) for c in near])
        exact = texts.select(F.inline(cells)).where("v is not null").distinct().groupBy("c").count().collect()  # a row per column
        distinct |= dict.fromkeys(near, 0) | {r["c"]: r["count"] for r in exact}
    kept = [(i + 1, c) for i, c in enumerate(cands) if agg[f"n{i}"] > 0 and distinct[c] <= limit[c] and agg[f"k{i}"] < 0.6 * agg[f"n{i}"]]
    return rows.sparkSession.createDataFrame(kept[:max_cols], "ordinal int, column_name string")


def categorical_columns(rows: DataFrame, max_cols: int | None = None) -> list[str]:
    """The names of A22, in column order."""
    return [r["column_name"] for r in categorical_profile(rows, max_cols).orderBy("ordinal").collect()]


def risk_attributes(rows: DataFrame, columns: list[str], cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """For each categorical column, value counts among high-risk rows (blank → ``unknown``),
    ranked by count, ties by first appearance in probability order; top 3 per column."""
    hi = rows.where(F.col("prediction_label") == F.lit(cfg.high_label))
    if not columns:
        return rows.sparkSession.createDataFrame([], "column_name string, value string, customers long, rank int")
    vals = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.coalesce(F.nullif(F.trim(_text_or_empty(rows, c)), F.lit("")), F.lit("unknown")).alias("value"))
                     for c in columns])
    first = F.struct((-F.col(P)).alias("np"), F.col("customer_id").alias("id"))
    exploded = hi.select(first.alias("_first"), F.inline(vals))
    counts = exploded.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("customers"), F.min("_first").alias("_first"))
    # top 3 per column by a two-level top-k: one scan, no task holding a column's whole vocabulary
    top = top_k_per_group(counts, ["column_name"], [F.desc("customers"), F.col("_first")], 3)
    return top.select("column_name", "value", "customers", F.col("rank").cast("int").alias("rank"))


def _pct0(x: Column) -> Column:
    """Python ``f"{x:.0%}"``."""
    return F.format_string("%d%%", F.bround(x * 100, 0).cast("bigint"))


def insight_facts(rows: DataFrame, cat_columns: list[str], cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Headline, narrative and the highest-risk / most stable records, as one row."""
    p = F.coalesce(F.nanvl(F.col(P).cast("double"), F.lit(0.0)), F.lit(0.0))
    hi, lo = F.col("prediction_label") == cfg.high_label, F.col("prediction_label") == cfg.low_label
    facts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hi).alias("high_risk"), F.count_if(lo).alias("low_risk"),
        F.avg(p).alias("_avg"),
        F.min(F.when(hi, F.struct((-p).alias("k"), F.col("customer_id").alias("id"), p.alias("p")))).alias("_top"),
        F.min(F.when(lo, F.struct(p.alias("k"), F.col("customer_id").alias("id"), p.alias("p")))).alias("_safe"))
    # the top value per categorical column: at most ``len(cat_columns)`` (≤ 4) rows reach the driver
    top_rows = (risk_attributes(rows, cat_columns, cfg).where(F.col("rank") == 1).collect() if cat_columns else [])
    order = {c: i for i, c in enumerate(cat_columns)}
    top_rows = sorted(top_rows, key=lambda r: order[r["column_name"]])
    attrs = F.array(*[F.struct(F.lit(r["column_name"]).alias("column_name"), F.lit(r["value"]).alias("value"))
                      for r in top_rows]) if top_rows else F.array().cast("array<struct<column_name:string,value:string>>")
    j = facts.withColumn("_attrs", attrs)
    total = F.col("total")

    def pct(n):
        return F.format_string("%d%%", F.bround(F.lit(100.0) * n / total, 0).cast("bigint"))

    parts = F.transform(F.slice(F.coalesce(F.col("_attrs"), F.array()), 1, 2),
                        lambda a: F.format_string("'%s' in %s", a["value"], F.regexp_replace(a["column_name"], "_", " ")))
    assoc = F.concat(F.lit("The highest-risk records are most associated with "), F.array_join(parts, " and "),
                     F.lit(". These patterns together drive the elevated churn likelihood observed in this dataset."))
    tail = (F.when((F.col("high_risk") > 0) & (F.size(F.coalesce(F.col("_attrs"), F.array())) > 0), assoc)
            .when(F.col("high_risk") > 0, F.lit("A portion of records shows elevated churn likelihood worth prioritizing for retention."))
            .otherwise(F.lit("No records currently meet the high-risk threshold, indicating a stable retention profile.")))
    narrative = F.concat(
        F.format_string("Across %d analyzed records, the model estimates an overall churn probability of %s. ",
                        total, _pct0(F.col("_avg"))),
        F.format_string("%d records (%s) are flagged as high risk and %d (%s) as lower risk. ",
                        F.col("high_risk"), pct(F.col("high_risk")), F.col("low_risk"), pct(F.col("low_risk"))),
        tail)
    return j.select(
        F.format_string("%d of %d records need retention attention", F.col("high_risk"), total).alias("headline"),
        narrative.alias("narrative"), "total", "high_risk", "low_risk",
        F.round("_avg", 3).alias("avg_probability"),
        F.col("_top.id").alias("top_record"),
        F.when(F.col("_top").isNotNull(), F.format_string(
            "%s carries a %s churn probability. Review its attributes to understand the dominant risk drivers in this dataset.",
            F.col("_top.id"), _pct0(F.col("_top.p")))).alias("top_detail"),
        F.col("_safe.id").alias("stable_record"),
        F.when(F.col("_safe").isNotNull(), F.format_string(
            "%s shows only a %s churn probability, reflecting a healthy profile ideal for loyalty expansion.",
            F.col("_safe.id"), _pct0(F.col("_safe.p")))).alias("stable_detail"))


def insight_segments(rows: DataFrame, cat_columns: list[str], cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """A24's segments as (position, title, detail): the highest-risk and the most stable record, where there is one, then
    for each of the first two ``cat_columns`` the three values most frequent among high-risk rows (none without such rows)."""
    facts = insight_facts(rows, [], cfg)
    records = facts.select(F.inline(F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Highest-risk record").alias("title"), F.col("top_detail").alias("detail")),
        F.struct(F.lit(2).alias("position"), F.lit("Most stable record").alias("title"), F.col("stable_detail").alias("detail")))))
    first = cat_columns[:2]
    if not first:
        return records.where("detail is not null")
    position = F.array_position(F.array(*[F.lit(c) for c in first]), F.col("column_name")).cast("int") + 2
    label = F.regexp_replace("column_name", "_", " ")
    top = F.struct("rank", F.format_string("%s (%d)", F.col("value"), F.col("customers")).alias("text"))
    values = F.transform(F.array_sort(F.collect_list(top)), lambda t: t["text"])  # at most three a column
    by_column = risk_attributes(rows, first, cfg).groupBy("column_name").agg(values.alias("values")).select(
        position.alias("position"), F.concat(F.lit("Risk by "), label).alias("title"),
        F.concat(F.lit("High risk is most associated with "), F.array_join("values", ", "),
                 F.lit(". Prioritize targeted retention for these "), label, F.lit(" segments.")).alias("detail"))
    return records.where("detail is not null").unionByName(by_column)


def context_summary(scored: DataFrame, sources: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> dict[str, DataFrame]:
    """Totals, label breakdown (A1), top 15 (K2) and upload history (R5) as four small frames."""
    from ebbtide.operators import registry as R
    from ebbtide.operators import topk as K
    return {"totals": scored.agg(F.count(F.lit(1)).alias("total_records"),
                                 F.count_if(F.col("prediction_label") == cfg.high_label).alias("high_risk")),
            "breakdown": A.risk_summary(scored), "top": K.top_risk(scored, 15), "history": R.list_sources(sources, cfg)}


# Role recommendation texts, by role, in output order. Each entry: (condition, template);
# the placeholders are filled from the facts row (high/low counts, average probability %, signal counts).
ROLE_RULES = {
    "sales": [
        ("always", "Initiate contract renewal negotiations immediately for the {high_count} high-risk accounts to protect ARR. Target month-to-month contracts by offering a 10% discount on a 12-month commitment transition."),
        ("payment_delayed", "Audit the billing and transaction history for {payment_delayed} payment-delay customers before sales outreach. Propose a migration to automated credit card auto-pay to eliminate payment barriers."),
        ("low_count", "Offer proactive loyalty expansions or multi-year contract renewals to secure the {low_count} low-risk accounts. Suggest premium features based on their high usage to expand account value."),
        ("always", "Prioritize upsell and relationship-building tasks with accounts exhibiting average prediction confidence of {avg_prob}%. Schedule structured QBRs to showcase business value."),
    ],
    "support": [
        ("ticket_heavy", "Create high-priority support tickets to resolve issues for {ticket_heavy} customers with 3+ pending tickets. Assign a senior support engineer to close these tickets within a strict 24-hour SLA."),
        ("complaint_heavy", "Escalate and resolve cases for the {complaint_heavy} customers with 3+ formal complaints. Conduct phone outreach from support management to restore trust."),
        ("low_satisfaction", "Initiate technical support outreach for {low_satisfaction} users with low satisfaction scores (<= 2.0). Schedule a 15-minute diagnostic call to isolate product gaps."),
        ("none_above", "All customer support tickets are currently resolved and within standard SLAs."),
    ],
    "executive": [
        ("always", "Acknowledge potential ARR risk from the {high_count} high-risk customer segments (average probability: {avg_prob}%). Prepare board reports detailing potential revenue impact and cash-retention actions."),
        ("low_satisfaction", "Investigate systemic service gaps affecting the {low_satisfaction} low-satisfaction accounts. Direct Product & Engineering heads to address core performance bottlenecks."),
        ("payment_delayed", "Authorize a billing flow review to reduce friction for the {payment_delayed} accounts with payment delays. Standardize digital auto-billing options to lower involuntary churn."),
        ("low_count", "Approve capital allocation for customer advocacy and engagement programs securing {low_count} low-risk accounts. Incentivize customer reviews (G2, Capterra) to drive organic referrals."),
    ],
    "manager": [
        ("always", "Prioritize intervention for {high_count} high-risk records (average probability: {avg_prob}%). Set daily task checklists for CSMs to check on these accounts."),
        ("ticket_heavy", "Address {ticket_heavy} high-risk customers who have submitted 3 or more support tickets. Run product training webinars to guide users through complex configurations."),
        ("complaint_heavy", "Resolve issues for {complaint_heavy} high-risk accounts with 3 or more complaint cases. Standardize refund/credit compensation rules for account recovery."),
        ("low_satisfaction", "Initiate check-ins for {low_satisfaction} high-risk users who reported low satisfaction scores (<= 2.0). Implement a CSAT recovery email sequence."),
        ("payment_delayed", "Review accounts for {payment_delayed} high-risk customers showing billing or payment delay indicators. Verify billing contact accuracy."),
        ("low_count", "Protect {low_count} lower-risk records with loyalty offers and regular engagement. Schedule monthly email updates highlighting new product releases."),
    ],
}
NO_ACTIVITY = "No churn activity detected yet; upload more customer data to generate insights."
FACT_FIELDS = ["high_count", "low_count", "avg_prob", "ticket_heavy", "complaint_heavy", "low_satisfaction", "payment_delayed"]


def role_facts(all_scored: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """The one-row facts behind A7 in one aggregation: A2 counts and rounded mean of the high-risk
    label, plus the A6 signal counts (all predictions, no active filter)."""
    hi = F.col("prediction_label") == cfg.high_label

    def cnt(col: str, op: str, v: float) -> Column:
        if col not in all_scored.columns:
            return F.lit(0).cast("bigint")
        return F.count_if(hi & A.cmp_true(A.num0(all_scored, col), op, v))

    agg = all_scored.agg(
        F.count_if(hi).alias("high_count"),
        F.count_if(F.col("prediction_label") == cfg.low_label).alias("low_count"),
        F.round(F.avg(F.when(hi, F.col(P))), 3).alias("_hi_avg"),
        cnt("support_tickets", ">=", 3).alias("ticket_heavy"), cnt("complaint_count", ">=", 3).alias("complaint_heavy"),
        cnt("customer_satisfaction_score", "<=", 2).alias("low_satisfaction"),
        cnt("payment_delays", ">=", 1).alias("payment_delayed"))
    # Python's round(): half to even
    return agg.withColumn("avg_prob", F.bround(F.col("_hi_avg") * 100, 1)).drop("_hi_avg")


def role_recommendations(facts: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Ordered recommendation texts per role from the rule table, as (role, ordinal, text)."""
    roles = roles or list(ROLE_RULES)
    out = []
    for role in roles:
        texts, conds = [], []
        for cond, tmpl in ROLE_RULES[role]:
            fmt = tmpl.replace("%", "%%")
            args = []
            for f in FACT_FIELDS:
                token = "{" + f + "}"
                while token in fmt:
                    idx = fmt.index(token)
                    fmt = fmt[:idx] + "%s" + fmt[idx + len(token):]
                    args.append((idx, f))
            args = [f for _, f in sorted(args)]
            text = F.format_string(fmt, *[F.col(a).cast("string") for a in args]) if args else F.lit(fmt.replace("%%", "%"))
            if cond == "always":
                c = F.lit(True)
            elif cond == "none_above":
                c = ~F.array_contains(F.array(*conds), True) if conds else F.lit(True)
            else:
                c = F.col(cond) > 0
            conds.append(c)
            texts.append(F.when(c, text))
        recs = F.when(F.col("high_count") > 0, F.filter(F.array(*texts), lambda x: x.isNotNull())) \
            .otherwise(F.array(F.lit(NO_ACTIVITY)))
        out.append(F.struct(F.lit(role).alias("role"), recs.alias("recs")))
    return (facts.select(F.inline(F.array(*out)))
            .select("role", F.posexplode("recs").alias("ordinal", "text")))
