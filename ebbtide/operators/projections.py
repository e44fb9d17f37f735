"""Projections, filters and scans over text."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.scalars import risk_band, risk_label

P = "predicted_probability"
PREDICTION_EXTRAS = ("region", "contract_type", "tenure_months", "churned", "support_tickets", "payment_delays",
                     "product_usage", "complaint_count", "customer_satisfaction_score")
INTERNAL_COLUMNS = {"predicted_probability", "prediction_label", "created_at", "churned"}


def predictions_list(scored: DataFrame) -> DataFrame:
    """Core prediction columns, band, drivers (JSON text) and the extras present; probability desc."""
    extras = [c for c in PREDICTION_EXTRAS if c in scored.columns]
    drivers = F.to_json("risk_drivers") if "risk_drivers" in scored.columns else F.lit("[]")
    return (scored.select("customer_id", P, "prediction_label", drivers.alias("risk_drivers"), "ci_lower", "ci_upper",
                          *extras)
            .orderBy(F.col(P).desc(), "customer_id"))


def filter_predictions(scored: DataFrame, label: str = "all", term: str = "") -> DataFrame:
    """Label filter and case-insensitive id containment."""
    out = scored if label == "all" else scored.where(F.col("prediction_label") == F.lit(label))
    t = (term or "").strip().lower()
    if t:
        out = out.where(F.lower(F.col("customer_id").cast("string")).contains(F.lit(t)))
    return out


def visible_columns(rows: DataFrame, limit: int | None = None, sample: int | None = None, order_by: list | None = None) -> DataFrame:
    """Columns that are non-empty in any row, minus the id and internal columns, as (ordinal, column_name) rows.

    One aggregation reads all rows. ``limit`` keeps the first columns, as a view with room for so many does; ``sample``
    looks at the first rows only (in ``order_by`` order).
    """
    candidates = [c for c in rows.columns if c != "customer_id" and c not in INTERNAL_COLUMNS]
    if sample is not None:
        rows = rows.orderBy(*(order_by or [])).limit(sample)
    nonempty = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != F.lit(""))).alias(f"n{i}")
                for i, c in enumerate(candidates)]
    agg = rows.agg(*nonempty)
    items = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"))
                      for i, c in enumerate(candidates)])
    kept = F.filter(items, lambda x: x["n"] > 0)
    return agg.select(F.inline(kept if limit is None else F.slice(kept, 1, limit))).select("ordinal", "column_name")


# Request-payload patterns (matched on lower-cased text; SQL patterns win).
SQLI_PATTERNS = [
    r"union\s+select",
    r"or\s+\d+\s*=\s*\d+",
    r"select\s+.*\s+from",
    r"drop\s+table",
    r"insert\s+into",
    r"delete\s+from",
    r"update\s+.*\s+set",
    r"'\s*or\s*'",
    r"\"\s*or\s*\"",
]
XSS_PATTERNS = [
    r"<script",
    r"javascript:",
    r"onload\s*=",
    r"onerror\s*=",
    r"alert\(",
    r"document\.cookie",
]
SQLI_REASON = "SQL Injection Attempt Blocked"
XSS_REASON = "Cross-Site Scripting Attempt Blocked"


# Literal substrings each pattern needs (a cheap `contains` test that rules a row out before any regex
# runs; it never changes the answer, since a match implies every listed literal is present).
_NEEDS = {
    r"union\s+select": ["union", "select"],
    r"or\s+\d+\s*=\s*\d+": ["or", "="],
    r"select\s+.*\s+from": ["select", "from"],
    r"drop\s+table": ["drop", "table"],
    r"insert\s+into": ["insert", "into"],
    r"delete\s+from": ["delete", "from"],
    r"update\s+.*\s+set": ["update", "set"],
    r"'\s*or\s*'": ["'", "or"],
    r"\"\s*or\s*\"": ['"', "or"],
    r"<script": ["<script"],
    r"javascript:": ["javascript:"],
    r"onload\s*=": ["onload", "="],
    r"onerror\s*=": ["onerror", "="],
    r"alert\(": ["alert("],
    r"document\.cookie": ["document.cookie"],
}


def _hit(low, pattern: str):
    guard = None
    for lit in _NEEDS.get(pattern, []):
        g = low.contains(F.lit(lit))
        guard = g if guard is None else guard & g
    m = low.rlike(pattern)
    return m if guard is None else (guard & m)


def payload_reason(text, lowered: bool = False) -> F.Column:
    """The block reason for one text value, or NULL (``lowered``: the text is already lower-cased)."""
    low = text if lowered else F.lower(text)
    sqli = None
    for p in SQLI_PATTERNS:
        sqli = _hit(low, p) if sqli is None else (sqli | _hit(low, p))
    xss = None
    for p in XSS_PATTERNS:
        xss = _hit(low, p) if xss is None else (xss | _hit(low, p))
    return F.when(sqli, F.lit(SQLI_REASON)).when(xss, F.lit(XSS_REASON))


def payload_scan(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Flag rows where any of ``cols`` matches; the first column (in order) that matches decides."""
    # lower-case each text once; the guarded pattern tests below are conditional branches, which
    # Spark's common-subexpression elimination would not share
    low = df.select(key, *[F.lower(F.col(c)).alias(f"_low{i}") for i, c in enumerate(cols)])
    reasons = [payload_reason(F.col(f"_low{i}"), lowered=True) for i in range(len(cols))]
    reason = F.coalesce(*reasons) if len(reasons) > 1 else reasons[0]
    # emit matches through a generator (a 0- or 1-element array): a plain `where(reason IS NOT NULL)`
    # would be pushed below the projection and evaluate every pattern twice per row
    hit = F.filter(F.array(F.struct(F.col(key).alias("k"), reason.alias("reason"))), lambda x: x["reason"].isNotNull())
    return low.select(F.inline(hit)).withColumnRenamed("k", key)


def label_risk(df: DataFrame, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """P6."""
    return df.withColumn("prediction_label", risk_label(F.col(P), cfg))


def watch_band(df: DataFrame) -> DataFrame:
    """P7."""
    return df.withColumn("risk_band", risk_band(F.col(P)))
