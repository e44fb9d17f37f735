"""Scalar column rules: numeric coercion, target encoders, title case, risk label and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ebbtide.config import (DEFAULT_CONFIG, RetentionConfig, TARGET_VOCABULARY,
                            TRUTHY_ACTIVE_VALUES, TRUTHY_TARGET_VALUES)

# Text a Python-style float parser accepts: sign, digits with single underscores between
# them, optional fraction and exponent, or inf / infinity / nan. Spark's own cast also accepts
# forms such as "2d" or "3f", which must not count as numbers here.
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_TEXT = (rf"^\s*[+-]?(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?"
              r"|(?i:inf|infinity|nan))\s*$")


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def parse_float_text(c: Column) -> Column:
    """Python ``float(text)`` semantics for a string column: NULL when it would raise."""
    cleaned = F.regexp_replace(F.trim(c), "_", "")
    low = F.lower(cleaned)
    special = (F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
               .when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
               .when(low.isin("nan", "+nan", "-nan"), F.lit(float("nan"))))
    return F.when(c.rlike(FLOAT_TEXT), F.coalesce(special, cleaned.try_cast("double")))


def safe_num(df: DataFrame, name: str | None, default: float) -> Column:
    """Numeric value of a column with a default for missing, blank, NaN or unparsable values.

    A missing column gives the default. For a numeric column NULL and NaN give the default; for a
    text column NULL, blank and unparsable text give the default while the text ``nan`` stays NaN.
    """
    d = F.lit(float(default))
    if name is None or name not in df.columns:
        return d
    c = F.col(name)
    dt = _dtype(df, name)
    if isinstance(dt, NumericType):
        v = c.cast("double")
        return F.coalesce(F.nanvl(v, d), d)
    if isinstance(dt, StringType):
        return F.coalesce(parse_float_text(c), d)
    # booleans and anything else: go through text
    return F.coalesce(parse_float_text(c.cast("string")), d)


def first_present(df: DataFrame, *names: str) -> str | None:
    for n in names:
        if n in df.columns:
            return n
    return None


def heuristic_score(df: DataFrame) -> Column:
    """Additive rule score; terms are added in a fixed order with DOUBLE arithmetic."""
    tickets = safe_num(df, first_present(df, "support_tickets", "support_calls"), 0.0)
    complaints = safe_num(df, first_present(df, "complaint_count", "complaints"), 0.0)
    delays = safe_num(df, first_present(df, "payment_delays", "late_payments"), 0.0)
    csat = safe_num(df, first_present(df, "customer_satisfaction_score", "satisfaction"), 5.0)
    tenure = safe_num(df, first_present(df, "tenure_months", "tenure"), 0.0)
    usage = safe_num(df, first_present(df, "product_usage", "usage"), 0.0)
    contract_col = first_present(df, "contract_type", "contract")
    contract = F.lower(F.coalesce(F.col(contract_col).cast("string"), F.lit(""))) if contract_col else F.lit("")

    contract_term = (F.when(contract.isin("month-to-month", "month to month", "monthly", "m2m"), F.lit(0.2))
                     .when(contract.isin("one year", "1 year", "annual", "yearly"), F.lit(0.05))
                     .when(contract.isin("two year", "2 year", "two-year", "2-year"), F.lit(-0.05))
                     .otherwise(F.lit(0.0)))
    score = F.lit(0.0) + contract_term
    score = score + F.least(F.lit(0.25), tickets * F.lit(0.04))
    score = score + F.least(F.lit(0.25), complaints * F.lit(0.08))
    score = score + F.least(F.lit(0.25), delays * F.lit(0.12))
    # Python's max(0, nan) is 0 while Spark's greatest(0, NaN) is NaN.
    score = score + F.nanvl(F.greatest(F.lit(0.0), (F.lit(5.0) - csat) * F.lit(0.08)), F.lit(0.0))
    score = score + F.when(tenure < 12, F.lit(0.12)).when(tenure < 24, F.lit(0.06)).otherwise(F.lit(0.0))
    score = score + F.when(usage < 20, F.lit(0.1)).otherwise(F.lit(0.0))
    return score


def heuristic_target(df: DataFrame) -> Column:
    """I15 label: 1 when the rule score reaches 0.55."""
    return F.when(heuristic_score(df) >= F.lit(0.55), F.lit(1)).otherwise(F.lit(0))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def risk_label(p: Column, cfg: RetentionConfig = DEFAULT_CONFIG) -> Column:
    """``p >= threshold`` is high risk. NaN is never high (Spark orders NaN above all numbers)."""
    return (F.when(~F.isnan(p) & (p >= F.lit(float(cfg.risk_threshold))), F.lit(cfg.high_label))
            .otherwise(F.lit(cfg.low_label)))


def risk_band(p: Column) -> Column:
    """Documented watch bands on the probability in percent."""
    pct = p * F.lit(100.0)
    return (F.when(pct >= 65, F.lit("high")).when(pct >= 35, F.lit("watch")).otherwise(F.lit("healthy")))


def fixed_band(p: Column, width: float = 0.08) -> tuple[Column, Column]:
    """M13 fallback band: p ± width, clipped to [0, 1]."""
    return clip01(p - F.lit(width)), clip01(p + F.lit(width))


def encode_target(c: Column) -> Column:
    """Vocabulary lookup on lower(trim(text)), else the number truncated to a whole one (bigint; beyond its
    range the nearest one), else 0."""
    key = F.lower(F.trim(c.cast("string")))
    vocab = F.create_map(*[x for k, v in TARGET_VOCABULARY.items() for x in (F.lit(k), F.lit(v))])
    numeric = parse_float_text(c.cast("string"))
    edge = F.lit(float(2 ** 63))
    whole = (F.when(F.isnan(numeric), None).when(numeric >= edge, F.lit(2 ** 63 - 1)).when(numeric <= -edge, F.lit(-2 ** 63))
             .otherwise(numeric.cast("bigint")))
    return F.coalesce(F.try_element_at(vocab, key).cast("bigint"), whole, F.lit(0).cast("bigint"))


def binarise_target(c: Column) -> Column:
    """Upload-time target: truthy text is 1, everything else (NULL included) is 0."""
    key = F.lower(F.trim(c.cast("string")))
    return F.when(key.isin(*TRUTHY_TARGET_VALUES), F.lit(1)).otherwise(F.lit(0))


def binarise_active(c: Column) -> Column:
    """An "active" flag becomes a churn target: active text is 0, everything else (NULL too) 1."""
    key = F.lower(F.trim(c.cast("string")))
    return F.when(key.isin(*TRUTHY_ACTIVE_VALUES), F.lit(0)).otherwise(F.lit(1))


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper-case a letter after any non-letter, lower-case the rest.

    Spark's ``initcap`` only capitalises after spaces ("Month-to-month"); here every word boundary
    counts ("Month-To-Month").
    """
    low = F.lower(c)
    # Split into runs of letters and non-letters, capitalise each letter run.
    parts = F.regexp_extract_all(low, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))), "")


def underscore_title(c: Column) -> Column:
    """``value.replace('_', ' ').title()`` used for display names."""
    return title_case(F.regexp_replace(c, "_", " "))


# ------------------------------------------------------------------ wall-clock time <-> instant

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(c: Column) -> Column:
    """A TIMESTAMP_NTZ (wall clock) read as a UTC instant, whatever the session time zone.

    Watermarks and event-time windows need TIMESTAMP; a plain cast would go through the session zone
    (shifting wall-clock times inside a DST gap and aligning windows to that zone). Interval arithmetic
    on NTZ values never consults a zone.
    """
    iv = c - F.expr(_EPOCH_NTZ)
    micros = (F.extract(F.lit("DAY"), iv).cast("bigint") * F.lit(86_400_000_000)
              + F.extract(F.lit("HOUR"), iv).cast("bigint") * F.lit(3_600_000_000)
              + F.extract(F.lit("MINUTE"), iv).cast("bigint") * F.lit(60_000_000)
              + (F.extract(F.lit("SECOND"), iv) * F.lit(1_000_000)).cast("bigint"))
    return F.timestamp_micros(micros)


def instant_to_ntz(c: Column) -> Column:
    """Inverse of :func:`ntz_to_instant`."""
    secs = F.unix_micros(c).cast("decimal(18,0)") / F.lit(1_000_000)
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
