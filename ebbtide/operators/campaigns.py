"""Campaign audience, personalised messages, send plan and the open/click funnel.

Delivery (SMTP, pacing, threads) is outside Spark; here the audience, rendered messages and the
send log are tables, and engagement is a fold of an event log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.indexing import dense_index
from ebbtide.functions.scalars import underscore_title
from ebbtide.session import broadcast_if_small

P = "predicted_probability"
MAX_TEMPLATES = 100_000  # message templates are configuration rows; broadcast only below this count
AUDIENCE_COLUMNS = ["customer_id", P, "prediction_label", "monthly_charges", "contract_type", "tenure_months",
                    "support_tickets", "payment_delays"]


def audience(scored: DataFrame, segment: str, cfg: RetentionConfig = DEFAULT_CONFIG) -> DataFrame:
    """``high_risk`` / ``low_risk`` / anything else = all active scored customers, p desc.

    Missing values take the mailer's defaults (``value or default``): 0, ``low_risk``, ``N/A``.
    """
    df = scored
    if segment == "high_risk":
        df = df.where(F.col("prediction_label") == F.lit(cfg.high_label))
    elif segment == "low_risk":
        df = df.where(F.col("prediction_label") == F.lit(cfg.low_label))

    def or_default(c: str, default):
        v = F.col(c)
        if isinstance(default, str):
            return F.when(v.isNull() | (v.cast("string") == ""), F.lit(default)).otherwise(v.cast("string"))
        z = F.lit(default)
        return F.when(v.isNull() | (v == 0), z).otherwise(v)

    return df.select(
        "customer_id",
        or_default(P, 0.0).alias(P),
        or_default("prediction_label", cfg.low_label).alias("prediction_label"),
        or_default("monthly_charges", 0.0).alias("monthly_charges"),
        or_default("contract_type", "N/A").alias("contract_type"),
        or_default("tenure_months", 0).alias("tenure_months"),
        or_default("support_tickets", 0).alias("support_tickets"),
        or_default("payment_delays", 0).alias("payment_delays"),
        F.concat(F.lower(F.col("customer_id")), F.lit("@example.com")).alias("email"),
    ).orderBy(F.col(P).desc(), "customer_id")


def audience_preview(aud: DataFrame, n: int = 20) -> DataFrame:
    """The first n recipients (the limit is the feature); the total is ``aud.count()`` apart."""
    return aud.orderBy(F.col(P).desc(), "customer_id").limit(n)


# Placeholder names of message templates and their fallbacks.
PLACEHOLDERS = ["customer_name", "company_name", "risk_label", "risk_score", "contract_type", "monthly_charges",
                "tenure_months", "support_tickets", "customer_id"]


def _placeholder_values(df: DataFrame, company: str) -> dict[str, Column]:
    def has(c):
        return c in df.columns
    label = F.col("prediction_label") if has("prediction_label") else F.lit("stable")
    p = F.coalesce(F.col(P), F.lit(0.0)) if has(P) else F.lit(0.0)
    return {
        "customer_name": F.col("customer_name").cast("string") if has("customer_name") else F.lit("Valued Customer"),
        "company_name": F.lit(company),
        "risk_label": underscore_title(label),
        # Python's round(): half to even
        "risk_score": F.format_string("%.1f%%", F.bround(p * 100, 1)),
        "contract_type": F.col("contract_type").cast("string") if has("contract_type") else F.lit("N/A"),
        "monthly_charges": F.format_string("$%.2f", F.col("monthly_charges").cast("double")) if has("monthly_charges")
        else F.lit("$0.00"),
        "tenure_months": F.col("tenure_months").cast("string") if has("tenure_months") else F.lit("N/A"),
        "support_tickets": F.col("support_tickets").cast("string") if has("support_tickets") else F.lit("0"),
        "customer_id": F.col("customer_id").cast("string") if has("customer_id") else F.lit(""),
    }


def render_text(template, values: dict[str, Column]) -> Column:
    """C3 for one template column: every ``{{name}}`` (any case) replaced by its value.

    Splitting on the placeholder and joining with the value inserts the value literally, so ``$``
    and ``\\`` in customer data are never read as regex back-references.
    """
    out = template
    for name in PLACEHOLDERS:
        pat = r"(?i)\{\{" + name + r"\}\}"
        out = F.call_function("array_join", F.split(out, F.lit(pat), -1), F.coalesce(values[name], F.lit("")))
    return out


def render(aud: DataFrame, subject: str, body: str, company: str = DEFAULT_CONFIG.company_name) -> DataFrame:
    """Personalised subject and body per recipient."""
    vals = _placeholder_values(aud, company)
    return aud.select("*", render_text(F.lit(subject), vals).alias("subject"),
                      render_text(F.lit(body), vals).alias("body"))


def strip_tags(c) -> Column:
    """Plain-text alternative — every ``<...>`` tag removed."""
    return F.regexp_replace(c, "<[^>]+>", "")


def send_plan(rendered: DataFrame, campaign_id: str, salt: str = "", batch_size: int = 10) -> DataFrame:
    """C4: one queued log row per recipient, a deterministic unique token and a batch number of
    ``batch_size`` in audience order (dense position, no global window). Message bodies are not moved."""
    idx = dense_index(rendered.select(P, "customer_id", "email", "subject"), [F.col(P).desc(), F.col("customer_id").asc()], "_pos")
    token = F.substring(F.sha2(F.concat_ws(":", F.lit(campaign_id), F.col("customer_id"), F.lit(salt)), 256), 1, 40)
    return idx.select(
        (F.col("_pos") + 1).alias("log_id"),
        F.lit(campaign_id).alias("campaign_id"),
        F.col("email").alias("recipient_email"), "customer_id", "subject",
        F.lit("queued").alias("status"), token.alias("tracking_token"),
        (F.col("_pos") / F.lit(batch_size)).cast("bigint").alias("batch"))


def engagement(events: DataFrame, keys: tuple[str, ...] = ("tracking_token",)) -> DataFrame:
    """Per tracking token, the state after its events in time order.

    ``events``: (event_id, tracking_token, kind ∈ {sent, open, click, bounce}, ts), one row per event id. An
    open counts only while the message is ``sent``: at or after the send, before the first click and the first
    bounce; the first such open is ``opened_at``. Every click counts. A bounce ends the message unless it was
    opened or clicked. Events without a token are kept as one row that is never opened.

    One aggregation gives each token's times; the opens are then joined with their token's times, so that a
    token with very many opens is combined map-side and can be split as a skewed join.
    """
    k, ts = F.col("kind"), F.col("ts")
    keys = list(keys)
    agg = events.groupBy(*keys).agg(
        F.max(k == "sent").alias("sent"),
        F.max(k == "bounce").alias("bounced"),
        F.min(F.when(k == "sent", ts)).alias("sent_at"),
        F.min(F.when(k.isin("click", "bounce"), ts)).alias("until"),
        F.max(F.when(k == "click", ts)).alias("clicked_at"),
        F.count_if(k == "click").alias("clicks"),
        F.min("ts").alias("first_ts"))
    live = agg.where("sent").select(*keys, "sent_at", "until")
    opens = (events.where(k == "open").select(*keys, "ts").join(live, keys)
             .where((ts >= F.col("sent_at")) & (F.col("until").isNull() | (ts < F.col("until"))))
             .groupBy(*keys).agg(F.min("ts").alias("opened_at")))
    state = agg.join(opens, keys, "left")
    opened = F.col("opened_at").isNotNull()
    status = (F.when(F.col("clicks") > 0, "clicked").when(opened, "opened").when(F.col("bounced"), "failed")
              .when(F.col("sent"), "sent").otherwise("queued"))
    return state.select(*keys, "sent", "bounced", opened.alias("opened"), "opened_at", "clicks", "clicked_at",
                        status.alias("status"), "first_ts")


def weekly_campaign(ts: Column) -> Column:
    """Campaign key of the fixture log: the week (Monday) of a token's first event."""
    return F.concat(F.lit("cmp_"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"))


def funnel(state: DataFrame, campaign_of: Column | None = None) -> DataFrame:
    """Sent, bounced, opened, clicked (recipients and total clicks) per campaign — derived."""
    camp = campaign_of if campaign_of is not None else F.lit("all")
    return (state.groupBy(camp.alias("campaign_id"))
            .agg(F.count_if("sent").alias("sent_count"), F.count_if("bounced").alias("bounced_count"),
                 F.count_if("opened").alias("opened_count"), F.count_if(F.col("clicks") > 0).alias("clicked_recipients"),
                 F.sum("clicks").alias("clicked_count")))


def campaign_detail(campaigns: DataFrame, templates: DataFrame, logs: DataFrame) -> DataFrame:
    """Campaigns with their template and log-derived counters, newest first."""
    counts = logs.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_recipients"),
        F.count_if(F.col("status").isin("sent", "opened", "clicked")).alias("sent_count"),
        F.count_if(F.col("status") == "failed").alias("bounced_count"),
        F.count_if(F.col("status").isin("opened", "clicked")).alias("opened_count"),
        F.count_if(F.col("status") == "clicked").alias("clicked_count"))
    t = templates.select("template_id", F.col("name").alias("template_name"), F.col("subject").alias("template_subject"))
    t = broadcast_if_small(t, MAX_TEMPLATES)
    return (campaigns.join(t, "template_id", "left").join(counts, "campaign_id", "left")
            .orderBy(F.desc("created_at"), "campaign_id"))
