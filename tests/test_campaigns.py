import datetime as dt

from pyspark.sql import functions as F

from ebbtide.operators import campaigns as C


def test_render_literal_dollar_and_backslash(spark):
    aud = spark.createDataFrame([("C1", 0.756, "high_risk", 49.5, "Mo$nthly\\1", 12, 3)],
                                "customer_id string, predicted_probability double, prediction_label string, "
                                "monthly_charges double, contract_type string, tenure_months long, support_tickets long")
    r = C.render(aud, "{{RISK_LABEL}} for {{customer_name}}", "{{contract_type}} {{monthly_charges}} {{Risk_Score}} {{x}}",
                 company="Acme").first()
    assert r.subject == "High Risk for Valued Customer"
    assert r.body == "Mo$nthly\\1 $49.50 75.6% {{x}}"


def test_strip_tags(spark):
    df = spark.createDataFrame([("<p>Hi <b>there</b></p>\n<br/>x",)], "h string")
    assert df.select(C.strip_tags(F.col("h")).alias("t")).first().t == "Hi there\nx"


def test_engagement_fold_order_independent(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(1, "a", "sent", t), (2, "a", "click", t + dt.timedelta(minutes=1)), (3, "a", "open", t + dt.timedelta(minutes=2)),
          (4, "b", "sent", t), (5, "b", "open", t + dt.timedelta(minutes=1)), (6, "b", "open", t + dt.timedelta(minutes=3)),
          (7, "b", "click", t + dt.timedelta(minutes=4)), (8, "b", "click", t + dt.timedelta(minutes=5)),
          (9, "c", "open", t), (10, "d", "bounce", t)]
    df = spark.createDataFrame(ev, "event_id long, tracking_token string, kind string, ts timestamp_ntz")
    st = {r.tracking_token: r for r in C.engagement(df).collect()}
    assert st["a"].opened is False and st["a"].clicks == 1 and st["a"].status == "clicked"   # click before open
    assert st["b"].opened is True and st["b"].opened_at == t + dt.timedelta(minutes=1)
    assert st["b"].clicks == 2 and st["b"].clicked_at == t + dt.timedelta(minutes=5)
    assert st["c"].opened is False and st["c"].status == "queued"                            # never sent
    assert st["d"].status == "failed"
    f = C.funnel(C.engagement(df)).first()
    assert (f.sent_count, f.opened_count, f.clicked_recipients, f.clicked_count, f.bounced_count) == (2, 1, 2, 3, 1)


def test_opens_count_only_while_sent(spark):
    t = dt.datetime(2024, 1, 1)

    def at(m):
        return t + dt.timedelta(minutes=m)
    ev = [(1, "early", "open", at(0)), (2, "early", "sent", at(1)),
          (3, "again", "open", at(0)), (4, "again", "sent", at(1)), (5, "again", "open", at(2)), (6, "again", "open", at(3)),
          (7, "bounced", "sent", at(0)), (8, "bounced", "bounce", at(1)), (9, "bounced", "open", at(2)),
          (10, "later", "sent", at(0)), (11, "later", "open", at(1)), (12, "later", "bounce", at(2)),
          (13, "tie", "sent", at(0)), (14, "tie", "open", at(0)),
          (15, None, "sent", at(0)), (16, None, "open", at(1))]
    df = spark.createDataFrame(ev, "event_id long, tracking_token string, kind string, ts timestamp_ntz")
    st = {r.tracking_token: (r.opened, r.opened_at, r.status) for r in C.engagement(df).collect()}
    assert st == {"early": (False, None, "sent"), "again": (True, at(2), "opened"), "bounced": (False, None, "failed"),
                  "later": (True, at(1), "opened"), "tie": (True, at(0), "opened"), None: (False, None, "sent")}


def test_send_plan_batches_and_tokens(spark):
    rows = [(f"C{i:03d}", 1.0 - i / 100.0, f"c{i}@example.com", "s") for i in range(25)]
    df = spark.createDataFrame(rows, "customer_id string, predicted_probability double, email string, subject string")
    plan = C.send_plan(df, "cmp", salt="x").orderBy("log_id").collect()
    assert [r.batch for r in plan] == [i // 10 for i in range(25)]
    assert [r.customer_id for r in plan] == [f"C{i:03d}" for i in range(25)]
    assert len({r.tracking_token for r in plan}) == 25
