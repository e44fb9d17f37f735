import os
import tempfile

import pandas as pd

from ebbtide.plans import flows
from tests.fixtures import SEED


def test_upload_then_dashboard_then_campaign(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "customers.csv")
    pd.DataFrame(SEED).to_csv(p, index=False, encoding="utf-8-sig")
    res = flows.upload(spark, p, "csv", "customers.csv")
    assert res.warnings == []
    preds = res.tables.predictions.cache()
    assert preds.count() == 25
    assert {r.prediction_label for r in preds.collect()} <= {"high_risk", "low_risk"}
    state = flows.dashboard_state(res.tables)
    assert sum(r.customers for r in state["summary"].collect()) == 25
    assert state["predictions"].count() == 25
    assert state["narrative"].first().total == 25
    titles = [r.title for r in state["segments"].orderBy("position").collect()]
    assert len(titles) == len(set(titles)) and all(t in ("Highest-risk record", "Most stable record") or t.startswith("Risk by ") for t in titles)
    assert state["metrics"].first().accuracy >= 0.0
    scored = flows.active_scored(res.tables.predictions, res.tables.customers, res.tables.sources)
    plan = flows.campaign_send_plan(scored, "all", "Hi {{customer_name}}", "{{risk_score}}", "c1").collect()
    assert len(plan) == 25 and len({r.tracking_token for r in plan}) == 25


def test_upload_without_id_warns(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "noid.csv")
    data = {k: v for k, v in SEED.items() if k != "customer_id"}
    pd.DataFrame(data).to_csv(p, index=False)
    res = flows.upload(spark, p, "csv")
    assert res.warnings == [flows.MISSING_ID_WARNING]
    ids = sorted(r.customer_id for r in res.tables.customers.collect())
    assert ids[0] == "CUST_00001" and len(ids) == 25


def test_insight_segments(spark):
    from ebbtide.operators import insights as N
    data = [("a", 0.9, "high_risk", "North", "x", "p"), ("b", 0.8, "high_risk", "South", None, "p"), ("c", 0.7, "high_risk", "South", " ", "q"),
            ("d", 0.1, "low_risk", "East", "y", "q"), ("e", 0.2, "low_risk", "East", "y", "q")]
    df = spark.createDataFrame(data, "customer_id string, predicted_probability double, prediction_label string, sales_region string, plan string, more string")
    found = N.categorical_columns(df.drop("customer_id"), 3)  # five ids are few enough to count as categories
    assert found == ["sales_region", "plan", "more"]
    got = [tuple(r) for r in N.insight_segments(df, found).orderBy("position").collect()]
    tail = ". Prioritize targeted retention for these "
    assert [g[:2] for g in got] == [(1, "Highest-risk record"), (2, "Most stable record"), (3, "Risk by sales region"), (4, "Risk by plan")]
    assert got[0][2].startswith("a carries a 90% churn") and got[1][2].startswith("d shows only a 10% churn")
    assert got[2][2] == f"High risk is most associated with South (2), North (1){tail}sales region segments."
    assert got[3][2] == f"High risk is most associated with unknown (2), x (1){tail}plan segments."
    calm = df.where("prediction_label = 'low_risk'")
    assert [r.title for r in N.insight_segments(calm, ["plan"]).collect()] == ["Most stable record"]
    assert [r.position for r in N.insight_segments(df, []).orderBy("position").collect()] == [1, 2]
    assert N.insight_segments(df.limit(0), ["plan"]).count() == 0


def test_answers_follow_the_registry(spark, sf_small):
    """A switched or deleted source shows in the next answer; the stored warehouse itself stays as it was."""
    from ebbtide.operators import registry as R
    from ebbtide.plans.warehouse import warehouse
    w = warehouse(spark, sf_small)
    before = w.active_scored().count()
    off = w.with_sources(R.toggle_source(w.sources, "src_automobile", False))
    gone = w.without_source("src_automobile")
    assert off.active_scored().where("source_id = 'src_automobile'").count() == 0 < before
    assert gone.active_scored().count() == off.active_scored().count() < before == w.active_scored().count()
    assert off.all_scored().count() == w.all_scored().count() > gone.all_scored().count() == gone.customers.count()
    assert off.active_scored().columns == w.active_scored().columns


def test_table_versions(spark, tmp_path):
    import pytest
    from ebbtide.sources.published import read_table, replace_table
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, root)
    assert replace_table(spark.range(3), root) == 1
    assert replace_table(spark.createDataFrame([("a", None)], "name string, n long"), root) == 2
    assert read_table(spark, root).columns == ["name", "n"] and read_table(spark, root, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        read_table(spark, root, 5)
