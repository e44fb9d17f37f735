from pyspark.sql import functions as F

from ebbtide.operators import aggregates as A
from ebbtide.operators import registry as R
from ebbtide.operators import topk as K

COLS = ("customer_id string, predicted_probability double, prediction_label string, contract_type string, "
        "tenure_months long, monthly_charges double, support_tickets long, customer_satisfaction_score double, "
        "churned long, payment_method string, internet_service string, region string")


def scored(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_null_tenure_is_25_plus_and_null_contract_separate(spark):
    df = scored(spark, [("a", 0.7, "high_risk", None, None, 10.0, 0, 5.0, 0, None, None, None),
                        ("b", 0.2, "low_risk", "unknown", 3, 0.0, 0, 5.0, 0, None, None, None)])
    tb = {r.tenure_bucket: r.cnt for r in A.tenure_buckets(df).collect()}
    assert tb == {"25+ Months": 1, "0-3 Months": 1}
    cb = A.contract_breakdown(df).collect()
    assert sorted((r.contract, r.is_null_group) for r in cb) == [("unknown", False), ("unknown", True)]


def test_exposure_zero_charges(spark):
    df = scored(spark, [("a", 0.7, "high_risk", None, 1, 0.0, 0, 5.0, 0, None, None, None)])
    r = A.exposure(df).first()
    assert r.total_charges == 0.0 and r.risk_exposure_pct == 0.0


def test_signals_nan_and_null(spark):
    df = scored(spark, [("a", 0.7, "high_risk", None, 1, 1.0, None, float("nan"), 0, None, None, None),
                        ("b", 0.7, "high_risk", None, 30, 1.0, 4, 1.0, 0, None, None, None)])
    sig = {r.signal: r.customers for r in A.signals(df).collect()}
    # NULL tickets count as 0 (low); NaN satisfaction is neither low nor high
    assert sig["Low support tickets (0-1)"] == 1 and sig["High support tickets (3+)"] == 1
    assert sig["Low satisfaction (1-2)"] == 1 and "High satisfaction (4-5)" not in sig


def test_topk_ties_break_on_id(spark):
    rows = [(f"c{i}", 0.9, "high_risk", None, 1, 1.0, 0, 5.0, 0, None, None, None) for i in range(5)]
    got = [r.customer_id for r in K.top_risk(scored(spark, rows), 3).collect()]
    assert got == ["c0", "c1", "c2"]


def test_cohort_and_drilldown_empty(spark):
    df = scored(spark, [("a", 0.7, "high_risk", "", 1, 1.0, 0, 5.0, 0, None, None, None),
                        ("b", 0.1, "low_risk", "One year", 1, 1.0, 0, 5.0, 1, None, None, None)])
    co = {r.cohort: (r.total, r.churned, r.m12_pct) for r in A.cohort_retention(df).collect()}
    assert co == {"Month-to-month": (1, 1, 0), "One year": (1, 1, 0)}
    dd = {r.selector: (r.total, r.m1_pct, r.m12_pct) for r in A.retention_drilldown(df, ["all", "contract_Two year"]).collect()}
    assert dd["contract_Two year"] == (0, 98, 58)
    assert dd["all"] == (2, 88, 0)


def test_registry_ops(spark):
    src = spark.createDataFrame([("sample_data", 1), ("s1", 0)], "source_id string, is_active int") \
        .withColumn("filename", F.lit("f")).withColumn("row_count", F.lit(1)).withColumn("created_at", F.current_timestamp())
    assert R.is_sample_only(src).first().sample_only is True
    custom = R.set_mode(src, "custom")
    assert {r.source_id: r.is_active for r in custom.collect()} == {"sample_data": 0, "s1": 1}
    assert R.is_sample_only(R.toggle_source(src, "s1", True)).first().sample_only is False
    assert [r.source_id for r in R.list_sources(src).collect()] == ["s1"]


def test_delete_source_cascades(spark):
    preds = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "customer_id string, predicted_probability double")
    cust = spark.createDataFrame([("a", "s1"), ("b", "s2")], "customer_id string, source_id string")
    src = spark.createDataFrame([("s1", 1), ("s2", 1)], "source_id string, is_active int")
    p2, c2, s2 = R.delete_source(preds, cust, src, "s1")
    assert [r.customer_id for r in p2.collect()] == ["b"]
    assert [r.customer_id for r in c2.collect()] == ["b"]
    assert [r.source_id for r in s2.collect()] == ["s2"]


def test_roi_sweep_point_equals_single_simulation(spark):
    rows = [(f"c{i}", i / 20.0, "high_risk" if i >= 12 else "low_risk", None, 1, (None if i % 4 == 0 else 10.0 * i), 0, 5.0, 0,
             None, None, None) for i in range(20)]
    df = scored(spark, rows)
    one = A.campaign_roi(df, threshold=0.5, discount=0.15, success=0.3).first().asDict()
    sweep = A.campaign_roi_sweep(df, [0.5], [0.15], [0.3]).first().asDict()
    for k in ("targeted", "revenue", "cost", "gross", "net", "roi_pct", "band"):
        assert one[k] == sweep[k], k


def test_profiles_see_every_row(spark):
    """What only a late row shows counts: a value in one row of many, categories and integers beyond the first rows."""
    from ebbtide.operators import insights as N
    from ebbtide.operators import projections as PR
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("customer_id"), (F.col("id") * 1.5).alias("charges"),
                                  F.when(F.col("id") == 2999, "late").alias("note"), F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")).alias("at_limit"),
                                  F.concat(F.lit("k"), (F.col("id") % 1001).cast("string")).alias("above"),
                                  F.when(F.col("id") < 1000, "word").otherwise(F.col("id").cast("string")).alias("mostly_numbers"), F.lit("").alias("blank"))
    assert [r.column_name for r in PR.visible_columns(df).collect()] == ["charges", "note", "at_limit", "above", "mostly_numbers"]
    assert [r.column_name for r in PR.visible_columns(df, 2, 50, ["customer_id"]).collect()] == ["charges", "at_limit"]
    assert [r.column_name for r in N.categorical_profile(df).collect()] == ["note", "at_limit"]
    assert [r.column_name for r in N.categorical_profile(df, 1).collect()] == ["note"]
    assert N.categorical_profile(df.limit(0)).count() == 0


def test_target_is_inferred_from_every_row(spark):
    from ebbtide.operators import ingest as I
    df = spark.range(500).select(F.lit("x").alias("a"), F.when(F.col("id") == 499, "Attrited").otherwise("z").alias("b"), F.lit("yes").alias("c"))
    assert I.infer_target(df) == "b" and I.infer_target(df.select("a")) is None
