import math

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S


def test_heuristic_dirty_strings(spark):
    # the reference's own exact-value case: [1, 0]
    df = spark.createDataFrame(
        [("invalid_str", "nan", "", "three", "10", "N/A", "monthly"),
         ("2", "1", "0", "4.0", "12", "50", "annual")],
        "support_tickets string, complaint_count string, payment_delays string, customer_satisfaction_score string, "
        "tenure_months string, product_usage string, contract_type string")
    rows = df.select(S.heuristic_target(df).alias("t"), S.heuristic_score(df).alias("s")).collect()
    assert [r.t for r in rows] == [1, 0]
    assert rows[0].s == pytest.approx(0.67)
    assert rows[1].s == pytest.approx(0.35)


def test_parse_float_text_python_rules(spark):
    vals = ["1_000", "2d", "3f", " 4.0 ", "inf", "-Infinity", "nan", "1e3", ".5", "5.", "abc", "", None, "1__0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.p for r in df.select(S.parse_float_text(F.col("v")).alias("p")).collect()]
    exp = []
    for v in vals:
        try:
            exp.append(float(v))
        except (TypeError, ValueError):
            exp.append(None)
    for g, e in zip(got, exp):
        if e is None:
            assert g is None
        elif math.isnan(e):
            assert math.isnan(g)
        else:
            assert g == e


def test_safe_num_numeric_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,)], "x double")
    got = [r.v for r in df.select(S.safe_num(df, "x", 7.0).alias("v")).collect()]
    assert got == [7.0, 7.0, 3.0]


def test_encode_target(spark):
    vals = ["Churned", " inactive ", "active", "5", "2.7", "yes", "N", None, "garbage", "-1", "3000000000", "1e30", "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.e for r in df.select(S.encode_target(F.col("v")).alias("e")).collect()]
    assert got == [1, 1, 0, 5, 2, 1, 0, 0, 0, -1, 3000000000, 2 ** 63 - 1, 0]


def test_binarise_upload_targets(spark):
    df = spark.createDataFrame([("Churned",), ("inactive",), ("yes",), (None,), ("0",)], "v string")
    t = [r.t for r in df.select(S.binarise_target(F.col("v")).alias("t")).collect()]
    a = [r.a for r in df.select(S.binarise_active(F.col("v")).alias("a")).collect()]
    assert t == [1, 0, 1, 0, 0]
    assert a == [1, 1, 0, 1, 1]


def test_title_case_matches_python(spark):
    vals = ["month-to-month", "one year", "high_risk".replace("_", " "), "unknown", "fiber optic", "x2y"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.t for r in df.select(S.title_case(F.col("v")).alias("t")).collect()]
    assert got == [v.title() for v in vals]


def test_risk_label_nan_is_low(spark):
    df = spark.createDataFrame([(float("nan"),), (0.6,), (0.59,)], "p double")
    got = [r.l for r in df.select(S.risk_label(F.col("p")).alias("l")).collect()]
    assert got == ["low_risk", "high_risk", "low_risk"]


def test_wall_clock_round_trip_any_zone(spark):
    import datetime as dt
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        vals = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 1, 5, 23, 15, 0, 123456)]
        df = spark.createDataFrame([(v,) for v in vals], "t timestamp_ntz")
        rows = df.select(S.instant_to_ntz(S.ntz_to_instant(F.col("t"))).alias("b"),
                         S.instant_to_ntz(F.window(S.ntz_to_instant(F.col("t")), "1 day").start).alias("d")).collect()
        assert [r.b for r in rows] == vals
        assert [r.d for r in rows] == [dt.datetime(v.year, v.month, v.day) for v in vals]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
