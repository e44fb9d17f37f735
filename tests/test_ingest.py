import os
import tempfile

from pyspark.sql import functions as F

from ebbtide.operators import ingest as I
from ebbtide.sources.tables import read_customers


def test_alias_upload_normalises(spark):
    df = spark.createDataFrame(
        [("CUST_1", 12, 49.5, 594.0, "Month-to-month", "DSL", "Card", "North", 2, 1, 30.0, 0, 3, "Churned")],
        "customer_id string, tenure long, monthly_charge double, total_charge double, contract string, internet string, "
        "payment string, region string, support_calls long, late_payments long, usage double, complaints long, "
        "satisfaction long, status string")
    r = I.normalise_churn(df).first()
    assert r.tenure_months == 12 and r.monthly_charges == 49.5
    assert r.contract_type == "Month-to-month" and r.churned == 1


def test_arbitrary_upload(spark):
    ids = [f"A{i:03d}" for i in range(1, 12)]
    status = ["active", "retained", "churned", "active", "churn", "retained", "active", "retained", "active",
              "retained", "active"]
    df = spark.createDataFrame([(i, float(n), "Paris", s) for n, (i, s) in enumerate(zip(ids, status))],
                               "my_custom_id string, customer_score double, city string, status string")
    assert I.dataset_kind(df) == "arbitrary"
    out = I.normalise_arbitrary(df)
    assert "status" not in out.columns and "churned" in out.columns and "customer_id" in out.columns
    rows = out.orderBy("customer_id").collect()
    assert len(rows) == 11
    assert [r.churned for r in rows][:5] == [0, 0, 1, 0, 1]
    assert rows[0].customer_id == "C0_001"


def test_standardise_and_generate_ids(spark):
    df = spark.createDataFrame([("x",), ("y",)], "AccountID string")
    out, found = I.standardise_id(df)
    assert found and out.columns == ["customer_id"]
    df2 = spark.range(3).select(F.col("id").alias("v"))
    ids = [r.customer_id for r in I.generate_ids(df2, order_cols=[F.col("v")]).orderBy("v").collect()]
    assert ids == ["CUST_00001", "CUST_00002", "CUST_00003"]


def test_seq_id_grows_past_width(spark):
    df = spark.createDataFrame([(99999,), (100000,), (7,)], "n long")
    got = [r.s for r in df.select(I.format_seq_id("CUST_", F.col("n")).alias("s")).collect()]
    assert got == ["CUST_99999", "CUST_100000", "CUST_00007"]


def test_quality_report(spark):
    df = spark.createDataFrame([("1", None), ("three", 2.0), (None, float("nan"))], "tenure_months string, monthly_charges double")
    rows = {(r.column_name, r.issue): r.n for r in I.quality_report(df).collect()}
    assert rows == {("monthly_charges", "null"): 2, ("tenure_months", "null"): 1, ("tenure_months", "non_numeric"): 1}


def test_dedup_keep_first(spark):
    # the scoring file repeats each id four times; keep-first leaves three rows
    rows = [(f"N00{i % 3 + 1}", i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "customer_id string, _row long, v double")
    out = {r.customer_id: r.v for r in I.dedup_keep_first(df).collect()}
    assert out == {"N001": 0.0, "N002": 1.0, "N003": 2.0}


def test_append_vs_upsert(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 2)], "customer_id string, x long")
    one_new = spark.createDataFrame([("a", 10, 0), ("c", 30, 1)], "customer_id string, x long, _row long")
    out, mode = I.import_frame(existing, one_new)
    assert mode == "append"
    assert {r.customer_id: r.x for r in out.collect()} == {"a": 1, "b": 2, "c": 30}
    all_old = spark.createDataFrame([("a", 10, 0), ("a", 11, 1)], "customer_id string, x long, _row long")
    out, mode = I.import_frame(existing, all_old)
    assert mode == "upsert"
    assert {r.customer_id: r.x for r in out.collect()} == {"a": 11, "b": 2}


def test_merge_updates_and_inserts(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 2)], "customer_id string, x long")
    both = spark.createDataFrame([("a", 10, "p", 0), ("c", 30, "q", 1), ("c", 31, "r", 2)], "customer_id string, x long, y string, _row long")
    out, mode = I.import_frame(existing, both, mode="merge")
    assert mode == "merge" and {r.customer_id: (r.x, r.y) for r in out.collect()} == {"a": (10, "p"), "b": (2, None), "c": (31, "r")}


def test_csv_bom_json_and_empty(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "c.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿customer_id,tenure_months\nX1,3\n")
    df = read_customers(spark, p, "csv")
    assert df.columns == ["customer_id", "tenure_months"]
    j = os.path.join(d, "c.json")
    with open(j, "w") as f:
        f.write('[{"customer_id": "a", "v": 1}, {"customer_id": "b", "v": 2}]')
    assert read_customers(spark, j, "json").count() == 2
    e = os.path.join(d, "empty.csv")
    open(e, "w").close()
    try:
        read_customers(spark, e, "csv")
        raise AssertionError("empty file accepted")
    except ValueError:
        pass


def test_infer_target_by_values(spark):
    df = spark.createDataFrame([("x", "yes"), ("y", "no")], "name string, answer string")
    assert I.infer_target(df, exclude=("customer_id",)) == "answer"


def test_mixed_case_names(spark):
    # id detection ignores case; the alias map is exact (a "Tenure" column is not an alias of tenure_months)
    df = spark.createDataFrame([("x", 5, 3)], "CustomerID string, Tenure long, support_calls long")
    out, found = I.standardise_id(df)
    assert found and "customer_id" in out.columns
    norm = I.normalise_churn(out)
    r = norm.first()
    assert r.tenure_months is None and r.support_tickets == 3.0


def test_long_keys_stay_whole(spark):
    from ebbtide.sources.fixtures import customer_id_of
    keys = [7, 123456789, 1234567890, 12345678901]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(customer_id_of(F.col("k"))).collect()]
    assert got == ["C000000007", "C123456789", "C1234567890", "C12345678901"]


def test_csv_with_quotes_reads_back(spark, tmp_path):
    from ebbtide.sources.sinks import write_csv
    from ebbtide.sources.tables import read_customers
    rows = [("a", 'said "hi, there" ok'), ("b", "two\nlines")]
    write_csv(spark.createDataFrame(rows, "id string, note string"), str(tmp_path / "x"))
    back = read_customers(spark, str(tmp_path / "x"), multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
