import datetime as dt

from pyspark.sql import functions as F

from ebbtide.functions.indexing import dense_index
from ebbtide.operators import ingest as I
from ebbtide.sources import sinks as S


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("k"))
    rows = dense_index(df, [F.col("k").desc()], "pos").collect()
    got = sorted((r.pos, r.k) for r in rows)
    assert [p for p, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(range(5000), reverse=True)


def _tables(spark, active):
    preds = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "customer_id string, predicted_probability double")
    cust = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s2")], "customer_id string, source_id string")
    src = spark.createDataFrame([("s1", active[0]), ("s2", active[1])], "source_id string, is_active int")
    return preds, cust, src


def test_merge_predictions_replaces_active_and_keeps_first_new(spark):
    preds, cust, src = _tables(spark, (1, 0))
    new = spark.createDataFrame([("a", 0.9, 0), ("a", 0.8, 1), ("d", 0.5, 2)], "customer_id string, predicted_probability double, _row long")
    stamp = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    out = {r.customer_id: r.predicted_probability for r in S.merge_predictions(preds, new, cust, src, stamp).collect()}
    assert out == {"a": 0.9, "b": 0.2, "c": 0.3, "d": 0.5}


def test_merge_predictions_without_active_source_clears_old(spark):
    preds, cust, src = _tables(spark, (0, 0))
    new = spark.createDataFrame([("d", 0.5)], "customer_id string, predicted_probability double")
    out = {r.customer_id for r in S.merge_predictions(preds, new, cust, src).collect()}
    assert out == {"d"}


def test_sync_feed_scores(spark):
    cust = spark.createDataFrame([("x", "s1", 0)], "customer_id string, source_id string, complaint_count long")
    preds = spark.createDataFrame([("x", 0.3, "low_risk")], "customer_id string, predicted_probability double, prediction_label string")
    feed = spark.createDataFrame([("HS-001", "?", 2), ("HS-002", "?", 1)], "customer_id string, source_id string, complaint_count long")
    c2, p2 = I.sync_feed(cust, preds, feed, "hubspot")
    assert {r.customer_id: r.source_id for r in c2.collect()} == {"x": "s1", "HS-001": "crm_sync_hubspot", "HS-002": "crm_sync_hubspot"}
    assert {r.customer_id: (r.predicted_probability, r.prediction_label) for r in p2.collect()} == {
        "x": (0.3, "low_risk"), "HS-001": (0.85, "high_risk"), "HS-002": (0.15, "low_risk")}


def test_top_k_per_group_matches_full_ranking(spark):
    from ebbtide.functions.indexing import top_k_per_group
    rows = [(g, i, (i * 37 + g * 11) % 101) for g in range(4) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v int").repartition(7)
    got = {(r.g, r.rank): (r.v, r.i) for r in top_k_per_group(df, ["g"], [F.desc("v"), F.col("i")], 3).collect()}
    for g in range(4):
        exp = sorted([(v, i) for gg, i, v in rows if gg == g], key=lambda t: (-t[0], t[1]))[:3]
        assert [got[(g, r)] for r in (1, 2, 3)] == exp


def test_exact_medians_with_hot_value(spark):
    import numpy as np
    from ebbtide.functions.indexing import exact_medians
    vals = [0.0] * 400 + [float(i) for i in range(1, 201)] + [None, float("nan")]
    evens = [float(i) for i in range(10)]
    df = spark.createDataFrame([(v, evens[i % 10] if i < 10 else None) for i, v in enumerate(vals)], "a double, b double")
    got = exact_medians(df.repartition(5), ["a", "b"])
    assert got["a"] == float(np.median([v for v in vals if v is not None and v == v]))
    assert got["b"] == 4.5


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    from ebbtide.sources.sinks import write_csv
    from ebbtide.sources.tables import read_customers
    texts = ["  spaces around  ", 'said ""hi"", "there"', "a\nb\r\nc", "x,y;z", "\t", "é 日本 '"]
    path = str(tmp_path / "t")
    write_csv(spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(2), path)
    back = read_customers(spark, path, "csv", schema="id long, body string", multi_line=True)
    assert {r["id"]: r["body"] for r in back.collect()} == dict(enumerate(texts))
