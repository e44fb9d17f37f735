"""Plan checks: what the physical plans must (not) contain."""

from ebbtide.plans.registered import QUERIES, W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry_is_broadcast_and_filter_pushed(spark, sf_small):
    from ebbtide.operators.joins import active_scored
    w = W(spark, sf_small)
    p = plan(active_scored(w.predictions, w.customers, w.sources))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    assert "EqualTo(is_active,1)" in p


def test_dashboard_question_scans_stored_active_scored(spark, sf_small):
    p = plan(QUERIES["segment_loss"](spark, sf_small))
    assert "ebbtide_active_scored" in p and "Join" not in p


def test_bucketed_join_has_no_exchange_below_it(spark, sf_small):
    from pyspark.sql import functions as F
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = W(spark, sf_small)
        j = w.predictions.join(w.customers, "customer_id").groupBy("prediction_label").agg(F.count("*"))
        p = plan(j)
        assert "SortMergeJoin" in p
        # the only exchange is the aggregation's; both join inputs are read bucketed
        assert p.count("Exchange hashpartitioning") == 1, p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_event_filter_reaches_scan(spark, sf_small):
    from ebbtide.sources.fixtures import usage_by_user
    p = plan(usage_by_user(spark, sf_small))
    assert "PushedFilters: [In(event_type" in p or "In(event_type" in p


def test_no_python_udf_outside_model(spark, sf_small):
    for name in ("segment_loss", "signals", "payload_scan_documents", "render_messages", "engagement", "kpis"):
        p = plan(QUERIES[name](spark, sf_small))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_no_single_partition_window(spark, sf_small):
    for name in ("dedup_keep_first", "merge_assignments", "segment_loss", "visible_columns"):
        p = plan(QUERIES[name](spark, sf_small))
        assert "Window" not in p or "SinglePartition" not in p, name
