import datetime as dt

from pyspark.sql import functions as F

from ebbtide.operators import campaigns as C
from ebbtide.session import scratch_path
from ebbtide.streaming import jobs as T


def test_engagement_stream_equals_batch_with_duplicates(spark):
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        et = ["signup", "view", "click", "error"][i % 4]
        rows.append((i, t + dt.timedelta(hours=i), i % 7, et, 1.0, "{}"))
    rows += rows[:10]  # re-delivered events
    ev = spark.createDataFrame(rows, T.ENGAGEMENT_SCHEMA)
    src = scratch_path(spark, "test-t2-src")
    ev.repartition(3).write.parquet(src)
    root, ck = scratch_path(spark, "test-t2-state"), scratch_path(spark, "test-t2-ck")
    T.stream_engagement(spark, src, root, ck, watermark="30 days")
    stream = {r.tracking_token: tuple(r) for r in T.engagement_from_state(spark, root).collect()}
    kind = F.create_map(*[F.lit(x) for kv in {"signup": "sent", "view": "open", "click": "click", "error": "bounce"}.items()
                          for x in kv])
    b = ev.dropDuplicates(["event_id"]).select("event_id", F.col("user_id").cast("string").alias("tracking_token"),
                                               F.element_at(kind, F.col("event_type")).alias("kind"), "ts")
    batch = {r.tracking_token: tuple(r) for r in C.engagement(b).collect()}
    assert stream == batch


def test_trend_stream_drops_late_rows(spark):
    t = dt.datetime(2024, 1, 10)
    first = [(i, "c", 0.5, t + dt.timedelta(hours=i)) for i in range(5)]
    late = [(100, "c", 0.9, t - dt.timedelta(days=5))]
    schema = "history_id long, customer_id string, predicted_probability double, recorded_ts timestamp_ntz"
    src = scratch_path(spark, "test-t3-src")
    root, ck = scratch_path(spark, "test-t3-state"), scratch_path(spark, "test-t3-ck")
    sch = spark.createDataFrame(first, schema).schema
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    T.stream_trend(spark, src, sch, root, ck, watermark="1 day")
    # the late row arrives after the watermark has moved past it: the restarted query drops it
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(src)
    T.stream_trend(spark, src, sch, root, ck, watermark="1 day")
    got = {r.window_start.date(): r.n for r in T.trend_from_state(spark, root).collect()}
    assert got == {dt.date(2024, 1, 10): 5}
    side = T.late_history(spark, root).collect()
    assert [(r.history_id, r.batch_id) for r in side] == [(100, 1)]  # rows in = rows summed + rows set aside
    assert T.compact_trend(spark, root) == 1 and {r.window_start.date(): r.n for r in T.trend_from_state(spark, root).collect()} == got


def test_stream_import_append_then_upsert(spark):
    schema = "customer_id string, tenure_months long, support_tickets long, churned long"
    src = scratch_path(spark, "test-t1-src")
    root, ck = scratch_path(spark, "test-t1-table"), scratch_path(spark, "test-t1-ck")
    sch = spark.createDataFrame([], schema).schema
    first = [("a", 1, 0, 0), ("b", 2, 0, 1), ("a", 9, 9, 1)]          # duplicate id: first row wins
    spark.createDataFrame(first, schema).coalesce(1).write.option("header", True).mode("append").csv(src)
    T.stream_import(spark, src, sch, root, ck, mode="auto")
    mixed = [("a", 50, 5, 1), ("c", 3, 1, 0)]                          # one new id: append only, "a" untouched
    spark.createDataFrame(mixed, schema).coalesce(1).write.option("header", True).mode("append").csv(src)
    T.stream_import(spark, src, sch, root, ck, mode="auto")
    known = [("b", 7, 4, 0), ("b", 8, 6, 0)]                            # all ids known: upsert, last row wins
    spark.createDataFrame(known, schema).coalesce(1).write.option("header", True).mode("append").csv(src)
    T.stream_import(spark, src, sch, root, ck, mode="auto")
    got = {r.customer_id: (r.tenure_months, r.support_tickets) for r in T.imported_table(spark, root).collect()}
    assert got == {"a": (1.0, 0.0), "b": (8.0, 6.0), "c": (3.0, 1.0)}


def test_engagement_stream_with_campaign_periods_equals_batch(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(hours=7 * i), i % 5, ["signup", "view", "click", "error"][i % 4], 1.0, "{}")
            for i in range(80)]
    ev = spark.createDataFrame(rows, T.ENGAGEMENT_SCHEMA)
    src = scratch_path(spark, "test-t2p-src")
    ev.orderBy("ts").coalesce(1).write.parquet(src)
    root, ck = scratch_path(spark, "test-t2p-state"), scratch_path(spark, "test-t2p-ck")
    T.stream_engagement(spark, src, root, ck, watermark="1 day", period="7 days")
    stream = {(r.tracking_token, r.period_start): (r.opened, r.clicks, r.status)
              for r in T.engagement_from_state(spark, root, "7 days").collect()}
    # batch twin: the same fold per (7-day period, token)
    kind = F.create_map(*[F.lit(x) for kv in {"signup": "sent", "view": "open", "click": "click", "error": "bounce"}.items()
                          for x in kv])
    b = ev.select(F.col("user_id").cast("string").alias("tracking_token"),
                  F.element_at(kind, F.col("event_type")).alias("kind"), "ts",
                  F.window(F.col("ts").cast("timestamp"), "7 days").start.cast("timestamp_ntz").alias("period_start"))
    state = C.engagement(b, ("tracking_token", "period_start"))
    batch = {(r.tracking_token, r.period_start): (r.opened, r.clicks, r.status) for r in state.collect()}
    assert stream == batch and len({p for _, p in stream}) > 1


def test_merging_import_does_not_depend_on_micro_batches(spark):
    schema = "customer_id string, tenure_months long, support_tickets long, churned long"
    sch = spark.createDataFrame([], schema).schema
    src = scratch_path(spark, "test-t1m-src")
    for rows in ([("a", 1, 0, 0), ("b", 2, 1, 1)], [("a", 50, 5, 1), ("c", 3, 1, 0)], [("b", 7, 4, 0), ("b", 8, 6, 0), ("d", 1, 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).mode("append").csv(src)
    for files in (1, 2, 4):
        root, ck = scratch_path(spark, "test-t1m-table"), scratch_path(spark, "test-t1m-ck")
        T.stream_import(spark, src, sch, root, ck, files_per_batch=files)
        got = {r.customer_id: (r.tenure_months, r.support_tickets, r.churned) for r in T.imported_table(spark, root).collect()}
        assert got == {"a": (50.0, 5.0, 1), "b": (8.0, 6.0, 0), "c": (3.0, 1.0, 0), "d": (1.0, 1.0, 1)}


def _engaged(spark, rows_by_run, **options):
    """Runs the stream once per list of rows, as restarts of one query; the latest states and what each run saw."""
    src, root, ck = (scratch_path(spark, f"test-t2r-{x}") for x in ("src", "state", "ck"))
    seen = []
    for rows in rows_by_run:
        spark.createDataFrame(rows, T.ENGAGEMENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        seen.append(T.stream_engagement(spark, src, root, ck, **options))
    return root, seen


def test_engagement_state_survives_restarts_and_takes_opens_before_their_send(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    runs = [[(1, at(5), 7, "view", 1.0, ""), (2, at(9), 7, "view", 1.0, ""), (3, at(1), 8, "signup", 1.0, ""), (4, at(2), 8, "view", 1.0, "")],
            [(5, at(3), 7, "signup", 1.0, ""), (6, at(4), 8, "click", 1.0, ""), (7, at(1), 8, "error", 1.0, "")],  # the send comes after its opens
            [(6, at(4), 8, "click", 1.0, ""), (8, at(20), 7, "click", 1.0, ""), (9, at(6), None, "view", 1.0, "")]]  # 6 is delivered again
    root, seen = _engaged(spark, runs, watermark="2 days")
    assert [s["rows"] for s in seen] == [4, 3, 3] and sum(s["late"] for s in seen) == 0
    got = {r.tracking_token: (r.sent, r.bounced, r.opened_at, r.clicks, r.status) for r in T.engagement_from_state(spark, root).collect()}
    assert got == {"7": (True, False, at(5), 1, "clicked"), "8": (True, True, None, 1, "clicked"), None: (False, False, None, 0, "queued")}
    written = T.read_batches(spark, root).groupBy("batch_id").count().collect()
    assert [r["count"] for r in written] == [2, 2, 2]  # only the tokens that changed (and Spark runs batches without data)
    assert T.compact_engagement(spark, root) == 1 and T.read_batches(spark, root).count() == 3
    assert {r.tracking_token: r.clicks for r in T.engagement_from_state(spark, root).collect()} == {"7": 1, "8": 1, None: 0}


def test_engagement_state_expires_and_late_events_are_counted(spark):
    t = dt.datetime(2024, 1, 1)
    day = lambda d: t + dt.timedelta(days=d)
    runs = [[(1, day(0), 7, "signup", 1.0, ""), (2, day(1), 7, "view", 1.0, "")], [(3, day(40), 9, "signup", 1.0, "")],
            [(4, day(2), 7, "click", 1.0, ""), (5, day(41), 9, "view", 1.0, "")]]
    root, seen = _engaged(spark, runs, watermark="1 day", period="7 days")
    assert [s["late"] for s in seen] == [0, 0, 1]  # the click of a period that is over
    states = T.read_batches(spark, root).where("tracking_token = '7'").orderBy("batch_id").collect()
    assert [s.closed for s in states][-1] is True and states[-1].opened_at is not None and states[-1].clicks == 0
    rows_in, late = sum(s["rows"] for s in seen), sum(s["late"] for s in seen)
    assert rows_in == late + sum(r.events for r in T.engagement_states(spark, root).collect())


def test_import_reads_quotes_and_names_rows_by_file_and_place(spark):
    src = scratch_path(spark, "test-t1q-src")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(src).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(f"part-{k}.csv", [('said "hi, there" ok'.replace('"', '""') if i == 1 else f"r{k}", k * 10 + i, i % 2) for i in range(4)]) for k in range(3)]
    for name, rows in files:
        out = fs.create(path(f"{src}/{name}"), True)
        out.write(bytearray(("region,support_tickets,churned\n" + "".join(f'"{a}",{b},{c}\n' for a, b, c in rows)).encode()))
        out.close()
    answers = []
    for n in (1, 2, 4):
        root, ck = scratch_path(spark, "test-t1q-table"), scratch_path(spark, "test-t1q-ck")
        T.stream_import(spark, src, spark.createDataFrame([], "region string, support_tickets long, churned long").schema, root, ck, files_per_batch=n)
        answers.append(sorted((r.customer_id, r.region, r.support_tickets, r.churned) for r in T.imported_table(spark, root).collect()))
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 12
    assert len({a[0].split("_")[0] for a in answers[0]}) == 3 and {a[0].split("_")[1] for a in answers[0]} == {"001", "002", "003", "004"}
    assert {a[1] for a in answers[0] if a[2] % 10 == 1} == {'said "hi, there" ok'} and {a[3] for a in answers[0]} == {0, 1}


def test_import_places_rows_of_split_files(spark):
    """Places follow the file although it is read in many splits."""
    src = scratch_path(spark, "test-t1s-src")
    spark.range(4000).selectExpr("concat('n', id) AS region", "id AS support_tickets", "0L AS churned").coalesce(1).write.option("header", True).csv(src)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        root, ck = scratch_path(spark, "test-t1s-table"), scratch_path(spark, "test-t1s-ck")
        T.stream_import(spark, src, spark.createDataFrame([], "region string, support_tickets long, churned long").schema, root, ck)
        got = T.imported_table(spark, root).selectExpr("int(split(customer_id, '_')[1]) - 1 AS place", "int(support_tickets) AS n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4000 and all(r.place == r.n for r in got)


def test_compacted_import_and_replacement(spark):
    schema = "customer_id string, support_tickets long, churned long"
    src, root, ck = (scratch_path(spark, f"test-t1c-{x}") for x in ("src", "table", "ck"))
    sch = spark.createDataFrame([], schema).schema
    for rows in ([("a", 1, 0), ("b", 2, 1)], [("b", 7, 0), ("c", 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.option("header", True).mode("append").csv(src)
        T.stream_import(spark, src, sch, root, ck)
    answer = sorted(map(tuple, T.imported_table(spark, root).collect()))
    assert T.compact_import(spark, root) == 1 and T.read_batches(spark, root).count() == 3
    assert sorted(map(tuple, T.imported_table(spark, root).collect())) == answer
    spark.createDataFrame([("a", 9, 1)], schema).coalesce(1).write.option("header", True).mode("append").csv(src)
    T.stream_import(spark, src, sch, root, ck)  # a batch after the compaction
    assert {r.customer_id: r.support_tickets for r in T.imported_table(spark, root).collect()} == {"a": 9.0, "b": 7.0, "c": 1.0}
    assert T.sinks.replace(spark, root, spark.createDataFrame([("z", "x")], "customer_id string, other string")) == 2
    assert [r.asDict() for r in T.imported_table(spark, root).collect()] == [{"customer_id": "z", "other": "x"}]
