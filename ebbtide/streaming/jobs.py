"""T1–T3 streaming jobs. Each has a batch twin that gives the same answer on the same input.

All three use ``trigger(availableNow=True)`` in tests and the bench (process what is there, then
stop); in production the same query runs with a processing-time trigger. Checkpoints live below the
shared checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ebbtide.config import DEFAULT_CONFIG, RetentionConfig
from ebbtide.functions.scalars import instant_to_ntz, ntz_to_instant
from ebbtide.operators import ingest as I
from ebbtide.session import broadcast_if_small
from ebbtide.sources.published import publish_json, read_json
from ebbtide.sources.tables import csv_options
from ebbtide.streaming import sinks
from ebbtide.streaming.sinks import BATCH, latest_per_key, read_batches, write_batch

FILE, ORDER = "_file", "_order"  # a row's file, and its place in the order of all imported rows
MAX_BATCH_KEYS = 5_000_000  # a micro-batch's distinct ids are broadcast only below this count


def _run(writer, checkpoint: str, available_now: bool = True):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    progress = {}  # by micro-batch: a query only remembers its last hundred
    while available_now and q.isActive:
        q.awaitTermination(0.5)
        progress |= {p["batchId"]: p for p in q.recentProgress}
    progress |= {p["batchId"]: p for p in q.recentProgress}
    if available_now and q.exception() is not None:
        raise q.exception()
    return q, progress


# ------------------------------------------------------------------ T1: incremental import

def _in_file(batch: DataFrame) -> DataFrame:
    """``place``: the row's number in its file, from 0, however the file is split and whatever else is in the batch.

    A split's rows are neighbours in their partition, so a row's number in its split is its distance from the split's
    first row; splits are counted, and a file's earlier splits (a few rows per file) give the offset.
    """
    at = batch.withColumn("_at", F.monotonically_increasing_id())
    file = [F.col(f"{FILE}.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start")]
    splits = at.select(*file, "_at").groupBy("_file_path", "_file_block_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file_path").orderBy("_file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = (F.col(f"{FILE}.file_path") == F.col("_file_path")) & (F.col(f"{FILE}.file_block_start") == F.col("_file_block_start"))
    placed = at.join(broadcast_if_small(splits), on).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.drop("_at", "_first", "_before", "_file_path", "_file_block_start")


def _file_tag(path: Column) -> Column:
    """Eight hex digits that name a file, from its name alone."""
    return F.substring(F.sha2(F.element_at(F.split(path, "/"), -1), 256), 1, 8)


def stream_import(spark: SparkSession, src_dir: str, schema: StructType, table_root: str, checkpoint: str,
                  cfg: RetentionConfig = DEFAULT_CONFIG, fmt: str = "csv", files_per_batch: int = 1,
                  mode: str = "merge", multi_line: bool = False) -> None:
    """New customer files → normalise (I17) → import. CSV files are read as S1 reads them (doubled quotes,
    ``multi_line`` for line breaks inside quotes).

    ``mode="merge"`` (default): known ids are updated, new ones inserted, the last row of an id wins. Rows are
    ordered by file time, file name, then place in the file, and that order is stored with them; rows of files without
    an id column are named by file and place. So the table is the same however files fall into micro-batches, and no
    earlier batch is read again.

    ``mode="auto"`` is the reference's rule per micro-batch: when at least one id is new, append the unseen ids
    (first row per id, I18) and leave existing rows untouched; when every id already exists, upsert (last row
    per id wins, I19). What counts as one upload is then one micro-batch.

    Each micro-batch writes only its own rows into its batch folder, so a replayed batch is idempotent.
    """
    if mode not in ("merge", "auto"):
        raise ValueError(f"unknown import mode {mode!r}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = csv_options(reader, multi_line).csv(src_dir) if fmt == "csv" else reader.format(fmt).load(src_dir)
    stream = stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path",
                                         "_metadata.file_block_start").alias(FILE))

    def merge(batch: DataFrame, batch_id: int) -> None:
        placed = _in_file(batch)
        order = F.struct(F.col(f"{FILE}.file_modification_time"), F.col(f"{FILE}.file_path"), F.col("place"))
        rows = placed.withColumn(I.ROW, order)
        rows, found = I.standardise_id(rows)
        if not found:
            rows = rows.withColumn("customer_id", I.format_seq_id("", F.col("place") + 1, 3))
            rows = rows.withColumn("customer_id", F.concat(F.lit("C"), _file_tag(F.col(f"{FILE}.file_path")), F.lit("_"), "customer_id"))
        rows = I.normalise_churn(rows.drop(FILE, "place"), cfg)
        if mode == "merge":
            write_batch(I.dedup_keep_last(rows, "customer_id", I.ROW).withColumnRenamed(I.ROW, ORDER), table_root, batch_id)
            return
        earlier = read_batches(spark, table_root, below=batch_id)
        if earlier is None:
            write_batch(I.dedup_keep_first(rows, "customer_id", I.ROW).drop(I.ROW), table_root, batch_id)
            return
        # which of this batch's ids exist already: the batch's own keys (size-checked) are broadcast and
        # the earlier keys stream past them — the large side is never shuffled
        batch_keys = broadcast_if_small(rows.select("customer_id").distinct(), MAX_BATCH_KEYS)
        seen = earlier.select("customer_id").join(batch_keys, "customer_id", "left_semi")
        fresh = rows.join(seen, "customer_id", "left_anti")
        if fresh.limit(1).count() > 0:
            write_batch(I.dedup_keep_first(fresh, "customer_id", I.ROW).drop(I.ROW), table_root, batch_id)
        else:
            write_batch(I.dedup_keep_last(rows, "customer_id", I.ROW).drop(I.ROW), table_root, batch_id)

    _run(stream.writeStream.foreachBatch(merge), checkpoint)


def _last_import(df: DataFrame) -> DataFrame:
    """The latest row per id, by file order where it is stored, else by micro-batch (``batch_id`` is kept)."""
    order = [c for c in (ORDER, BATCH) if c in df.columns]
    key = F.struct(*order).alias("_key")
    others = [c for c in df.columns if c not in ("customer_id", *order)]
    best = df.groupBy("customer_id").agg(F.max(F.struct(key, *others)).alias("_v"))
    return best.select("customer_id", *[F.col(f"_v.{c}").alias(c) for c in others], *[F.col(f"_v._key.{c}").alias(c) for c in order])


def imported_table(spark: SparkSession, table_root: str) -> DataFrame | None:
    """The imported customers, one row per id."""
    df = read_batches(spark, table_root)
    return None if df is None else _last_import(df).drop(ORDER, BATCH)


def compact_import(spark: SparkSession, table_root: str) -> int:
    """Folds all imported batches into one row per id and publishes it as a new version of the table."""
    return sinks.compact(spark, table_root, _last_import)


# ------------------------------------------------------------------ T2: engagement

ENGAGEMENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# How the log's event types read as engagement events.
EVENT_KINDS = {"signup": "sent", "view": "open", "click": "click", "error": "bounce"}
_STATE = "sent_at long, until long, bounced boolean, clicks long, clicked_at long, first long, events long, opens array<long>"
_FOLDED = "sent boolean, bounced boolean, opened_at long, clicks long, clicked_at long, first long, events long, closed boolean"


def _least(*values: int | None) -> int | None:
    known = [v for v in values if v is not None]
    return min(known) if known else None


def _fold(keys: list[str], period: bool):
    """The state function of T2: micro-seconds of the send, of the first click or bounce, and of the opens that may still
    count. Opens after the first that counts, and opens before the send that no later send can precede, are let go."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent_at, until, bounced, clicks, clicked_at, first, events, opens = state.get if state.exists else (None, None, False, 0, None, None, 0, [])
        opens = set(opens or [])
        closed = state.hasTimedOut
        if not closed:
            for f in frames:  # a token's events of a micro-batch, in frames of bounded size
                at = {kind: g for kind, g in f.groupby("kind")["micros"]}
                sent_at = _least(sent_at, *([int(at["sent"].min())] if "sent" in at else []))
                until = _least(until, *[int(at[k].min()) for k in ("click", "bounce") if k in at])
                bounced = bounced or "bounce" in at
                clicks += len(at.get("click", ()))
                clicked_at = max([c for c in (clicked_at, *([int(at["click"].max())] if "click" in at else [])) if c is not None], default=None)
                first, events = _least(first, int(f["micros"].min())), events + len(f)
                opens |= set(int(x) for x in at["open"].unique()) if "open" in at else set()
                opens = _useful(opens, sent_at, until, None)
        live = [o for o in opens if sent_at is not None and o >= sent_at and (until is None or o < until)]
        opened_at = min(live, default=None) if key[0] is not None else None
        if closed:
            state.remove()
        else:
            watermark = state.getCurrentWatermarkMs() * 1000
            state.update((sent_at, until, bounced, clicks, clicked_at, first, events, sorted(_useful(opens, sent_at, until, watermark))))
            if period:
                state.setTimeoutTimestamp(max(int(key[1]) // 1000, state.getCurrentWatermarkMs() + 1))
        row = {c: [v] for c, v in zip(keys, key)}
        row |= {"sent": [sent_at is not None], "bounced": [bounced], "opened_at": pd.array([opened_at], "Int64"), "clicks": [clicks],
                "clicked_at": pd.array([clicked_at], "Int64"), "first": pd.array([first], "Int64"), "events": [events], "closed": [closed]}
        yield pd.DataFrame(row)

    return fold


def _useful(opens: set[int], sent_at: int | None, until: int | None, watermark: int | None) -> set[int]:
    """Opens that can still be the first to count: none at or after ``until`` (it only falls), only the first at or after
    the send, and those before the send which a send yet to come (not before the watermark) may precede."""
    opens = {o for o in opens if until is None or o < until}
    if sent_at is None:
        early, counting = opens, []
    else:
        early, counting = {o for o in opens if o < sent_at}, [o for o in opens if o >= sent_at]
    if watermark is not None:
        early = {o for o in early if o >= watermark}
    return early | ({min(counting)} if counting else set())


def engagement_stream(events: DataFrame, watermark: str = "7 days", period: str | None = None) -> DataFrame:
    """T2 as a stream of changed states: engagement events, each event id once within the watermark, folded per token.

    State is one entry per event id of the watermark's span and one record per token. With ``period`` (e.g.
    ``"30 days"``, a campaign's lifetime) a token has one record per period, which is written a last time (``closed``)
    and removed once the watermark has passed the period's end; no event of it can arrive after that.
    """
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])
    ev = (events.where(F.col("event_type").isin(*EVENT_KINDS))
          .select("event_id", F.col("user_id").cast("string").alias("tracking_token"),
                  F.element_at(kind, F.col("event_type")).alias("kind"),
                  # watermarks need TIMESTAMP: the wall-clock time read as UTC, independent of the session zone
                  ntz_to_instant(F.col("ts")).alias("_event_time"))
          .withWatermark("_event_time", watermark)
          .dropDuplicatesWithinWatermark(["event_id"]))
    keys, schema = ["tracking_token"], "tracking_token string, "
    if period is not None:
        ev = ev.withColumn("period_end", F.unix_micros(F.window("_event_time", period).getField("end")))
        keys, schema = [*keys, "period_end"], schema + "period_end long, "
    ev = ev.withColumn("micros", F.unix_micros("_event_time"))
    timeout = GroupStateTimeout.EventTimeTimeout if period is not None else GroupStateTimeout.NoTimeout
    return ev.groupBy(*keys).applyInPandasWithState(_fold(keys, period is not None), schema + _FOLDED, _STATE, "append", timeout)


def stream_engagement(spark: SparkSession, events_dir: str, state_root: str, checkpoint: str,
                      watermark: str = "7 days", files_per_batch: int = 1, glob: str | None = None,
                      period: str | None = None) -> dict[str, int]:
    """Each micro-batch writes the states that it changed into its own folder; no earlier folder is read.

    Returns the run's ``rows`` read and ``late`` rows (engagement events dropped by the watermark), which are also
    kept per run below ``_late``.
    """
    r = spark.readStream.schema(ENGAGEMENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    changed = engagement_stream(r.parquet(events_dir), watermark, period)
    q, progress = _run(changed.writeStream.outputMode("append").foreachBatch(lambda b, i: write_batch(b, state_root, i)), checkpoint)
    seen = {"rows": sum(p["numInputRows"] for p in progress.values()),
            "late": sum(o["numRowsDroppedByWatermark"] for p in progress.values() for o in p["stateOperators"])}
    publish_json(spark, f"{state_root}/_late", f"{q.runId}.json", seen)
    return seen


def engagement_states(spark: SparkSession, state_root: str) -> DataFrame:
    """The latest state of every token (and period): what was written last, nothing is folded again."""
    log = read_batches(spark, state_root)
    return latest_per_key(log, [c for c in ("tracking_token", "period_end") if c in log.columns])


def engagement_from_state(spark: SparkSession, state_root: str, period: str | None = None) -> DataFrame:
    """The columns of the batch fold (C6); with ``period``, the length of the stream's periods, each period's start."""
    s = engagement_states(spark, state_root)
    at = {c: instant_to_ntz(F.timestamp_micros(F.col(c))) for c in ("opened_at", "clicked_at", "first")}
    opened = F.col("opened_at").isNotNull()
    status = (F.when(F.col("clicks") > 0, "clicked").when(opened, "opened").when(F.col("bounced"), "failed")
              .when(F.col("sent"), "sent").otherwise("queued"))
    keys = ["tracking_token"]
    if period is not None:
        keys.append(instant_to_ntz(F.timestamp_micros("period_end") - F.expr(f"INTERVAL {period}")).alias("period_start"))
    return s.select(*keys, "sent", "bounced", opened.alias("opened"), at["opened_at"].alias("opened_at"), "clicks",
                    at["clicked_at"].alias("clicked_at"), status.alias("status"), at["first"].alias("first_ts"))


def compact_engagement(spark: SparkSession, state_root: str) -> int:
    """Keeps the latest state of each token as the table's new version."""
    def last(log: DataFrame) -> DataFrame:
        keys = [c for c in ("tracking_token", "period_end") if c in log.columns]
        return latest_per_key(log.withColumn("_batch", F.col(BATCH)), keys).withColumnRenamed("_batch", BATCH)
    return sinks.compact(spark, state_root, last)


# ------------------------------------------------------------------ T3: risk trend

def _watermark_before(spark: SparkSession, state_root: str, batch_id: int) -> int | None:
    """Greatest event time (micros) of all earlier micro-batches; None before the first."""
    if batch_id == 0:
        return None
    found = read_json(spark, f"{state_root}/_progress/{batch_id - 1}.json")
    if found is None:
        raise RuntimeError(f"micro-batch {batch_id - 1} of {state_root} left no progress; was its folder changed?")
    return found["latest"]


def stream_trend(spark: SparkSession, history_dir: str, schema, state_root: str, checkpoint: str,
                 width: str = "1 day", watermark: str = "2 days", files_per_batch: int = 1,
                 ts_col: str = "recorded_ts", p_col: str = "predicted_probability") -> None:
    """Tumbling-window sums of the probability, with late rows set aside.

    The watermark of a micro-batch is the greatest event time of the earlier ones less ``watermark``; a row whose window
    had ended by then is late. Late rows are written to ``late/`` with their micro-batch, all others are summed per
    window. Sums add up, so a micro-batch writes its own part of each window and reads none of the earlier ones; its
    folders are written over if Spark repeats it, so nothing counts twice. Rows without a time
    belong to no window; they are set aside too.
    """
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(history_dir)
    timed = src.withColumn("_event_time", ntz_to_instant(F.col(ts_col)))
    windowed = timed.withColumn("_w", F.when(F.col("_event_time").isNotNull(), F.window("_event_time", width)))

    def add(batch: DataFrame, batch_id: int) -> None:
        before = _watermark_before(spark, state_root, batch_id)
        late = F.col("_w").isNull()
        if before is not None:
            late = late | (F.col("_w.end") <= F.timestamp_micros(F.lit(before)) - F.expr(f"INTERVAL {watermark}"))
        on_time = batch.where(~late)
        sums = on_time.groupBy("_w").agg(F.sum(p_col).alias("p_sum"), F.count(p_col).alias("p_n"), F.count(F.lit(1)).alias("n"))
        write_batch(sums.select(instant_to_ntz(F.col("_w.start")).alias("window_start"), instant_to_ntz(F.col("_w.end")).alias("window_end"),
                                "p_sum", "p_n", "n"), f"{state_root}/windows", batch_id)
        write_batch(batch.where(late).drop("_event_time", "_w"), f"{state_root}/late", batch_id)
        latest = batch.agg(F.max(F.unix_micros("_event_time"))).first()[0]
        latest = max([x for x in (before, latest) if x is not None], default=None)
        publish_json(spark, f"{state_root}/_progress", f"{batch_id}.json", {"latest": latest})

    _run(windowed.writeStream.foreachBatch(add), checkpoint)


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("window_start", "window_end").agg(F.sum("p_sum").alias("p_sum"), F.sum("p_n").alias("p_n"), F.sum("n").alias("n"), F.max(BATCH).alias(BATCH))


def trend_from_state(spark: SparkSession, state_root: str) -> DataFrame:
    cur = _summed(read_batches(spark, f"{state_root}/windows"))
    return cur.select("window_start", "window_end", (F.col("p_sum") / F.nullif(F.col("p_n"), F.lit(0))).alias("probability"), "n")


def compact_trend(spark: SparkSession, state_root: str) -> int:
    """One row per window as the table's new version."""
    return sinks.compact(spark, f"{state_root}/windows", _summed)


def late_history(spark: SparkSession, state_root: str) -> DataFrame | None:
    """The rows that came too late for their window, with the micro-batch that brought them."""
    return read_batches(spark, f"{state_root}/late")
