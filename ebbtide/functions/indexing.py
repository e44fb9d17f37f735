"""Dense row positions without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task. Instead the frame is
range-sorted, each row gets ``monotonically_increasing_id`` (partition id in the upper bits, the
position inside the partition in the lower 33), the frame is checkpointed so those ids are stable
if a task is re-run, and the per-partition row counts (one row per partition) give each partition
its starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def dense_index(df: DataFrame, order_cols: list, name: str = "row_index") -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order_cols`` order (ties: give a unique
    tiebreak in ``order_cols``)."""
    tagged = cut_lineage(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, never by the data.
    offsets = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), pid == offsets._pid)
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
            .drop("_mid", "_pid", "_off"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, in ``order_cols`` order (a unique tiebreak is expected).

    Two levels, so no task ever holds a whole group: rows are first ranked inside each (input
    partition, group) slice — bounded by the partition size — and only those local top-k rows
    (at most k × partitions per group) take part in the final per-group ranking.
    """
    local_w = Window.partitionBy(F.col("_pid"), *group_cols).orderBy(*order_cols)
    local = (df.withColumn("_pid", F.spark_partition_id())
             .withColumn("_lr", F.row_number().over(local_w)).where(F.col("_lr") <= k).drop("_lr", "_pid"))
    final_w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return local.withColumn(rank_col, F.row_number().over(final_w)).where(F.col(rank_col) <= k)


PICK_ROWS = 4096  # distinct values per column that are read back in the last step
_ACCURACY = 10_000  # of the approximate quantiles that bracket a rank


def exact_ranks(df: DataFrame, values: dict[str, tuple[Column, list[int]]]) -> dict[str, list[float | None]]:
    """The values at the given ranks (0-based, ascending; NULL and NaN skipped) of several double expressions at once.

    Bracketed selection: approximate quantiles give an interval that must hold the ranks, a counting scan places it, and
    both repeat inside it, each time with some thousandth of the values left, until it holds one value or at most
    ``PICK_ROWS`` distinct ones, which are counted and read back. Nothing is sorted or stored, a value that very many rows
    share ends the search at once, and every scan serves all expressions.
    """
    clean = {k: F.when(~F.isnan(e), e) for k, (e, _) in values.items()}
    ranks = {k: r for k, (_, r) in values.items()}
    found: dict[str, list[float | None]] = {k: [None] * len(r) for k, r in ranks.items()}
    # interval, values below it and in it; the first scan counts and brackets all of them
    first = df.agg(*[x for i, k in enumerate(clean) for x in (F.count(clean[k]).alias(f"n{i}"), F.min(clean[k]).alias(f"lo{i}"), F.max(clean[k]).alias(f"hi{i}"))]).first()
    state = {k: (first[f"lo{i}"], first[f"hi{i}"], 0, first[f"n{i}"]) for i, k in enumerate(clean) if ranks[k] and first[f"n{i}"]}
    open_ = [k for k, (lo, hi, _, n) in state.items() if lo < hi and n > PICK_ROWS]
    while open_:
        within = {k: F.when(clean[k].between(*state[k][:2]), clean[k]) for k in open_}
        asked = []
        for k in open_:
            _, _, below, n = state[k]
            at = [(r - below + 0.5) / n for r in ranks[k]]
            asked.append(F.percentile_approx(within[k], [max(0.0, min(at) - 2 / _ACCURACY), min(1.0, max(at) + 2 / _ACCURACY)], _ACCURACY))
        cut = df.agg(*[q.alias(f"q{i}") for i, q in enumerate(asked)]).first()
        tight = {k: tuple(cut[f"q{i}"]) for i, k in enumerate(open_)}
        placed = df.agg(*[x for i, k in enumerate(open_) for x in (F.count_if(clean[k] < tight[k][0]).alias(f"b{i}"),
                                                                  F.count_if(clean[k].between(*tight[k])).alias(f"n{i}"))]).first()
        again = []
        for i, k in enumerate(open_):
            below, n = placed[f"b{i}"], placed[f"n{i}"]
            holds = below <= min(ranks[k]) and max(ranks[k]) < below + n
            if not holds or n >= state[k][3]:  # no nearer: the few distinct values left are counted as they are
                continue
            state[k] = (*tight[k], below, n)
            if tight[k][0] < tight[k][1] and n > PICK_ROWS:
                again.append(k)
        open_ = again
    picks = [k for k, (lo, hi, _, _) in state.items() if lo < hi]
    counts: dict[str, list[tuple[float, int]]] = {k: [] for k in picks}
    if picks:
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.when(clean[k].between(*state[k][:2]), clean[k]).alias("v")) for k in picks])
        for r in df.select(F.inline(cells)).where("v is not null").groupBy("k", "v").count().collect():
            counts[r["k"]].append((r["v"], r["count"]))
    for k, (lo, hi, below, _) in state.items():
        if lo == hi:
            found[k] = [lo] * len(ranks[k])
            continue
        at, todo = below, sorted(counts[k])
        ends = []
        for v, n in todo:
            at += n
            ends.append((at, v))
        found[k] = [next(v for end, v in ends if r < end) for r in ranks[k]]
    return found


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median of each numeric column (NULL and NaN skipped; the mean of the two middle values for an even count)."""
    if not cols:
        return {}
    v = {c: F.col(c).cast("double") for c in cols}
    n = df.agg(*[F.count(F.when(~F.isnan(v[c]), v[c])).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    middle = {c: sorted({(n[i] - 1) // 2, n[i] // 2}) if n[i] else [] for i, c in enumerate(cols)}
    got = exact_ranks(df, {c: (v[c], middle[c]) for c in cols})
    return {c: sum(got[c]) / len(got[c]) if got[c] else None for c in cols}
