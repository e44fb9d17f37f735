"""Idempotent micro-batch folders with versions: batches, a compacted base, and a pointer published by one rename.

Each micro-batch writes into its own ``batch_id=<n>`` folder with overwrite, so a batch that Spark re-executes after a
failure replaces its own output instead of duplicating it. ``compact`` folds all batches so far into one base folder and
publishes a pointer to it: a small file written under a name of its own and renamed into ``_versions/<k>``. Readers take
the newest pointer's base and the batches after it, so they see either the old or the new version, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.published import names_below, publish_json, read_json

BATCH = "batch_id"


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/{BATCH}={batch_id}"


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(root, batch_id))


def _version(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The newest published version: its number, and its base folder with the last batch folded into it."""
    numbers = [int(n) for n in names_below(spark, f"{root}/_versions") if n.isdigit()]
    if not numbers:
        return 0, {"base": None, "upto": -1}
    return max(numbers), read_json(spark, f"{root}/_versions/{max(numbers)}")


def read_batches(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """All rows under ``root`` with their ``batch_id`` (the base's included), or None before the first batch."""
    version = _version(spark, root)[1]
    batches = [int(n.split("=")[1]) for n in names_below(spark, root) if n.startswith(f"{BATCH}=")]
    parts = [spark.read.parquet(f"{root}/{version['base']}")] if version["base"] else []
    newer = [batch_path(root, b) for b in sorted(batches) if b > version["upto"]]
    if newer:
        parts.append(spark.read.option("basePath", root).parquet(*newer).withColumn(BATCH, F.col(BATCH).cast("long")))
    if not parts:
        return None
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return df if below is None else df.where(F.col(BATCH) < below)


def compact(spark: SparkSession, root: str, fold) -> int:
    """Writes ``fold`` of everything read so far as the new base and publishes it; returns the version's number.

    ``fold`` keeps the ``batch_id`` column. A compaction that loses the race for a number publishes nothing.
    """
    number, version = _version(spark, root)
    batches = [int(n.split("=")[1]) for n in names_below(spark, root) if n.startswith(f"{BATCH}=")]
    df = read_batches(spark, root)
    if df is None:
        return number
    base = f"_base/{number + 1}-{uuid.uuid4().hex[:8]}"
    fold(df).write.parquet(f"{root}/{base}")
    won = publish_json(spark, f"{root}/_versions", str(number + 1), {"base": base, "upto": max([version["upto"], *batches])})
    return number + 1 if won else _version(spark, root)[0]


def replace(spark: SparkSession, root: str, df: DataFrame) -> int:
    """The table becomes ``df``, whatever its columns, by publishing a base that no earlier batch belongs to."""
    number, version = _version(spark, root)
    batches = [int(n.split("=")[1]) for n in names_below(spark, root) if n.startswith(f"{BATCH}=")]
    base, upto = f"_base/{number + 1}-{uuid.uuid4().hex[:8]}", max([version["upto"], *batches])
    df.withColumn(BATCH, F.lit(upto).cast("long")).write.parquet(f"{root}/{base}")
    if not publish_json(spark, f"{root}/_versions", str(number + 1), {"base": base, "upto": upto}):
        raise RuntimeError(f"another writer published version {number + 1} of {root}")
    return number + 1


def latest_per_key(log: DataFrame, keys: list[str]) -> DataFrame:
    """Latest version of each key across batch folders (a partial-aggregating ``max`` of a struct led by the batch id)."""
    others = [c for c in log.columns if c not in keys and c != BATCH]
    best = log.groupBy(*keys).agg(F.max(F.struct(BATCH, *others)).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])
