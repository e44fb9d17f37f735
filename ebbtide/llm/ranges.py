"""Rows in one total order, in files of their own, numbered by part, for operators that work on runs of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.store import stored

TASK_PARTS = 16  # parts that one range of the sort aims at


def sorted_parts(df: DataFrame, order: list[Column], name: str, part_weight: int, weight_col: str | None = None) -> DataFrame:
    """``df`` in ``order`` with ``part`` (rising along the order) and ``place`` (row within the part), stored.

    Sampled splitters deal the rows into ranges, as many as the data needs, and a range is cut into parts of about
    ``part_weight`` rows (or of the sum of ``weight_col``), so a part fits in a task whatever the table's size. Rows
    that are equal in ``order`` can be split only if the caller ends it with something that tells them apart.
    ``part`` and ``place`` are fixed once written, so a task that runs again sees the same parts.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (part_weight * TASK_PARTS)))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, weight = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            size = batch.column(weight_col).to_numpy() if weight_col else np.ones(batch.num_rows, np.int64)
            parts, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, w in enumerate(size.tolist()):
                if weight and weight + w > part_weight:
                    part, place, weight = part + 1, 0, 0
                parts[i], places[i] = part, place
                place, weight = place + 1, weight + w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), pa.array(places)], [*batch.schema.names, "part", "place"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "part long", "place long"])
    return stored(rows.mapInArrow(number, schema), name)
