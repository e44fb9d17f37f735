"""Table scans (S3) and customer-file readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3: columnar scan of one parquet table; Catalyst prunes columns and pushes filters into it."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0] if df.columns else None
    if first is not None and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def csv_options(reader, multi_line: bool = False):
    """A (batch or stream) reader for customer CSV: UTF-8, a header row, and a quote inside a quoted field is doubled."""
    return (reader.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def read_customers(spark: SparkSession, path: str, fmt: str = "csv", *, json_array: bool = True,
                   schema=None, multi_line: bool = False) -> DataFrame:
    """A customer file of any layout.

    CSV: UTF-8, header row, inferred types (give ``schema`` in production to skip the inference
    pass), a byte-order mark on the first header is stripped, a quote inside a quoted field is doubled;
    ``multi_line`` reads line breaks inside quotes, at the price that a file is one task. JSON: an array of records
    (``json_array``) or JSON lines. An empty file is rejected.
    """
    fmt = fmt.lower()
    if fmt == "csv":
        reader = csv_options(spark.read, multi_line)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "json":
        reader = spark.read.option("multiLine", json_array)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.json(path)
    else:
        raise ValueError(f"unsupported customer file format: {fmt}")
    if not df.columns:
        raise ValueError("the uploaded file is empty")
    return _strip_bom(df)
