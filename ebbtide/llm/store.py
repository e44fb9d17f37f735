"""Tables and files in the shared folder: written once, then read, so a lost executor costs one task."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: cuts the lineage reliably."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def open_folder(uri: str):
    """(file system, path) of a shared folder given as a path or URI that Arrow can open."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def write_file(folder: str, name: str, write: Callable) -> str:
    """Writes ``folder/name`` through a name of its own, then moves it into place, so that a failed or
    repeated task attempt never leaves half a file. Returns the path as the file system knows it."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    draft, final = f"{path}/.{name}-{uuid.uuid4().hex}", f"{path}/{name}"
    with system.open_output_stream(draft) as out:
        write(out)
    system.move(draft, final)
    return final
