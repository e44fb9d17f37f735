"""Small settings files and versions of whole tables in the shared folder, each published as a whole by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _folder(spark: SparkSession, root: str):
    """(file system, Path class) of any Hadoop-compatible folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def names_below(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    fs, path = _folder(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def read_json(spark: SparkSession, file: str) -> dict | None:
    """A small settings file, None where there is none."""
    fs, path = _folder(spark, file)
    if not fs.exists(path(file)):
        return None
    stream = fs.open(path(file))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def publish_json(spark: SparkSession, folder: str, name: str, value: dict) -> bool:
    """Writes ``folder/name`` as a whole or not at all; False if the name is taken already."""
    fs, path = _folder(spark, folder)
    draft = path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(path(f"{folder}/{name}")) or not fs.rename(draft, path(f"{folder}/{name}")):
        fs.delete(draft, False)
        return False
    return True


def replace_table(df: DataFrame, root: str) -> int:
    """``df``, with its own schema, as the next version of the table below ``root``; returns its number.

    The rows are written first and become the table by the one rename that publishes their version, so readers see the
    table before or after, and a failed write leaves no version. Of two writers at once, the later one takes the next number.
    """
    spark, data = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{data}")
    while True:
        version = 1 + max((int(n.removesuffix(".json")) for n in names_below(spark, f"{root}/versions") if not n.startswith(".")), default=0)
        if publish_json(spark, f"{root}/versions", f"{version:012d}.json", {"data": data, "schema": df.schema.jsonValue()}):
            return version


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table below ``root``, the last one published unless named."""
    if version is None:
        found = [int(n.removesuffix(".json")) for n in names_below(spark, f"{root}/versions") if not n.startswith(".")]
        if not found:
            raise FileNotFoundError(f"no table was published below {root}")
        version = max(found)
    at = read_json(spark, f"{root}/versions/{version:012d}.json")
    if at is None:
        raise FileNotFoundError(f"no version {version} below {root}")
    return spark.read.schema(StructType.fromJson(at["schema"])).parquet(f"{root}/{at['data']}")
