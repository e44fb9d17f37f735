"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it
back, so a lost executor costs one stage's tasks at most. Stages compute on models, sets and automata that SQL
cannot express, so there is no SQL twin; ``tests/llm/test_duplicates.py`` runs the stages, whose operators are held against brute force in ``tests/llm``.

Defined results of every stage: columns beyond those of ``documents`` are carried through whatever their names; repeated rows are
judged alike; an empty table gives no rows. Each stage's docstring says what becomes of nulls and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, langid, minhash, packing, pii
from ebbtide.llm.store import parquet, stored

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided (operator 3); those without a letter or without a clear language go.

    A null or empty text goes; a null id or label stays (a null id counts as not held out, a null label is not learnt from)."""
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 4), at similarity 0.8 where the query of operator 4 has 0.85.

    The smallest id stays, and with it every row that repeats it; a text without words and a row without an id always stay."""
    return minhash.representatives(docs, percent=minhash.LOOSE_PERCENT, bands=minhash.LOOSE_BANDS, band_rows=minhash.LOOSE_ROWS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 9). A null or empty text holds none and stays."""
    return decontaminate.clean(docs, parquet(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind (operator 2); ``n_chars`` follows the text. A null text stays null, and so does its ``n_chars``."""
    text = docs.withColumn("text", pii.redacted(F.col("text")))
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens (operator 7). A null text is its end id alone; a null id is kept."""
    return packing.packed_digest(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
