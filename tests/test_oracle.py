"""Registered queries against their DuckDB SQL twins on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import digest

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
SKIP_SLOW = {"train_and_score", "retrain_after_toggle", "feature_importance", "holdout_metrics"}


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(__import__("ebbtide.plans.registered", fromlist=["SQL"]).SQL))
def test_query_matches_sql_twin(spark, sf_small, duck, name):
    if name in SKIP_SLOW:
        pytest.skip("model training is checked at metric level")
    sdf = entry.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    dtypes = dict(zip(dcols, [str(t) for t in duck.sql(entry.oracle_sql()[name]).types]))
    for col, st in sdf.dtypes:
        assert SPARK_TO_DUCK.get(st, st) == dtypes[col], (col, st, dtypes[col])
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns) == digest(drows, dcols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["dimension", "value", "customers", "avg_risk", "expected_loss"]


def test_every_query_has_a_twin_or_is_rows_only():
    from ebbtide.plans.registered import QUERIES, SQL
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only <= {"train_and_score", "feature_importance", "holdout_metrics", "retrain_after_toggle",
                         "predict_new_file"}
