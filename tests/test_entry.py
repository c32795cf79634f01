"""The driver contract, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [
    "numeric_profile_nulls", "dataset_manifest", "sample_rows", "clean_columns", "scale_robust",
    "split_exact", "kfold_stratified_sizes", "threshold_eval_by_model", "roc_curve",
    "optimal_threshold", "train_ridge", "registry_state", "last_logs",
]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, found.fetchall())
