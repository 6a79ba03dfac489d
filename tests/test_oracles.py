"""Queries against their SQL on the smallest data, one of each kind."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "scale_features", "scaled_value_range", "class_feature_stats", "f1_embeddings", "f1_lineitem", "f1_multilabel", "duplicate_groups", "knn_tie_break", "neighbor_prefix_sweep", "n3_pos_neg_multilabel", "n1_multilabel", "msf_edges",
    "all_metrics", "multilabel_weighted", "before_after_frozen", "diagnostics", "f1_degenerate_counts",
]


@pytest.fixture(scope="module")
def db():
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(frame, columns):
    return sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).first()["f1"] == pytest.approx(0.980216169, abs=1e-6)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
