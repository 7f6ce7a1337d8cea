"""The driver contract, and SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entrypoint  # noqa: E402
from check import TABLES, bag  # noqa: E402
from conftest import SF  # noqa: E402

SAMPLE = [
    "f02_last_value_holdout", "a10_pinball", "r06_regularize_and_impute", "r10_feature_bundle", "y01_detect_frequency", "y09_anomaly_records",
    "y12_composite_analysis", "f13_walk_forward_benchmark", "f18_auto_select", "f25_top_down", "x13_decision_policy", "s08_indicator_unpivot",
    "p08_capability_filter", "q02_stream_side_sink", "q04_stream_calibration",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entrypoint.entry(spark)
    assert df.columns == ["series_id", "mae", "rmse", "smape"] and df.count() == 6


def test_every_twin_belongs_to_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
    assert len(entrypoint.queries()) > 250


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, db, name):
    df = entrypoint.queries()[name](spark, SF)
    cur = db.execute(entrypoint.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(cols, cur.fetchall())
