"""Inferred aliases agree with pandas on regular calendars."""

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidepanel.functions.freq import alias_step, steps_between, steps_from, token
from tidepanel.operators import clean
from tidepanel.operators import analysis as an

CASES = ["D", "2D", "W-WED", "2W-SUN", "h", "6h", "15min", "90s", "MS", "2MS", "ME", "QS-OCT", "QE-DEC", "YS-JAN", "YE-DEC", "B", "BMS", "BME"]


@pytest.fixture(scope="module")
def inferred(spark):
    rows = []
    for c in CASES:
        idx = pd.date_range("2021-01-01", periods=24, freq=c)
        rows += [(c, t.to_pydatetime(), i, 24, 1.0) for i, t in enumerate(idx)]
    p = spark.createDataFrame(rows, "series_id string, ts timestamp, pos long, n long, y double")
    return {r.series_id: r.alias for r in an.inferred_alias(p).collect()}


@pytest.mark.parametrize("freq", CASES)
def test_alias(inferred, freq):
    assert inferred[freq] == pd.infer_freq(pd.date_range("2021-01-01", periods=24, freq=freq))


def test_irregular(panel):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    stamps = {"gappy": [t0 + timedelta(hours=h) for h in range(20) if h != 7], "wild": [t0 + timedelta(hours=h * h) for h in range(9)], "two": [t0, t0 + timedelta(days=1)]}
    p = panel({k: [1.0] * len(v) for k, v in stamps.items()}, stamps=stamps)
    got = {r.series_id: r.frequency for r in an.detect_frequency(p).collect()}
    assert got == {"gappy": "H", "wild": "irregular", "two": "unknown"}
    ingest = {r.series_id: r.frequency for r in an.ingest_frequency(p).collect()}
    assert ingest == {"gappy": "h", "wild": "auto", "two": "auto"}


def test_mostly_regular_long_series(spark):
    """1201 points, every third step doubled: half of at least 1000 steps suffices."""
    t, rows = pd.Timestamp("2024-01-01"), []
    for i in range(1201):
        rows.append(("s", t.to_pydatetime(), i, 1201, 1.0))
        t += pd.Timedelta(hours=2 if i % 3 == 2 else 1)
    p = spark.createDataFrame(rows, "series_id string, ts timestamp, pos long, n long, y double")
    assert an.ingest_frequency(p).first().frequency == "h"


def test_tokens():
    assert [token(x) for x in ("15T", "min", "2H", "D", "W-SUN", "MS", "QE", "A", "auto")] == ["MIN", "MIN", "H", "D", "W", "M", "Q", "Y", "AUTO"]
    assert alias_step("2MS") == ("month", 2) and alias_step("QS-OCT") == ("month", 3) and alias_step("6h") == ("second", 21600)
    with pytest.raises(ValueError):
        alias_step("fortnight?")


@pytest.mark.parametrize(
    ("alias", "start"),
    [
        ("B", "2024-01-12"), ("2B", "2024-01-11"), ("ME", "2024-01-31"), ("ME", "2024-02-29"), ("QE-DEC", "2023-12-31"), ("YE-DEC", "2023-12-31"),
        ("BMS", "2024-01-01"), ("BME", "2024-01-31"), ("BQS-OCT", "2024-01-01"), ("BQE-DEC", "2023-12-29"), ("BYE-DEC", "2023-12-29"), ("MS", "2024-01-01"),
        ("QS-OCT", "2024-01-01"), ("YS-JAN", "2024-01-01"), ("W-MON", "2024-01-01"), ("3D", "2024-01-01"), ("6h", "2024-01-01"), ("15min", "2024-01-01"),
    ],
)
def test_calendar_steps_follow_pandas(spark, alias, start):
    import pandas as pd

    expected = pd.date_range(start, periods=40, freq=alias)
    base = spark.range(40).select(F.lit(start).cast("timestamp").alias("t"), "id", F.lit(alias).alias("alias"))
    rows = base.select("t", "id", "alias", steps_from(F.col("t"), F.col("id"), F.col("alias")).alias("ts")).orderBy("id")
    assert [r.ts for r in rows.collect()] == [t.to_pydatetime() for t in expected]
    late = rows.withColumn("back", steps_between(F.col("t"), F.col("ts") + F.expr("interval 3 minutes"), F.col("alias")))
    assert all(r.back == r.id for r in late.collect())
    literal = rows.select(
        steps_from(F.col("ts"), -F.col("id"), alias).alias("t0"), steps_from(F.col("t"), F.col("id"), alias).alias("t1"), "ts", steps_between(F.col("t"), F.col("ts"), alias).alias("k"), "id"
    )
    assert all(r.t0 == expected[0].to_pydatetime() and r.t1 == r.ts and r.k == r.id for r in literal.collect())


def test_weekends_roll_to_business_days(spark):
    saturday = F.lit("2024-01-13").cast("timestamp")
    row = spark.range(1).select(*[F.dayofmonth(steps_from(saturday, F.lit(k), "B")).alias(f"k{k + 1}") for k in (-1, 0, 1, 2)]).first()
    assert tuple(row) == (12, 15, 15, 16)


def test_each_series_has_its_own_frequency(spark):
    import pandas as pd

    rows = []
    for sid, alias, start in (("b", "B", "2024-01-10"), ("me", "ME", "2023-10-31"), ("h", "h", "2024-01-01"), ("bms", "BMS", "2024-01-01")):
        for i, t in enumerate(pd.date_range(start, periods=12, freq=alias)):
            rows.append((sid, t.to_pydatetime(), None if i == 5 else float(i)))
    rows.append(("odd", pd.Timestamp("2024-01-01").to_pydatetime(), 1.0))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, y double")
    panel, diagnostics, violations = clean.regularize_and_impute(df, None, method="linear")
    found = {}
    for r in panel.collect():
        found.setdefault(r.series_id, {})[r.ts] = r.y
    for sid in ("b", "me", "h", "bms"):
        expected = {t: float(i) for i, (s, t, _) in enumerate([r for r in rows if r[0] == sid])}
        assert found[sid] == pytest.approx(expected)
    assert {r.series_id for r in violations.collect()} == {"odd"}


def test_observations_beside_the_grid_are_violations(spark):
    import pandas as pd

    rows = [("a", t.to_pydatetime(), 1.0) for t in pd.date_range("2024-02-29", periods=4, freq="ME")]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, y double")
    ok, _, none = clean.regularize_and_impute(df, "ME", method="linear")
    assert ok.count() == 4 and none.count() == 0
    _, _, bad = clean.regularize_and_impute(df, "MS", method="linear")
    assert "not on the grid" in bad.first().reason
