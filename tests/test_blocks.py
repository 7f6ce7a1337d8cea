"""Blocked execution must not change any result, whatever the block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import analysis as an, blocks as bl, clean, scale, windows as wn


def wavy(n, seed=1):
    rng = np.random.default_rng(seed)
    return (10 * np.sin(np.arange(n) / 3) + rng.normal(size=n)).round(3).tolist()


@pytest.fixture(params=[3, 7, 65_536])
def block(request, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK_ROWS", request.param)
    monkeypatch.setattr(clean, "BLOCK_ROWS", request.param)
    return request.param


def test_number_rows(spark, panel, block):
    p = panel({"a": wavy(50), "b": [1.0]}).drop("pos", "n")
    for seconds in (None, 1, 200_000):
        got = {(r.series_id, r.ts): (r.pos, r.n) for r in bl.number_rows(p, bucket_seconds=seconds).collect()}
        want = {(r.series_id, r.ts): (r.pos, r.n) for r in panel({"a": wavy(50), "b": [1.0]}).collect()}
        assert got == want


def test_framed_windows(panel, values_of, block):
    y = wavy(40)
    p = panel({"a": y})
    lag = values_of(bl.framed(p, lambda w: {"l": F.lag("y", 5).over(w), "f": F.lead("y", 2).over(w)}, back=5, fwd=2), "l")["a"]
    assert lag == [None] * 5 + y[:-5]
    roll = values_of(wn.rolling_features(p, [4]), "rolling_mean_4")["a"]
    assert roll[:3] == [None] * 3
    assert roll[3:] == pytest.approx([np.mean(y[i - 3 : i + 1]) for i in range(3, 40)])


def test_fills_and_runs(panel, values_of, block):
    y = [None, 1.0, None, None, 4.0] + [None] * 9 + [7.0, None]
    p = panel({"a": y, "b": [None, None, 3.0]})
    assert values_of(clean.forward_fill(p), "y")["a"] == [None, 1.0, 1.0, 1.0] + [4.0] * 10 + [7.0, 7.0]
    assert values_of(clean.backward_fill(p), "y")["a"] == [1.0, 1.0, 4.0, 4.0, 4.0] + [7.0] * 10 + [None]
    x = [i for i, v in enumerate(y) if v is not None]
    assert values_of(clean.linear(p), "y")["a"] == pytest.approx(np.interp(range(16), x, [y[i] for i in x]))
    assert {r.series_id: r.max_gap for r in clean.missing_runs(p).collect()} == {"a": 9, "b": 2}


def test_running_sum_inverts_differences(panel, values_of, block):
    y = wavy(30)
    d = scale.difference(panel({"a": y}))
    firsts = bl.per_series(d, F.min_by("y", "pos").alias("first_y"))
    assert values_of(scale.undifference(d, firsts), "restored")["a"] == pytest.approx(y)


def test_attach_reaches_every_row(panel, block):
    p = panel({"a": wavy(25), "b": wavy(4)})
    s = bl.per_series(p, F.sum("y").alias("s"))
    assert bl.attach(p, s).count() == 29


@pytest.mark.parametrize("short", [2, 20_000])
def test_exact_quantiles(panel, block, short, monkeypatch):
    monkeypatch.setattr(bl, "SHORT_ROWS", short)
    y = wavy(101) + [5.0] * 30
    p = panel({"a": y, "b": [2.0, 1.0], "c": [9.0]})
    q = {r.series_id: r for r in bl.exact_quantiles(p, "y", {"lo": 0.1, "mid": 0.5, "top": 1.0, "up": bl.UPPER_MEDIAN}).collect()}
    assert q["a"].lo == pytest.approx(np.quantile(y, 0.1))
    assert q["a"].mid == pytest.approx(np.median(y))
    assert q["a"].top == max(y)
    assert q["a"].up == sorted(y)[len(y) // 2]
    assert (q["b"].mid, q["b"].up, q["c"].lo) == (1.5, 2.0, 9.0)


def test_autocorrelation_blocks(panel, block):
    y = np.array(wavy(60))
    got = {r.lag: r for r in an.acf(panel({"a": y.tolist()}), 20).collect()}
    for k in (1, 5, 20):
        assert got[k].pearson == pytest.approx(np.corrcoef(y[:-k], y[k:])[0, 1])
        d = y - y.mean()
        assert got[k].biased == pytest.approx((d[:-k] * d[k:]).sum() / (len(y) * y.var()))


def test_hot_series_is_spread(panel, monkeypatch):
    """No (series, block) holds more than block + halo rows."""
    monkeypatch.setattr(bl, "BLOCK_ROWS", 10)
    h = bl.halo(panel({"hot": wavy(95), "cold": wavy(3)}), back=2, fwd=1)
    sizes = [r["count"] for r in h.groupBy("series_id", "_blk").count().collect()]
    assert max(sizes) <= 13 and len(sizes) == 11


def test_partition_invariance(spark, panel):
    p = panel({"a": wavy(80), "b": wavy(33, 2)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    res = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(map(str, an.analyze(p, max_lag=20).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert res[0] == res[1]
