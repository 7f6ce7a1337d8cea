"""Hashed draws: repeatable, independent of partitioning, and within their bounds."""

import pytest

from tidepanel.operators import attribution as at, forecast as fc, scenario as sc


def test_augmented_panel(spark, panel):
    y = [20.0 + (i % 7) + 0.1 * i for i in range(56)]
    p = panel({"s": y, "low": [0.0, 1.0] * 20})
    one = sorted(map(str, sc.augment(p, 7, count=2, seed=3, freq="D").collect()))
    two = sorted(map(str, sc.augment(p.repartition(3), 7, count=2, seed=3, freq="D").collect()))
    other = sorted(map(str, sc.augment(p, 7, count=2, seed=4, freq="D").collect()))
    assert one == two and one != other and len(one) == 2 * (56 + 40)
    rows = sc.augment(p, 7, count=2, seed=3).collect()
    assert min(r.y for r in rows) >= 0.0
    mine = [r.y for r in rows if r.source_id == "s"]
    assert sum(mine) / len(mine) == pytest.approx(sum(y) / len(y), rel=0.1)


def test_permutation_importance(panel):
    p = panel({"s": [1.0, 5.0, 2.0, 8.0, 3.0, 9.0]})
    first = {r.pos: r.importance for r in at.permutation(p, repeats=4, predict=fc.linear_trend).collect()}
    again = {r.pos: r.importance for r in at.permutation(p.repartition(4), repeats=4, predict=fc.linear_trend).collect()}
    assert first == pytest.approx(again) and sum(first.values()) == pytest.approx(1.0)
    last = {r.pos: r.importance for r in at.permutation(p, repeats=4).collect()}
    assert last[5] == pytest.approx(1.0)  # a last-value forecast depends on the last point only
