"""Targets against the iterated rule, balance of the cube method, odd rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Weights by code point, null last; what a stopped source can't take is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), list(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def documents(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 6 + ["b", "é", "zz", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_and_taken_words(spark):
    docs, rows = documents(spark)
    mixed = mixing.mix(spark, docs, bucket=64)
    found = mixed.toPandas()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    expected = brute_targets(sizes)
    assert len(found) == len(rows)
    for source, part in found.groupby(found["source"].fillna("null")):
        key = None if source == "null" else source
        assert part["target"].iloc[0] == pytest.approx(expected[key])
        assert part["source_size"].iloc[0] == sizes[key]
        assert abs((part["size"] * part["copies"]).sum() - expected[key]) <= 60
        assert part["copies"].max() <= 2
    again = mixing.mix(spark, docs.repartition(7, "source"), bucket=64).toPandas()
    assert dict(zip(found.doc_id, found.copies)) == dict(zip(again.doc_id, again.copies))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "a b\x0bc d", "a"), (3, "a b\x0bc d", "a"), (3, "other", "a"), (None, "no id", "b"), (5, "x " * 9000, "c")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, target int")
    found = mixing.mix(spark, docs)
    assert found.columns.count("target") == 1
    sizes = sorted((r.doc_id or 0, r["size"]) for r in found.collect())
    assert sizes == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 4), (3, 4), (5, 9000)]
    assert len({r.copies for r in found.filter("doc_id = 3 AND size = 4").collect()}) == 1
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    repeated = mixing.repeat_rows(found, docs.drop("target").columns)
    assert repeated.count() == found.agg(F.sum("copies")).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=80), st.floats(0.01, 0.99), st.integers(0, 9))
def test_flight_keeps_both_totals(sizes, share, seed):
    psi = [share] * len(sizes)
    left = mixing.flight([1.0] * len(sizes), [float(s) for s in sizes], psi, random.Random(seed))
    assert len(left) <= 2
    assert sum(psi) == pytest.approx(share * len(sizes), abs=1e-5)
    assert sum(p * s for p, s in zip(psi, sizes)) == pytest.approx(share * sum(sizes), abs=1e-3)
    mixing.land([float(s) for s in sizes], psi, left)
    assert set(psi) <= {0.0, 1.0}
    assert abs(sum(p * s for p, s in zip(psi, sizes)) - share * sum(sizes)) <= max(sizes) + 1e-3


def test_flight_draws_without_bias():
    hits = [0] * 6
    for seed in range(2000):
        psi = [0.3] * 6
        left = mixing.flight([1.0] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], psi, random.Random(seed))
        rng = random.Random(seed + 1)
        for k in left:
            psi[k] = float(rng.random() < psi[k])
        hits = [h + p for h, p in zip(hits, psi)]
    assert all(0.25 < h / 2000 < 0.35 for h in hits)
