"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target of words and with it a rate: whole copies of each document and, for the fractional rest, an
inclusion probability. The flight phase of the cube method moves these probabilities through the null space of two
constraints, documents and words, so that both totals of a source stay exactly in place until at most two documents are
undecided. It runs in buckets of a source; what a bucket leaves undecided is gathered level by level, and only the last
few documents of a source are landed by the rounding that misses the word total least.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, free_names, staged

EPS = 1e-9


def word_count(text: str = "text") -> Column:
    """Words of a text; none for a missing one."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, units, target) from rows of (source, size, units).

    Weights repeat over the sources by code point, null last. Targets share `share` of all words by weight, stop at `most`
    times the source's words, and the excess is shared again by weight. The sources to be stopped come first in the order of
    size by weight, so one running sum finds them. The windows see one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("units").alias("units"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    goal = F.lit(share) * F.sum("source_size").over(everything)
    left = goal - F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumns({"level": left / weight_left, "turn": F.row_number().over(by_ratio)})
    open_turn = F.when(F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"), F.col("turn"))
    level = F.first(F.when(F.col("turn") == F.col("first_open"), F.col("level")), ignorenulls=True).over(everything)
    leveled = leveled.withColumn("first_open", F.min(open_turn).over(everything)).withColumn("water", level)
    stopped = F.col("first_open").isNull() | (F.col("turn") < F.col("first_open"))
    target = F.when(stopped, F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * F.col("water"))
    return leveled.select("source", "source_size", "units", target.cast("double").alias("target"))


def flight(count: list[float], size: list[float], psi: list[float], rng: random.Random) -> list[int]:
    """Move psi in place until less than three units are undecided; returns those.

    Three undecided units have a direction in which both totals stay; a random step along it that keeps the
    expectation decides at least one of them.
    """
    active: list[int] = []
    for k in range(len(psi)):
        if not EPS < psi[k] < 1 - EPS:
            psi[k] = float(round(psi[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        i, j, l = active  # noqa: E741
        u = (count[j] * size[l] - count[l] * size[j], count[l] * size[i] - count[i] * size[l], count[i] * size[j] - count[j] * size[i])
        if u == (0.0, 0.0, 0.0):  # equal ratios: two units are enough
            u = (count[j], -count[i], 0.0)
        up = down = float("inf")
        for m, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - psi[m]) / d), min(down, psi[m] / d)
            elif d < 0:
                up, down = min(up, psi[m] / -d), min(down, (1 - psi[m]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        rest = []
        for m, d in zip(active, u):
            psi[m] += step * d
            if EPS < psi[m] < 1 - EPS:
                rest.append(m)
            else:
                psi[m] = float(round(psi[m]))
        active = rest
    return active


def land(size: list[float], psi: list[float], left: list[int]) -> None:
    """Decide the last (at most two) units so that the word total is missed least."""
    best = min(range(1 << len(left)), key=lambda bits: (abs(sum(size[k] * ((bits >> b & 1) - psi[k]) for b, k in enumerate(left))), bits))
    for b, k in enumerate(left):
        psi[k] = float(best >> b & 1)


def _fly(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "digest"], na_position="first").reset_index(drop=True)
        rng = random.Random(zlib.crc32(repr((seed, level, *[None if pd.isna(k) else k if isinstance(k, str) else int(k) for k in key])).encode()))
        order = list(range(len(rows)))
        rng.shuffle(order)
        count, size, psi = (rows[c].to_numpy(float)[order].tolist() for c in ("units", "size", "psi"))
        left = flight(count, size, psi, rng)
        if last:
            land(size, psi, left)
        out = np.empty(len(rows))
        out[order] = psi
        return rows.assign(psi=out)

    return run


UNITS = "source string, doc_id long, digest long, size double, units double, psi double, bucket long"


def select_units(spark: SparkSession, units: DataFrame, most_units: int, bucket: int, seed: int) -> DataFrame:
    """Decide units of (source, doc_id, digest, size, units, psi, bucket): psi becomes 0 or 1.

    A source starts in buckets of about `bucket` units; each leaves two undecided at most, so `bucket // 2` buckets meet in one
    of the next level. The number of levels follows from the units of the largest source.
    """
    done: list[DataFrame] = []
    buckets, level = -(-most_units // bucket), 0
    while True:
        last = buckets <= 1
        flown = units.groupBy("source", "bucket").applyInPandas(_fly(seed, level, last), UNITS)
        if last:
            done.append(flown)
            break
        flown = staged(spark, flown, "flight")
        done.append(flown.filter("psi = 0 OR psi = 1"))
        units = flown.filter("psi > 0 AND psi < 1").withColumn("bucket", F.floor(F.col("bucket") / (bucket // 2)))
        buckets, level = -(-buckets // (bucket // 2)), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("source", "doc_id", "digest", F.col("psi").cast("long").alias("extra"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    bucket: int = 4096,
    seed: int = 20,
) -> DataFrame:
    """All rows of docs with size, source_size, target and copies, how often the mix takes the row (0 to ceil(most)).

    A missing text has size 0; a missing source is a source of its own, last in the order. Rows equal in doc_id, text and
    source are decided together. Sources without words get the target 0. Empty tables stay empty; columns of docs named like
    a result column are replaced. Draws depend on seed, source and rows only, so reruns agree.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "digest", "extra", "units")
    sized = docs.withColumn("size", word_count()).withColumn("digest", F.xxhash64("text", F.lit(3)))
    units = sized.groupBy("source", "doc_id", "digest").agg(F.sum("size").alias("size"), F.count("*").alias("units"))
    units = staged(spark, units.select("source", F.col("doc_id").cast("long"), "digest", "size", "units"), "units")
    counts = units.groupBy("source").agg(F.count("*").alias("n_units"))
    plan = source_targets(units, weights, share, most)
    plan = plan.alias("p").join(counts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.*", "n_units")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = staged(spark, plan.withColumn("rate", rate), "plan")
    top = plan.agg(F.max("n_units")).first()[0] or 0
    placed = units.alias("u").join(plan.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source")))
    rest = F.col("rate") - F.floor("rate")
    spread = F.pmod(F.xxhash64("u.doc_id", "digest", F.lit(seed)), F.ceil(F.col("n_units") / bucket)).alias("bucket")
    placed = placed.select("u.source", "doc_id", "digest", F.col("size").cast("double"), F.col("u.units").cast("double"), rest.alias("psi"), spread)
    chosen = select_units(spark, placed, top, bucket, seed)
    same = lambda a, b, cols: _all([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    joined = sized.alias("d").join(chosen.alias("k"), same("d", "k", ("doc_id", "digest", "source"))).select("d.*", "extra")
    joined = joined.alias("d").join(plan.alias("p"), same("d", "p", ("source",)))
    copies = (F.floor("rate") + F.col("extra")).cast("long").alias("copies")
    return joined.select(*[F.col(f"d.{c}") for c in docs.columns], F.col("d.size"), "source_size", "target", copies)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as the mix takes it."""
    (copy,) = free_names(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
