"""Order-dependent work on panels without ever putting a whole series into one task.

A panel row is (series_id, ts, y) plus `pos`, its 0-based chronological index, and `n`, the length of
its series. Rows of a series are cut into blocks of `BLOCK_ROWS` consecutive positions, and
(series_id, block) is the key all window work, joins and fills are distributed on:

* bounded frames (lags, rolling windows): neighbouring rows are copied into the next block (`framed`);
* unbounded frames (fills, running sums): one summary row per block is scanned, then joined back;
* per-series statistics: partial aggregates, joined back on (series_id, block) so that a series that
  owns a third of the table is spread over as many join keys as it has blocks (`attach`);
* exact quantiles: sketch bracket first, then exact ranks inside the bracket only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("series_id",)
BLOCK_ROWS = 65_536
SHORT_ROWS = 20_000  # series up to this length are sorted as one array for exact quantiles


def _div(size: int) -> Column:
    return F.floor(F.col("pos") / F.lit(size)).cast("long")


def number_rows(
    df: DataFrame,
    order: Sequence[str] = ("ts",),
    keys: Sequence[str] = KEY,
    bucket_seconds: int | None = 3600,
) -> DataFrame:
    """Add `pos` (0-based rank in `order` within keys) and `n` (rows per key).

    Two levels: rows are ranked inside (key, time bucket), and the bucket's offset comes from a
    running sum over bucket counts, so no task sorts a whole series. `bucket_seconds=None` ranks per
    key directly; use it for roll-ups, where the calendar bounds the rows of a series. The first order
    column is a timestamp, or a number that grows with the rows (buckets of BLOCK_ROWS values).
    """
    keys = list(keys)
    if bucket_seconds is None:
        w = Window.partitionBy(*keys)
        return df.withColumns(
            {"pos": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "n": F.count(F.lit(1)).over(w)}
        )
    timed = df.schema[order[0]].dataType.typeName() == "timestamp"
    lead = F.unix_seconds(F.col(order[0])) / F.lit(bucket_seconds) if timed else F.col(order[0]) / F.lit(BLOCK_ROWS)
    part = df.withColumn("_b", F.floor(lead))
    by_time = Window.partitionBy(*keys).orderBy("_b")
    offsets = (
        part.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_c").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
            F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return (
        part.join(offsets, [*keys, "_b"])
        .withColumn("pos", (F.col("_o") + local).cast("long"))
        .drop("_b", "_o")
    )


def halo(panel: DataFrame, back: int = 0, fwd: int = 0, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Assign rows to blocks (`_blk`), copying rows within `back` / `fwd` of a border to the neighbour.

    `_own` is false on the copies.
    """
    size = max(size or BLOCK_ROWS, back, fwd)
    blk, off = _div(size), F.col("pos") % F.lit(size)
    homes = [F.struct(blk.alias("blk"), F.lit(True).alias("own"))]
    if back:
        homes.append(
            F.when(
                (off >= size - back) & (F.col("pos") - off + size < F.col("n")),
                F.struct((blk + 1).alias("blk"), F.lit(False).alias("own")),
            )
        )
    if fwd:
        homes.append(F.when((off < fwd) & (blk > 0), F.struct((blk - 1).alias("blk"), F.lit(False).alias("own"))))
    if len(homes) == 1:
        return panel.withColumns({"_blk": blk, "_own": F.lit(True)})
    spread = panel.withColumn("_h", F.explode(F.array_compact(F.array(*homes))))
    return spread.withColumns({"_blk": F.col("_h.blk"), "_own": F.col("_h.own")}).drop("_h")


def framed(
    panel: DataFrame,
    build: Callable[[object], Mapping[str, Column]],
    back: int = 0,
    fwd: int = 0,
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Add window columns that look at most `back` rows behind and `fwd` rows ahead.

    `build(w)` returns the columns over window `w` (per block, ordered by pos).
    """
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    return halo(panel, back, fwd, keys).withColumns(dict(build(w))).where(F.col("_own")).drop("_own", "_blk")


def per_series(panel: DataFrame, *aggs: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Partial-aggregated statistics per series; keeps `n` so they can be attached again."""
    return panel.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def attach(
    panel: DataFrame,
    stats: DataFrame,
    extra: Sequence[str] = (),
    keys: Sequence[str] = KEY,
    how: str = "inner",
) -> DataFrame:
    """Join per-series rows (with `n`) onto the panel on (keys, block[, extra]).

    A statistics row is copied once per block of its own series, so hot series join on many keys.
    """
    on = [*keys, "_blk", *extra]
    spread = stats.withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(BLOCK_ROWS)).cast("long")))
    ).drop("n")
    return panel.withColumn("_blk", _div(BLOCK_ROWS)).join(spread, on, how).drop("_blk")


def nearest_valid(
    panel: DataFrame, value: str = "y", keys: Sequence[str] = KEY, carry: Sequence[str] = ()
) -> DataFrame:
    """Add prev_pos/prev_y (last valid at or before) and next_pos/next_y (first valid at or after).

    Columns named in `carry` travel with the valid point as prev_<c> / next_<c>.
    """
    keys = list(keys)
    point = F.when(
        F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v"), *[F.col(c) for c in carry])
    )
    cut = panel.withColumn("_blk", _div(BLOCK_ROWS)).withColumn("_pt", point)
    scan = Window.partitionBy(*keys).orderBy("_blk")
    borders = (
        cut.groupBy(*keys, "_blk")
        .agg(F.min("_pt").alias("_f"), F.max("_pt").alias("_l"))
        .select(
            *keys,
            "_blk",
            F.last("_l", True).over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_f", True).over(scan.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
    )
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    prev = F.coalesce(F.last("_pt", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    nxt = F.coalesce(F.first("_pt", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    out = cut.join(borders, [*keys, "_blk"]).withColumns({"_p": prev, "_n": nxt})
    return out.withColumns(
        {
            "prev_pos": F.col("_p.p"),
            "prev_y": F.col("_p.v"),
            "next_pos": F.col("_n.p"),
            "next_y": F.col("_n.v"),
            **{f"prev_{c}": F.col(f"_p.{c}") for c in carry},
            **{f"next_{c}": F.col(f"_n.{c}") for c in carry},
        }
    ).drop("_blk", "_pt", "_before", "_after", "_p", "_n")


def running_sum(panel: DataFrame, value: str, out: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Cumulative sum along pos (NULL counts as 0): block totals are scanned, then added locally."""
    keys = list(keys)
    cut = panel.withColumn("_blk", _div(BLOCK_ROWS))
    scan = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*keys, "_blk")
        .agg(F.sum(value).alias("_s"))
        .select(*keys, "_blk", F.coalesce(F.sum("_s").over(scan), F.lit(0)).alias("_base"))
    )
    w = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(base, [*keys, "_blk"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0)))
        .drop("_blk", "_base")
    )


# The order statistic at 0-based index count // 2, as (probability, rank rule).
UPPER_MEDIAN = (0.5, lambda cnt: F.floor(cnt / 2).cast("double"))


def exact_quantiles(panel: DataFrame, value: str, probs: Mapping[str, object], keys: Sequence[str] = KEY) -> DataFrame:
    """Linear-interpolated exact quantiles per series, one column per name in `probs`, plus `n`.

    A probability may also be a pair (probability, rank rule over the count), e.g. `UPPER_MEDIAN`.
    Series of up to SHORT_ROWS rows are sorted as one bounded array. For longer ones a mergeable sketch
    brackets each target rank, rows below the bracket are only counted, and exact ranks are taken among
    the distinct values inside.
    """
    rules = {k: p if isinstance(p, tuple) else (p, lambda cnt, q=p: F.lit(float(q)) * (cnt - 1)) for k, p in probs.items()}
    long = F.col("n") > SHORT_ROWS
    return _array_quantiles(panel.where(~long), value, rules, list(keys)).unionByName(
        _bracketed_quantiles(panel.where(long), value, rules, list(keys))
    )


def _array_quantiles(panel: DataFrame, value: str, rules: Mapping[str, tuple], keys: list[str]) -> DataFrame:
    packed = per_series(panel, F.sort_array(F.collect_list(value)).alias("_a"), keys=keys)
    cnt = F.size("_a")

    def pick(rule) -> Column:
        r = rule(cnt)
        lo, hi = F.get("_a", F.floor(r).cast("int")), F.get("_a", F.ceil(r).cast("int"))
        return F.when(cnt > 0, lo + (hi - lo) * (r - F.floor(r)))

    return packed.select(*keys, "n", *[pick(rule).alias(k) for k, (_, rule) in rules.items()])


def _bracketed_quantiles(panel: DataFrame, value: str, rules: Mapping[str, tuple], keys: list[str]) -> DataFrame:
    names = list(rules)
    v = F.col(value)
    margin = 5e-4
    points = [min(max(rules[k][0] + s, 0.0), 1.0) for k in names for s in (-margin, margin)]
    sketch = F.percentile_approx(value, F.array(*[F.lit(x) for x in points]), 10_000)
    stats = per_series(
        panel,
        F.count(value).alias("_cnt"),
        F.min(value).alias("_mn"),
        F.max(value).alias("_mx"),
        sketch.alias("_sk"),
        keys=keys,
    )
    spans = []
    for i, k in enumerate(names):
        lo = F.col("_mn") if points[2 * i] == 0.0 else F.col("_sk")[2 * i]
        hi = F.col("_mx") if points[2 * i + 1] == 1.0 else F.col("_sk")[2 * i + 1]
        spans.append(F.struct(F.lit(k).alias("k"), lo.alias("lo"), hi.alias("hi"), rules[k][1](F.col("_cnt")).alias("r")))
    stats = stats.select(*keys, "n", F.array(*spans).alias("_spans"))
    marked = attach(panel.where(v.isNotNull()).select(*keys, "pos", value), stats, keys=keys)
    placed = (
        marked.select(*keys, v.alias("_v"), F.explode("_spans").alias("_s"))
        .where(F.col("_v") <= F.col("_s.hi"))
        .select(
            *keys,
            F.col("_s.k").alias("_k"),
            F.col("_s.r").alias("_r"),
            F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v")).alias("_v"),  # NULL group = rows below the bracket
        )
        .groupBy(*keys, "_k", "_r", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first())
    ranked = placed.withColumn("_hi", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    floor_r, ceil_r = F.floor("_r"), F.ceil("_r")

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= r) & (r <= F.col("_hi")), F.col("_v")))

    picked = ranked.groupBy(*keys, "_k", "_r").agg(at(floor_r).alias("_a"), at(ceil_r).alias("_z"))
    value_at = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_r") - floor_r)
    wide = picked.withColumn("_q", value_at).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(k) for k in names]
    )
    return stats.select(*keys, "n").join(wide, keys, "left")
