"""Cleaning, gap filling, windows, features and scaling on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import clean, folds, scale, spline, windows as wn
from tidepanel.operators.blocks import attach, number_rows, per_series
from tidepanel.operators.smoothing import smoothing_spline
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.session import table

ED = f"WITH {pn.EVENTS_DAILY}, panel AS (SELECT * FROM events_daily)"
EH = f"WITH {pn.EVENTS_HOURLY}, panel AS (SELECT * FROM events_hourly)"
OD = f"WITH {pn.ORDERS_DAILY}, panel AS (SELECT * FROM orders_daily)"
ER = f"WITH {pn.EVENTS_RAW}, panel AS (SELECT * FROM events_raw)"
# Hourly grid with the natural gaps of the events table.
GRID = (
    f"WITH {pn.EVENTS_HOURLY}, g AS (SELECT series_id, unnest(generate_series(mn, mx, INTERVAL 1 HOUR)) AS ts FROM"
    " (SELECT series_id, min(ts) AS mn, max(ts) AS mx FROM events_hourly GROUP BY 1)),"
    " reg AS (SELECT g.series_id, g.ts, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos,"
    " count(*) OVER (PARTITION BY g.series_id) AS n, h.y FROM g LEFT JOIN events_hourly h ON h.series_id = g.series_id AND h.ts = g.ts)"
)
# Nearest valid neighbours of every grid row.
NEAR = (
    GRID + ", nb AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,"
    " last_value(y IGNORE NULLS) OVER b AS py, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,"
    " first_value(y IGNORE NULLS) OVER f AS ny FROM reg"
    " WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    " f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
    " lin AS (SELECT series_id, ts, pos, n, coalesce(y, (ny - py) / (np - pp) * (pos - pp) + py, py, ny) AS y FROM nb)"
)


def holes(spark, sf):
    """Hourly event sums on the full hour grid; hours without events are missing."""
    return clean.regularize(pn.events_hourly(spark, sf), "h")


def out(df, *cols, digits=6):
    return df.select("series_id", "pos", *[F.round(c, digits).alias(c) for c in cols])


# ---- validation ------------------------------------------------------------------------------


@query(
    "p01_drop_null_targets",
    "WITH raw AS (SELECT event_type AS series_id, event_id AS pos, CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL"
    " ELSE value END AS y FROM events)"
    " SELECT series_id, count(y) AS kept, CAST(CASE WHEN count(y) = 0 THEN 'target column contains only null values' ELSE '' END AS VARCHAR)"
    " AS reason FROM raw GROUP BY 1",
)
def p01_drop_null_targets(spark, sf):
    ev = table(spark, sf, "events")
    hide = (F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)
    raw = ev.select(F.col("event_type").alias("series_id"), F.when(~hide, F.col("value")).alias("y"))
    rows, bad = clean.drop_null_targets(raw)
    kept = rows.groupBy("series_id").agg(F.count("y").alias("kept"))
    return kept.join(bad, "series_id", "full").select(
        "series_id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("reason", F.lit("")).alias("reason")
    )


@query(
    "p02_target_type_check",
    "WITH raw AS (SELECT event_id AS pos, event_type AS series_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'n/a' ELSE"
    " CAST(value AS VARCHAR) END AS raw FROM events)"
    " SELECT series_id, CASE WHEN raw = 'true' THEN 'target contains boolean value' WHEN raw = 'n/a' THEN"
    " 'target contains non-numeric value' ELSE 'ok' END AS reason, count(*) AS rows, min(pos) AS first_row FROM raw GROUP BY 1, 2",
)
def p02_target_type_check(spark, sf):
    ev = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "n/a").otherwise(F.col("value").cast("string"))
    raw = ev.select(F.col("event_id").alias("pos"), F.col("event_type").alias("series_id"), text.alias("raw"))
    good, bad = clean.check_target(raw)
    both = good.select("series_id", "pos", F.lit("ok").alias("reason")).unionByName(bad)
    return both.groupBy("series_id", "reason").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_row"))


@query(
    "p04_validate_series",
    GRID + ", k AS (SELECT *, CASE WHEN series_id = 'view' AND pos % 2 = 0 THEN NULL WHEN series_id = 'click' THEN 5.0 ELSE y END AS v FROM reg),"
    " runs AS (SELECT series_id, max(c) AS g FROM (SELECT series_id, grp, count(*) AS c FROM (SELECT series_id, pos - row_number() OVER"
    " (PARTITION BY series_id ORDER BY pos) AS grp FROM k WHERE v IS NULL) GROUP BY 1, 2) GROUP BY 1),"
    " st AS (SELECT k.series_id, count(*) AS n, count(v) AS c, stddev_pop(v) AS sd FROM k GROUP BY 1)"
    " SELECT series_id, (1.0 - CAST(c AS DOUBLE) / n <= 0.30 AND coalesce(g, 0) <= 24 AND sd <> 0 AND n >= 100) AS ok,"
    " concat_ws('; ', CASE WHEN 1.0 - CAST(c AS DOUBLE) / n > 0.30 THEN printf('target missing ratio %.4f exceeds limit 0.3000', 1.0 - CAST(c AS DOUBLE) / n) END,"
    " CASE WHEN g > 24 THEN printf('target max missing gap %d exceeds limit 24', g) END,"
    " CASE WHEN sd = 0 THEN 'target is constant (zero variance)' END,"
    " CASE WHEN n < 100 THEN printf('series length %d is below minimum 100', n) END) AS reasons FROM st LEFT JOIN runs USING (series_id)",
)
def p04_validate_series(spark, sf):
    y = F.when((F.col("series_id") == "view") & (F.col("pos") % 2 == 0), None).when(F.col("series_id") == "click", 5.0).otherwise(F.col("y"))
    res = clean.validate_series(holes(spark, sf).withColumn("y", y), min_length=100)
    return res.select("series_id", "ok", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "p12_clean_values_mask",
    GRID + " SELECT series_id, pos, coalesce(y, 0.0) AS value, y IS NOT NULL AS valid FROM reg",
)
def p12_clean_values_mask(spark, sf):
    from tidepanel.operators.context import clean_values_and_mask

    return clean_values_and_mask(holes(spark, sf)).select("series_id", "pos", "value", "valid")


@query(
    "p19_normalize_ids",
    "WITH raw AS (SELECT CASE event_id % 4 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE event_type END AS id FROM events)"
    " SELECT coalesce(nullif(trim(id), ''), 'series_0') AS series_id, count(*) AS rows FROM raw GROUP BY 1",
)
def p19_normalize_ids(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(k == 1, "  ").when(k == 3, F.col("event_type"))
    df = clean.normalize_ids(table(spark, sf, "events").select(raw.alias("series_id")))
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))


# ---- grouping, duplicates, grid --------------------------------------------------------------


@query(
    "a01_group_to_series",
    "SELECT coalesce(event_type, 'series_0') AS series_id, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,"
    " strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY 1",
)
def a01_group_to_series(spark, sf):
    df = clean.normalize_ids(table(spark, sf, "events").withColumnRenamed("event_type", "series_id"))
    g = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return g.select("series_id", "rows", pn.stamp("a", "first_ts"), pn.stamp("z", "last_ts"))


@query(
    "a02_collapse_duplicates",
    "WITH d AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS y FROM events)"
    f" SELECT series_id, {pn.sql_stamp()}, round(avg(y), 6) AS y, count(*) - 1 AS merged FROM d GROUP BY series_id, d.ts",
)
def a02_collapse_duplicates(spark, sf):
    y = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    raw = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), y.alias("y"))
    return clean.collapse_duplicates(raw).select("series_id", pn.stamp(), F.round("y", 6).alias("y"), "merged")


@query("j03_regular_grid", GRID + f" SELECT series_id, {pn.sql_stamp()}, pos, y FROM reg")
def j03_regular_grid(spark, sf):
    return holes(spark, sf).select("series_id", pn.stamp(), "pos", "y")


@query(
    "w14_keep_first_dedupe",
    "SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, y FROM (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,"
    " value AS y, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def w14_keep_first_dedupe(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("y"), "event_id"
    )
    return clean.keep_first(raw, "event_id").select("series_id", pn.stamp(), "y")


@query(
    "w11_longest_gap",
    GRID + " SELECT r.series_id, coalesce(max(g), 0) AS max_gap FROM (SELECT DISTINCT series_id FROM reg) r LEFT JOIN (SELECT series_id, grp,"
    " count(*) AS g FROM (SELECT series_id, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS grp FROM reg WHERE y IS NULL)"
    " GROUP BY 1, 2) x ON x.series_id = r.series_id GROUP BY 1",
)
def w11_longest_gap(spark, sf):
    return clean.missing_runs(holes(spark, sf))


# ---- gap filling -----------------------------------------------------------------------------


@query("w04_forward_fill", NEAR + " SELECT series_id, pos, py AS y FROM nb")
def w04_forward_fill(spark, sf):
    return clean.forward_fill(holes(spark, sf)).select("series_id", "pos", "y")


@query("w05_backward_fill", NEAR + " SELECT series_id, pos, ny AS y FROM nb")
def w05_backward_fill(spark, sf):
    return clean.backward_fill(holes(spark, sf)).select("series_id", "pos", "y")


@query("w06_linear_interpolation", NEAR + " SELECT series_id, pos, round(y, 6) AS y FROM lin")
def w06_linear_interpolation(spark, sf):
    return out(clean.linear(holes(spark, sf)), "y")


SEASONAL = (
    NEAR + ", ph AS (SELECT series_id, pos % 24 AS ph, avg(y) AS m FROM reg GROUP BY 1, 2)"
    " SELECT series_id, pos, round(coalesce(y, m), 6) AS y FROM reg JOIN ph USING (series_id) WHERE ph.ph = pos % 24"
)


@query("w07_seasonal_interpolation", SEASONAL)
def w07_seasonal_interpolation(spark, sf):
    return out(clean.seasonal(holes(spark, sf), 24), "y")


@query(
    "r09_impute_dispatch",
    NEAR + ", ph AS (SELECT series_id, pos % 24 AS ph, avg(y) AS m FROM reg GROUP BY 1, 2),"
    " s AS (SELECT reg.series_id, pos, coalesce(y, m) AS y FROM reg JOIN ph ON ph.series_id = reg.series_id AND ph.ph = pos % 24)"
    " SELECT 'forward_fill' AS method, series_id, count(py) AS filled, round(sum(py), 3) AS total FROM nb GROUP BY 2 UNION ALL"
    " SELECT 'backward_fill', series_id, count(ny), round(sum(ny), 3) FROM nb GROUP BY 2 UNION ALL"
    " SELECT 'linear', series_id, count(y), round(sum(y), 3) FROM lin GROUP BY 2 UNION ALL"
    " SELECT 'seasonal', series_id, count(y), round(sum(y), 3) FROM s GROUP BY 2",
)
def r09_impute_dispatch(spark, sf):
    base = holes(spark, sf)
    parts = []
    for m in ("forward_fill", "backward_fill", "linear", "seasonal"):
        parts.append(
            clean.impute(base, m, 24).groupBy("series_id").agg(F.count("y").alias("filled"), F.round(F.sum("y"), 3).alias("total"))
            .select(F.lit(m).alias("method"), "series_id", "filled", "total")
        )
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query(
    "r06_regularize_and_impute",
    NEAR + " SELECT r.series_id, o AS original_rows, n AS regular_rows, miss AS imputed, g AS max_gap, round(CAST(miss AS DOUBLE) / n, 6) AS missing_ratio,"
    " CASE WHEN miss = 0 THEN 'none' ELSE 'linear' END AS used_method, round(total, 3) AS total FROM"
    " (SELECT series_id, count(y) AS o, max(n) AS n, count(*) - count(y) AS miss FROM reg GROUP BY 1) r JOIN"
    " (SELECT series_id, coalesce(max(CASE WHEN y IS NULL THEN pos - coalesce(pp, -1) END), 0) AS g FROM nb GROUP BY 1) USING (series_id) JOIN"
    " (SELECT series_id, sum(y) AS total FROM lin GROUP BY 1) USING (series_id) WHERE CAST(miss AS DOUBLE) / n <= 0.30",
)
def r06_regularize_and_impute(spark, sf):
    panel, diag, _ = clean.regularize_and_impute(pn.events_hourly(spark, sf), "h", method="linear")
    total = panel.groupBy("series_id").agg(F.round(F.sum("y"), 3).alias("total"))
    return diag.join(total, "series_id").select(
        "series_id", "original_rows", "regular_rows", "imputed", "max_gap", F.round("missing_ratio", 6).alias("missing_ratio"), "used_method", "total"
    )


# Not-a-knot cubic: the tridiagonal system for the knots' curvatures, eliminated forwards and filled in backwards.
CUBIC = (
    NEAR.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", k0 AS (SELECT series_id, pos AS x, y, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS m FROM reg WHERE y IS NOT NULL),"
    " k AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s, x - lag(x) OVER w AS g, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS r,"
    " lag(x) OVER w - lag(x, 2) OVER w AS gg, lead(x, 2) OVER w - lead(x) OVER w AS hh FROM k0 WINDOW w AS (PARTITION BY series_id ORDER BY x)),"
    " t AS (SELECT series_id, i, m, 6 * (s - r) AS rhs, 2 * (g + h) + CASE WHEN i = 1 THEN g * (1 + g / h) ELSE 0 END + CASE WHEN i = m - 2 THEN h * (1 + h / g) ELSE 0 END AS di,"
    " CASE WHEN i = m - 2 THEN g - h * (h / g) ELSE g END AS lo, CASE WHEN i = 1 THEN h - g * (g / h) ELSE h END AS up FROM k WHERE i BETWEEN 1 AND m - 2),"
    " fw AS (SELECT series_id, i, m, di, rhs, up FROM t WHERE i = 1 UNION ALL SELECT t.series_id, t.i, t.m, t.di - t.lo / fw.di * fw.up, t.rhs - t.lo / fw.di * fw.rhs, t.up FROM fw JOIN t ON t.series_id = fw.series_id AND t.i = fw.i + 1),"
    " bw AS (SELECT series_id, i, rhs / di AS c FROM fw WHERE i = m - 2 UNION ALL SELECT fw.series_id, fw.i, (fw.rhs - fw.up * bw.c) / fw.di FROM bw JOIN fw ON fw.series_id = bw.series_id AND fw.i = bw.i - 1),"
    " kc AS (SELECT k.*, CASE WHEN k.i = 0 THEN (SELECT c FROM bw b WHERE b.series_id = k.series_id AND b.i = 1) * (1 + h / hh) - (SELECT c FROM bw b WHERE b.series_id = k.series_id AND b.i = 2) * (h / hh)"
    " WHEN k.i = m - 1 THEN (SELECT c FROM bw b WHERE b.series_id = k.series_id AND b.i = k.m - 2) * (1 + g / gg) - (SELECT c FROM bw b WHERE b.series_id = k.series_id AND b.i = k.m - 3) * (g / gg) ELSE bw.c END AS c"
    " FROM k LEFT JOIN bw ON bw.series_id = k.series_id AND bw.i = k.i),"
    " sp AS (SELECT series_id, x AS x0, y AS y0, c AS c0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(c) OVER w AS c1 FROM kc WINDOW w AS (PARTITION BY series_id ORDER BY x)),"
    " ip AS (SELECT n.series_id, n.pos, n.y, (x1 - n.pos) / (x1 - x0) AS l, (n.pos - x0) / (x1 - x0) AS q, x1 - x0 AS w, y0, y1, c0, c1 FROM nb n LEFT JOIN sp ON sp.series_id = n.series_id AND sp.x0 = n.pp)"
    " SELECT series_id, pos, round(coalesce(y, l * y0 + q * y1 + ((l * l * l - l) * c0 + (q * q * q - q) * c1) * w * w / 6), 4) AS y FROM ip"
)


@query("r07_cubic_interpolation", CUBIC)
def r07_cubic_interpolation(spark, sf):
    """Not-a-knot cubic through the observed hours; checked against the knots and a dense solve in the tests."""
    return out(clean.impute(holes(spark, sf), "cubic"), "y", digits=4)


@query("r08_spline_fit")
def r08_spline_fit(spark, sf):
    panel = pn.orders_daily(spark, sf)
    fits = spline.fit(panel, strategy="curvature")
    return out(spline.fitted(panel, fits), "fitted", "slope", "residual", digits=3)


@query("y13_stl_adds_up", ED + " SELECT series_id, n, 'stl' AS method, round(sum(y), 4) AS total, true AS seasonal FROM panel GROUP BY 1, 2")
def y13_stl_adds_up(spark, sf):
    """Trend, season and rest add up to the series."""
    from tidepanel.operators import decompose

    parts = decompose.stl(pn.events_daily(spark, sf), 7)
    total = F.sum(F.col("trend") + F.col("seasonal") + F.col("resid"))
    return parts.groupBy("series_id", "n", "method").agg(F.round(total, 4).alias("total"), (F.stddev_pop("seasonal") > 0).alias("seasonal"))


# straight lines are not penalised, so the fit keeps the sum and the first moment of the data
@query("r08_pspline", OD + " SELECT series_id, n, round(sum(y) / n, 2) AS mean, round(sum(y * pos) / sum(pos), 2) AS moment FROM panel GROUP BY 1, 2")
def r08_pspline(spark, sf):
    panel = pn.orders_daily(spark, sf)
    rows = spline.fitted(panel, spline.fit(panel, strategy="pspline"))
    return rows.groupBy("series_id", "n").agg(
        F.round(F.sum("fitted") / F.col("n"), 2).alias("mean"), F.round(F.sum(F.col("fitted") * F.col("pos")) / F.sum("pos"), 2).alias("moment")
    )


# a natural spline keeps both as well; its squared residuals meet the target, or are those of the straight line
@query(
    "r08_smoothing_spline",
    OD + ", z AS (SELECT series_id, pos, n, y / avg(y) OVER (PARTITION BY series_id) AS y FROM panel)"
    " SELECT series_id, n, round(sum(y) / n, 6) AS mean, round(sum(y * pos) / sum(pos), 6) AS moment,"
    " round(least(0.1, regr_syy(y, pos) * (1 - regr_r2(y, pos)) / n), 5) AS variance FROM z GROUP BY 1, 2",
)
def r08_smoothing_spline(spark, sf):
    panel = pn.orders_daily(spark, sf)
    level = attach(panel, panel.groupBy("series_id").agg(F.max("n").alias("n"), F.avg("y").alias("_m"))).withColumn("y", F.col("y") / F.col("_m"))
    rows = smoothing_spline(level.drop("_m"), factor=0.1)
    return rows.groupBy("series_id", "n").agg(
        F.round(F.sum("fitted") / F.col("n"), 6).alias("mean"), F.round(F.sum(F.col("fitted") * F.col("pos")) / F.sum("pos"), 6).alias("moment"),
        F.round(F.sum(F.col("residual") * F.col("residual")) / F.col("n"), 5).alias("variance"),
    )


@query("r08_spline_extrapolate")
def r08_spline_extrapolate(spark, sf):
    fits = spline.fit(pn.orders_daily(spark, sf))
    return spline.extrapolate(fits, 14).withColumn("mean", F.round("mean", 2))


@query(
    "a16_summary_features",
    OD + " SELECT series_id, round(avg(y), 2) AS mean, round(stddev_pop(y), 2) AS std, min(y) AS min, max(y) AS max, true AS has_trend FROM panel GROUP BY 1",
)
def a16_summary_features(spark, sf):
    f = spline.summary_features(pn.orders_daily(spark, sf))
    return f.select(
        "series_id", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"), "min", "max",
        F.col("trend_range").isNotNull().alias("has_trend"),
    )


# ---- windows ---------------------------------------------------------------------------------


def _sql_lags(ks, auto):
    cond = "CAST(floor(n / 3) AS BIGINT)" if auto else "n"
    return ", ".join(f"CASE WHEN {k} < {cond} THEN lag(y, {k}) OVER w END AS lag_{k}" for k in ks)


def _sql_rolls(ss):
    return ", ".join(
        f"CASE WHEN pos >= {s - 1} AND {s} < floor(n / 3) THEN round({fn}(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {s - 1}"
        f" PRECEDING AND CURRENT ROW), 4) END AS {name}_{s}"
        for s in ss
        for fn, name in (("avg", "rolling_mean"), ("stddev_pop", "rolling_std"))
    )


WIN = " FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos)"


@query("w01_lag_features", ED + f" SELECT series_id, pos, {_sql_lags(wn.AUTO_LAGS, True)}" + WIN)
def w01_lag_features(spark, sf):
    df = wn.lag_features(pn.events_daily(spark, sf))
    return df.select("series_id", "pos", *[f"lag_{k}" for k in wn.AUTO_LAGS])


@query("w02_rolling_features", OD + f" SELECT series_id, pos, {_sql_rolls(wn.AUTO_WINDOWS)} FROM panel")
def w02_rolling_features(spark, sf):
    df = wn.rolling_features(pn.orders_daily(spark, sf))
    return out(df, *[f"rolling_{m}_{s}" for s in wn.AUTO_WINDOWS for m in ("mean", "std")], digits=4)


@query("w03_first_difference", OD + " SELECT series_id, pos, round(y - lag(y) OVER w, 2) AS diff_1" + WIN)
def w03_first_difference(spark, sf):
    return out(wn.first_difference(pn.orders_daily(spark, sf)), "diff_1", digits=2)


@query(
    "w08_supervised_windows",
    OD + ", x AS (SELECT series_id, pos - 23 AS start, list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS x,"
    " list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS l FROM panel)"
    " SELECT series_id, start, x[1] AS x_first, x[24] AS x_last, l[1] AS label_first, l[7] AS label_last FROM x WHERE len(x) = 24 AND len(l) = 7",
)
def w08_supervised_windows(spark, sf):
    df = wn.supervised_windows(pn.orders_daily(spark, sf), 24, 7)
    return df.select(
        "series_id", "start", F.get("x", 0).alias("x_first"), F.get("x", 23).alias("x_last"),
        F.get("label", 0).alias("label_first"), F.get("label", 6).alias("label_last"),
    )


@query(
    "w09_multivariate_windows",
    ED + ", f AS (SELECT *, CAST(isodow(ts) - 1 AS DOUBLE) AS dow FROM panel)"
    " SELECT series_id, pos - 4 AS start, lag(y, 4) OVER w AS x_first_y, dow AS x_last_dow, lead(y, 2) OVER w AS label_last, lead(dow, 2) OVER w AS future_dow"
    " FROM f WINDOW w AS (PARTITION BY series_id ORDER BY pos) QUALIFY pos >= 4 AND pos + 2 < n",
)
def w09_multivariate_windows(spark, sf):
    panel = pn.events_daily(spark, sf).withColumn("dow", F.weekday("ts").cast("double"))
    df = wn.multivariate_windows(panel, ["y", "dow"], "y", 5, 2, future=["dow"])
    return df.select(
        "series_id", "start", F.get(F.get("x", 0), 0).alias("x_first_y"), F.get(F.get("x", 4), 1).alias("x_last_dow"),
        F.get("label", 1).alias("label_last"), F.get(F.get("future_x", 1), 0).alias("future_dow"),
    )


SPLIT_SQL = (
    " CASE WHEN pos < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN pos < least(greatest(greatest(1, floor(n * 0.7::DOUBLE)) + 1,"
    " floor(n * 0.85::DOUBLE)), n - 1) THEN 'val' ELSE 'test' END"
)


@query("w10_chronological_split", OD + f" SELECT series_id,{SPLIT_SQL} AS part, count(*) AS rows, min(pos) AS first_pos FROM panel GROUP BY 1, 2")
def w10_chronological_split(spark, sf):
    df = pn.orders_daily(spark, sf).withColumn("part", wn.split_label())
    return df.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"))


SEGS = (
    EH + ", s AS (SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY pos) AS segment FROM (SELECT *, CASE WHEN"
    " abs(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY pos)) - 3600) > 1800 THEN 1 ELSE 0 END AS brk FROM panel))"
)


@query(
    "w12_contiguous_segments",
    SEGS + " SELECT series_id, CAST(segment AS BIGINT) AS segment, min(pos) AS first_pos, count(*) AS rows FROM s GROUP BY 1, 2",
)
def w12_contiguous_segments(spark, sf):
    df = wn.segments(pn.events_hourly(spark, sf), 3600)
    return df.groupBy("series_id", F.col("segment").cast("long").alias("segment")).agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "w13_segment_chunks",
    SEGS + ", l AS (SELECT series_id, segment, min(pos) AS s0, count(*) AS len FROM s GROUP BY 1, 2),"
    " good AS (SELECT DISTINCT series_id FROM l WHERE len >= 24),"
    " r AS (SELECT s.series_id, CAST(s.segment AS BIGINT) AS segment, pos, s0, len FROM s JOIN l ON l.series_id = s.series_id AND l.segment = s.segment"
    " WHERE len >= 24 UNION ALL SELECT series_id, -1, pos, 0, n FROM s WHERE series_id NOT IN (SELECT * FROM good) AND n >= 24)"
    " SELECT series_id, segment, (pos - s0) // 24 AS chunk, pos, CASE WHEN (pos - s0) % 24 < 18 THEN 'context' ELSE 'horizon' END AS role"
    " FROM r WHERE ((pos - s0) // 24 + 1) * 24 <= len",
)
def w13_segment_chunks(spark, sf):
    df = wn.segment_chunks(pn.events_hourly(spark, sf), 3600, 18, 6)
    return df.select("series_id", "segment", "chunk", "pos", "role")


@query(
    "w16_stride_downsample",
    OD + ", s AS (SELECT *, CAST(greatest(1, ceil(n / 500)) AS BIGINT) AS st FROM panel),"
    " t AS (SELECT *, (n - 1) // st + 1 + CASE WHEN (n - 1) % st = 0 THEN 0 ELSE 1 END AS total, (n - 1) // st + 1 AS reg FROM s)"
    " SELECT series_id, pos, y FROM t WHERE pos = n - 1 OR (pos % st = 0 AND pos // st < CASE WHEN total > 500 THEN total - 2 ELSE reg END)",
)
def w16_stride_downsample(spark, sf):
    return wn.downsample(pn.orders_daily(spark, sf), 500).select("series_id", "pos", "y")


def _sg_sql(size=5):
    w = wn.savgol_weights(size)
    half = size // 2

    def combo(row, first):
        return " + ".join(f"{float(c)!r} * {'y' if first + j == 0 else ('lead' if first + j > 0 else 'lag') + f'(y, {abs(first + j)}) OVER w'}" for j, c in enumerate(row))

    arms = "".join(f" WHEN pos = {p} THEN {combo(w[p], -p)} WHEN n - 1 - pos = {p} THEN {combo(w[size - 1 - p], p - size + 1)}" for p in range(half))
    return f"CASE{arms} ELSE {combo(w[half], -half)} END"


@query("w19_savitzky_golay", OD + f" SELECT series_id, pos, round({_sg_sql()}, 2) AS smooth" + WIN)
def w19_savitzky_golay(spark, sf):
    return out(wn.savgol(pn.orders_daily(spark, sf), 5), "smooth", digits=2)


MA7 = (
    OD + ", t AS (SELECT *, sum(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS trend FROM panel),"
    " m AS (SELECT *, avg(y - trend) OVER (PARTITION BY series_id, pos % 7) AS seasonal FROM t)"
)


@query("w20_moving_average_trend", MA7 + " SELECT series_id, pos, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(y - trend - seasonal, 2) AS resid FROM m")
def w20_moving_average_trend(spark, sf):
    return out(wn.moving_average_parts(pn.orders_daily(spark, sf), 7), "trend", "seasonal", "resid", digits=2)


# ---- features and scaling --------------------------------------------------------------------

CAL = {
    "hour_of_day": "hour(ts) / 23.0",
    "day_of_week": "(isodow(ts) - 1) / 6.0",
    "day_of_month": "day(ts) / 31.0",
    "month": "month(ts) / 12.0",
    "quarter": "quarter(ts) / 4.0",
    "week_of_year": "week(ts) / 53.0",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END",
}
CAL_SQL = ", ".join(
    f"CASE WHEN min({e}) OVER s < max({e}) OVER s THEN round(CAST({e} AS DOUBLE), 6) END AS {k}" for k, e in CAL.items()
)


@query("c14_calendar_features", OD + f" SELECT series_id, pos, {CAL_SQL} FROM panel WINDOW s AS (PARTITION BY series_id)")
def c14_calendar_features(spark, sf):
    return out(wn.calendar_features(pn.orders_daily(spark, sf)), *CAL)


@query(
    "c20_fourier_terms",
    ED + " SELECT series_id, pos, " + ", ".join(
        f"round({fn}(2 * pi() * {k} * pos / {p}), 6) AS {fn}_{str(p).replace('.', '_')}_{k}" for p in wn.FOURIER_PERIODS for k in (1, 2, 3) for fn in ("sin", "cos")
    ) + " FROM panel",
)
def c20_fourier_terms(spark, sf):
    cols = wn.fourier_columns()
    return pn.events_daily(spark, sf).select(
        "series_id", "pos", *[F.round(c, 6).alias(k.replace(".", "_")) for k, c in cols.items()]
    )


@query("c21_log_transform", OD + " SELECT series_id, pos, round(ln(1 + y), 6) AS logged, round(exp(ln(1 + y)) - 1, 2) AS back FROM panel WHERE y >= 0")
def c21_log_transform(spark, sf):
    z = scale.log_forward(F.col("y"))
    df = pn.orders_daily(spark, sf).withColumn("logged", z).where("logged is not null")
    return df.select("series_id", "pos", F.round("logged", 6).alias("logged"), F.round(scale.log_backward(F.col("logged")), 2).alias("back"))


@query(
    "r10_feature_bundle",
    OD + f", b AS (SELECT series_id, pos, {CAL_SQL}, {_sql_lags(wn.AUTO_LAGS, True)}, {_sql_rolls((7,))}, round(y - lag(y) OVER w, 2) AS diff_1,"
    " round(sin(2 * pi() * pos / 7), 6) AS sin_7_1 FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos), s AS (PARTITION BY series_id)) SELECT * FROM b",
)
def r10_feature_bundle(spark, sf):
    df = wn.feature_bundle(pn.orders_daily(spark, sf))
    return df.select(
        "series_id", "pos", *[F.round(c, 6).alias(c) for c in CAL], *[f"lag_{k}" for k in wn.AUTO_LAGS],
        F.round("rolling_mean_7", 4).alias("rolling_mean_7"), F.round("rolling_std_7", 4).alias("rolling_std_7"),
        F.round("diff_1", 2).alias("diff_1"), F.round("`sin_7.0_1`", 6).alias("sin_7_1"),
    )


TRAIN = OD + f", sp AS (SELECT *,{SPLIT_SQL} AS part FROM panel)"


@query(
    "r01_standard_scaler",
    TRAIN + ", f AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM sp WHERE part = 'train' GROUP BY 1)"
    " SELECT series_id, pos, round((y - m) / s, 6) AS scaled, round((y - m) / s * s + m, 2) AS restored FROM sp JOIN f USING (series_id)",
)
def r01_standard_scaler(spark, sf):
    return _scaled(spark, sf, "standard")


@query(
    "r02_minmax_scaler",
    TRAIN + ", f AS (SELECT series_id, min(y) AS m, max(y) - min(y) AS s FROM sp WHERE part = 'train' GROUP BY 1)"
    " SELECT series_id, pos, round((y - m) / s, 6) AS scaled, round((y - m) / s * s + m, 2) AS restored FROM sp JOIN f USING (series_id)",
)
def r02_minmax_scaler(spark, sf):
    return _scaled(spark, sf, "minmax")


def _scaled(spark, sf, name):
    """Fitted on the training rows, applied to all, inverted again."""
    panel, scaler = pn.orders_daily(spark, sf), scale.build(name)
    params = scale.fit(panel, scaler, wn.split_label() == "train")
    scaled = scale.apply(panel, scaler, params)
    return scale.invert(scaled, scaler, params).select(
        "series_id", "pos", F.round("scaled", 6).alias("scaled"), F.round("restored", 2).alias("restored")
    )


@query("r03_differencing", OD + " SELECT series_id, pos, round(y - lag(y) OVER w, 2) AS diff, round(y, 2) AS restored" + WIN)
def r03_differencing(spark, sf):
    d = scale.difference(pn.orders_daily(spark, sf))
    firsts = per_series(d, F.min_by("y", "pos").alias("first_y"))
    return out(scale.undifference(d, firsts), "diff", "restored", digits=2)


@query("r04_log_pair", OD + " SELECT series_id, round(sum(ln(1 + y)), 4) AS sum_log, count(*) AS rows FROM panel GROUP BY 1")
def r04_log_pair(spark, sf):
    df = pn.orders_daily(spark, sf).withColumn("z", scale.log_forward(F.col("y")))
    return df.groupBy("series_id").agg(F.round(F.sum("z"), 4).alias("sum_log"), F.count("z").alias("rows"))


@query(
    "e03_scaler_protocol",
    OD + " SELECT series_id, 'standard' AS scaler, round(avg(y), 2) AS p1, round(stddev_pop(y), 2) AS p2 FROM panel GROUP BY 1 UNION ALL"
    " SELECT series_id, 'minmax', round(min(y), 2), round(max(y) - min(y), 2) FROM panel GROUP BY 1",
)
def e03_scaler_protocol(spark, sf):
    panel = pn.orders_daily(spark, sf)
    parts = []
    for name in ("standard", "minmax"):
        s = scale.build(name)
        p1, p2 = s.params
        parts.append(s.fit(panel).select("series_id", F.lit(name).alias("scaler"), F.round(p1, 2).alias("p1"), F.round(p2, 2).alias("p2")))
    return parts[0].unionByName(parts[1])


@query(
    "r11_prep_chain",
    NEAR.replace("lin AS", "lin0 AS") + f", lin AS (SELECT * FROM lin0), sm AS (SELECT series_id, pos, n, {_sg_sql()} AS y FROM lin WINDOW w AS (PARTITION BY series_id ORDER BY pos)),"
    f" sp AS (SELECT *,{SPLIT_SQL} AS part FROM sm), f AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM sp WHERE part = 'train' GROUP BY 1),"
    " z AS (SELECT series_id, pos, (y - m) / s AS y FROM sp JOIN f USING (series_id))"
    " SELECT series_id, pos - 23 AS start, round(lag(y, 23) OVER w, 6) AS x_first, round(y, 6) AS x_last, round(lead(y) OVER w, 6) AS label FROM z"
    " WINDOW w AS (PARTITION BY series_id ORDER BY pos) QUALIFY lag(y, 23) OVER w IS NOT NULL AND lead(y) OVER w IS NOT NULL",
)
def r11_prep_chain(spark, sf):
    from tidepanel.plans.prepare import prepare_panel

    x = prepare_panel(holes(spark, sf), fill="linear")["windows"]
    return x.select(
        "series_id", "start", F.round(F.get("x", 0), 6).alias("x_first"), F.round(F.get("x", 23), 6).alias("x_last"),
        F.round(F.get("label", 0), 6).alias("label"),
    )
