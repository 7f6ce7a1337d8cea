"""Ensembles, conformal intervals, hierarchies, what-if, counterfactuals and scenario trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import conformal as cf, ensemble as en, folds, forecast as fc, hierarchy as hi, scenario as sc
from tidepanel.operators.blocks import number_rows
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import HOLD, LINE_SQL, PROFILE_SQL, SCALE_SQL, Z10
from tidepanel.plans.q_prep import ED, OD
from tidepanel.session import table

MEMBERS = ("last_value", "linear_trend", "seasonal_naive", "seasonal_profile")
WEIGHTS = (("last_value", 1.0), ("linear_trend", 3.0), ("seasonal_naive", 0.5), ("seasonal_profile", -1.0))
MEMBER_SQL = (
    HOLD + ", panel AS (SELECT series_id, ts, pos, n - 7 AS n, y FROM hist)," + LINE_SQL + "," + PROFILE_SQL
    + ", fc AS (SELECT 'last_value' AS model, series_id, step, p AS mean FROM lastv, range(1, 8) AS r(step)"
    " UNION ALL SELECT 'linear_trend', series_id, step, my + b * (n - 1 + step - mx) FROM fit, range(1, 8) AS r(step)"
    " UNION ALL SELECT 'seasonal_naive', series_id, step, y FROM panel, range(1, 8) AS r(step) WHERE pos = n - 7 + ((step - 1) % 7)"
    " UNION ALL SELECT 'seasonal_profile', l.series_id, step, level + slope * (n - 1 + step - (n - 1) / 2) + s FROM line l, range(1, 8) AS r(step), tmpl t WHERE t.series_id = l.series_id AND t.phase = (n - 1 + step) % 7),"
    " w(model, weight) AS (VALUES ('last_value', 1.0), ('linear_trend', 3.0), ('seasonal_naive', 0.5), ('seasonal_profile', 1.0)),"
    " m AS (SELECT series_id, step, mean AS v, weight AS w, row_number() OVER o - 1 AS i, sum(weight) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY series_id, step) AS tot"
    " FROM fc JOIN w USING (model) WINDOW o AS (PARTITION BY series_id, step ORDER BY mean, model))"
)


def members(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    return en.union_outputs(*[fc.forecast(history, m, 7) for m in MEMBERS])


def _merge(key, method, expr):
    @query(key, MEMBER_SQL + f" SELECT series_id, CAST(step AS INTEGER) AS step, round({expr}, 6) AS mean FROM m GROUP BY 1, 2")
    def run(spark, sf, method=method):
        w = spark.createDataFrame(list(WEIGHTS), "model string, weight double")
        return en.merge(members(spark, sf), method, w, horizon=7).select("series_id", "step", F.round("mean", 6).alias("mean"))

    return run


_merge("f20_ensemble_mean", "mean", "sum(v * w) / sum(w)")
_merge("f20_ensemble_median", "median", "min(v) FILTER (WHERE cum >= tot / 2)")
_merge("f20_ensemble_trimmed", "trimmed_mean", "sum(v * w) FILTER (WHERE i BETWEEN 1 AND 2) / sum(w) FILTER (WHERE i BETWEEN 1 AND 2)")
_merge(
    "f20_ensemble_winsorized", "winsorized_mean",
    "(sum(v * w) FILTER (WHERE i BETWEEN 1 AND 2) + sum(w) FILTER (WHERE i = 0) * min(v) FILTER (WHERE i = 1) + sum(w) FILTER (WHERE i = 3) * min(v) FILTER (WHERE i = 2)) / sum(w)",
)


@query(
    "j04_model_completeness",
    MEMBER_SQL + " SELECT model, series_id, model || ': horizon mismatch (4 vs 7), skipped' AS warning FROM fc WHERE model = 'seasonal_naive' AND series_id = 'view' GROUP BY 1, 2",
)
def j04_model_completeness(spark, sf):
    rows = members(spark, sf).where("not (model = 'seasonal_naive' and series_id = 'view' and step > 4)")
    return en.incomplete_members(rows, 7)


@query("u01_union_outputs", MEMBER_SQL + " SELECT model, count(*) AS rows, count(DISTINCT series_id) AS series FROM fc GROUP BY 1")
def u01_union_outputs(spark, sf):
    per = members(spark, sf).groupBy("model", "series_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("model").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("series"))


# ---- conformal -------------------------------------------------------------------------------

CALIB = (
    OD + ", cp AS (SELECT series_id, y AS a, lag(y, 7) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM panel),"
    " q AS (SELECT series_id, count(*) AS c, list_sort(list({score})) AS s FROM cp WHERE p IS NOT NULL GROUP BY 1),"
    " r AS (SELECT series_id, c, s, least(ceil((c + 1) * 0.9::DOUBLE) / c, 1.0) * (c - 1) AS k FROM q),"
    " qh AS (SELECT series_id, s[1 + CAST(floor(k) AS BIGINT)] + (s[1 + CAST(ceil(k) AS BIGINT)] - s[1 + CAST(floor(k) AS BIGINT)]) * (k - floor(k)) AS q FROM r)"
)
SPLIT = CALIB.format(score="abs(a - p)")
ADAPT = CALIB.format(score="abs(a - p) / (abs(p) + 1e-8)")


def _calibration(spark, sf, method):
    """Seven-day naive forecasts of every day calibrate the intervals."""
    from tidepanel.operators.blocks import framed

    pairs = framed(pn.orders_daily(spark, sf), lambda w: {"p": F.lag("y", 7).over(w)}, back=7)
    return cf.calibrate(pairs.where("p is not null").withColumnRenamed("y", "a"), 0.9, method)


@query("f21_conformal_calibrate", SPLIT + " SELECT series_id, round(q, 3) AS q_hat FROM qh")
def f21_conformal_calibrate(spark, sf):
    return _calibration(spark, sf, "split").select("series_id", F.round("q_hat", 3).alias("q_hat"))


@query("f21_conformal_adaptive", ADAPT + " SELECT series_id, round(q, 6) AS q_hat FROM qh")
def f21_conformal_adaptive(spark, sf):
    return _calibration(spark, sf, "adaptive").select("series_id", F.round("q_hat", 6).alias("q_hat"))


@query(
    "f22_conformal_intervals",
    SPLIT + " SELECT p.series_id, CAST(step AS INTEGER) AS step, y AS mean, round(y - q, 3) AS low, round(y + q, 3) AS high FROM panel p JOIN qh USING (series_id), range(1, 15) AS r(step)"
    " WHERE pos = n - 7 + ((step - 1) % 7)",
)
def f22_conformal_intervals(spark, sf):
    f = cf.intervals(fc.forecast(pn.orders_daily(spark, sf), "seasonal_naive", 14), _calibration(spark, sf, "split"), 0.9)
    return f.select(
        "series_id", "step", "mean", F.round(F.col("quantiles")["0.05"], 3).alias("low"), F.round(F.col("quantiles")["0.95"], 3).alias("high")
    )


# ---- hierarchy: total -> region -> nation, monthly orders ------------------------------------

GEO = (
    "WITH RECURSIVE flat AS (SELECT r_name, n_name, date_trunc('month', o_orderdate) AS ts, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey"
    " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),"
    " lev AS (SELECT 'nation' AS lvl, n_name AS series_id, ts, round(sum(v), 2) AS y FROM flat GROUP BY 2, 3 UNION ALL SELECT 'region', r_name, ts, round(sum(v), 2) FROM flat GROUP BY 2, 3"
    " UNION ALL SELECT 'total', 'TOTAL', ts, round(sum(v), 2) FROM flat GROUP BY 3),"
    " panel AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM lev),"
    " edges AS (SELECT DISTINCT 'TOTAL' AS parent, r_name AS child FROM region UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),"
    " st AS (SELECT lvl, series_id, max(n) AS n, arg_max(y, pos) AS lv, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM panel GROUP BY 1, 2),"
    " fcb AS (SELECT series_id, CAST(step AS INTEGER) AS step, CASE WHEN lvl = 'nation' THEN lv ELSE my + b * (n - 1 + step - mx) END AS mean FROM st, range(1, 7) AS r(step)),"
    " paths(ancestor, node) AS (SELECT parent, child FROM edges UNION ALL SELECT p.ancestor, e.child FROM paths p JOIN edges e ON e.parent = p.node),"
    " leaves AS (SELECT child AS leaf FROM edges WHERE child NOT IN (SELECT parent FROM edges)),"
    " clo AS (SELECT ancestor, node AS leaf FROM paths WHERE node IN (SELECT leaf FROM leaves) UNION ALL SELECT leaf, leaf FROM leaves)"
)


def geo_edges(spark, sf):
    reg = table(spark, sf, "region")
    nat = table(spark, sf, "nation").join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
    top = reg.select(F.lit("geo").alias(hi.H), F.lit("TOTAL").alias("parent"), F.col("r_name").alias("child"))
    return top.unionByName(nat.select(F.lit("geo").alias(hi.H), F.col("r_name").alias("parent"), F.col("n_name").alias("child")))


def geo_panel(spark, sf):
    """Monthly totals per nation are shuffled once; regions and the total are sums of them."""
    o = table(spark, sf, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("ts"), "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nat = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ts").agg(F.sum("o_totalprice").alias("v"))
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flat = nat.join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    lev = F.explode(
        F.array(
            F.struct(F.lit("nation").alias("lvl"), F.col("n_name").alias("series_id")),
            F.struct(F.lit("region").alias("lvl"), F.col("r_name").alias("series_id")),
            F.struct(F.lit("total").alias("lvl"), F.lit("TOTAL").alias("series_id")),
        )
    )
    rows = flat.select(lev.alias("l"), "ts", "v").groupBy("l.lvl", "l.series_id", "ts").agg(F.round(F.sum("v"), 2).alias("y"))
    return number_rows(rows, bucket_seconds=None)


def geo_forecast(spark, sf):
    """Last value for nations, trend for the levels above: incoherent on purpose."""
    p = geo_panel(spark, sf)
    low, high = p.where("lvl = 'nation'"), p.where("lvl <> 'nation'")
    f = fc.last_value(low, 6).unionByName(fc.linear_trend(high, 6))
    return f.select(F.lit("geo").alias(hi.H), "series_id", "step", "mean")


@query(
    "f23_summing_matrix",
    GEO + " SELECT ancestor, leaf, 1.0::DOUBLE AS k FROM clo",
)
def f23_summing_matrix(spark, sf):
    return hi.closure(geo_edges(spark, sf)).select("ancestor", "leaf", "k")


@query(
    "f23_hierarchy_levels",
    GEO + ", dep(s, d) AS (SELECT 'TOTAL', 0 UNION ALL SELECT child, d + 1 FROM dep JOIN edges ON parent = s)"
    " SELECT s AS series_id, d AS depth, s = 'TOTAL' AS is_root, s IN (SELECT leaf FROM leaves) AS is_leaf FROM dep",
)
def f23_hierarchy_levels(spark, sf):
    e = geo_edges(spark, sf)
    return hi.levels(e).join(hi.nodes(e), [hi.H, "series_id"]).select("series_id", "depth", "is_root", "is_leaf")


@query("f24_bottom_up", GEO + " SELECT ancestor AS series_id, step, round(sum(mean), 2) AS mean FROM clo JOIN fcb ON series_id = leaf GROUP BY 1, 2")
def f24_bottom_up(spark, sf):
    r = hi.reconcile(geo_edges(spark, sf), geo_forecast(spark, sf), "bottom_up")
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


SHARE = (
    GEO + ", mn AS (SELECT series_id, avg(mean) AS m FROM fcb GROUP BY 1), sh AS (SELECT parent, child, c.m / p.m AS s FROM edges JOIN mn p ON p.series_id = parent JOIN mn c ON c.series_id = child),"
    " ls AS (SELECT a.child AS leaf, {share} AS s FROM sh a JOIN sh b ON b.child = a.parent),"
    " lf AS (SELECT leaf, step, mean * s AS mean FROM ls, fcb WHERE series_id = 'TOTAL')"
    " SELECT ancestor AS series_id, step, round(sum(mean), 2) AS mean FROM clo JOIN lf USING (leaf) GROUP BY 1, 2"
)


@query("f25_top_down", SHARE.format(share="a.s * b.s"))
def f25_top_down(spark, sf):
    r = hi.reconcile(geo_edges(spark, sf), geo_forecast(spark, sf), "top_down")
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


@query("f25_top_down_direct_parent", SHARE.format(share="a.s"))
def f25_top_down_direct_parent(spark, sf):
    r = hi.reconcile(geo_edges(spark, sf), geo_forecast(spark, sf), "top_down", direct_parent=True)
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


OLS_SQL = (
    GEO + ", nat AS (SELECT e.parent AS r, e.child AS s, step, mean AS y FROM edges e JOIN fcb ON series_id = child WHERE parent <> 'TOTAL'),"
    # region totals: children give mean M with variance c, the region's own forecast variance 1
    " reg AS (SELECT r, nat.step, sum(y) AS m0, count(*) AS v0, (any_value(f.mean) + sum(y) / count(*)) / (1 + 1.0 / count(*)) AS m, 1 / (1 + 1.0 / count(*)) AS v FROM nat JOIN fcb f ON f.series_id = r AND f.step = nat.step GROUP BY 1, 2),"
    " tot AS (SELECT reg.step, sum(m) AS m0, sum(v) AS v0, (any_value(f.mean) + sum(m) / sum(v)) / (1 + 1 / sum(v)) AS t FROM reg JOIN fcb f ON f.series_id = 'TOTAL' AND f.step = reg.step GROUP BY 1),"
    " rt AS (SELECT r, reg.step, m + v / tot.v0 * (t - tot.m0) AS t, reg.m0, reg.v0 FROM reg JOIN tot ON tot.step = reg.step)"
    " SELECT 'TOTAL' AS series_id, step, round(t, 2) AS mean FROM tot UNION ALL SELECT r, step, round(t, 2) FROM rt UNION ALL SELECT s, nat.step, round(y + (t - m0) / v0, 2) FROM nat JOIN rt ON rt.r = nat.r AND rt.step = nat.step"
)


@query("f26_reconcile_ols", OLS_SQL)
def f26_reconcile_ols(spark, sf):
    """Equality with a dense projection is checked in the tests."""
    r = hi.reconcile(geo_edges(spark, sf), geo_forecast(spark, sf), "ols")
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


# a leaf has no incoherence, so its variance is the ridge alone: it keeps its forecast, and members are nested sums
@query("f27_reconcile_mint", GEO + " SELECT ancestor AS series_id, step, round(sum(mean), 2) AS mean FROM clo JOIN fcb ON series_id = leaf GROUP BY 1, 2")
def f27_reconcile_mint(spark, sf):
    r = hi.reconcile(geo_edges(spark, sf), geo_forecast(spark, sf), "mint_shrink")
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


COHER = (
    GEO + ", ks AS (SELECT parent, step, sum(mean) AS s FROM edges JOIN fcb ON series_id = child GROUP BY 1, 2),"
    " g AS (SELECT parent, ks.step, abs(mean - s) AS d FROM ks JOIN fcb ON series_id = parent AND fcb.step = ks.step)"
)


@query("f28_coherency_check", COHER + " SELECT parent, 'parent differs from the sum of its children' AS problem, count(*) AS steps, round(max(d), 2) AS max_diff FROM g WHERE d > 1e-6 GROUP BY 1")
def f28_coherency_check(spark, sf):
    c = hi.coherency(geo_edges(spark, sf), geo_forecast(spark, sf))
    return c.select("parent", "problem", "steps", F.round("max_diff", 2).alias("max_diff"))


@query("j05_parent_child_sums", COHER + " SELECT parent, CAST(step AS INTEGER) AS step, round(d, 2) AS gap FROM g")
def j05_parent_child_sums(spark, sf):
    e, f = geo_edges(spark, sf), geo_forecast(spark, sf)
    kids = e.join(f.withColumnRenamed("series_id", "child"), [hi.H, "child"]).groupBy("parent", "step").agg(F.sum("mean").alias("s"))
    return kids.join(f.withColumnRenamed("series_id", "parent"), ["parent", "step"]).select("parent", "step", F.round(F.abs(F.col("mean") - F.col("s")), 2).alias("gap"))


@query("j08_missing_members", GEO + " SELECT s AS series_id FROM (SELECT parent AS s FROM edges UNION SELECT child FROM edges) WHERE s NOT IN (SELECT series_id FROM panel WHERE series_id NOT LIKE 'NATION_1%')")
def j08_missing_members(spark, sf):
    f = geo_forecast(spark, sf).where("series_id not like 'NATION_1%'")
    return hi.missing_members(geo_edges(spark, sf), f).select("series_id")


@query("u01_passthrough_outsiders", GEO + " SELECT 'x:' || series_id AS series_id, step, round(mean, 2) AS mean FROM fcb UNION ALL SELECT ancestor, step, round(sum(mean), 2) FROM clo JOIN fcb ON series_id = leaf GROUP BY 1, 2")
def u01_passthrough_outsiders(spark, sf):
    f = geo_forecast(spark, sf)
    outside = f.withColumn("series_id", F.concat(F.lit("x:"), "series_id"))
    r = hi.reconcile(geo_edges(spark, sf), f.unionByName(outside), "bottom_up")
    return r.select("series_id", "step", F.round("mean", 2).alias("mean"))


@query("u03_missing_leaves", GEO + " SELECT leaf AS series_id FROM leaves WHERE leaf LIKE 'NATION_2%'")
def u03_missing_leaves(spark, sf):
    return hi.missing_leaves(geo_edges(spark, sf), geo_forecast(spark, sf).where("series_id not like 'NATION_2%'")).select("series_id")


# ---- what-if and counterfactual --------------------------------------------------------------

SCENARIOS = {
    "surge": [sc.Transform("target", "multiply", 1.5), sc.Transform("target", "add", 10.0, series_id="click")],
    "flat": [sc.Transform("target", "replace", 50.0, series_id="view")],
}
WHATIF = (
    ED + ", sp AS (SELECT 'surge' AS scenario, series_id, pos, n, y * 1.5 + CASE WHEN series_id = 'click' THEN 10 ELSE 0 END AS y FROM panel"
    " UNION ALL SELECT 'flat', series_id, pos, n, CASE WHEN series_id = 'view' THEN 50 ELSE y END FROM panel UNION ALL SELECT 'baseline', series_id, pos, n, y FROM panel)"
)


@query("p17_what_if_transforms", WHATIF + " SELECT scenario, series_id, pos, round(y, 8) AS y FROM sp WHERE scenario <> 'baseline'")
def p17_what_if_transforms(spark, sf):
    return sc.what_if_panel(pn.events_daily(spark, sf), SCENARIOS).select("scenario", "series_id", "pos", F.round("y", 8).alias("y"))


@query("p17_unmatched_transforms", ED + " SELECT 'surge' AS scenario, 1 AS ordinal, 'refund' AS series_id WHERE 'refund' NOT IN (SELECT series_id FROM panel)")
def p17_unmatched_transforms(spark, sf):
    named = {"surge": [sc.Transform("target", "add", 1.0, series_id="click"), sc.Transform("target", "add", 1.0, series_id="refund")]}
    return sc.unmatched_transforms(pn.events_daily(spark, sf), named).select("scenario", "ordinal", "series_id")


@query(
    "p17_what_if_covariates",
    "WITH c AS (SELECT event_type AS series_id, 'past' AS role, 'hits' AS name, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS num FROM events GROUP BY 1, 4"
    " UNION ALL SELECT event_type, 'future', 'hits', date_trunc('day', ts), CAST(count(*) AS DOUBLE) FROM events GROUP BY 1, 4)"
    " SELECT role, series_id, round(sum(CASE role WHEN 'past' THEN num * 2 ELSE num + 5 END), 6) AS total FROM c GROUP BY 1, 2",
)
def p17_what_if_covariates(spark, sf):
    ev = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("num"))
    cov = ev.select("series_id", F.explode(F.array(F.lit("past"), F.lit("future"))).alias("role"), F.lit("hits").alias("name"), "ts", "num")
    plan = {"s": [sc.Transform("past", "multiply", 2.0, key="hits"), sc.Transform("future", "add", 5.0, key="hits")]}
    return sc.what_if_covariates(cov, plan).groupBy("role", "series_id").agg(F.round(F.sum("num"), 6).alias("total"))


@query(
    "f30_what_if_forecasts",
    WHATIF + ", f AS (SELECT scenario, series_id, max(n) AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM sp GROUP BY 1, 2),"
    " o AS (SELECT scenario, series_id, CAST(step AS INTEGER) AS step, my + b * (n - 1 + step - mx) AS mean FROM f, range(1, 8) AS r(step))"
    " SELECT o.scenario, o.series_id, o.step, round(o.mean, 6) AS mean, round(o.mean - b.mean, 6) AS delta FROM o JOIN o b ON b.scenario = 'baseline' AND b.series_id = o.series_id AND b.step = o.step",
)
def f30_what_if_forecasts(spark, sf):
    w = sc.what_if(pn.events_daily(spark, sf), SCENARIOS, "linear_trend", 7)
    return w.select("scenario", "series_id", "step", F.round("mean", 6).alias("mean"), (F.round("delta", 6) + 0.0).alias("delta"))


CFACT = (
    ED + ", f AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM panel WHERE pos < 20 GROUP BY 1),"
    " s AS (SELECT p.series_id, CAST(pos - 19 AS INTEGER) AS step, y AS actual, my + b * (pos - mx) AS cf FROM panel p JOIN f USING (series_id) WHERE pos >= 20)"
)


@query("j06_counterfactual_steps", CFACT + " SELECT series_id, step, actual, round(cf, 6) AS counterfactual, round(actual - cf, 6) AS delta FROM s")
def j06_counterfactual_steps(spark, sf):
    steps, _ = sc.counterfactual(pn.events_daily(spark, sf), F.lit(20), "linear_trend", horizon=10)
    return steps.select("series_id", "step", "actual", F.round("counterfactual", 6).alias("counterfactual"), F.round("delta", 6).alias("delta"))


@query(
    "f29_counterfactual_summary",
    CFACT + " SELECT series_id, round(avg(abs(actual - cf)), 6) AS mean_absolute_delta, round(sum(actual - cf), 6) AS total_delta, round(avg(actual - cf) / abs(avg(actual)) * 100, 6) AS average_delta_pct,"
    " CASE WHEN sum(actual - cf) > 1e-9 THEN 'above_counterfactual' WHEN sum(actual - cf) < -1e-9 THEN 'below_counterfactual' ELSE 'neutral' END AS direction FROM s GROUP BY 1",
)
def f29_counterfactual_summary(spark, sf):
    _, s = sc.counterfactual(pn.events_daily(spark, sf), F.lit(20), "linear_trend", horizon=10)
    return s.select("series_id", *[F.round(c, 6).alias(c) for c in ("mean_absolute_delta", "total_delta", "average_delta_pct")], "direction")


# ---- scenario trees --------------------------------------------------------------------------


@query(
    "f31_scenario_tree_level",
    HOLD + SCALE_SQL + " SELECT series_id, 'root' AS node_id, '' AS parent_id, 0 AS depth, round(p, 6) AS value, 1.0::DOUBLE AS probability FROM lastv"
    f" UNION ALL SELECT series_id, 'root/q' || q, 'root', 1, round(p + z * s, 6), 0.5::DOUBLE FROM lastv JOIN scale USING (series_id), (VALUES ('0.1', -{Z10}), ('0.9', {Z10})) AS v(q, z)",
)
def f31_scenario_tree_level(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    t = sc.scenario_tree(history, "last_value", 1, [0.1, 0.9])
    return t.select("series_id", "node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "depth", F.round("value", 6).alias("value"), "probability")


@query(
    "f31_scenario_tree_probabilities",
    ED + " SELECT series_id, CAST(d AS INTEGER) AS depth, CAST(pow(2, d) AS BIGINT) AS nodes, 1.0::DOUBLE AS total FROM (SELECT DISTINCT series_id FROM panel), range(0, 3) AS r(d)",
)
def f31_scenario_tree_probabilities(spark, sf):
    t = sc.scenario_tree(pn.events_daily(spark, sf), "last_value", 2, [0.1, 0.9])
    return t.groupBy("series_id", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("probability"), 9).alias("total"))


@query(
    "f31_scenario_tree_wide",
    ED + " SELECT series_id, CAST(d AS INTEGER) AS depth, CAST(pow(9, d) AS BIGINT) AS nodes, CAST(pow(9, greatest(d - 1, 0)) AS BIGINT) AS parents, 1.0::DOUBLE AS total"
    " FROM (SELECT DISTINCT series_id FROM panel), range(0, 4) AS r(d)",
)
def f31_scenario_tree_wide(spark, sf):
    """Nine branches, three levels: no branch is left out and every level's probabilities add up to 1."""
    t = sc.scenario_tree(pn.events_daily(spark, sf), "last_value", 3, [k / 10 for k in range(1, 10)])
    parents = F.greatest(F.countDistinct("parent_id"), F.lit(1))
    return t.groupBy("series_id", "depth").agg(F.count(F.lit(1)).alias("nodes"), parents.alias("parents"), F.round(F.sum("probability"), 9).alias("total"))


SCEN = (
    "WITH s AS (SELECT 'u' || user_id AS group_id, CASE event_type WHEN 'click' THEN 'Base case' WHEN 'purchase' THEN 'Upside' WHEN 'error' THEN 'Pessimistic' WHEN 'signup' THEN 'Bull run' ELSE 'Sideways' END AS name,"
    " CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id) AS probability FROM events GROUP BY user_id, 2)"
)


def _scenarios(spark, sf):
    ev = table(spark, sf, "events")
    t = F.col("event_type")
    name = F.when(t == "click", "Base case").when(t == "purchase", "Upside").when(t == "error", "Pessimistic").when(t == "signup", "Bull run").otherwise("Sideways")
    c = ev.groupBy("user_id", name.alias("name")).agg(F.count(F.lit(1)).alias("c"))
    tot = c.groupBy("user_id").agg(F.sum("c").alias("t"))
    return c.join(tot, "user_id").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("group_id"), "name", (F.col("c") / F.col("t")).alias("probability"))


@query(
    "f32_scenario_rationale",
    SCEN + ", y AS (SELECT *, CASE WHEN name = 'Base case' THEN 'base' WHEN name IN ('Upside', 'Bull run') THEN 'upside' WHEN name = 'Pessimistic' THEN 'downside' ELSE 'alternative' END AS type, CAST(round(probability * 100) AS INTEGER) AS pct FROM s)"
    " SELECT group_id, name, type, round(probability, 6) AS probability, CASE type WHEN 'base' THEN 'Base case (' || pct || '% probability): continuation of current trend and conditions' WHEN 'upside' THEN 'Upside case (' || pct || '% probability): favorable conditions materialize'"
    " WHEN 'downside' THEN 'Downside case (' || pct || '% probability): adverse conditions materialize' ELSE 'Alternative scenario (' || pct || '% probability)' END AS rationale FROM y",
)
def f32_scenario_rationale(spark, sf):
    return sc.rationale(_scenarios(spark, sf)).withColumn("probability", F.round("probability", 6))


@query(
    "f32_scenario_summary",
    SCEN + " SELECT group_id, count(*) AS scenarios, (list(name ORDER BY probability DESC, name))[1] AS most_likely, round(max(probability) - min(probability), 6) AS spread, max(probability) - min(probability) > 0.3 AS uncertain FROM s GROUP BY 1",
)
def f32_scenario_summary(spark, sf):
    return sc.rationale_summary(_scenarios(spark, sf)).withColumn("spread", F.round("spread", 6))


# ---- augmentation ----------------------------------------------------------------------------


@query(
    "f33_series_profile",
    OD + "," + PROFILE_SQL + ", rs AS (SELECT p.series_id, stddev_pop(y - (level + slope * (pos - (p.n - 1) / 2) + s)) AS a, stddev_pop(y) AS b, min(y) AS mn FROM panel p JOIN line l ON l.series_id = p.series_id"
    " JOIN tmpl t ON t.series_id = p.series_id AND t.phase = pos % 7 GROUP BY 1)"
    " SELECT series_id, round(level, 3) AS level, round(slope, 5) AS slope, round(greatest(a, b * 0.05, 1e-6), 3) AS noise_std, mn >= 0 AS non_negative, round((SELECT s FROM tmpl t WHERE t.series_id = line.series_id AND phase = 0), 3) AS season_0 FROM line JOIN rs USING (series_id)",
)
def f33_series_profile(spark, sf):
    p = sc.series_profile(pn.orders_daily(spark, sf), 7)
    return p.select(
        "series_id", F.round("level", 3).alias("level"), F.round("slope", 5).alias("slope"), F.round("noise_std", 3).alias("noise_std"), "non_negative",
        F.round(F.col("template")[F.lit(0).cast("long")], 3).alias("season_0"),
    )


def _drawn(what: str) -> str:
    return f"((CAST('0x' || substr(md5('0:{what}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


@query(
    "f34_augmented_panel",
    OD + "," + PROFILE_SQL + ", rs AS (SELECT p.series_id, stddev_pop(y - (level + slope * (pos - (p.n - 1) / 2) + s)) AS a, stddev_pop(y) AS b, min(y) AS mn, min(ts) AS t0 FROM panel p JOIN line l ON l.series_id = p.series_id"
    " JOIN tmpl t ON t.series_id = p.series_id AND t.phase = pos % 7 GROUP BY 1),"
    f" v AS (SELECT line.series_id, line.n, k, t0, level * (1 + 0.05 * (2 * {_drawn("level:' || line.series_id || ':' || k")} - 1)) AS l, slope * (1 + 0.1 * (2 * {_drawn("trend:' || line.series_id || ':' || k")} - 1)) AS sl,"
    f" 1 + 0.1 * (2 * {_drawn("season:' || line.series_id || ':' || k")} - 1) AS f, greatest(a, b * 0.05, 1e-6) AS ns, mn >= 0 AS nn FROM line JOIN rs USING (series_id), range(1, 4) AS r(k)),"
    f" g AS (SELECT v.*, pos, sqrt(-2 * ln({_drawn("u1:' || series_id || ':' || k || ':' || pos")})) * cos(2 * pi() * {_drawn("u2:' || series_id || ':' || k || ':' || pos")}) AS z FROM (SELECT *, unnest(range(n)) AS pos FROM v) AS v),"
    " e AS (SELECT g.series_id, k, pos, t0, nn, l + sl * (pos - (n - 1) / 2) + s * f + z * ns AS y FROM g JOIN tmpl t ON t.series_id = g.series_id AND t.phase = pos % 7)"
    " SELECT series_id AS source_id, series_id || '_synthetic_' || k AS series_id, pos, strftime(t0 + INTERVAL 1 DAY * CAST(pos AS INTEGER), '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN nn THEN greatest(y, 0.0) ELSE y END, 0) AS y FROM e",
)
def f34_augmented_panel(spark, sf):
    a = sc.augment(pn.orders_daily(spark, sf), 7, count=3, freq="D")
    return a.select("source_id", "series_id", "pos", pn.stamp(), F.round("y", 0).alias("y"))


# ---- a user's request model: covariates, timestamps and horizon in one call --------------------------------

# daily hits are known in advance; the model moves the last value by half the change in hits
HITS = ED + ", hits AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS h FROM events GROUP BY 1, 2), ph AS (SELECT p.*, h FROM panel p JOIN hits USING (series_id, ts))"


def daily_hits(spark, sf):
    ev = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("num"))
    return ev.select("series_id", F.explode(F.array(F.lit("past"), F.lit("future"))).alias("role"), F.lit("hits").alias("name"), "ts", "num")


def moved_by_hits(request):
    past, future = request["past_covariates"]["hits"], request["future_covariates"]["hits"]
    return {"mean": request["target"][-1] + 0.5 * (future - past[-1])}


@query(
    "e01_request_model",
    HITS + ", c AS (SELECT series_id, n - 7 AS cut FROM panel GROUP BY 1, 2), l AS (SELECT p.series_id, cut, y, h FROM ph p JOIN c USING (series_id) WHERE pos = cut - 1)"
    " SELECT p.series_id, CAST(pos - cut + 1 AS INTEGER) AS step, round(l.y + 0.5 * (p.h - l.h), 6) AS mean FROM ph p JOIN l USING (series_id) WHERE pos >= cut",
)
def e01_request_model(spark, sf):
    """A batch forecast by a user's model that reads past and future covariates."""
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    rows = fc.forecast(history, fc.RequestModel("hits", moved_by_hits, daily_hits(spark, sf), "D"), 7)
    return rows.select("series_id", "step", F.round("mean", 6).alias("mean"))


@query(
    "e01_request_counterfactual",
    HITS + ", l AS (SELECT series_id, y, h FROM ph WHERE pos = 19) SELECT p.series_id, CAST(pos - 19 AS INTEGER) AS step, p.y AS actual, round(l.y + 0.5 * (p.h - l.h), 6) AS counterfactual FROM ph p JOIN l USING (series_id) WHERE pos BETWEEN 20 AND 29",
)
def e01_request_counterfactual(spark, sf):
    """The same model in a counterfactual: it sees the covariates that follow the intervention."""
    steps, _ = sc.counterfactual(pn.events_daily(spark, sf), F.lit(20), fc.RequestModel("hits", moved_by_hits, daily_hits(spark, sf), "D"), horizon=10)
    return steps.select("series_id", "step", "actual", F.round("counterfactual", 6).alias("counterfactual"))


@query(
    "e01_request_tree",
    HITS + ", c AS (SELECT series_id, n - 7 AS cut FROM panel GROUP BY 1, 2), b AS (SELECT p.series_id, pos - cut + 1 AS d, y, h FROM ph p JOIN c USING (series_id) WHERE pos BETWEEN cut - 1 AND cut + 1),"
    " t AS (SELECT z.series_id, z.y AS v0, z.y + 0.5 * (a.h - z.h) AS v1, z.y + 0.5 * (a.h - z.h) + 0.5 * (e.h - a.h) AS v2 FROM b z JOIN b a ON a.series_id = z.series_id AND a.d = 1 JOIN b e ON e.series_id = z.series_id AND e.d = 2 WHERE z.d = 0)"
    " SELECT series_id, 'root' AS node_id, round(v0, 6) AS value FROM t UNION ALL SELECT series_id, 'root/q' || q, round(v1, 6) FROM t, (VALUES ('0.1'), ('0.9')) AS x(q)"
    " UNION ALL SELECT series_id, 'root/q' || x.q || '/q' || w.q, round(v2, 6) FROM t, (VALUES ('0.1'), ('0.9')) AS x(q), (VALUES ('0.1'), ('0.9')) AS w(q)",
)
def e01_request_tree(spark, sf):
    """The same model in a scenario tree: every path is asked with its own last value and time. It gives no quantiles."""
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    t = sc.scenario_tree(history, fc.RequestModel("hits", moved_by_hits, daily_hits(spark, sf), "D"), 2, [0.1, 0.9])
    return t.select("series_id", "node_id", F.round("value", 6).alias("value"))
