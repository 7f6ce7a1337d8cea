"""Covariate contracts, capabilities and model-ready covariates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import covariates as cv
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_prep import ED
from tidepanel.session import table

# Covariates of every user series, by day of the event: hits (past and future for ids divisible by 2), price
# (text for ids divisible by 3), temp (future only for ids divisible by 5), tier (static for ids divisible by 7).
COV = (
    "WITH e AS (SELECT 'u' || user_id AS series_id, user_id AS u, event_id, ts, value AS v FROM events),"
    " cov AS (SELECT series_id, 'past' AS role, 'hits' AS name, ts, v AS num, CAST(NULL AS VARCHAR) AS cat FROM e UNION ALL SELECT series_id, 'future', 'hits', ts, v, NULL FROM e WHERE u % 2 = 0"
    " UNION ALL SELECT series_id, 'past', 'price', ts, CASE WHEN u % 3 <> 0 OR (u % 9 = 0 AND event_id % 2 = 0) THEN v END, CASE WHEN u % 3 = 0 AND NOT (u % 9 = 0 AND event_id % 2 = 0) THEN 'x' END FROM e"
    " UNION ALL SELECT series_id, 'future', 'temp', ts, v, NULL FROM e WHERE u % 5 = 0 UNION ALL SELECT series_id, 'static', 'tier', ts, NULL, 'gold' FROM e WHERE u % 7 = 0),"
    " kd AS (SELECT series_id, role, name, count(*) AS rows, CASE WHEN count(num) > 0 AND count(cat) > 0 THEN 'mixed' WHEN count(num) > 0 THEN 'numeric' WHEN count(cat) > 0 THEN 'categorical' ELSE 'empty' END AS kind FROM cov GROUP BY 1, 2, 3),"
    " pr AS (SELECT series_id, name, max(kind) FILTER (WHERE role = 'past') AS pk, max(kind) FILTER (WHERE role = 'future') AS fk, max(rows) FILTER (WHERE role = 'past') AS pr, max(rows) FILTER (WHERE role = 'future') AS fr FROM kd WHERE role <> 'static' GROUP BY 1, 2),"
    " prof AS (SELECT series_id, name, CASE WHEN fk IS NOT NULL THEN 'known_future' ELSE 'past_only' END AS grp, pk AS kind FROM pr WHERE pk IS NOT NULL UNION ALL SELECT DISTINCT series_id, name, 'static', 'static' FROM cov WHERE role = 'static')"
)


def covariates(spark, sf):
    ev = table(spark, sf, "events")
    u, k = F.col("user_id"), F.col("event_id")
    none = lambda t: F.lit(None).cast(t)
    split = (u % 9 == 0) & (k % 2 == 0)
    rows = F.array_compact(
        F.array(
            F.struct(F.lit("past").alias("role"), F.lit("hits").alias("name"), F.col("value").alias("num"), none("string").alias("cat")),
            F.when(u % 2 == 0, F.struct(F.lit("future").alias("role"), F.lit("hits").alias("name"), F.col("value").alias("num"), none("string").alias("cat"))),
            F.struct(F.lit("past").alias("role"), F.lit("price").alias("name"), F.when((u % 3 != 0) | split, F.col("value")).alias("num"), F.when((u % 3 == 0) & ~split, "x").alias("cat")),
            F.when(u % 5 == 0, F.struct(F.lit("future").alias("role"), F.lit("temp").alias("name"), F.col("value").alias("num"), none("string").alias("cat"))),
            F.when(u % 7 == 0, F.struct(F.lit("static").alias("role"), F.lit("tier").alias("name"), none("double").alias("num"), F.lit("gold").alias("cat"))),
        )
    )
    return ev.select(F.concat(F.lit("u"), u.cast("string")).alias("series_id"), "ts", F.explode(rows).alias("r")).select("series_id", "ts", "r.*")


@query("p05_covariate_kinds", COV + " SELECT series_id, role, name, rows, kind FROM kd")
def p05_covariate_kinds(spark, sf):
    return cv.kinds(covariates(spark, sf))


@query(
    "p03_request_contract",
    COV + ", n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1), x AS (SELECT series_id, name, CASE WHEN pk IN ('mixed', 'empty') OR fk IN ('mixed', 'empty') THEN 'values must be all numeric or all text' WHEN pk IS NULL THEN 'missing in past covariates'"
    " WHEN pr <> n THEN 'past length differs from target length' WHEN fr <> 60 THEN 'future length differs from horizon' WHEN pk <> fk THEN 'kind differs between past and future' END AS problem FROM pr JOIN n USING (series_id)) SELECT * FROM x WHERE problem IS NOT NULL",
)
def p03_request_contract(spark, sf):
    cov = covariates(spark, sf)
    n = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    return cv.covariate_violations(cov, n, 60)


@query(
    "p03_request_arrays",
    "WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'twice' ELSE 'r' || event_id END AS series_id, event_id % 4 AS t, event_id % 3 AS y, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 5 END AS a FROM events)"
    " SELECT problem, count(*) AS requests FROM (SELECT 'target length must match timestamps length' AS problem FROM r WHERE t <> y UNION ALL SELECT 'actuals are required' FROM r WHERE a IS NULL UNION ALL SELECT 'actuals length must match horizon' FROM r WHERE a <> 3"
    " UNION ALL SELECT 'series ids must be unique' FROM r GROUP BY series_id HAVING count(*) > 1) GROUP BY 1",
)
def p03_request_arrays(spark, sf):
    k = F.col("event_id")
    rep = lambda m: F.array_repeat("value", (k % m).cast("int"))
    req = table(spark, sf, "events").select(
        F.when(k % 50 == 0, "twice").otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("series_id"), rep(4).alias("timestamps"), rep(3).alias("target"), F.when(k % 6 != 0, rep(5)).alias("actuals")
    )
    return cv.request_violations(req, 3, [0.1, 0.9], need_actuals=True).groupBy("problem").agg(F.count(F.lit(1)).alias("requests"))


@query("p06_normalize_covariates", COV + " SELECT role, name, count(*) AS rows FROM cov WHERE role <> 'future' OR name = 'hits' GROUP BY 1, 2")
def p06_normalize_covariates(spark, sf):
    return cv.normalize(covariates(spark, sf)).groupBy("role", "name").agg(F.count(F.lit(1)).alias("rows"))


@query("u02_known_future_names", COV + " SELECT series_id, name FROM cov WHERE role = 'past' INTERSECT SELECT series_id, name FROM cov WHERE role = 'future'")
def u02_known_future_names(spark, sf):
    return cv.known_future(covariates(spark, sf))


@query("u03_future_only_names", COV + " SELECT series_id, name FROM cov WHERE role = 'future' EXCEPT SELECT series_id, name FROM cov WHERE role = 'past'")
def u03_future_only_names(spark, sf):
    return cv.future_only(covariates(spark, sf))


@query("p07_covariate_profile", COV + ' SELECT series_id, name, grp AS "group", kind FROM prof')
def p07_covariate_profile(spark, sf):
    return cv.profile(covariates(spark, sf))


@query(
    "p08_capability_filter",
    COV + ", b AS (SELECT * FROM prof WHERE grp = 'static' OR grp = 'known_future' OR kind <> 'numeric') SELECT 'warning' AS what, 'ignoring unsupported covariate: model ''toto-open-base-1.0'' (family=toto) does not support '"
    " || CASE grp WHEN 'past_only' THEN 'past-only' WHEN 'known_future' THEN 'known-future' ELSE 'static' END || CASE WHEN grp = 'static' THEN '' ELSE ' ' || kind END || ' covariates; series=''' || series_id || ''' covariate=''' || name || '''' AS label, CAST(1 AS BIGINT) AS rows FROM b"
    " UNION ALL SELECT 'kept', role || '/' || name, count(*) FROM cov WHERE (series_id, name) IN (SELECT series_id, name FROM prof WHERE grp = 'past_only' AND kind = 'numeric') GROUP BY 2",
)
def p08_capability_filter(spark, sf):
    kept, warnings = cv.apply_capabilities(covariates(spark, sf), "toto-open-base-1.0")
    w = warnings.select(F.lit("warning").alias("what"), F.col("warning").alias("label"), F.lit(1).cast("long").alias("rows"))
    k = kept.groupBy(F.lit("kept").alias("what"), F.concat_ws("/", "role", "name").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return w.unionByName(k)


@query(
    "p09_policy_subset",
    COV + ", nk AS (SELECT series_id, role, name FROM kd WHERE role <> 'static' AND kind = 'numeric'), num AS (SELECT c.* FROM cov c SEMI JOIN nk ON nk.series_id = c.series_id AND nk.role = c.role AND nk.name = c.name),"
    " p AS (SELECT DISTINCT series_id, name FROM num WHERE role = 'past')"
    " SELECT 'nhits' AS model, role, name, count(*) AS rows FROM num WHERE role = 'past' OR (series_id, name) IN (SELECT series_id, name FROM p) GROUP BY 2, 3 UNION ALL SELECT 'toto-open-base-1.0', role, name, count(*) FROM num WHERE role = 'past' GROUP BY 2, 3"
    " UNION ALL SELECT 'chronos2', role, name, count(*) FROM cov WHERE role <> 'static' GROUP BY 2, 3",
)
def p09_policy_subset(spark, sf):
    cov, res = covariates(spark, sf), None
    for m in ("nhits", "toto-open-base-1.0", "chronos2", "sundial-base-128m"):
        one = cv.apply_policy(cov, m).groupBy(F.lit(m).alias("model"), "role", "name").agg(F.count(F.lit(1)).alias("rows"))
        res = one if res is None else res.unionByName(one)
    return res


EXO = (
    ED + ", c AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS hits, round(max(value), 2) AS peak FROM events GROUP BY 1, 2), w AS (SELECT series_id, max(ts) AS t FROM panel GROUP BY 1),"
    " pc AS (SELECT p.series_id, p.ts, CASE WHEN day(p.ts) % 6 = 0 THEN 0.0 ELSE hits END AS hits, peak FROM panel p JOIN c ON c.series_id = p.series_id AND c.ts = p.ts),"
    " lp AS (SELECT series_id, arg_max(hits, ts) FILTER (WHERE day(ts) % 6 <> 0) AS lh, arg_max(peak, ts) AS lk FROM pc GROUP BY 1)"
    " SELECT series_id, 'past' AS role, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hits, peak FROM pc UNION ALL"
    " SELECT w.series_id, 'future', strftime(t + to_days(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S'), CASE WHEN k <= 2 THEN k * 10.0 ELSE lh END, lk FROM w JOIN lp ON lp.series_id = w.series_id, range(1, 6) AS r(k)"
)


@query("p10_exogenous_columns", EXO)
def p10_exogenous_columns(spark, sf):
    """Every sixth day lacks `hits`; two future days of `hits` are known, `peak` has no future."""
    panel = pn.events_daily(spark, sf)
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("hits"), F.round(F.max("value"), 2).alias("peak"))
    past = d.select("series_id", "ts", F.lit("past").alias("role"), F.inline(F.array(F.struct(F.lit("hits").alias("name"), F.when(F.dayofmonth("ts") % 6 != 0, F.col("hits")).alias("num")), F.struct(F.lit("peak").alias("name"), F.col("peak").alias("num")))))
    ends = panel.groupBy("series_id").agg(F.max("ts").alias("t"))
    fut = ends.select("series_id", F.lit("future").alias("role"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"), "t").select(
        "series_id", F.timestamp_seconds(F.unix_seconds("t") + F.col("k") * 86400).alias("ts"), "role", F.lit("hits").alias("name"), (F.col("k") * 10.0).cast("double").alias("num")
    )
    return cv.assemble_exogenous(panel, past.unionByName(fut), 5, ["hits", "peak"], "D").select("series_id", "role", pn.stamp(), "hits", "peak")


@query(
    "p16_calendar_covariates",
    ED + ", r AS (SELECT series_id, 'past' AS role, ts FROM panel UNION ALL SELECT series_id, 'future', max(ts) + to_days(CAST(k AS INTEGER)) FROM panel, range(1, 8) AS r(k) GROUP BY series_id, k)"
    " SELECT series_id, role, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(isodow(ts) - 1 AS DOUBLE) AS calendar_num, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS calendar_cat FROM r",
)
def p16_calendar_covariates(spark, sf):
    return cv.calendar(pn.events_daily(spark, sf), 7, "D").withColumn("ts", pn.stamp())
