"""Series analysis on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import analysis as an, attribution as at, decompose as dc, folds, forecast as fc
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import HOLD
from tidepanel.plans.q_prep import ED, MA7, OD, out

EPOCH = "epoch_us({})"
# Several panels side by side, so every frequency rule meets data that triggers it.
MIX = (
    f"WITH {pn.EVENTS_DAILY}, {pn.EVENTS_HOURLY}, {pn.ORDERS_DAILY}, {pn.SHIP_MONTHLY}, {pn.EVENTS_RAW},"
    " biz AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n"
    " FROM events_daily WHERE isodow(ts) <= 5),"
    " qtr AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n"
    " FROM (SELECT l_returnflag AS series_id, date_trunc('quarter', l_shipdate) AS ts, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1, 2)),"
    " panel AS (SELECT 'd:' || series_id AS series_id, ts, pos, n, y FROM events_daily UNION ALL SELECT 'h:' || series_id, ts, pos, n, y FROM events_hourly"
    " UNION ALL SELECT 'o:' || series_id, ts, pos, n, y FROM orders_daily UNION ALL SELECT 'm:' || series_id, ts, pos, n, y FROM ship_monthly"
    " UNION ALL SELECT 'q:' || series_id, ts, pos, n, y FROM qtr"
    " UNION ALL SELECT 'b:' || series_id, ts, pos, n, y FROM biz UNION ALL SELECT 'r:' || series_id, ts, pos, n, y FROM events_raw),"
    " d AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS delta, lag(ts) OVER w AS prev FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos))"
)
REG = (
    MIX + ", dcnt AS (SELECT series_id, delta, count(*) AS c FROM d WHERE delta IS NOT NULL GROUP BY 1, 2),"
    " dom AS (SELECT series_id, delta AS dominant, c AS topc FROM dcnt WHERE delta > 0 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY c DESC, delta) = 1),"
    " tot AS (SELECT series_id, CAST(sum(c) AS BIGINT) AS alln, CAST(coalesce(sum(c) FILTER (WHERE delta > 0), 0) AS BIGINT) AS posn FROM dcnt GROUP BY 1),"
    " reg AS (SELECT i.series_id, dominant, CAST(topc AS DOUBLE) / posn AS share, coalesce(CAST(topc AS DOUBLE) / alln, 0.0) AS all_share, coalesce(posn, 0) AS deltas"
    " FROM (SELECT DISTINCT series_id FROM panel) i LEFT JOIN dom ON dom.series_id = i.series_id LEFT JOIN tot ON tot.series_id = i.series_id)"
)
_MON = "['" + "','".join(an.MONTHS) + "']"
_DOW = "['" + "','".join(an.DAYS) + "']"
_LEFT = "(day(last_day(ts)) - day(ts))"
_SEC = (
    "CASE WHEN {s} <= 0 OR {s} <> floor({s}) THEN NULL WHEN {s} % 86400 = 0 THEN CASE WHEN {s} = 86400 THEN '' ELSE CAST(CAST({s} // 86400 AS BIGINT) AS VARCHAR) END || 'D'"
    " WHEN {s} % 3600 = 0 THEN CASE WHEN {s} = 3600 THEN '' ELSE CAST(CAST({s} // 3600 AS BIGINT) AS VARCHAR) END || 'h'"
    " WHEN {s} % 60 = 0 THEN CASE WHEN {s} = 60 THEN '' ELSE CAST(CAST({s} // 60 AS BIGINT) AS VARCHAR) END || 'min'"
    " ELSE CASE WHEN {s} = 1 THEN '' ELSE CAST(CAST({s} AS BIGINT) AS VARCHAR) END || 's' END"
)


def _cnt(n, text):
    return f"CASE WHEN {n} = 1 THEN '' ELSE CAST({n} AS VARCHAR) END || {text}"


ALIAS = (
    REG + ", fx AS (SELECT series_id, max(n) AS n, min(delta) AS lo, max(delta) AS hi,"
    " min((year(ts) * 12 + month(ts)) - (year(prev) * 12 + month(prev))) AS mlo, max((year(ts) * 12 + month(ts)) - (year(prev) * 12 + month(prev))) AS mhi,"
    " min(year(ts) - year(prev)) AS ylo, max(year(ts) - year(prev)) AS yhi, min(month(ts)) AS m_lo, max(month(ts)) AS m_hi,"
    " arg_min(month(ts), pos) AS m0, arg_min(isodow(ts), pos) AS w0,"
    f" CASE WHEN bool_and(day(ts) = 1) THEN 'cs' WHEN bool_and((day(ts) = 1 AND isodow(ts) <= 5) OR (day(ts) <= 3 AND isodow(ts) = 1)) THEN 'bs'"
    f" WHEN bool_and({_LEFT} = 0) THEN 'ce' WHEN bool_and(({_LEFT} = 0 AND isodow(ts) <= 5) OR ({_LEFT} < 3 AND isodow(ts) = 5)) THEN 'be' END AS k,"
    " bool_and(isodow(ts) <= 5 AND (prev IS NULL OR delta = 86400 OR (delta = 259200 AND isodow(ts) = 1))) AS biz FROM d GROUP BY 1),"
    " al AS (SELECT series_id, n, CASE WHEN n < 3 OR lo <= 0 THEN NULL"
    f" WHEN lo % 86400 = 0 AND k IS NOT NULL AND ylo = yhi AND m_lo = m_hi THEN {_cnt('ylo', '(CASE WHEN k[1] = chr(98) THEN chr(66) ELSE chr(32) END)')} || 'Y' || '-' || {_MON}[m0]"
    f" WHEN lo % 86400 = 0 AND k IS NOT NULL AND mlo = mhi AND mlo % 3 = 0 AND mlo > 0 THEN {_cnt('(mlo // 3)', chr(39) + 'Q' + chr(39))} || CASE WHEN k IN ('cs', 'bs') THEN 'S' ELSE 'E' END"
    " || '-' || CASE m0 % 3 WHEN 0 THEN 'DEC' WHEN 1 THEN 'OCT' ELSE 'NOV' END"
    f" WHEN lo % 86400 = 0 AND k IS NOT NULL AND mlo = mhi AND mlo > 0 THEN {_cnt('mlo', 'CASE k WHEN ' + chr(39) + 'cs' + chr(39) + ' THEN ' + chr(39) + 'MS' + chr(39) + ' WHEN ' + chr(39) + 'ce' + chr(39) + ' THEN ' + chr(39) + 'ME' + chr(39) + ' WHEN ' + chr(39) + 'bs' + chr(39) + ' THEN ' + chr(39) + 'BMS' + chr(39) + ' ELSE ' + chr(39) + 'BME' + chr(39) + ' END')}"
    f" WHEN lo % 86400 = 0 AND lo = hi AND lo % 604800 = 0 THEN {_cnt('CAST(lo // 604800 AS BIGINT)', chr(39) + 'W-' + chr(39))} || {_DOW}[w0]"
    f" WHEN lo % 86400 = 0 AND lo = hi THEN {_cnt('CAST(lo // 86400 AS BIGINT)', chr(39) + 'D' + chr(39))}"
    f" WHEN lo % 86400 = 0 AND biz THEN 'B' WHEN lo % 86400 <> 0 AND lo = hi AND lo = floor(lo) THEN {_SEC.format(s='lo')} END AS alias FROM fx)"
)


def mixed(spark, sf):
    """Daily, hourly, business-day, monthly, quarterly and raw panels stacked under prefixed ids."""
    from tidepanel.operators.blocks import number_rows
    from tidepanel.session import table

    li = table(spark, sf, "lineitem")
    quarter = number_rows(
        li.groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("quarter", "l_shipdate").alias("ts")).agg(
            F.round(F.sum("l_extendedprice"), 2).alias("y")
        ),
        bucket_seconds=None,
    )
    biz = number_rows(pn.events_daily(spark, sf).where(F.weekday("ts") < 5).select("series_id", "ts", "y"), bucket_seconds=None)
    parts = [
        ("d:", pn.events_daily(spark, sf)),
        ("h:", pn.events_hourly(spark, sf)),
        ("o:", pn.orders_daily(spark, sf)),
        ("m:", pn.ship_monthly(spark, sf)),
        ("q:", quarter),
        ("b:", biz),
        ("r:", pn.events_raw(spark, sf)),
    ]
    res = None
    for prefix, p in parts:
        one = p.select(F.concat(F.lit(prefix), "series_id").alias("series_id"), "ts", "pos", "n", "y")
        res = one if res is None else res.unionByName(one)
    return res


@query("y05_regularity_score", REG + " SELECT series_id, dominant, round(all_share, 6) AS regularity, deltas FROM reg")
def y05_regularity_score(spark, sf):
    return an.regularity(mixed(spark, sf)).select(
        "series_id", "dominant", F.round("all_share", 6).alias("regularity"), "deltas"
    )


_NEAR = "CASE WHEN med IS NULL THEN 'irregular' ELSE (SELECT arg_min(a, (abs(ln(greatest(med, 1e-9) / s)), i)) FROM (VALUES " + ", ".join(
    f"({i}, '{a}', {s})" for i, (a, s) in enumerate(an.NEAREST)
) + ") AS v(i, a, s)) END"


@query(
    "y01_detect_frequency",
    ALIAS + ", med AS (SELECT series_id, quantile_cont(delta, 0.5) AS med FROM d WHERE delta > 0 GROUP BY 1),"
    " j AS (SELECT al.series_id, n, alias, all_share, med FROM al JOIN reg USING (series_id) LEFT JOIN med USING (series_id)),"
    " nr AS (SELECT series_id, arg_min(a, abs(ln(greatest(med, 1e-9) / s)) + i * 1e-12) AS near FROM j, (VALUES "
    + ", ".join(f"({i}, '{a}', {s})" for i, (a, s) in enumerate(an.NEAREST))
    + ") AS v(i, a, s) WHERE med IS NOT NULL GROUP BY 1)"
    " SELECT j.series_id, CASE WHEN n < 3 THEN 'unknown' WHEN alias IS NOT NULL THEN alias WHEN all_share >= 0.8 THEN coalesce(near, 'irregular') ELSE 'irregular' END AS frequency,"
    " round(CASE WHEN n < 3 THEN 0.0 ELSE all_share END, 6) AS regularity FROM j LEFT JOIN nr ON nr.series_id = j.series_id",
)
def y01_detect_frequency(spark, sf):
    return an.detect_frequency(mixed(spark, sf)).withColumn("regularity", F.round("regularity", 6))


DOM = "CASE WHEN deltas >= 2 AND ({share} >= {min} OR (deltas >= 1000 AND {share} >= 0.5)) THEN " + _SEC.format(s="dominant") + " END"


@query(
    "y02_ingest_frequency",
    ALIAS + f" SELECT series_id, coalesce(alias, {DOM.format(share='share', min=0.8)}, {DOM.format(share='share', min=0.5)}, 'auto') AS frequency FROM al JOIN reg USING (series_id)",
)
def y02_ingest_frequency(spark, sf):
    return an.ingest_frequency(mixed(spark, sf), imputing=True)


@query(
    "y03_request_frequency",
    ALIAS + ", bz AS (SELECT series_id, bool_and(isodow(ts) <= 5) AS wk, avg(CASE WHEN round(delta / 86400) > 0 THEN CASE WHEN round(delta / 86400) IN (1, 3, 4) THEN 1.0 ELSE 0.0 END END) AS usual,"
    " bool_or(round(delta / 86400) >= 3) AS wide FROM d GROUP BY 1),"
    f" x AS (SELECT series_id, alias, {DOM.format(share='all_share', min=0.8)} AS dom, dominant = 86400 AND wk AND wide AND usual >= 0.95 AS b FROM al JOIN reg USING (series_id) JOIN bz USING (series_id))"
    " SELECT series_id, coalesce(alias, CASE WHEN dom IS NOT NULL AND b THEN 'B' ELSE dom END) AS frequency FROM x",
)
def y03_request_frequency(spark, sf):
    return an.request_frequency(mixed(spark, sf))


@query(
    "y04_median_frequency",
    MIX + ", med AS (SELECT i.series_id, med FROM (SELECT DISTINCT series_id FROM panel) i LEFT JOIN (SELECT series_id, quantile_cont(delta, 0.5) AS med FROM d WHERE delta > 0 GROUP BY 1) m USING (series_id))"
    " SELECT series_id, CASE WHEN med IS NULL THEN 'D' "
    + " ".join(f"WHEN abs(med - {s}) <= {max(1.0, s * 0.25)} THEN '{a}'" for s, a in an.LADDER)
    + " "
    + " ".join(f"WHEN med < {b} THEN '{a}'" for b, a in an.LADDER_BELOW)
    + " ELSE 'M' END AS frequency FROM med",
)
def y04_median_frequency(spark, sf):
    return an.median_frequency(mixed(spark, sf))


# ---- autocorrelation, seasonality ------------------------------------------------------------

ACF = (
    OD + ", lags AS (SELECT CAST(lag AS INTEGER) AS lag FROM range(1, 366) AS r(lag)),"
    " ac AS (SELECT a.series_id, lag, coalesce(CASE WHEN isnan(corr(a.y, b.y)) THEN 0 ELSE corr(a.y, b.y) END, 0) AS c, max(a.n) AS n,"
    " sum((a.y - m) * (b.y - m)) / max(v) AS sxy FROM panel a JOIN (SELECT series_id, avg(y) AS m, var_pop(y) AS v FROM panel GROUP BY 1) s ON s.series_id = a.series_id,"
    " lags, panel b WHERE b.series_id = a.series_id AND b.pos = a.pos + lag GROUP BY 1, 2)"
)


@query("c23_autocorrelation", ACF + " SELECT series_id, lag, round(c, 6) AS pearson, round(sxy / n, 6) AS biased, round(sxy / (n - lag), 6) AS unbiased FROM ac")
def c23_autocorrelation(spark, sf):
    a = an.acf(pn.orders_daily(spark, sf), 365)
    return a.select("series_id", "lag", *[F.round(c, 6).alias(c) for c in ("pearson", "biased", "unbiased")])


SEAS = (
    ACF + ", u AS (SELECT *, lag(c, 1, -1) OVER w AS pc, lead(c, 1, -1) OVER w AS nc FROM ac WHERE lag >= 2 AND lag <= greatest(2, n // 2)"
    " WINDOW w AS (PARTITION BY series_id ORDER BY lag)), pk AS (SELECT *, c >= 0.3 AND c >= pc AND c >= nc AS peak FROM u),"
    " pool AS (SELECT * FROM pk WHERE c >= 0.3 AND (peak OR series_id NOT IN (SELECT series_id FROM pk WHERE peak))),"
    " best AS (SELECT series_id, lag FROM pool QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY c DESC, lag) <= {k}),"
    " seas AS (SELECT i.series_id, coalesce(p, '') AS periods FROM (SELECT DISTINCT series_id FROM panel) i LEFT JOIN"
    " (SELECT series_id, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) AS p FROM best GROUP BY 1) b ON b.series_id = i.series_id)"
)
# The hourly counts carry a daily rhythm; daily orders are close to noise.
SEAS_H = SEAS.replace("SELECT * FROM orders_daily", "SELECT * FROM ship_monthly").replace(pn.ORDERS_DAILY, pn.SHIP_MONTHLY)


@query("y06_seasonality", SEAS_H.format(k=3) + " SELECT * FROM seas")
def y06_seasonality(spark, sf):
    return an.seasonality(pn.ship_monthly(spark, sf)).select("series_id", F.array_join("periods", ",").alias("periods"))


@query("t04_top_seasonal_lags", SEAS_H.format(k=5) + " SELECT * FROM seas")
def t04_top_seasonal_lags(spark, sf):
    return an.seasonality(pn.ship_monthly(spark, sf), top_k=5).select("series_id", F.array_join("periods", ",").alias("periods"))


@query(
    "y14_detect_period",
    ACF.replace("SELECT * FROM orders_daily", "SELECT * FROM ship_monthly").replace(pn.ORDERS_DAILY, pn.SHIP_MONTHLY)
    + ", u AS (SELECT *, lag(sxy) OVER w AS pc, lead(sxy) OVER w AS nc FROM ac WHERE lag < least(n // 2, 365) WINDOW w AS (PARTITION BY series_id ORDER BY lag)),"
    " f AS (SELECT series_id, min(lag) AS p FROM u WHERE lag >= 2 AND sxy / n > 0.1 AND sxy > pc AND sxy > nc GROUP BY 1)"
    " SELECT i.series_id, CAST(CASE WHEN n < 10 OR v = 0 THEN 1 ELSE coalesce(p, CASE WHEN n >= 365 THEN 7 WHEN n >= 52 THEN 12 ELSE 1 END) END AS INTEGER) AS period"
    " FROM (SELECT series_id, max(n) AS n, var_pop(y) AS v FROM panel GROUP BY 1) i LEFT JOIN f ON f.series_id = i.series_id",
)
def y14_detect_period(spark, sf):
    return an.detect_period(pn.ship_monthly(spark, sf))


@query(
    "c24_dominant_period",
    ED + ", ks AS (SELECT series_id, n, k, sqrt(pow(sum((y - m) * cos(2 * pi() * k * pos / n)), 2) + pow(sum((y - m) * sin(2 * pi() * k * pos / n)), 2)) AS p"
    " FROM (SELECT *, avg(y) OVER (PARTITION BY series_id) AS m FROM panel), range(1, 1000) AS r(k) WHERE k <= n // 2 GROUP BY 1, 2, 3),"
    " b AS (SELECT series_id, n // k AS p, n FROM ks QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(p, 9) DESC, k) = 1)"
    " SELECT series_id, CAST(CASE WHEN p >= 2 AND p <= n // 2 THEN p END AS DOUBLE) AS period FROM b",
)
def c24_dominant_period(spark, sf):
    return an.dominant_period(pn.events_daily(spark, sf)).withColumn("period", F.col("period").cast("double"))


# ---- trend, anomalies, stationarity ----------------------------------------------------------

TREND = (
    ", tr AS (SELECT series_id, CASE WHEN max(n) < 2 THEN 0 ELSE coalesce(regr_slope(y, pos), 0) END AS slope, CASE WHEN max(n) < 2 OR var_pop(y) = 0 THEN 0"
    " ELSE greatest(0, least(1, regr_r2(y, pos))) END AS r2, greatest(abs(avg(y)), 1.0) AS scale FROM {p} GROUP BY 1)"
)
DIR = "CASE WHEN abs(slope) / scale < 1e-3 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END"


@query("y07_trend", MIX + TREND.format(p="panel") + f" SELECT series_id, round(slope, 4) AS slope, round(r2, 6) AS r2, {DIR} AS direction FROM tr")
def y07_trend(spark, sf):
    t = an.trend(mixed(spark, sf))
    return t.select("series_id", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), "direction")


IQR = (
    ", q AS (SELECT series_id, max(n) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM panel GROUP BY 1),"
    " b AS (SELECT series_id, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE n >= 4 AND q3 > q1),"
    " an AS (SELECT p.*, iqr, lo, hi, y < lo OR y > hi AS x FROM panel p JOIN b USING (series_id))"
)


@query("y08_anomalies", MIX + IQR + " SELECT series_id, pos, y AS value FROM an WHERE x")
def y08_anomalies(spark, sf):
    return an.anomalies(mixed(spark, sf)).select("series_id", "pos", F.col("y").alias("value"))


RECS = (
    IQR + ", c AS (SELECT *, coalesce(lag(x) OVER w, false) AS px, coalesce(lead(x) OVER w, false) AS nx, y - coalesce(lag(y) OVER w, y) AS b4,"
    " coalesce(lead(y) OVER w, y) - y AS af FROM an WINDOW w AS (PARTITION BY series_id ORDER BY pos)),"
    " r AS (SELECT *, CASE WHEN px OR nx THEN 'shift' WHEN b4 * af < 0 AND (abs(b4) > iqr OR abs(af) > iqr) THEN 'trend_break' WHEN y > hi THEN 'spike'"
    " WHEN y < lo THEN 'dip' ELSE 'trend_break' END AS type, greatest(CASE WHEN y > hi THEN y - hi ELSE lo - y END, 0) / iqr AS far FROM c WHERE x)"
)


@query(
    "y09_anomaly_records",
    MIX + RECS + " SELECT series_id, pos, type, CASE WHEN far >= 2 THEN 'high' WHEN far >= 1 THEN 'medium' ELSE 'low' END AS severity, y AS value,"
    " greatest(pos - 1, 0) AS range_start, least(n - 1, pos + 1) AS range_end, CASE type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in an.HANDLING.items()) + " END AS handling FROM r",
)
def y09_anomaly_records(spark, sf):
    return an.anomaly_records(mixed(spark, sf))


@query("w18_anomaly_types", MIX + RECS + " SELECT series_id, type, count(*) AS points FROM r GROUP BY 1, 2")
def w18_anomaly_types(spark, sf):
    return an.anomaly_records(mixed(spark, sf)).groupBy("series_id", "type").agg(F.count(F.lit(1)).alias("points"))


HALF = (
    ", h AS (SELECT series_id, max(n) AS n, avg(y) FILTER (WHERE pos < n // 2) AS m1, avg(y) FILTER (WHERE pos >= n // 2) AS m2, var_pop(y) FILTER (WHERE pos < n // 2) AS v1,"
    " var_pop(y) FILTER (WHERE pos >= n // 2) AS v2, avg(y) AS m, stddev_pop(y) AS sd FROM {p} GROUP BY 1),"
    " stn AS (SELECT series_id, CASE WHEN n >= 8 THEN abs(m1 - m2) / greatest(abs(m), sd, 1.0) <= 0.25 AND CASE WHEN v1 <= 1e-12 AND v2 <= 1e-12 THEN true"
    " WHEN v1 <= 1e-12 OR v2 <= 1e-12 THEN false ELSE greatest(v1, v2) / least(v1, v2) <= 2.5 END END AS stationary FROM h)"
)


@query("w17_split_halves", MIX + HALF.format(p="panel") + " SELECT series_id, round(m1, 7) AS mean_1, round(m2, 7) AS mean_2, round(sqrt(v1), 6) AS sd_1, round(sqrt(v2), 6) AS sd_2 FROM h")
def w17_split_halves(spark, sf):
    s = an.split_halves(mixed(spark, sf))
    return s.select(
        "series_id", F.round("mean_1", 7).alias("mean_1"), F.round("mean_2", 7).alias("mean_2"),
        F.round(F.sqrt("var_1"), 6).alias("sd_1"), F.round(F.sqrt("var_2"), 6).alias("sd_2"),
    )


@query("y10_stationarity", MIX + HALF.format(p="panel") + " SELECT series_id, stationary FROM stn")
def y10_stationarity(spark, sf):
    return an.stationarity(mixed(spark, sf))


@query(
    "y11_data_quality",
    REG + " SELECT p.series_id, round(0.5 * (count(y) + count(ts)) / (2.0 * count(*)) + 0.35 * max(all_share) + 0.15 * count(DISTINCT ts) / count(*), 6) AS quality"
    " FROM panel p JOIN reg USING (series_id) GROUP BY 1",
)
def y11_data_quality(spark, sf):
    panel = mixed(spark, sf)
    scores = an.regularity(panel).select("series_id", F.col("all_share").alias("regularity"))
    return an.data_quality(panel, scores)


# Analysis of monthly shipments, as SQL; shared with the narrative queries.
ANALYSIS = (
    SEAS_H.format(k=3) + TREND.format(p="panel") + IQR + HALF.format(p="panel")
    + f", ana AS (SELECT i.series_id, 'MS' AS frequency, seas.periods, {DIR} AS direction, round(r2, 6) AS r2, coalesce(a.c, 0) AS anomalies, stationary, n, 0.65 + 0.35 * topc / (n - 1) AS quality"
    " FROM (SELECT series_id, max(n) AS n FROM panel GROUP BY 1) i JOIN seas ON seas.series_id = i.series_id JOIN tr ON tr.series_id = i.series_id"
    " LEFT JOIN (SELECT series_id, count(*) AS c FROM an WHERE x GROUP BY 1) a ON a.series_id = i.series_id JOIN stn ON stn.series_id = i.series_id"
    " JOIN (SELECT series_id, max(c) AS topc FROM (SELECT series_id, g, count(*) AS c FROM (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER"
    " (PARTITION BY series_id ORDER BY pos)) AS g FROM panel) WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1) rg ON rg.series_id = i.series_id)"
)


@query("y12_composite_analysis", ANALYSIS + " SELECT series_id, frequency, periods, direction, r2, anomalies, stationary, round(quality, 6) AS quality, '' AS warnings FROM ana")
def y12_composite_analysis(spark, sf):
    a = an.analyze(pn.ship_monthly(spark, sf))
    return a.select(
        "series_id", "frequency", F.array_join("periods", ",").alias("periods"), "direction", F.round("r2", 6).alias("r2"),
        "anomalies", "stationary", "quality", F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "a23_unique_counts",
    MIX + " SELECT series_id, count(*) AS rows, count(DISTINCT ts) AS unique_ts, round(CAST(count(DISTINCT ts) AS DOUBLE) / count(*), 6) AS uniqueness FROM panel GROUP BY 1",
)
def a23_unique_counts(spark, sf):
    per_ts = mixed(spark, sf).groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("c"))
    g = per_ts.groupBy("series_id").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("unique_ts"))
    return g.withColumn("uniqueness", F.round(F.col("unique_ts") / F.col("rows"), 6))


@query(
    "u04_merged_warnings",
    MIX + ", c AS (SELECT series_id, max(n) AS n FROM panel GROUP BY 1) SELECT DISTINCT series_id || ': ' || w AS warning FROM c,"
    " (VALUES (40, 'fewer than 40 points'), (100, 'fewer than 100 points')) AS v(k, w) WHERE n < k",
)
def u04_merged_warnings(spark, sf):
    c = mixed(spark, sf).groupBy("series_id").agg(F.max("n").alias("n"))
    notes = F.array_compact(
        F.array(F.when(F.col("n") < 40, F.lit("fewer than 40 points")), F.when(F.col("n") < 100, F.lit("fewer than 100 points")))
    )
    return an.merged_warnings(c.withColumn("warnings", notes))


# ---- decomposition ---------------------------------------------------------------------------

STRENGTH = (
    " , vr AS (SELECT series_id, CASE WHEN var_pop(y) = 0 THEN 1 ELSE var_pop(y) END AS v, var_pop(trend) AS t, var_pop(seasonal) AS s, var_pop(resid) AS r FROM {p} GROUP BY 1)"
    " SELECT series_id, round(t / v, 4) AS trend_strength, round(s / v, 4) AS seasonal_strength, round(r / v, 4) AS residual_ratio,"
    " CASE WHEN round(t / (t + s + r), 4) >= round(s / (t + s + r), 4) AND round(t / (t + s + r), 4) >= round(r / (t + s + r), 4) THEN 'trend'"
    " WHEN round(s / (t + s + r), 4) >= round(r / (t + s + r), 4) THEN 'seasonal' ELSE 'residual' END AS dominant FROM vr"
)


def _strengths(parts):
    s = dc.strengths(parts)
    return s.select(
        "series_id", *[F.round(c, 4).alias(c) for c in ("trend_strength", "seasonal_strength", "residual_ratio")], "dominant"
    )


@query("y13_decompose_moving_average", MA7 + ", parts AS (SELECT *, y - trend - seasonal AS resid FROM m)" + STRENGTH.format(p="parts"))
def y13_decompose_moving_average(spark, sf):
    return _strengths(dc.moving_average(pn.orders_daily(spark, sf), 7))


CLASSIC = (
    f"WITH {pn.SHIP_MONTHLY}, panel AS (SELECT * FROM ship_monthly), t AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN"
    " (sum(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 END AS tt"
    " FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY pos)), ph AS (SELECT series_id, pos % 12 AS ph, avg({d}) AS m FROM t GROUP BY 1, 2),"
    " se AS (SELECT series_id, ph, m {op} avg(m) OVER (PARTITION BY series_id) AS seasonal FROM ph),"
    " parts AS (SELECT t.series_id, pos, y, coalesce(tt, 0) AS trend, seasonal, coalesce(y {op} tt {op} seasonal, 0) AS resid FROM t JOIN se ON se.series_id = t.series_id AND se.ph = pos % 12)"
)


@query("y13_decompose_additive", CLASSIC.format(d="y - tt", op="-") + STRENGTH.format(p="parts"))
def y13_decompose_additive(spark, sf):
    return _strengths(dc.classical(pn.ship_monthly(spark, sf), 12, "additive"))


@query("y13_decompose_multiplicative", CLASSIC.format(d="y / tt", op="/") + " SELECT series_id, pos, round(trend, 1) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM parts")
def y13_decompose_multiplicative(spark, sf):
    p = dc.classical(pn.ship_monthly(spark, sf), 12, "multiplicative")
    return p.select("series_id", "pos", F.round("trend", 1).alias("trend"), F.round("seasonal", 6).alias("seasonal"), F.round("resid", 6).alias("resid"))


@query("y13_decompose_stl")
def y13_decompose_stl(spark, sf):
    p = dc.stl(pn.ship_monthly(spark, sf), 12)
    return p.select("series_id", "pos", "method", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "resid")])


# ---- attribution -----------------------------------------------------------------------------

HOLD_H = HOLD + ", hl AS (SELECT *, n - 7 AS hn FROM hist)"
SHARES = (
    ", cr AS (SELECT a.series_id, lag, corr(a.y, b.y) AS c FROM hist a, (VALUES (7), (12), (24), (30)) AS v(lag), hist b WHERE b.series_id = a.series_id"
    " AND b.pos = a.pos + lag AND a.n - 7 >= 2 * lag GROUP BY 1, 2), bs AS (SELECT series_id, greatest(0, max(CASE WHEN isnan(c) THEN 0 ELSE c END)) AS s FROM cr GROUP BY 1),"
    " vl AS (SELECT series_id, stddev_pop(d) AS r FROM (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM hist) GROUP BY 1),"
    " fl AS (SELECT series_id, max(n) - 7 AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b, arg_max(y, pos) AS lst FROM hist GROUP BY 1),"
    " sh AS (SELECT fl.series_id, abs(my + b * (n - 1 + 7 - mx) - lst) AS t, coalesce(s, 0) AS s, r FROM fl LEFT JOIN bs USING (series_id) JOIN vl USING (series_id))"
)


@query(
    "y15_history_shares",
    HOLD + SHARES + " SELECT series_id, round(t / (t + s + r), 4) AS trend, round(s / (t + s + r), 4) AS seasonal, round(r / (t + s + r), 4) AS residual,"
    " CASE WHEN t >= s AND t >= r THEN 'trend' WHEN s >= r THEN 'seasonal' ELSE 'residual' END AS dominant_driver FROM sh",
)
def y15_history_shares(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    return at.history_shares(history, fc.linear_trend(history, 7))


IMPORTANCE = (
    ", i0 AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY series_id ORDER BY pos), 0) AS dl, abs(y - avg(y) OVER (PARTITION BY series_id)) AS mg FROM panel),"
    " i1 AS (SELECT *, 0.45 * (pos + 1) / n + 0.35 * coalesce(abs(dl) / nullif(max(abs(dl)) OVER (PARTITION BY series_id), 0), 0) + 0.2 * coalesce(mg / nullif(max(mg) OVER"
    " (PARTITION BY series_id), 0), 0) AS s FROM i0), i2 AS (SELECT *, s / max(s) OVER (PARTITION BY series_id) AS imp FROM i1),"
    " i3 AS (SELECT * FROM i2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY imp DESC, pos) <= 8)"
)


@query(
    "y16_temporal_importance",
    OD + IMPORTANCE + f" SELECT series_id, n - pos AS lag, {pn.sql_stamp()}, y AS value, round(imp, 4) AS importance, CASE WHEN dl > 0 THEN 'positive' WHEN dl < 0 THEN 'negative'"
    " ELSE 'neutral' END AS direction, CASE WHEN pos = n - 1 THEN 'most recent observation anchors the near-term forecast' WHEN imp > 0.75 THEN"
    " 'large local change and recency made this point influential' ELSE 'point contributed through recency and deviation from baseline' END AS reason FROM i3",
)
def y16_temporal_importance(spark, sf):
    t = at.temporal_importance(pn.orders_daily(spark, sf))
    return t.withColumn("ts", pn.stamp())


LAGC = (
    ED + ", z AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS d, var_pop(y) OVER (PARTITION BY series_id) AS v FROM panel),"
    " lc AS (SELECT a.series_id, b.pos - a.pos AS lag, max(a.n) AS n, abs(sum(a.d * b.d) / (max(a.v) * (max(a.n) - (b.pos - a.pos)))) AS strength FROM z a JOIN z b"
    " ON a.series_id = b.series_id AND b.pos > a.pos AND b.pos - a.pos < a.n // 2 WHERE a.n >= 4 AND a.v > 0 GROUP BY 1, 2)"
)


@query(
    "y08_long_series_bounds",
    "WITH q AS (SELECT l_returnflag AS series_id, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)"
    " SELECT series_id, n, round(q1 - 1.5 * (q3 - q1), 4) AS lo, round(q3 + 1.5 * (q3 - q1), 4) AS hi FROM q",
)
def y08_long_series_bounds(spark, sf):
    """Fences of every line item's price: series of a third of the table each."""
    panel = pn.lineitem_rows(spark, sf)
    n = panel.groupBy("series_id").agg(F.max("n").alias("n"))
    return an.anomaly_bounds(panel).drop("n").join(n, "series_id").select("series_id", "n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("c24_long_series_period")
def c24_long_series_period(spark, sf):
    """Strongest period of every line item's price; tests hold the transforms against one transform."""
    return an.dominant_period(pn.lineitem_rows(spark, sf))


@query("y17_lag_attribution", LAGC + " SELECT series_id, lag, n - 1 - lag AS pos, round(strength / sum(strength) OVER (PARTITION BY series_id), 6) AS importance FROM lc")
def y17_lag_attribution(spark, sf):
    a = at.lag_correlation(pn.events_daily(spark, sf))
    return a.select("series_id", "lag", "pos", F.round("importance", 6).alias("importance"))


@query("t05_top_attribution_lags", LAGC + " SELECT series_id, lag, round(strength, 6) AS strength FROM lc QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY strength DESC, lag) <= 5")
def t05_top_attribution_lags(spark, sf):
    t = at.top_lags(at.lag_correlation(pn.events_daily(spark, sf)))
    return t.select("series_id", "lag", F.round("strength", 6).alias("strength"))


@query(
    "y18_occlusion",
    ED + ", b AS (SELECT series_id, avg(y) AS m, arg_max(y, pos) AS lst, max(n) AS n FROM panel GROUP BY 1)"
    " SELECT p.series_id, pos, CASE WHEN pos // 5 = (b.n - 1) // 5 AND abs(m - lst) > 0 THEN round(1.0 / (b.n - ((b.n - 1) // 5) * 5), 6) ELSE 0.0 END::DOUBLE AS importance FROM panel p JOIN b USING (series_id)",
)
def y18_occlusion(spark, sf):
    """Only the window holding the last point moves a last-value forecast."""
    return out(at.occlusion(pn.events_daily(spark, sf), window=5, horizon=3), "importance")


@query(
    "y19_permutation",
    ED + ", d AS (SELECT series_id, n, pos AS spot, y AS old, CAST('0x' || substr(md5('42:' || series_id || ':' || pos || ':' || rep), 1, 15) AS BIGINT) % n AS pos FROM panel, range(1, 4) AS r(rep)),"
    " c AS (SELECT d.series_id, spot, sum(abs((1.0 / d.n + ((d.n - 1) / 2.0 + 2.0) * (spot - (d.n - 1) / 2.0) / (d.n * (d.n * d.n - 1.0) / 12.0)) * (q.y - old))) / 3 AS raw"
    " FROM d JOIN panel q ON q.series_id = d.series_id AND q.pos = d.pos GROUP BY 1, 2)"
    " SELECT series_id, spot AS pos, round(raw / sum(raw) OVER (PARTITION BY series_id), 6) AS importance FROM c",
)
def y19_permutation(spark, sf):
    return out(at.permutation(pn.events_daily(spark, sf), repeats=3, horizon=3, predict="linear_trend"), "importance")


TAIL_MEAN = (
    ED + ", b AS (SELECT series_id, avg(y) AS m FROM panel GROUP BY 1), w AS (SELECT p.series_id, pos // 4 AS w, abs(sum(CASE WHEN pos >= n - 3 THEN m - y ELSE 0 END)) / 3 / count(*) AS raw"
    " FROM panel p JOIN b USING (series_id) GROUP BY 1, 2), r AS (SELECT p.series_id, pos, raw FROM panel p JOIN w ON w.series_id = p.series_id AND w.w = pos // 4)"
    " SELECT series_id, pos, round(raw / sum(raw) OVER (PARTITION BY series_id), 6) AS importance FROM r"
)


@query("e02_user_predict_function", TAIL_MEAN)
def e02_user_predict_function(spark, sf):
    """A user's forecaster drives the attribution: mean of the last three points."""
    model = fc.GroupedModel("tail_mean", lambda y, horizon, levels: {"mean": [y[-3:].mean()] * horizon})
    return out(at.occlusion(pn.events_daily(spark, sf), window=4, horizon=2, predict=model), "importance")
