"""Readers and writers on files and messages that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import freq as fq, parse
from tidepanel.operators import context as cx, folds, forecast as fc

from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import HOLD, SCALE_SQL, Z10
from tidepanel.plans.q_prep import ED, OD
from tidepanel.session import scratch_path, table
from tidepanel.sources import readers as rd, sinks

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _events_text(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").cast("string").alias("target")
    )


@query("s01_csv_scan", f"SELECT event_type AS series_id, {TS}, value AS y FROM events")
def s01_csv_scan(spark, sf):
    """Semicolon files are written and read back by sniffing."""
    path = scratch_path(spark, "csv")
    _events_text(spark, sf).write.csv(path, header=True, sep=";")
    return rd.to_panel(rd.read_csv(spark, path)).select("series_id", pn.stamp(), "y")


@query("s01_csv_preamble", f"SELECT event_type AS series_id, {TS}, value AS y FROM events")
def s01_csv_preamble(spark, sf):
    """Every file starts with two lines that are not data."""
    path = scratch_path(spark, "preamble")
    part = F.pmod(F.hash("timestamp", "target"), F.lit(8))
    e = _events_text(spark, sf).select(F.concat_ws("|", "series_id", "timestamp", "target").alias("value"), part.alias("k"), F.lit(3).alias("o"))
    top = spark.createDataFrame([("Data Source|Events", 0), ("Last Updated", 1), ("series_id|timestamp|target", 2)], "value string, o int")
    head = top.select("value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "o")
    e.unionByName(head).repartition(8, "k").sortWithinPartitions("k", "o").select("value", "k").write.partitionBy("k").text(path)
    return rd.to_panel(rd.read_csv(spark, path)).select("series_id", pn.stamp(), "y")


@query("s02_bom_and_header_trim", f"SELECT event_type AS series_id, {TS}, value AS y FROM events")
def s02_bom_and_header_trim(spark, sf):
    path = scratch_path(spark, "bom")
    e = _events_text(spark, sf)
    e.select(F.col("series_id").alias("﻿ series_id "), F.col("timestamp").alias(" timestamp"), F.col("target").alias("target ")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.to_panel(rd.read_csv(spark, path)).select("series_id", pn.stamp(), "y")


@query("s03_parquet_scan", "SELECT o_orderpriority AS series_id, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def s03_parquet_scan(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return o.groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s06_column_roles", f"SELECT event_type AS series_id, {TS}, value AS y FROM events")
def s06_column_roles(spark, sf):
    """Roles found by name, whatever the case: DATE, Entity and the only numeric column."""
    ev = table(spark, sf, "events").select(F.col("ts").alias("DATE"), F.col("event_type").alias("Entity"), F.col("value").alias("reading"), "props")
    return rd.to_panel(ev).select("series_id", pn.stamp(), "y")


@query("s07_unnamed_time_column", f"SELECT 'series_0' AS series_id, {TS}, value AS y FROM events")
def s07_unnamed_time_column(spark, sf):
    t = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("unnamed_0"), F.col("value").alias("target"))
    return rd.to_panel(rd.promote_unnamed_time(t)).select("series_id", pn.stamp(), "y")


IND = (
    "SELECT CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'C' || n_nationkey END AS code, n_name AS name, year(o_orderdate) AS y, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE round(sum(o_totalprice), 2) END AS v"
    " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, n_nationkey"
)


@query(
    "s08_indicator_unpivot",
    f"WITH i AS ({IND}), s AS (SELECT coalesce(nullif(code, ''), name) AS series, y, v FROM i), a AS (SELECT series FROM s GROUP BY 1 HAVING count(v) > 0)"
    " SELECT r.y || '-01-01' AS timestamp, a.series, s.v AS target FROM a JOIN (SELECT DISTINCT y FROM s) AS r(y) ON true LEFT JOIN s ON s.series = a.series AND s.y = r.y",
)
def s08_indicator_unpivot(spark, sf):
    """Nation totals per year as an indicator matrix."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    flat = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("n_nationkey")
    wide = flat.groupBy(
        F.col("n_name").alias("Country Name"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("Country Code"), F.lit("orders").alias("Indicator Name"), F.lit("O").alias("Indicator Code"), k.alias("k")
    ).pivot("y").agg(F.first("v"))  # one column for each year there is
    years = [c for c in wide.columns if c.isdigit()]
    wide = wide.select(*rd.INDICATOR_IDS, *[F.when(F.col("k") % 7 != 0, F.col(y)).cast("string").alias(y) for y in years])
    long = rd.unpivot_indicators(wide)
    return long.select("timestamp", "series", "target")


@query("s09_wide_to_panel", "SELECT 'l_quantity' AS series_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts, l_quantity AS y FROM lineitem UNION ALL SELECT 'l_discount', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), l_discount FROM lineitem")
def s09_wide_to_panel(spark, sf):
    return rd.wide_to_panel(table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_discount"), "l_shipdate").select("series_id", pn.stamp(), "y")


@query("s10_long_target_to_panel", f"SELECT 'series_0' AS series_id, {TS}, value AS y FROM events WHERE event_type = 'view' UNION ALL SELECT event_type, {TS}, value FROM events WHERE event_type <> 'view'")
def s10_long_target_to_panel(spark, sf):
    ev = table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("target"))
    return rd.to_panel(ev).select("series_id", pn.stamp(), "y")


@query(
    "s11_json_payloads",
    "SELECT CASE WHEN event_id % 3 = 0 THEN 'series_' || event_id ELSE event_type END AS series_id, CASE WHEN i = 0 AND event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE CAST(i AS VARCHAR) END AS timestamp, i AS pos, value + i AS y FROM events, range(0, 2) AS r(i)"
    " WHERE NOT (i = 1 AND event_id % 2 = 0)",
)
def s11_json_payloads(spark, sf):
    ev = table(spark, sf, "events")
    odd = F.col("event_id") % 2 == 1
    target = F.when(odd, F.array("value", F.col("value") + 1)).otherwise(F.array("value"))
    stamps = F.when(~odd, F.array(F.date_format("ts", "yyyy-MM-dd")))
    ident = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    msg = ev.select(F.to_json(F.struct(ident.alias("id"), stamps.alias("timestamps"), target.alias("target"))).alias("payload"), F.col("event_id").alias("ordinal"))
    return rd.payloads_to_panel(msg)


@query("s12_store_scan", "SELECT o_orderpriority AS series_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, o_totalprice AS y FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def s12_store_scan(spark, sf):
    """The predicates of the database scan, pushed into the table scan (no database is at hand)."""
    o = rd.select_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "1-URGENT", "1996-01-01", "1996-12-31")
    return o.select("series_id", pn.stamp(), "y")


@query("s13_list_series", "SELECT DISTINCT event_type AS series_id FROM events")
def s13_list_series(spark, sf):
    return rd.list_series(pn.events_daily(spark, sf))


@query("s14_series_chunks", OD + " SELECT series_id, pos // 1000 AS chunk, count(*) AS rows, round(sum(y), 2) AS total FROM panel GROUP BY 1, 2")
def s14_series_chunks(spark, sf):
    c = rd.chunks(pn.orders_daily(spark, sf), 1000)
    return c.select("series_id", "chunk", F.size("y").cast("long").alias("rows"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("s15_object_store_scan", "SELECT CASE WHEN event_type = 'view' THEN 'default' ELSE event_type END AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS y FROM events")
def s15_object_store_scan(spark, sf):
    """All objects below a prefix are read."""
    path = scratch_path(spark, "objects")
    ev = table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("series_id"), F.col("ts").alias("timestamp"), "value")
    ev.repartition(4).write.parquet(path)
    return rd.read_objects(spark, path).select("series_id", pn.stamp(), "y")


MSG = (
    "SELECT CASE WHEN event_id % 4 = 0 THEN 'default' ELSE event_type END AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS y FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0"
)


def messages(spark, sf):
    """Events as JSON messages; some are arrays, some carry text values, some lack an id."""
    ev = table(spark, sf, "events")
    k = F.col("event_id")
    value = F.when(k % 11 == 0, "oops").otherwise(F.col("value").cast("string"))
    obj = F.to_json(F.struct(F.when(k % 4 != 0, F.col("event_type")).alias("series_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), value.alias("value")))
    return ev.select(F.when(k % 7 == 0, F.lit("[1, 2]")).otherwise(obj).alias("value"))


@query("s16_topic_messages", MSG)
def s16_topic_messages(spark, sf):
    return rd.parse_messages(messages(spark, sf)).select("series_id", pn.stamp(), "y")


@query(
    "s17_train_test_matrix",
    ED + " SELECT series_id, pos - (n - 7 - 14) AS pos, strftime(DATE '2000-01-01' + CAST(pos - (n - 7 - 14) AS INTEGER), '%Y-%m-%d %H:%M:%S') AS ts, y FROM panel WHERE pos >= n - 21 AND pos < n - 7 AND series_id <> 'error'",
)
def s17_train_test_matrix(spark, sf):
    """Daily means pivoted to one row per series with columns V<pos>; one series is missing from the test part."""
    p = pn.events_daily(spark, sf)
    wide = lambda d: d.groupBy("series_id").pivot("pos").agg(F.first("y"))
    train, test = wide(p.where("pos < n - 7")), wide(p.where("pos >= n - 7 and series_id <> 'error'"))
    hist, _ = rd.train_test_panel(train, test, "series_id", horizon=7, context=14)
    return hist.select("series_id", "pos", pn.stamp(), "y")


@query("j07_train_test_ids", ED + " SELECT DISTINCT series_id FROM panel WHERE series_id NOT IN ('error', 'view')")
def j07_train_test_ids(spark, sf):
    ids = pn.events_daily(spark, sf).select("series_id").distinct()
    return ids.where("series_id <> 'error'").join(ids.where("series_id <> 'view'"), "series_id", "left_semi")


@query("s18_csv_directory", OD + " SELECT lower(replace(series_id, ' ', '')) AS series_id, pos - (n - 200) AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, y FROM panel WHERE pos >= n - 200")
def s18_csv_directory(spark, sf):
    """One folder per series; the last 200 rows of each are kept."""
    path = scratch_path(spark, "folders")
    p = pn.orders_daily(spark, sf).select(F.replace("series_id", F.lit(" "), F.lit("")).alias("f"), F.date_format("ts", "yyyy-MM-dd").alias("Datetime"), F.col("y").cast("string").alias("MW"))
    p.repartition("f").write.partitionBy("f").csv(path, header=True)
    d = rd.read_csv_directory(spark, path, keep=200, id_from="folder")
    return d.select("series_id", (F.col("pos") - (F.col("n") - 200)).alias("pos"), pn.stamp(), "y")


@query(
    "s19_explode_array_targets",
    "SELECT event_type AS series_id, strftime(ts + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 2 = 0 THEN [value, value + 2][i + 1] ELSE [value + 1][i + 1] END AS y FROM events, range(0, 2) AS r(i) WHERE i = 0 OR event_id % 2 = 0",
)
def s19_explode_array_targets(spark, sf):
    """Odd events have an invalid first element, so the next one takes its place."""
    odd = F.col("event_id") % 2 == 1
    arr = F.when(odd, F.array(F.lit(None).cast("double"), F.col("value") + 1)).otherwise(F.array("value", F.col("value") + 2))
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", arr.alias("target"))
    return rd.explode_targets(ev, "h").select("series_id", pn.stamp(), "y")


@query("s20_composite_key", "SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || '|' || user_id END AS key, count(*) AS rows FROM events GROUP BY 1")
def s20_composite_key(spark, sf):
    k = parse.composite_key([F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.col("user_id")])
    return table(spark, sf, "events").groupBy(F.coalesce(k, F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s21_series_column_ranking",
    "SELECT * FROM (SELECT 'user_id' AS \"column\", count(*) AS \"values\", max(c) AS max_rows FROM (SELECT user_id, count(*) AS c FROM events GROUP BY 1) UNION ALL SELECT 'store', count(*), max(c) FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)) WHERE max_rows >= 20",
)
def s21_series_column_ranking(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("store"), "value")
    return rd.series_column_ranking(ev, 20, exclude=["event_id"])


@query(
    "s22_column_role_inference",
    "SELECT * FROM (VALUES ('when', 1.0::DOUBLE, 0.0::DOUBLE, 'timestamp'), ('kind', 0.0::DOUBLE, 0.0::DOUBLE, ''), ('value', 0.0::DOUBLE, 1.0::DOUBLE, 'target')) AS v(\"column\", time_ratio, number_ratio, role) WHERE (SELECT count(*) FROM events) > 0",
)
def s22_column_role_inference(spark, sf):
    ev = table(spark, sf, "events").select(F.date_format("ts", "yyyy/MM/dd HH:mm").alias("when"), F.col("event_type").alias("kind"), F.concat("value", F.lit("")).alias("value"))
    return rd.infer_roles(ev.withColumn("value", F.concat(F.lit("1"), F.lit(","), F.lpad(F.regexp_replace("value", r"\D", ""), 3, "0"), F.lit(".5"))))


ASSESS = (
    "WITH r AS (SELECT event_id, event_id % 50 <> 0 AS t, event_id % 70 <> 3 AS v FROM events), g AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, row_number() OVER (PARTITION BY t AND v ORDER BY event_id) AS k FROM r),"
    " runs AS (SELECT max(c) AS longest FROM (SELECT count(*) AS c FROM g WHERE t AND v GROUP BY rn - k))"
    " SELECT round(avg(CASE WHEN t THEN 1.0 ELSE 0.0 END), 6) AS time_ratio, round(avg(CASE WHEN v THEN 1.0 ELSE 0.0 END), 6) AS number_ratio, (SELECT longest FROM runs) AS longest_run, '' AS problem FROM r"
)


@query("s23_schema_assessment", ASSESS)
def s23_schema_assessment(spark, sf):
    k = F.col("event_id")
    ev = table(spark, sf, "events").select("event_id", F.when(k % 50 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("t"), F.when(k % 70 != 3, F.col("value").cast("string")).otherwise("n/a").alias("v"))
    a = rd.assess_schema(ev, "t", "v", ["event_id"])
    return a.select(F.round("time_ratio", 6).alias("time_ratio"), F.round("number_ratio", 6).alias("number_ratio"), "longest_run", F.coalesce("problem", F.lit("")).alias("problem"))


@query(
    "s24_forecast_flatten",
    HOLD + SCALE_SQL + ", l AS (SELECT series_id, max(ts) AS t FROM hist GROUP BY 1) SELECT series_id, 'D' AS freq, CAST(step AS INTEGER) AS step, strftime(t + to_days(CAST(step AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, round(p, 6) AS mean,"
    f" round(p - {Z10} * s * sqrt(step), 6) AS q0_1, round(p + {Z10} * s * sqrt(step), 6) AS q0_9 FROM lastv JOIN scale USING (series_id) JOIN l USING (series_id), range(1, 8) AS r(step)",
)
def s24_forecast_flatten(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    f = fc.forecast(history, "last_value", 7, quantiles=[0.1, 0.9]).join(cx.future_timestamps(history, 7, "D"), ["series_id", "step"])
    flat = sinks.flatten_forecast(f.withColumn("freq", F.lit("D")), [0.1, 0.9])
    return flat.select("series_id", "freq", "step", pn.stamp(), F.round("mean", 6).alias("mean"), F.round("`q0.1`", 6).alias("q0_1"), F.round("`q0.9`", 6).alias("q0_9"))


@query("s28_append_actuals", ED + f" SELECT series_id, pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, y FROM panel")
def s28_append_actuals(spark, sf):
    history, actuals = folds.holdout(pn.events_daily(spark, sf), 7)
    return rd.append_actuals(history, actuals, "D").select("series_id", "pos", pn.stamp(), "y")


# ---- sorting, limits, sampling ---------------------------------------------------------------


@query("t01_chronological_order", "SELECT 'u' || user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS ord FROM events")
def t01_chronological_order(spark, sf):
    return pn.events_raw(spark, sf).select("series_id", "pos", "ord")


@query("t06_seeded_series_sample", "WITH d AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42:u' || user_id), user_id LIMIT 20) SELECT 'u' || user_id AS series_id, count(*) AS rows FROM events WHERE user_id IN (SELECT user_id FROM d) GROUP BY 1")
def t06_seeded_series_sample(spark, sf):
    ev = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"))
    return rd.sample_series(ev, 20, 42).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))


@query("t08_source_limit", "SELECT event_type AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value AS y FROM events ORDER BY event_type, events.ts LIMIT 100")
def t08_source_limit(spark, sf):
    return rd.select_series(table(spark, sf, "events"), "event_type", "ts", "value", limit=100).select("series_id", pn.stamp(), "y")


# ---- text and time functions -----------------------------------------------------------------


@query("c02_sanitize_ids", "SELECT coalesce(nullif(substr(trim(regexp_replace(lower(trim(s_name || ' /' || n_name || '#')), '[^0-9a-z]', '_', 'g'), '_'), 1, 48), ''), 'series') AS id, count(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def c02_sanitize_ids(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(parse.sanitize(F.concat("s_name", F.lit(" /"), "n_name", F.lit("#"))).alias("id")).agg(F.count(F.lit(1)).alias("rows"))


@query("c03_parse_numbers", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN round(1000 + value, 2) WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE value END AS value FROM events")
def c03_parse_numbers(spark, sf):
    k, v = F.col("event_id") % 5, F.col("value")
    text = (
        F.when(k == 0, F.concat(F.lit(" "), v.cast("string"), F.lit(" ")))
        .when(k == 1, F.concat(F.lit("1,"), F.lpad(F.format_string("%.2f", v), 6, "0")))
        .when(k == 2, "N/A").when(k == 3, " None ").otherwise(v.cast("string"))
    )
    ev = table(spark, sf, "events").where("value < 1000 or event_id % 5 <> 1")
    low = ev.select("event_id", parse.number(text).alias("value"))
    high = table(spark, sf, "events").where("value >= 1000 and event_id % 5 = 1").select("event_id", F.round(F.col("value") + 1000, 2).alias("value"))
    return low.unionByName(high)


@query(
    "c10_parse_timestamps",
    "SELECT event_id, strftime(CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('day', ts)"
    " WHEN 5 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS ts FROM events",
)
def c10_parse_timestamps(spark, sf):
    k = F.col("event_id") % 8
    f = lambda p: F.date_format("ts", p)
    text = (
        F.when(k == 0, F.unix_seconds("ts").cast("string")).when(k == 1, F.unix_millis("ts").cast("string")).when(k == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")))
        .when(k == 3, f("yyyy/MM/dd HH:mm")).when(k == 4, f("yyyy-MM-dd")).when(k == 5, f("dd/MM/yyyy")).when(k == 6, f("yyyy-MM-dd HH:mm:ss")).otherwise("not a time")
    )
    p = table(spark, sf, "events").select("event_id", parse.timestamp(text).alias("ts"))
    return p.select("event_id", pn.stamp())


_ALIASES = ("15min", "h", "2H", "D", "W", "MS", "QS", "Y", "30s", "auto")
_COMPAT = (900, 3600, 7200, 86400, 604800, 2592000, 7862400, 31536000, 30, None)
_TOKENS = ("MIN", "H", "H", "D", "W", "M", "Q", "Y", "S", "AUTO")


@query("c11_alias_to_step", "SELECT alias, token, seconds, count(*) AS rows FROM events JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{t}', {'NULL' if s is None else s}::DOUBLE)" for i, (a, t, s) in enumerate(zip(_ALIASES, _TOKENS, _COMPAT))) + ") AS v(i, alias, token, seconds) ON event_id % 10 = i GROUP BY 1, 2, 3")
def c11_alias_to_step(spark, sf):
    a = F.element_at(F.array(*[F.lit(x) for x in _ALIASES]), (F.col("event_id") % 10 + 1).cast("int"))
    ev = table(spark, sf, "events").select(a.alias("alias"))
    return ev.groupBy("alias", fq.token_column(F.col("alias")).alias("token"), fq.compat_seconds(F.col("alias")).cast("double").alias("seconds")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c12_seconds_to_alias",
    "WITH s AS (SELECT CAST((event_id % 40) * CASE event_id % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END AS BIGINT) AS s FROM events)"
    " SELECT s AS seconds, CASE WHEN s <= 0 THEN '' WHEN s % 86400 = 0 THEN CASE WHEN s = 86400 THEN '' ELSE (s // 86400) || '' END || 'D' WHEN s % 3600 = 0 THEN CASE WHEN s = 3600 THEN '' ELSE (s // 3600) || '' END || 'h'"
    " WHEN s % 60 = 0 THEN CASE WHEN s = 60 THEN '' ELSE (s // 60) || '' END || 'min' ELSE CASE WHEN s = 1 THEN '' ELSE s || '' END || 's' END AS alias, count(*) AS rows FROM s GROUP BY 1, 2",
)
def c12_seconds_to_alias(spark, sf):
    k = F.col("event_id")
    s = (k % 40) * F.when(k % 4 == 0, 86400).when(k % 4 == 1, 3600).when(k % 4 == 2, 60).otherwise(1)
    ev = table(spark, sf, "events").select(s.cast("long").alias("seconds"))
    return ev.groupBy("seconds", F.coalesce(fq.alias_of_seconds(F.col("seconds")), F.lit("")).alias("alias")).agg(F.count(F.lit(1)).alias("rows"))


@query("c13_future_timestamps", f"WITH {pn.SHIP_MONTHLY}, l AS (SELECT series_id, max(ts) AS t FROM ship_monthly GROUP BY 1) SELECT series_id, CAST(step AS INTEGER) AS step, strftime(t + to_months(CAST(step AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts FROM l, range(1, 13) AS r(step)")
def c13_future_timestamps(spark, sf):
    return cx.future_timestamps(pn.ship_monthly(spark, sf), 12, "MS").select("series_id", "step", pn.stamp())


@query("c15_index_grid", OD + " SELECT series_id, pos, strftime(min(ts) OVER (PARTITION BY series_id) + to_days(CAST(pos AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts FROM panel")
def c15_index_grid(spark, sf):
    return cx.index_grid(pn.orders_daily(spark, sf), "D").select("series_id", "pos", pn.stamp())


@query("c22_clamp_and_invert", "SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS unit, round(greatest(0, least(1, 1 - value / 60)), 6) AS inverted FROM events")
def c22_clamp_and_invert(spark, sf):
    from tidepanel.functions.numeric import clip, invert_ratio

    return table(spark, sf, "events").select("event_id", F.round(clip(F.col("value") / 100), 6).alias("unit"), F.round(invert_ratio("value", 60.0), 6).alias("inverted"))


# ---- model-side context ----------------------------------------------------------------------


@query("p13_truncate_context", OD + " SELECT series_id, pos - greatest(n - 512, 0) AS pos, least(n, 512) AS n, y FROM panel WHERE pos >= n - 512")
def p13_truncate_context(spark, sf):
    from tidepanel.operators.windows import truncate_context

    return truncate_context(pn.orders_daily(spark, sf), 512).select("series_id", "pos", "n", "y")


@query(
    "p14_left_padding",
    ED + " SELECT series_id, pos + greatest(40 - n, 0) AS pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, y, false AS padded FROM panel UNION ALL SELECT series_id, 40 - n - k, strftime(ts - to_days(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S'), y, true FROM panel, range(1, 41) AS r(k) WHERE pos = 0 AND k <= 40 - n",
)
def p14_left_padding(spark, sf):
    return cx.left_pad(pn.events_daily(spark, sf), 40, "D").select("series_id", "pos", pn.stamp(), "y", "padded")


@query("p15_limit_series", "WITH i AS (SELECT DISTINCT user_id, 'u' || user_id AS s FROM events ORDER BY s LIMIT 40) SELECT 'u' || user_id AS series_id, count(*) AS rows FROM events WHERE 'u' || user_id IN (SELECT s FROM i) GROUP BY 1 UNION ALL SELECT 'input series limited to first 40 of ' || count(DISTINCT user_id), 0 FROM events")
def p15_limit_series(spark, sf):
    kept, warning = cx.limit_series(pn.events_raw(spark, sf), 40)
    rows = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    return rows.unionByName(warning.select(F.col("warning").alias("series_id"), F.lit(0).cast("long").alias("rows")))


@query(
    "p11_repair_non_finite",
    HOLD + " SELECT series_id, CAST(step AS INTEGER) AS step, round(CASE WHEN step = 2 THEN p WHEN step = 3 THEN p ELSE p * 1.5 END, 6) AS mean, round(CASE WHEN step = 4 THEN p * 1.5 WHEN step = 2 THEN p ELSE p * 2 END, 6) AS q90 FROM lastv, range(1, 8) AS r(step)",
)
def p11_repair_non_finite(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    s, m = F.col("step"), F.col("mean")
    f = fc.last_value(history, 7)
    bad = f.select("series_id", "step", F.when(s == 2, float("nan")).when(s == 3, float("inf")).otherwise(m * 1.5).alias("mean"), F.create_map(F.lit("0.9"), F.when(s.isin(2, 4), float("nan")).otherwise(m * 2)).alias("quantiles"))
    fixed = cx.repair_non_finite(bad, history)
    return fixed.select("series_id", "step", F.round("mean", 6).alias("mean"), F.round(F.col("quantiles")["0.9"], 6).alias("q90"))
