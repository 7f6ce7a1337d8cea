"""Trust scoring on projections of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import trust as tr
from tidepanel.plans.catalog import query
from tidepanel.session import table

# Payload per domain: table, key column, and input columns with (multiplier, modulus, divisor) hashed from the key.
PAYLOADS = {
    "financial_market": ("customer", "c_custkey", {"liquidity_depth": (3, 101, 100), "spread_bps": (7, 131, 1), "volatility_regime": (11, 101, 80), "slippage_risk": (13, 101, 100), "freshness_score": (17, 101, 100)}),
    "news": ("documents", "doc_id", {"source_credibility": (3, 101, 100), "source_agreement": (7, 101, 100), "contradiction_score": (11, 101, 100), "propagation_delay_seconds": (613, 100003, 1), "freshness_score": (17, 101, 100)}),
    "supply_chain": ("supplier", "s_suppkey", {"lead_time_reliability": (3, 101, 100), "inventory_visibility": (7, 101, 100), "disruption_risk": (11, 101, 100), "sensor_quality": (13, 101, 100), "data_latency_seconds": (617, 4001, 1)}),
    "geopolitical": ("customer", "c_custkey", {"political_stability": (3, 101, 100), "sanctions_exposure": (7, 101, 100), "conflict_proximity": (11, 101, 100), "regulatory_alignment": (13, 101, 100), "freshness_score": (17, 101, 100)}),
    "regulatory": ("part", "p_partkey", {"compliance_score": (3, 101, 100), "enforcement_risk": (7, 101, 100), "reporting_quality": (11, 101, 100), "audit_recency": (13, 101, 100), "data_freshness": (17, 101, 100)}),
}


def payload(spark, sf, domain):
    """Every ninth row lacks its first input, so the default applies."""
    t, key, cols = PAYLOADS[domain]
    k = F.col(key)
    out, first = [k.cast("string").alias("item_id")], True
    for name, (m, mod, div) in cols.items():
        v = (k * m % mod) / F.lit(float(div))
        out.append((F.when(k % 9 != 0, v) if first else v).alias(name))
        first = False
    return table(spark, sf, t).select(*out)


def _scores_sql(domain: str) -> str:
    """Rows with components as columns c0.. and violations as text."""
    d = tr.DOMAINS[domain]
    t, key, cols = PAYLOADS[domain]
    alias = {a: f.name for f in d.fields for a in (f.name, *f.aliases)}
    given = {}
    for i, (name, (m, mod, div)) in enumerate(cols.items()):
        v = f"({key} * {m} % {mod}) / {float(div)}::DOUBLE"
        given[alias.get(name, name)] = f"CASE WHEN {key} % 9 <> 0 THEN {v} END" if i == 0 else v
    sel = []
    for f in d.fields:
        src = given.get(f.name)
        if f.name == "data_freshness" and "data_latency_seconds" in given:
            e = f"greatest(0.0, least(1.0, 1 - ({given['data_latency_seconds']}) / 3600.0))"
        elif src is None:
            e = f"{f.default}::DOUBLE"
        else:
            e = f"coalesce({src}, {f.default}::DOUBLE)"
            if f.unit:
                e = f"greatest(0.0, least(1.0, {e}))"
        sel.append(f"{e} AS {f.name}")
    comp = {
        "direct": "{f}", "complement": "1 - {f}", "invert": "greatest(0.0, least(1.0, 1 - {f} / {c}::DOUBLE))",
    }
    cs = ", ".join(f"{comp[c.kind].format(f=c.field, c=c.ceiling)} AS s_{c.name}" for c in d.components)
    total = sum(c.weight for c in d.components)
    score = "(" + " + ".join(f"s_{c.name} * {c.weight}" for c in d.components) + f") / {total}"
    viol = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {r.field} {r.op} {r.critical} THEN '{r.critical_name}' WHEN {r.field} {r.op} {r.warning} THEN '{r.warning_name}' END" for r in d.rules
    ) + ")"
    crit = " OR ".join(f"{r.field} {r.op} {r.critical}" for r in d.rules)
    return (
        f"{domain}_p AS (SELECT CAST({key} AS VARCHAR) AS item_id, {', '.join(sel)} FROM {t}),"
        f" {domain}_c AS (SELECT *, {cs}, {viol} AS violations, ({crit}) AS crit FROM {domain}_p),"
        f" {domain}_s AS (SELECT *, {score} AS trust_score FROM {domain}_c),"
        f" {domain}_r AS (SELECT item_id, '{domain}' AS agent, '{domain}' AS domain, trust_score, violations, crit, CASE WHEN crit OR trust_score < 0.5 THEN 'RED' WHEN violations <> '' THEN 'YELLOW'"
        f" WHEN trust_score >= 0.75 THEN 'GREEN' ELSE 'YELLOW' END AS risk_category, CASE WHEN crit THEN 'blocked' WHEN trust_score >= 0.75 AND violations = '' THEN 'high_trust' WHEN trust_score >= 0.5 THEN 'moderate_trust' ELSE 'low_trust' END AS status FROM {domain}_s)"
    )


def _names(col="violations"):
    return F.array_join(F.transform(col, lambda v: v["name"]), ",")


def _domain_query(key, domain):
    first = tr.DOMAINS[domain].components[1].name

    @query(key, "WITH " + _scores_sql(domain) + f" SELECT r.item_id, round(r.trust_score, 6) AS trust_score, r.risk_category, r.status, r.violations, round(s.s_{first}, 6) AS second_component FROM {domain}_r r JOIN {domain}_s s USING (item_id)")
    def run(spark, sf):
        r = tr.score(payload(spark, sf, domain), domain)
        return r.select("item_id", F.round("trust_score", 6).alias("trust_score"), "risk_category", "status", _names().alias("violations"), F.round(F.col("components")[first]["score"], 6).alias("second_component"))

    return run


_domain_query("x02_financial_trust", "financial_market")
_domain_query("x03_news_trust", "news")
_domain_query("x04_supply_chain_trust", "supply_chain")
_domain_query("x05_geopolitical_trust", "geopolitical")
_domain_query("x06_regulatory_trust", "regulatory")

FIN = "WITH " + _scores_sql("financial_market")
GEO = "WITH " + _scores_sql("geopolitical")


@query("x01_normalize_payload", FIN + " SELECT item_id, round(liquidity_depth, 6) AS liquidity_depth, bid_ask_spread_bps, round(realized_volatility, 6) AS realized_volatility, round(execution_risk, 6) AS execution_risk, round(data_freshness, 6) AS data_freshness FROM financial_market_p")
def x01_normalize_payload(spark, sf):
    n = tr.normalize(payload(spark, sf, "financial_market"), tr.FINANCIAL)
    r = lambda c: F.round(c, 6).alias(c)
    return n.select("item_id", r("liquidity_depth"), "bid_ask_spread_bps", r("realized_volatility"), r("execution_risk"), r("data_freshness"))


ADJ = {"political_stability": 1.5, "sanctions_exposure": 0.5}


@query(
    "x07_calibrated_score",
    GEO + " SELECT item_id, round((s_political_stability * 0.45 + s_sanctions_exposure * 0.125 + s_conflict_proximity * 0.2 + s_regulatory_alignment * 0.15 + s_data_freshness * 0.1) / 1.025, 6) AS trust_score FROM geopolitical_s",
)
def x07_calibrated_score(spark, sf):
    adj = spark.createDataFrame([("geopolitical", ADJ)], "agent string, factors map<string,double>")
    return tr.score(payload(spark, sf, "geopolitical"), "geopolitical", adj).select("item_id", F.round("trust_score", 6).alias("trust_score"))


MARKET_COLS = {"brier_score": (3, 101, 150), "log_loss": (7, 101, 60), "ece": (11, 101, 700), "volume": (613, 20011, 1), "recency": (13, 101, 100), "resolution_clarity": (17, 101, 100)}


def market_payload(spark, sf):
    k = F.col("event_id")
    cols = [((k * m % mod) / F.lit(float(div))).alias(n) for n, (m, mod, div) in MARKET_COLS.items()]
    return table(spark, sf, "events").select(k.cast("string").alias("item_id"), (k * 19 % 101 / 100).alias("trust_score"), *cols)


MARKET = (
    "WITH p AS (SELECT CAST(event_id AS VARCHAR) AS item_id, (event_id * 19 % 101) / 100 AS trust_score, " + ", ".join(f"(event_id * {m} % {mod}) / {float(div)}::DOUBLE AS {n}" for n, (m, mod, div) in MARKET_COLS.items()) + " FROM events),"
    " l AS (" + " UNION ALL ".join(
        f"SELECT item_id, trust_score, '{n}' AS component, {w} AS weight, " + (f"greatest(0.0, 1 - {n} / {g * 3}::DOUBLE)" if d == "lower" else f"least(1.0, {n} / {g}::DOUBLE)") + " AS nz FROM p" for n, w, g, d in tr.MARKET
    ) + "), b AS (SELECT *, CASE WHEN nz >= 0.8 THEN 'excellent' WHEN nz >= 0.6 THEN 'good' WHEN nz >= 0.4 THEN 'fair' ELSE 'poor' END AS grade FROM l)"
)


@query("x08_market_breakdown", MARKET + " SELECT component, grade AS assessment, count(*) AS items, round(sum(nz * weight), 4) AS contribution FROM b GROUP BY 1, 2")
def x08_market_breakdown(spark, sf):
    b = tr.market_breakdown(market_payload(spark, sf))
    return b.groupBy("component", "assessment").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("contribution"), 4).alias("contribution"))


@query("x08_market_recommendations", MARKET + " SELECT component, count(*) AS items FROM (SELECT item_id, component FROM b WHERE grade = 'poor' UNION ALL SELECT item_id, 'overall' FROM p WHERE trust_score < 0.25) GROUP BY 1")
def x08_market_recommendations(spark, sf):
    return tr.market_recommendations(market_payload(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("items"))


@query("x08_market_results", MARKET + " SELECT item_id, round(trust_score, 6) AS trust_score, CASE WHEN trust_score >= 0.75 THEN 'GREEN' WHEN trust_score >= 0.5 THEN 'YELLOW' ELSE 'RED' END AS risk_category, CASE WHEN trust_score < 0.5 THEN 'low_market_trust' ELSE '' END AS violations FROM p")
def x08_market_results(spark, sf):
    return tr.score_market(market_payload(spark, sf)).select("item_id", F.round("trust_score", 6).alias("trust_score"), "risk_category", _names().alias("violations"))


@query(
    "x09_route_to_agent",
    "SELECT CAST(event_id AS VARCHAR) AS item_id, CASE event_type WHEN 'click' THEN 'financial_market' WHEN 'view' THEN 'news' WHEN 'error' THEN 'regulatory' ELSE 'geopolitical' END AS agent FROM events WHERE event_type <> 'signup'",
)
def x09_route_to_agent(spark, sf):
    """Domain, source type, or both pick the agent; requests nobody answers to fall away."""
    ev = table(spark, sf, "events")
    t = F.col("event_type")
    req = ev.select(
        F.col("event_id").cast("string").alias("item_id"),
        F.when(t == "view", "news").otherwise("other").alias("domain"),
        F.when(t == "click", "fx_market").when(t == "view", "fx_market").when(t == "error", "legal").when(t == "purchase", "sanctions").otherwise("weather").alias("source_type"),
    )
    return tr.route(req, tr.agent_table(spark)).select("item_id", "agent")


MULTI = "WITH " + _scores_sql("financial_market") + ", " + _scores_sql("geopolitical") + (
    ", u AS (SELECT *, 20 AS pr FROM financial_market_r UNION ALL SELECT *, 50 FROM geopolitical_r),"
    " o AS (SELECT *, CASE risk_category WHEN 'GREEN' THEN 0 WHEN 'YELLOW' THEN 1 ELSE 2 END AS ro FROM u)"
)


@query(
    "x10_multi_agent_aggregate",
    MULTI + " SELECT item_id, count(*) AS agents, round(sum(trust_score / pr) / sum(1.0::DOUBLE / pr), 6) AS trust_score, CASE max(ro) WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END AS risk_category, max(ro) <> min(ro) AS agents_disagree,"
    " CAST(sum(CASE WHEN violations = '' THEN 0 ELSE len(string_split(violations, ',')) END) AS INTEGER) AS violations FROM o GROUP BY 1",
)
def x10_multi_agent_aggregate(spark, sf):
    both = tr.score(payload(spark, sf, "financial_market"), "financial_market").unionByName(tr.score(payload(spark, sf, "geopolitical"), "geopolitical"))
    a = tr.aggregate_agents(both, tr.agent_table(spark))
    return a.select("item_id", "agents", F.round("trust_score", 6).alias("trust_score"), "risk_category", "agents_disagree", F.size("violations").alias("violations"))


_attr = " UNION ALL ".join(f"SELECT item_id, '{c.name}' AS component, s_{c.name} * {c.weight} AS contribution, trust_score FROM geopolitical_s" for c in tr.GEOPOLITICAL.components)


@query(
    "x11_component_attribution",
    GEO + f", a AS ({_attr}) SELECT item_id, component, round(contribution, 4) AS contribution, round(CASE WHEN trust_score > 0 THEN contribution / trust_score * 100 ELSE 0 END, 1) AS impact_pct FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(contribution, 9) DESC, component) = 1",
)
def x11_component_attribution(spark, sf):
    a = tr.attribution(tr.score(payload(spark, sf, "geopolitical"), "geopolitical")).where("rank = 1")
    return a.select("item_id", "component", F.round("contribution", 4).alias("contribution"), F.round("impact_pct", 1).alias("impact_pct"))


@query(
    "x12_trust_gates",
    GEO + ", g AS (SELECT *, NOT (trust_score < 0.5 OR crit OR risk_category = 'RED') AS allowed FROM geopolitical_r)"
    " SELECT item_id, allowed, 'trust_score' AS gate, CASE WHEN trust_score < 0.5 THEN 'BLOCK' ELSE 'PASS' END AS gate_status FROM g UNION ALL SELECT item_id, allowed, 'constraint_violations', CASE WHEN crit THEN 'BLOCK' ELSE 'PASS' END FROM g"
    " UNION ALL SELECT item_id, allowed, 'risk_category', CASE risk_category WHEN 'RED' THEN 'BLOCK' WHEN 'YELLOW' THEN 'WARN' ELSE 'PASS' END FROM g",
)
def x12_trust_gates(spark, sf):
    return tr.gates(tr.score(payload(spark, sf, "geopolitical"), "geopolitical")).drop("agent")


@query(
    "x13_decision_policy",
    GEO + ", d AS (SELECT r.*, (CAST(item_id AS BIGINT) * 23 % 101) / 100 AS confidence, c_acctbal AS fv FROM geopolitical_r r JOIN customer ON CAST(c_custkey AS VARCHAR) = item_id),"
    " b AS (SELECT *, trust_score < 0.5 OR crit OR risk_category = 'RED' AS blocked, abs(fv) > 8000 AS over, confidence = 0.9 AS odd FROM d)"
    " SELECT item_id, confidence >= 0.85 AND NOT blocked AND NOT over AND NOT odd AS auto_executed, blocked AS trust_blocked, confidence < 0.85 OR blocked OR over OR odd AS escalated,"
    " concat_ws('; ', CASE WHEN confidence >= 0.85 THEN 'PASS: confidence' ELSE 'FAIL: confidence' END, CASE WHEN trust_score < 0.5 THEN 'BLOCK: trust_score' ELSE 'PASS: trust_score' END, CASE WHEN crit THEN 'BLOCK: critical violations' END,"
    " CASE risk_category WHEN 'RED' THEN 'BLOCK: risk_category RED' WHEN 'YELLOW' THEN 'WARN: risk_category YELLOW' END, CASE WHEN over THEN 'ESCALATE: forecast value' END, CASE WHEN odd THEN 'RULE [review]' END) AS rules FROM b",
)
def x13_decision_policy(spark, sf):
    r = tr.score(payload(spark, sf, "geopolitical"), "geopolitical")
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), (F.col("c_custkey") * 23 % 101 / 100).alias("confidence"), F.col("c_acctbal").alias("forecast_value"))
    d = tr.decide(r.join(c, "item_id"), approval_above=8000.0, rules=[tr.PolicyRule("review", "confidence", "eq", 0.9, blocks=True)])
    return d.select("item_id", "auto_executed", "trust_blocked", "escalated", F.array_join("rules_applied", "; ").alias("rules"))


# Outcomes: every event is one scored prediction of its type's agent.
OUT = (
    "WITH o AS (SELECT event_type AS agent, event_id, ts, (event_id * 37 % 101) / 100 AS predicted, CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS actual, least(value / 100, 1.0) AS sa, (event_id * 41 % 101) / 100 AS sb FROM events),"
    " l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY agent ORDER BY ts DESC, event_id DESC) <= 100)"
)


def outcomes(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    comp = F.create_map(F.lit("size"), F.least(v / 100, F.lit(1.0)), F.lit("luck"), k * 41 % 101 / 100)
    return table(spark, sf, "events").select(
        F.col("event_type").alias("agent"), "event_id", "ts", (k * 37 % 101 / 100).alias("predicted"), F.when(v > 40, 1.0).otherwise(0.0).alias("actual"), comp.alias("components")
    )


NEWEST = lambda: [F.col("ts").desc(), F.col("event_id").desc()]


@query(
    "x14_calibration_stats",
    OUT + ", b AS (SELECT agent, least(floor(predicted * 10), 9) AS b, count(*) AS k, avg(predicted) AS p, avg(actual) AS a, sum(predicted - actual) AS d FROM l GROUP BY 1, 2)"
    " SELECT agent, CAST(sum(k) AS BIGINT) AS records, round(sum(d) / sum(k), 6) AS bias, round(sum(k * abs(p - a)) / sum(k), 6) AS ece FROM b GROUP BY 1",
)
def x14_calibration_stats(spark, sf):
    s = tr.calibration_stats(outcomes(spark, sf), NEWEST())
    return s.select("agent", "records", F.round("bias", 6).alias("bias"), F.round("ece", 6).alias("ece"))


@query(
    "x14_weight_adjustments",
    OUT + " SELECT agent, 'size' AS component, round(greatest(0.5, least(1.5, 1 + corr(sa, actual - predicted))), 6) AS factor FROM l GROUP BY 1 UNION ALL SELECT agent, 'luck', round(greatest(0.5, least(1.5, 1 + corr(sb, actual - predicted))), 6) FROM l GROUP BY 1",
)
def x14_weight_adjustments(spark, sf):
    return tr.weight_adjustments(outcomes(spark, sf), NEWEST()).withColumn("factor", F.round("factor", 6))


HIST = (
    "WITH h AS (SELECT event_type AS domain, event_id, ts, least(value / 100, 1.0) AS s FROM events),"
    " l AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS rn FROM h QUALIFY rn <= 500), t AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM l),"
    " x AS (SELECT domain, max(n) AS records, avg(s) AS mean_score, min(s) AS min_score, max(s) AS max_score, max(s) FILTER (WHERE rn = 1) AS latest_score, avg(s) FILTER (WHERE rn <= 3) - avg(s) FILTER (WHERE (n >= 6 AND rn BETWEEN 4 AND 6) OR (n < 6 AND rn > n - 3)) AS d FROM t GROUP BY 1),"
    " hs AS (SELECT *, CASE WHEN records < 3 THEN 'stable' WHEN d > 0.05 THEN 'improving' WHEN d < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM x)"
)


def history(spark, sf):
    s = F.least(F.col("value") / 100, F.lit(1.0))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("domain"), "event_id", "ts", s.alias("trust_score"), F.when(s >= 0.75, "GREEN").when(s >= 0.5, "YELLOW").otherwise("RED").alias("risk_category")
    )


@query("x15_history_stats", HIST + " SELECT domain, records, round(mean_score, 6) AS mean_score, min_score, max_score, latest_score, CASE WHEN latest_score >= 0.75 THEN 'GREEN' WHEN latest_score >= 0.5 THEN 'YELLOW' ELSE 'RED' END AS latest_risk, trend FROM hs")
def x15_history_stats(spark, sf):
    return tr.history_stats(history(spark, sf), NEWEST()).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "w22_recent_trend",
    "WITH h AS (SELECT user_id, least(value / 100, 1.0) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events),"
    " x AS (SELECT user_id, least(max(c), 500) AS n, avg(s) FILTER (WHERE rn <= 3) - avg(s) FILTER (WHERE (least(c, 500) >= 6 AND rn BETWEEN 4 AND 6) OR (c < 6 AND rn > c - 3)) AS d FROM h GROUP BY 1)"
    " SELECT user_id, CASE WHEN n < 3 THEN 'stable' WHEN d > 0.05 THEN 'improving' WHEN d < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM x",
)
def w22_recent_trend(spark, sf):
    s = F.least(F.col("value") / 100, F.lit(1.0))
    h = table(spark, sf, "events").select("user_id", "event_id", "ts", s.alias("trust_score"), F.lit("GREEN").alias("risk_category"))
    return tr.history_stats(h, NEWEST(), ["user_id"]).select("user_id", "trend")


ALERT = (
    "WITH " + HIST[5:] + ", " + _scores_sql("geopolitical") + ", al AS (SELECT item_id, concat_ws('; ', CASE WHEN trust_score < 0.45 THEN printf('trust_score %.2f < threshold 0.45', trust_score) END, CASE WHEN risk_category = 'RED' THEN 'risk_category RED' END,"
    " CASE WHEN (SELECT trend FROM hs WHERE domain = 'click') IN ('declining', 'stable', 'improving') THEN 'trend ' || (SELECT trend FROM hs WHERE domain = 'click') END) AS reasons FROM geopolitical_r)"
)


def _alerts(spark, sf):
    r = tr.score(payload(spark, sf, "geopolitical"), "geopolitical")
    th = spark.createDataFrame([("geopolitical", 0.45, ["RED"], ["declining", "stable", "improving"])], "domain string, min_trust_score double, risk_categories array<string>, alert_on_trend array<string>")
    trends = tr.history_stats(history(spark, sf), NEWEST()).where("domain = 'click'").select(F.lit("geopolitical").alias("domain"), "trend")
    return tr.alerts(r, th, trends)


@query("x16_alerts", ALERT + " SELECT item_id, reasons FROM al WHERE reasons <> ''")
def x16_alerts(spark, sf):
    return _alerts(spark, sf).select("item_id", F.array_join("reasons", "; ").alias("reasons"))


@query("j09_alert_threshold_join", ALERT + " SELECT len(string_split(reasons, '; ')) AS reasons, count(*) AS items FROM al WHERE reasons <> '' GROUP BY 1")
def j09_alert_threshold_join(spark, sf):
    return _alerts(spark, sf).groupBy(F.size("reasons").cast("long").alias("reasons")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "j10_news_reference_join",
    "WITH " + _scores_sql("financial_market") + ", " + _scores_sql("news") + ", j AS (SELECT f.item_id, f.trust_score, f.crit, n.trust_score AS ns, n.crit AS nc FROM financial_market_r f LEFT JOIN news_r n ON CAST(n.item_id AS BIGINT) * 3 = CAST(f.item_id AS BIGINT))"
    " SELECT item_id, round(CASE WHEN ns IS NULL THEN trust_score ELSE (trust_score + ns * 0.1) / 1.1 END, 6) AS trust_score, (crit OR coalesce(nc, false)) AS critical FROM j",
)
def j10_news_reference_join(spark, sf):
    """Every third market signal refers to a news story."""
    p = payload(spark, sf, "financial_market")
    k = F.col("item_id").cast("long")
    p = p.withColumn("news_signal_ref", F.when(k % 3 == 0, (k / 3).cast("long").cast("string")))
    r = tr.score(p, "financial_market", news=tr.score(payload(spark, sf, "news"), "news"))
    return r.select("item_id", F.round("trust_score", 6).alias("trust_score"), tr.has_critical().alias("critical"))


@query(
    "x17_degraded_results",
    "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'agent_failure:missing id' ELSE 'agent_failure:negative value' END AS violation, 'RED' AS risk_category, 'poorly_calibrated' AS status, count(*) AS items FROM customer WHERE c_custkey % 10 = 0 OR c_acctbal < 0 GROUP BY 1",
)
def x17_degraded_results(spark, sf):
    c = table(spark, sf, "customer")
    p = c.select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey").cast("string")).alias("symbol"), F.col("c_acctbal").alias("spread_bps"))
    bad = tr.score(p, "financial_market").where("status = 'poorly_calibrated'")
    return bad.groupBy(F.col("violations")[0]["name"].alias("violation"), "risk_category", "status").agg(F.count(F.lit(1)).alias("items"))


_bl = " UNION ALL ".join(f"SELECT item_id, '{c.name}' AS component, round(s_{c.name}, 6) AS score, {c.weight}::DOUBLE AS weight FROM geopolitical_s" for c in tr.GEOPOLITICAL.components)


@query("x18_breakdown_layout", GEO + f" SELECT * FROM ({_bl})")
def x18_breakdown_layout(spark, sf):
    b = tr.breakdown_layout(tr.score(payload(spark, sf, "geopolitical"), "geopolitical"))
    return b.select("item_id", "component", F.round("score", 6).alias("score"), "weight")


@query("x18_summary_layout", GEO + " SELECT item_id, agent, domain, round(trust_score, 6) AS trust_score, risk_category, status, violations AS violation_names, NOT crit AS constraint_satisfied FROM geopolitical_r")
def x18_summary_layout(spark, sf):
    r = tr.score(payload(spark, sf, "geopolitical"), "geopolitical")
    f = tr.flat_layout(r).select("item_id", "constraint_satisfied")
    s = tr.summary_layout(r).join(f, "item_id")
    return s.select("item_id", "agent", "domain", F.round("trust_score", 6).alias("trust_score"), "risk_category", "status", F.array_join("violation_names", ",").alias("violation_names"), "constraint_satisfied")


@query("e05_custom_domain", "SELECT CAST(s_suppkey AS VARCHAR) AS item_id, round(0.6 * greatest(0, least(1, s_acctbal / 10000)) + 0.4 * (1 - (s_suppkey % 11) / 10), 6) AS trust_score FROM supplier")
def e05_custom_domain(spark, sf):
    """A user domain is one more table: solvency and complaint rate of suppliers."""
    vendor = tr.Domain(
        "vendor", ("vendor_id",), (tr.Field("solvency"), tr.Field("complaints")),
        (tr.Component("solvency", "solvency", 0.6), tr.Component("complaints", "complaints", 0.4, "complement")),
        (tr.Rule("solvency", "<=", 0.05, "insolvent", 0.1, "weak", "solvency"),),
    )
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vendor_id"), (F.col("s_acctbal") / 10000).alias("solvency"), (F.col("s_suppkey") % 11 / 10).alias("complaints"))
    return tr.score(s, vendor).select("item_id", F.round("trust_score", 6).alias("trust_score"))
