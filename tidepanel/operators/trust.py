"""Table-driven trust scoring: payload columns -> components, violations, score, risk, gates and policies.

A domain is a table of fields, weighted components and threshold rules; users add a domain by adding a
table. Everything is per-row column work: no shuffle until results are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import clip, finite, ratio

RESULT_COLUMNS = ("item_id", "agent", "domain", "trust_score", "risk_category", "status", "components", "violations")
COMPONENTS = "map<string,struct<score:double,weight:double>>"
VIOLATION = "struct<name:string,severity:string,type:string>"


@dataclass(frozen=True)
class Field:
    """An input: aliases in order of preference, default, and whether it is a unit-interval score."""

    name: str
    aliases: tuple[str, ...] = ()
    default: float = 0.5
    unit: bool = True


@dataclass(frozen=True)
class Component:
    """score = field, 1 - field (`complement`) or 1 - field / ceiling (`invert`)."""

    name: str
    field: str
    weight: float
    kind: str = "direct"
    ceiling: float = 1.0


@dataclass(frozen=True)
class Rule:
    """A critical and a warning threshold on one field; critical wins."""

    field: str
    op: str
    critical: float
    critical_name: str
    warning: float
    warning_name: str
    type: str


@dataclass(frozen=True)
class Domain:
    name: str
    id_aliases: tuple[str, ...]
    fields: tuple[Field, ...]
    components: tuple[Component, ...]
    rules: tuple[Rule, ...]
    priority: int = 100
    source_types: tuple[str, ...] = field(default=())


FRESH = ("freshness_score",)
# Fields, weights, thresholds, priorities and source types of the built-in domains (fixed values).
FINANCIAL = Domain(
    "financial_market",
    ("instrument_id", "symbol"),
    (
        Field("liquidity_depth"),
        Field("bid_ask_spread_bps", ("spread_bps",), 50.0, False),
        Field("realized_volatility", ("volatility_regime",), 0.3, False),
        Field("execution_risk", ("slippage_risk",)),
        Field("data_freshness", FRESH),
    ),
    (
        Component("liquidity_depth", "liquidity_depth", 0.25),
        Component("spread_slippage", "bid_ask_spread_bps", 0.25, "invert", 100.0),
        Component("regime_stability", "realized_volatility", 0.25, "invert", 1.0),
        Component("execution_risk", "execution_risk", 0.15, "complement"),
        Component("data_freshness", "data_freshness", 0.10),
    ),
    (
        Rule("bid_ask_spread_bps", ">=", 100.0, "spread_slippage_extreme", 25.0, "spread_slippage_elevated", "liquidity"),
        Rule("execution_risk", ">=", 0.8, "execution_risk_high", 0.6, "execution_risk_elevated", "execution"),
        Rule("data_freshness", "<=", 0.10, "market_data_stale", 0.25, "market_data_aging", "freshness"),
    ),
    20,
    ("financial_market", "equity_market", "fx_market", "rates_market", "commodity_market"),
)
NEWS = Domain(
    "news",
    ("story_id", "headline"),
    (
        Field("source_credibility"),
        Field("corroboration", ("source_agreement",)),
        Field("contradiction_score"),
        Field("propagation_delay_seconds", (), 300.0, False),
        Field("freshness_score"),
    ),
    (
        Component("source_credibility", "source_credibility", 0.35),
        Component("corroboration", "corroboration", 0.25),
        Component("contradiction_penalty", "contradiction_score", 0.20, "complement"),
        Component("propagation_delay", "propagation_delay_seconds", 0.10, "invert", 3600.0),
        Component("freshness", "freshness_score", 0.10),
    ),
    (
        Rule("source_credibility", "<", 0.2, "source_credibility_low", 0.4, "source_credibility_weak", "credibility"),
        Rule("contradiction_score", ">", 0.8, "contradiction_high", 0.6, "contradiction_elevated", "consistency"),
        Rule("propagation_delay_seconds", ">", 86400.0, "propagation_delay_excessive", 21600.0, "propagation_delay_elevated", "timeliness"),
    ),
    40,
    ("news", "intel", "media"),
)
SUPPLY = Domain(
    "supply_chain",
    ("network_id", "shipment_id"),
    (
        Field("lead_time_reliability"),
        Field("inventory_visibility"),
        Field("disruption_risk"),
        Field("sensor_quality"),
        Field("data_freshness", ("freshness_score", "data_latency")),
    ),
    (
        Component("lead_time_reliability", "lead_time_reliability", 0.30),
        Component("inventory_visibility", "inventory_visibility", 0.25),
        Component("disruption_risk", "disruption_risk", 0.20, "complement"),
        Component("sensor_quality", "sensor_quality", 0.15),
        Component("data_freshness", "data_freshness", 0.10),
    ),
    (
        Rule("disruption_risk", ">=", 0.8, "disruption_risk_extreme", 0.6, "disruption_risk_elevated", "disruption"),
        Rule("lead_time_reliability", "<=", 0.2, "lead_time_unreliable", 0.4, "lead_time_degraded", "reliability"),
        Rule("sensor_quality", "<=", 0.15, "sensor_quality_critical", 0.3, "sensor_quality_low", "data_quality"),
        Rule("data_freshness", "<=", 0.10, "supply_data_stale", 0.25, "supply_data_aging", "freshness"),
    ),
    30,
    ("supply_chain", "logistics"),
)
GEOPOLITICAL = Domain(
    "geopolitical",
    ("region_id", "country_code", "geo_zone"),
    (
        Field("political_stability"),
        Field("sanctions_exposure"),
        Field("conflict_proximity"),
        Field("regulatory_alignment"),
        Field("data_freshness", FRESH),
    ),
    (
        Component("political_stability", "political_stability", 0.30),
        Component("sanctions_exposure", "sanctions_exposure", 0.25, "complement"),
        Component("conflict_proximity", "conflict_proximity", 0.20, "complement"),
        Component("regulatory_alignment", "regulatory_alignment", 0.15),
        Component("data_freshness", "data_freshness", 0.10),
    ),
    (
        Rule("sanctions_exposure", ">=", 0.8, "sanctions_exposure_extreme", 0.6, "sanctions_exposure_elevated", "sanctions"),
        Rule("conflict_proximity", ">=", 0.8, "conflict_proximity_extreme", 0.6, "conflict_proximity_elevated", "conflict"),
        Rule("political_stability", "<=", 0.2, "political_stability_critical", 0.4, "political_stability_low", "stability"),
        Rule("data_freshness", "<=", 0.10, "geo_data_stale", 0.25, "geo_data_aging", "freshness"),
    ),
    50,
    ("geopolitical", "country_risk", "sanctions"),
)
REGULATORY = Domain(
    "regulatory",
    ("jurisdiction_id", "regulation_id", "compliance_scope"),
    (
        Field("compliance_score"),
        Field("enforcement_risk"),
        Field("reporting_quality"),
        Field("audit_recency"),
        Field("data_freshness", FRESH),
    ),
    (
        Component("compliance_score", "compliance_score", 0.30),
        Component("enforcement_risk", "enforcement_risk", 0.25, "complement"),
        Component("reporting_quality", "reporting_quality", 0.20),
        Component("audit_recency", "audit_recency", 0.15),
        Component("data_freshness", "data_freshness", 0.10),
    ),
    (
        Rule("compliance_score", "<=", 0.2, "compliance_critical", 0.4, "compliance_low", "compliance"),
        Rule("enforcement_risk", ">=", 0.8, "enforcement_risk_extreme", 0.6, "enforcement_risk_elevated", "enforcement"),
        Rule("reporting_quality", "<=", 0.2, "reporting_quality_critical", 0.4, "reporting_quality_low", "reporting"),
        Rule("audit_recency", "<=", 0.1, "audit_recency_stale", 0.25, "audit_recency_aging", "audit"),
    ),
    60,
    ("regulatory", "compliance", "legal"),
)
DOMAINS: dict[str, Domain] = {d.name: d for d in (FINANCIAL, NEWS, SUPPLY, GEOPOLITICAL, REGULATORY)}

# Components of prediction-market trust: weight, good value, direction (fixed values).
MARKET = (
    ("brier_score", 0.30, 0.2, "lower"),
    ("log_loss", 0.20, 0.5, "lower"),
    ("ece", 0.25, 0.05, "lower"),
    ("volume", 0.10, 10000.0, "higher"),
    ("recency", 0.10, 0.8, "higher"),
    ("resolution_clarity", 0.05, 0.9, "higher"),
)
MARKET_PRIORITY = 10
MARKET_AGENT = "market_calibration"


# ---- scoring ---------------------------------------------------------------------------------


def normalize(payload: DataFrame, domain: Domain) -> DataFrame:
    """item_id, the domain's fields under their canonical names, and `problem` for unusable payloads.

    Extra columns stay. A latency in seconds, where present, sets the freshness.
    """
    have = set(payload.columns)

    def first(names: Sequence[str]) -> Column | None:
        cols = [F.col(n) for n in names if n in have]
        return F.coalesce(*cols) if cols else None

    ident = first(("item_id", *domain.id_aliases))
    ident = F.trim(ident.cast("string")) if ident is not None else F.lit(None).cast("string")
    values, bad = {}, F.lit(False)
    for f in domain.fields:
        raw = first((f.name, *f.aliases))
        x = finite(raw) if raw is not None else F.lit(None).cast("double")
        if f.unit:
            values[f.name] = clip(F.coalesce(x, F.lit(f.default)))
        else:
            values[f.name] = F.coalesce(x, F.lit(f.default))
            bad = bad | (F.coalesce(x, F.lit(0.0)) < 0)
    if domain.name == "supply_chain" and "data_latency_seconds" in have:
        late = clip(1 - F.col("data_latency_seconds") / 3600.0)
        values["data_freshness"] = F.coalesce(late, values["data_freshness"])
        bad = bad | (F.coalesce(F.col("data_latency_seconds"), F.lit(0.0)) < 0)
    known = {n for f in domain.fields for n in (f.name, *f.aliases)} | {"item_id", *domain.id_aliases, "data_latency_seconds"}
    rest = [F.col(c) for c in payload.columns if c not in known]
    problem = F.when(ident.isNull() | (ident == ""), "missing id").when(bad, "negative value")
    return payload.select(ident.alias("item_id"), *[c.alias(n) for n, c in values.items()], *rest, problem.alias("problem"))


def _score(c: Component) -> Column:
    x = F.col(c.field)
    return {"direct": x, "complement": 1 - x, "invert": clip(1 - x / c.ceiling)}[c.kind]


def component_map(domain: Domain, adjustments: Column | None = None) -> Column:
    """Map component -> (score, weight); `adjustments` is a map of weight multipliers."""
    pairs = []
    for c in domain.components:
        w = F.lit(c.weight)
        if adjustments is not None:
            w = w * F.coalesce(adjustments[c.name], F.lit(1.0))
        pairs += [F.lit(c.name), F.struct(_score(c).alias("score"), w.cast("double").alias("weight"))]
    return F.create_map(*pairs).cast(COMPONENTS)


def violation_array(domain: Domain) -> Column:
    def test(x: Column, op: str, v: float) -> Column:
        return {">=": x >= v, ">": x > v, "<=": x <= v, "<": x < v}[op]

    def entry(name: str, severity: str, kind: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"))

    cols = [
        F.when(test(F.col(r.field), r.op, r.critical), entry(r.critical_name, "critical", r.type)).when(
            test(F.col(r.field), r.op, r.warning), entry(r.warning_name, "warning", r.type)
        )
        for r in domain.rules
    ]
    return F.array_compact(F.array(*cols)).cast(f"array<{VIOLATION}>")


def weighted_score(components: Column) -> Column:
    entries = F.map_values(components)
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e.weight)
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + e.score * e.weight) / F.when(total == 0, 1.0).otherwise(total)


def has_critical(violations: str = "violations") -> Column:
    return F.exists(violations, lambda v: v.severity == "critical")


def risk_category() -> Column:
    s = F.col("trust_score")
    return (
        F.when(has_critical() | (s < 0.5), "RED").when(F.size("violations") > 0, "YELLOW").when(s >= 0.75, "GREEN").otherwise("YELLOW")
    )


def calibration_status() -> Column:
    s = F.col("trust_score")
    return (
        F.when(has_critical(), "blocked").when((s >= 0.75) & (F.size("violations") == 0), "high_trust").when(s >= 0.5, "moderate_trust").otherwise("low_trust")
    )


def _finish(df: DataFrame, agent: str, domain: str) -> DataFrame:
    out = df.withColumn("trust_score", weighted_score(F.col("components")))
    out = out.withColumns({"agent": F.lit(agent), "domain": F.lit(domain), "risk_category": risk_category(), "status": calibration_status()})
    return out


def degraded(item_id: Column, agent: str, domain: str, reason: Column) -> list[Column]:
    """Result columns of a payload that could not be scored: score 0, RED, one critical violation."""
    v = F.array(F.struct(F.concat(F.lit("agent_failure:"), reason).alias("name"), F.lit("critical").alias("severity"), F.lit("failure").alias("type")))
    return [
        item_id.alias("item_id"), F.lit(agent).alias("agent"), F.lit(domain).alias("domain"), F.lit(0.0).alias("trust_score"), F.lit("RED").alias("risk_category"),
        F.lit("poorly_calibrated").alias("status"), F.create_map().cast(COMPONENTS).alias("components"), v.cast(f"array<{VIOLATION}>").alias("violations"),
    ]


def score(payload: DataFrame, domain: Domain | str, adjustments: DataFrame | None = None, news: DataFrame | None = None) -> DataFrame:
    """Trust results of a payload table. Unusable payloads become degraded results.

    `adjustments` is (agent, factors map); `news` holds news results that `news_signal_ref` points to.
    """
    d = DOMAINS[domain] if isinstance(domain, str) else domain
    base = normalize(payload, d)
    ok = base.where(F.col("problem").isNull())
    factors = None
    if adjustments is not None:
        mine = adjustments.where(F.col("agent") == d.name).agg(F.lit(d.name).alias("agent"), F.first("factors").alias("_adj"))
        ok = ok.withColumn("agent", F.lit(d.name)).join(F.broadcast(mine), "agent")  # a global aggregate is one row
        factors = F.coalesce("_adj", F.create_map().cast("map<string,double>"))
    ok = ok.withColumns({"components": component_map(d, factors), "violations": violation_array(d)})
    if news is not None and "news_signal_ref" in ok.columns:
        ok = _with_news(ok, news)
    good = _finish(ok, d.name, d.name).select(*RESULT_COLUMNS)
    bad = base.where(F.col("problem").isNotNull()).select(*degraded(F.col("item_id"), d.name, d.name, F.col("problem")))
    return good.unionByName(bad)


def _with_news(ok: DataFrame, news: DataFrame) -> DataFrame:
    """Add the referenced news signal as a 0.10 component and its critical violations."""
    ref = news.select(F.col("item_id").alias("news_signal_ref"), F.col("trust_score").alias("_ns"), F.col("violations").alias("_nv"))
    j = ok.join(ref, "news_signal_ref", "left")
    extra = F.create_map(F.lit("news_signal"), F.struct(F.col("_ns").alias("score"), F.lit(0.10).alias("weight"))).cast(COMPONENTS)
    crit = F.transform(
        F.filter("_nv", lambda v: v.severity == "critical"),
        lambda v: F.struct(
            F.concat(F.lit("news_"), v["name"]).alias("name"), v.severity.alias("severity"), F.concat(F.lit("news_"), F.coalesce(v["type"], F.lit("unknown"))).alias("type")
        ),
    )
    found = F.col("_ns").isNotNull()
    return j.withColumns(
        {
            "components": F.when(found, F.map_concat("components", extra)).otherwise(F.col("components")),
            "violations": F.when(found, F.concat("violations", crit)).otherwise(F.col("violations")),
        }
    ).drop("_ns", "_nv")


def market_breakdown(payload: DataFrame) -> DataFrame:
    """Long breakdown (item_id, component, value, weight, normalized, contribution, assessment)."""
    parts = []
    for name, weight, good, direction in MARKET:
        v = finite(name) if name in payload.columns else F.lit(None).cast("double")
        norm = F.greatest(F.lit(0.0), 1 - v / (good * 3)) if direction == "lower" else F.least(F.lit(1.0), v / good)
        norm = F.when(v.isNotNull(), norm)
        parts.append(F.struct(F.lit(name).alias("component"), v.alias("value"), F.lit(weight).alias("weight"), norm.alias("normalized")))
    long = payload.select("item_id", "trust_score", F.explode(F.array(*parts)).alias("p")).select("item_id", "trust_score", "p.*")
    n = F.col("normalized")
    grade = F.when(n.isNull(), "not_available").when(n >= 0.8, "excellent").when(n >= 0.6, "good").when(n >= 0.4, "fair").otherwise("poor")
    return long.withColumns({"contribution": F.coalesce(n * F.col("weight"), F.lit(0.0)), "assessment": grade})


def market_recommendations(payload: DataFrame) -> DataFrame:
    """(item_id, component): poor components, and `overall` for scores below 0.25."""
    poor = market_breakdown(payload).where("assessment = 'poor'").select("item_id", "component")
    low = payload.where(F.col("trust_score") < 0.25).select("item_id", F.lit("overall").alias("component"))
    return poor.unionByName(low)


def score_market(payload: DataFrame) -> DataFrame:
    """Prediction-market results; the score is given, the components explain it."""
    b = market_breakdown(payload).groupBy("item_id", "trust_score").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("component", F.struct(F.coalesce("normalized", F.lit(0.0)).alias("score"), "weight"))))
        ).cast(COMPONENTS).alias("components")
    )  # one entry per component
    s = F.col("trust_score")
    low = F.struct(F.lit("low_market_trust").alias("name"), F.lit("warning").alias("severity"), F.lit("calibration").alias("type"))
    return b.select(
        "item_id", F.lit(MARKET_AGENT).alias("agent"), F.lit("prediction_market").alias("domain"), "trust_score",
        F.when(s >= 0.75, "GREEN").when(s >= 0.5, "YELLOW").otherwise("RED").alias("risk_category"),
        F.when(s >= 0.75, "well_calibrated").when(s >= 0.5, "moderately_calibrated").otherwise("poorly_calibrated").alias("status"),
        "components", F.array_compact(F.array(F.when(s < 0.5, low))).cast(f"array<{VIOLATION}>").alias("violations"),
    )


# ---- routing, aggregation, projections -------------------------------------------------------


def agent_table(spark) -> DataFrame:
    """(agent, key, priority): domains and source types each agent answers to."""
    rows = [(MARKET_AGENT, "prediction_market", MARKET_PRIORITY)]
    for d in DOMAINS.values():
        rows += [(d.name, k, d.priority) for k in sorted({d.name, *d.source_types})]
    return spark.createDataFrame(rows, "agent string, key string, priority int")


def route(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """(item_id, ..., agent): the agent matching domain or source type, the domain's own first, then by priority."""
    keyed = requests.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("domain", "source_type")))))
    hit = keyed.join(agents, "key")
    best = F.min_by("agent", F.struct(F.when(F.col("agent") == F.col("domain"), 0).otherwise(1), "priority", "agent")).alias("agent")
    return hit.groupBy(*requests.columns).agg(best)


RISK = ("GREEN", "YELLOW", "RED")
STATUS = ("high_trust", "moderate_trust", "low_trust", "blocked")


def _ordinal(c: str, names: Sequence[str]) -> Column:
    out = None
    for i, n in enumerate(names):
        out = F.when(F.col(c) == n, i) if out is None else out.when(F.col(c) == n, i)
    return out.otherwise(1)


def aggregate_agents(results: DataFrame, priorities: DataFrame) -> DataFrame:
    """One row per item over its agents: worst risk and status, 1/priority-weighted score, distinct violations."""
    p = priorities.groupBy("agent").agg(F.min("priority").alias("priority"))
    r = results.join(p, "agent", "left")
    w = 1.0 / F.greatest(F.coalesce("priority", F.lit(100)), F.lit(1))
    names = lambda t: F.array(*[F.lit(x) for x in t])
    agg = r.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("agents"),
        ratio(F.sum(w * F.col("trust_score")), F.sum(w)).alias("trust_score"),
        F.max(_ordinal("risk_category", RISK)).alias("_r"),
        F.min(_ordinal("risk_category", RISK)).alias("_r0"),
        F.max(_ordinal("status", STATUS)).alias("_s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("violations")))).alias("violations"),
    )  # a handful of agents per item
    return agg.select(
        "item_id", "agents", "trust_score", F.get(names(RISK), F.col("_r")).alias("risk_category"), F.get(names(STATUS), F.col("_s")).alias("status"),
        "violations", (F.col("_r") != F.col("_r0")).alias("agents_disagree"),
    )


def attribution(results: DataFrame) -> DataFrame:
    """(item_id, agent, component, contribution, impact_pct, rank): weight share x score."""
    e = results.select("item_id", "agent", "trust_score", F.explode("components").alias("component", "c"), F.map_values("components").alias("_all"))
    total = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x.weight)
    contrib = F.col("c.weight") / F.when(total == 0, 1.0).otherwise(total) * F.col("c.score")
    pct = F.when(F.col("trust_score") > 0, contrib / F.col("trust_score") * 100).otherwise(0.0)
    w = Window.partitionBy("item_id", "agent").orderBy(F.abs("contribution").desc(), "component")
    return e.select("item_id", "agent", "component", contrib.alias("contribution"), pct.alias("impact_pct")).withColumn("rank", F.row_number().over(w))


def gates(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(item_id, allowed, gate, gate_status): trust score, constraint violations, risk category."""
    low, crit = F.col("trust_score") < threshold, has_critical()
    g = F.array(
        F.struct(F.lit("trust_score").alias("gate"), F.when(low, "BLOCK").otherwise("PASS").alias("gate_status")),
        F.struct(F.lit("constraint_violations").alias("gate"), F.when(crit, "BLOCK").otherwise("PASS").alias("gate_status")),
        F.struct(
            F.lit("risk_category").alias("gate"),
            F.when(F.col("risk_category") == "RED", "BLOCK").when(F.col("risk_category") == "YELLOW", "WARN").otherwise("PASS").alias("gate_status"),
        ),
    )
    allowed = ~(low | crit | (F.col("risk_category") == "RED"))
    return results.select("item_id", "agent", allowed.alias("allowed"), F.explode(g).alias("g")).select("item_id", "agent", "allowed", "g.*")


@dataclass(frozen=True)
class PolicyRule:
    """A custom escalation rule on a numeric column."""

    name: str
    field: str
    op: str  # lt, gt, eq, lte or gte
    value: float
    blocks: bool = False


def decide(
    decisions: DataFrame, execute_threshold: float = 0.85, trust_threshold: float = 0.5, approval_above: float | None = None, rules: Sequence[PolicyRule] = ()
) -> DataFrame:
    """Policy outcome per decision row (confidence, forecast_value and optionally trust columns).

    Adds auto_executed, trust_blocked, escalated and the applied rules in order.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    enough = conf >= execute_threshold
    applied = [F.when(enough, "PASS: confidence").otherwise("FAIL: confidence")]
    block = F.lit(False)
    if "trust_score" in decisions.columns:
        known = F.col("trust_score").isNotNull()
        low, crit = known & (F.col("trust_score") < trust_threshold), F.coalesce(has_critical(), F.lit(False))
        red = F.coalesce(F.col("risk_category") == "RED", F.lit(False))
        applied += [
            F.when(low, "BLOCK: trust_score").when(known, "PASS: trust_score"),
            F.when(crit, "BLOCK: critical violations"),
            F.when(red, "BLOCK: risk_category RED").when(F.col("risk_category") == "YELLOW", "WARN: risk_category YELLOW"),
        ]
        block = low | crit | red
    over = F.lit(False)
    if approval_above is not None:
        over = F.coalesce(F.abs("forecast_value") > approval_above, F.lit(False))
        applied.append(F.when(over, "ESCALATE: forecast value"))
    stop = F.lit(False)
    for r in rules:
        x = F.col(r.field)
        hit = {"lt": x < r.value, "gt": x > r.value, "eq": x == r.value, "lte": x <= r.value, "gte": x >= r.value}[r.op]
        hit = F.coalesce(hit, F.lit(False))
        applied.append(F.when(hit, f"RULE [{r.name}]"))
        if r.blocks:
            stop = stop | hit
    return decisions.withColumns(
        {
            "auto_executed": enough & ~block & ~over & ~stop,
            "trust_blocked": block,
            "escalated": ~enough | block | over | stop,
            "rules_applied": F.array_compact(F.array(*applied)),
        }
    )


# ---- calibration, history, alerts ------------------------------------------------------------

WINDOW, HISTORY, MIN_RECORDS, BINS = 100, 500, 5, 10


def recent(df: DataFrame, keys: Sequence[str], count: int, order: Sequence[Column]) -> DataFrame:
    """Newest `count` rows per key with `rn` (1 = newest); the rank limit is applied before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count)


def calibration_stats(outcomes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(agent, records, bias, ece) over the last 100 outcomes (agent, predicted, actual, components)."""
    last = recent(outcomes, ["agent"], WINDOW, order)
    bin_ = F.least(F.floor(F.col("predicted") * BINS), F.lit(BINS - 1))
    per_bin = last.groupBy("agent", bin_.alias("b")).agg(
        F.count(F.lit(1)).alias("k"), F.avg("predicted").alias("p"), F.avg("actual").alias("a"), F.sum(F.col("predicted") - F.col("actual")).alias("d")
    )
    return per_bin.groupBy("agent").agg(
        F.sum("k").alias("records"),
        (F.sum("d") / F.sum("k")).alias("bias"),
        (F.sum(F.col("k") * F.abs(F.col("p") - F.col("a"))) / F.sum("k")).alias("ece"),
    )


def weight_adjustments(outcomes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(agent, component, factor): 1 + correlation of the component score with actual - predicted, in [0.5, 1.5].

    Needs 5 records; a component missing from a record counts as 0.
    """
    last = recent(outcomes, ["agent"], WINDOW, order).withColumn("_res", F.col("actual") - F.col("predicted"))
    names = last.select("agent", F.explode(F.map_keys("components")).alias("component")).distinct()
    sized = last.groupBy("agent").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_RECORDS)
    pairs = last.join(names, "agent").join(sized, "agent").withColumn("_s", F.coalesce(F.try_element_at("components", F.col("component")), F.lit(0.0)))
    corr = F.coalesce(F.nanvl(F.corr("_s", "_res"), F.lit(0.0)), F.lit(0.0))
    return pairs.groupBy("agent", "component").agg(clip(1 + corr, 0.5, 1.5).alias("factor"))


def factor_maps(adjustments: DataFrame) -> DataFrame:
    """(agent, factors map) for `score`."""
    return adjustments.groupBy("agent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "factor")))).alias("factors"))


def trend_of(rn: str = "rn", total: str = "total", value: str = "trust_score") -> Column:
    """Mean of the last 3 minus the 3 before (the first 3 below 6 records): improving / declining / stable.

    An aggregate over rows with `rn` (1 = newest) and the kept count `total`.
    """
    r, n = F.col(rn), F.col(total)
    newest = F.avg(F.when(r <= 3, F.col(value)))
    older = F.avg(F.when(F.when(n >= 6, (r > 3) & (r <= 6)).otherwise(r > n - 3), F.col(value)))
    diff = newest - older
    return F.when(F.max(total) < 3, "stable").when(diff > 0.05, "improving").when(diff < -0.05, "declining").otherwise("stable")


def history_stats(history: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Count, mean / min / max / latest score, latest risk and trend over the last 500 records per key."""
    last = recent(history, keys, HISTORY, order)
    last = last.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return last.groupBy(*keys).agg(
        F.max("total").alias("records"),
        F.avg("trust_score").alias("mean_score"),
        F.min("trust_score").alias("min_score"),
        F.max("trust_score").alias("max_score"),
        F.max(F.when(F.col("rn") == 1, F.col("trust_score"))).alias("latest_score"),
        F.max(F.when(F.col("rn") == 1, F.col("risk_category"))).alias("latest_risk"),
        trend_of().alias("trend"),
    )


def alerts(results: DataFrame, thresholds: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """(item_id, domain, reasons): results that a threshold of their domain catches.

    `thresholds`: (domain, min_trust_score, risk_categories, alert_on_trend); `trends`: (domain, trend).
    """
    j = results.join(thresholds, "domain")
    trend = F.lit(None).cast("string")
    if trends is not None:
        j = j.join(trends.select("domain", "trend"), "domain", "left")
        trend = F.col("trend")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("trust_score") < F.col("min_trust_score"), F.format_string("trust_score %.2f < threshold %.2f", F.col("trust_score"), F.col("min_trust_score"))),
            F.when(F.array_contains("risk_categories", F.col("risk_category")), F.concat(F.lit("risk_category "), "risk_category")),
            F.when(F.array_contains("alert_on_trend", trend), F.concat(F.lit("trend "), trend)),
        )
    )
    return j.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("item_id", "domain", "trust_score", "risk_category", "reasons")


# ---- layouts ---------------------------------------------------------------------------------


def summary_layout(results: DataFrame) -> DataFrame:
    return results.select(
        "item_id", "agent", "domain", "trust_score", "risk_category", "status", F.transform("violations", lambda v: v["name"]).alias("violation_names")
    )


def breakdown_layout(results: DataFrame) -> DataFrame:
    """One row per component."""
    return results.select("item_id", "agent", F.explode("components").alias("component", "c")).select("item_id", "agent", "component", "c.score", "c.weight")


def flat_layout(results: DataFrame) -> DataFrame:
    """Scores and weights as maps, plus `constraint_satisfied`."""
    return results.select(
        "item_id", "agent", "domain", "trust_score", "status", "risk_category", (~has_critical()).alias("constraint_satisfied"),
        F.transform_values("components", lambda _, c: c.score).alias("scores"), F.transform_values("components", lambda _, c: c.weight).alias("weights"),
    )
