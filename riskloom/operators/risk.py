"""Entity risk that decays, reports, alerts and the query functions of the API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import entity_type
from .graph import neighborhood

PROFILE = (
    "entity_id string, entity_type string, score double, baseline_score double, last_updated bigint, "
    "associated_chains array<string>, evidence_count bigint, first_seen bigint, tags array<string>"
)
#: Fixed texts by chain type.
ACTIONS = {
    "c2_beacon": "Block the destination and isolate the source host",
    "lateral_movement": "Reset the credentials used and review access of the pivot host",
    "data_exfil": "Block the outbound connection and assess what data left",
    "dga_activity": "Sinkhole the domains and scan the host for malware",
}
OTHER_ACTION = "Investigate the entities involved"


def decayed(score: Column, elapsed_ms: Column, half_life_hours: float = 24.0) -> Column:
    return score * F.pow(F.lit(0.5), F.greatest(elapsed_ms, F.lit(0)) / (half_life_hours * 3_600_000))


def trend(score: Column, baseline: Column) -> Column:
    """increasing above twice the baseline, decreasing below half of it; stable without a baseline."""
    ratio = score / F.nullif(baseline, F.lit(0.0))
    return F.when(ratio > 2, "increasing").when(ratio < 0.5, "decreasing").otherwise("stable")


def updated(profiles: DataFrame, anomalies: DataFrame, chains: DataFrame, now_ms: int, half_life_hours: float = 24.0) -> DataFrame:
    """profiles (PROFILE) after a batch of anomalies (entity_id, score) and chains, at now_ms.

    Old scores decay by time; anomalies above 0 add their score, each appearance in a chain half its risk.
    One union and one aggregate, so the state is read and shuffled once.
    """
    none = lambda kind: F.lit(None).cast(kind)
    old = profiles.select(
        "entity_id", "baseline_score", decayed(F.col("score"), F.lit(now_ms) - F.col("last_updated"), half_life_hours).alias("points"),
        "evidence_count", "first_seen", F.col("associated_chains").alias("chains"), "tags",
    )
    new = anomalies.filter("score > 0").select(
        "entity_id", none("double").alias("baseline_score"), F.col("score").alias("points"), F.lit(1).cast("bigint").alias("evidence_count"),
        F.lit(now_ms).cast("bigint").alias("first_seen"), F.array().cast("array<string>").alias("chains"), F.array().cast("array<string>").alias("tags"),
    )
    each = chains.select("chain_id", "total_risk_score", "mitre_techniques", F.explode("nodes").alias("n"))
    linked = each.select(
        F.col("n.entity").alias("entity_id"), none("double").alias("baseline_score"), (0.5 * F.col("total_risk_score")).alias("points"), F.lit(0).cast("bigint").alias("evidence_count"),
        F.lit(now_ms).cast("bigint").alias("first_seen"), F.array("chain_id").alias("chains"), F.col("mitre_techniques").alias("tags"),
    )
    out = old.unionByName(new).unionByName(linked).groupBy("entity_id").agg(
        F.sum("points").alias("score"),
        F.coalesce(F.max("baseline_score"), F.lit(0.0)).alias("baseline_score"),
        F.lit(now_ms).cast("bigint").alias("last_updated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("chains")))).alias("associated_chains"),
        F.sum("evidence_count").alias("evidence_count"),
        F.min("first_seen").alias("first_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    return out.select("entity_id", entity_type(F.col("entity_id")).alias("entity_type"), "score", "baseline_score", "last_updated", "associated_chains", "evidence_count", "first_seen", "tags")


def score_at(profiles: DataFrame, entity: str, now_ms: int, half_life_hours: float = 24.0) -> DataFrame:
    """One row: the entity's score at a time; 0 if it is unknown. Changes nothing."""
    s = decayed(F.col("score"), F.lit(now_ms) - F.col("last_updated"), half_life_hours)
    return profiles.filter(F.col("entity_id") == entity).agg(F.coalesce(F.max(s), F.lit(0.0)).alias("score")).select(F.lit(entity).alias("entity_id"), "score")


def top(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def alerts(scores: DataFrame, least: float = 0.9, critical: float = 0.95) -> DataFrame:
    """(id, score, tier) of scores (id, score) from `least` on."""
    return scores.filter(F.col("score") >= least).withColumn("tier", F.when(F.col("score") > critical, "critical").otherwise("investigation"))


def mitre_coverage(chains: DataFrame, n: int = 20) -> DataFrame:
    each = chains.select(F.explode("mitre_techniques").alias("technique")).groupBy("technique").agg(F.count("*").alias("chains"))
    return each.orderBy(F.desc("chains"), "technique").limit(n)


def action(kind: Column) -> Column:
    out = F.lit(OTHER_ACTION)
    for k, text in ACTIONS.items():
        out = F.when(kind == k, text).otherwise(out)
    return out


def recommendations(chains: DataFrame, profiles: DataFrame, n: int = 5) -> DataFrame:
    """(place, target, priority, text): the first chains by priority, then the riskiest entities without chains."""
    first = chains.orderBy("investigation_priority", F.desc("total_risk_score"), "chain_id").limit(n)
    a = first.select(F.lit(0).alias("part"), F.col("chain_id").alias("target"), F.col("investigation_priority").alias("priority"), action(F.col("chain_type")).alias("text"), F.col("total_risk_score").alias("risk"))
    lone = top(profiles.filter(F.size("associated_chains") == 0), n, "score", "entity_id")
    b = lone.select(F.lit(1).alias("part"), F.col("entity_id").alias("target"), F.lit(3).alias("priority"), F.lit(OTHER_ACTION).alias("text"), F.col("score").alias("risk"))
    order = Window.partitionBy().orderBy("part", "priority", F.desc("risk"), "target")
    return a.unionByName(b).select(F.row_number().over(order).alias("place"), "target", "priority", "text")


def daily_report(profiles: DataFrame, chains: DataFrame, n_events: DataFrame, date: str) -> DataFrame:
    """One row with all sections of the report."""

    def section(df, name, *columns):
        rows = F.array_sort(F.collect_list(F.struct(*columns)))
        return df.agg(rows.alias(name))

    ents = top(profiles, 20, "score", "entity_id")
    last = F.when(F.size("associated_chains") > 5, F.slice("associated_chains", -5, 5)).otherwise(F.col("associated_chains"))
    entities = section(ents.withColumn("last", last), "top_entities", (-F.col("score")).alias("order"), "entity_id", "entity_type", "score", "evidence_count", F.col("last").alias("associated_chains"))
    best = section(top(chains, 10, "total_risk_score", "chain_id"), "top_chains", (-F.col("total_risk_score")).alias("order"), "chain_id", "chain_type", "total_risk_score", "description")
    mitre = section(mitre_coverage(chains), "mitre", (-F.col("chains")).alias("order"), "technique", "chains")
    advice = section(recommendations(chains, profiles), "recommendations", "place", "target", "priority", "text")
    totals = profiles.agg(F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("total_evidence"), F.count("*").alias("entities"))
    count = chains.agg(F.count("*").alias("chains"))
    out = totals.join(count).join(n_events.agg(F.count("*").alias("events"))).join(entities).join(best).join(mitre).join(advice)
    return out.select(F.lit(date).alias("date"), "events", "entities", "chains", "total_evidence", "top_entities", "top_chains", "mitre", "recommendations")


def histogram(scores: DataFrame, bins: int = 30, column: str = "score") -> DataFrame:
    """(bin, n) over 0..1, the last bin with its upper end."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(column) * bins)).cast("int")
    return scores.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def drift(scores: DataFrame, high: float = 0.5, share: float = 0.30) -> DataFrame:
    """One row: entities, how many are above each of three marks, and whether those above `high` are too many."""
    n = lambda cut: F.count_if(F.col("score") > cut)
    return scores.agg(F.count("*").alias("entities"), n(0.5).alias("above_50"), n(0.7).alias("above_70"), n(0.9).alias("above_90"), (n(high) > share * F.count("*")).alias("drift"))


def chains_page(chains: DataFrame, least: float = 0.7, kind: str | None = None, n: int = 50) -> DataFrame:
    """The riskiest chains of a type; of equal ones the first by their entities."""
    out = chains.filter(F.col("total_risk_score") >= least)
    out = out.filter(F.col("chain_type") == kind) if kind else out
    return out.orderBy(F.desc("total_risk_score"), "affected_assets", "chain_id").limit(min(n, 200))


def chain_by_id(chains: DataFrame, ids: DataFrame) -> DataFrame:
    """The chains whose chain_id is in ids (chain_id)."""
    return chains.join(ids.select("chain_id"), "chain_id", "left_semi")


def profile(profiles: DataFrame, edges: DataFrame, entity: str, depth: int = 1) -> DataFrame:
    """The entity's row with neighbors: how many others links reach within depth; none if it is unknown."""
    start = profiles.sparkSession.range(1).select(F.lit(entity).alias("id"))
    n = neighborhood(edges, start, depth).filter("hops > 0").agg(F.count("*").alias("neighbors"))
    return profiles.filter(F.col("entity_id") == entity).join(F.broadcast(n))


def neighbors(edges: DataFrame, entity: str, depth: int = 1) -> DataFrame:
    """(entity_id, neighbor, hops): what links reach from an entity within depth."""
    start = edges.sparkSession.range(1).select(F.lit(entity).alias("id"))
    return neighborhood(edges, start, depth).filter("hops > 0").select(F.lit(entity).alias("entity_id"), F.col("id").alias("neighbor"), "hops")


def exported(logs: DataFrame, chains: DataFrame, scores: DataFrame, entities: DataFrame, metrics: DataFrame | None, n: int = 20) -> DataFrame:
    """The report as one row, to be written as JSON: eight figures of the run and the `n` riskiest chains.

    scores (id, score): of addresses; metrics: evaluation.metrics(), or None without known attacks (its figures are null then).
    """
    own = ["chain_id", "chain_type", "total_risk_score", "confidence", "affected_assets", "mitre_techniques", "investigation_priority", "description"]
    best = top(chains, n, "total_risk_score", "chain_id")
    order = F.array_sort(F.collect_list(F.struct((-F.col("total_risk_score")).alias("order"), *own)))
    listed = best.agg(F.transform(order, lambda c: F.struct(*[c[x].alias(x) for x in own])).alias("chains"))
    high = scores.agg(F.count_if(F.col("score") > 0.7).alias("high_risk"), F.count_if(F.col("score") > 0.9).alias("critical_risk"))
    out = logs.agg(F.count("*").alias("events")).join(chains.agg(F.count("*").alias("chains_found"))).join(high)
    out = out.join(entities.agg(F.count("*").alias("entities"))).join(listed)
    if metrics is None:
        return out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1")])
    return out.join(metrics.select("precision", "recall", "f1"))


def entities_page(profiles: DataFrame, kind: str | None = None, least: float = 0.0, n: int = 50) -> DataFrame:
    """The riskiest entities of a type, each with total: how many there are."""
    found = profiles.filter(F.col("score") >= least)
    found = found.filter(F.col("entity_type") == kind) if kind else found
    return top(found.join(F.broadcast(found.agg(F.count("*").alias("total")))), min(n, 200), "score", "entity_id")


def counters(logs: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: events and chains."""
    return logs.agg(F.count("*").alias("events")).join(chains.agg(F.count("*").alias("chains")))


def chains_of(profiles: DataFrame, chains: DataFrame) -> DataFrame:
    """(entity_id, and the columns of chains): an entity's chains; without a row where it has none."""
    each = profiles.select("entity_id", F.explode("associated_chains").alias("chain_id"))
    return each.join(chains, "chain_id")


def severity_counts(chains: DataFrame, critical: float = 0.9, high: float = 0.7) -> DataFrame:
    """One row: chains, critical (by risk), high (below critical), and how many types there are."""
    r = F.col("total_risk_score")
    return chains.agg(
        F.count("*").alias("chains"), F.count_if(r >= critical).alias("critical"), F.count_if((r >= high) & (r < critical)).alias("high"), F.count_distinct("chain_type").alias("types")
    )


def search(profiles: DataFrame, text: str, least: float = 0.0) -> DataFrame:
    return profiles.filter(F.contains(F.lower("entity_id"), F.lower(F.lit(text))) & (F.col("score") >= least))


def sorted_chains(chains: DataFrame, kinds: list[str] | None, least: float, by: str = "risk") -> DataFrame:
    """Chains of some types from a risk on, by risk, confidence or events."""
    events = F.aggregate("edges", F.lit(0).cast("bigint"), lambda a, e: a + e["event_count"])
    out = chains.withColumn("events", events).filter(F.col("total_risk_score") >= least)
    out = out.filter(F.col("chain_type").isin(*kinds)) if kinds else out
    return out.orderBy(F.desc({"risk": "total_risk_score", "confidence": "confidence", "events": "events"}[by]), "chain_id")


def narrative(chains: DataFrame) -> DataFrame:
    """(chain_id, story, action): one sentence along the nodes' roles."""
    say = {"source": " started", "pivot": " was used to move on", "target": " was reached"}
    step = lambda n: F.concat(n["entity"], F.when(n["role"] == "source", say["source"]).when(n["role"] == "pivot", say["pivot"]).otherwise(say["target"]))
    return chains.select("chain_id", F.concat(F.array_join(F.transform("nodes", step), ", then "), F.lit(".")).alias("story"), action(F.col("chain_type")).alias("action"))


def timeline(events: DataFrame, entity: str, n: int = 100) -> DataFrame:
    """The latest entries (entity_id, ts_ms, event_type, description) of an entity."""
    return events.filter(F.col("entity_id") == entity).orderBy(F.desc("ts_ms"), "event_type", "description").limit(n)


def timeline_entries(logs: DataFrame) -> DataFrame:
    """(entity_id, ts_ms, event_type, description) for the source of every record."""
    told = F.concat_ws(" ", "event_type", F.lit("to"), F.coalesce("dst_ip", F.lit("unknown")))
    return logs.filter("src_ip is not null").select(F.col("src_ip").alias("entity_id"), "ts_ms", "event_type", told.alias("description"))
