"""Named queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import net, text
from .lineage import saved, written
from .operators import autoencoder, chains, density, detectors, dga, evaluation, features, graph, intel, paths, risk
from .plans import pipeline
from .sources import dns, etw, syslog, waf
from .sources.netlog import netlog
from .streaming import state

QUERIES: dict = {}
VOLUME = list(features.FEATURES[:8])
NOW = "2024-07-01 00:00:00"


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order are equal; negative zero is zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def scored_nodes(logs: DataFrame) -> DataFrame:
    """Nodes whose risk is their share of the busiest node's events."""
    nodes = graph.build_nodes(logs)
    most = nodes.agg(F.max("total_events").alias("most"))
    score = nodes.join(F.broadcast(most)).select("id", F.round(F.col("total_events") / F.col("most"), 6).alias("score"))
    return graph.apply_scores(nodes, score)


def scored_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    logs = netlog(spark, d)
    return written(scored_nodes(logs)), written(chains.edge_frequency(graph.build_edges(logs)))


def flat_chains(df: DataFrame) -> DataFrame:
    who = F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["entity"], n["role"])), ",")
    links = F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["src"], e["edge_type"], e["dst"])), ",")
    return rounded(df.select("chain_type", who.alias("nodes"), links.alias("edges"), "total_risk_score", "first_seen", "last_seen", joined("affected_assets")))


@query
def netlog_records(spark, d):
    return netlog(spark, d).drop("timestamp")


@query
def top_risky_addresses(spark, d):
    return rounded(pipeline.flagship(netlog(spark, d)))


@query
def entity_features(spark, d):
    f = features.entity_features(netlog(spark, d))
    return rounded(f.withColumns({c: F.round(c, 2) for c in ("mean_iat", "std_iat")}), 5)


@query
def baseline_counts(spark, d):
    return features.baseline(netlog(spark, d))


@query
def baseline_novelty(spark, d):
    logs = netlog(spark, d)
    span = logs.agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    first = logs.join(F.broadcast(span)).filter("ts_ms < low + (high - low) / 10").drop("low", "high")  # a baseline comes before what it is held against
    return rounded(features.novelty(features.entities(logs), features.baseline(first), features.KEYS))


@query
def windowed_volume(spark, d):
    w = features.windowed_features(netlog(spark, d), "1 day", 86400.0)
    volume = ["event_count", "events_per_sec", "bytes_out_total", "bytes_in_total", "unique_dst_ips", "unique_dst_ports", "unique_domains", "waf_alert_density", "unique_waf_rules", "max_waf_severity"]
    return rounded(w.select("src_ip", "event_type", F.unix_millis("window_start").alias("start_ms"), *volume))


@query
def ecod_scores(spark, d):
    return rounded(detectors.ecod(features.entity_features(netlog(spark, d)), features.KEYS, VOLUME))


@query
def ensemble_ranks(spark, d):
    f = saved(features.entity_features(netlog(spark, d)))
    a = detectors.ecod(f, features.KEYS, VOLUME, digits=6)
    b = f.select(*features.KEYS, F.col("bytes_out_total").alias("score"))
    c = f.select(*features.KEYS, F.lit(0.0).alias("score"))
    return rounded(detectors.ensemble({"ecod": a, "isolation_forest": b, "graph_rare_path": c}, features.KEYS))


def volume_scores(spark, d):
    f = features.entity_features(netlog(spark, d))
    return detectors.min_max(f.select(*features.KEYS, "bytes_out_total"), "bytes_out_total").select(*features.KEYS, F.col("scaled").alias("score"))


@query
def gpd_thresholds(spark, d):
    return rounded(detectors.gpd_threshold(volume_scores(spark, d)))


@query
def sketched_thresholds(spark, d):
    """The thresholds from sketches of each event type's scores, merged: within a hundredth of the exact ones or not."""
    scores = volume_scores(spark, d)
    near = detectors.sketched_threshold(detectors.score_sketch(scores, by=["event_type"])).select(F.col("threshold").alias("sketched"))
    exact = detectors.gpd_threshold(scores).select(F.col("threshold").alias("exact"))
    n = scores.agg(F.count("*").alias("scores"))
    return near.join(exact).join(n).select("scores", (F.abs(F.col("sketched") - F.col("exact")) <= 0.01).alias("near"))


@query
def clipped_scores(spark, d):
    f = features.entity_features(netlog(spark, d))
    return rounded(detectors.clipped(f.select(*features.KEYS, "bytes_out_total"), "bytes_out_total", 0.01, 0.99).select(*features.KEYS, "scaled"))


@query
def explained_scores(spark, d):
    return rounded(detectors.explain(features.entity_features(netlog(spark, d)), features.KEYS, VOLUME, 3))


@query
def isolation_forest_scores(spark, d):
    return detectors.isolation_forest(features.entity_features(netlog(spark, d)), features.KEYS, list(features.FEATURES))


@query
def density_scores(spark, d):
    return rounded(detectors.density(features.entity_features(netlog(spark, d)), features.KEYS, VOLUME))


@query
def reconstruction_scores(spark, d):
    return detectors.reconstruction(features.entity_features(netlog(spark, d)), features.KEYS, list(features.FEATURES))


@query
def score_alerts(spark, d):
    scores = volume_scores(spark, d).select(F.concat_ws(":", "src_ip", "event_type").alias("id"), "score")
    return rounded(risk.alerts(scores, 0.5, 0.8))


@query
def score_histogram(spark, d):
    return risk.histogram(volume_scores(spark, d))


@query
def score_drift(spark, d):
    return risk.drift(volume_scores(spark, d))


@query
def graph_nodes(spark, d):
    return graph.build_nodes(netlog(spark, d))


@query
def graph_edges(spark, d):
    e = graph.build_edges(netlog(spark, d))
    return e.select("src", "dst", "edge_type", "event_count", "first_seen", "last_seen", joined("ports"), joined("protocols"))


@query
def graph_scored_nodes(spark, d):
    return rounded(scored_nodes(netlog(spark, d)).select("id", "risk_score", "is_anomalous"))


@query
def graph_edge_risk(spark, d):
    nodes, edges = scored_graph(spark, d)
    return rounded(graph.apply_edge_risk(edges, nodes).select("src", "dst", "edge_type", "risk_score", "freq"))


@query
def graph_degrees(spark, d):
    return graph.degrees(graph.build_edges(netlog(spark, d))).select("id", "out_degree", "in_degree", "degree", "out_neighbors")


@query
def graph_risk_subgraph(spark, d):
    nodes, edges = scored_graph(spark, d)
    return graph.risk_subgraph(nodes, edges, 0.5)[1].select("src", "dst", "edge_type", "event_count")


@query
def graph_touching(spark, d):
    nodes, edges = scored_graph(spark, d)
    return graph.touching(edges, nodes.filter("risk_score >= 0.95")).select("src", "dst", "edge_type", "event_count")


@query
def graph_neighborhood(spark, d):
    edges = graph.build_edges(netlog(spark, d))
    start = spark.range(1).select(F.lit("203.0.113.77").alias("id"))
    return graph.neighborhood(edges, start, 2)


@query
def graph_trace_path(spark, d):
    return graph.trace_path(graph.build_edges(netlog(spark, d)), "10.1.0.3", "203.0.113.88", 5)


@query
def graph_edge_rarity(spark, d):
    return rounded(graph.edge_rarity(netlog(spark, d)))


@query
def graph_rare_path_scores(spark, d):
    return rounded(paths.path_scores(paths.rarest_paths(graph.edge_rarity(netlog(spark, d)))))


def short_paths(spark, d):
    """The rarest paths of two and three edges through every address, at a cut that leaves some out."""
    return paths.rarest_paths(graph.edge_rarity(netlog(spark, d)), length=3, percentile=0.25)


@query
def graph_rare_path_means(spark, d):
    found = short_paths(spark, d)
    means = F.array_join(F.transform("paths", lambda x: F.format_number(x["mean"], 4)), ";").alias("means")
    return rounded(found.select("id", F.size("paths").alias("n"), means).join(paths.path_scores(found), "id"), 5)


@query
def graph_paths_of_address(spark, d):
    logs = netlog(spark, d)
    busiest = graph.build_nodes(logs).filter("entity_type = 'ip'").orderBy(F.desc("total_events"), "id").first().id
    found = paths.paths_of(short_paths(spark, d), busiest)
    return rounded(found.select(F.lit(busiest).alias("id"), "place", "mean"), 5)


@query
def graph_peers(spark, d):
    return graph.peers(graph.build_edges(netlog(spark, d)), 5)


@query
def chain_seeds(spark, d):
    nodes, edges = scored_graph(spark, d)
    return rounded(chains.seeds(nodes, edges, 0.8, 0.3))


@query
def chain_outbound(spark, d):
    nodes, edges = scored_graph(spark, d)
    return flat_chains(chains.outbound(nodes, edges, chains.seeds(nodes, edges, 0.8, 0.3), 50, 0.6))


@query
def chain_risky_edges(spark, d):
    nodes, edges = scored_graph(spark, d)
    return flat_chains(chains.risky_edges(nodes, edges, chains.seeds(nodes, edges, 0.8, 0.3), 20, 0.8, 0.9))


@query
def chain_scans(spark, d):
    nodes, edges = scored_graph(spark, d)
    return flat_chains(chains.scans(nodes, edges, 0.9, 10, 5))


@query
def chain_lateral(spark, d):
    nodes, edges = scored_graph(spark, d)
    return flat_chains(chains.lateral(nodes, edges, 50, 0.9))


@query
def chain_rare_paths(spark, d):
    nodes, edges = scored_graph(spark, d)
    p = chains.rare_paths(nodes, edges, chains.seeds(nodes, edges, 0.8, 0.3), n_seeds=40, cut=0.30, risk_cut=0.5, per_seed=10)
    return rounded(p.select("seed", F.array_join("path", ",").alias("path"), "rarity", "score", "max_risk", "place"))


@query
def chains_mined(spark, d):
    nodes, edges = scored_graph(spark, d)
    out = chains.mine(nodes, edges, 0.30, None)
    return out.select("chain_id", "chain_type", "total_risk_score", "confidence", joined("mitre_techniques"), "investigation_priority", "description")


@query
def chain_type_counts(spark, d):
    return chains_mined(spark, d).groupBy("chain_type").agg(F.count("*").alias("n"))


@query
def sequence_patterns(spark, d):
    return rounded(chains.sequences(netlog(spark, d)).select(joined("sequence"), "freq", "share"))


@query
def sequence_support(spark, d):
    return rounded(chains.sequences(netlog(spark, d), rare=1.1).select(joined("sequence"), "freq", "share"))


@query
def dga_domain_features(spark, d):
    each = netlog(spark, d).select("domain").filter("domain is not null").distinct()
    return rounded(dga.domain_features(each))


@query
def dga_domain_scores(spark, d):
    return rounded(dga.dga_scores(netlog(spark, d)).select("domain", "score", "is_dga"))


@query
def dga_host_ratio(spark, d):
    logs = netlog(spark, d)
    scored = dga.dga_scores(logs).withColumn("is_dga", F.col("score") >= 0.3)
    return rounded(dga.host_ratio(logs, scored))


@query
def dga_forest_scores(spark, d):
    return dga.dga_scores(netlog(spark, d), forest=True).select("domain", "score", "is_dga")


@query
def text_statistics(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", "").alias("t"))
    t = F.col("t")
    return rounded(docs.select("doc_id", text.shannon_entropy(t).alias("entropy"), text.digit_fraction(t).alias("digits"), text.max_consonant_run(t).alias("run"), text.ngram_frequency_score(t).alias("bigrams"), text.unique_char_ratio(t).alias("unique_chars")))


@query
def addresses_in_texts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    each = docs.select("doc_id", F.explode(net.extract_ips(F.col("text"))).alias("ip"))
    return each.select("doc_id", "ip", net.is_internal_ip(F.col("ip")).alias("internal"), net.is_public_ip(F.col("ip")).alias("public"), net.ip_in_subnet(F.col("ip"), "128.0.0.0/1").alias("upper_half"))


@query
def address_functions(spark, d):
    ips = netlog(spark, d).select(F.col("dst_ip").alias("ip")).distinct()
    return ips.select("ip", net.is_valid_ip(F.col("ip")).alias("valid"), net.normalize_ip(F.col("ip")).alias("normal"), net.is_internal_ip(F.col("ip")).alias("internal"), net.entity_type(F.col("ip")).alias("entity_type"), net.ipv4_number(F.col("ip")).alias("number"))


@query
def business_hours(spark, d):
    t = F.col("ts_ms")
    return netlog(spark, d).groupBy(net.utc_hour(t).alias("hour"), net.in_business_hours(t).alias("business"), net.at_night(t).alias("night")).agg(F.count("*").alias("n"))


@query
def top_event_types(spark, d):
    return netlog(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out")).orderBy(F.desc("n"), "event_type").limit(10)


@query
def top_sources(spark, d):
    return netlog(spark, d).groupBy("src_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_ip").limit(10)


@query
def connection_detail(spark, d):
    rows = netlog(spark, d).filter("src_ip = '10.1.0.8'")
    return rows.groupBy("dst_ip", "event_type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("dst_port")), lambda p: p.cast("string")), ",").alias("ports"), F.sum("bytes_out").alias("bytes_out"))


@query
def inside_outside(spark, d):
    inside = F.col("dst_ip").rlike(r"^(10\.|192\.168\.|172\.16\.)")
    return netlog(spark, d).groupBy(inside.alias("inside")).agg(F.count("*").alias("n"), F.count_distinct("dst_ip").alias("targets"))


def profile_parts(spark, d):
    logs = netlog(spark, d)
    half = F.col("event_id") % 2 == 0
    old = logs.filter(half).groupBy("src_ip").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_seen"))
    old = old.select(F.col("src_ip").alias("entity_id"), net.entity_type(F.col("src_ip")).alias("entity_type"), (F.col("n") / 100).alias("score"), F.lit(0.0).alias("baseline_score"), F.lit(1_000).cast("bigint").alias("last_updated"), F.array().cast("array<string>").alias("associated_chains"), F.col("n").alias("evidence_count"), "first_seen", F.array().cast("array<string>").alias("tags"))
    new = logs.filter(~half).groupBy(F.col("dst_ip").alias("entity_id")).agg((F.count("*") / 100).alias("score"))
    return old, new


@query
def risk_profiles(spark, d):
    old, new = profile_parts(spark, d)
    nodes, edges = scored_graph(spark, d)
    found = chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5))
    out = risk.updated(old, new, found, 86_401_000)
    return rounded(out.select("entity_id", "entity_type", "score", "evidence_count", F.size("associated_chains").alias("chains"), joined("tags"), risk.trend(F.col("score"), F.col("baseline_score")).alias("trend")), 8)


@query
def risk_point_lookup(spark, d):
    return rounded(risk.score_at(profile_parts(spark, d)[0], "10.1.0.8", 86_401_000))


@query
def risk_top_profiles(spark, d):
    return rounded(risk.top(profile_parts(spark, d)[0].select("entity_id", "score"), 20, "score", "entity_id"))


@query
def risk_search(spark, d):
    return rounded(risk.search(profile_parts(spark, d)[0].select("entity_id", "score"), ".1.0.1", 0.3))


@query
def daily_report(spark, d):
    old, new = profile_parts(spark, d)
    nodes, edges = scored_graph(spark, d)
    found = chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5))
    out = risk.daily_report(risk.updated(old, new, found, 86_401_000), found, netlog(spark, d), "2024-01-01")
    return out.select("date", "events", "entities", "chains", "total_evidence", F.size("top_entities").alias("n_entities"), F.size("top_chains").alias("n_chains"), F.size("recommendations").alias("n_recommendations"))


@query
def mitre_coverage(spark, d):
    nodes, edges = scored_graph(spark, d)
    return risk.mitre_coverage(chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5)))


@query
def chains_api_page(spark, d):
    nodes, edges = scored_graph(spark, d)
    return flat_chains(risk.chains_page(chains.lateral(nodes, edges, 50, 0.9), 0.7, "lateral_movement", 20))


@query
def chain_by_id(spark, d):
    nodes, edges = scored_graph(spark, d)
    found = chains.lateral(nodes, edges, 50, 0.9)
    one = risk.top(found, 1, "total_risk_score", "affected_assets").select("chain_id")
    return flat_chains(risk.chain_by_id(found, one))


@query
def entity_profile(spark, d):
    logs = netlog(spark, d)
    profiles = profile_parts(spark, d)[0].select("entity_id", "entity_type", "score", "evidence_count")
    return rounded(risk.profile(profiles, graph.build_edges(logs), "10.1.0.8", 1).select("entity_id", "entity_type", "score", "evidence_count", "neighbors"))


@query
def entities_page(spark, d):
    return rounded(risk.entities_page(profile_parts(spark, d)[0].select("entity_id", "entity_type", "score"), "ip", 0.3, 20))


@query
def service_counters(spark, d):
    nodes, edges = scored_graph(spark, d)
    return risk.counters(netlog(spark, d), chains.scans(nodes, edges, 0.9, 10, 5))


@query
def chains_of_entities(spark, d):
    nodes, edges = scored_graph(spark, d)
    old, new = profile_parts(spark, d)
    found = chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5))
    return rounded(risk.chains_of(risk.updated(old, new, found, 86_401_000), found).select("entity_id", "chain_type", "total_risk_score"))


@query
def report_summary(spark, d):
    nodes, edges = scored_graph(spark, d)
    return risk.severity_counts(chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5)))


@query
def chain_narratives(spark, d):
    nodes, edges = scored_graph(spark, d)
    return risk.narrative(chains.lateral(nodes, edges, 20, 0.9)).select("story", "action")


@query
def entity_timeline(spark, d):
    return risk.timeline(risk.timeline_entries(netlog(spark, d)), "10.1.0.8", 50)


@query
def intel_matches(spark, d):
    logs = netlog(spark, d)
    entities = logs.select(F.explode(F.array("dst_ip", F.concat(F.lit("www."), F.col("domain")))).alias("entity"))
    ips = logs.filter("event_id % 97 = 0").select(F.lit("ip").alias("kind"), F.col("dst_ip").alias("value"))
    names = logs.filter("event_id % 89 = 0 and domain is not null").select(F.lit("domain").alias("kind"), F.col("domain").alias("value"))
    return intel.match(entities, intel.normalized(ips.unionByName(names)))


@query
def weak_labels(spark, d):
    return rounded(evaluation.weak_labels(netlog(spark, d)))


def with_attacks(spark, d):
    """The table's records with nine attacks among them, and the attacks."""
    return evaluation.inject(netlog(spark, d), 1_718_400_000_000)


@query
def evaluation_metrics(spark, d):
    logs, truth = with_attacks(spark, d)
    return evaluation.metrics(truth, pipeline.run(logs).chains, 0.5)


@query
def injected_records(spark, d):
    logs, _ = with_attacks(spark, d)
    found = evaluation.injected(logs).groupBy(F.try_element_at("tags", F.lit(-1)).alias("attack")).agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))
    rest = logs.filter(F.size("tags") == 0).agg(F.lit("none").alias("attack"), F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))
    return found.unionByName(rest)


@query
def evaluation_per_type(spark, d):
    logs, truth = with_attacks(spark, d)
    return evaluation.per_type(truth, pipeline.run(logs).chains, 0.5)


@query
def running_risk(spark, d):
    """The decaying risk of every source as the stream leaves it, over records that are all there."""
    logs = netlog(spark, d).select(F.col("src_ip").alias("entity_id"), "timestamp", (F.col("severity") / 10).alias("score"))
    return rounded(state.risk_batch(logs, 24.0))


@query
def target_novelty(spark, d):
    """New targets of the second half of the time, by source, against a baseline of the first."""
    logs = netlog(spark, d)
    half = logs.agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("half"))
    cut = logs.join(F.broadcast(half))
    known = state.merge_targets(state.targets_of(cut.filter("ts_ms < half")))
    return state.with_novelty(cut.filter("ts_ms >= half"), known).groupBy("src_ip").agg(F.count("*").alias("events"), F.count_if("new_target").alias("new_targets"))


@query
def core_distances(spark, d):
    """Exact distance of each entity to its tenth nearest, in the empirical tails of three features."""
    names = ["unique_dst_ips", "unique_dst_ports", "bytes_out_total"]
    tails = detectors.left_tails(features.entity_features(netlog(spark, d)), features.KEYS, names)
    wide = tails.groupBy(*features.KEYS).pivot("feature", names).agg(F.first("p"))
    rows, one = density.points(wide, features.KEYS, names)
    core = density.core_distances(one, density.nearest(one, 10), 10)
    return rounded(rows.join(core, "id").select(*features.KEYS, "core"))


@query
def density_clusters(spark, d):
    names = ["unique_dst_ips", "unique_dst_ports", "bytes_out_total"]
    tails = detectors.left_tails(features.entity_features(netlog(spark, d)), features.KEYS, names)
    wide = tails.groupBy(*features.KEYS).pivot("feature", names).agg(F.first("p"))
    return density.density_clusters(wide, features.KEYS, names, least=25)


@query
def autoencoder_scores(spark, d):
    return autoencoder.autoencoder(features.entity_features(netlog(spark, d)), features.KEYS, list(features.FEATURES))


@query
def exported_report(spark, d):
    """The summary and the chains of the exported report, over the scanning and lateral chains."""
    nodes, edges = scored_graph(spark, d)
    mined = chains.enrich(chains.scans(nodes, edges, 0.9, 10, 5).unionByName(chains.lateral(nodes, edges, 50, 0.9)))
    scores = nodes.filter("entity_type = 'ip'").select("id", F.col("risk_score").alias("score"))
    out = risk.exported(netlog(spark, d), mined, scores, scores, None)
    first = F.array_join(F.transform("chains", lambda c: F.format_number(c["total_risk_score"], 4)), ",")
    return out.select("events", "chains_found", "high_risk", "critical_risk", "entities", first.alias("chains"))


@query
def entity_neighbors(spark, d):
    logs = netlog(spark, d)
    one = logs.groupBy("src_ip").count().orderBy(F.desc("count"), "src_ip").first().src_ip
    return risk.neighbors(graph.build_edges(logs), one, 1)


@query
def pipeline_scores(spark, d):
    return pipeline.scored(netlog(spark, d))[2]


@query
def tumbling_windows(spark, d):
    out = state.tumbling_counts(netlog(spark, d), "1 day")
    return out.select(F.unix_millis("start").alias("start_ms"), "src_ip", "event_type", "events", "bytes_out")


@query
def sliding_windows(spark, d):
    return state.sliding_counts(netlog(spark, d), "2 hours", "1 hour").select(F.unix_millis("start").alias("start_ms"), "event_type", "events")


@query
def session_windows(spark, d):
    return state.sessions(netlog(spark, d), "6 hours").select("src_ip", F.unix_millis("start").alias("start_ms"), F.unix_millis("stop").alias("stop_ms"), "events")


@query
def state_merge(spark, d):
    logs = netlog(spark, d)
    a, b = (graph.build_edges(logs.filter(F.col("event_id") % 2 == i)) for i in (0, 1))
    e = state.merge_edges(a, b)
    return e.select("src", "dst", "edge_type", "event_count", "first_seen", "last_seen", joined("ports"), joined("protocols"))


PARSED = ["event_type", "src_ip", "dst_ip", "src_port", "severity", "proto", "process_name", "process_id"]


def stamp(pattern: str):
    return F.date_format("timestamp", pattern)


@query
def parse_syslog_5424(spark, d):
    word = F.when(F.col("event_type") == "auth_failure", "Failed password for root").when(F.col("event_type") == "auth_success", "Accepted password for root").otherwise("Allowed TCP connection")
    line = F.concat(F.lit("<"), (F.col("severity") * 8 + F.col("event_id") % 8).cast("string"), F.lit(">1 "), stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" fw"), (F.col("event_id") % 5).cast("string"), F.lit(" sshd "), F.col("event_id").cast("string"), F.lit(" - - "), word, F.lit(" from "), F.col("src_ip"), F.lit(":"), F.col("dst_port").cast("string"), F.lit(" to "), F.col("dst_ip"))
    out = syslog.parse(netlog(spark, d).select(line.alias("value")), 2024, F.lit(NOW).cast("timestamp"))
    return out.select("event_id", "sensor_id", F.unix_millis("timestamp").alias("ms"), *PARSED)


@query
def parse_syslog_3164(spark, d):
    line = F.concat(F.lit("<13>"), stamp("MMM dd HH:mm:ss"), F.lit(" host"), (F.col("event_id") % 5).cast("string"), F.lit(" app["), F.col("event_id").cast("string"), F.lit("]: denied from "), F.col("src_ip"), F.lit(" port "), F.col("dst_port").cast("string"))
    out = syslog.parse(netlog(spark, d).select(line.alias("value")), 2024, F.lit(NOW).cast("timestamp"))
    return out.select("event_id", "sensor_id", F.date_format("timestamp", "MM-dd HH:mm:ss").alias("day"), *PARSED)


@query
def parse_dns_bind(spark, d):
    line = F.concat(stamp("dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" queries: info: client @0x1 "), F.col("src_ip"), F.lit("#"), (F.col("event_id") % 60000 + 1).cast("string"), F.lit(" ("), F.col("domain"), F.lit("): query: "), F.col("domain"), F.lit(" IN A + (10.0.0.1)"))
    out = dns.parse(netlog(spark, d).filter("domain is not null").select(line.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "src_ip", "src_port", "domain", "dns_rdata", "proto", "event_type")


@query
def parse_dns_windows(spark, d):
    code = F.when(F.col("dns_rcode") == "NXDOMAIN", "3").otherwise("0")
    line = F.concat_ws("\t", stamp("yyyy-MM-dd'T'HH:mm:ss"), "src_ip", "domain", F.lit("AAAA"), code, F.lit("a"), F.lit("b"), F.lit("c"))
    out = dns.parse(netlog(spark, d).filter("domain is not null").select(line.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select("event_id", "src_ip", "domain", "dns_rdata", "dns_rcode", joined("tags"))


@query
def parse_waf_json(spark, d):
    act = F.when(F.col("severity") > 5, "block").otherwise("log")
    line = F.to_json(F.struct(F.col("src_ip").alias("clientIP"), F.lit("app.internal").alias("clientRequestHTTPHost"), F.concat(F.lit("/p/"), "event_id").alias("clientRequestPath"), F.col("ts_ms").alias("timestamp"), F.col("waf_rule_id").alias("ruleId"), act.alias("action"), F.lit("403").alias("edgeResponseStatus")))
    out = waf.parse(netlog(spark, d).filter("event_type = 'waf_alert'").select(line.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select(F.unix_millis("timestamp").alias("ms"), "src_ip", "domain", "url", "waf_action", "waf_rule_id", "severity", "http_status", joined("tags"))


@query
def parse_waf_pairs(spark, d):
    line = F.concat(F.lit('src_ip="'), F.col("src_ip"), F.lit('" dst_ip='), F.col("dst_ip"), F.lit(" rule_id="), F.col("waf_rule_id"), F.lit(" request blocked"))
    out = waf.parse(netlog(spark, d).filter("event_type = 'waf_alert'").select(line.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select("event_id", "src_ip", "dst_ip", "waf_action", "waf_rule_id", "severity")


@query
def parse_etw_xml(spark, d):
    number = F.when(F.col("event_type") == "auth_failure", "4625").otherwise("4624")
    line = F.concat(F.lit('<Event xmlns="http://x"><System><EventID>'), number, F.lit("</EventID><Level>"), (F.col("severity") % 6).cast("string"), F.lit('</Level><TimeCreated SystemTime="'), stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"/><Computer>pc</Computer></System><EventData><Data Name="TargetUserName">'), F.col("user"), F.lit('</Data><Data Name="IpAddress">'), F.col("src_ip"), F.lit("</Data></EventData></Event>"))
    out = etw.parse(netlog(spark, d).filter("user is not null").select(line.alias("value")), F.lit(NOW).cast("timestamp"))
    return out.select("event_id", F.unix_millis("timestamp").alias("ms"), "sensor_id", "src_ip", "user", "event_type", "severity", joined("tags"))
