"""Attack chains mined from the graph.

A chain: chain_id, chain_type, nodes (entity, role, risk_score), edges (src, dst, edge_type, event_count),
total_risk_score, confidence, first_seen, last_seen, affected_assets. Rules give typed rows; enrich()
adds phases, techniques, description and priority by type. Every cut has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import at_night, is_internal_ip
from ..lineage import saved, written
from .graph import degrees, union_all
from .sequences import frequent

NODE = "struct<entity: string, role: string, risk_score: double>"
EDGE = "struct<src: string, dst: string, edge_type: string, event_count: bigint>"
#: Fixed table of chain types: phases, techniques, priority.
TEMPLATES = {
    "c2_beacon": (["Command & Control"], ["T1071", "T1071.001", "T1573"], 1),
    "lateral_movement": (["Lateral Movement"], ["T1021", "T1078", "T1550"], 1),
    "data_exfil": (["Actions on Objectives", "Exfiltration"], ["T1041", "T1048", "T1567"], 1),
    "dga_activity": (["Command & Control"], ["T1568", "T1568.002"], 2),
    "recon_scan": (["Reconnaissance", "Discovery"], ["T1046", "T1595"], 3),
    "credential_theft": (["Credential Access"], ["T1003", "T1110", "T1555"], 1),
    "ransomware_pattern": (["Impact", "Command & Control"], ["T1486", "T1070", "T1485"], 1),
    "privilege_escalation": (["Privilege Escalation"], ["T1068", "T1134", "T1548"], 2),
    "supply_chain": (["Initial Access"], ["T1195", "T1195.002"], 2),
    "suspicious_activity": (["Unknown"], [], 3),
}
COLUMNS = ["chain_id", "chain_type", "nodes", "edges", "total_risk_score", "confidence", "first_seen", "last_seen", "affected_assets"]


def edge_frequency(edges: DataFrame) -> DataFrame:
    """edges with freq: event_count over the largest."""
    most = edges.agg(F.max("event_count").alias("most"))
    return edges.join(F.broadcast(most)).withColumn("freq", F.col("event_count") / F.col("most")).drop("most")


def seeds(nodes: DataFrame, edges: DataFrame, least: float = 0.30, rare: float = 0.05) -> DataFrame:
    """(id, risk_score): risky nodes (or the 50 riskiest if none is), and nodes of degree 2 to 500 with a rare edge out."""
    risky = nodes.filter(F.col("risk_score") >= least).select("id", "risk_score")
    top = nodes.filter("risk_score > 0").orderBy(F.desc("risk_score"), "id").limit(50).select("id", "risk_score")
    none = nodes.agg(F.max("risk_score").alias("most")).filter(F.coalesce("most", F.lit(0.0)) < least)
    instead = top.join(F.broadcast(none), F.lit(True), "left_semi")
    out = edges.filter(F.col("freq") < rare).select(F.col("src").alias("id")).distinct()
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = degree.filter(F.col("degree").between(2, 500)).select("id")
    quiet = nodes.select("id", "risk_score").join(out, "id", "left_semi").join(known, "id", "left_semi")
    return union_all([risky, instead, quiet]).distinct()


def best_seeds(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("risk_score"), "id").limit(n)


def identity(kind: Column, nodes: Column, edges: Column) -> Column:
    """A stable id from what the chain is made of."""
    names = F.array_join(F.transform(nodes, lambda n: n["entity"]), ",")
    links = F.array_join(F.transform(edges, lambda e: F.concat_ws(">", e["src"], e["edge_type"], e["dst"])), ",")
    return F.substring(F.sha2(F.concat_ws("|", kind, names, links), 256), 1, 16)


def chain(df: DataFrame, kind: Column, nodes: Column, edges: Column, risk: Column, confidence: Column, first: Column, last: Column, assets: Column) -> DataFrame:
    out = df.select(
        kind.alias("chain_type"),
        nodes.cast(f"array<{NODE}>").alias("nodes"),
        edges.cast(f"array<{EDGE}>").alias("edges"),
        risk.cast("double").alias("total_risk_score"),
        confidence.cast("double").alias("confidence"),
        first.alias("first_seen"),
        last.alias("last_seen"),
        assets.alias("affected_assets"),
    )
    return out.withColumn("chain_id", identity(F.col("chain_type"), F.col("nodes"), F.col("edges"))).select(COLUMNS)


def node(entity: Column, role: str | Column, risk: Column) -> Column:
    return F.struct(entity.alias("entity"), (F.lit(role) if isinstance(role, str) else role).alias("role"), risk.alias("risk_score"))


def edge(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.struct(c("src").alias("src"), c("dst").alias("dst"), c("edge_type").alias("edge_type"), c("event_count").alias("event_count"))


def rare_paths(nodes: DataFrame, edges: DataFrame, found: DataFrame, n_seeds: int = 40, least: int = 2, most: int = 3, cut: float = 0.65, risk_cut: float = 0.50, per_seed: int = 10, beam: int = 200) -> DataFrame:
    """The `per_seed` best simple paths of rare edges from each of the riskiest seeds: seed, path, links, since, until, rarity, score, max_risk, place.

    A path of least to most edges scores 0.7 min(mean rarity / 8, 1) + 0.3 mean risk of its nodes. Exact: a first search follows
    the `beam` most promising paths of a seed after each hop, and the last place it finds is a bar. The second follows every
    path that can still reach its seed's bar (or the cut, where that is higher): a path can gain no more than the rarest edge and the
    riskiest node next to where it stands, then those of the whole graph. So no path is lost, and few are followed.

    The paths of a hop go to the edges, not both to a shuffle, while they are no more than a first search can have.
    """
    risk = nodes.select(F.col("id").alias("dst"), F.col("risk_score").alias("dst_risk"))
    w = F.round(-F.log(F.greatest("freq", F.lit(1e-6))), 9)
    steps = edges.select("src", "dst", "edge_type", "event_count", "first_seen", "last_seen", w.alias("w"))
    steps = written(steps.join(risk, "dst").withColumnRenamed("src", "at"))
    ahead = steps.groupBy("at").agg(F.max("w").alias("next_w"), F.max("dst_risk").alias("next_risk"))
    ahead = saved(ahead.join(F.broadcast(steps.agg(F.max("w").alias("any_w"), F.max("dst_risk").alias("any_risk")))))
    start = saved(best_seeds(found, n_seeds).select(
        F.col("id").alias("seed"), F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast(f"array<{EDGE}>").alias("links"), F.array("risk_score").alias("risks"),
        F.lit(0.0).alias("rarity"), F.lit(None).cast("bigint").alias("since"), F.lit(None).cast("bigint").alias("until"),
    ))
    total = F.aggregate("risks", F.lit(0.0), lambda a, x: a + x)
    types = F.transform("links", lambda e: e["edge_type"])

    def score_of(rarity: Column, risks: Column, hops: int) -> Column:
        return 0.7 * F.least(rarity / hops / 8, F.lit(1.0)) + 0.3 * risks / (hops + 1)

    def promise(hop: int) -> Column:
        """The most that a path of `hop` edges can score after one more edge or several."""
        more = [h - hop - 1 for h in range(max(least, hop + 1), most + 1)]
        ends = [score_of(F.col("rarity") + F.col("next_w") + m * F.col("any_w"), total + F.col("next_risk") + m * F.col("any_risk"), hop + 1 + m) for m in more]
        return F.greatest(*ends) if len(ends) > 1 else ends[0]

    def search(bars: DataFrame | None) -> DataFrame:
        """Finished paths: of the most promising ones of each seed, or of all that can reach its bar."""
        paths, out = start, None
        for hop in range(1, most + 1):
            near = paths.join(ahead, "at").withColumn("promise", promise(hop - 1))
            if bars is None:
                order = Window.partitionBy("seed").orderBy(F.desc("promise"), F.xxhash64("path", types))
                near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).drop("r")
            else:
                near = near.join(F.broadcast(bars), "seed").filter(F.col("promise") >= F.col("bar") - 1e-8)  # a row for each seed
            near = saved(near.select(paths.columns))
            few = near.limit(n_seeds * beam + 1).count() <= n_seeds * beam
            grown = (F.broadcast(near) if few else near).join(steps, "at").filter(~F.array_contains("path", F.col("dst")))
            link = F.struct(F.col("at").alias("src"), "dst", "edge_type", "event_count")
            paths = grown.select(
                "seed", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("links", F.array(link)).alias("links"),
                F.concat("risks", F.array("dst_risk")).alias("risks"), F.round(F.col("rarity") + F.col("w"), 9).alias("rarity"),
                F.least("since", "first_seen").alias("since"), F.greatest("until", "last_seen").alias("until"),
            )
            done = paths.withColumn("score", F.round(score_of(F.col("rarity"), total, hop), 9)).withColumn("max_risk", F.array_max("risks"))
            done = done.filter((F.col("score") >= cut) & (F.col("max_risk") >= risk_cut))
            if bars is not None:
                done = done.join(F.broadcast(bars), "seed").filter(F.col("score") >= F.col("bar") - 1e-8).drop("bar")
            if hop < most:
                paths = saved(paths)
            if hop >= least:
                out = done if out is None else out.unionByName(done)
        place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "path", types))
        return saved(out.withColumn("place", place).filter(F.col("place") <= per_seed))

    last = search(None).filter(F.col("place") == per_seed).select("seed", F.col("score").alias("last"))
    bars = saved(start.select("seed").join(last, "seed", "left").select("seed", F.greatest(F.coalesce("last", F.lit(cut)), F.lit(cut)).alias("bar")))
    return search(bars)


def path_type(nodes: Column, links: Column, out_degree: Column, ports: Column) -> Column:
    """Type of a path chain from its edge types, and where its ends are; first rule that holds."""
    kinds = F.array_distinct(F.transform(links, lambda e: e["edge_type"]))
    has = lambda k: F.array_contains(kinds, k)
    outside = F.exists(nodes, lambda n: ~is_internal_ip(n["entity"]))
    inside = F.exists(nodes, lambda n: is_internal_ip(n["entity"]))
    targets = F.size(F.array_distinct(F.transform(links, lambda e: e["dst"])))
    events = F.aggregate(links, F.lit(0).cast("bigint"), lambda a, e: a + e["event_count"])
    n = F.size(links)
    return (
        F.when(has("auth") & has("network"), "lateral_movement")
        .when(has("dns"), "dga_activity")
        .when((targets >= 5) & has("network") & ~outside, "recon_scan")
        .when((out_degree >= 8) & (ports >= 5) & has("network"), "recon_scan")
        .when(outside & inside & has("network"), F.when((events >= 8) | (n >= 2), "data_exfil").otherwise("c2_beacon"))
        .when(outside & (n == 1), "c2_beacon")
        .when(F.size(kinds) >= 3, "supply_chain")
        .when(has("network") & ~outside & (n >= 2), "lateral_movement")
        .otherwise("suspicious_activity")
    )


def path_chains(paths: DataFrame, edges: DataFrame) -> DataFrame:
    own = edges.join(F.broadcast(paths.select(F.col("seed").alias("src")).distinct()), "src", "left_semi")  # the seeds are few
    d = degrees(own).select(F.col("id").alias("seed"), "out_degree", "ports")
    df = paths.join(d, "seed", "left").fillna(0, ["out_degree", "ports"])
    last = F.size("path") - 1
    roles = F.transform("path", lambda p, i: node(p, F.when(i == 0, "source").when(i == last, "target").otherwise("pivot"), F.get("risks", i)))
    df = df.withColumn("nodes", roles)
    kind = path_type(F.col("nodes"), F.col("links"), F.col("out_degree"), F.col("ports"))
    return chain(df, kind, F.col("nodes"), F.col("links"), F.col("score"), F.col("score"), F.col("since"), F.col("until"), F.col("path"))


def with_risks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    r = nodes.select("id", "risk_score")
    out = edges.drop("risk_score").join(r.select(F.col("id").alias("src"), F.col("risk_score").alias("src_risk")), "src")
    return out.join(r.select(F.col("id").alias("dst"), F.col("risk_score").alias("dst_risk")), "dst")


def outbound(nodes: DataFrame, edges: DataFrame, found: DataFrame, n_seeds: int = 50, least: float = 0.6) -> DataFrame:
    """Risky internal seeds that talk to outside addresses: data_exfil beyond ports 80 and 443, else c2_beacon."""
    top = best_seeds(found, n_seeds).filter(F.col("risk_score") >= least).select(F.col("id").alias("src"))
    dst = F.col("dst")
    far = ~is_internal_ip(dst) & ~dst.rlike(r"^(8\.8\.|1\.1\.|9\.9\.)")
    rows = edges.filter(F.col("edge_type").isin("network", "dns") & is_internal_ip(F.col("src")) & far).join(F.broadcast(top), "src", "left_semi")
    rows = with_risks(rows, nodes)
    odd = F.exists("ports", lambda p: ~p.isin(80, 443))
    kind = F.when(odd, "data_exfil").otherwise("c2_beacon")
    risk = F.greatest("src_risk", F.lit(0.5))
    ends = F.array(node(F.col("src"), "source", F.col("src_risk")), node(dst, "target", F.col("dst_risk")))
    return chain(rows, kind, ends, F.array(edge()), risk, risk, F.col("first_seen"), F.col("last_seen"), F.array("src", "dst"))


def risky_edges(nodes: DataFrame, edges: DataFrame, found: DataFrame, n_seeds: int = 20, least: float = 0.80, rare: float = 0.10) -> DataFrame:
    """Rare direct edges between two of the riskiest seeds, from the higher to the lower ranked."""
    order = Window.partitionBy().orderBy(F.desc("risk_score"), "id")
    top = best_seeds(found, n_seeds).withColumn("rank", F.row_number().over(order))
    a = top.select(F.col("id").alias("src"), F.col("rank").alias("ra"))
    b = top.select(F.col("id").alias("dst"), F.col("rank").alias("rb"))
    rows = edges.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").filter((F.col("ra") < F.col("rb")) & (F.col("freq") < rare))
    rows = with_risks(rows, nodes).withColumn("risk", F.greatest("src_risk", "dst_risk")).filter(F.col("risk") >= least)
    ends = F.array(node(F.col("src"), "source", F.col("src_risk")), node(F.col("dst"), "target", F.col("dst_risk")))
    return chain(rows, F.lit("suspicious_activity"), ends, F.array(edge()), F.col("risk"), F.col("risk"), F.col("first_seen"), F.col("last_seen"), F.array("src", "dst"))


def scans(nodes: DataFrame, edges: DataFrame, least: float = 0.5, targets: int = 10, shown: int = 20) -> DataFrame:
    """Risky nodes with many distinct targets: recon_scan, with the first targets by name as assets."""
    rows = edges.drop("risk_score").filter(F.col("edge_type").isin("network", "dns")).join(nodes.filter(F.col("risk_score") >= least).select(F.col("id").alias("src"), "risk_score"), "src")
    each = rows.groupBy("src", "dst").agg(F.max("risk_score").alias("risk_score"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    order = Window.partitionBy("src").orderBy("dst")
    each = each.withColumn("r", F.row_number().over(order))
    found = each.groupBy("src").agg(
        F.count("*").alias("n"), F.max("risk_score").alias("risk"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.col("dst")))).alias("shown"),
    )
    found = found.filter(F.col("n") >= targets)
    only = F.array(node(F.col("src"), "source", F.col("risk")))
    none = F.array().cast(f"array<{EDGE}>")
    return chain(found, F.lit("recon_scan"), only, none, F.col("risk"), F.col("risk"), F.col("first_seen"), F.col("last_seen"), F.concat(F.array("src"), F.col("shown")))


def lateral(nodes: DataFrame, edges: DataFrame, top: int = 50, least: float = 0.3) -> DataFrame:
    """Logins to an internal pivot that then connects on: auth edge, then network or dns edge from its target.

    Kept if the login began at night, an edge is risky, busy, or the ends are.
    """
    logins = edges.filter(F.col("edge_type") == "auth").filter(is_internal_ip(F.col("dst")) & (F.col("src") != F.col("dst")))
    onward = edges.filter("edge_type in ('network', 'dns') and dst <> src").join(logins.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    e = with_risks(logins.unionByName(onward), nodes)
    first = e.filter("edge_type = 'auth'").select(*[F.col(c).alias(f"a_{c}") for c in ("src", "dst", "edge_type", "event_count", "first_seen", "last_seen", "src_risk", "dst_risk")])
    second = e.filter("edge_type in ('network', 'dns')").select(*[F.col(c).alias(f"b_{c}") for c in ("src", "dst", "edge_type", "event_count", "first_seen", "last_seen", "dst_risk")])
    first, second = of_pivots(first, second, top, least)
    rows = first.join(second, first["a_dst"] == second["b_src"]).filter("b_dst <> a_src and b_dst <> b_src")
    risk = F.greatest("a_src_risk", "a_dst_risk", "b_dst_risk")
    odd = at_night(F.col("a_first_seen")) | (risk > 0.5) | (F.col("a_event_count") > 50) | (F.col("b_event_count") > 50)
    rows = rows.withColumn("risk", risk).filter(odd | (F.col("risk") >= least))
    rows = rows.orderBy(F.desc("risk"), "a_src", "a_dst", "b_dst", "b_edge_type").limit(top)
    path = F.array(node(F.col("a_src"), "source", F.col("a_src_risk")), node(F.col("a_dst"), "pivot", F.col("a_dst_risk")), node(F.col("b_dst"), "target", F.col("b_dst_risk")))
    return chain(
        rows, F.lit("lateral_movement"), path, F.array(edge("a_"), edge("b_")), F.col("risk"), 0.9 * F.col("risk"),
        F.least("a_first_seen", "b_first_seen"), F.greatest("a_last_seen", "b_last_seen"), F.array("a_src", "a_dst", "b_dst"),
    )


def of_pivots(first: DataFrame, second: DataFrame, top: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The logins and the edges on that can be in the `top` rows of lateral(), so that no pivot joins all with all.

    A row's order is risk, then names. Of a pivot's edges on only the `top` + 1 best by (risk, b_dst, b_edge_type) can be in
    the first rows of a login: one of them may lead back to it. The same holds for logins, but whether one is kept at all
    may hang on the night, or on either count. So each is ranked among those with the same standing in these.
    """
    night, busy = at_night(F.col("a_first_seen")), F.col("a_event_count") > 50
    a = Window.partitionBy("a_dst", night, busy).orderBy(F.desc(F.greatest("a_src_risk", "a_dst_risk")), "a_src")
    b = Window.partitionBy("b_src", F.col("b_event_count") > 50).orderBy(F.desc("b_dst_risk"), "b_dst", "b_edge_type")
    low = F.col("b_low")
    second = second.withColumn("b_rank", F.row_number().over(b))
    # an edge on that is less risky than the login counts by name alone
    by_name = Window.partitionBy("b_src", F.col("b_event_count") > 50).orderBy("b_dst", "b_edge_type")
    second = second.withColumn("b_low", F.row_number().over(by_name))
    second = second.filter((F.col("b_rank") <= 3 * top) | (low <= 3 * top))
    by_source = Window.partitionBy("a_dst", night, busy).orderBy("a_src")
    first = first.withColumn("a_rank", F.row_number().over(a)).withColumn("a_low", F.row_number().over(by_source))
    first = first.filter((F.col("a_rank") <= top + 1) | (F.col("a_low") <= top + 1))
    return first.drop("a_rank", "a_low"), second.drop("b_rank", "b_low")


def entities_of(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(c, lambda n: n["entity"])))


def deduplicated(chains: DataFrame) -> DataFrame:
    """Of chains over the same entities the riskiest, then without those whose entities another chain has with more.

    Containment is looked for among chains that share the entity that fewest chains have, not between all pairs.
    """
    each = chains.withColumn("who", entities_of(F.col("nodes")))
    order = Window.partitionBy("who").orderBy(F.desc("total_risk_score"), "chain_id")
    each = saved(each.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r"))
    larger = each.select(F.col("who").alias("all"), F.explode("who").alias("one"))
    often = larger.groupBy("one").agg(F.count("*").alias("n"))
    mine = each.select("who", F.explode("who").alias("one")).join(often, "one").groupBy("who").agg(F.min(F.struct("n", "one"))["one"].alias("one"))
    inside = mine.join(larger, "one").filter((F.size("all") > F.size("who")) & (F.size(F.array_except("who", "all")) == 0)).select("who").distinct()
    return each.join(inside, "who", "left_anti").drop("who")


def templates(spark) -> DataFrame:
    words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = [F.struct(F.lit(k).alias("chain_type"), words(p).alias("kill_chain_phases"), words(m).alias("techniques"), F.lit(n).alias("investigation_priority")) for k, (p, m, n) in TEMPLATES.items()]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def enrich(chains: DataFrame) -> DataFrame:
    """chains with kill_chain_phases, mitre_techniques, investigation_priority and description of their type."""
    t = F.broadcast(templates(chains.sparkSession))
    known = F.when(F.col("chain_type").isin(*TEMPLATES), F.col("chain_type")).otherwise("suspicious_activity")
    df = chains.withColumn("known", known).join(t.withColumnRenamed("chain_type", "known"), "known").drop("known")
    who = lambda role: F.coalesce(F.get(F.filter("nodes", lambda n: n["role"] == role), F.lit(0))["entity"], F.lit("unknown"))
    told = F.concat_ws(" ", F.initcap(F.replace(F.col("chain_type"), F.lit("_"), F.lit(" "))), F.lit("from"), who("source"), F.lit("to"), who("target"))
    return df.withColumnRenamed("techniques", "mitre_techniques").withColumn("description", told)


def mine(nodes: DataFrame, edges: DataFrame, cut: float = 0.65, found: DataFrame | None = None) -> DataFrame:
    """All rules' chains, without repeats, enriched."""
    edges = edges if "freq" in edges.columns else written(edge_frequency(edges))
    found = saved(seeds(nodes, edges) if found is None else found)
    parts = [
        path_chains(rare_paths(nodes, edges, found, cut=cut), edges),
        outbound(nodes, edges, found),
        risky_edges(nodes, edges, found),
        scans(nodes, edges),
        lateral(nodes, edges),
    ]
    return enrich(deduplicated(union_all(parts)))


def sequences(logs: DataFrame, least: int = 2, length: int = 8, ahead: int = 3, rare: float = 0.01, ips: int = 2) -> DataFrame:
    """Rare sequences of (event_type, target): sequence, freq (hosts that have it), share (of all hosts).

    A sequence of a host goes on with any of the next `ahead` events. Kept are those of at most `length`
    items that `least` hosts or more have, fewer than the share `rare` of all hosts, with `ips` targets or
    more. Grown an item at a time; a sequence that too few hosts have has no longer ones.

    Hosts with the same events in the same order are one host that counts as many. Sequences grow in the task where all with
    the same first two items meet (sequences.py); nothing of what grows is written.
    """
    item = F.concat_ws("|", "event_type", "dst_ip")
    order = Window.partitionBy("src_ip").orderBy("ts_ms", *[c for c in ("event_id",) if c in logs.columns], item)
    events = written(logs.filter("src_ip <> '' and dst_ip <> ''").select("src_ip", item.alias("item"), F.row_number().over(order).alias("at")))
    rows, items, hosts = host_copies(events)
    out = frequent(rows, items, least, length, ahead)
    targets = F.size(F.array_distinct(F.transform("sequence", lambda x: F.substring_index(x, "|", -1))))
    out = out.filter(targets >= ips).join(F.broadcast(hosts)).select("sequence", "freq", (F.col("freq") / F.col("hosts")).alias("share"))
    return out.filter(F.col("share") < rare)


def host_copies(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events (src_ip, item, at) as rows (host, hosts, at, word) of one host for all with the same events, the items (word, item), and one row with the number of hosts."""
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "item", "at")).alias(f"mark{seed}") for seed in (1, 2)]
    same = events.groupBy("src_ip").agg(F.count("*").alias("n"), *marks)
    own = written(same.groupBy("n", "mark1", "mark2").agg(F.min("src_ip").alias("src_ip"), F.count("*").alias("hosts")).select("src_ip", "hosts", F.monotonically_increasing_id().alias("host")))
    items = written(events.select("item").distinct().select("item", F.monotonically_increasing_id().alias("word")))
    rows = written(events.join(own, "src_ip").join(items, "item").select("host", "hosts", "at", "word"))
    return rows, items, own.agg(F.sum("hosts").alias("hosts"))
