import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.functions import net, text
from riskloom.operators import chains, detectors, evaluation, features, graph, intel, paths, ranks, risk, sequences
from riskloom.queries import QUERIES

LOG = "event_id long, src_ip string, dst_ip string, dst_port int, proto string, event_type string, ts_ms long, bytes_out long, bytes_in long, user string, domain string, dns_rcode string, waf_rule_id string, severity int"


def logs(spark, *rows):
    names = [f.split()[0] for f in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, i if n == "event_id" else None) for n in names) for i, r in enumerate(rows)], LOG)


def test_two_row_features(spark):
    base = dict(src_ip="10.1.1.1", event_type="network_connect", proto="TCP")
    df = logs(spark, base | dict(dst_ip="203.0.113.1", dst_port=443, bytes_out=1000, ts_ms=1000000), base | dict(dst_ip="203.0.113.2", dst_port=80, bytes_out=500, ts_ms=1001000))
    r = features.entity_features(df).first().asDict()
    assert len(features.FEATURES) == 31
    want = dict(event_count=2, unique_dst_ips=2, unique_dst_ports=2, bytes_out_total=1500, bytes_in_total=0, byte_ratio=1500, mean_iat=1, std_iat=0, dst_ip_entropy=1, dst_port_entropy=1, rare_ip_fraction=1, new_ip_fraction=1, business_hour_fraction=0)
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_periodic_gaps(spark):
    rows = [dict(src_ip="a", event_type="network_connect", ts_ms=i * 1000 + (i % 2) * 100) for i in range(20)]
    r = features.entity_features(logs(spark, *rows)).first()
    gaps = [1100 if i % 2 == 0 else 900 for i in range(19)]
    assert r.mean_iat == pytest.approx(sum(gaps) / 19 / 1000)
    assert r.beacon_score == 0  # gaps alternate, so neighbours are opposed
    assert 0.85 < r.regularity < 0.95


def test_gaps_of_months(spark):
    month = 31 * 86_400_000
    r = features.entity_features(logs(spark, *[dict(src_ip="a", event_type="network_connect", ts_ms=i * i * month) for i in range(4)])).first()
    assert r.mean_iat == pytest.approx(3 * month / 1000) and r.std_iat == pytest.approx(2 * month / 1000)


def test_features_of_nothing(spark):
    assert features.entity_features(logs(spark)).count() == 0
    r = features.entity_features(logs(spark, dict(event_type="dns_query", ts_ms=5))).first()
    assert r.src_ip == "unknown" and r.event_count == 1 and r.mean_domain_len == 0


def test_features_read_rows_once_for_all_distinct_counts(spark):
    rows = [dict(src_ip="a", event_type="auth_failure", dst_ip=f"d{i % 3}", dst_port=i % 2, user=("u1", "u2", "", None)[i % 4], ts_ms=i) for i in range(8)]
    df = features.entity_features(logs(spark, *rows))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "user" not in " ".join(x for x in plan.splitlines() if "Join" in x)  # rows without a user met in one task
    r = df.first()
    assert (r.unique_dst_ips, r.unique_dst_ports, r.unique_users_attempted, r.new_user_auth, r.dst_port_entropy) == (3, 2, 2, 1, 1)
    for seen, new in ((["u1", "u2", "d0"], 0), (["u2"], 1)):
        r = features.entity_features(logs(spark, *rows), spark.createDataFrame([(u, 9) for u in seen], "ip string, n long")).first()
        assert r.new_user_auth == new and r.new_ip_fraction == pytest.approx(2 / 3 if "d0" in seen else 1)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("aabb",), ("",), (None,), ("bcdfg1",)], "t string")
    got = df.select(text.shannon_entropy(F.col("t")).alias("e"), text.consonant_vowel_ratio(F.col("t")).alias("cv"), text.max_consonant_run(F.col("t")).alias("run"), text.digit_fraction(F.col("t")).alias("d")).collect()
    assert (got[0].e, got[0].cv, got[0].run) == (1.0, 1.0, 2)
    assert got[1].e == 0 and got[2].e == 0
    assert math.isinf(got[3].cv) and got[3].run == 5 and got[3].d == pytest.approx(1 / 6)


def test_addresses(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("256.1.1.1",), ("8.8.8.8",), ("::1",), ("a.b",), ("u@h",), ("172.32.0.1",)], "t string")
    c = F.col("t")
    got = df.select(net.is_valid_ip(c), net.is_internal_ip(c), net.is_public_ip(c), net.entity_type(c), net.ip_in_subnet(c, "10.1.0.0/16"), net.normalize_ip(c)).collect()
    assert [tuple(r) for r in got] == [
        (True, True, False, "ip", True, "10.1.2.3"),
        (False, False, False, "ip", False, None),
        (True, False, True, "ip", False, "8.8.8.8"),
        (True, False, False, "ip", False, "::1"),
        (False, False, False, "domain", False, None),
        (False, False, False, "user", False, None),
        (True, False, True, "ip", False, "172.32.0.1"),
    ]


def scored(spark, edges, risks):
    e = spark.createDataFrame([(s, d, t, n, 0, 10, [443], ["TCP"]) for s, d, t, n in edges], "src string, dst string, edge_type string, event_count long, first_seen long, last_seen long, ports array<int>, protocols array<string>")
    n = spark.createDataFrame([(i, "ip", r) for i, r in risks.items()], "id string, entity_type string, risk_score double")
    return n, e


def test_lateral_chain(spark):
    n, e = scored(spark, [("10.0.0.1", "10.0.0.2", "auth", 1), ("10.0.0.2", "10.0.0.3", "network", 1), ("10.0.0.2", "10.0.0.1", "network", 1)], {"10.0.0.1": 0.9, "10.0.0.2": 0.2, "10.0.0.3": 0.1})
    got = chains.enrich(chains.lateral(n, e)).collect()
    assert [[x.entity for x in r.nodes] for r in got] == [["10.0.0.1", "10.0.0.2", "10.0.0.3"]]
    assert got[0].confidence == pytest.approx(0.81) and got[0].investigation_priority == 1


def test_scan_needs_ten_targets(spark):
    edges = [("10.0.0.1", f"10.0.1.{i}", "network", 1) for i in range(10)]
    risks = {"10.0.0.1": 0.6} | {f"10.0.1.{i}": 0.0 for i in range(10)}
    assert chains.scans(*scored(spark, edges, risks)).count() == 1
    assert chains.scans(*scored(spark, edges[:9], risks)).count() == 0


def test_rare_path_with_defaults(spark):
    edges = [("10.0.0.1", "10.0.0.2", "network", 1), ("10.0.0.2", "203.0.113.9", "network", 1), ("10.0.0.8", "10.0.0.9", "network", 100000)]
    n, e = scored(spark, edges, {"10.0.0.1": 0.9, "10.0.0.2": 0.9, "203.0.113.9": 0.9, "10.0.0.8": 0.0, "10.0.0.9": 0.0})
    out = chains.mine(n, e).filter("size(edges) = 2").collect()
    assert [[x.entity for x in r.nodes] for r in out] == [["10.0.0.1", "10.0.0.2", "203.0.113.9"]]
    assert out[0].chain_type == "data_exfil"


def test_rare_path_scores_follow_every_edge(spark):
    """A path of five edges, the last of them less rare than 25 others out of its node; nodes without paths; no rare edge."""
    names = "src string, dst string, rarity double"
    rows = [("g", "a", 9.0), ("a", "b", 9.0), ("b", "c", 9.0), ("c", "d", 9.0), ("d", "e", 9.0), ("e", "f", 8.0)] + [("e", f"x{i:02}", 8.5) for i in range(25)] + [("y", "z", 1.0)]
    got = {r.id: r.score for r in paths.path_scores(paths.rarest_paths(spark.createDataFrame(rows, names), percentile=0.0)).collect()}
    assert set(got) == {*"abcdefgyz"} | {f"x{i:02}" for i in range(25)}
    assert got["f"] == pytest.approx(sum((9 * n + 8) / (n + 1) for n in (1, 2, 3, 4)) / 4)
    assert got["g"] == got["y"] == got["z"] == 0
    got = {r.id: r.score for r in paths.path_scores(paths.rarest_paths(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], names))).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 1.5}


def all_paths(edges, seeds, least, most):
    """Every simple path by depth-first search: (nodes, indexes of its edges)."""
    out, stack = [], [((s,), ()) for s in seeds]
    while stack:
        nodes, used = stack.pop()
        if len(used) >= least:
            out.append((nodes, used))
        if len(used) < most:
            stack += [((*nodes, e[1]), (*used, i)) for i, e in enumerate(edges) if e[0] == nodes[-1] and e[1] not in nodes]
    return out


@pytest.mark.parametrize(("seed", "k"), [(0, 1), (1, None)])
def test_rarest_paths_equal_all_paths(spark, seed, k):
    """Random graphs with ties, loops and double edges; with one label a node at first the search must begin again."""
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.choice([rng.random() * 9, float(rng.randint(1, 4))])) for _ in range(20)]
    df = spark.createDataFrame(rows, "src string, dst string, rarity double")
    found = paths.rarest_paths(df, length=4, percentile=0.4, top=3, least=2.0, k=k)
    got = {r.id: [x.mean for x in r.paths] for r in found.collect()}
    best = {}
    for s, d, w in rows:
        if s != d:
            best[s, d] = max(best.get((s, d), 0.0), w)
    edges = [(s, d, w) for (s, d), w in best.items()]
    ends = {n: [e[2] for e in edges if n in e[:2]] for n in {x for e in edges for x in e[:2]}}
    every = [(sum(edges[i][2] for i in used) / len(used), nodes) for nodes, used in all_paths(edges, [n for n, w in ends.items() if len(w) >= 2 and max(w) > 2], 2, 4)]
    last = {}
    for mean, nodes in every:
        last[nodes[-1], len(nodes)] = max(last.get((nodes[-1], len(nodes)), 0.0), mean)
    cut = np.percentile(list(last.values()), 40)
    assert got == {n: pytest.approx(sorted((m for m, p in every if n in p and m >= cut - 1e-8), reverse=True)[:3]) for n in ends}
    some = max(got, key=lambda n: len(got[n]))
    assert [(r.place, r.mean) for r in paths.paths_of(found, some).collect()] == list(enumerate(got[some], 1))
    assert all(some in r.path for r in paths.paths_of(found, some).collect()) and paths.paths_of(found, "nobody").count() == 0


def test_rare_chain_paths_equal_all_paths(spark):
    """A beam of one path finds a low bar; the second search still finds every path of the first places."""
    rng = random.Random(5)
    edges = [(f"10.0.0.{rng.randrange(9)}", f"10.0.0.{rng.randrange(9)}", rng.choice(["network", "auth"]), rng.choice([1, 1, 2, 5, 40])) for _ in range(40)]
    edges = [e for i, e in enumerate(edges) if e[0] != e[1] and e[:3] not in [x[:3] for x in edges[:i]]]
    risks = {f"10.0.0.{i}": rng.choice([0.2, 0.6, 0.61, 0.9]) for i in range(9)}
    n, e = scored(spark, edges, risks)
    found = n.select("id", "risk_score")
    got = chains.rare_paths(n, chains.edge_frequency(e), found, n_seeds=5, cut=0.2, risk_cut=0.6, per_seed=4, beam=1)
    got = [(r.seed, r.place, tuple(r.path), tuple(x.edge_type for x in r.links), r.score) for r in got.collect()]
    want = []
    for s in sorted(risks, key=lambda i: (-risks[i], i))[:5]:
        own = []
        for nodes, used in all_paths(edges, [s], 2, 3):
            mean = sum(-math.log(edges[i][3] / max(x[3] for x in edges)) for i in used) / len(used)
            score = 0.7 * min(mean / 8, 1) + 0.3 * sum(risks[x] for x in nodes) / len(nodes)
            if score >= 0.2 and max(risks[x] for x in nodes) >= 0.6:
                own.append((-round(score, 9), nodes, tuple(edges[i][2] for i in used)))
        want += [(s, i + 1, p, t, pytest.approx(-score)) for i, (score, p, t) in enumerate(sorted(own)[:4])]
    assert sorted(got) == sorted(want, key=lambda x: x[:2])


def test_every_rule_of_chain_types(spark):
    """One path for each rule, in the order of the rules, and the default."""
    i, o = [f"10.0.0.{k}" for k in range(9)], ["203.0.113.1", "203.0.113.2"]
    cases = [
        ([i[0], i[1], i[2]], ["auth", "network"], 1, 0, 0, "lateral_movement"),
        ([i[0], o[0]], ["dns"], 1, 0, 0, "dga_activity"),
        (i[:6], ["network"] * 5, 1, 0, 0, "recon_scan"),
        ([i[0], o[0]], ["network"], 1, 8, 5, "recon_scan"),
        ([i[0], o[0]], ["network"], 8, 1, 1, "data_exfil"),
        ([i[0], i[1], o[0]], ["network", "network"], 1, 1, 1, "data_exfil"),
        ([i[0], o[0]], ["network"], 7, 7, 9, "c2_beacon"),
        ([o[0], o[1]], ["file"], 1, 0, 0, "c2_beacon"),
        ([i[0], i[1], i[2], i[3]], ["file", "process", "http"], 1, 0, 0, "supply_chain"),
        ([i[0], i[1], i[2]], ["network", "network"], 1, 0, 0, "lateral_movement"),
        ([i[0], i[1]], ["file"], 1, 0, 0, "suspicious_activity"),
    ]
    rows = [([(p, "x", 0.0) for p in path], [(a, b, t, n) for a, b, t in zip(path, path[1:], types, strict=False)], degree, ports, kind) for path, types, n, degree, ports, kind in cases]
    df = spark.createDataFrame(rows, f"nodes array<{chains.NODE}>, links array<{chains.EDGE}>, degree int, ports int, kind string")
    got = df.select("kind", chains.path_type(F.col("nodes"), F.col("links"), F.col("degree"), F.col("ports")).alias("got")).collect()
    assert [r.got for r in got] == [r.kind for r in got]


def test_paths_traced_from_both_ends(spark):
    """The first by name of the shortest, in the direction of the edges; plans don't grow with the hops allowed."""
    edges = [("a", "c"), ("a", "b"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("x", "y"), *[(f"h{k}", f"h{k + 1}") for k in range(7)]]
    df = spark.createDataFrame(edges, "src string, dst string")
    trace = lambda s, t, n=5: [r.node for r in graph.trace_path(df, s, t, n).orderBy("hop").collect()]
    assert trace("a", "f") == ["a", "b", "d", "e", "f"] and trace("f", "c") == ["f", "a", "c"] and trace("a", "a") == ["a"]
    assert trace("a", "y") == trace("y", "x") == trace("h0", "h7", 6) == trace("nobody", "a") == []
    assert trace("h0", "h7", 8) == [f"h{k}" for k in range(8)]
    size = lambda n: len(graph.trace_path(df, "h0", f"h{n}", n)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(7) <= size(2)


def test_report_export_and_node_link(spark):
    n, e = scored(spark, [("10.0.0.1", "10.0.0.2", "network", 1), ("10.0.0.2", "10.0.0.3", "auth", 2), ("10.0.0.9", "10.0.0.8", "dns", 1)], {"10.0.0.1": 0.95, "10.0.0.2": 0.8, "10.0.0.3": 0.1, "10.0.0.8": 0.0, "10.0.0.9": 0.0})
    near, links = graph.node_link(n, e, spark.createDataFrame([("10.0.0.1",)], "id string"), 1)
    assert sorted((r.id, r.hops) for r in near.collect()) == [("10.0.0.1", 0), ("10.0.0.2", 1)] and [(r.source, r.target, r.key) for r in links.collect()] == [("10.0.0.1", "10.0.0.2", "network")]
    assert [tuple(r) for r in risk.neighbors(e, "10.0.0.2").orderBy("neighbor").collect()] == [("10.0.0.2", "10.0.0.1", 1), ("10.0.0.2", "10.0.0.3", 1)]
    mined = chains.enrich(chain_rows(spark, *[(f"c{k:02}", "c2_beacon", "xy") for k in range(25)]).selectExpr("chain_id", "chain_type", "nodes", "double(right(chain_id, 2)) / 100 as total_risk_score", "0.5D as confidence", "array('x') as affected_assets"))
    out = risk.exported(e, mined, n.selectExpr("id", "risk_score as score"), n, None).first()
    assert (out.events, out.chains_found, out.high_risk, out.critical_risk, out.entities, out.f1) == (3, 25, 2, 1, 5, None)
    assert [c.chain_id for c in out.chains] == [f"c{k:02}" for k in range(24, 4, -1)]


def test_contained_chains_go(spark):
    def c(i, who, risk):
        return (i, "x", [(w, "source", 0.0) for w in who], [], risk, risk, 0, 0, list(who))

    df = spark.createDataFrame([c("1", "ab", 0.5), c("2", "ba", 0.9), c("3", "abc", 0.1), c("4", "d", 0.1)], f"chain_id string, chain_type string, nodes array<{chains.NODE}>, edges array<{chains.EDGE}>, total_risk_score double, confidence double, first_seen long, last_seen long, affected_assets array<string>")
    assert sorted(r.chain_id for r in chains.deduplicated(df).collect()) == ["3", "4"]


def chain_rows(spark, *rows):
    return spark.createDataFrame([(i, t, [(e, "source", 0.0) for e in who], 5000) for i, t, who in rows], f"chain_id string, chain_type string, nodes array<{chains.NODE}>, first_seen long")


def test_metrics(spark):
    truth = spark.createDataFrame([("a", "c2_beacon", ["x", "y", "z"], 1000)], "attack_id string, attack_type string, entities array<string>, start_time long")
    exact = evaluation.metrics(truth, chain_rows(spark, ("1", "c2_beacon", "xyz"))).first()
    assert (exact.precision, exact.recall, exact.f1) == (1, 1, pytest.approx(1))
    none = evaluation.metrics(truth, chain_rows(spark)).first()
    assert (none.recall, none.false_negatives) == (0, 1)
    other = evaluation.metrics(truth, chain_rows(spark, ("1", "c2_beacon", "qr"))).first()
    assert (other.precision, other.false_positives) == (0, 1)
    assert evaluation.metrics(truth, chain_rows(spark, ("1", "recon_scan", "xy")), 0.5).first().true_positives == 1
    assert evaluation.latency(truth, chain_rows(spark, ("1", "recon_scan", "xy")), 0.5).first()["mean"] == 4


def test_injectors(spark):
    logs, truth = evaluation.demo_logs(spark, 0)
    assert logs.filter(F.exists("tags", lambda t: t == "injected")).count() == 72 + 18 + 2 * 4 + 50 + 30 + 200 + 100 + 500
    assert truth.count() == 9 and evaluation.ransomware(spark, "a", "b", 0).count() == 210


def test_detectors_stay_in_range(spark):
    df = spark.createDataFrame([("a", float(i), float(i % 7)) for i in range(300)] + [("b", 1e6, 500.0)], "k string, x double, y double").withColumn("id", F.monotonically_increasing_id())
    for f in (detectors.isolation_forest, detectors.ecod, detectors.density, detectors.reconstruction):
        r = f(df, ["id"], ["x", "y"]).agg(F.min("score"), F.max("score"), F.count("*")).first()
        assert 0 <= r[0] <= r[1] <= 1 and r[2] == 301
    assert detectors.isolation_forest(df.limit(5), ["id"], ["x", "y"]).agg(F.max("score")).first()[0] == 0


def test_intel(spark):
    feed = intel.normalized(spark.createDataFrame([(None, "1.2.3.4"), (None, "Evil.com ")], "kind string, value string"))
    e = spark.createDataFrame([("1.2.3.4",), ("a.b.evil.com",), ("evil.com",), ("good.org",)], "entity string")
    assert {r.entity: r.score for r in intel.match(e, feed).collect()} == {"1.2.3.4": 0.9, "a.b.evil.com": 0.5, "evil.com": 0.8}


def test_risk_decays_and_adds(spark):
    old = spark.createDataFrame([("10.0.0.1", "ip", 0.8, 0.0, 0, [], 3, 0, [])], risk.PROFILE)
    new = spark.createDataFrame([("10.0.0.1", 0.5), ("10.0.0.2", 0.0)], "entity_id string, score double")
    c = spark.createDataFrame([("c", 0.6, ["T1"], [("10.0.0.1", "source", 0.0)])], f"chain_id string, total_risk_score double, mitre_techniques array<string>, nodes array<{chains.NODE}>")
    got = risk.updated(old, new, c, 86_400_000).collect()
    assert [(r.entity_id, r.score, r.evidence_count, r.tags) for r in got] == [("10.0.0.1", pytest.approx(0.4 + 0.5 + 0.3), 4, ["T1"])]
    assert risk.score_at(old, "nobody", 5).first().score == 0


def test_ranks_and_percentiles(spark):
    """Running sums over many partitions, ties, one value alone, no rows, nulls."""
    values = [1.5, 2.0, 2.0, -3.0, 7.25, 2.0, 9.0, 9.0, 0.0, None, *[float(i % 37) / 4 for i in range(400)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = ranks.percentiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    want = df.selectExpr("count(v) n", "percentile(v, 0.01) a", "percentile(v, 0.5) b", "percentile(v, 0.9) c", "percentile(v, 1.0) d").first()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]
    assert ranks.percentiles(df.limit(1), "v", {"a": 0.9}).first() == (1, 1.5)
    assert ranks.percentiles(df.limit(0), "v", {"a": 0.9}).first() == (0, None)
    known = sorted(v for v in values if v is not None)
    rows = df.filter("v is not null").select("id", F.col("v").alias("score"))
    for r in detectors.average_rank(rows, ["id"]).collect():
        v = values[r.id]
        assert abs(r.share - (sum(x < v for x in known) + (known.count(v) + 1) / 2) / len(known)) < 1e-12
    tails = detectors.left_tails(df.filter("v is not null").withColumn("w", -F.col("v")), ["id"], ["v", "w"])
    for r in tails.collect():
        v = r.value if r.feature == "v" else -r.value
        assert abs(r.p - sum(x <= v if r.feature == "v" else x >= v for x in known) / len(known)) < 1e-12


def test_labels_send_a_row_an_edge(spark):
    """The heaviest labels are those of all simple paths, and no path goes into the shuffle before the cut."""
    rng = random.Random(5)
    rows = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(60)})
    rows = [(a, b, float(rng.randrange(1, 5))) for a, b in rows if a != b]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    start = edges.select(F.col("src").alias("id")).distinct()
    out = paths.labels(edges, start, 3, 4)
    w, all_ = {(a, b): x for a, b, x in rows}, [[a] for a in {a for a, _, _ in rows}]
    for hops in range(1, 4):
        all_ = [p + [b] for p in all_ for (a, b) in w if a == p[-1] and b not in p]
        want = {}
        for p in all_:
            want.setdefault(p[-1], []).append(sum(w[e] for e in zip(p, p[1:])))
        for r in out.filter(F.col("hops") == hops).collect():
            top = sorted(want.get(r.id, []), reverse=True)
            sure = [x.w for x in r.found if r.lost is None or x.w >= r.lost]  # what was lost on the way may come before the others
            assert sure == top[: len(sure)] and (r.lost is not None or len(top) == len(r.found))
            assert all(x.w == sum(w[e] for e in zip(x.path, x.path[1:])) and x.path[-1] == r.id and len(set(x.path)) == hops + 1 for x in r.found)
    sent = spark.createDataFrame([("x", f"s{i}", [(float(i), 0)]) for i in range(50)], "id string, src string, own array<struct<w: double, place: int>>")
    assert {r.src for r in paths.heaviest_edges(sent, 3).collect()} == {"s49", "s48", "s47"}


def test_sequences_of_copied_hosts_cost_as_one(spark):
    """Hosts with the same events count each, but only one of them is followed; all equals a plain search."""
    rng = random.Random(6)
    own = {f"h{h}": [(f"e{rng.randrange(2)}", f"t{rng.randrange(3)}") for _ in range(6)] for h in range(4)}
    hosts = own | {f"{h}-{i}": x for h, x in own.items() for i in range(5)} | {"short": own["h0"][:3]}
    rows = [dict(src_ip=h, event_type=e, dst_ip=t, ts_ms=i) for h, x in hosts.items() for i, (e, t) in enumerate(x)]
    have = {}
    for h, x in hosts.items():
        grown = {((f"{e}|{t}",), i) for i, (e, t) in enumerate(x)}
        for _ in range(3):
            for q, _ in grown:
                have.setdefault(q, set()).add(h)
            grown = {((*q, "|".join(x[j])), j) for q, i in grown for j in range(i + 1, min(i + 4, len(x)))}
    want = {q: len(h) for q, h in have.items() if len(h) >= 2 and len({y.split("|")[1] for y in q}) >= 2}
    df = logs(spark, *rows)
    got = {tuple(r.sequence): r.freq for r in chains.sequences(df, length=3, rare=1.1).collect()}
    assert got == want and len(want) > 20
    events = df.select("src_ip", F.col("event_type").alias("item"), F.col("ts_ms").alias("at"))
    followed, _, n = chains.host_copies(events)
    assert followed.select("host").distinct().count() <= 5 and n.first().hosts == len(hosts)


def test_pipeline_scores_mine_no_chains(spark, sf_dir, monkeypatch):
    """What a query doesn't return isn't made."""
    monkeypatch.setattr(chains, "mine", None)
    monkeypatch.setattr(detectors, "detect", lambda f, keys, names, paths: f.select(*keys).crossJoin(paths.agg(F.max("score").alias("score"))))
    monkeypatch.setattr(paths, "rarest_paths", lambda rarity: rarity.select(F.col("src").alias("id"), F.array().cast("array<struct<mean: double, path: array<string>>>").alias("paths")))
    assert QUERIES["pipeline_scores"](spark, sf_dir).count() > 10


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_sequences_grow_in_tasks_and_write_nothing(spark, monkeypatch, most):
    """Nothing that grows is written; halves of what grows, more items than are broadcast and a host of one event give the same."""
    monkeypatch.setattr(chains, "frequent", lambda *a: sequences.frequent(*a, most=most))
    rng = random.Random(9)
    hosts = {f"h{h}": [(f"e{rng.randrange(2)}", f"t{rng.randrange(4)}") for _ in range(14)] for h in range(5)} | {"short": [("e0", "t0")]}
    rows = [dict(src_ip=h, event_type=e, dst_ip=t, ts_ms=i) for h, x in hosts.items() for i, (e, t) in enumerate(x)]
    have = {}
    for h, x in hosts.items():
        grown = {((f"{e}|{t}",), i) for i, (e, t) in enumerate(x)}
        for _ in range(5):
            for q, _ in grown:
                have.setdefault(q, set()).add(h)
            grown = {((*q, "|".join(x[j])), j) for q, i in grown for j in range(i + 1, min(i + 4, len(x)))}
    want = {q: len(h) for q, h in have.items() if len(h) >= 2 and len({y.split("|")[1] for y in q}) >= 2}
    made, written, saved = [], chains.written, chains.saved
    monkeypatch.setattr(chains, "written", lambda df: made.append(df.columns) or written(df))
    monkeypatch.setattr(chains, "saved", lambda df: made.append(df.columns) or saved(df))
    out = chains.sequences(logs(spark, *rows), length=5, rare=1.1)
    assert {tuple(r.sequence): r.freq for r in out.collect()} == want and len(want) > 100
    assert len(made) == 4 and not any(set(c) & {"sequence", "before"} for c in made)  # before: two tables for each length


def test_sequences_grow_by_halves(monkeypatch):
    """What a task holds is bounded, and the same is found."""
    rng = np.random.default_rng(3)
    words, n = rng.integers(0, 4, 60), 20  # three hosts of 20 events
    rows = []
    for h in range(3):
        own = words[h * n : h * n + n].tolist()
        rows += [(h, 1, i, own[i], s, own[i + 1 : i + 10]) for i in range(n) for s in set(own[i + 1 : i + 4])]
    rows.sort(key=lambda r: (r[3], r[4]))
    names = ["host", "hosts", "at", "word", "second", "next"]
    t = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    told = lambda: sorted((tuple(p), int(f)) for t_ in sequences.chunks(iter(t.to_batches(max_chunksize=7))) for paths, freq in sequences.mined(t_, 2, 4, 3) for p, f in zip(paths.tolist(), freq, strict=True))
    want = told()
    monkeypatch.setattr(sequences, "MOST", 10)
    monkeypatch.setattr(sequences, "CHUNK", 5)
    assert told() == want and len(want) == len(set(want)) > 100


def test_reconstruction_makes_its_rows_once(spark):
    """Scaler, components and errors all read the features, which are costly to make."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return float(x * x % 17)

    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("a"), F.udf(seen, "double")("id").alias("b"), F.lit(3.0).alias("c"))
    got = detectors.reconstruction(rows, ["k"], ["a", "b", "c"], components=1)
    assert got.count() == 200 and got.filter("score < 0 or score > 1 or isnan(score)").isEmpty()
    assert made.value < 3 * 200


def test_text_statistics_look_at_no_character_in_a_lambda(spark):
    df = spark.createDataFrame([("",), (None,), ("abab",), ("a\U0001f600\na\U0001f600",)], "t string")
    out = df.select(text.shannon_entropy(F.col("t")).alias("e"), text.ngram_frequency_score(F.col("t")).alias("b"), text.unique_char_ratio(F.col("t")).alias("u"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "slice(" not in plan and "replace(" not in plan
    got = {(round(r.e, 6), round(r.b, 6), r.u) for r in out.collect()}
    assert got == {(0.0, 0.0, 0.0), (1.0, 0.666667, 0.5), (1.521928, 0.75, 0.6)}


def test_the_hops_of_rare_paths_do_not_shuffle_the_graph(spark, monkeypatch):
    """A hop's few paths go to the edges, whatever the size of the graph."""
    edges = spark.sql("select concat('10.0.0.', id % 40) src, concat('10.0.0.', (id * 7 + 1) % 40) dst, 'network' edge_type, 1L event_count, id first_seen, id last_seen, 0.001 + id / 1000 freq from range(200)").filter("src <> dst")
    nodes = edges.selectExpr("explode(array(src, dst)) id").distinct().withColumn("risk_score", F.lit(0.9))
    plans, keep = [], chains.saved

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(chains, "saved", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert chains.rare_paths(nodes, edges, nodes, n_seeds=5, cut=0.1).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hops = [p for p in plans if "array_contains(path" in p and "row_number" not in p]
    assert hops and not any("SortMergeJoin [at" in p for p in hops)


def test_lateral_joins_risks_to_the_edges_of_pivots_only(spark):
    rows = [("10.0.0.1", "10.0.0.2", "auth"), ("10.0.0.2", "10.0.0.3", "network"), ("10.0.0.8", "10.0.0.9", "network"), ("10.0.0.2", "10.0.0.2", "dns")]
    edges = spark.createDataFrame([(a, b, t, 60, 0, 1) for a, b, t in rows], "src string, dst string, edge_type string, event_count long, first_seen long, last_seen long")
    nodes = edges.selectExpr("explode(array(src, dst)) id").distinct().withColumn("risk_score", F.lit(0.5))
    found = chains.lateral(nodes, edges).select("affected_assets").collect()
    assert [r.affected_assets for r in found] == [["10.0.0.1", "10.0.0.2", "10.0.0.3"]]
