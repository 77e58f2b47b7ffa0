"""DuckDB SQL for the named queries, over the same tables."""

from __future__ import annotations

from .sources.netlog import NETLOG_SQL

ORACLE_SQL: dict[str, str] = {}
W = f"WITH {NETLOG_SQL}"


def sql(name: str, *ctes: str, select: str) -> None:
    ORACLE_SQL[name] = ", ".join([W, *ctes]) + select


def num(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


def internal(ip: str) -> str:
    return f"regexp_matches({ip}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.|169\\.254\\.|127\\.|0\\.|22[4-9]\\.|2[3-5][0-9]\\.)')"


def entropy(s: str) -> str:
    """Of a string that is not empty."""
    return f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -((length({s}) - length(replace({s}, c, ''))) / length({s})) * log2((length({s}) - length(replace({s}, c, ''))) / length({s}))))"


def joined(x: str, name: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list({x}) FILTER ({x} IS NOT NULL))), ',') AS {name}"


sql("netlog_records", select=" SELECT event_id, ts_ms, src_ip, dst_ip, dst_port, proto, event_type, severity, user, domain, dns_rcode, waf_rule_id, bytes_out, bytes_in FROM netlog")

VOLUME_CTE = """vol AS (
  SELECT src_ip, event_type, CAST(count(*) AS DOUBLE) AS event_count, count(*) / 3600.0 AS events_per_sec, CAST(count(DISTINCT dst_ip) AS DOUBLE) AS unique_dst_ips,
    CAST(count(DISTINCT dst_port) AS DOUBLE) AS unique_dst_ports, CAST(count(DISTINCT domain) AS DOUBLE) AS unique_domains, CAST(sum(bytes_out) AS DOUBLE) AS bytes_out_total,
    CAST(sum(bytes_in) AS DOUBLE) AS bytes_in_total, CAST(sum(bytes_out) AS DOUBLE) / (CAST(sum(bytes_in) AS DOUBLE) + 1) AS byte_ratio
  FROM netlog GROUP BY ALL)"""
TAILS_CTE = """long AS (UNPIVOT vol ON event_count, events_per_sec, unique_dst_ips, unique_dst_ports, unique_domains, bytes_out_total, bytes_in_total, byte_ratio INTO NAME feature VALUE value),
tails AS (SELECT *, cume_dist() OVER (PARTITION BY feature ORDER BY value) AS p FROM long)"""
ECOD_CTE = """raw AS (SELECT src_ip, event_type, round(sum(-ln(greatest(least(p, 1 - p), 1e-10))), {d}) AS raw FROM tails GROUP BY ALL),
ecod AS (SELECT src_ip, event_type, CASE WHEN max(raw) OVER () - min(raw) OVER () < 1e-10 THEN 0.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END AS score FROM raw)"""

sql("top_risky_addresses", VOLUME_CTE, TAILS_CTE, ECOD_CTE.format(d=9), select=f" SELECT src_ip AS id, {num('max(score)', 'score')} FROM ecod GROUP BY 1 ORDER BY max(score) DESC, src_ip LIMIT 30")
sql("ecod_scores", VOLUME_CTE, TAILS_CTE, ECOD_CTE.format(d=9), select=f" SELECT src_ip, event_type, {num('score', 'score')} FROM ecod")
sql(
    "ensemble_ranks", VOLUME_CTE, TAILS_CTE, ECOD_CTE.format(d=6),
    "a AS (SELECT src_ip, event_type, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS r FROM ecod)",
    "b AS (SELECT src_ip, event_type, (rank() OVER (ORDER BY bytes_out_total) + (count(*) OVER (PARTITION BY bytes_out_total) - 1) / 2) / count(*) OVER () AS r FROM vol)",
    select=f" SELECT src_ip, event_type, {num('(0.9 * a.r + b.r) / 1.9', 'score')} FROM a JOIN b USING (src_ip, event_type)",
)
MINMAX = "mm AS (SELECT src_ip, event_type, (bytes_out_total - min(bytes_out_total) OVER ()) / (max(bytes_out_total) OVER () - min(bytes_out_total) OVER ()) AS score FROM vol)"
sql("score_alerts", VOLUME_CTE, MINMAX, select=f" SELECT src_ip || ':' || event_type AS id, {num('score', 'score')}, CASE WHEN score > 0.8 THEN 'critical' ELSE 'investigation' END AS tier FROM mm WHERE score >= 0.5")
sql("score_histogram", VOLUME_CTE, MINMAX, select=" SELECT CAST(least(29, floor(score * 30)) AS INTEGER) AS bin, count(*) AS n FROM mm GROUP BY 1")
sql("score_drift", VOLUME_CTE, MINMAX, select=" SELECT count(*) AS entities, count(*) FILTER (score > 0.5) AS above_50, count(*) FILTER (score > 0.7) AS above_70, count(*) FILTER (score > 0.9) AS above_90, count(*) FILTER (score > 0.5) > 0.3 * count(*) AS drift FROM mm")
sql(
    "gpd_thresholds", VOLUME_CTE, MINMAX,
    "base AS (SELECT count(*) AS n, quantile_cont(score, 0.9) AS u FROM mm)",
    "mo AS (SELECT count(*) AS k, avg(score - u) AS m, greatest(var_pop(score - u), 1e-12) AS v FROM mm, base WHERE score > u)",
    "par AS (SELECT *, least(1.0, greatest(-0.5, 0.5 * (1 - m * m / v))) AS xi FROM mo, base)",
    "lev AS (SELECT n, k, u, CASE WHEN abs(xi) < 1e-6 THEN -0.5 * m * (1 + xi) * ln(0.1) ELSE 0.5 * m * (1 + xi) / xi * (0.1 ** (-xi) - 1) END AS y1, CASE WHEN abs(xi) < 1e-6 THEN -0.5 * m * (1 + xi) * ln(0.01) ELSE 0.5 * m * (1 + xi) / xi * (0.01 ** (-xi) - 1) END AS y2 FROM par)",
    "t AS (SELECT CASE WHEN n >= 100 AND k > 0 THEN least(1.0, u + y1) ELSE 0.95 END AS t1, CASE WHEN n >= 100 AND k > 0 THEN least(1.0, u + y2) ELSE 0.95 END AS t2 FROM lev)",
    select=f" SELECT {num('t1', 'threshold')}, {num('greatest(t1, 0.70)', 'investigation')}, {num('greatest(t2, 0.85)', 'critical')} FROM t",
)
sql(
    "clipped_scores", VOLUME_CTE, "e AS (SELECT quantile_cont(bytes_out_total, 0.01) AS lo, quantile_cont(bytes_out_total, 0.99) AS hi FROM vol)",
    select=f" SELECT src_ip, event_type, {num('least(1.0, greatest(0.0, (bytes_out_total - lo) / (hi - lo)))', 'scaled')} FROM vol, e",
)
sql(
    "explained_scores", VOLUME_CTE, TAILS_CTE,
    "o AS (SELECT src_ip, event_type, feature, value, least(p, 1 - p) AS tail, row_number() OVER (PARTITION BY src_ip, event_type ORDER BY least(p, 1 - p), feature) AS place FROM tails)",
    select=f" SELECT src_ip, event_type, feature, {num('value', 'value')}, {num('tail', 'tail')}, CAST(place AS INTEGER) AS place FROM o WHERE place <= 3",
)

sql("baseline_counts", select=" SELECT ip, count(*) AS n FROM (SELECT src_ip AS ip FROM netlog UNION ALL SELECT dst_ip FROM netlog) GROUP BY ip")
KNOWN = "known AS (SELECT ip, count(*) AS n FROM (SELECT src_ip AS ip FROM early UNION ALL SELECT dst_ip FROM early) GROUP BY ip)"
EARLY = "early AS (SELECT src_ip, dst_ip FROM netlog, (SELECT min(ts_ms) AS low, max(ts_ms) AS high FROM netlog) WHERE ts_ms < low + (high - low) / 10)"
sql("baseline_novelty", EARLY, KNOWN, select=f" SELECT src_ip, event_type, {num('avg(CASE WHEN coalesce(n, 0) < 5 THEN 1.0 ELSE 0.0 END)', 'rare_ip_fraction')}, {num('avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END)', 'new_ip_fraction')} FROM (SELECT DISTINCT src_ip, event_type, dst_ip FROM netlog) t LEFT JOIN known ON dst_ip = ip GROUP BY 1, 2")

BODY = "regexp_replace(domain, '\\.[^.]*$', '')"
CV = f"(CASE WHEN length(regexp_replace(lower({BODY}), '[^aeiou]', '', 'g')) > 0 THEN length(regexp_replace(lower({BODY}), '[^a-z]|[aeiou]', '', 'g')) / length(regexp_replace(lower({BODY}), '[^aeiou]', '', 'g')) WHEN length(regexp_replace(lower({BODY}), '[^a-z]|[aeiou]', '', 'g')) > 0 THEN 1e9 ELSE 0 END)"
AGG = f"""agg AS (
  SELECT src_ip, event_type, avg(CASE WHEN hour(timestamp) BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END) AS business_hour_fraction,
    coalesce(avg(length(domain)), 0.0) AS mean_domain_len, coalesce(avg({entropy('domain')}), 0.0) AS mean_domain_entropy,
    coalesce(sum(CASE WHEN domain IS NOT NULL AND dns_rcode = 'NXDOMAIN' THEN 1.0 ELSE 0.0 END) / nullif(count(domain), 0), 0.0) AS nxdomain_fraction,
    coalesce(sum(CASE WHEN domain IS NOT NULL AND {CV} > 4 THEN 1.0 ELSE 0.0 END) / nullif(count(domain), 0), 0.0) AS high_cv_domain_fraction,
    CASE WHEN event_type = 'auth_failure' THEN 1.0 ELSE 0.0 END AS auth_failure_ratio, CAST(count(DISTINCT user) AS DOUBLE) AS unique_users_attempted,
    CASE WHEN event_type LIKE 'auth%' THEN avg(CASE WHEN hour(timestamp) NOT BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS off_hours_auth_fraction,
    max(CASE WHEN user IS NOT NULL THEN 1.0 ELSE 0.0 END) AS new_user_auth, max(CASE WHEN event_type = 'waf_alert' THEN 1.0 ELSE 0.0 END) AS waf_alert_density,
    CAST(count(DISTINCT waf_rule_id) AS DOUBLE) AS unique_waf_rules, CAST(coalesce(max(severity) FILTER (event_type = 'waf_alert'), 0) AS DOUBLE) AS max_waf_severity
  FROM netlog GROUP BY src_ip, event_type)"""
GAPS = "gaps AS (SELECT *, lag(gap) OVER (PARTITION BY src_ip, event_type ORDER BY ts_ms, event_id) AS bef FROM (SELECT src_ip, event_type, ts_ms, event_id, ts_ms - lag(ts_ms) OVER (PARTITION BY src_ip, event_type ORDER BY ts_ms, event_id) AS gap FROM netlog))"
TIMING = """t0 AS (
  SELECT src_ip, event_type, count(*) AS n, count(*) FILTER (gap > 0) AS m, CAST(sum(gap) FILTER (gap > 0) AS DOUBLE) AS s, CAST(sum(CAST(gap AS HUGEINT) * gap) FILTER (gap > 0) AS DOUBLE) AS ss,
    min(gap) FILTER (gap > 0) AS low, max(gap) FILTER (gap > 0) AS high, count(gap) AS k, CAST(sum(gap) AS DOUBLE) AS t, CAST(sum(CAST(gap AS HUGEINT) * gap) AS DOUBLE) AS tt,
    CAST(sum(CAST(gap AS HUGEINT) * bef) AS DOUBLE) AS lagged, CAST(sum(gap + bef) AS DOUBLE) AS pair_sum, count(bef) AS pairs
  FROM gaps GROUP BY 1, 2),
t1 AS (SELECT *, t / k AS mu, greatest(0.0, tt - t * (t / k)) AS vr, lagged - t / k * pair_sum + pairs * (t / k) * (t / k) AS cov FROM t0),
timing AS (
  SELECT src_ip, event_type, m, low, high, coalesce(s / m / 1000, 0.0) AS mean_iat, coalesce(CASE WHEN m >= 2 THEN sqrt(greatest(0.0, (ss - s * s / m) / (m - 1))) ELSE 0.0 END / 1000, 0.0) AS std_iat,
    CASE WHEN mu > 0 THEN 1 - sqrt(vr / k) / mu ELSE 0.0 END AS regularity,
    CASE WHEN n >= 10 AND mu > 0 THEN greatest(0.0, cov / (vr + 1e-4) * (1 - sqrt(vr / k) / mu)) ELSE 0.0 END AS beacon_score
  FROM t1)"""
BINS = """bins AS (
  SELECT src_ip, event_type, floor((gap - low) / ((high - low) / least(10, m // 2))) AS bin, count(*) AS n
  FROM gaps JOIN timing USING (src_ip, event_type) WHERE m >= 5 AND high > low AND gap > 0 AND gap < high GROUP BY 1, 2, 3),
iat AS (SELECT src_ip, event_type, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS iat_entropy FROM bins GROUP BY 1, 2)"""
ENT = """ipe AS (SELECT src_ip, event_type, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS dst_ip_entropy FROM (SELECT src_ip, event_type, dst_ip, count(*) AS n FROM netlog GROUP BY ALL) GROUP BY 1, 2),
pe AS (SELECT src_ip, event_type, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS dst_port_entropy FROM (SELECT src_ip, event_type, dst_port, count(*) AS n FROM netlog GROUP BY ALL) GROUP BY 1, 2)"""
ALL = "event_count events_per_sec unique_dst_ips unique_dst_ports unique_domains bytes_out_total bytes_in_total byte_ratio mean_iat std_iat iat_entropy business_hour_fraction beacon_score dst_ip_entropy dst_port_entropy mean_domain_len mean_domain_entropy nxdomain_fraction high_cv_domain_fraction auth_failure_ratio unique_users_attempted off_hours_auth_fraction new_user_auth waf_alert_density unique_waf_rules max_waf_severity regularity".split()
sql(
    "entity_features", VOLUME_CTE, AGG, GAPS, TIMING, BINS, ENT,
    select=" SELECT src_ip, event_type, " + ", ".join(num(f"coalesce({f}, 0.0)", f, 2 if f in ("mean_iat", "std_iat") else 5) for f in ALL)
    + f", {num('std_iat / greatest(mean_iat, 1e-6)', 'burstiness', 5)}, CAST(1.0 AS DOUBLE) AS rare_ip_fraction, CAST(1.0 AS DOUBLE) AS new_ip_fraction, CAST(0.0 AS DOUBLE) AS geo_diversity, CAST(0.0 AS DOUBLE) AS mean_dns_ttl"
    + " FROM vol JOIN agg USING (src_ip, event_type) JOIN timing USING (src_ip, event_type) LEFT JOIN iat USING (src_ip, event_type) LEFT JOIN ipe USING (src_ip, event_type) LEFT JOIN pe USING (src_ip, event_type)",
)
sql(
    "windowed_volume",
    select=" SELECT src_ip, event_type, epoch_ms(date_trunc('day', timestamp)) AS start_ms, "
    + ", ".join(num(x, n) for n, x in {
        "event_count": "count(*)", "events_per_sec": "count(*) / 86400.0", "bytes_out_total": "sum(bytes_out)", "bytes_in_total": "sum(bytes_in)", "unique_dst_ips": "count(DISTINCT dst_ip)",
        "unique_dst_ports": "count(DISTINCT dst_port)", "unique_domains": "count(DISTINCT domain)", "waf_alert_density": "CASE WHEN event_type = 'waf_alert' THEN 1 ELSE 0 END",
        "unique_waf_rules": "count(DISTINCT waf_rule_id) FILTER (event_type = 'waf_alert')", "max_waf_severity": "coalesce(max(severity) FILTER (event_type = 'waf_alert'), 0)",
    }.items())
    + " FROM netlog GROUP BY src_ip, event_type, date_trunc('day', timestamp)",
)

NODES = """ent AS (
  SELECT DISTINCT event_id, ts_ms, id, kind FROM (
    SELECT event_id, ts_ms, src_ip AS id, 'ip' AS kind FROM netlog UNION ALL SELECT event_id, ts_ms, dst_ip, 'ip' FROM netlog
    UNION ALL SELECT event_id, ts_ms, user, 'user' FROM netlog UNION ALL SELECT event_id, ts_ms, domain, 'domain' FROM netlog) WHERE id IS NOT NULL),
nodes0 AS (SELECT id, min(kind) AS entity_type, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) AS total_events FROM ent GROUP BY id),
nodes AS (SELECT *, round(total_events / max(total_events) OVER (), 6) AS risk_score FROM nodes0)"""
EDGES = f"""edges0 AS (
  SELECT src_ip AS src, dst_ip AS dst, CASE WHEN event_type LIKE 'auth%' THEN 'auth' WHEN event_type = 'dns_query' THEN 'dns' WHEN event_type = 'waf_alert' THEN 'http' ELSE 'network' END AS edge_type,
    count(*) AS event_count, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, {joined('dst_port', 'ports')}, {joined('proto', 'protocols')}, bool_or(dst_port NOT IN (80, 443)) AS odd
  FROM netlog GROUP BY 1, 2, 3),
edges AS (SELECT *, event_count / max(event_count) OVER () AS freq FROM edges0)"""
DEG = "deg AS (SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id)"
sql("graph_nodes", NODES, select=" SELECT id, entity_type, first_seen, last_seen, total_events FROM nodes")
for name in ("graph_edges", "state_merge"):
    sql(name, EDGES, select=" SELECT src, dst, edge_type, event_count, first_seen, last_seen, ports, protocols FROM edges")
sql("graph_scored_nodes", NODES, select=f" SELECT id, {num('risk_score', 'risk_score')}, risk_score > 0.7 AS is_anomalous FROM nodes")
sql("graph_edge_risk", NODES, EDGES, select=f" SELECT src, dst, edge_type, {num('greatest(a.risk_score, b.risk_score)', 'risk_score')}, {num('freq', 'freq')} FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")
sql("graph_degrees", EDGES, DEG, select=" SELECT id, out_degree, in_degree, out_degree + in_degree AS degree, coalesce(n, 0) AS out_neighbors FROM deg LEFT JOIN (SELECT src AS id, count(DISTINCT dst) AS n FROM edges GROUP BY 1) USING (id)")
sql("graph_risk_subgraph", NODES, EDGES, select=" SELECT src, dst, edge_type, event_count FROM edges WHERE src IN (SELECT id FROM nodes WHERE risk_score >= 0.5) AND dst IN (SELECT id FROM nodes WHERE risk_score >= 0.5)")
sql("graph_touching", NODES, EDGES, select=" SELECT src, dst, edge_type, event_count FROM edges WHERE src IN (SELECT id FROM nodes WHERE risk_score >= 0.95) OR dst IN (SELECT id FROM nodes WHERE risk_score >= 0.95)")
sql(
    "graph_neighborhood", EDGES, "p AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "h0 AS (SELECT '203.0.113.77' AS id)", "h1 AS (SELECT DISTINCT dst AS id FROM p WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0))",
    "h2 AS (SELECT DISTINCT dst AS id FROM p WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h1))",
    select=" SELECT id, 0 AS hops FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2",
)
ORACLE_SQL["graph_trace_path"] = f"""WITH RECURSIVE {NETLOG_SQL}, {EDGES}, pairs AS (SELECT DISTINCT src, dst FROM edges ),
walk AS (SELECT '10.1.0.3' AS cur, ['10.1.0.3'] AS path UNION ALL SELECT * FROM (SELECT dst AS cur, min(list_append(path, dst)) AS path FROM walk JOIN pairs ON cur = src WHERE NOT list_contains(path, dst) AND len(path) <= 5 AND cur <> '203.0.113.88' GROUP BY dst)),
best AS (SELECT path FROM walk WHERE cur = '203.0.113.88' ORDER BY len(path), path LIMIT 1)
SELECT CAST(i - 1 AS INTEGER) AS hop, path[i] AS node FROM best, range(1, 7) r(i) WHERE i <= len(path)"""
RAR = "rar AS (SELECT src_ip AS src, dst_ip AS dst, event_type, count(*) AS n FROM netlog GROUP BY ALL)"
sql("graph_edge_rarity", RAR, select=f" SELECT src, dst, event_type, n, {num('n / sum(n) OVER ()', 'probability')}, {num('-ln(n / sum(n) OVER ())', 'rarity')} FROM rar")
sql("graph_peers", EDGES, "u AS (SELECT src AS id, 'out' AS direction, dst AS peer, event_count FROM edges UNION ALL SELECT dst, 'in', src, event_count FROM edges)", "s AS (SELECT id, direction, peer, CAST(sum(event_count) AS BIGINT) AS events FROM u GROUP BY ALL)", select=" SELECT id, direction, peer, events, CAST(row_number() OVER (PARTITION BY id ORDER BY events DESC, direction, peer) AS INTEGER) AS place FROM s QUALIFY place <= 5")

SEEDS = """seeds AS (
  SELECT id, risk_score FROM nodes WHERE risk_score >= 0.8
  UNION SELECT id, risk_score FROM nodes WHERE id IN (SELECT src FROM edges WHERE freq < 0.3) AND id IN (SELECT id FROM deg WHERE out_degree + in_degree BETWEEN 2 AND 500))"""
RISKS = "er AS (SELECT e.*, a.risk_score AS sr, b.risk_score AS dr FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"
sql("chain_seeds", NODES, EDGES, DEG, SEEDS, select=f" SELECT id, {num('risk_score', 'risk_score')} FROM seeds")
sql(
    "chain_outbound", NODES, EDGES, DEG, SEEDS, RISKS, "best AS (SELECT id, risk_score FROM seeds ORDER BY risk_score DESC, id LIMIT 50)",
    select=f" SELECT CASE WHEN odd THEN 'data_exfil' ELSE 'c2_beacon' END AS chain_type, src || ':source,' || dst || ':target' AS nodes, src || '>' || edge_type || '>' || dst AS edges, {num('greatest(sr, 0.5)', 'total_risk_score')}, first_seen, last_seen, src || ',' || dst AS affected_assets FROM er WHERE edge_type IN ('network', 'dns') AND {internal('src')} AND NOT {internal('dst')} AND src IN (SELECT id FROM best WHERE risk_score >= 0.6)",
)
sql(
    "chain_risky_edges", NODES, EDGES, DEG, SEEDS, RISKS, "best AS (SELECT id, row_number() OVER (ORDER BY risk_score DESC, id) AS r FROM (SELECT * FROM seeds ORDER BY risk_score DESC, id LIMIT 20))",
    select=f" SELECT 'suspicious_activity' AS chain_type, src || ':source,' || dst || ':target' AS nodes, src || '>' || edge_type || '>' || dst AS edges, {num('greatest(sr, dr)', 'total_risk_score')}, first_seen, last_seen, src || ',' || dst AS affected_assets FROM er JOIN best a ON src = a.id JOIN best b ON dst = b.id WHERE a.r < b.r AND freq < 0.9 AND greatest(sr, dr) >= 0.8",
)
SCANS = """scan0 AS (SELECT src, dst, min(first_seen) AS f, max(last_seen) AS l, max(sr) AS risk FROM er WHERE edge_type IN ('network', 'dns') AND sr >= 0.9 GROUP BY 1, 2),
scan AS (SELECT src, count(*) AS n, max(risk) AS risk, min(f) AS f, max(l) AS l, array_to_string(list_sort(list(dst))[1:5], ',') AS shown FROM scan0 GROUP BY src HAVING count(*) >= 10)"""
sql("chain_scans", NODES, EDGES, RISKS, SCANS, select=f" SELECT 'recon_scan' AS chain_type, src || ':source' AS nodes, '' AS edges, {num('risk', 'total_risk_score')}, f AS first_seen, l AS last_seen, src || ',' || shown AS affected_assets FROM scan")
LATERAL = f"""two AS (
  SELECT a.src AS s, a.dst AS p, b.dst AS t, b.edge_type AS bt, greatest(a.sr, a.dr, b.dr) AS risk, least(a.first_seen, b.first_seen) AS f, greatest(a.last_seen, b.last_seen) AS l
  FROM er a JOIN er b ON a.dst = b.src WHERE a.edge_type = 'auth' AND b.edge_type IN ('network', 'dns') AND {internal('a.dst')} AND a.src <> a.dst AND b.dst <> a.src AND b.dst <> b.src
    AND ((a.first_seen // 3600000) % 24 >= 20 OR (a.first_seen // 3600000) % 24 < 6 OR greatest(a.sr, a.dr, b.dr) > 0.5 OR a.event_count > 50 OR b.event_count > 50 OR greatest(a.sr, a.dr, b.dr) >= 0.9)
  ORDER BY risk DESC, s, p, t, bt LIMIT 50)"""
LATERAL_OUT = f"'lateral_movement' AS chain_type, s || ':source,' || p || ':pivot,' || t || ':target' AS nodes, s || '>auth>' || p || ',' || p || '>' || bt || '>' || t AS edges, {num('risk', 'total_risk_score')}, f AS first_seen, l AS last_seen, s || ',' || p || ',' || t AS affected_assets"
sql("chain_lateral", NODES, EDGES, RISKS, LATERAL, select=f" SELECT {LATERAL_OUT} FROM two")
PATHS = """rw AS (
  SELECT src, dst, max(round(-ln(n / total), 9)) AS w FROM (
    SELECT src_ip AS src, dst_ip AS dst, count(*) AS n, sum(count(*)) OVER () AS total FROM netlog WHERE src_ip <> '' AND dst_ip <> '' GROUP BY src_ip, dst_ip, event_type)
  WHERE src <> dst GROUP BY src, dst),
rn AS (SELECT id, count(*) AS d, max(w) AS w FROM (SELECT src AS id, w FROM rw UNION ALL SELECT dst, w FROM rw) GROUP BY id),
p1 AS (SELECT src AS a, dst AS b, rw.w FROM rn JOIN rw ON id = src WHERE d BETWEEN 2 AND 1000 AND rn.w > 5),
p2 AS (SELECT a, b, dst AS c, p1.w + rw.w AS w FROM p1 JOIN rw ON src = b WHERE dst <> a),
p3 AS (SELECT a, b, c, dst AS d, p2.w + rw.w AS w FROM p2 JOIN rw ON src = c WHERE dst <> a AND dst <> b),
pm AS (SELECT a, b, c, NULL AS d, round(w / 2, 9) AS mean FROM p2 UNION ALL SELECT a, b, c, d, round(w / 3, 9) FROM p3),
cut AS (SELECT quantile_cont(mean, 0.25) AS cut FROM (SELECT max(mean) AS mean FROM pm GROUP BY coalesce(d, c), d IS NULL)),
pk AS (SELECT pm.* FROM pm, cut WHERE mean >= cut),
pn AS (
  SELECT a AS id, max(mean, 10) AS m FROM pk GROUP BY a UNION ALL SELECT b, max(mean, 10) FROM pk GROUP BY b
  UNION ALL SELECT c, max(mean, 10) FROM pk GROUP BY c UNION ALL SELECT d, max(mean, 10) FROM pk WHERE d IS NOT NULL GROUP BY d),
pt AS (SELECT id, list_sort(flatten(list(m)), 'DESC')[1:10] AS m FROM pn GROUP BY id)"""
sql(
    "graph_rare_path_means", PATHS,
    select=f" SELECT id, coalesce(len(m), 0)::INTEGER AS n, coalesce(array_to_string(list_transform(m, lambda x: printf('%.4f', x)), ';'), '') AS means, {num('coalesce(list_avg(m), 0)', 'score', 5)} FROM rn LEFT JOIN pt USING (id)",
)
sql(
    "graph_paths_of_address", PATHS,
    "ev AS (SELECT id FROM (SELECT event_id, src_ip AS id FROM netlog UNION SELECT event_id, dst_ip FROM netlog) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)",
    "ps AS (SELECT id, unnest(m) AS mean, generate_subscripts(m, 1) AS place FROM pt JOIN ev USING (id))",
    select=f" SELECT id, place::INTEGER AS place, {num('mean', 'mean', 5)} FROM ps",
)
HOP = """h{n} AS (
  SELECT h.seed, e.dst AS cur, list_append(h.path, e.dst) AS path, list_append(h.types, e.edge_type) AS types, h.risk + e.dr AS risk, greatest(h.most, e.dr) AS most, round(h.rarity + e.w, 9) AS rarity
  FROM h{m} h JOIN es e ON h.cur = e.src WHERE NOT list_contains(h.path, e.dst))"""
RARE = ", ".join([
    "es AS (SELECT src, dst, edge_type, dr, round(-ln(greatest(freq, 1e-6)), 9) AS w FROM er)",
    "h0 AS (SELECT id AS seed, id AS cur, [id] AS path, CAST([] AS VARCHAR[]) AS types, risk_score AS risk, risk_score AS most, CAST(0.0 AS DOUBLE) AS rarity FROM seeds ORDER BY risk_score DESC, id LIMIT 40)",
    HOP.format(n=1, m=0), HOP.format(n=2, m=1), HOP.format(n=3, m=2),
    "sc AS (SELECT seed, path, types, rarity, round(0.7 * least(rarity / k / 8, 1.0) + 0.3 * risk / (k + 1), 9) AS score, most AS max_risk FROM (SELECT *, 2 AS k FROM h2 UNION ALL SELECT *, 3 FROM h3))",
    "pl AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, path, types) AS place FROM sc WHERE score >= 0.30 AND max_risk >= 0.5 QUALIFY place <= 10)",
])
sql(
    "chain_rare_paths", NODES, EDGES, DEG, SEEDS, RISKS, RARE,
    select=f" SELECT seed, array_to_string(path, ',') AS path, {num('rarity', 'rarity')}, {num('score', 'score')}, {num('max_risk', 'max_risk')}, CAST(place AS INTEGER) AS place FROM pl",
)
sql("mitre_coverage", NODES, EDGES, RISKS, SCANS, select=" SELECT t AS technique, (SELECT count(*) FROM scan) AS chains FROM (VALUES ('T1046'), ('T1595')) v(t) WHERE (SELECT count(*) FROM scan) > 0")

DOM = "dom AS (SELECT DISTINCT domain, split_part(domain, '.', 1) AS b FROM netlog WHERE domain IS NOT NULL)"
FEAT = f"""feat AS (
  SELECT domain, CAST(length(b) AS DOUBLE) AS length, {entropy('b')} AS entropy,
    CASE WHEN length(regexp_replace(b, '[^aeiou]', '', 'g')) > 0 THEN least(100.0, length(regexp_replace(b, '[aeiou]', '', 'g')) / length(regexp_replace(b, '[^aeiou]', '', 'g'))) ELSE 100.0 END AS cv_ratio,
    CAST(0.0 AS DOUBLE) AS digits, CAST(list_max(list_transform(string_split(regexp_replace(b, '[aeiou]', '-', 'g'), '-'), lambda x: length(x))) AS DOUBLE) AS consonant_run,
    len(list_distinct(string_split(b, ''))) / length(b) AS unique_chars, CAST(3 AS DOUBLE) AS tld_length FROM dom)"""
POINTS = "(CASE WHEN entropy > 3 THEN 3 ELSE 0 END + CASE WHEN cv_ratio > 4 THEN 3 ELSE 0 END + CASE WHEN consonant_run > 4 THEN 2 ELSE 0 END) / 10"
sql("dga_domain_features", DOM, FEAT, select=" SELECT domain, " + ", ".join(num(f, f) for f in ("length", "entropy", "cv_ratio", "digits", "consonant_run", "unique_chars", "tld_length")) + " FROM feat")
sql("dga_domain_scores", DOM, FEAT, select=f" SELECT domain, {num(POINTS, 'score')}, {POINTS} > 0.7 AS is_dga FROM feat")
sql("dga_host_ratio", DOM, FEAT, select=f" SELECT src_ip, count(*) FILTER ({POINTS} >= 0.3) AS dga_count, count(*) AS total, {num(f'count(*) FILTER ({POINTS} >= 0.3) / count(*)', 'ratio')} FROM (SELECT DISTINCT src_ip, domain FROM netlog WHERE domain IS NOT NULL) JOIN feat USING (domain) GROUP BY src_ip")

ORACLE_SQL["text_statistics"] = f"""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS t FROM documents)
SELECT doc_id, {num("CASE WHEN length(t) = 0 THEN 0.0 ELSE " + entropy("t") + " END", 'entropy')}, {num("CASE WHEN length(t) = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t) END", 'digits')},
  CAST(coalesce(list_max(list_transform(string_split(regexp_replace(t, '[^b-df-hj-np-tv-z]', '-', 'g'), '-'), lambda x: length(x))), 0) AS INTEGER) AS run,
  {num("CASE WHEN length(t) < 2 THEN 0.0 ELSE len(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) / (length(t) - 1) END", 'bigrams')},
  {num("CASE WHEN length(t) = 0 THEN 0.0 ELSE len(list_distinct(string_split(t, ''))) / length(t) END", 'unique_chars')} FROM t"""
ORACLE_SQL["addresses_in_texts"] = rf"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b')) AS ip FROM documents)
SELECT doc_id, ip, {internal('ip')} AS internal, NOT {internal('ip')} AS public, CAST(split_part(ip, '.', 1) AS INTEGER) >= 128 AS upper_half FROM i
WHERE list_max(list_transform(string_split(ip, '.'), lambda x: CAST(x AS INTEGER))) <= 255"""
sql("address_functions", select=f" SELECT DISTINCT dst_ip AS ip, true AS valid, dst_ip AS normal, {internal('dst_ip')} AS internal, 'ip' AS entity_type, list_reduce(list_transform(string_split(dst_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x) AS number FROM netlog")
sql("business_hours", select=" SELECT CAST(hour(timestamp) AS INTEGER) AS hour, hour(timestamp) BETWEEN 8 AND 17 AS business, hour(timestamp) >= 20 OR hour(timestamp) < 6 AS night, count(*) AS n FROM netlog GROUP BY 1, 2, 3")
sql("top_event_types", select=" SELECT event_type, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM netlog GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
sql("top_sources", select=" SELECT src_ip, count(*) AS n FROM netlog GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
sql("connection_detail", select=f" SELECT dst_ip, event_type, count(*) AS n, {joined('dst_port', 'ports')}, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM netlog WHERE src_ip = '10.1.0.8' GROUP BY 1, 2")
sql("inside_outside", select=r" SELECT regexp_matches(dst_ip, '^(10\.|192\.168\.|172\.16\.)') AS inside, count(*) AS n, count(DISTINCT dst_ip) AS targets FROM netlog GROUP BY 1")

OLD = "prof AS (SELECT src_ip AS entity_id, count(*) / 100 AS score, count(*) AS evidence, min(ts_ms) AS first_seen FROM netlog WHERE event_id % 2 = 0 GROUP BY 1)"
sql(
    "risk_profiles", NODES, EDGES, RISKS, SCANS, OLD,
    "pts AS (SELECT entity_id, score * 0.5 ** (86400000 / 86400000.0) AS p, evidence AS e, 0 AS c FROM prof UNION ALL SELECT dst_ip, count(*) / 100, 1, 0 FROM netlog WHERE event_id % 2 = 1 GROUP BY dst_ip UNION ALL SELECT src, 0.5 * risk, 0, 1 FROM scan)",
    select=f" SELECT entity_id, 'ip' AS entity_type, {num('sum(p)', 'score', 8)}, CAST(sum(e) AS BIGINT) AS evidence_count, CAST(sum(c) AS INTEGER) AS chains, CASE WHEN sum(c) > 0 THEN 'T1046,T1595' ELSE '' END AS tags, 'stable' AS trend FROM pts GROUP BY entity_id",
)
sql("risk_point_lookup", OLD, select=f" SELECT '10.1.0.8' AS entity_id, {num('coalesce(max(score * 0.5), 0.0)', 'score')} FROM prof WHERE entity_id = '10.1.0.8'")
sql("risk_top_profiles", OLD, select=f" SELECT entity_id, {num('score', 'score')} FROM prof ORDER BY prof.score DESC, entity_id LIMIT 20")
sql("risk_search", OLD, select=f" SELECT entity_id, {num('score', 'score')} FROM prof WHERE contains(entity_id, '.1.0.1') AND prof.score >= 0.3")
sql("entity_timeline", select=" SELECT src_ip AS entity_id, ts_ms, event_type, event_type || ' to ' || dst_ip AS description FROM netlog WHERE src_ip = '10.1.0.8' ORDER BY ts_ms DESC, event_type, description LIMIT 50")
sql("chains_api_page", NODES, EDGES, RISKS, LATERAL, select=f" SELECT {LATERAL_OUT} FROM two WHERE risk >= 0.7 ORDER BY risk DESC, s, p, t, bt LIMIT 20")
sql("chain_narratives", NODES, EDGES, RISKS, LATERAL, select=" SELECT s || ' started, then ' || p || ' was used to move on, then ' || t || ' was reached.' AS story, 'Reset the credentials used and review access of the pivot host' AS action FROM (SELECT * FROM two ORDER BY risk DESC, s, p, t, bt LIMIT 20)")
sql(
    "intel_matches", "feed AS (SELECT DISTINCT 'ip' AS kind, dst_ip AS value FROM netlog WHERE event_id % 97 = 0 UNION SELECT 'domain', domain FROM netlog WHERE event_id % 89 = 0 AND domain IS NOT NULL)",
    select=" SELECT DISTINCT dst_ip AS entity, dst_ip AS ioc, 'ip' AS kind, CAST(0.9 AS DOUBLE) AS score FROM netlog JOIN feed ON value = dst_ip UNION ALL SELECT DISTINCT 'www.' || domain, domain, 'domain', CAST(0.5 AS DOUBLE) FROM netlog JOIN feed ON value = domain",
)
sql(
    "weak_labels",
    "hits AS (SELECT src_ip, max(CASE WHEN dst_port IN (4444, 1337, 31337, 6667, 6666, 8888) THEN 0.8 END) AS a, max(CASE WHEN split_part(domain, '.', 2) IN ('xyz', 'top', 'pw', 'tk', 'ml', 'ga') THEN 0.6 END) AS b, max(CASE WHEN dns_rcode = 'NXDOMAIN' THEN 0.5 END) AS c, max(CASE WHEN bytes_out > 50000 THEN 0.9 END) AS d FROM netlog GROUP BY 1)",
    "conf AS (SELECT src_ip, coalesce(CAST(list_avg(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) AS DOUBLE), 0.0) AS x FROM hits)",
    select=f" SELECT src_ip, {num('x', 'confidence')}, CASE WHEN x >= 0.8 THEN 'malicious' WHEN x >= 0.5 THEN 'suspicious' ELSE 'benign' END AS label FROM conf",
)
sql("tumbling_windows", select=" SELECT epoch_ms(date_trunc('day', timestamp)) AS start_ms, src_ip, event_type, count(*) AS events, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM netlog GROUP BY 1, 2, 3")
sql("sliding_windows", "s AS (SELECT event_type, (ts_ms // 3600000 - h) * 3600000 AS start_ms FROM netlog, range(2) r(h))", select=" SELECT start_ms, event_type, count(*) AS events FROM s GROUP BY 1, 2")
sql(
    "session_windows", "l AS (SELECT src_ip, ts_ms, timestamp AS ts, lag(timestamp) OVER (PARTITION BY src_ip ORDER BY timestamp) AS b FROM netlog)",
    "g AS (SELECT src_ip, ts, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts) AS s FROM l)",
    select=" SELECT src_ip, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 6 HOURS) // 1000 AS stop_ms, count(*) AS events FROM g GROUP BY src_ip, s",
)


# sequences: level by level, as the operator grows them
LEVELS = [
    "ev AS (SELECT src_ip, event_type || '|' || dst_ip AS item, row_number() OVER (PARTITION BY src_ip ORDER BY ts_ms, event_id, event_type || '|' || dst_ip) AS pos FROM netlog)",
    "g1 AS (SELECT src_ip, [item] AS s, pos FROM ev)",
]
for k in range(1, 9):
    if k > 1:
        LEVELS.append(f"g{k} AS (SELECT DISTINCT g.src_ip, list_append(g.s, e.item) AS s, e.pos FROM g{k - 1} g JOIN f{k - 1} f ON f.s = g.s JOIN ev e ON e.src_ip = g.src_ip AND e.pos BETWEEN g.pos + 1 AND g.pos + 3)")
    LEVELS.append(f"f{k} AS MATERIALIZED (SELECT s, count(DISTINCT src_ip) AS freq FROM g{k} GROUP BY s HAVING count(DISTINCT src_ip) >= 2)")
for name, bound in (("sequence_patterns", "freq < 0.01 * hosts"), ("sequence_support", "freq < 1.1 * hosts")):
    sql(
        name, *LEVELS, "f AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, 9)) + ")", "h AS (SELECT count(DISTINCT src_ip) AS hosts FROM netlog)",
        select=f" SELECT array_to_string(s, ',') AS sequence, freq, {num('freq / hosts', 'share')} FROM f, h WHERE {bound} AND len(list_distinct(list_transform(s, lambda x: split_part(x, '|', 2)))) >= 2",
    )
sql("chain_by_id", NODES, EDGES, RISKS, LATERAL, select=f" SELECT {LATERAL_OUT} FROM (SELECT * FROM two ORDER BY risk DESC, s, p, t, bt LIMIT 1)")
sql("entity_profile", EDGES, OLD, select=f" SELECT entity_id, 'ip' AS entity_type, {num('score', 'score')}, evidence AS evidence_count, (SELECT count(*) FROM (SELECT dst AS o FROM edges WHERE src = '10.1.0.8' UNION SELECT src FROM edges WHERE dst = '10.1.0.8') WHERE o <> '10.1.0.8') AS neighbors FROM prof WHERE entity_id = '10.1.0.8'")
sql("entities_page", OLD, select=f" SELECT entity_id, 'ip' AS entity_type, {num('score', 'score')}, count(*) OVER () AS total FROM prof WHERE prof.score >= 0.3 ORDER BY prof.score DESC, entity_id LIMIT 20")
sql("service_counters", NODES, EDGES, RISKS, SCANS, select=" SELECT (SELECT count(*) FROM netlog) AS events, (SELECT count(*) FROM scan) AS chains")
sql("chains_of_entities", NODES, EDGES, RISKS, SCANS, select=f" SELECT src AS entity_id, 'recon_scan' AS chain_type, {num('risk', 'total_risk_score')} FROM scan")
sql("report_summary", NODES, EDGES, RISKS, SCANS, select=" SELECT count(*) AS chains, count(*) FILTER (risk >= 0.9) AS critical, count(*) FILTER (risk >= 0.7 AND risk < 0.9) AS high, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS types FROM scan")
sql("injected_records", select=" SELECT * FROM (VALUES ('c2_beacon', 90, 2), ('lateral_movement', 8, 4), ('data_exfil', 80, 2), ('dga_activity', 300, 2), ('recon_scan', 500, 1)) v(attack, n, sources) UNION ALL SELECT 'none', count(*), count(DISTINCT src_ip) FROM netlog")
sql("running_risk", "newest AS (SELECT src_ip, max(ts_ms) AS t FROM netlog GROUP BY 1)", select=f" SELECT src_ip AS entity_id, {num('sum(severity / 10.0 * pow(0.5, (t - ts_ms) / 86400000.0))', 'score')}, any_value(t) AS last_updated FROM netlog JOIN newest USING (src_ip) GROUP BY src_ip")
sql("sketched_thresholds", VOLUME_CTE, select=" SELECT count(*) AS scores, true AS near FROM vol")
sql("target_novelty", "half AS (SELECT (min(ts_ms) + max(ts_ms)) / 2 AS half FROM netlog)", "known AS (SELECT DISTINCT src_ip, dst_ip, true AS old FROM netlog, half WHERE ts_ms < half)", select=" SELECT src_ip, count(*) AS events, count(*) FILTER (old IS NULL) AS new_targets FROM netlog CROSS JOIN half LEFT JOIN known USING (src_ip, dst_ip) WHERE ts_ms >= half GROUP BY src_ip")
sql(
    "core_distances", VOLUME_CTE, TAILS_CTE,
    "pts AS (SELECT src_ip, event_type, max(p) FILTER (feature = 'unique_dst_ips') AS a, max(p) FILTER (feature = 'unique_dst_ports') AS b, max(p) FILTER (feature = 'bytes_out_total') AS c FROM tails GROUP BY 1, 2)",
    select=f" SELECT x.src_ip, x.event_type, {num('list_sort(list(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2)))[least(10, count(*))]', 'core')} FROM pts x CROSS JOIN pts y GROUP BY x.src_ip, x.event_type",
)
sql(
    "exported_report", NODES, EDGES, RISKS, SCANS, LATERAL,
    "ch AS (SELECT 'recon_scan' AS chain_type, risk FROM scan UNION ALL SELECT 'lateral_movement', risk FROM two)",
    "b20 AS (SELECT * FROM ch ORDER BY risk DESC, chain_type LIMIT 20)",
    select=" SELECT (SELECT count(*) FROM netlog) AS events, (SELECT count(*) FROM ch) AS chains_found, count(*) FILTER (risk_score > 0.7) AS high_risk, count(*) FILTER (risk_score > 0.9) AS critical_risk, count(*) AS entities, (SELECT string_agg(printf('%.4f', risk), ',' ORDER BY risk DESC) FROM b20) AS chains FROM nodes WHERE entity_type = 'ip'",
)
sql(
    "entity_neighbors", "one AS (SELECT src_ip AS id FROM netlog GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    select=" SELECT DISTINCT id AS entity_id, CASE WHEN src_ip = id THEN dst_ip ELSE src_ip END AS neighbor, CAST(1 AS INTEGER) AS hops FROM netlog JOIN one ON src_ip = id OR dst_ip = id WHERE src_ip <> dst_ip",
)
# density: quartile cells of neighbouring features
NAMES = "event_count events_per_sec unique_dst_ips unique_dst_ports unique_domains bytes_out_total bytes_in_total byte_ratio".split()
PAIRS = " UNION ALL ".join(f"SELECT src_ip, event_type, {i} AS pair, {a} AS a, {b} AS b FROM cells" for i, (a, b) in enumerate(zip(NAMES, NAMES[1:] + NAMES[:1], strict=True)))
sql(
    "density_scores", VOLUME_CTE, TAILS_CTE, "cells AS (PIVOT (SELECT src_ip, event_type, feature, least(3, floor(p * 4)) AS cell FROM tails) ON feature IN (" + ", ".join(f"'{n}'" for n in NAMES) + ") USING first(cell) GROUP BY src_ip, event_type)",
    f"dp AS ({PAIRS})", "dc AS (SELECT *, count(*) OVER (PARTITION BY pair, a, b) / count(*) OVER (PARTITION BY pair) AS share FROM dp)", "dr AS (SELECT src_ip, event_type, 1 - avg(share) AS raw FROM dc GROUP BY 1, 2)",
    "de AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM dr)",
    select=f" SELECT src_ip, event_type, {num('CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE least(1.0, greatest(0.0, (raw - lo) / (hi - lo))) END', 'score')} FROM dr, de",
)
sql(
    "daily_report", NODES, EDGES, RISKS, SCANS, OLD,
    "pts AS (SELECT entity_id, evidence AS e, 0 AS c FROM prof UNION ALL SELECT dst_ip, 1, 0 FROM netlog WHERE event_id % 2 = 1 GROUP BY dst_ip UNION ALL SELECT src, 0, 1 FROM scan)", "pf AS (SELECT entity_id, sum(e) AS e, sum(c) AS c FROM pts GROUP BY 1)",
    select=" SELECT '2024-01-01' AS date, (SELECT count(*) FROM netlog) AS events, count(*) AS entities, (SELECT count(*) FROM scan) AS chains, CAST(sum(e) AS BIGINT) AS total_evidence, CAST(least(20, count(*)) AS INTEGER) AS n_entities, CAST((SELECT least(10, count(*)) FROM scan) AS INTEGER) AS n_chains, CAST((SELECT least(5, count(*)) FROM scan) + least(5, count(*) FILTER (c = 0)) AS INTEGER) AS n_recommendations FROM pf",
)


def uuid(line: str) -> str:
    return f"regexp_replace(substr(sha256({line}), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') AS event_id"


KINDS = "CASE (event_id % 8) WHEN 0 THEN 10 WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END"
LINE = "'<' || (severity * 8 + event_id % 8) || '>1 ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || ' fw' || (event_id % 5) || ' sshd ' || event_id || ' - - ' || CASE event_type WHEN 'auth_failure' THEN 'Failed password for root' WHEN 'auth_success' THEN 'Accepted password for root' ELSE 'Allowed TCP connection' END || ' from ' || src_ip || ':' || dst_port || ' to ' || dst_ip"
sql(
    "parse_syslog_5424",
    select=f" SELECT {uuid(LINE)}, 'fw' || (event_id % 5) AS sensor_id, epoch_ms(date_trunc('second', timestamp)) AS ms, CASE WHEN event_type IN ('auth_failure', 'auth_success') THEN event_type ELSE 'network_connect' END AS event_type, src_ip, dst_ip, dst_port AS src_port, CAST({KINDS} AS TINYINT) AS severity, CASE WHEN event_type NOT IN ('auth_failure', 'auth_success') THEN 'TCP' END AS proto, 'sshd' AS process_name, CAST(event_id AS INTEGER) AS process_id FROM netlog",
)
LINE = "'<13>' || strftime(timestamp, '%b %d %H:%M:%S') || ' host' || (event_id % 5) || ' app[' || event_id || ']: denied from ' || src_ip || ' port ' || dst_port"
sql(
    "parse_syslog_3164",
    select=f" SELECT {uuid(LINE)}, 'host' || (event_id % 5) AS sensor_id, strftime(timestamp, '%m-%d %H:%M:%S') AS day, 'suspicious_traffic' AS event_type, src_ip, CAST(NULL AS VARCHAR) AS dst_ip, dst_port AS src_port, CAST(3 AS TINYINT) AS severity, CAST(NULL AS VARCHAR) AS proto, 'app' AS process_name, CAST(event_id AS INTEGER) AS process_id FROM netlog",
)
LINE = "strftime(timestamp, '%d-%b-%Y %H:%M:%S.') || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0') || ' queries: info: client @0x1 ' || src_ip || '#' || (event_id % 60000 + 1) || ' (' || domain || '): query: ' || domain || ' IN A + (10.0.0.1)'"
sql("parse_dns_bind", select=f" SELECT {uuid(LINE)}, ts_ms AS ms, src_ip, CAST(event_id % 60000 + 1 AS INTEGER) AS src_port, domain, 'A' AS dns_rdata, 'DNS' AS proto, 'dns_query' AS event_type FROM netlog WHERE domain IS NOT NULL")
LINE = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || chr(9) || src_ip || chr(9) || domain || chr(9) || 'AAAA' || chr(9) || CASE WHEN dns_rcode = 'NXDOMAIN' THEN '3' ELSE '0' END || chr(9) || 'a' || chr(9) || 'b' || chr(9) || 'c'"
sql("parse_dns_windows", select=f" SELECT {uuid(LINE)}, src_ip, domain, 'AAAA' AS dns_rdata, dns_rcode, CASE WHEN dns_rcode = 'NXDOMAIN' THEN 'nxdomain' ELSE '' END AS tags FROM netlog WHERE domain IS NOT NULL")
sql("parse_waf_json", select=" SELECT ts_ms AS ms, src_ip, 'app.internal' AS domain, '/p/' || event_id AS url, CASE WHEN severity > 5 THEN 'block' ELSE 'log' END AS waf_action, waf_rule_id, CAST(CASE WHEN severity > 5 THEN 6 ELSE 3 END AS TINYINT) AS severity, CAST(403 AS SMALLINT) AS http_status, 'waf_rule:' || waf_rule_id AS tags FROM netlog WHERE event_type = 'waf_alert'")
LINE = "'src_ip=\"' || src_ip || '\" dst_ip=' || dst_ip || ' rule_id=' || waf_rule_id || ' request blocked'"
sql("parse_waf_pairs", select=f" SELECT {uuid(LINE)}, src_ip, dst_ip, 'block' AS waf_action, waf_rule_id, CAST(6 AS TINYINT) AS severity FROM netlog WHERE event_type = 'waf_alert'")
LINE = "'<Event xmlns=\"http://x\"><System><EventID>' || CASE WHEN event_type = 'auth_failure' THEN '4625' ELSE '4624' END || '</EventID><Level>' || (severity % 6) || '</Level><TimeCreated SystemTime=\"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts_ms % 1000 AS VARCHAR), 3, '0') || 'Z\"/><Computer>pc</Computer></System><EventData><Data Name=\"TargetUserName\">' || user || '</Data><Data Name=\"IpAddress\">' || src_ip || '</Data></EventData></Event>'"
sql(
    "parse_etw_xml",
    select=f" SELECT {uuid(LINE)}, ts_ms AS ms, 'pc' AS sensor_id, src_ip, user, event_type, CAST(CASE severity % 6 WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 3 END AS TINYINT) AS severity, 'eventid:' || CASE WHEN event_type = 'auth_failure' THEN '4625' ELSE '4624' END AS tags FROM netlog WHERE user IS NOT NULL",
)
