"""Reading files whatever their names, events over several lines, and times without a zone."""

from itertools import combinations

from pyspark.sql import functions as F

from riskloom.operators import chains, evaluation, risk
from riskloom.sources import files
from riskloom.sources.rules import in_utc, iso_time

LINE = "<13>Jun 18 10:00:00 host app[7]: denied from 10.0.0.9 port 22\n"
EVENT = '<Event xmlns="http://x">\n <System>\n  <EventID>4625</EventID>\n  <Level>2</Level>\n  <TimeCreated SystemTime="2024-06-18T10:00:00.000Z"/>\n  <Computer>pc</Computer>\n </System>\n <EventData>\n  <Data Name="IpAddress">10.0.0.4</Data>\n </EventData>\n</Event>\n'


def test_files_of_any_name(spark, tmp_path):
    for name in ("messages", "app.out", "auth"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text(LINE)
        (tmp_path / name / "notes.json").write_text("{}\n")
        assert [r.src_ip for r in files.load(spark, str(tmp_path / name)).collect()] == ["10.0.0.9"]


def test_events_over_several_lines(spark, tmp_path):
    (tmp_path / "security.xml").write_text("<Events>\n" + EVENT + EVENT.replace("10.0.0.4", "10.0.0.5") + "</Events>\n")
    got = files.load(spark, str(tmp_path), "etw").collect()
    assert sorted(r.src_ip for r in got) == ["10.0.0.4", "10.0.0.5"] and {r.event_type for r in got} == {"auth_failure"}


def test_times_without_zone_are_utc(spark):
    rows = spark.createDataFrame([("2024-06-18T10:00:00", "2024-06-18T12:00:00+02:00", "2024 Jun 18 10:00:00")], "a string, b string, c string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            none = F.lit(None).cast("timestamp")
            r = rows.select(*[F.unix_millis(t).alias(n) for n, t in (("a", iso_time(F.col("a"), none)), ("b", iso_time(F.col("b"), none)), ("c", in_utc(F.col("c"), "yyyy MMM d HH:mm:ss")))]).first()
            assert (r.a, r.b, r.c) == (1718704800000,) * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rare_sequences(spark):
    hosts = {"10.0.0.1": "abcde", "10.0.0.2": "axxbc", "10.0.0.3": "zzab", "10.0.0.4": "cba"}
    rows = [(h, f"203.0.113.{ord(c)}", "network_connect", i) for h, s in hosts.items() for i, c in enumerate(s)]
    want = {}
    for s in hosts.values():
        found = {tuple(s[i] for i in at) for n in range(2, len(s) + 1) for at in combinations(range(len(s)), n) if all(b - a <= 3 for a, b in zip(at, at[1:], strict=False))}
        for x in found:
            want[x] = want.get(x, 0) + 1
    want = {x: n for x, n in want.items() if n >= 2 and n / 4 < 0.9 and len(set(x)) >= 2}
    logs = spark.createDataFrame(rows, "src_ip string, dst_ip string, event_type string, ts_ms long")
    got = {tuple(chr(int(x.rsplit(".", 1)[1])) for x in r.sequence): r.freq for r in chains.sequences(logs, rare=0.9).collect()}
    assert got == want and ("a", "b") in got


def test_pivots_keep_the_first_rows(spark):
    """lateral() joins a part of each pivot's edges only, and gives what joining all gives."""
    nodes = spark.createDataFrame([(f"10.0.0.{i}", (i * 37 % 100) / 100) for i in range(250)], "id string, risk_score double")
    edges = [(f"10.0.0.{i}", "10.0.0.7", "auth", 1 + i % 60, i * 3_600_000, i) for i in range(120)] + [("10.0.0.7", f"10.0.0.{i}", ("network", "dns")[i % 2], 1 + i % 55, i, i) for i in range(60, 240)]
    edges = spark.createDataFrame(edges, "src string, dst string, edge_type string, event_count long, first_seen long, last_seen long")
    kept = lambda: [tuple(r) for r in chains.lateral(nodes, edges, 10, 0.3).select("affected_assets", "total_risk_score").collect()]
    part, plain = kept(), chains.of_pivots
    chains.of_pivots = lambda a, b, *_: (a, b)
    try:
        assert sorted(part) == sorted(kept())
    finally:
        chains.of_pivots = plain


def test_lookups_of_the_report(spark):
    truth = spark.createDataFrame([("a", "c2_beacon", ["x", "y"], 0), ("b", "recon_scan", ["q"], 0)], "attack_id string, attack_type string, entities array<string>, start_time bigint")
    schema = "chain_id string, chain_type string, nodes array<struct<entity: string, role: string, risk_score: double>>, total_risk_score double, first_seen bigint"
    found = spark.createDataFrame([("1", "c2_beacon", [("x", "source", 1.0), ("y", "target", 0.1)], 0.95, 0), ("2", "recon_scan", [("w", "source", 1.0)], 0.75, 0)], schema)
    assert [r.attack_id for r in evaluation.misses(truth, found).collect()] == ["b"]
    assert [r.chain_id for r in evaluation.false_positives(truth, found).collect()] == ["2"]
    assert tuple(risk.severity_counts(found).first()) == (2, 1, 1, 2)
    assert [r.chain_id for r in risk.chain_by_id(found, spark.createDataFrame([("2",)], "chain_id string")).collect()] == ["2"]
