import pytest
from pyspark.sql import functions as F

from riskloom.schema import LOG_FIELDS
from riskloom.sources import dns, etw, files, syslog, waf
from riskloom.sources.registry import available_parsers, get_parser, register

NOW = "2024-07-01 00:00:00"


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def now():
    return F.lit(NOW).cast("timestamp")


def test_registry():
    assert available_parsers() == ["dns", "etw", "syslog", "waf"]
    with pytest.raises(ValueError):
        get_parser("csv")
    with pytest.raises(TypeError):
        register("bad", 3)


def test_syslog_forms(spark):
    got = syslog.parse(
        lines(
            spark,
            r'<165>1 2025-02-03T04:05:06.700Z gate9 pfilter 77 drop1 [zone@32473 in="lan\] a" out="wan"][x y="1"] packet rejected, 172.20.4.4:6001 -> 198.18.7.7:25 udp',
            "<38>Mar  4 23:59:58 bastion login/pam[4021]: Login incorrect for operator7 from 172.20.9.1, sport=40404",
            "#! rotated",
            "\t ",
            "<30>Dec 31 00:00:01 resolver cache: soa refresh for zone blue.test via 172.20.0.53",
            "<86>Apr 9 01:02:03 edge2 relay[x]: tunnel established",
            "<12>1 2025-02-03T04:05:06Z gate9 - - - - ",
            "link flapped; peer 172.20.1.1 denied",
        ),
        2025,
        now(),
    ).collect()
    assert [n for n, _ in LOG_FIELDS] == list(got[0].asDict())
    assert [(r.event_type, r.severity, r.src_ip, r.dst_ip, r.src_port, r.process_name, r.process_id, r.sensor_id) for r in got] == [
        ("suspicious_traffic", 3, "172.20.4.4", "198.18.7.7", 6001, "pfilter", 77, "gate9"),
        ("auth_failure", 2, "172.20.9.1", None, 40404, "login/pam", 4021, "bastion"),
        ("dns_query", 2, "172.20.0.53", None, None, "cache", None, "resolver"),
        ("network_connect", 2, None, None, None, "relay[x]", None, "edge2"),
        ("network_connect", 5, None, None, None, None, None, "gate9"),
        ("network_connect", 3, "172.20.1.1", None, None, None, None, "unknown"),
    ]
    assert [str(got[i].timestamp) for i in (0, 1, 3)] == ["2025-02-03 04:05:06.700000", "2025-03-04 23:59:58", "2025-04-09 01:02:03"]


def test_syslog_event_rules(spark):
    """One message for each rule of the classifier, and the default."""
    want = [
        ("publickey accepted for u", 6, "auth_success"),
        ("invalid user zed", 6, "auth_failure"),
        ("session opened with success", 6, "auth_success"),
        ("session opened for u", 6, "auth_failure"),
        ("ssh handshake failed", 6, "auth_failure"),
        ("nxdomain from upstream", 6, "dns_query"),
        ("query : host.test", 6, "dns_query"),
        ("drop on eth1", 6, "suspicious_traffic"),
        ("permit rule 9", 6, "network_connect"),
        ("accept on eth1", 6, "network_connect"),
        ("http get /index", 6, "http_request"),
        ("buffer overflow in parser", 6, "suspicious_traffic"),
        ("kernel panic", 2, "suspicious_traffic"),
        ("fan speed normal", 6, "network_connect"),
    ]
    texts = [f"<{8 + level}>May 6 07:08:09 box app: {m}" for m, level, _ in want]
    got = {r.raw_message: r.event_type for r in syslog.parse(lines(spark, *texts), 2025, now()).collect()}
    assert got == {t: kind for t, (_, _, kind) in zip(texts, want, strict=True)}


def test_dns_forms(spark):
    got = dns.parse(
        lines(
            spark,
            "07-Nov-2025 19:20:21.004 queries: info: client @0x55aa 172.20.3.9#40001 (mail.north.test): query: mail.north.test IN MX +E(0)K (172.20.0.2)",
            "07-Nov-2025 19:20:22.000 queries: info: client 172.20.3.8#40002 (query.test): query: query.test IN AAAA + (172.20.0.2)",
            "client 172.20.5.5#9953: view inner: query: login.south.test IN A",
            "client 172.20.5.6 : query: bare.test IN A",
            "[1762543221] unbound[801:3] reply: SERVFAIL q 9 172.20.6.6 AAAA west.test.",
            "2025-11-07T19:20:21\t172.20.7.7\teast.test\tTXT\t5\t-\t-\t-",
            "nxdomain while asking far-off.example.net of 172.20.8.8",
        ),
        now(),
    ).collect()
    assert [(r.src_ip, r.src_port, r.domain, r.dns_rcode, r.dns_rdata, r.tags) for r in got] == [
        ("172.20.3.9", 40001, "mail.north.test", None, "MX", []),
        ("172.20.3.8", 40002, "query.test", None, "AAAA", []),
        ("172.20.5.5", 9953, "login.south.test", None, None, []),
        ("172.20.5.6", None, "bare.test", None, None, []),
        ("172.20.6.6", None, "west.test.", "SERVFAIL", "AAAA", []),
        ("172.20.7.7", None, "east.test", "REFUSED", "TXT", []),
        ("172.20.8.8", None, "far-off.example.net", "NXDOMAIN", None, ["nxdomain"]),
    ]
    assert [str(got[i].timestamp) for i in (0, 4, 5)] == ["2025-11-07 19:20:21.004000", "2025-11-07 19:20:21", "2025-11-07 19:20:21"]


def test_waf_forms(spark):
    got = waf.parse(
        lines(
            spark,
            '{"action":"block","clientIP":"203.0.113.99","clientRequestHTTPMethod":"GET","timestamp":"2024-06-15T08:30:30Z","ruleId":"1","status":"403"}',
            '{"timestamp":1718438400,"httpRequest":{"clientIp":"1.2.3.4"}}',
            'ModSecurity: Access denied from 1.2.3.4 to 5.6.7.8 [id "942100"]',
            'src_ip="9.9.9.9" rule_id=7 dropped',
        ),
        now(),
    ).collect()
    assert [(r.src_ip, r.dst_ip, r.http_method, r.http_status, r.waf_action, r.waf_rule_id, r.severity) for r in got] == [
        ("203.0.113.99", None, "GET", 403, "block", "1", 6),
        ("1.2.3.4", None, None, None, None, None, 3),
        ("1.2.3.4", "5.6.7.8", None, None, "block", "942100", 6),
        ("9.9.9.9", None, None, None, "block", "7", 6),
    ]
    assert str(got[1].timestamp) == "2024-06-15 08:00:00"


def test_etw_events(spark):
    xml = (
        '<Events><Event xmlns="http://x"><System><EventID>4625</EventID><Level>2</Level><TimeCreated SystemTime="2024-06-15T08:00:00.000Z"/>'
        '<Computer>pc</Computer></System><EventData><Data Name="TargetUserName">admin</Data><Data Name="IpAddress">10.1.1.50</Data></EventData></Event>'
        "<Event><System><EventID>3</EventID></System><EventData><Data>tcp 1.2.3.4 to 4.3.2.1</Data></EventData></Event></Events>"
    )
    got = etw.parse(lines(spark, xml, "<Event><broken"), now()).collect()
    assert [(r.event_type, r.severity, r.sensor_id, r.src_ip, r.dst_ip, r.user, r.proto, r.tags) for r in got] == [
        ("auth_failure", 8, "pc", "10.1.1.50", None, "admin", None, ["eventid:4625"]),
        ("network_connect", 3, "unknown", "1.2.3.4", "4.3.2.1", None, "TCP", ["eventid:3"]),
    ]


def test_normalize_and_load(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.log").write_text("<37>Aug 8 08:08:08 bastion login[9]: keyboard login accepted for operator7 from 172.20.9.2\n\n# no\n")
    files.normalize(spark, str(tmp_path / "in"), str(tmp_path / "out"), "syslog")
    assert files.load(spark, str(tmp_path / "out")).select("event_type").collect()[0][0] == "auth_success"
    assert files.load(spark, str(tmp_path / "in")).count() == 1
    assert files.from_text(spark, "client 172.20.5.5#9953: query: inner.test IN A", "dns").first().domain == "inner.test"


def test_syslog_port_makes_tokens_once_a_message(spark):
    """Looking the next token up in an expression made all tokens again for each of them."""
    lines = ["from 10.0.0.1:22. on", "denied port 443", "sport=0 dport:(53)", "report 7", "a:1 1.2.3.4:99999", None]
    df = spark.createDataFrame([(x,) for x in lines], "m string").select("m", syslog.port(F.col("m")).alias("p"))
    assert [r.p for r in df.collect()] == [22, 443, 53, None, None, None]
    assert df._jdf.queryExecution().analyzed().toString().count("split(lower(") == 1
