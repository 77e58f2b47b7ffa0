"""The driver's events table read as unified log records.

Only integer and string expressions, so that SQL elsewhere can say the same (NETLOG_SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_OF = {"click": "network_connect", "view": "dns_query", "error": "auth_failure", "signup": "auth_success", "purchase": "waf_alert"}
PORTS = (80, 443, 22, 53, 445, 3389, 8080)
TLDS = (".com", ".net", ".xyz", ".top")


def inner_address(n: Column) -> Column:
    return F.concat(F.lit("10.1."), F.floor(n / 250).cast("string"), F.lit("."), (1 + n % 250).cast("string"))


def netlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts_ms, timestamp and the fields of the log record that the events give."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.lit("network_connect")
    for theirs, ours in EVENT_OF.items():
        kind = F.when(F.col("event_type") == theirs, ours).otherwise(kind)
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "value", k.alias("k"), kind.alias("event_type"))
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    port = F.element_at(F.array(*[F.lit(p) for p in PORTS]), F.col("k") % len(PORTS) + 1)
    tld = F.element_at(F.array(*[F.lit(t) for t in TLDS]), F.col("k") % len(TLDS) + 1)
    out = F.floor(F.col("value") * 100).cast("long")
    return e.select(
        "event_id",
        "timestamp",
        F.unix_millis("timestamp").alias("ts_ms"),
        inner_address(F.col("user_id")).alias("src_ip"),
        F.when(F.col("k") < 60, inner_address(F.col("k"))).otherwise(F.concat(F.lit("203.0.113."), F.col("k").cast("string"))).alias("dst_ip"),
        port.alias("dst_port"),
        F.when(is_("dns_query"), "UDP").otherwise("TCP").alias("proto"),
        "event_type",
        (F.col("k") % 11).cast("int").alias("severity"),
        F.when(is_("auth_failure", "auth_success"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user"),
        F.when(is_("dns_query"), F.concat(F.translate((F.col("event_id") * 7919).cast("string"), "0123456789", "abcdefghij"), tld)).alias("domain"),
        F.when(is_("dns_query"), F.when(F.col("k") % 5 == 0, "NXDOMAIN").otherwise("NOERROR")).alias("dns_rcode"),
        F.when(is_("waf_alert"), F.concat(F.lit("R"), (F.col("k") % 20).cast("string"))).alias("waf_rule_id"),
        out.alias("bytes_out"),
        F.floor(out / 3).cast("long").alias("bytes_in"),
    )


NETLOG_SQL = r"""
netlog AS (
  SELECT event_id, ts AS timestamp, epoch_us(ts) // 1000 AS ts_ms,
    '10.1.' || CAST(user_id // 250 AS VARCHAR) || '.' || CAST(1 + user_id % 250 AS VARCHAR) AS src_ip,
    CASE WHEN k < 60 THEN '10.1.' || CAST(k // 250 AS VARCHAR) || '.' || CAST(1 + k % 250 AS VARCHAR) ELSE '203.0.113.' || CAST(k AS VARCHAR) END AS dst_ip,
    [80, 443, 22, 53, 445, 3389, 8080][k % 7 + 1] AS dst_port,
    CASE WHEN event_type = 'dns_query' THEN 'UDP' ELSE 'TCP' END AS proto, event_type, k % 11 AS severity,
    CASE WHEN event_type IN ('auth_failure', 'auth_success') THEN 'u' || CAST(user_id AS VARCHAR) END AS user,
    CASE WHEN event_type = 'dns_query' THEN translate(CAST(event_id * 7919 AS VARCHAR), '0123456789', 'abcdefghij') || ['.com', '.net', '.xyz', '.top'][k % 4 + 1] END AS domain,
    CASE WHEN event_type = 'dns_query' THEN CASE WHEN k % 5 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END END AS dns_rcode,
    CASE WHEN event_type = 'waf_alert' THEN 'R' || CAST(k % 20 AS VARCHAR) END AS waf_rule_id,
    CAST(floor(value * 100) AS BIGINT) AS bytes_out, CAST(floor(CAST(floor(value * 100) AS BIGINT) / 3) AS BIGINT) AS bytes_in
  FROM (SELECT event_id, ts, user_id, value, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
    CASE event_type WHEN 'view' THEN 'dns_query' WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' WHEN 'purchase' THEN 'waf_alert' ELSE 'network_connect' END AS event_type
    FROM events))
"""
