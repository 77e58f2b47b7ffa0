"""The unified log record and helpers to build it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = """event_id string, timestamp timestamp, ingest_time timestamp, source_type string, sensor_id string,
src_ip string, src_port int, dst_ip string, dst_port int, proto string, event_type string, severity tinyint,
user string, process_name string, process_id int, domain string, url string, http_method string, http_status smallint,
bytes_in bigint, bytes_out bigint, duration_ms int, dns_rcode string, dns_rdata string, waf_action string,
waf_rule_id string, raw_message string, tags array<string>"""
LOG_FIELDS = [tuple(f.strip().split(" ", 1)) for f in _FIELDS.replace("\n", " ").split(",")]
LOG_SCHEMA = _FIELDS.replace("\n", " ")
#: Fixed names of event types.
EVENT_TYPES = (
    "network_connect", "dns_query", "http_request", "auth_success", "auth_failure", "process_create",
    "file_create", "file_delete", "registry_modify", "waf_alert", "suspicious_traffic", "network_listen",
)
SOURCE_TYPES = ("syslog", "etw", "waf", "dns")


def unified(df: DataFrame, **columns: Column) -> DataFrame:
    """A unified record for each row: the given columns, typed; the others null."""
    unknown = set(columns) - {n for n, _ in LOG_FIELDS}
    if unknown:
        raise ValueError(f"not fields of the log record: {sorted(unknown)}")
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in LOG_FIELDS])


def with_ts_ms(logs: DataFrame) -> DataFrame:
    """logs with ts_ms, the event time in epoch milliseconds, on which arithmetic is done."""
    return logs.withColumn("ts_ms", F.unix_millis(F.col("timestamp").cast("timestamp")))


def event_uuid(raw: Column) -> Column:
    """The first half of the line's SHA-256, written as a UUID."""
    h = F.sha2(raw, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
