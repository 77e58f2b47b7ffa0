"""WAF logs (JSON of several vendors, ModSecurity, key-value lines) to unified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import event_uuid, unified
from .rules import addresses, first_of, group, has_any, iso_time, mapped

PAIR = r'(\w+)\s*[:=]\s*(?:"([^"]*)"|([^\s"]+))'
#: Fixed field names, the first present and not empty one counts.
JSON_FIELDS = {
    "src": ("clientIP", "client_ip", "sourceIP", "httpRequest.clientIp"),
    "dst": ("destinationIP", "serverIP"),
    "domain": ("clientRequestHTTPHost", "host"),
    "url": ("clientRequestPath", "uri", "path"),
    "method": ("clientRequestHTTPMethodName", "clientRequestHTTPMethod", "httpMethod", "method"),
    "status": ("edgeResponseStatus", "status"),
    "action": ("action", "terminatingAction"),
    "rule": ("ruleId", "WAFRuleId"),
    "time": ("timestamp", "dateTime", "@timestamp"),
}
PAIR_FIELDS = {
    "src": ("src_ip", "clientip", "source_ip"),
    "dst": ("dst_ip", "server_ip", "host"),
    "action": ("action", "waf_action"),
    "rule": ("rule_id", "ruleid"),
    "time": ("timestamp", "time"),
}
SEVERITY = {"block": 6, "challenge": 5}


def parse(lines: DataFrame, ingest_time: Column | None = None, sensor_id: str = "unknown") -> DataFrame:
    """lines (value) to unified records; blank lines are skipped."""
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    v = F.col("value")
    df = lines.select(F.trim("value").alias("value")).filter(F.col("value") != "").withColumn("json", F.try_parse_json("value"))
    is_json = F.schema_of_variant("json").startswith("OBJECT")
    df = df.withColumn("form", first_of([(F.coalesce(is_json, F.lit(False)), "json"), (has_any(v, "ModSecurity"), "modsecurity")], "pairs"))
    named = F.regexp_extract_all(v, F.lit(PAIR), F.lit(1))
    quoted, bare = (F.regexp_extract_all(v, F.lit(PAIR), F.lit(n)) for n in (2, 3))
    value = F.zip_with(quoted, bare, lambda q, b: F.when(q != "", q).otherwise(b))
    # the last of equal keys counts
    pairs = F.map_from_entries(F.aggregate(
        F.arrays_zip(named.alias("k"), value.alias("v")), F.array().cast("array<struct<k: string, v: string>>"),
        lambda acc, p: F.concat(F.filter(acc, lambda x: x["k"] != p["k"]), F.array(F.struct(p["k"].alias("k"), p["v"].alias("v")))),
    ))
    df = df.withColumn("pairs", F.when(F.col("form") == "pairs", pairs)).withColumn("ips", addresses(v))
    is_ = lambda form: F.col("form") == form

    def field(name):
        of_json = [F.nullif(F.try_variant_get("json", f"$.{k}" if k[0] != "@" else f"$['{k}']", "string"), F.lit("")) for k in JSON_FIELDS[name]]
        out = F.when(is_("json"), F.coalesce(*of_json))
        if name in PAIR_FIELDS:
            out = out.when(is_("pairs"), F.coalesce(*[F.nullif(F.try_element_at("pairs", F.lit(k)), F.lit("")) for k in PAIR_FIELDS[name]]))
        return out

    low = F.lower(v)
    words = first_of([(has_any(low, "block", "deny", "reject", "drop"), "block"), (has_any(low, "allow", "pass", "accept"), "allow"), (has_any(low, "challenge", "captcha"), "challenge")], "log")
    mod = first_of([(has_any(low, "denied"), "block"), (has_any(v, "Warning"), "log")], F.lit(None).cast("string"))
    action = F.when(is_("modsecurity"), mod).when(is_("pairs"), F.coalesce(field("action"), words)).otherwise(field("action"))
    rule = F.when(is_("modsecurity"), group(v, r"""id\s*[:"']+(\d+)""", 1)).otherwise(field("rule"))
    src = F.when(is_("modsecurity"), F.get("ips", F.lit(0))).when(is_("pairs"), F.coalesce(field("src"), F.get("ips", F.lit(0)))).otherwise(field("src"))
    second = F.get("ips", F.lit(1))
    dst = F.when(is_("modsecurity"), second).when(is_("pairs"), F.when(field("src").isNull(), F.coalesce(second, field("dst"))).otherwise(field("dst"))).otherwise(field("dst"))
    number = field("time").try_cast("double")
    epoch = F.timestamp_millis(F.when(number < 1e12, number * 1000).otherwise(number).try_cast("long"))
    tags = F.when(rule.isNotNull(), F.array(F.concat(F.lit("waf_rule:"), rule))).otherwise(F.array().cast("array<string>"))
    return unified(
        df,
        event_id=event_uuid(v),
        timestamp=F.coalesce(F.when(number.isNull(), iso_time(field("time"), now)), epoch, now),
        ingest_time=now,
        source_type=F.lit("waf"),
        sensor_id=F.lit(sensor_id),
        src_ip=src,
        dst_ip=dst,
        proto=F.lit("HTTP"),
        event_type=F.lit("waf_alert"),
        severity=mapped(F.coalesce(action, F.lit("")), SEVERITY, 3),
        domain=field("domain"),
        url=field("url"),
        http_method=field("method"),
        http_status=field("status").try_cast("smallint"),
        waf_action=action,
        waf_rule_id=rule,
        raw_message=v,
        tags=tags,
    )
