"""31 features of every (source address, event type), from unified records with ts_ms.

One aggregate over rows that two window passes (gap to the event before, and the gap before that)
have been added to, joined with per-value counts for the entropies. Timing is done in integer
milliseconds and divided at the end, so results don't depend on the order of rows. Distinct values of all
kinds are counted in one pass (value_counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, text

FEATURES = (
    "event_count", "events_per_sec", "unique_dst_ips", "unique_dst_ports", "unique_domains", "bytes_out_total",
    "bytes_in_total", "byte_ratio", "mean_iat", "std_iat", "burstiness", "iat_entropy", "business_hour_fraction",
    "beacon_score", "dst_ip_entropy", "dst_port_entropy", "rare_ip_fraction", "new_ip_fraction", "geo_diversity",
    "mean_domain_len", "mean_domain_entropy", "nxdomain_fraction", "high_cv_domain_fraction", "mean_dns_ttl",
    "auth_failure_ratio", "unique_users_attempted", "off_hours_auth_fraction", "new_user_auth", "waf_alert_density",
    "unique_waf_rules", "max_waf_severity",
)
KEYS = ["src_ip", "event_type"]


def entities(logs: DataFrame) -> DataFrame:
    """logs with src_ip "unknown" where there is none."""
    return logs.withColumn("src_ip", F.coalesce(text.truthy(F.col("src_ip")), F.lit("unknown")))


def baseline(logs: DataFrame) -> DataFrame:
    """(ip, n): how often each address is a source or a target."""
    both = logs.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).filter("ip <> ''")
    return both.groupBy("ip").agg(F.count("*").alias("n"))


def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows (of those where `of` holds) where the condition holds; 0 if there are none."""
    if of is None:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))
    return F.coalesce(F.sum(F.when(of & condition, 1.0).otherwise(0.0)) / F.nullif(F.sum(F.when(of, 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(0.0))


def value_counts(logs: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, kind, v, n): how often each value of each kind comes; nulls don't count.

    One pass for all kinds: distinct aggregates would repeat every row once for each of them, nulls included.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("v")) for k, c in values.items()])
    each = logs.select(*keys, F.explode(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("p"))
    return each.groupBy(*keys, "p.kind", "p.v").agg(F.count("*").alias("n"))


def variety(each: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values by kind, and the entropy in bits of how often addresses and ports come, from value_counts()."""
    n = F.col("n")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    distinct = lambda kind: F.count(of(kind, n)).cast("double")
    # -sum p log p = log N - (sum n log n) / N
    entropy = lambda kind: F.log2(F.sum(of(kind, n))) - F.sum(of(kind, n * F.log2(n))) / F.sum(of(kind, n))
    return each.groupBy(*keys).agg(
        distinct("ip").alias("unique_dst_ips"), distinct("port").alias("unique_dst_ports"), distinct("domain").alias("unique_domains"),
        distinct("user").alias("unique_users_attempted"), distinct("rule").alias("unique_waf_rules"),
        entropy("ip").alias("dst_ip_entropy"), entropy("port").alias("dst_port_entropy"),
    )


def new_users(each: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """new_user_auth by key: 1 if a user of value_counts() is not in the baseline."""
    users = each.filter("kind = 'user'").select(*keys, F.col("v").alias("ip"))
    return users.join(known.select("ip"), "ip", "left_anti").groupBy(*keys).agg(F.lit(1.0).alias("new_user_auth"))


def timing(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Gap features: mean_iat, std_iat, iat_entropy, beacon_score, regularity, by key."""
    order = Window.partitionBy(*keys).orderBy("ts_ms", *[c for c in ("event_id",) if c in logs.columns])
    gaps = logs.select(*keys, "ts_ms", *[c for c in ("event_id",) if c in logs.columns])
    gaps = gaps.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(order)).withColumn("before", F.lag("gap").over(order))
    up = F.when(F.col("gap") > 0, F.col("gap"))
    g, b = F.col("gap").cast("decimal(38,0)"), F.col("before").cast("decimal(38,0)")
    one = gaps.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(up).alias("m"),
        F.sum(up).alias("s"),
        F.sum(up.cast("decimal(19,0)") * up.cast("decimal(19,0)")).alias("ss"),  # gaps over 35 days pass 64 bits
        F.min(up).alias("low"),
        F.max(up).alias("high"),
        F.count("gap").alias("k"),
        F.sum("gap").alias("t"),
        F.sum(g * g).alias("tt"),
        F.sum(g * b).alias("lagged"),
        F.sum(F.when(F.col("before").isNotNull(), F.col("gap") + F.col("before"))).alias("pair_sum"),
        F.count("before").alias("pairs"),
    )
    d = lambda c: F.col(c).cast("double")
    mean = d("s") / d("m")
    std = F.when(F.col("m") >= 2, F.sqrt(F.greatest(F.lit(0.0), (d("ss") - d("s") * d("s") / d("m")) / (d("m") - 1)))).otherwise(0.0)
    # regularity and lag-1 correlation of all gaps, in ms
    mu = d("t") / d("k")
    var = F.greatest(F.lit(0.0), d("tt") - d("t") * mu)
    cov = d("lagged") - mu * d("pair_sum") + d("pairs") * mu * mu
    spread = F.sqrt(var / d("k"))
    regular = F.when(mu > 0, 1 - spread / mu).otherwise(0.0)
    beacon = F.when((F.col("n") >= 10) & (mu > 0), F.greatest(F.lit(0.0), cov / (var + 1e-4) * regular)).otherwise(0.0)
    one = one.select(
        *keys,
        "m",
        "low",
        "high",
        F.coalesce(mean / 1000, F.lit(0.0)).alias("mean_iat"),
        F.coalesce(std / 1000, F.lit(0.0)).alias("std_iat"),
        beacon.alias("beacon_score"),
        F.coalesce(regular, F.lit(0.0)).alias("regularity"),
    )
    bins = F.least(F.lit(10), F.floor(F.col("m") / 2))
    width = (F.col("high") - F.col("low")) / bins
    wide = one.filter("m >= 5 and high > low").select(*keys, "low", "high", width.alias("width"))
    placed = gaps.filter("gap > 0").join(wide, keys).filter("gap < high").groupBy(*keys, F.floor((F.col("gap") - F.col("low")) / F.col("width")).alias("bin")).agg(F.count("*").alias("n"))
    n = F.col("n")
    entropy = placed.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(n * F.log2(n)) / F.sum("n")).alias("iat_entropy"))
    return one.drop("m", "low", "high").join(entropy, keys, "left").fillna(0.0, ["iat_entropy"])


def novelty(logs: DataFrame, known: DataFrame, keys: list[str], rare: int = 5) -> DataFrame:
    """Shares of distinct targets that the baseline has fewer than `rare` times, or not at all."""
    targets = logs.select(*keys, F.col("dst_ip").alias("ip")).filter("ip <> ''").distinct().join(known, "ip", "left")
    return targets.groupBy(*keys).agg(share(F.coalesce(F.col("n"), F.lit(0)) < rare).alias("rare_ip_fraction"), share(F.col("n").isNull()).alias("new_ip_fraction"))


def entity_features(logs: DataFrame, known: DataFrame | None = None, window_sec: float = 3600.0, keys: list[str] | None = None) -> DataFrame:
    """The keys, FEATURES (doubles) and regularity. known: a baseline(); none means an empty one."""
    keys = keys or KEYS
    logs = entities(logs)
    domain, rcode = text.truthy(F.col("domain")), F.col("dns_rcode")
    auth, waf = F.col("event_type").startswith("auth_"), F.col("event_type") == "waf_alert"
    has_domain = domain.isNotNull()
    user = F.when(auth, text.truthy(F.col("user")))
    hour = net.utc_hour(F.col("ts_ms"))
    out = logs.groupBy(*keys).agg(
        F.count("*").cast("double").alias("event_count"),
        (F.count("*") / window_sec).alias("events_per_sec"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).cast("double").alias("bytes_out_total"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).cast("double").alias("bytes_in_total"),
        share(hour.between(8, 17)).alias("business_hour_fraction"),
        F.coalesce(F.avg(F.length(domain)), F.lit(0.0)).alias("mean_domain_len"),
        F.coalesce(F.avg(F.when(has_domain, text.shannon_entropy(domain))), F.lit(0.0)).alias("mean_domain_entropy"),
        share(rcode == "NXDOMAIN", has_domain).alias("nxdomain_fraction"),
        share(text.consonant_vowel_ratio(text.last_body(domain)) > 4, has_domain).alias("high_cv_domain_fraction"),
        share(F.col("event_type") == "auth_failure", auth).alias("auth_failure_ratio"),
        share(~hour.between(8, 17), auth).alias("off_hours_auth_fraction"),
        share(waf).alias("waf_alert_density"),
        F.coalesce(F.max(F.when(waf, F.col("severity"))), F.lit(0)).cast("double").alias("max_waf_severity"),
    )
    out = out.withColumn("byte_ratio", F.col("bytes_out_total") / (F.col("bytes_in_total") + 1))
    each = value_counts(logs, keys, {"ip": text.truthy(F.col("dst_ip")), "port": F.col("dst_port"), "domain": domain, "user": user, "rule": F.when(waf, text.truthy(F.col("waf_rule_id")))})
    parts = [timing(logs, keys), variety(each, keys)]
    if known is not None:
        parts += [novelty(logs, known, keys), new_users(each, known, keys)]
    for part in parts:
        out = out.join(part, keys, "left")
    if known is None:  # nothing is known: a join with an empty baseline would bring all rows without a user together in one task
        some = lambda c: F.when(F.col(c) > 0, 1.0)
        out = out.withColumns({"rare_ip_fraction": some("unique_dst_ips"), "new_ip_fraction": some("unique_dst_ips"), "new_user_auth": some("unique_users_attempted")})
    out = out.withColumn("burstiness", F.col("std_iat") / F.greatest("mean_iat", F.lit(1e-6)))
    out = out.withColumn("geo_diversity", F.lit(0.0)).withColumn("mean_dns_ttl", F.lit(0.0))
    return out.select(*keys, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES], "regularity")


def windowed_features(logs: DataFrame, duration: str = "1 hour", seconds: float = 3600.0) -> DataFrame:
    """The features of every tumbling window: keys and window_start."""
    each = logs.withColumn("window_start", F.window("timestamp", duration)["start"])
    return entity_features(each, window_sec=seconds, keys=[*KEYS, "window_start"])
