"""Threat feeds (kind, value) and their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import is_ipv4, looks_ipv6

#: Indicators are broadcast up to this many (about 100 bytes each).
BROADCAST_IOCS = 500_000


def normalized(feed: DataFrame) -> DataFrame:
    value = F.lower(F.trim("value"))
    kind = F.when(is_ipv4(value) | looks_ipv6(value), "ip").otherwise("domain")
    out = feed.select(F.coalesce("kind", kind).alias("kind"), value.alias("value"))
    return out.filter("value <> ''").distinct()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One indicator a line, # begins a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value"))
    return normalized(lines.select(F.lit(None).cast("string").alias("kind"), "value"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one, with type and value, indicator or ioc."""
    rows = spark.read.schema("type string, value string, indicator string, ioc string").option("multiLine", True).json(path)
    kind = F.when(F.contains(F.lower("type"), F.lit("ip")), "ip").when(F.contains(F.lower("type"), F.lit("domain")), "domain")
    return normalized(rows.select(kind.alias("kind"), F.coalesce("value", "indicator", "ioc").alias("value")))


def add_manual(spark: SparkSession, path: str, kind: str, value: str) -> None:
    row = spark.range(1).select(F.lit(kind).alias("type"), F.lit(value).alias("value"))
    row.write.mode("append").json(path)


def small(feed: DataFrame) -> DataFrame:
    return F.broadcast(feed) if feed.limit(BROADCAST_IOCS + 1).count() <= BROADCAST_IOCS else feed


def match(entities: DataFrame, feed: DataFrame) -> DataFrame:
    """Per matched entity (of column entity): ioc, kind, score. Addresses 0.9, domains 0.8, else the longest parent domain 0.5."""
    feed = small(feed)
    e = entities.select("entity").filter("entity <> ''").distinct().withColumn("low", F.lower("entity"))
    labels = F.split("low", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = e.select("entity", F.posexplode(F.when(is_ipv4(F.col("low")), F.array("low")).otherwise(parents)).alias("depth", "value"))
    hit = each.join(feed, "value")
    score = F.when(F.col("kind") == "ip", 0.9).when(F.col("depth") == 0, 0.8).otherwise(0.5)
    order = Window.partitionBy("entity").orderBy("depth", F.desc("score"), "kind")
    hit = hit.withColumn("score", score).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return hit.select("entity", F.col("value").alias("ioc"), "kind", "score")


def enrich(scores: DataFrame, feed: DataFrame) -> DataFrame:
    """scores (entity, score) raised to the match's score where that is higher, with ioc."""
    found = match(scores, feed).select("entity", "ioc", F.col("score").alias("intel"))
    out = scores.join(found, "entity", "left")
    return out.withColumn("score", F.greatest("score", F.coalesce("intel", F.lit(0.0)))).drop("intel")
