"""The communication graph as two DataFrames: nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..lineage import saved


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or nulls where the records don't have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def edge_label(event_type: Column) -> Column:
    return (
        F.when(event_type.startswith("auth_"), "auth")
        .when(event_type == "dns_query", "dns")
        .when(event_type == "process_create", "process")
        .when(event_type.startswith("file_"), "file")
        .when(event_type == "waf_alert", "http")
        .otherwise("network")
    )


def build_nodes(logs: DataFrame) -> DataFrame:
    """id, entity_type, first_seen, last_seen, total_events."""
    src, process = truthy(F.col("src_ip")), truthy(column(logs, "process_name"))
    kinds = {"ip": [src, truthy(F.col("dst_ip"))], "user": [truthy(column(logs, "user"))], "domain": [truthy(column(logs, "domain"))], "process": [F.concat(src, F.lit(":"), process)]}
    found = F.array(*[F.struct(c.alias("id"), F.lit(kind).alias("entity_type")) for kind, cs in kinds.items() for c in cs])
    each = logs.select("ts_ms", F.explode(F.array_distinct(found)).alias("e")).filter("e.id is not null")
    return each.groupBy(F.col("e.id").alias("id")).agg(
        F.min("e.entity_type").alias("entity_type"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.count("*").alias("total_events")
    )


def build_edges(logs: DataFrame) -> DataFrame:
    """src, dst, edge_type, event_count, first_seen, last_seen, ports, protocols; only between known addresses."""
    rows = logs.filter("src_ip <> '' and dst_ip <> ''")
    return rows.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), edge_label(F.col("event_type")).alias("edge_type")).agg(
        F.count("*").alias("event_count"),
        F.min("ts_ms").alias("first_seen"),
        F.max("ts_ms").alias("last_seen"),
        F.array_sort(F.collect_set("dst_port")).alias("ports"),
        F.array_sort(F.collect_set(column(logs, "proto"))).alias("protocols"),
    )


def apply_scores(nodes: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """nodes with risk_score (of scores: id, score; 0 without) and is_anomalous."""
    best = scores.groupBy("id").agg(F.max("score").alias("risk_score"))
    out = nodes.join(best, "id", "left").fillna(0.0, ["risk_score"])
    return out.withColumn("is_anomalous", F.col("risk_score") > threshold)


def apply_edge_risk(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with risk_score: the larger one of their ends."""
    risk = nodes.select("id", "risk_score")
    out = edges.join(risk.select(F.col("id").alias("src"), F.col("risk_score").alias("a")), "src", "left")
    out = out.join(risk.select(F.col("id").alias("dst"), F.col("risk_score").alias("b")), "dst", "left")
    return out.withColumn("risk_score", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).drop("a", "b")


def anomalous_nodes(nodes: DataFrame, least: float = 0.7) -> DataFrame:
    return nodes.filter(F.col("risk_score") >= least)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids (id)."""
    ends = [edges.join(ids.select(F.col("id").alias(c)), c, "left_semi").select(edges.columns) for c in ("src", "dst")]
    return ends[0].unionByName(ends[1]).dropDuplicates(["src", "dst", "edge_type"])


def risk_subgraph(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    kept = anomalous_nodes(nodes, least)
    return kept, induced(edges, kept)


def neighborhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops) of what links reach from start (id) within depth, whichever way they point."""
    pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = front = start.select("id", F.lit(0).alias("hops")).distinct()
    for hop in range(1, depth + 1):
        step = pairs.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = step.join(reached, "id", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached


def node_link(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The graph around start (id) as node-link tables, to be written as JSON lines: nodes (id, hops and their columns), links (source, target, key and the edge's columns)."""
    near = neighborhood(edges, start, depth)
    links = induced(edges, near).withColumnsRenamed({"src": "source", "dst": "target"}).withColumn("key", F.col("edge_type"))
    return nodes.join(near, "id"), links


def trace_path(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """(hop, node) of a directed path with the fewest edges, the first by name of those; none beyond `most` edges.

    Searched from both ends, each hop from the end whose frontier has fewer nodes, until the frontiers meet. A frontier
    keeps of each node's paths the first by name, is written, and is read by the next hop alone.
    """
    pairs = saved(edges.select("src", "dst").distinct())
    one = edges.sparkSession.range(1)
    here = {name: saved(one.select(F.lit(at).alias("at"), F.array(F.lit(at)).alias("path"))) for name, at in (("from", source), ("to", target))}
    seen, count = {k: f.select("at") for k, f in here.items()}, {"from": 1, "to": 1}
    # paths by name: the forward part in order, then the other part in order, so the first of all is the first of the joined ones
    met = here["from"].join(here["to"].select("at", F.col("path").alias("rest")), "at")
    hops = 0
    while met.isEmpty() and hops < most and min(count.values()):
        end = min(count, key=count.get)
        near, far = ("src", "dst") if end == "from" else ("dst", "src")
        step = here[end].join(pairs.withColumnRenamed(near, "at"), "at")
        path = F.concat("path", F.array(far)) if end == "from" else F.concat(F.array(far), "path")
        step = step.select(F.col(far).alias("at"), path.alias("path")).join(seen[end], "at", "left_anti")
        here[end] = saved(step.groupBy("at").agg(F.min("path").alias("path")))
        seen[end] = saved(seen[end].unionByName(here[end].select("at")))
        count[end], hops = here[end].count(), hops + 1
        met = here["from"].join(here["to"].select("at", F.col("path").alias("rest")), "at")
    whole = met.select(F.concat("path", F.slice("rest", 2, most + 1)).alias("path"))
    return whole.orderBy("path").limit(1).select(F.posexplode("path").alias("hop", "node"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree (edges of every type count), out_neighbors, ports (distinct, out)."""
    ports = edges.select(F.col("src").alias("id"), F.explode("ports").alias("p")).distinct().groupBy("id").agg(F.count("*").cast("int").alias("ports"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.count_distinct("dst").alias("out_neighbors"))
    out = out.join(ports, "id", "left").fillna(0, ["ports"])
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    both = out.join(into, "id", "full").fillna(0)
    return both.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def edge_rarity(logs: DataFrame) -> DataFrame:
    """(src, dst, event_type, n, probability, rarity = -ln probability) over all events."""
    rows = logs.filter("src_ip <> '' and dst_ip <> ''")
    each = rows.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "event_type").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return each.join(F.broadcast(total)).withColumn("probability", p).withColumn("rarity", -F.log(p)).drop("total")


def peers(edges: DataFrame, top: int = 20) -> DataFrame:
    """Per entity its busiest peers: id, direction, peer, events, place."""
    out = edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("peer"), "event_count")
    into = edges.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("peer"), "event_count")
    total = out.unionByName(into).groupBy("id", "direction", "peer").agg(F.sum("event_count").alias("events"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("events"), "direction", "peer"))
    return total.withColumn("place", place).filter(F.col("place") <= top)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
