"""The graph and risk as durable state, and streams over unified records.

Graph and baseline are kept in a StateStore; merges are associative (sum, min, max, union). Running risk is the state of the
stream itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detectors import merged_sketches, score_sketch, sketched_threshold
from ..operators.graph import build_edges, build_nodes
from .store import StateStore, Table, query_id


def merge_nodes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy("id").agg(F.min("entity_type").alias("entity_type"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("total_events").alias("total_events"))


def merge_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return both.groupBy("src", "dst", "edge_type").agg(F.sum("event_count").alias("event_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), union("ports"), union("protocols"))


def merge_targets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src_ip", "dst_ip").agg(F.min("first_seen").alias("first_seen"), F.sum("events").alias("events"))


def merge_scores(rows: DataFrame) -> DataFrame:
    return merged_sketches(rows, ["series"])


#: The graph, who has talked to whom, and sketches of scores by series.
TABLES = {
    "nodes": Table(("id",), lambda rows: merge_nodes(None, rows)),
    "edges": Table(("src", "dst", "edge_type"), lambda rows: merge_edges(None, rows)),
    "targets": Table(("src_ip", "dst_ip"), merge_targets),
    "scores": Table(("series",), merge_scores),
}


def graph_store(spark: SparkSession, path: str, buckets: int = 64) -> StateStore:
    return StateStore(spark, path, TABLES, buckets)


def merge_window(store: StateStore, logs: DataFrame, writer: str, batch: int) -> None:
    """Merge a window's graph into the state."""
    store.append("nodes", writer, batch, build_nodes(logs))
    store.append("edges", writer, batch, build_edges(logs))


def stream_into_state(logs: DataFrame, store: StateStore, checkpoint: str, most_deltas: int = 16):
    """A query that merges every micro-batch of streaming logs into the state."""

    def each(batch: DataFrame, n: int) -> None:
        merge_window(store, batch, query_id(store.spark, checkpoint), n)
        for name in ("nodes", "edges"):
            store.compact_when(name, most_deltas)

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def targets_of(logs: DataFrame) -> DataFrame:
    rows = logs.filter("src_ip <> '' and dst_ip <> ''")
    return rows.select("src_ip", "dst_ip", F.col("ts_ms").alias("first_seen"), F.lit(1).cast("bigint").alias("events"))


def with_novelty(logs: DataFrame, known: DataFrame | None) -> DataFrame:
    """logs with new_target: whether the source has not talked to the target in the baseline known (src_ip, dst_ip)."""
    has = F.col("src_ip").isNotNull() & (F.col("src_ip") != "") & F.col("dst_ip").isNotNull() & (F.col("dst_ip") != "")
    if known is None:
        return logs.withColumn("new_target", has)
    out = logs.join(known.select("src_ip", "dst_ip", F.lit(True).alias("_known")), ["src_ip", "dst_ip"], "left")
    return out.withColumn("new_target", has & F.col("_known").isNull()).drop("_known").select(*logs.columns, "new_target")


def novelty_stream(logs: DataFrame, store: StateStore, checkpoint: str, sink: Callable[[DataFrame, int], None], most_deltas: int = 16):
    """A query that tells targets that are new to their source, against a baseline that grows with every batch.

    A batch is held against the buckets of the baseline that its own keys are in, handed to sink(rows, batch), and then joins
    the baseline: a target is new in the first batch that has it, in all of its rows there. A batch that runs again is
    held against the baseline without itself.
    """

    def each(batch: DataFrame, n: int) -> None:
        writer = query_id(store.spark, checkpoint)
        if (writer, n) in store.deltas("targets"):  # it ran before and did not finish
            store.append("targets", writer, n, targets_of(batch.limit(0)))
        sink(with_novelty(batch, store.read_for("targets", targets_of(batch))), n)
        store.append("targets", writer, n, targets_of(batch))
        store.compact_when("targets", most_deltas)

    return logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(logs: DataFrame, duration: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, src_ip, event_type, events, bytes_out) of tumbling windows; batch or stream."""
    w = F.window("timestamp", duration)
    rows = logs.withWatermark("timestamp", late) if logs.isStreaming else logs
    out = rows.groupBy(w.alias("w"), "src_ip", "event_type").agg(F.count("*").alias("events"), F.sum("bytes_out").alias("bytes_out"))
    return out.select(F.col("w.start").alias("start"), "src_ip", "event_type", "events", "bytes_out")


def sliding_counts(logs: DataFrame, duration: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    rows = logs.withWatermark("timestamp", late) if logs.isStreaming else logs
    out = rows.groupBy(F.window("timestamp", duration, step).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events")


def sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(src_ip, start, stop, events) of runs of records with no gap as long."""
    rows = logs.withWatermark("timestamp", late) if logs.isStreaming else logs
    out = rows.groupBy(F.session_window("timestamp", gap).alias("w"), "src_ip").agg(F.count("*").alias("events"))
    return out.select("src_ip", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def threshold_stream(scores: DataFrame, store: StateStore, checkpoint: str, most_deltas: int = 16):
    """A query that adds every micro-batch of scores (series, score) to the sketch of its series."""

    def each(batch: DataFrame, n: int) -> None:
        store.append("scores", query_id(store.spark, checkpoint), n, score_sketch(batch, by=["series"]))
        store.compact_when("scores", most_deltas)

    return scores.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thresholds(store: StateStore, series: str) -> DataFrame:
    """threshold, investigation and critical of a series as its scores stand; those for few scores if it has none."""
    found = store.lookup("scores", series=series)
    return sketched_threshold(found if found is not None else store.spark.createDataFrame([], "sketch binary"))


class DecayingRisk(StatefulProcessor):
    """Value state (score, at) for each entity: the sum of its scores, each halved every half-life up to the time `at` of the newest.

    The sum doesn't depend on the order of rows, so late ones that the watermark still lets in count in full. An event-time
    timer stands where the score will have decayed below `least`: then the entity leaves, with a row that says so.
    """

    def __init__(self, half_ms: float, least: float):
        self.half_ms, self.least = half_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("risk", "score double, at bigint")

    def keep(self, score: float, at: int) -> None:
        self.state.update((score, at))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at + int(np.ceil(self.half_ms * max(0.0, np.log2(max(score, self.least) / self.least)))) + 1)

    def row(self, key, score: float, at: int, left: bool) -> pd.DataFrame:
        return pd.DataFrame({"entity_id": [key[0]], "score": [score], "last_updated": [at], "left": [left]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        at = int(initialState["last_updated"].max())
        age = (at - initialState["last_updated"]).to_numpy(float)
        self.keep(float((initialState["score"].to_numpy(float) * 0.5 ** (age / self.half_ms)).sum()), at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        score, at = self.state.get() if self.state.exists() else (0.0, None)
        for b in rows:
            ts = b["timestamp"].astype("datetime64[ms]").astype("int64").to_numpy()
            new = int(ts.max()) if at is None else max(at, int(ts.max()))
            score = score * 0.5 ** ((new - at) / self.half_ms) if at is not None else 0.0
            score += float((np.maximum(b["score"].fillna(0).to_numpy(float), 0) * 0.5 ** ((new - ts) / self.half_ms)).sum())
            at = new
        self.keep(score, at)
        yield self.row(key, score, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        score, at = self.state.get()
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        self.state.clear()
        yield self.row(key, score * 0.5 ** ((now - at) / self.half_ms), now, True)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def risk_stream(scores: DataFrame, half_life_hours: float = 24.0, late: str = "1 hour", least: float = 0.01, profiles: DataFrame | None = None) -> DataFrame:
    """Running risk of each entity over a stream (entity_id, timestamp, score): entity_id, score, last_updated, left.

    profiles (entity_id, score, last_updated): risk from a batch that the stream begins with. The session's
    spark.sql.streaming.stateStore.providerClass must be RocksDB's.
    """
    spark = scores.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    rows = scores.select("entity_id", "timestamp", "score").withWatermark("timestamp", late).groupBy("entity_id")
    initial = profiles.select("entity_id", "score", "last_updated").groupBy("entity_id") if profiles is not None else None
    out = "entity_id string, score double, last_updated bigint, left boolean"
    return rows.transformWithStateInPandas(DecayingRisk(half_life_hours * 3_600_000, least), out, "Update", "EventTime", initial)


def risk_batch(scores: DataFrame, half_life_hours: float = 24.0) -> DataFrame:
    """The same of rows that are all there: entity_id, score, last_updated."""
    at = scores.groupBy("entity_id").agg(F.max("timestamp").alias("at"))
    age = F.unix_millis("at") - F.unix_millis("timestamp")
    points = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) * F.pow(F.lit(0.5), age / (half_life_hours * 3_600_000))
    return scores.join(at, "entity_id").groupBy("entity_id").agg(F.sum(points).alias("score"), F.unix_millis(F.max("at")).alias("last_updated"))
