"""Streams with restarts, late rows and new checkpoints; the state store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import detectors, graph
from riskloom.sources.netlog import netlog
from riskloom.streaming import state


def totals(df, column):
    return tuple(df.agg(F.count("*"), F.sum(column)).first())


def test_graph_state_of_a_stream(spark, tmp_path, sf_dir):
    """Three batches, then a second query with a checkpoint of its own whose batch 0 must count; compaction; lookups."""
    logs = netlog(spark, sf_dir)
    parts = logs.randomSplit([3.0, 1.0], seed=1)
    parts[0].repartition(3).write.parquet(str(tmp_path / "a"))
    parts[1].repartition(1).write.parquet(str(tmp_path / "b"))
    read = lambda name: spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    store = state.graph_store(spark, str(tmp_path / "state"), buckets=8)
    state.stream_into_state(read("a"), store, str(tmp_path / "cp1")).awaitTermination()
    assert [b for _, b in store.deltas("edges")] == [0, 1, 2]
    assert totals(store.read("edges"), "event_count") == totals(graph.build_edges(parts[0]), "event_count")
    assert store.compact("edges") == 8 and not store.deltas("edges")
    state.stream_into_state(read("b"), store, str(tmp_path / "cp2")).awaitTermination()
    edges = graph.build_edges(logs)
    assert totals(store.read("edges"), "event_count") == totals(edges, "event_count")
    assert totals(store.read("nodes"), "total_events") == totals(graph.build_nodes(logs), "total_events")
    writer = state.query_id(spark, str(tmp_path / "cp1"))
    store.append("edges", writer, 2, edges)  # compacted: runs again for nothing
    (other, batch), = store.deltas("edges")
    store.append("edges", other, batch, graph.build_edges(parts[1]))  # not compacted: replaces itself
    assert totals(store.read("edges"), "event_count") == totals(edges, "event_count")
    one = edges.orderBy("src", "dst", "edge_type").first()
    assert store.lookup("edges", src=one.src, dst=one.dst, edge_type=one.edge_type).select(*edges.columns).first() == one
    assert store.lookup("edges", src="nobody", dst="x", edge_type="y").count() == 0
    store.compact("edges")
    store.clean("edges")
    assert totals(store.read("edges"), "event_count") == totals(edges, "event_count") and store.manifest("edges")["version"] == 2


def test_compaction_leaves_other_buckets(spark, tmp_path):
    """A small batch after a large one: the delta and the compaction touch one bucket alone; a lost race is told."""
    store = state.graph_store(spark, str(tmp_path), buckets=16)
    rows = lambda ids: spark.createDataFrame([(f"s{i}", "t", i, 1) for i in ids], "src_ip string, dst_ip string, first_seen long, events long")
    assert store.read("targets") is None and store.lookup("targets", src_ip="s1", dst_ip="t") is None
    store.append("targets", "w", 0, rows(range(200)))
    store.compact("targets")
    before = store.manifest("targets")["buckets"]
    store.append("targets", "w", 1, rows([7, 7]))
    assert store.compact("targets") == 1
    after = store.manifest("targets")["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.lookup("targets", src_ip="s7", dst_ip="t").first().events == 3 and store.read("targets").count() == 200
    with pytest.raises(RuntimeError):
        store._publish("targets", store.manifest("targets"))


def test_a_target_stops_being_new(spark, tmp_path):
    schema = "event_id long, src_ip string, dst_ip string, ts_ms long"
    batches = [[(1, "a", "x", 5), (2, "a", "x", 6), (3, "b", "x", 7), (4, "a", None, 8)], [(5, "a", "x", 9), (6, "a", "y", 9)], [(7, "a", "y", 10), (8, "b", "y", 11), (9, "", "y", 12)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    got = {}
    sink = lambda df, n: got.update({r.event_id: r.new_target for r in df.collect()})
    store = state.graph_store(spark, str(tmp_path / "state"), buckets=4)
    for i in range(3):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / str(i)))
        state.novelty_stream(stream, store, str(tmp_path / f"cp{i}"), sink, most_deltas=1).awaitTermination()
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: False}


def test_thresholds_of_a_stream(spark, tmp_path):
    """Three batches of a skewed series: thresholds as near to the exact ones as the sketch's ranks; another series; none."""
    rng = random.Random(8)
    values = [min(1.0, rng.expovariate(6)) for _ in range(6000)]
    rows = [("a", v) for v in values] + [("b", 0.5), ("b", None), ("b", float("nan"))]
    spark.createDataFrame(rows, "series string, score double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = state.graph_store(spark, str(tmp_path / "state"), buckets=4)
    state.threshold_stream(stream, store, str(tmp_path / "cp"), most_deltas=2).awaitTermination()
    got = state.thresholds(store, "a").first()
    df = spark.createDataFrame([(v,) for v in values], "score double")
    want = detectors.gpd_threshold(df).first()
    off = 0.01  # ranks of a sketch of this size are off by less
    low, high = (detectors.gpd_threshold(df, tail=0.10 + d).first() for d in (off, -off))
    slack = abs(low.threshold - high.threshold) + 0.02
    assert abs(got.threshold - want.threshold) <= slack and abs(got.critical - want.critical) <= 3 * slack
    assert [state.thresholds(store, s).first().threshold for s in ("b", "nobody")] == [0.95, 0.95]


SCORES = "entity_id string, timestamp timestamp, score double"


def at(hours):
    return dt.datetime(2024, 6, 1) + dt.timedelta(hours=hours)


def test_running_risk(spark, tmp_path):
    """Files one by one, a restart after two, a row that comes late, one entity that falls silent, and what a batch knew before."""
    files = [[("a", at(1), 0.8), ("idle", at(1), 0.3)], [("a", at(4), 0.5), ("b", at(4), 0.9)], [("a", at(3.5), 0.4), ("a", at(5), None), ("b", at(5), -1.0)], [("b", at(200), 0.1)], [("b", at(201), 0.1)]]
    old = spark.createDataFrame([("a", 2.0, int(at(0).timestamp() * 1000))], "entity_id string, score double, last_updated long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    seen = []

    def run(n):
        for i in range(n):
            if not (tmp_path / "in" / f"{i}.parquet").exists():
                spark.createDataFrame(files[i], SCORES).coalesce(1).write.parquet(str(tmp_path / "tmp" / str(i)))
                part = next((tmp_path / "tmp" / str(i)).glob("part-*.parquet"))
                (tmp_path / "in").mkdir(exist_ok=True)
                part.rename(tmp_path / "in" / f"{i}.parquet")
        stream = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = state.risk_stream(stream, half_life_hours=10, late="2 hours", least=0.01, profiles=old)
        keep = lambda df, n: seen.extend(df.collect())
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    try:
        run(2)
        run(5)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = [r for f in files for r in f]
    all_rows = spark.createDataFrame([("a", at(0), 2.0), *rows], SCORES)
    want = {r.entity_id: (r.score, r.last_updated) for r in state.risk_batch(all_rows, 10).collect()}
    last = {r.entity_id: r for r in seen if not r.left}
    for e in ("a", "b"):
        assert (last[e].score, last[e].last_updated) == (pytest.approx(want[e][0]), want[e][1])
    gone = {r.entity_id: r for r in seen if r.left}
    assert {"a", "idle"} <= set(gone) and all(r.score <= 0.0101 for r in gone.values())
    with pytest.raises(ValueError):
        state.risk_stream(spark.readStream.schema(SCORES).parquet(str(tmp_path / "in")))
