"""Helpers shared by the operators: cut lineage, narrow a table by ids, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast up to this many (about 40 bytes each in the hash table); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Links that are worked on together where there are few.
EDGES_A_PARTITION = 200_000


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a new local one only where that is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp())
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; rows hold whole texts here
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than saved(), but it stays there."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_text_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id (long), text, and same: tells rows of one doc_id with different texts apart; whether any doc_id repeats (if not, same is 0)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return docs.withColumn("same", F.xxhash64("text") if repeats else F.lit(0).cast("long")), repeats


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> bool:
    return ids.limit(most + 1).count() <= most


def only(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_IDS, anti: bool = False) -> DataFrame:
    """Rows of df whose key is in ids (one column), or isn't. Broadcasts ids only up to `most` rows."""
    return df.join(F.broadcast(ids) if small(ids, most) else ids, on, "left_anti" if anti else "left_semi")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id that links reach.

    Alternates large-star and small-star steps. Each takes a minimum per id (a partial aggregate)
    and joins it back, so no id's neighbours are gathered into one row. Loops and repeated edges
    are allowed; an empty table gives an empty one. Few edges are kept in few partitions.
    """

    def held(df: DataFrame) -> DataFrame:
        return df.coalesce(parts) if parts else df

    parts = 0
    e, state = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state or not now[0]:
            break
        state, parts = now, now[0] // EDGES_A_PARTITION + 1
        e = e.coalesce(parts)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = held(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(held(held(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """components() after more links (a, b): only components are linked anew, not their members."""
    ends = links
    for end in ("a", "b"):
        of = label.select(F.col("id").alias(end), F.col("component").alias("c"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    above = saved(components(ends))
    top = above.select(F.col("id").alias("component"), F.col("component").alias("top"))
    known = label.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = above.join(label.select("id"), "id", "left_anti")
    return known.unionByName(new)
