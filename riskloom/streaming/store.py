"""Tables of mergeable state in a folder that the cluster shares: deltas, merged when read, compacted by bucket.

A table has key columns and a merge: an associative and commutative aggregate by key (sum, min, max, union) that gives the
columns it takes. A batch only writes its own rows, cut into hash buckets of the key, so its cost follows the batch, not
the state. Reading merges the compacted rows with the deltas written since; a lookup reads the key's bucket alone.
Compaction merges the buckets that deltas touch into new files and leaves the others where they are.

    <table>/delta/<writer>/<batch>/bucket=<n>/   what a writer's batch brought
    <table>/base/<run>/bucket=<n>/               compacted rows
    <table>/manifest/<n>.json                    where each bucket's compacted rows are, and each writer's last batch in them

Batches are fenced by writer and number. A batch that runs again replaces its own delta, or does nothing once it is compacted.
A writer is a streaming query by its id (which a new checkpoint folder renews), so batch 0 of a new query is never
taken for batch 0 of an old one. A manifest appears whole, by a rename, and a number is taken once: of two compactions at
a time the second fails and loses nothing, as deltas go only after the manifest stands. Readers of an older manifest should end
before `clean`, which removes what no manifest needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]


class StateStore:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at = self._path("/".join([self.path, *parts]))
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _there(self, *parts: str) -> bool:
        return self._fs.exists(self._path("/".join([self.path, *parts])))

    def manifest(self, name: str) -> dict:
        """{"version", "buckets": {bucket: run}, "done": {writer: last compacted batch}} as it stands."""
        found = [int(n.removesuffix(".json")) for n in self._names(name, "manifest") if n.endswith(".json")]
        if not found:
            return {"version": 0, "buckets": {}, "done": {}}
        text = self.spark.read.text(f"{self.path}/{name}/manifest/{max(found)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def deltas(self, name: str) -> list[tuple[str, int]]:
        """(writer, batch) of the deltas that aren't compacted."""
        done = self.manifest(name)["done"]
        return sorted((w, int(b)) for w in self._names(name, "delta") for b in self._names(name, "delta", w) if int(b) > done.get(w, -1) and self._there(name, "delta", w, b, "_SUCCESS"))

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name].keys), F.lit(self.buckets)).cast("int")

    def append(self, name: str, writer: str, batch: int, rows: DataFrame) -> None:
        """Write a batch's rows, merged by key, as the delta of (writer, batch)."""
        if batch <= self.manifest(name)["done"].get(writer, -1):
            return
        rows = self.tables[name].merge(rows).withColumn("bucket", self._bucket(name))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/delta/{writer}/{batch}")

    def _parts(self, name: str, buckets: set[int] | None) -> list[str]:
        """Folders of the compacted and the newer rows of some buckets (or all)."""
        own = [f"base/{run}/bucket={b}" for b, run in self.manifest(name)["buckets"].items()]
        own += [f"delta/{w}/{b}/{n}" for w, b in self.deltas(name) for n in self._names(name, "delta", w, str(b)) if n.startswith("bucket=")]
        return [f"{self.path}/{name}/{p}" for p in own if buckets is None or int(p.rpartition("=")[2]) in buckets]

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """The merged state; None while there is none."""
        parts = self._parts(name, buckets)
        return self.tables[name].merge(self.spark.read.parquet(*parts)) if parts else None

    def read_for(self, name: str, rows: DataFrame) -> DataFrame | None:
        """The merged state of the buckets that rows' keys are in: `buckets` numbers at most come to the driver."""
        return self.read(name, {r[0] for r in rows.select(self._bucket(name)).distinct().collect()})

    def lookup(self, name: str, **key) -> DataFrame | None:
        """The merged row of one key, from its bucket alone."""
        one = self.spark.range(1).select(*[F.lit(key[c]).alias(c) for c in self.tables[name].keys])
        found = self.read_for(name, one)
        return found.join(F.broadcast(one), list(self.tables[name].keys), "left_semi") if found is not None else None

    def compact(self, name: str) -> int:
        """Merge all deltas into the buckets they touch; the number of buckets written."""
        old, deltas = self.manifest(name), self.deltas(name)
        touched = {int(n.rpartition("=")[2]) for w, b in deltas for n in self._names(name, "delta", w, str(b)) if n.startswith("bucket=")}
        new = {"version": old["version"] + 1, "buckets": dict(old["buckets"]), "done": dict(old["done"])}
        for w, b in deltas:
            new["done"][w] = max(b, new["done"].get(w, -1))
        if touched:
            run = uuid.uuid4().hex
            rows = self.read(name, touched).withColumn("bucket", self._bucket(name))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/base/{run}")
            new["buckets"] |= {str(b): run for b in touched}
        self._publish(name, new)
        for w, b in deltas:
            self._fs.delete(self._path(f"{self.path}/{name}/delta/{w}/{b}"), True)
        return len(touched)

    def compact_when(self, name: str, most: int = 16) -> None:
        """Compact once more than `most` deltas wait: each row is then rewritten once for so many batches that touch its bucket."""
        if len(self.deltas(name)) > most:
            self.compact(name)

    def _publish(self, name: str, manifest: dict) -> None:
        final = f"{self.path}/{name}/manifest/{manifest['version']}.json"
        draft = self._path(f"{self.path}/{name}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._path(final)) or not self._fs.rename(draft, self._path(final)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {name} was written by another")

    def clean(self, name: str) -> None:
        """Remove compacted rows and manifests that the newest manifest doesn't need."""
        now = self.manifest(name)
        for run in self._names(name, "base"):
            for part in self._names(name, "base", run):
                if now["buckets"].get(part.rpartition("=")[2]) != run and part.startswith("bucket="):
                    self._fs.delete(self._path(f"{self.path}/{name}/base/{run}/{part}"), True)
        for n in self._names(name, "manifest"):
            if n.endswith(".json") and int(n.removesuffix(".json")) < now["version"]:
                self._fs.delete(self._path(f"{self.path}/{name}/manifest/{n}"), False)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
