"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct k-word shingles. Hashing every shingle to one bit of a long
sketch and XORing gives the set's parity sketch; two sketches differ in at most as many bits as the
sets differ in members. Within a band of sizes, sets with Jaccard num/den or more differ in at most
d members, so of m > d parts of the sketch one is equal in both (pigeonhole). Documents meet in the
buckets (band, part, value of the part); their sets are then compared exactly.

Sketches are never laid out: a part has 2**32 bits, and only the XOR of its set bits' hashes is
made, which is the same for equal parts. A part without set bits says nothing and would be shared by all
texts of a size, so there are half as many parts again as d: then a document has more other parts than d.
It uses the d + 1 that come first in an order which depends on a part's content alone (those with most
shingles first): at most d of a document's parts are not in the other one, so the first equal part in that
order is among the first d + 1 of both. The few documents without d + 1 such parts use the empty ones too.

Null texts are empty. Texts without words have size 0 and link with nothing; they keep their own doc_id
as component_id. Repeated rows each get a row; rows of one doc_id with different texts are judged each by
its own text. A row with a null doc_id takes part, and its component_id is the smallest doc_id that is
not null, or null if there is none. Ties: components depend on the links alone. Texts of any length are
taken whole, a chunk of texts at a time. An empty table gives an empty one. Columns beyond doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import saved, small, with_text_key
from .linker import digests, link, most_apart, parity_sketch, set_of, verified_texts
from .textkit import mix, signed, taken

#: Ratio of a band's sizes; a set is also in the band below while that may hold partners.
BAND = 1.6


def bands(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(band, d, parts) for a set of n members: all pairs with Jaccard num/den share a band."""
    out, low, b = [], 1, 0
    while low <= n:
        high = max(low + 1, int(low * BAND))  # smaller members of pairs in this band: low to high - 1
        most = ((high - 1) * den) // num
        if n <= most:
            d = most_apart(high - 1, most, num, den)
            out.append((b, d, d + 1 + d // 2 + 2 * (d > 0)))
        low, b = high, b + 1
    return out


def part_keys(values: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each set, and the index of the set."""
    keys, owners = [], []
    for s, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b == a:
            continue
        h = values[a:b]
        bit = mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
        for band, d, parts in bands(b - a, num, den):
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            value = np.bitwise_xor.reduceat(bit[order], at)
            where, members = part[order][at], np.diff(np.append(at, len(part)))
            where, members, value = where[value != 0], members[value != 0], value[value != 0]
            few = len(where) <= d
            if few:  # then an equal part may be an empty one
                none = np.setdiff1d(np.arange(parts), where)
                where, value = np.concatenate([where, none]), np.concatenate([value, np.zeros(len(none), np.uint64)])
            key = mix(value ^ mix(where.astype(np.uint64) + np.uint64((band + 1) << 40)))
            if not few:
                key = key[np.lexsort((key, -members))[: d + 1]]
            keys.append(key)
            owners.append(np.full(len(key), s))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def unit_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, same, id, n, sketch): each document's set as digest, size and parity sketch."""

    def run(batches):
        for batch in batches:
            for row, values, first in set_of(batch.column("text"), k):
                own = batch.slice(row, len(first) - 1)
                cols = [pa.array(signed(digests(values, first))), pa.array(np.diff(first)), pa.array(parity_sketch(values, first), pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("same"), *cols], ["doc_id", "same", "id", "n", "sketch"])

    return docs.select("doc_id", "same", "text").mapInArrow(run, "doc_id long, same long, id long, n long, sketch binary")


def key_table(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, id) of every document's buckets; sets that repeat within a chunk are taken once."""

    def run(batches):
        for batch in batches:
            for _, values, first in set_of(batch.column("text"), k):
                ids = digests(values, first)
                _, once = np.unique(ids, return_index=True)
                once.sort()
                keys, owner = part_keys(*taken(values, first, once), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(signed(ids[once][owner]))], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links: Jaccard num/den or more.

    component_id is the smallest doc_id that links reach, the document's own included.
    """
    docs, repeats = with_text_key(docs)
    units = saved(unit_table(docs, k))
    row = F.min(F.struct("doc_id", "same")).alias("row")
    classes = saved(units.groupBy("id").agg(F.min("doc_id").alias("doc_id"), row, F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def verify(pairs: DataFrame, some: DataFrame) -> DataFrame:
        reps = some.select("id", F.col("row.doc_id").alias("of"), F.col("row.same").alias("text_key"))
        mine = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("text_key"))
        texts = docs.join(F.broadcast(reps) if small(reps) else reps, mine).select("id", "text")
        return verified_texts(pairs, texts.dropDuplicates(["id"]) if repeats else texts, k, num, den)

    found = link(key_table(docs, k, num, den), lambda ids: classes, verify, num, den)
    best = classes.filter("n > 0").select("id", "doc_id").join(found, "id", "left")
    best = best.withColumn("component", F.coalesce("component", "id"))
    least = best.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = best.join(least, "component").select("id", "component_id")
    out = units.select("doc_id", "id", F.col("n").alias("n_shingles")).join(named, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
