"""Removal of near-duplicate passages by MinHash banding.

A text is cut into passages: after every line feed, and inside a line before each word that, together
with its next, has the least hash among the SPREAD words before and after it. Such a cut depends on these
words alone, so a passage that repeats inside other surroundings is cut alike from SPREAD words after
its start to SPREAD words before its end. A passage has 2 * SPREAD words on the average.

A passage's set holds its distinct k-word shingles (words are split at white space, A-Z lower-cased);
passages of fewer than k words have none and link with nothing. Equal sets are one class, found by a
digest. Classes of so many shingles that a different set can be near enough get the keys of band_count()
bands of ROWS MinHashes each: a pair at the asked similarity shares a key with probability RECALL or more.
Classes that share a key are compared exactly, and components of the links are clusters. Of each cluster
the first passage is kept (smallest doc_id, then position), every later one is a repeat.

A stretch of neighbouring repeats is removed if it has `least` words or more; passages too short to be
compared belong to it where they stand between two repeats. Shorter stretches stay, so a common line
or heading is no reason to cut a text: a passage of at least 2 * SPREAD + `least` + 20 or so words goes
(but for the words at its ends), one of fewer than 2 * SPREAD + `least` inside a line never does.

Null texts have no passages and stay null; so do empty ones. Identical repeated rows count as one
document and get a row each; rows of one doc_id with different texts are documents of their own, in the
order of a hash of the text. A null doc_id comes before all others. Texts of any length are cut whole.
An empty table gives an empty one. Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import only, saved, with_text_key
from .linker import digests, link, parity_sketch, verified
from .textkit import SPACED, chunks, distinct, mix, shingles, signed, sliding_least, taken, words

SPREAD = 6
ROWS, RECALL = 2, 0.98
LEAST_WORDS = 24
NO_ID = -(1 << 63)


def band_count(num: int, den: int) -> int:
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - (num / den) ** ROWS))) if num < den else 1


def least_set(num: int, den: int) -> int:
    """Members of the smallest set that a different one can be near enough to."""
    return -(-den // (den - num)) - 1 if num < den else 1 << 62


@dataclass
class Passages:
    """The passages of a run of texts that begins at `row`: owner (text), position in it, bounds in its bytes, words, and the sets of `some`."""

    row: int
    owner: np.ndarray
    position: np.ndarray
    start: np.ndarray
    end: np.ndarray
    size: np.ndarray
    some: np.ndarray
    sets: np.ndarray
    at: np.ndarray


def cut_points(hashes: np.ndarray, first: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Words before which a line is cut; first[l] to first[l + 1]: the words of line l."""
    h = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    i = np.arange(spread, max(spread, len(h) - spread))
    if not len(i):
        return i
    least = sliding_least(h, spread)
    line = np.searchsorted(first, i, "right") - 1
    inside = (i - first[line] >= spread) & (first[line + 1] - 1 - i > spread)
    return i[inside & (h[i] < least[i - spread]) & (h[i] <= least[i + 1])]


def passages(column: pa.Array, k: int):
    for row, data, offs in chunks(column):
        lines = np.unique(np.concatenate([offs, np.flatnonzero(data == 10) + 1]))
        w = words(data, lines, SPACED)
        first = np.unique(np.concatenate([w.first, cut_points(w.hash, w.first)]))
        size = np.diff(first)
        start = w.start[first[:-1]]
        owner = np.searchsorted(offs, start, "right") - 1
        position = np.arange(len(owner)) - np.searchsorted(owner, owner)
        end = np.append(start[1:], len(data))
        end = np.where(np.append(owner[1:], -1) == owner, end, offs[owner + 1])
        some = np.flatnonzero(size >= k)
        sets, at = distinct(*taken(*shingles(replace(w, first=first), k), some))
        yield Passages(row, owner, position, start - offs[owner], end - offs[owner], size, some, sets, at)


def occurrences(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, same, position, id) of every passage with k words or more."""

    def run(batches):
        for b in batches:
            ids, same = (b.column(c).to_numpy() for c in ("doc_id", "same"))
            for p in passages(b.column("text"), k):
                of = p.row + p.owner[p.some]
                cols = [ids[of], same[of], p.position[p.some].astype(np.int32), signed(digests(p.sets, p.at))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "same", "position", "id"])

    return docs.mapInArrow(run, "doc_id long, same long, position int, id long")


def once_each(p: Passages, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, sets, at) of the sets large enough for near copies, each once."""
    digest = digests(p.sets, p.at)
    _, once = np.unique(digest, return_index=True)
    once = np.sort(once[np.diff(p.at)[once] >= least])
    return (digest[once], *taken(p.sets, p.at, once))


def band_keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, id): the buckets of every class."""
    bands, least = band_count(num, den), least_set(num, den)

    def run(batches):
        for b in batches:
            for p in passages(b.column("text"), k):
                ids, sets, at = once_each(p, least)
                if not len(ids):
                    continue
                keys = []
                for band in range(bands):
                    key = np.full(len(ids), np.uint64(band))
                    for j in range(ROWS):
                        seed = np.uint64(pow(0xBF58476D1CE4E5B9, band * ROWS + j + 2, 1 << 64))
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(sets ^ seed), at[:-1]))
                    keys.append(key)
                cols = [signed(np.concatenate(keys)), signed(np.tile(ids, bands))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def set_table(docs: DataFrame, k: int, least: int) -> DataFrame:
    """(id, members) of the classes with `least` shingles or more, each once for each run of texts."""

    def run(batches):
        for b in batches:
            for p in passages(b.column("text"), k):
                ids, sets, at = once_each(p, least)
                members = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), members], ["id", "members"])

    return docs.select("text").mapInArrow(run, "id long, members array<long>")


def with_sketch(sets: DataFrame) -> DataFrame:
    """(id, members, n, sketch)."""

    def run(batches):
        for b in batches:
            members = b.column("members")
            at = members.offsets.to_numpy().astype(np.int64)
            sketch = parity_sketch(members.values.to_numpy().view(np.uint64)[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(at)), pa.array(sketch, pa.binary())], [*b.schema.names, "n", "sketch"])

    return sets.select("id", "members").mapInArrow(run, "id long, members array<long>, n long, sketch binary")


def repeats(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, same, repeated): positions of the passages that repeat an earlier one, by document."""
    known = saved(occurrences(docs, k))

    def classes_of(ids: DataFrame) -> DataFrame:
        return saved(with_sketch(only(set_table(docs, k, least_set(num, den)), ids, "id").dropDuplicates(["id"])))

    def verify(pairs: DataFrame, classes: DataFrame) -> DataFrame:
        return verified(pairs, classes.select("id", "members"), num, den)

    found = link(band_keys(docs, k, num, den), classes_of, verify, num, den, share=1)
    where = F.struct("doc_id", "same", "position")
    own = known.groupBy("id").agg(F.min(where).alias("first"), F.count("*").alias("times"))
    own = own.join(found, "id", "left").filter("times > 1 or component is not null")
    own = saved(own.withColumn("component", F.coalesce("component", "id")))
    keep = own.groupBy("component").agg(F.min("first").alias("keep"))
    later = known.join(own.join(keep, "component").select("id", "keep"), "id").filter(where != F.col("keep"))
    return later.groupBy("doc_id", "same").agg(F.collect_set("position").alias("repeated"))


def stretches(repeat: np.ndarray, size: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Runs (first, behind last) of passages that begin and end in a repeat, hold only repeats and short ones, and have `least` words or more."""
    out, a, b, n = [], -1, -1, 0

    def close():
        if a >= 0 and size[a:b].sum() >= least:
            out.append((a, b))

    for n in np.flatnonzero(repeat).tolist():
        if a >= 0 and (size[b:n] < k).all():
            b = n + 1
        else:
            close()
            a, b = n, n + 1
    close()
    return out


def cut(docs: DataFrame, k: int, least: int) -> DataFrame:
    """(doc_id, n_removed, removed, text) of documents with repeats (array of positions)."""

    def run(batches):
        for b in batches:
            ids, texts, listed = (b.column(c).to_pylist() for c in ("doc_id", "text", "repeated"))
            rows = []
            for p in passages(b.column("text"), k):
                bounds = np.searchsorted(p.owner, np.arange(p.owner[-1] + 2 if len(p.owner) else 0))
                for d in range(len(bounds) - 1):
                    x, y = bounds[d], bounds[d + 1]
                    r = p.row + d
                    repeat = np.zeros(y - x, bool)
                    repeat[listed[r]] = True
                    found = stretches(repeat, p.size[x:y], k, least)
                    spans = [(int(p.start[x + i]), int(p.end[x + j - 1])) for i, j in found]
                    data, out, at = (texts[r] or "").encode(), [], 0
                    for s, e in spans:
                        out.append(data[at:s])
                        at = e
                    gone = sum(j - i for i, j in found)
                    rows.append((ids[r], gone, [{"start": s, "end": e} for s, e in spans], (b"".join(out) + data[at:]).decode()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_removed", "removed", "text"])

    schema = "doc_id long, n_removed long, removed array<struct<start: long, end: long>>, text string"
    return docs.select("doc_id", "text", "repeated").mapInArrow(run, schema)


def paragraph_dedup(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, least: int = LEAST_WORDS) -> DataFrame:
    """Per document: doc_id, n_removed (passages), removed (their stretches, as bytes of the text), text (what stays)."""
    docs, _ = with_text_key(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"))
    found = saved(repeats(docs, k, num, den))
    ids, key = found.select("doc_id", "same"), ["doc_id", "same"]
    some = cut(only(docs, ids, key).join(found, key), k, least)
    rest = only(docs, ids, key, anti=True)
    rest = rest.select("doc_id", F.lit(0).cast("long").alias("n_removed"), F.array().cast(some.schema["removed"].dataType).alias("removed"), "text")
    return some.unionByName(rest).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
