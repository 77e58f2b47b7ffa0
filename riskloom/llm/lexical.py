"""Ranked lexical search by WAND over shards of documents.

Terms are runs of digits, letters (A to Z lower-cased, no other) and characters beyond ASCII. A term's weight is
floor(1000 ln((2N+2)/(2df+1))); a document's score sums w ((10^9 tf) div (1000 tf + 8m)) over the item's terms,
each once, with m = 100 - 90 + (90 n N) div L; all but the logarithm is in 64-bit integers.

One pass counts N, L and the documents of every term that an item asks for. The second lays each task's documents
out in shards of SHARD_WORDS words: an inverted index of the items' terms, in which every posting carries its
impact (its exact share of the score) and every term its largest. Each item walks a shard by WAND: with its terms
in the order of their next documents, the pivot is the first at which the sum of the largest impacts beats the
item's threshold; documents before it are skipped, the pivot is scored, and a full heap lifts the threshold.
All items of a block walk a shard in step, as rows of arrays. Thresholds pass from shard to shard in a task; the heaps of
tasks are merged in two steps (by part of the tasks, then all), each with at most k rows an item and part.

Items come in blocks of about ITEM_TERMS terms, each broadcast for a search of its own; the block of an item is
given by a hash of its id. Rows of one item_id are one item with the terms of all; an item without
known terms has no rows, nor has one without a document of a score above 0. Null texts have no terms. A null
item_id is an item like others; each row of documents is a document, whatever its doc_id, and null doc_ids come last
among equal scores. Equal scores rank by doc_id; equal rows of one doc_id take a rank each. Texts of any length are taken
whole. Empty tables give an empty one. Other columns are ignored whatever their names. Terms are told apart
by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved
from .textkit import chunks, words

K = 10
SHARD_WORDS = 400_000
ITEM_TERMS = 100_000
#: Places of a (item, term) table that walk in step.
CELLS = 1 << 18
LAST = np.int64(1) << 40

TERM = np.zeros(256, dtype=bool)
TERM[48:58] = TERM[97:123] = True
TERM[128:] = True


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of each item that has any."""

    def run(batches):
        for b in batches:
            for row, data, offs in chunks(b.column("text")):
                w = words(data, offs, TERM)
                terms = [np.unique(w.hash[i:j]).view(np.int64) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(row, len(terms)), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    each = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<long>")
    return each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).filter("size(terms) > 0")


@dataclass
class Asked:
    """A block of items: its distinct terms in order, and a table of each item's terms as places among them (-1: none)."""

    term: np.ndarray
    of: np.ndarray

    @classmethod
    def of_items(cls, terms: list[np.ndarray]) -> Asked:
        term = np.unique(np.concatenate(terms).astype(np.int64).view(np.uint64))
        of = np.full((len(terms), max(map(len, terms))), -1)
        for i, t in enumerate(terms):
            of[i, : len(t)] = np.searchsorted(term, np.asarray(t, np.int64).view(np.uint64))
        return cls(term, of)

    def postings(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(term, text, tf) of a run of texts, by term and text, and each text's number of words."""
        w = words(data, offs, TERM)
        at = np.minimum(np.searchsorted(self.term, w.hash), len(self.term) - 1)
        own = self.term[at] == w.hash
        key, tf = np.unique(at[own] * (len(offs) - 1) + w.doc[own], return_counts=True)
        return key // (len(offs) - 1), key % (len(offs) - 1), tf, np.diff(w.first)


def counted(docs: DataFrame, asked: Asked) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each term."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        a = shared.value
        df, total = np.zeros(len(a.term), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for _, data, offs in chunks(b.column("text")):
                term, _, _, n = a.postings(data, offs)
                df += np.bincount(term, minlength=len(df))
                total += (n > 0).sum(), n.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([total, df[some]]))], ["term", "n"])

    df = np.zeros(len(asked.term) + 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        df[r.term] = r.n
    return int(df[-1]), int(df[-2]), df[:-2]


@dataclass
class Shard:
    """Postings by term: first[t] to first[t + 1] have the places of term t's documents and their impacts."""

    first: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    most: np.ndarray
    key: np.ndarray

    @classmethod
    def of_postings(cls, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: np.ndarray, count: int, length: int) -> Shard:
        m = 10 + (90 * n.astype(np.int64) * count) // max(length, 1)
        tf = tf.astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        first = np.searchsorted(term, np.arange(len(weight) + 1))
        most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            most[some] = np.maximum.reduceat(impact, first[:-1][some])
        pad = lambda x, v: np.append(x, v)  # noqa: E731  a place past the last posting
        return cls(first, pad(doc, LAST), pad(impact, 0), most, term * LAST + doc)

    def walk(self, of: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item (a row of `of`), its k best documents with scores above the floor: (scores, places), -1 where there is none."""
        items, width = of.shape
        none = of < 0
        term = np.maximum(of, 0)
        stop = np.where(none, 0, self.first[term + 1])
        at = np.where(none, 0, self.first[term])
        most = np.where(none, 0, self.most[term])
        score, place = np.full((items, k), -1), np.full((items, k), -1)
        bar = floor.copy()
        lane = np.arange(items)
        while len(lane):
            rows = np.arange(len(lane))
            doc = np.where(at < stop, self.doc[at], LAST)
            order = np.argsort(doc, axis=1)
            reach = np.cumsum(np.take_along_axis(most, order, 1), axis=1) > bar[:, None]
            pivot_at = reach.argmax(axis=1)
            pivot = doc[rows, order[rows, pivot_at]]
            on = reach[rows, pivot_at] & (pivot < LAST)
            if not on.all():
                lane, term, stop, at, most, bar, doc, pivot = (x[on] for x in (lane, term, stop, at, most, bar, doc, pivot))
                rows = np.arange(len(lane))
                if not len(lane):
                    break
            r, c = np.nonzero(doc < pivot[:, None])  # skip to the pivot
            at[r, c] = np.searchsorted(self.key, term[r, c] * LAST + pivot[r])
            here = (at < stop) & (self.doc[np.minimum(at, len(self.doc) - 1)] == pivot[:, None])
            got = np.where(here, self.impact[at], 0).sum(axis=1)
            at += here
            won = np.flatnonzero(got > bar)
            if len(won):
                mine = lane[won]
                worst = k - 1 - score[mine][:, ::-1].argmin(axis=1)  # of equal scores the last
                score[mine, worst] = got[won]
                place[mine, worst] = pivot[won]
                # the heap keeps its order: earlier documents stand first among equals
                by = np.argsort(-score[mine], axis=1, kind="stable")
                score[mine], place[mine] = np.take_along_axis(score[mine], by, 1), np.take_along_axis(place[mine], by, 1)
                bar[won] = np.maximum(bar[won], score[mine, k - 1])
        return score, place


def heaps(docs: DataFrame, asked: Asked, weight: np.ndarray, count: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): for each task and item the k best of the task's documents; item: a row of asked.of."""
    shared = docs.sparkSession.sparkContext.broadcast((asked, weight))

    def run(batches):
        a, w = shared.value
        items = len(a.of)
        best, best_id, best_null = np.full((items, k), 0), np.full((items, k), 0), np.ones((items, k), bool)
        held, ids, size = [], [], 0

        def searched():
            doc_id = pa.concat_arrays(ids)
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            doc_id = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            place = np.empty(len(doc_id), np.int64)
            by = np.lexsort((doc_id, null))
            place[by] = np.arange(len(by))  # documents stand by id
            starts = np.cumsum([0, *(len(x[3]) for x in held)])
            term, doc, tf = (np.concatenate(x) for x in zip(*((t, place[d + s], f) for (t, d, f, _), s in zip(held, starts, strict=False)), strict=True))
            n = np.empty(len(by), np.int64)
            n[place] = np.concatenate([x[3] for x in held])
            order = np.lexsort((doc, term))
            shard = Shard.of_postings(term[order], doc[order], tf[order], n, w, count, length)
            floor = np.maximum(best[:, k - 1] - 1, 0)  # an equal score may win by a smaller id
            for i in range(0, items, max(1, CELLS // a.of.shape[1])):
                some = slice(i, i + max(1, CELLS // a.of.shape[1]))
                score, at = shard.walk(a.of[some], k, floor[some])
                none = at < 0
                score, at = np.where(none, 0, score), by[np.where(none, 0, at)]
                both = np.concatenate([best[some], score], axis=1)
                both_id = np.concatenate([best_id[some], doc_id[at]], axis=1)
                both_null = np.concatenate([best_null[some], null[at] | none], axis=1)
                top = np.lexsort((both_id, both_null, -both), axis=1)[:, :k]
                best[some], best_id[some], best_null[some] = (np.take_along_axis(x, top, 1) for x in (both, both_id, both_null))

        for b in batches:
            for row, data, offs in chunks(b.column("text")):
                held.append(a.postings(data, offs))
                ids.append(b.column("doc_id").slice(row, len(offs) - 1))
                size += int(held[-1][3].sum())
                if size >= SHARD_WORDS:
                    searched()
                    held, ids, size = [], [], 0
        if held:
            searched()
        i, j = np.nonzero(best > 0)
        doc_id = pa.array(best_id[i, j], mask=best_null[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(i), doc_id, pa.array(best[i, j])], ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    asked = saved(item_terms(items))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about ITEM_TERMS terms
        if not own:
            continue
        one = Asked.of_items([r.terms for r in own])
        count, length, df = counted(docs, one)
        weight = np.where(df > 0, np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))), 0).astype(np.int64)
        best = heaps(docs, one, weight, count, length, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = Window.partitionBy("item", "part").orderBy(*order)
        best = best.withColumn("part", F.spark_partition_id() % F.lit(64)).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "item long, item_id long")
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
