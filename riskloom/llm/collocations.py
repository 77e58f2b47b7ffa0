"""Phrase collocations: phrases of two and three words that are bound together, by language.

Texts are lower-cased (A to Z), split into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.

1. Every word of a language is counted (tasks count first), which gives the dictionary: the words that occur
   `least` times or more, numbered by language. No phrase with another word can occur so often, so these break
   a piece.
2. Each place gives one fixed-width key: its word's number and the next two, 21 bits each, 0 after a break. Two
   words are the upper part of the key, so one sorted pass counts both lengths. Tasks count their keys first.
3. Keys are dealt to ranges, each sorted (Spark's radix sort of longs) and its runs counted. The ranges follow
   from the dictionary's counts: a key's place is the share of words below its first one, plus its first one's share
   times that below the second. A frequent first word is so dealt to many ranges; no two words are cut apart.
4. The counts of a phrase's parts are joined to it, and phrases inside a longer one that is half as frequent go.

The dictionary is broadcast up to MOST_WORDS words (21 bits; about 60 MB), counted before. Beyond it phrases are
counted as text by groupBy, slower, with the same result.

n counts all words of the language. A candidate's cut after k words gives a*a/(l*r); the lowest counts, and the smallest k
of equal ones. Scores are computed in 38-digit decimals: exact up to a count of 10^15. Equal scores rank by count, then by
the phrase's bytes. Null texts are empty; a null lang is `und`, and joins documents whose lang is that. Repeated rows count
each time; texts of any length are read whole; an empty table gives an empty one; doc_id and other columns are ignored.
Words are told apart by a 64-bit hash when they are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written
from .textkit import chunks, mix, words

BITS = 21
MOST_WORDS = (1 << BITS) - 1
LOW = np.int64(MOST_WORDS)
#: Words or keys that a task counts at a time, and places a range holds.
HELD = 4_000_000
RANGE = 8_000_000

BREAK = np.zeros(256, dtype=bool)
BREAK[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
WORD = ~BREAK
WORD[[32, 9]] = False


def tallied(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts, and a place of each."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[order][head], np.add.reduceat(count[order], head) if len(head) else count[:0], order[head]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, c) of every word."""

    def run(batches):
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).combine_chunks()
            return t.group_by(["lang", "word"]).aggregate([("c", "sum")]).rename_columns(["lang", "word", "c"])

        size = 0
        for b in batches:
            lang = pc.dictionary_encode(b.column("lang"))
            of = lang.indices.to_numpy(zero_copy_only=False)
            for row, data, offs in chunks(b.column("text")):
                w = words(data, offs, WORD)
                own = of[row + w.doc]
                _, c, at = tallied(mix(w.hash ^ mix(own.astype(np.uint64))), np.ones(len(own), np.int64))
                data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
                text = sliced(data, w.start[at], w.end[at])
                held.append(pa.table({"lang": lang.dictionary.take(pa.array(own[at])), "word": text, "c": c}))
                size += len(c)
                if size > HELD // 4:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > HELD // 8:
                        yield from held[0].to_batches(max_chunksize=100_000)
                        held, size = [], 0
        if held:
            yield from merged().to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of bytes as texts."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.tobytes()), pa.py_buffer(data[at].tobytes()))


class Dictionary:
    """Numbers, from 1, of the frequent words by language, and their shares of all frequent words."""

    def __init__(self, frequent: pa.Table):
        frequent = frequent.sort_by([("lang", "ascending"), ("word", "ascending")])
        self.lang, self.word = (frequent.column(c).combine_chunks().cast(pa.string()) for c in ("lang", "word"))
        self.langs = pc.unique(self.lang)
        size = frequent.column("c").to_numpy().astype(float)
        self.share = np.concatenate([[0.0], size / max(size.sum(), 1)])
        self.below = np.concatenate([[0.0], np.cumsum(self.share)[:-1]])
        self.places = int(size.sum())
        hashes = []
        for _, data, offs in chunks(self.word):
            w = words(data, offs, np.ones(256, bool), lower=False)
            hashes.append(w.hash)
        key = self.keys(pc.index_in(self.lang, self.langs).to_numpy(), np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        order = np.argsort(key)
        self.key, self.number = key[order], order + 1

    @staticmethod
    def keys(lang: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes + mix(lang.astype(np.uint64) + np.uint64(1)))

    def numbers(self, lang: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words; 0 for those not in the dictionary. lang: places in langs, or -1."""
        key = self.keys(np.maximum(lang, 0), hashes)
        order = np.argsort(key)  # in order, lookups stay near each other
        at = np.empty(len(key), np.int64)
        at[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
        return np.where((self.key[at] == key) & (lang >= 0), self.number[at], 0)

    def ranges(self, key: np.ndarray, count: int) -> np.ndarray:
        """The range of each key, rising with the key; keys of the same two words share one."""
        one, two = key >> (2 * BITS), (key >> BITS) & LOW
        return np.minimum(((self.below[one] + self.share[one] * self.below[two]) * count).astype(np.int32), count - 1)


def keys(docs: DataFrame, shared, count: int) -> DataFrame:
    """(range, key, c): the counted keys of places whose next word is frequent too."""

    def run(batches):
        d: Dictionary = shared.value
        held, size = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            key, c, _ = tallied(*(np.concatenate(x) for x in zip(*held, strict=True)))
            at = d.ranges(key, count)
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (at, key, c)], ["range", "key", "c"])

        for b in batches:
            lang = pc.fill_null(pc.index_in(b.column("lang"), d.langs), -1).to_numpy(zero_copy_only=False)
            for row, data, offs in chunks(b.column("text")):
                w = words(data, offs, WORD)
                n = d.numbers(lang[row + w.doc], w.hash)
                piece = np.concatenate([[0], np.cumsum(BREAK[data])])[w.start]
                on = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
                two = np.where(on, n[1:], 0)
                three = np.zeros(len(two), np.int64)
                three[:-1] = np.where(two[:-1] > 0, two[1:], 0)
                key = (n[:-1] << (2 * BITS)) | (two << BITS) | three
                key = np.sort(key[(n[:-1] > 0) & (two > 0)])
                held.append(tallied(key, np.ones(len(key), np.int64))[:2])
                size += len(held[-1][0])
                if size > HELD:
                    yield from merged()
                    held, size = [], 0
        if held:
            yield from merged()

    return docs.mapInArrow(run, "range int, key long, c long")


def runs(sorted_keys: DataFrame, shared, least: int) -> DataFrame:
    """(lang, w1, w2, w3, a) of the phrases that occur `least` times or more; w3 is null for two words. Each range comes sorted."""

    def run(batches):
        d: Dictionary = shared.value
        key, c = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told(key: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for shift in (BITS, 0):
                k, a, _ = tallied(key >> shift << shift, c)
                some = (a >= least) & ((k & LOW > 0) if shift == 0 else True)
                k, a = k[some], a[some]
                one, two, three = k >> (2 * BITS), (k >> BITS) & LOW, k & LOW
                texts = [d.word.take(pa.array(one - 1)), d.word.take(pa.array(two - 1)), d.word.take(pa.array(three - 1, mask=three == 0))]
                yield pa.RecordBatch.from_arrays([d.lang.take(pa.array(one - 1)), *texts, pa.array(a)], ["lang", "w1", "w2", "w3", "a"])

        for b in batches:
            key, c = (np.concatenate([x, b.column(n).to_numpy()]) for x, n in ((key, "key"), (c, "c")))
            if len(key) > HELD // 8:
                cut = int(np.searchsorted(key, key[-1] >> BITS << BITS))  # the last two words may go on
                yield from told(key[:cut], c[:cut])
                key, c, _ = tallied(key[cut:], c[cut:])
        yield from told(key, c)

    return sorted_keys.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, a long")


def phrases(docs: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """The phrases by the dictionary's numbers."""
    spark = docs.sparkSession
    d = Dictionary(frequent.toArrow())  # MOST_WORDS words at most
    shared = spark.sparkContext.broadcast(d)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.places // RANGE + 1)
    dealt = keys(docs, shared, count).repartitionById(count, F.col("range")).sortWithinPartitions("key")
    return runs(dealt.select("key", "c"), shared, least)


def phrases_as_text(docs: DataFrame, least: int) -> DataFrame:
    """The same without a dictionary: each phrase is counted as its words."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = docs.select("lang", F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    w = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0)).alias("w"))
    at = w.filter("size(w) > 1").select("lang", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    three = F.when(F.col("i") + 2 <= F.size("w"), F.get("w", F.col("i") + 1))
    at = at.select("lang", F.get("w", F.col("i") - 1).alias("w1"), F.get("w", F.col("i")).alias("w2"), three.alias("w3"))
    each = at.withColumn("w3", F.lit(None).cast("string")).unionByName(at.filter("w3 is not null"))
    return each.groupBy("lang", "w1", "w2", "w3").agg(F.count("*").alias("a")).filter(F.col("a") >= least)


def quotient(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    over, under = (f"cast({x} as decimal(16,0)) * cast({y} as decimal(16,0))" for x, y in ((a, a), (left, right)))
    return F.expr(f"cast({over} as decimal(31,0)) * cast(1000000 as decimal(7,0)) div ({under})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases that occur `least` times or more.

    A phrase goes if a longer candidate around it has share percent of its occurrences or more.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = written(word_counts(docs))
    n = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = counts.filter(F.col("c") >= least)
    found = written(phrases(docs, frequent, least) if frequent.count() <= MOST_WORDS else phrases_as_text(docs, least))
    two, three = found.filter("w3 is null").drop("w3"), found.filter("w3 is not null")
    one = lambda w, c: frequent.select("lang", F.col("word").alias(w), F.col("c").alias(c))
    pair = lambda x, y, c: two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(c))
    inside = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    short = two.join(longer, ["lang", "w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    short = short.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", quotient("a", "l", "r").alias("score"))
    three = three.join(one("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
    three = three.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(one("w3", "r2"), ["lang", "w3"])
    cuts = [F.struct(quotient("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(*cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = short.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(F.broadcast(n), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM t),
f1 AS (SELECT lang, w1 AS g, count(*) AS a FROM x GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS g, count(*) AS a FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS g, count(*) AS a FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT lang, g, w1 AS one, w2 AS rest, a, 1 AS k FROM f2
  UNION ALL SELECT lang, g, w1, w2 || ' ' || w3, a, 1 FROM f3
  UNION ALL SELECT lang, g, w1 || ' ' || w2, w3, a, 2 FROM f3),
f AS (SELECT lang, g, a FROM f1 UNION ALL SELECT lang, g, a FROM f2),
scored AS (
  SELECT cuts.lang, cuts.g, cuts.a, k, l.a AS l, r.a AS r, CAST((1000000 * cuts.a::HUGEINT * cuts.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = one JOIN f r ON r.lang = cuts.lang AND r.g = rest),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
longer AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS g, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3) GROUP BY lang, g),
kept AS (SELECT cut.* FROM cut LEFT JOIN longer USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
