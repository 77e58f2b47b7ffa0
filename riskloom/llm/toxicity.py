"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Every letter (byte) of a word is predicted from the five before it in the word. Two models have the
top order to themselves: one counts toxic, the other ordinary training rows. All lower orders are
shared by both: continuation counts (of distinct letters to the left), gathered over the words of
all documents, with absolute discounts and interpolation down to single letters. A spelling rare in
both classes thus gets the same backoff probability from both, and says nothing.

A word's score is the difference of the two log-likelihoods over its length in letters. A document
is scored by its highest word, its second highest, and the mean over all its letters, put together
by a logistic regression.

Labels are learned from at most FIT_ROWS rows a class (those whose hashed doc_id is smallest) for
the counts and CALIBRATION_ROWS others for the regression; backoff counts cover every document. In the
regression a row weighs as many labels as it stands for, so that the classes keep their share.
Neither labels, doc_id, lang nor source are inputs of a score.

Null and empty texts, and texts without letters, get the score of all-zero inputs. Without training
rows of both classes every score is 0. Rows of labels with a null are not used; of repeated labels the
largest is. Repeated documents each get a row and count each time. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import saved
from .textkit import LOWER, chunks, words

ORDER = 6
DISCOUNT = 0.75
#: Bounds of what is learned from labelled rows.
FIT_ROWS = 20_000
CALIBRATION_ROWS = 8_000

LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every letter with the five before it in its word (spaces before the word), as 48-bit numbers; word starts."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], size)
    at = np.repeat(start, size) + nth
    out = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        out |= np.where(nth >= j, data[np.maximum(at - j, 0)], 32).astype(np.int64) << (8 * j)
    return out, first


def summed(key: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    out, at = np.unique(key, return_inverse=True)
    return [out, *(np.bincount(at, c, len(out)).astype(np.int64) for c in counts)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(g, tox, ord): every gram of the documents, and its counts in rows whose cls is 1 and 0."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        for b in batches:
            cls = b.column("cls").fill_null(-1).to_numpy(zero_copy_only=False)
            for row, data, offs in chunks(b.column("text")):
                w = words(data, offs, LETTERS)
                h, once, back = np.unique(w.hash, return_index=True, return_inverse=True)
                own = cls[row + w.doc]
                g, first = grams(LOWER[data], w.start[once], w.end[once])
                size = np.diff(first)
                tox, rest = (np.repeat(np.bincount(back, own == c, len(h)), size) for c in (1, 0))
                held.append(summed(g, tox, rest))
                if len(held) > 8:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            g, tox, rest = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (g, tox, rest)], ["g", "tox", "ord"])

    each = docs.select("text", "cls").mapInArrow(run, "g long, tox long, ord long")
    return each.groupBy("g").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def cut(g: str, letters: int) -> Column:
    """The last letters of a gram."""
    return F.col(g).bitwiseAND(F.lit((1 << 8 * letters) - 1))


def backoff(counts: DataFrame) -> DataFrame:
    """(s, p): the shared probability of the last letter of every five-letter ending of a gram.

    The levels are saved: each is used twice, so a plan of all of them would hold the upper ones again and again.
    """
    levels = {ORDER - 1: saved(counts.select(cut("g", ORDER - 1).alias("s")).groupBy("s").agg(F.count("*").alias("c")))}
    for k in range(ORDER - 2, 0, -1):
        levels[k] = saved(levels[k + 1].select(cut("s", k).alias("s")).groupBy("s").agg(F.count("*").alias("c")))
    p = None
    for k in range(1, ORDER):
        here = levels[k].withColumn("h", F.shiftright("s", 8))
        of = here.groupBy("h").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
        here = here.join(of, "h")
        if p is None:
            lower, join = F.lit(1 / 256), here
        else:
            join = here.withColumn("b", cut("s", k - 1)).join(p.select(F.col("s").alias("b"), F.col("p").alias("lower")), "b")
            lower = F.col("lower")
        value = (F.col("c") - DISCOUNT) / F.col("n") + DISCOUNT * F.col("kinds") / F.col("n") * lower
        p = join.select("s", value.alias("p"))
    return p


@dataclass
class Scorer:
    """Sorted grams and contexts with their log-likelihood differences, and the regression's weights."""

    g: np.ndarray
    g_score: np.ndarray
    h: np.ndarray
    h_score: np.ndarray
    weights: np.ndarray | None = None

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.h, keys >> 8), len(self.h) - 1)
        np.copyto(out, self.h_score[at], where=self.h[at] == keys >> 8)
        at = np.minimum(np.searchsorted(self.g, keys), len(self.g) - 1)
        np.copyto(out, self.g_score[at], where=self.g[at] == keys)
        return out

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """By document: highest and second highest distinct word, and mean over letters."""
        docs = len(offs) - 1
        out = np.zeros((docs, 3))
        w = words(data, offs, LETTERS)
        if not len(w.hash) or not len(self.g):
            return out
        _, once, back = np.unique(w.hash, return_index=True, return_inverse=True)
        g, first = grams(LOWER[data], w.start[once], w.end[once])
        total = np.add.reduceat(self.of(g), first[:-1])
        size = np.diff(first)
        score = (total / (size + 2.0))[back]  # two more letters: a word of few letters says less
        some = np.flatnonzero(np.diff(w.first))
        at = w.first[some]
        out[some, 0] = np.maximum.reduceat(score, at)
        below = np.where(score < np.repeat(out[:, 0], np.diff(w.first)), score, 0.0)
        out[some, 1] = np.maximum.reduceat(below, at)
        out[some, 2] = np.add.reduceat(total[back], at) / np.add.reduceat(size[back], at)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, stands_for: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method, intercept first. stands_for: the weight of each row."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (stands_for * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (stands_for * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, cls, part, stands_for) of the rows to learn from: part "fit" or "calibrate"; bounded by the constants.

    stands_for: labels of the part and class over rows taken of them.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("cls"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("r", F.xxhash64("doc_id", F.lit("toxicity")))
    out = []
    for part, most, mine in (("fit", FIT_ROWS, F.pmod("r", F.lit(4)) > 0), ("calibrate", CALIBRATION_ROWS // 2, F.pmod("r", F.lit(4)) == 0)):
        for c in (0, 1):
            own = known.filter(mine & (F.col("cls") == c))
            share = own.agg(F.greatest(F.count("*") / most, F.lit(1.0)).alias("stands_for"))
            rows = own.orderBy("r", "doc_id").limit(most).join(F.broadcast(share))
            out.append(rows.select("doc_id", F.col("cls").cast("int").alias("cls"), F.lit(part).alias("part"), "stands_for"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def by_key(df: DataFrame) -> list[np.ndarray]:
    """The columns of (key, value) by ascending key; they come to the driver as Arrow, a few bytes a row."""
    key, value = (c.to_numpy() for c in df.toArrow().columns)
    order = np.argsort(key)
    return [key[order], value[order]]


def fitted(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows = saved(training(labels))  # 48,000 rows at most
    mine = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id", "left")
    cls = F.when(F.col("part") == "fit", F.col("cls"))
    counts = saved(gram_counts(mine.withColumn("cls", cls)))
    seen = counts.filter("tox + ord > 0").withColumn("h", F.shiftright("g", 8))
    of = seen.groupBy("h").agg(*[f(F.when(F.col(c) > 0, F.col(c))).alias(f"{c}_{n}") for c in ("tox", "ord") for n, f in (("n", F.sum), ("kinds", F.count))])
    weight = {c: F.when(F.col(f"{c}_n") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0) for c in ("tox", "ord")}
    of = saved(of.select("h", "tox_n", "ord_n", weight["tox"].alias("tox_w"), weight["ord"].alias("ord_w")))
    joined = seen.join(of, "h").withColumn("s", cut("g", ORDER - 1)).join(backoff(counts), "s")
    p = {c: F.when(F.col(c) > 0, (F.col(c) - DISCOUNT) / F.col(f"{c}_n")).otherwise(0.0) + F.col(f"{c}_w") * F.col("p") for c in ("tox", "ord")}
    # bounded by FIT_ROWS: grams of the fitted rows alone
    g, g_score = by_key(joined.select("g", (F.log(p["tox"]) - F.log(p["ord"])).cast("float").alias("v")))
    h, h_score = by_key(of.select("h", (F.log("tox_w") - F.log("ord_w")).cast("float").alias("v")))
    scorer = Scorer(g, g_score, h, h_score)
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows.filter("part = 'calibrate'")), "doc_id")
    known = features(chosen, scorer, "cls int").toArrow()
    cls = known.column("cls").to_numpy()
    if len(g) and len(np.unique(cls)) == 2:
        share = {r["cls"]: r["stands_for"] for r in rows.filter("part = 'calibrate'").select("cls", "stands_for").distinct().collect()}
        x = np.column_stack([known.column(c).to_numpy() for c in "abc"])
        scorer.weights = logistic(x, cls, np.where(cls == 1, share[1], share[0]))
    return scorer


def features(docs: DataFrame, scorer: Scorer, keep: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    name = keep.split()[0]

    def run(batches):
        for b in batches:
            for row, data, offs in chunks(b.column("text")):
                x = shared.value.features(data, offs)
                own = b.column(name).slice(row, len(x))
                cols = [own, *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(3)), pa.array(shared.value.score(x))]
                yield pa.RecordBatch.from_arrays(cols, [name, "a", "b", "c", "score"])

    return docs.select(name, "text").mapInArrow(run, f"{keep}, a double, b double, c double, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = features(docs, fitted(docs, labels), "doc_id long")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns stay."""
    scorer = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for b in batches:
            keep = [scorer.value.score(scorer.value.features(data, offs)) < 0.5 for _, data, offs in chunks(b.column("text"))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
