"""Language identification in two steps: the language family, then support vector machines for each two languages of it.

A text is its frequencies of hashed byte n-grams (one to four bytes, inside words between their borders).
Linear support vector machines (squared hinge loss, Newton's method in the primal) tell each family from the
rest; within the family that wins, one machine for each two of its languages votes, and most votes win (then the
larger sum of margins, then the smaller name). As scores are sums over n-grams, those of a distinct word
are added up once for a run of texts. The score is the family's share of the calibrated family scores times the
least calibrated probability of the winner in its votes.

FAMILIES names the family of known codes; a value of `lang` that isn't among them is a family of its own.

Machines are learned from at most FIT_ROWS texts a language (those with the smallest digests of doc_id and
text; equal rows count once), the families' from at most FAMILY_ROWS in all (one a language at least). Each machine
is fitted by a task of its own; a row for each language and one of WIDTH weights for each machine pass through
the driver, which fits some hundreds of languages.

Only rows with a lang whose crc32(doc_id as text) modulo 3 is not 1 are learned from (a null doc_id is learned from);
doc_id, lang and source are no inputs of a prediction. Null texts and texts without a letter are `und` with score 0,
as is every text where nothing could be learned. Repeated rows get a row each, an empty table gives an empty one,
texts of any length are read whole, other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved
from .textkit import LOWER, chunks, mix, words
from .toxicity import logistic

#: Bounds of what is learned from.
FIT_ROWS, FAMILY_ROWS = 1000, 2000
#: Hashed n-grams, the longest of them, and the machines' regularisation against their mean squared norm.
WIDTH, LONGEST, RIDGE = 1 << 14, 4, 0.01

#: Language families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
}

LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def family(lang: str) -> str:
    code = lang.replace("_", "-").split("-")[0].lower()
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"={lang}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with a border on both sides, and where each word's begin."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    nth = np.arange(first[-1]) - first[owner]
    inner = (nth > 0) & (nth < size[owner] - 1)
    byte = np.zeros(first[-1] + LONGEST, np.uint64)
    byte[: first[-1]][inner] = data[(start[owner] + nth - 1)[inner]]
    byte[: first[-1]][~inner] = 32
    value, out, of = np.zeros(first[-1], np.uint64), [], []
    for n in range(LONGEST):
        value = value | (byte[n : n + first[-1]] << np.uint64(8 * n + 3))
        whole = np.flatnonzero((nth + n < size[owner]) & (inner if n == 0 else True))
        out.append((mix(value[whole] | np.uint64(n)) & np.uint64(WIDTH - 1)).astype(np.int64))
        of.append(owner[whole])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(of[order], np.arange(len(size) + 1))


@dataclass
class Counted:
    """The words of a run of texts: n-grams of the distinct ones, and which one each word is."""

    gram: np.ndarray
    first: np.ndarray
    back: np.ndarray
    of: np.ndarray  # of[d] to of[d + 1]: the words of text d

    @classmethod
    def of_texts(cls, data: np.ndarray, offs: np.ndarray) -> Counted:
        w = words(data, offs, LETTERS)
        _, once, back = np.unique(w.hash, return_index=True, return_inverse=True)
        return cls(*grams(LOWER[data], w.start[once], w.end[once]), back, w.first)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The mean over a text's n-grams of their rows in weights; zeros for a text without any."""
        docs = len(self.of) - 1
        out = np.zeros((docs, weights.shape[1]))
        some = np.flatnonzero(np.diff(self.of))
        if len(some):
            by_word = np.add.reduceat(weights[self.gram], self.first[:-1], axis=0, dtype=np.float64)
            count = np.add.reduceat(np.diff(self.first)[self.back], self.of[some])
            out[some] = np.add.reduceat(by_word[self.back], self.of[some], axis=0) / count[:, None]
        return out


def sampled(docs: DataFrame) -> DataFrame:
    """(lang, h, text): at most FIT_ROWS different rows a language to learn from."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.groupBy("lang").agg((1.5 * FIT_ROWS / F.count("*")).alias("share"))  # a row for each language
    h = F.xxhash64("doc_id", "text", F.lit("language"))
    some = known.select("lang", h.alias("h"), "text").join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    once = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("nth") <= FIT_ROWS)


def frequencies(rows: DataFrame) -> DataFrame:
    """(lang, nth, gram, freq): the n-gram frequencies of texts that have any."""

    def run(batches):
        for b in batches:
            for row, data, offs in chunks(b.column("text")):
                c = Counted.of_texts(data, offs)
                gram, freq, keep = [], [], []
                for d in range(len(offs) - 1):
                    if c.of[d] < c.of[d + 1]:
                        word, n = np.unique(c.back[c.of[d] : c.of[d + 1]], return_counts=True)
                        size = c.first[word + 1] - c.first[word]
                        at = np.repeat(c.first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        total = np.bincount(c.gram[at], np.repeat(n, size), WIDTH)
                        gram.append(np.flatnonzero(total).astype(np.int32))
                        freq.append((total[gram[-1]] / total.sum()).astype(np.float32))
                        keep.append(row + d)
                if keep:
                    own = b.select(["lang", "nth"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(gram, pa.list_(pa.int32())), pa.array(freq, pa.list_(pa.float32()))], ["lang", "nth", "gram", "freq"])

    return rows.select("lang", "nth", "text").mapInArrow(run, "lang string, nth int, gram array<int>, freq array<float>")


def machine(k: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dual weights of a support vector machine with squared hinge loss; k: inner products, y: -1 or 1."""
    ridge = RIDGE * np.trace(k) / len(k)
    inside, beta = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(30):
        beta = np.zeros(len(y))
        own = np.flatnonzero(inside)
        beta[own] = np.linalg.solve(k[np.ix_(own, own)] + ridge * np.eye(len(own)), y[own])
        now = y * (k @ beta) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return beta


def fit(rows, classes: list[str], label) -> list[tuple]:
    """(class, weights, bias, slope, shift) of each of the classes against the rows of other labels."""
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (g, f) in enumerate(zip(rows.gram, rows.freq, strict=True)):
        x[i, g] = f
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    k = (x @ x.T).astype(np.float64)
    k += np.trace(k) / len(k)  # the bias
    out = []
    for c in classes:
        y = np.where(label == c, 1.0, -1.0)
        beta = machine(k, y)
        w = (x.T @ beta.astype(np.float32)) * scale
        margin = k @ beta
        shift, slope = logistic(margin[:, None], (y > 0).astype(float), np.ones(len(y)), ridge=1.0)
        bias = (np.trace(k) / len(k) / 2) * beta.sum()  # half of the trace is the bias's own
        out.append((c, w.astype(np.float32).tobytes(), float(bias), float(slope), float(shift)))
    return out


def fitted(docs: DataFrame) -> Identifier | None:
    spark = docs.sparkSession
    known = saved(frequencies(sampled(docs)))
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return None
    homes: dict[str, list[str]] = {}
    for lang in langs:
        homes.setdefault(family(lang), []).append(lang)
    each = max(1, FAMILY_ROWS // len(langs))
    plan = [(lang, "", "", each) for lang in langs] if len(homes) > 1 else []
    plan += [(lang, a, b, FIT_ROWS) for own in homes.values() for i, a in enumerate(own) for b in own[i + 1 :] for lang in (a, b)]
    found: dict[tuple[str, str], tuple] = {}
    if plan:

        def run(key, rows):
            import pandas as pd

            pair = [key[0], key[1]]
            label = rows.lang.map(family).to_numpy() if not pair[0] else rows.lang.to_numpy()
            got = fit(rows, sorted(set(label)) if not pair[0] else pair[:1], label)
            return pd.DataFrame([(*pair, *g) for g in got], columns=["a", "b", "name", "weights", "bias", "slope", "shift"])

        models = spark.createDataFrame(plan, "lang string, a string, b string, most int")
        rows = known.join(F.broadcast(models), "lang").filter(F.col("nth") <= F.col("most"))
        fits = rows.groupBy("a", "b").applyInPandas(run, "a string, b string, name string, weights binary, bias double, slope double, shift double")
        for r in fits.collect():  # a row for each machine
            found[(r.a, r.b) if r.a else ("", r.name)] = (np.frombuffer(r.weights, np.float32), r.bias, r.slope, r.shift)
    return Identifier(sorted(homes), homes, found)


@dataclass
class Identifier:
    families: list[str]
    homes: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple]

    def margins(self, c: Counted, keys: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Margins and calibrated probabilities of the texts by machine."""
        own = [self.machines[k] for k in keys]
        m = c.sums(np.stack([x[0] for x in own], axis=1)) + np.array([x[1] for x in own])
        return m, 1 / (1 + np.exp(-np.clip(m * np.array([x[2] for x in own]) + np.array([x[3] for x in own]), -30, 30)))

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and scores of the texts."""
        docs = len(offs) - 1
        c = Counted.of_texts(data, offs)
        home, score, name = np.zeros(docs, np.int64), np.ones(docs), np.empty(docs, object)
        if len(self.families) > 1:
            _, p = self.margins(c, [("", f) for f in self.families])
            home = p.argmax(axis=1)
            score = p[np.arange(docs), home] / p.sum(axis=1)
        for h in np.unique(home):
            langs, own = self.homes[self.families[h]], home == h
            if len(langs) == 1:
                name[own] = langs[0]
                continue
            pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :]]
            m, p = self.margins(c, pairs)
            votes, total, least = (np.zeros((docs, len(langs))) for _ in range(3))
            least += 1
            for j, (a, b) in enumerate(pairs):
                for lang, sign, prob in ((a, 1, p[:, j]), (b, -1, 1 - p[:, j])):
                    i = langs.index(lang)
                    votes[:, i] += m[:, j] >= 0 if sign > 0 else m[:, j] < 0
                    total[:, i] += sign * m[:, j]
                    least[:, i] = np.minimum(least[:, i], prob)
            best = np.lexsort((total.T, votes.T), axis=0)[-1]
            tied = (votes == votes[np.arange(docs), best][:, None]) & (total == total[np.arange(docs), best][:, None])
            best = tied.argmax(axis=1)
            name[own] = np.array(langs, object)[best[own]]
            score[own] *= least[np.arange(docs), best][own]
        return name, score


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches):
        for b in batches:
            for row, data, offs in chunks(b.column("text")):
                n = len(offs) - 1
                told = b.column("told").slice(row, n).to_numpy(zero_copy_only=False).astype(bool)
                name, score = shared.value.predict(data, offs) if shared.value else (np.empty(n, object), np.zeros(n))
                told = told & (shared.value is not None)
                cols = [b.column("doc_id").slice(row, n), b.column("held_out").slice(row, n), pa.array(np.where(told, name, "und"), pa.string()), pa.array(np.where(told, score, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    told = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), told.alias("told"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
