"""Language identification, ranked lexical search and phrase collocations against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import collocations, langid, lexical, queries

LOWER = {i: i + 32 for i in range(65, 91)}
#: Columns whose names are used inside.
DOCS = "doc_id long, text string, lang string, source string, term long, score double, part int, told string, share double, n long, key long"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with extra columns."""
    return spark.createDataFrame([(*r, "s", 1, 0.5, 1, "x", 0.1, 3, 4) for r in rows], DOCS).repartition(3)


def told(lang, rng, n):
    """A text of n words of an invented language: its own endings and letters."""
    ends = {"en": ["ing", "the", "of"], "de": ["ung", "der", "sch"], "nl": ["ijk", "het", "oe"], "fr": ["eux", "le", "ç"], "es": ["ción", "el", "ñ"], "zz": ["qqa", "xo", "zu"]}[lang]
    return " ".join("".join(rng.choice(ends + ["a", "e", "n"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_families(spark):
    """Six languages, three of one family and one of none; nulls, texts without letters, repeated rows, a very long text."""
    rng = random.Random(2)
    rows = [(i, told(lang, rng, rng.randint(4, 40)), lang) for i, lang in enumerate(["en", "de", "nl", "fr", "es", "zz"] * 40)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (903, "——", "fr"), (None, told("de", rng, 30), "de"), (904, told("fr", rng, 60_000), None), rows[0], rows[0]]
    out = langid.languages(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    got = {r.doc_id: r for r in out}
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902, 903)] == [("und", 0.0)] * 4
    assert got[904].lang_pred == "fr" and got[None].lang_pred == "de"
    held = [(got[i].lang_pred, lang) for i, t, lang in rows[:240] if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 50


def test_languages_of_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    right = queries.op11_language_id(spark, sf_dir).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert right >= 0.97


def test_languages_of_nothing(spark):
    assert langid.languages(docs(spark, []).limit(0)).count() == 0
    assert [(r.lang_pred, r.score) for r in langid.languages(docs(spark, [(1, "a text", None)])).collect()] == [("und", 0.0)]
    one = langid.languages(docs(spark, [(i, "a text", "xx") for i in range(6)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}


def test_machine_is_optimal():
    """The conditions of the minimum of the regularised squared hinge loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.7 * rng.normal(size=60) > 0, 1.0, -1.0)
    k = x @ x.T
    beta = langid.machine(k, y)
    f, ridge = k @ beta, langid.RIDGE * np.trace(k) / 60
    inside = y * f < 1
    assert np.allclose(ridge * beta[inside], (y - f)[inside]) and not beta[~inside].any() and 0 < inside.sum() < 60


def test_grams_of_words():
    data = np.frombuffer(b"ab abc", np.uint8)
    g, first = langid.grams(data, np.array([0, 3]), np.array([2, 6]))
    sizes = [sum(max(0, n + 2 - k + 1) for k in (1, 2, 3, 4)) - 2 for n in (2, 3)]  # borders alone are no n-gram
    assert np.diff(first).tolist() == sizes
    shared = {" a", "ab", "a", "b", " ab"}
    assert len(set(g[: first[1]].tolist()) & set(g[first[1] :].tolist())) == len(shared)


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def ranked_plainly(rows, items, k=10):
    of = [Counter(terms(t)) for _, t, _ in rows]
    size = [sum(c.values()) for c in of]
    n, total, out = sum(s > 0 for s in size), sum(size), []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = Counter(t for c in of for t in c)
    for i, own in wanted.items():
        scored = []
        for (doc, _, _), c, s in zip(rows, of, size, strict=True):
            m = 10 + (90 * s * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(400_000, 100_000), (150, 20)])
def test_ranked_search_equals_scoring_all(spark, monkeypatch, shard, block):
    """Ties (equal texts), repeated and null ids, nulls, a very long text, items of one id, without terms and unknown; many shards and blocks."""
    monkeypatch.setattr(lexical, "SHARD_WORDS", shard)
    monkeypatch.setattr(lexical, "ITEM_TERMS", block)
    rng = random.Random(4)
    vocabulary = [f"w{i}" if i % 3 else f"É{i}" for i in range(120)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=n))
    rows = [(rng.randrange(1000), text(rng.randint(1, 60)), "en") for _ in range(150)]
    rows += [(i, rows[7][1], "en") for i in (5, 3, 3, 2000, 2001, 2002, 2003, 2004, None, None, 4, 6)]
    rows += [(1, None, None), (2, "", "x"), (3, "?!", "x"), (None, text(30), "x"), (9, text(20_000), "x")]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(12, rows[7][1]), (12, "w1 w2"), (13, "unknownword"), (14, None), (15, ".."), (None, "w3 W4")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, rank int")
    got = [tuple(r) for r in lexical.ranked(docs(spark, rows), asked).collect()]
    assert sorted(got, key=str) == ranked_plainly(rows, items)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(docs(spark, []).limit(0), items).count() == 0
    assert lexical.ranked(docs(spark, [(1, "a b", "en")]), items.limit(0)).count() == 0
    assert lexical.ranked(docs(spark, [(1, "a b", "en")]), items).collect()[0].rank == 1


def collocated_plainly(rows, least, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in n:
        kept = []
        for (own, p), a in found.items():
            longer = [b for (other, q), b in found.items() if other == own and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if own == lang and not any(100 * b >= share * a for b in longer):
                cuts = [(1000000 * a * a // (f[own, p[:k]] * f[own, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), f[own, p[:k]], f[own, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("most", [collocations.MOST_WORDS, 3])
def test_collocations_equal_counting_all(spark, monkeypatch, most):
    """By the dictionary with small buffers, and as text beyond its bound; ties, control characters in words, nulls, repeated rows, a very long text."""
    monkeypatch.setattr(collocations, "MOST_WORDS", most)
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "RANGE", 50)
    rng = random.Random(6)
    vocabulary = ["New", "YORK", "city", "a\x01", "a", "é", "x-y", "the", "of", "漢", "q", "Of", "[]", "t\x0eb"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "; "]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 50)) + " new york city", rng.choice(["en", "de", "de", None, "und"])) for i in range(60)]
    rows += [rows[0]] * 12 + [(None, "new york  city hall", "fr")] * 11 + [(1, None, "en"), (2, "", "it"), (3, "..", "it"), (4, text(3000), "en"), (5, "same same same same same same same same same same same same", "pt")]
    got = collocations.collocations(docs(spark, rows), least=10, share=50, top=12)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(map(tuple, got.collect())) == collocated_plainly(rows, 10, 50, 12)


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_017, 3_000_000_019, 4_000_000_007
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.quotient("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)
    assert collocations.collocations(docs(spark, []).limit(0)).count() == 0
