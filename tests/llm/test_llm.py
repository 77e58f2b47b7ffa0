"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import chat, decontam, embed_dedup, jaccard_join, linker, paragraph_dedup, pieces, queries, secret_scan, sharding, suffix_dedup, toxicity
from riskloom.llm.frames import components
from riskloom.llm.textkit import mix, words

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, removed int"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts):
    """Documents with extra columns whose names clash with those used inside."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared lines, empties, nulls and a long text."""
    rng = random.Random(seed)
    text = lambda k: "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(k))
    shared = " ".join(rng.choice(WORDS) for _ in range(40))
    out = [text(rng.randint(1, 8)) for _ in range(n)]
    out += [out[0], out[0], out[1] + "\n" + shared, out[2] + "\n" + shared, shared, None, "", "one two", "one two", "ONE two", "\n\n", "é漢字 " * 30, "a" * 500, "a" * 300]
    for i in range(12):
        w = out[3].split(" ")
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out.append(text(300))
    return out


def sets(texts, k):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        yield frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def union(n, links):
    root = list(range(n))

    def top(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard_join_is_exact(spark, k, num, den):
    texts = corpus()
    s = list(sets(texts, k))
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and len(s[i] & s[j]) * den >= num * len(s[i] | s[j]) > 0]
    want = union(len(s), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), k, num, den).collect()}
    assert got == {i: (len(s[i]), want[i]) for i in range(len(s))}


ROWS = "doc_id long, text string, id long, key string, same string, label string, members string"


def test_jaccard_join_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "q y x w v u t s"
    rows = [(1, a), (1, b), (2, a + " i"), (3, b + " z"), (None, "m n o p q r s t"), (5, "m n o p q r s t u"), (None, "lone words of no other text"), (7, ""), (7, ""), (8, None)]
    df = spark.createDataFrame([(i, t, 1, "k", "s", "l", "m") for i, t in rows], ROWS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 7, 10).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (2, 6, 1), (3, 6, 1), (None, 5, 5), (5, 6, 5), (None, 3, None), (7, 0, 7), (7, 0, 7), (8, 0, 8)], key=str)


def test_near_copies_below_the_bar_make_few_rows(spark, monkeypatch):
    """600 texts, each pair at Jaccard of about 0.75 where 0.85 is asked for, and a bucket larger than a block."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(300)]
    texts = []
    for _ in range(600):
        w = list(base)
        for at in rng.sample(range(0, 300, 5), 6):
            w[at] = rng.choice(WORDS)
        texts.append(" ".join(w))
    monkeypatch.setattr(linker, "BLOCK", 128)
    made, plain = [], linker.candidates
    monkeypatch.setattr(linker, "candidates", lambda *a: made.append(plain(*a)) or made[-1])
    s = list(sets(texts, 4))
    links = [(i, j) for i in range(600) for j in range(i) if len(s[i] & s[j]) * 100 >= 85 * len(s[i] | s[j])]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, texts), 4, 85, 100).collect()}
    assert got == dict(enumerate(union(600, links)))
    assert sum(x.count() for x in made) < 20 * 600


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def cut_plainly(text, k=5, spread=paragraph_dedup.SPREAD):
    """(start, end, words) of the passages of a text, word by word."""
    data = text.encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    pair = [int(x) for x in mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])]
    line = [data[:s].count(b"\n") for s, _ in found]
    heads = []
    for i in range(len(found)):
        around = range(i - spread, i + spread + 2)
        inside = around[0] >= 0 and around[-1] < len(found) and line[around[0]] == line[around[-1]]
        least = inside and all(pair[i] < pair[j] for j in around[:spread]) and all(pair[i] <= pair[j] for j in around[spread + 1 : -1])
        if i == 0 or line[i] != line[i - 1] or least:
            heads.append(i)
    ends = [*heads[1:], len(found)] if heads else []
    return [(found[a][0], found[b][0] if b < len(found) else len(data), [data[s:e].lower() for s, e in found[a:b]]) for a, b in zip(heads, ends, strict=True)]


def test_paragraph_dedup(spark):
    texts = corpus(5)
    rng = random.Random(15)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, common = prose(60), prose(15)
    texts += [prose(40) + " " + passage + " " + prose(30), prose(70) + " " + passage + "\n" + prose(9), common + " " + prose(50), prose(20) + " " + common + " " + prose(50), "is " * 200, "is " * 150]
    cut = [cut_plainly(t or "") for t in texts]
    shingled = lambda w: frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset()
    every = [(d, i, shingled(w)) for d, own in enumerate(cut) for i, (_, _, w) in enumerate(own)]
    links, by = [], defaultdict(list)
    for a, (_, _, s) in enumerate(every):
        for g in s:
            by[g].append(a)
    for a, b in {(x, y) for own in by.values() for x in own for y in own if y < x}:
        x, y = every[a][2], every[b][2]
        if 5 * len(x & y) >= 4 * len(x | y):
            links.append((a, b))
    repeat = [defaultdict(bool) for _ in texts]
    for at, top in enumerate(union(len(every), links)):
        repeat[every[at][0]][every[at][1]] = at != top
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(docs(spark, texts)).collect()}
    wrong = 0
    for d, (text, own) in enumerate(zip(texts, cut, strict=True)):
        marks = "".join("r" if repeat[d][i] else "s" if len(w) < 5 else "-" for i, (_, _, w) in enumerate(own))
        spans = [(m.start(), m.end()) for m in re.finditer(r"r(?:[rs]*r)?", marks)]
        spans = [(a, b) for a, b in spans if sum(len(w) for _, _, w in own[a:b]) >= paragraph_dedup.LEAST_WORDS]
        data, left, at = (text or "").encode(), b"", 0
        for a, b in spans:
            left += data[at : own[a][0]]
            at = own[b - 1][1]
        left += data[at:]
        want = (None if text is None else left.decode(), sum(b - a for a, b in spans))
        wrong += (got[d].text, got[d].n_removed) != want  # a pair near the bar may share no band
    assert wrong <= 2
    n = len(texts)
    assert got[n - 6].n_removed == 0 and got[n - 5].n_removed > 0 and len(got[n - 5].text) < len(texts[n - 5]) - 200
    assert got[n - 4].n_removed == got[n - 3].n_removed == 0
    assert paragraph_dedup.paragraph_dedup(docs(spark, [])).count() == 0


def test_paragraph_dedup_repeated_rows_and_null_ids(spark):
    rng = random.Random(16)
    a, b = (" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (3, "")]
    df = spark.createDataFrame([(i, t, 1, "k", "s", "l", "m") for i, t in rows], ROWS)
    got = Counter((r.doc_id, r.text == "") for r in paragraph_dedup.paragraph_dedup(df).collect())
    assert got == {(1, True): 2, (1, False): 1, (2, True): 1, (None, False): 1, (3, True): 1}


def test_bands_follow_the_bar():
    assert (paragraph_dedup.band_count(4, 5), paragraph_dedup.least_set(4, 5)) == (4, 4)
    assert paragraph_dedup.band_count(3, 5) == 9 and paragraph_dedup.least_set(3, 5) == 2


def test_suffix_dedup(spark):
    texts = corpus(7)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, np.int8)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mask[s : s + 100] = 1
            seen.add(b[s : s + 100])
        left = bytes(x for x, m in zip(b, mask, strict=False) if not m)
        want[i] = (len(b), int(mask.sum()), int((np.diff(mask, prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs(spark, texts)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    """Different texts of one id are documents of their own; the first occurrence stays, whatever rows share its id."""
    rng = random.Random(11)
    a, b, lead = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (260, 240, 150))
    rows = [(1, a), (1, b), (1, lead + a), (2, b), (3, b), (3, b), (None, lead[:120]), (None, None), (4, ""), (4, "short")]
    df = spark.createDataFrame([(i, t, 5, "s", 1) for i, t in rows], "doc_id long, text string, number long, shown string, same int")
    out = [(r.doc_id, r.kept) for r in suffix_dedup.deduplicated(df).collect()]
    assert len(out) == len(rows)
    kept = [bytes(k).decode() for _, k in out]
    assert sum(b in k for k in kept) == 1 and sorted(k for i, k in out if i in (2, 3)) == [b""] * 3
    assert any(a[:100] in k for k in kept) and any(a[-100:] in k for k in kept)
    order = spark.createDataFrame([(t,) for _, t in rows[:3]], "t string").selectExpr("t", "xxhash64(t) h").orderBy("h").collect()
    want, seen = {}, {lead[i : i + 100] for i in range(21)}
    for r in order:
        data, mask = r.t, [False] * len(r.t)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                mask[i : i + 100] = [True] * 100
            seen.add(data[i : i + 100])
        want[r.t] = "".join(c for c, m in zip(data, mask, strict=True) if not m)
    assert sorted(bytes(k).decode() for i, k in out if i == 1) == sorted(want.values())


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(9000))
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, 9000])
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    windows = []
    for piece, cut, base in suffix_dedup.parts(data, offs):
        first, count, *_ = suffix_dedup.runs(piece, cut)
        windows += [w + base for f, c in zip(first, count, strict=True) for w in range(f, f + c)]
    assert sorted(windows) == list(range(9000 - 99))


def test_equal_classes():
    rng = random.Random(2)
    buf = bytes(rng.choice(b"ab") for _ in range(400)) * 3
    start = np.arange(1000)
    got = suffix_dedup.equal_classes(np.frombuffer(buf + bytes(8), np.uint8), start, np.zeros(1000, int))
    count = Counter(buf[s : s + 100] for s in start)
    by = defaultdict(set)
    for s in start:
        by[buf[s : s + 100]].add(int(got[s]))
    assert all(len(v) == 1 and (v != {-1}) == (count[k] > 1) for k, v in by.items())
    assert len({v.pop() for k, v in by.items() if count[k] > 1}) == sum(c > 1 for c in count.values())


@pytest.mark.xfail(reason="sf0.1, all languages: 56 of 97 held-out toxic rows found, precision 0.97; few of the German, French and Spanish ones", strict=False)
def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    d, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    known = d.join(labels, "doc_id").select("doc_id", "text", "toxic")
    got = toxicity.toxicity(known.select("doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit >= 0.95 * sum(r.toxic for r in got) and hit >= 0.97 * sum(r.predicted for r in got)


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, [None, "", "plain words", "?!"]), labels).collect()
    assert [(r.score, r.predicted) for r in got] == [(0, 0)] * 4
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i in range(40)] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, [None, "", *(["nasty brute"] * 38)]), labels).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def test_toxicity_classes_keep_their_share(spark, monkeypatch):
    """Labels that texts say little about, one in ten toxic, and more of both than calibration takes."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(6)).replace("w", rng.choice("abcdef")) for _ in range(4000)]
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in range(4000)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 100)
    got = toxicity.toxicity(docs(spark, texts), labels).collect()
    assert 0.05 < np.mean([r.score for r in got]) < 0.2
    assert np.mean([r.predicted for r in got]) < 0.1


def test_decontamination(spark):
    rng = random.Random(4)
    item = " ".join(rng.choice(WORDS) for _ in range(20))
    short = "alpha beta-gamma"
    texts = ["x " * 30 + item.upper() + " y" * 30, item[:60], "Alpha, BETA gamma delta", None, "", "z " * 900 + item, "alpha beta"]
    bench = spark.createDataFrame([(1, item), (10, item), (2, short), (3, None), (4, "...")], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        w, hit, items = words(t), set(), set()
        for n, b in ((1, item), (10, item), (2, short)):
            b = words(b)
            size = min(13, len(b))
            for v in {tuple(b[j : j + size]) for j in range(len(b) - size + 1)}:
                for p in range(len(w) - size + 1):
                    if tuple(w[p : p + size]) == v:
                        hit |= set(range(p, p + size))
                        items.add(n)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, set(r.item_ids), r.contaminated) == (len(w), len(hit), len(items), items, bool(hit) and 20 * len(hit) >= len(w))
    left = {r.doc_id: r.text for r in decontam.without_hit_words(docs(spark, texts), bench).collect()}
    assert left[2] == ",   delta"
    assert left[6] == "alpha beta"


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_rows(spark, monkeypatch, most):
    """Repeated rows, one doc_id with different texts, null ids, capitals beyond ASCII, a very long text; broadcast and shuffled."""
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
    item = " ".join(f"Ä{i} q{i}" for i in range(10))
    long_text = "Word " * 200_000 + item
    rows = [(1, item), (1, item), (1, "clean text"), (None, item), (None, None), (2, item.lower()), (3, long_text), (4, "DŽ İ Σ alpha BETA"), (5, "")]
    bench = spark.createDataFrame([(1, item), (2, "alpha beta")], "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    told = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in got), key=str)
    want = [(1, 20, 20, [1]), (1, 20, 20, [1]), (1, 2, 0, []), (None, 20, 20, [1]), (None, 0, 0, []), (2, 20, 0, []), (3, 200_020, 20, [1]), (4, 5, 2, [2]), (5, 0, 0, [])]
    assert told == sorted(((i is None, i, n, h, x, h > 0 and 20 * h >= n) for i, n, h, x in want), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contamination(empty, bench).count() == 0
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).collect()
    assert len(got) == len(rows) and not any(r.n_hit or r.contaminated for r in got)


def test_sharding(spark):
    texts = [None, "", "é", *(["same"] * 50), *[f"t{i}" for i in range(600)]]
    got = {r.doc_id: r for r in sharding.sharded(docs(spark, texts), [1.0] * 16, [1.0] * 17).collect()}
    slots = defaultdict(list)
    for i, t in enumerate(texts):
        bid = [int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:15], 16) for s in range(17)]
        r, b = got[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(b) + 1, zlib.crc32(b), int(np.argmax(bid[:16])), int(np.argmax(bid)))
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_decide_shares(spark):
    df = docs(spark, ["x"] * 3000)
    n = Counter(r.shard for r in sharding.sharded(df, [3.0, 1.0]).collect())
    assert 0.7 < n[0] / 3000 < 0.8


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    vecs = [*base, *(base[:60] + 0.03 * rng.normal(size=(60, 16))), *base[:20]]
    rows = [(i, [float(x) for x in v], int(i % 2) if i < 300 else int((i - 300) % 60 % 2)) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [1.0], 0), (n + 5, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([v for _, v, _ in rows[:n]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows[:n]])[:, None] == np.array([r[2] for r in rows[:n]]))
    np.fill_diagonal(near, False)
    want = union(n, np.argwhere(near))
    found = embed_dedup.near_duplicates(df)
    got = {r.vec_id: r for r in found.collect()}
    assert len(got) == len(rows)
    assert sum(got[i].n_links for i in range(n)) >= 0.9 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(n))
    assert np.mean([got[i].component_id == want[i] for i in range(n)]) > 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 6))
    assert embed_dedup.audit(df, found) >= 0.9
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_groups_of_many_near_copies(spark):
    """Groups with more members than candidate lists hold; shards hold several of them."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(13, 16))
    x = np.concatenate([b + 0.02 * rng.normal(size=(n, 16)) for b, n in zip(base, [800] + [150] * 12, strict=True)])
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    found = embed_dedup.near_duplicates(df)
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert near.sum(axis=1).min() > 64
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * near.sum()
    assert embed_dedup.audit(df, found) >= 0.99


@pytest.mark.parametrize("block", [4096, 150])
def test_embeddings_pairs_of_near_copies_are_counted_not_written(spark, monkeypatch, block):
    """A group of near copies: rows grow with its members, not with its pairs, whole or cut into blocks; no centre cuts it."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "SHARD", 200)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base[0] + 0.02 * rng.normal(size=(500, 16)), base, base[0][None], base[:1]])
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    made, links = [], embed_dedup.links
    monkeypatch.setattr(embed_dedup, "links", lambda *a: made.append(links(*a)) or made[0])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    want = union(len(x), np.argwhere(near))
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}
    assert made[0].count() < 10 * len(x) < near.sum() / 20  # before: a row for each pair
    if block > len(x):
        assert len(embed_dedup.centres(u[:500], 20, least=0.98)) == 1


def test_embeddings_pair_close_to_the_bound(spark):
    """What a product can't tell from the bound is measured."""
    sims = np.array([[0.98, 0.98 - 1e-7, 0.5, 0.99]])
    raw, others = np.array([[1.0, 0.0]]), np.array([[c, np.sqrt(1 - c * c)] for c in (0.9800001, 0.9799999, 0.5, 0.99)])
    assert embed_dedup.verified(np.zeros((1, 4), bool), sims, raw, others, 0.98).tolist() == [[True, False, False, True]]


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "<a> \\l"}, {"role": "assistant", "content": "b"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations"),
    ({"prompt": "q", "response": "</turn>"}, "prompt+response"),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction+input+output"),
    ({"messages": []}, "messages-empty"),
    ({"unknown": 1}, None),
]


def test_chat_keeps_columns_of_the_same_name(spark):
    rows = spark.createDataFrame([(1, json.dumps(LAYOUTS[2][0]), "t", "p", "f")], "i long, record string, turns string, parts string, formatted string")
    r = chat.formatted(rows).first()
    assert (r.turns, r.parts, r.layout) == ("t", "p", "prompt+response") and "<turn user>q</turn>" in r.formatted


def test_embeddings_null_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (9, [5.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True)] * 2 + [(4, 1, 4, True)] * 2 + [(9, 0, 9, True)], key=str)


def test_chat_layouts(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(LAYOUTS)] + [(90, None), (91, "{"), (92, "[1]")]
    out = chat.formatted(spark.createDataFrame(rows, "i long, record string"))
    got = {r.i: r for r in out.withColumn("back", chat.read_back(out["formatted"])).withColumn("loss", chat.loss_text(out["formatted"], out["loss_spans"])).collect()}
    assert [got[i].layout for i in range(len(LAYOUTS))] == [x for _, x in LAYOUTS]
    assert [(t.role, t.text) for t in got[0].back] == [("user", "<a> \\l"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[1].back] == [("user", "q"), ("assistant", "")]
    assert got[2].loss == "</turn>" and got[3].loss == "done"
    assert [t.text for t in got[3].back] == ["do", "done"]
    assert got[4].formatted == "" and got[4].back == []
    assert all(got[i].formatted is None for i in (5, 90, 91, 92))


#: By rule: the pattern it stands for, the group whose length counts, and the least length.
SECRET_PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}


def test_secret_automaton_against_patterns():
    a = secret_scan.scanner()
    rng = random.Random(6)
    bits = ["token", "secret", "Password", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abcdef12", "0" * 31, "f" * 33, "AKIA", "ABCDEFGHIJ123456", "\n", ",", "é", ".", "x", "ghp_" + "a" * 40]
    bits += ["eyJ", "eyJ" + "k" * 12, ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ſecret=", "\u212aey", "-", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", None]
    texts += ["0" * 40_000 + " token=" + "b" * 40_000 + "token=" + "c" * 9, "token=" * 8_000]
    got = [d for part in secret_scan.scan(a, pa.array(texts)) for d in part]
    assert [r.kind for r in secret_scan.RULES] == list(SECRET_PATTERNS)
    for t, spans in zip(texts, got, strict=True):
        want = []
        for k, (pattern, group, least) in enumerate(SECRET_PATTERNS.values()):
            want += [(m.start(), k, m.end()) for m in re.finditer(pattern.replace("(?i:", "(?ia:"), t or "") if m.end(group) - m.start(group) >= least]
        assert spans == [(secret_scan.RULES[k].kind, s, e) for s, k, e in sorted(want)]


def test_secret_query_columns_and_redaction(spark):
    text = "é token = 'abcdefgh' and " + "a1" * 20
    r = secret_scan.digest_columns(secret_scan.secret_spans(docs(spark, [text]))).first()
    assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (1, 0, 1, "assign:2:19,hex:25:65")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert [x.text for x in secret_scan.redacted(docs(spark, [text, None])).orderBy("doc_id").collect()] == ["é [assign]' and [hex]", None]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [*(t or "" for t in corpus(8)), "  a  b   c\t\nd ", "ﬁ Å ①　x​z", "<s> <unk> <0x0A>", "aaaaaaaaaaaaa bbbbbbbbb"]
    got = {r.doc_id: r for r in pieces.encoded(docs(spark, texts), pieces.load()).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t) and got[i].decoded == sp.decode(sp.encode(t)) == t and got[i].round_trip


def test_pieces_unigram_is_the_best_segmentation():
    scores = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.2, "▁a": -2.5, "ba": -1.8, "aba": -2.9}
    m = pieces.Model("unigram", {p: i + 1 for i, p in enumerate(scores)}, scores, [], 0, [b"?", *(p.replace("▁", " ").encode() for p in scores)])
    rng = random.Random(9)
    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)})

    def best(w):
        if not w:
            return 0.0
        return max([m.scores[w[:n]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in m.scores] + [m.least + best(w[1:])])

    for w, cut in pieces.segmented(m, words):
        assert "".join(cut) == w
        assert sum(m.scores.get(p, m.least) for p in cut) == pytest.approx(best(w))


def test_queries_on_empty_tables(spark, tmp_path, sf_dir):
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name.startswith("op7") else 0), name


def test_pipeline_keeps_and_drops(spark, sf_dir):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, columns = d, d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == columns
        if name == "ngram_jaccard_join":
            groups = jaccard_join.jaccard_components(at)
            assert after.count() == groups.select("component_id").distinct().count()
        if name == "secret_scans":
            assert after.count() == at.count()
        from riskloom.llm.frames import written

        at = written(after)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in at.collect())
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in out)


def test_toxicity_backoff_holds_every_level_once(spark):
    """A plan in which the upper levels come again under every lower one outgrew the driver's memory."""
    letters = [int.from_bytes(w[::-1].ljust(6), "little") for w in (b"abcdef", b"bcdefg", b"cdefgh", b"xbcdef")]
    counts = spark.createDataFrame([(g, 1, 0) for g in letters], "g long, tox long, ord long")
    p = toxicity.backoff(counts)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == toxicity.ORDER - 1
    assert p.count() == 3 and p.filter("p <= 0 or p >= 1").isEmpty()


def test_toxicity_rows_come_to_the_driver_by_key(spark):
    key, value = toxicity.by_key(spark.createDataFrame([(3, 0.5), (1, 1.5), (2, -1.0)], "g long, v float"))
    assert key.tolist() == [1, 2, 3] and value.tolist() == [1.5, -1.0, 0.5] and value.dtype == np.float32
    assert all(len(x) == 0 for x in toxicity.by_key(spark.createDataFrame([], "g long, v float")))


def test_buckets_with_the_same_units_are_one(spark):
    """Two units that meet in many buckets make one; a larger bucket with both stays."""
    rows = [(k, i) for k in range(50) for i in (-7, 9)] + [(99, i) for i in (-7, 9, 11)] + [(100, 5)]
    got = linker.crowded(spark.createDataFrame(rows, "key long, id long")).collect()
    buckets: dict = {}
    for r in got:
        buckets.setdefault(r.key, []).append(r.id)
    assert sorted(map(sorted, buckets.values())) == [[-7, 9], [-7, 9, 11]]


@pytest.mark.parametrize("most", [3, 40, 1 << 18])
def test_pairs_of_runs_come_some_at_a_time(monkeypatch, most):
    monkeypatch.setattr(linker, "PAIRS", most)
    size = np.array([1, 2, 30, 5, 30])
    first = np.cumsum(size) - size
    found = list(linker.pairs_of(first, size))
    want = {(f + i, f + j) for f, s in zip(first.tolist(), size.tolist()) for i in range(s) for j in range(i + 1, s)}
    pairs = [(int(a), int(b)) for i, j in found for a, b in zip(i, j)]
    assert len(pairs) == len(want) and set(pairs) == want
    assert max(len(i) for i, _ in found) <= 2 * max(most, 30)


def keys_by_set(sets_, num, den):
    values = np.concatenate([np.sort(s) for s in sets_])
    keys, owner = jaccard_join.part_keys(values, np.cumsum([0, *map(len, sets_)]), num, den)
    return [set(keys[owner == i].tolist()) for i in range(len(sets_))]


@pytest.mark.parametrize(("num", "den"), [(4, 5), (85, 100)])
def test_unrelated_sets_share_no_bucket_and_near_ones_do(num, den):
    """Parts without a shingle, the same in all sets of a size, once made buckets of a corpus's unrelated texts."""
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for n in (60, 230, 400, 600, 1000):
        keys = keys_by_set([some(n) for _ in range(60)], num, den)
        assert len(set().union(*keys)) == sum(map(len, keys))
    for n in [*range(1, 80), 227, 363, 580]:
        for _ in range(20):
            both = some(n)
            apart = both.size * den // num - both.size  # as many as the similarity allows, on both sides
            one = rng.integers(0, apart + 1)
            a, b = keys_by_set([np.concatenate([both, some(one)]), np.concatenate([both, some(apart - one)])], num, den)
            assert a & b
