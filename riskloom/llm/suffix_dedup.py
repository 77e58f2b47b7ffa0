"""Removal of repeated substrings by sorting suffixes.

Of every string of LENGTH bytes the first occurrence stays (smallest doc_id, then smallest start); a
byte that any later occurrence covers is removed. Strings are judged on the input and never cross
documents.

1. Anchors. Each LENGTH-byte window has one anchor, its K-byte gram with the smallest hash (leftmost
   of equals), so equal windows have equal anchors at the same offset. A run of windows with one
   anchor is one row: hash of the anchor, digest of the bytes the run covers, document and place.
   About one byte in 35 starts a row. Documents are dealt out by anchor once.
2. Runs that repeat byte for byte are duplicates as a whole, all but the first. Only where the first
   ones of different runs share an anchor may windows be equal in part; their bytes are looked up.
3. Those windows' suffixes are sorted by deep-shallow sorting: a multikey quicksort on eight bytes at a
   time down to SHALLOW bytes, then blind tries for the groups that are still together: a node skips
   to where its strings first differ and splits them by that byte alone. Leaves of LENGTH equal
   bytes are the repeated windows.

Null texts are empty. Documents shorter than LENGTH lose nothing. Identical repeated rows count as one
document and get a row each. Rows of one doc_id with different texts are documents of their own, in the order of a digest
of their texts, and share no spans. A null doc_id comes before all others. Texts of any length are taken whole, in parts
that overlap. Ties can't arise: of equal strings the order of documents and places decides. An empty table gives an empty one.
Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import only, saved, with_text_key
from .linker import grouped
from .textkit import BYTE_VALUE, chunks, mix, powers, signed, sliding_least

LENGTH, K, SHALLOW = 100, 32, 32
WINDOWS = LENGTH - K + 1  # anchors to choose from in a window
PLACE_BITS = 22
#: Bytes of a text looked at together; longer texts are cut, with LENGTH - 1 bytes in common.
PART = 1 << 21
#: Suffixes sorted together.
SORTED_AT_ONCE = 400_000
NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte grams, by doubling."""
    h, size = BYTE_VALUE[data], 1
    while size < K:
        h = h[:-size] * np.uint64(pow(0x9FB21C651E98DF25, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def runs(data: np.ndarray, offs: np.ndarray):
    """(first window, windows, offset of the anchor, anchor hash, digest) of each run in texts at offs."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = gram_hashes(data)
    place = np.uint64((1 << PLACE_BITS) - 1)
    at = (sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), WINDOWS) & place).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offs) >= LENGTH
    inside[offs[:-1][long]] = 1
    stop = offs[1:][long] - LENGTH + 1
    np.add.at(inside, stop, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]))
    count = np.diff(np.append(first, n))
    keep = inside[first] > 0
    first, count = first[keep], count[keep]
    anchor = at[first]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    digest = mix((total[first + count + LENGTH - 1] - total[first]) * down[first])
    digest = mix(digest + (count * 128 + anchor - first).astype(np.uint64))
    return first, count, anchor - first, mix(h[anchor]), digest


def parts(data: np.ndarray, offs: np.ndarray):
    """(bytes, offsets, start in the text) of pieces of PART bytes; only a single long text is cut."""
    if len(data) <= PART + LENGTH:
        yield data, offs, 0
        return
    for at in range(0, len(data) - LENGTH + 1, PART):
        piece = data[at : at + PART + LENGTH - 1]
        yield piece, np.array([0, len(piece)]), at


def not_first(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which runs come after an equal run among these. Such a run is no first one among all runs either."""
    order = np.lexsort((place, doc, digest, key))
    k, d, i, p = (x[order] for x in (key, digest, doc, place))
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])[: len(k)])
    nth = np.repeat(head, np.diff(np.append(head, len(k))))
    out = np.zeros(len(key), bool)
    out[order] = (i != i[nth]) | (p != p[nth])
    return out


def anchors(docs: DataFrame) -> DataFrame:
    """(key, digest, doc_id, place, known) of every run; place: first window << 14 | windows << 7 | anchor's offset.

    known: an equal run comes before it in the same piece of input. Nothing more need be compared, so key
    is then a hash of the document (digest 0), and copies of one run are not dealt to one task.
    """

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for row, whole, offs in chunks(b.column("text"), PART):
                for data, cut, base in parts(whole, offs):
                    first, count, offset, key, digest = runs(data, cut)
                    doc = np.searchsorted(cut, first, "right") - 1
                    place = (first - cut[doc] + base) << 14 | count << 7 | offset
                    owner = ids[row + doc]
                    known = not_first(key, digest, owner, place)
                    key = np.where(known, mix(owner.astype(np.uint64)), key)
                    digest = np.where(known, np.uint64(0), digest)
                    cols = [signed(key), signed(digest), owner, place, known]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "digest", "doc_id", "place", "known"])

    return docs.mapInArrow(run, "key long, digest long, doc_id long, place long, known boolean")


def equal_classes(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each suffix a class number, equal for those of one group with LENGTH equal bytes; -1 if alone.

    buf must go on for eight bytes after the last window.
    """
    words = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1))
    word = lambda at: np.ascontiguousarray(words[at]).view(">u8").ravel()
    out = np.full(len(start), -1, np.int64)
    live = np.arange(len(start))
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, a key of eight bytes a level
        live, group = split(live, group, word(start[live] + depth))
    named = 0
    while len(live):  # blind tries, all nodes of a level at once
        head = np.flatnonzero(np.diff(group, prepend=-1))
        mate = np.repeat(live[head], np.diff(np.append(head, len(live))))
        same = np.full(len(live), LENGTH, np.int64)
        open_ = np.ones(len(live), bool)
        for depth in range(SHALLOW, LENGTH, 8):
            some = np.flatnonzero(open_)
            if not len(some):
                break
            x = word(start[live[some]] + depth) ^ word(start[mate[some]] + depth)
            differs = x != 0
            bits = np.zeros(len(some), np.int64)
            bits[differs] = 63 - np.floor(np.log2(x[differs].astype(np.float64))).astype(np.int64)
            # a float may round up to the next power of two; then the byte before is looked at again
            exact = x[differs] >> (np.uint64(63) - bits[differs].astype(np.uint64)) == 0
            bits[differs] += exact
            same[some[differs]] = np.minimum(depth + bits[differs] // 8, LENGTH)
            open_[some[differs]] = False
        skip = np.minimum.reduceat(same, head)
        size = np.diff(np.append(head, len(live)))
        done = np.repeat(skip >= LENGTH, size)
        whole = np.repeat(np.arange(len(head)), size)[done]
        out[live[done]] = whole + named
        named += len(head)
        at = np.repeat(skip, size)[~done]
        live, group = live[~done], group[~done]
        live, group = split(live, group, buf[start[live] + at].astype(np.uint64))
    return out


def split(live: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members sorted by group and key; groups are divided by key, and members left alone dropped."""
    order = np.lexsort((key, group))
    live, group, key = live[order], group[order], key[order]
    new = np.ones(len(live), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(new)
    alone = new & np.append(new[1:], True)
    return live[~alone], number[~alone]


def later_windows(key, doc, place, segments: list[bytes]):
    """(doc, start, end) of the windows that occur earlier in the same group of runs, as byte spans."""
    first, count, offset = place >> 14, place >> 7 & 127, place & 127
    size = np.array([len(s) for s in segments])
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    buf = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
    run = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    anchor_at = offset[run] - nth
    group = np.unique(np.stack([key[run], anchor_at]), axis=1, return_inverse=True)[1].ravel() if len(run) else run
    cls = equal_classes(buf, base[run] + nth, group)
    some = np.flatnonzero(cls >= 0)
    at = first[run[some]] + nth[some]
    order = np.lexsort((at, doc[run[some]], cls[some]))
    some, at = some[order], at[order]
    later = np.concatenate([[False], cls[some][1:] == cls[some][:-1]])[: len(some)]
    owner, at = doc[run[some]][later], at[later]
    if not len(at):
        return owner, at, at
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + LENGTH)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return owner[head], at[head], at[last] + LENGTH


def shared_in_part(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, end) from runs that share an anchor but not all bytes; found has them by document."""

    def cut(batches):
        for b in batches:
            keys, ids, places, bytes_ = [], [], [], []
            for text, doc, mixed in zip(*(b.column(c).to_pylist() for c in ("text", "doc_id", "mixed")), strict=True):
                data = (text or "").encode()
                for m in mixed:
                    lo, count = m["place"] >> 14, m["place"] >> 7 & 127
                    keys.append(m["key"])
                    ids.append(doc)
                    places.append(m["place"])
                    bytes_.append(data[lo : lo + count + LENGTH - 1])
            cols = [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "place", "bytes"])

    def sort(batches):
        held, size = [], 0
        for t in grouped(batches, "key"):
            held.append(t)
            size += t.num_rows * WINDOWS // 2
            if size > SORTED_AT_ONCE:
                yield from result(held)
                held, size = [], 0
        if held:
            yield from result(held)

    def result(tables):
        t = pa.concat_tables(tables)
        key, doc, place = (t.column(c).to_numpy() for c in ("key", "doc_id", "place"))
        out = later_windows(key, doc, place, t.column("bytes").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc_id", "start", "end"])

    some = found.filter("size(mixed) > 0").select("doc_id", "mixed")
    texts = only(docs, some.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]).join(some, "doc_id").select("doc_id", "text", "mixed")
    segments = texts.mapInArrow(cut, "key long, doc_id long, place long, bytes binary")
    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "doc_id long, start long, end long")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of documents that lose bytes; spans: struct<start, end> in bytes, in any order."""
    rows = anchors(docs).repartition("key")
    rows = rows.selectExpr(
        "doc_id",
        "key",
        "place",
        "known or dense_rank() over (partition by key, known, digest order by doc_id, place) > 1 as whole",
        "min(digest) over (partition by key, known) <> max(digest) over (partition by key, known) as part",
    )
    rows = rows.filter("whole or part").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("place"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.struct("key", "place"))).alias("mixed"),
    )
    found = saved(rows)
    ends = lambda p: F.struct(
        F.shiftright(p, 14).alias("start"), (F.shiftright(p, 14) + F.shiftright(p, 7).bitwiseAND(F.lit(127)) + (LENGTH - 1)).alias("end")
    )
    whole = found.filter("size(whole) > 0").select("doc_id", F.transform("whole", ends).alias("spans"))
    part = shared_in_part(docs, found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return whole.unionByName(part).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_bytes(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of data, bytes removed, and maximal removed runs."""
    out, at, n = [], 0, 0
    for s, e in sorted(spans):
        if s > at or not n:
            n += 1
            out.append(data[at:s])
        at = max(at, e)
    out.append(data[at:])
    left = b"".join(out)
    return left, len(data) - len(left), n


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, shown, text): shown is the doc_id; doc_id a number for each of its different texts, in the same order."""
    docs, repeats = with_text_key(docs)
    if not repeats:
        return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").alias("shown"), "text")
    order = docs.select(F.col("doc_id").alias("of"), F.col("same").alias("of_same")).distinct().repartitionByRange("of", "of_same").sortWithinPartitions("of", "of_same")
    order = saved(order.withColumn("number", F.monotonically_increasing_id()))
    own = docs.join(order, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("of_same")))
    return own.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("shown"), "text")


def deduplicated(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (binary)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts  # doc_id as it was
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(c).to_pylist() for c in ("shown", "text", "spans")), strict=True):
                data = (text or "").encode()
                left, gone, n = kept_bytes(data, [(s["start"], s["end"]) for s in spans or ()])
                rows.append((doc, len(data), gone, n, hashlib.sha256(left).hexdigest(), left)[: len(names)])
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)] if rows else [pa.array([], t) for t in types[: len(names)]], names)

    docs = numbered(docs)
    spans = saved(removed_spans(docs.select("doc_id", "text")))
    ids = spans.select("doc_id")
    cut = only(docs, ids, "doc_id").join(spans, "doc_id").select("shown", "text", "spans")
    rest = only(docs, ids, "doc_id", anti=True).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return cut.unionByName(rest.select("shown", "text", "spans")).mapInArrow(run, schema)
