"""Links between sets of word shingles that collide in some bucket, without all pairs of a bucket.

A *unit* is a class of texts with one shingle set (id: 64-bit digest of the set). Input: rows
(key, id) saying which buckets a unit is in. The linker

1. keeps the buckets with two units or more, of those with the same units one;
2. draws a spanning forest over each of a share of them, nearest parity sketches first, and verifies its
   edges by the exact sets;
3. takes components of the verified links, and draws forests in the buckets whose units are not all in
   one component, between units of different components, but for those of step 2 without a failed edge;
4. in the buckets where an edge of step 3 failed verifies all pairs between components whose sketches
   allow the similarity.

A pair that the sketches allow is joined by a chain of edges of its bucket's forest; if all of them hold,
nothing is left to look at. A forest has one edge less than its bucket has members. Step 4 makes rows only for
pairs that no chain of links joins and that the sketches can't rule out: the Hamming distance of two parity
sketches never exceeds the symmetric difference of the sets, so it drops no link; and as a sketch has two bits
or more for each member, it falls little short of the difference, so few pairs are left.

Buckets of more than BLOCK members are cut into blocks, and each pair of blocks is a task's work of
its own: a large bucket is compared by many tasks, none of which holds more than two blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, joined_components, saved
from .textkit import SPACED, chunks, distinct, mix, shingles, signed, words

#: Bits of a sketch: SHARP for each shingle, rounded up to a power of two, between these.
SHARP, LEAST_BITS, MOST_BITS = 2, 128, 16384
#: The first forests are drawn over one bucket in so many, where units are in many. Any choice gives the same components.
FOREST_SHARE = 4
#: Members of a bucket compared at a time, and pairs whose sketches are.
BLOCK, PAIRS = 1024, 1 << 18


def most_apart(a, b, num: int, den: int):
    """The largest symmetric difference of sets of a and b members with Jaccard num/den or more."""
    return ((den - num) * (a + b)) // (den + num)


def parity_sketch(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each run of distinct shingles, the bits that an odd number of them hash to."""
    size = np.diff(first)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size * SHARP, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    h = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    out: list[bytes] = [b""] * len(size)
    for b in np.unique(bits):
        own = np.flatnonzero(bits == b)
        for at in range(0, len(own), max(1, (1 << 21) // int(b))):  # two million cells at a time
            some = own[at : at + max(1, (1 << 21) // int(b))]
            index = np.repeat(np.arange(len(some)) * b, size[some])
            place = np.repeat(first[:-1][some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
            odd = np.bincount(index + (h[place] & np.uint64(b - 1)).astype(np.int64), minlength=len(some) * b) & 1
            packed = np.packbits(odd.astype(np.uint8), bitorder="little").reshape(len(some), b // 8)
            for i, row in zip(some.tolist(), packed, strict=True):
                out[i] = row.tobytes()
    return out


def digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; of the empty set, 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x2545F4914F6CDD1D)))])
    out = mix(total[first[1:]] - total[first[:-1]] + mix(np.diff(first).astype(np.uint64)))
    return np.where(np.diff(first) > 0, out, np.uint64(0))


def set_of(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offs in chunks(text):
        yield row, *distinct(*shingles(words(data, offs, SPACED), k))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != k[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def crowded(keys: DataFrame) -> DataFrame:
    """The (key, id) rows of buckets with two ids or more, of buckets with the same ids one; block and blocks: of BLOCK members each.

    key is then a digest of the bucket's ids: similar units meet in many buckets, and one says all. Were two digests equal,
    their buckets would be one, which has no pair less.
    """

    def run(batches):
        for t in grouped(batches, "key"):
            k, i = (t.column(c).to_numpy() for c in ("key", "id"))
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            k, i = k[new], i[new]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(head, len(k)))
            block = (np.arange(len(k)) - np.repeat(head, size)) // BLOCK
            blocks = np.repeat(-(-size // BLOCK), size)
            key = digests(i.view(np.uint64), np.append(head, len(k)))
            once = np.zeros(len(head), bool)
            once[np.unique(key, return_index=True)[1]] = True
            more = np.repeat((size > 1) & once, size)
            cols = [signed(np.repeat(key, size)), i, block.astype(np.int32), blocks.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in cols], ["key", "id", "block", "blocks"])

    found = keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, block int, blocks int")
    return found.dropDuplicates(["key", "id"])


class Sketches:
    """The sketches of a table's rows, of different lengths."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks().cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)
        self.size = np.diff(self.at)

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Sketches in `size` bytes: bits that coincide are XORed, which is the parity again."""
        out = np.zeros((len(rows), size), np.uint8)
        for own in np.unique(self.size[rows]):
            some = np.flatnonzero(self.size[rows] == own)
            x = self.data[self.at[rows[some]][:, None] + np.arange(own)]
            out[some] = np.bitwise_xor.reduce(x.reshape(len(some), own // size, size), axis=1)
        return out.view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of rows i and j, pair by pair, in the shorter one's length."""
        out = np.zeros(len(i), np.int64)
        size = np.minimum(self.size[i], self.size[j])
        for s in np.unique(size):
            some = np.flatnonzero(size == s)
            rows, back = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
            x, step = self.folded(rows, int(s)), max(1, (1 << 22) // int(s))
            for a in range(0, len(some), step):
                p, q = back[: len(some)][a : a + step], back[len(some) :][a : a + step]
                out[some[a : a + step]] = np.bitwise_count(x[p] ^ x[q]).sum(axis=1)
        return out


def pairs_of(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within runs of rows, about PAIRS at a time."""
    left, right, held = [], [], 0
    for s in np.unique(size[size > 1]):
        if s * (s - 1) // 2 > PAIRS:  # some rows of a run at a time
            step = max(1, PAIRS // int(s))
            for start in first[size == s]:
                for at in range(0, int(s) - 1, step):
                    a = np.arange(at, min(at + step, int(s) - 1))
                    i = np.repeat(a, s - 1 - a)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(s - 1 - a) - (s - 1 - a), s - 1 - a) + i + 1
                    yield start + i, start + j
            continue
        a, b = np.triu_indices(s, 1)
        own = first[size == s]
        step = max(1, PAIRS // len(a))
        for at in range(0, len(own), step):
            left.append((own[at : at + step, None] + a).ravel())
            right.append((own[at : at + step, None] + b).ravel())
            held += len(left[-1])
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def spanning(i: np.ndarray, j: np.ndarray, far: np.ndarray, count: int) -> np.ndarray:
    """Which of the edges between nodes i and j (below count) are in a forest of the nearest."""
    order = np.argsort(far, kind="stable")
    top, keep = np.arange(count), []
    while True:
        order = order[top[i[order]] != top[j[order]]]
        if not len(order):
            return np.array(keep, np.int64)
        nearest = np.full(count, -1)
        for end in (j, i):  # of a node's edges the first one is written last
            nearest[top[end[order[::-1]]]] = order[::-1]
        for e in np.unique(nearest[nearest >= 0])[np.argsort(far[np.unique(nearest[nearest >= 0])], kind="stable")].tolist():
            a, b = top[i[e]], top[j[e]]
            while top[a] != a:
                a = top[a]
            while top[b] != b:
                b = top[b]
            if a != b:
                top[max(a, b)] = min(a, b)
                keep.append(e)
        while (top[top] != top).any():
            top = top[top]


def near_pairs(t: pa.Table, num: int, den: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs with one key and different labels that may be near enough: all, or a forest for each key. t is sorted by key."""
    k, label, n, block = (t.column(c).to_numpy() for c in ("key", "label", "n", "block"))
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(head, len(k)))
    two = np.minimum.reduceat(block, head) != np.maximum.reduceat(block, head)  # these keys compare between blocks only
    two = np.repeat(two, size)
    sketches, found = Sketches(t.column("sketch")), []
    for i, j in pairs_of(head, size):
        fine = (label[i] != label[j]) & ~(two[i] & (block[i] == block[j]))
        i, j = i[fine], j[fine]
        fine = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        i, j = i[fine], j[fine]
        far = sketches.apart(i, j)
        fine = far <= most_apart(n[i], n[j], num, den)
        found.append((i[fine], j[fine], far[fine]))
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if forest and len(i):
        bucket = np.repeat(np.arange(len(head)), size)
        node = np.unique(np.stack([bucket, label]), axis=1, return_inverse=True)[1].ravel()
        keep = spanning(node[i], node[j], far, int(node.max()) + 1)
        i, j = i[keep], j[keep]
    return i, j


def candidates(rows: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Pairs (bucket, a, b), a < b, from rows (key, id, block, blocks, label, n, sketch)."""

    def run(batches):
        for t in grouped(batches, "key"):
            i, j = near_pairs(t, num, den, forest)
            if len(i):
                ids, bucket = t.column("id").to_numpy(), t.column("bucket").to_numpy()
                cols = bucket[i], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "a", "b"])

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one, two = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.withColumn("bucket", F.col("key")).withColumn("other", other)
    rows = rows.withColumn("key", F.when(F.col("blocks") > 1, F.xxhash64("key", one, two)).otherwise(F.col("key")))
    rows = rows.repartition("key").sortWithinPartitions("key").select("key", "bucket", "id", "block", "label", "n", "sketch")
    return rows.mapInArrow(run, "bucket long, a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, good) of the pairs; sets (id, members); good: the sets have Jaccard num/den or more."""
    s = sets.select(F.col("id").alias("a"), F.col("members").alias("s"))
    t = sets.select(F.col("id").alias("b"), F.col("members").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    good = (both > 0) & (den * both >= num * (F.size("s") + F.size("t") - both))
    return pairs.join(s, "a").join(t, "b").select("a", "b", good.alias("good"))


def verified_texts(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As verified(), from texts (id, text): these take less room than their sets."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 128):  # so many texts' sets at a time
                part, sets = batch.slice(at, 128), []
                for side in ("s", "t"):
                    own = []
                    for _, values, first in set_of(part.column(side), k):
                        own += [values[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
                    sets.append(own)
                for r, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[at + r] = both and den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "good"])

    s = texts.select(F.col("id").alias("a"), F.col("text").alias("s"))
    t = texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    return pairs.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long, good boolean")


def link(
    keys: DataFrame, units_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], num: int, den: int, share: int = FOREST_SHARE
) -> DataFrame:
    """(id, component) of the units that have links.

    keys (key, id): buckets; units_of(ids) gives (id, n, sketch), size and sketch of these units' sets,
    and may give more; verify(pairs, units) gives (a, b, good) of pairs (a, b), from the units of both.
    The first forests are drawn over one bucket in `share`; with 1, step 3 is left out. A unit without
    links has no row.
    """
    shared = saved(crowded(keys))
    known = units_of(shared.select("id").distinct())
    units = known.select("id", "n", "sketch")

    def judged(rows: DataFrame, forest: bool) -> tuple[DataFrame, DataFrame]:
        """Edges with their buckets, and (a, b, good)."""
        edges = saved(candidates(rows.join(units, "id"), num, den, forest))
        pairs = edges.select("a", "b").distinct()
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return edges, saved(verify(pairs, known.join(ids, "id")))

    def mixed(rows: DataFrame, label: DataFrame) -> DataFrame:
        """Rows of the buckets that are in several components."""
        rows = rows.join(label.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        some = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
        return rows.join(some.select("key"), "key", "left_semi")

    def failed(edges: DataFrame, judged: DataFrame) -> DataFrame:
        return edges.join(judged.filter("not good"), ["a", "b"], "left_semi").select(F.col("bucket").alias("key"), F.lit(True).alias("failed")).distinct()

    taken = F.pmod("key", F.lit(share)) == 0
    edges, found = judged(shared.filter(taken).withColumn("label", F.col("id")), True)
    label = saved(components(found.filter("good").select("a", "b")))
    if share > 1:
        again = shared.join(failed(edges, found), "key", "left").filter(~taken | F.col("failed")).drop("failed")
        edges, found = judged(mixed(again, label), True)
        label = saved(joined_components(label, found.filter("good").select("a", "b")))
    last = shared.join(failed(edges, found), "key", "left_semi")
    _, rest = judged(mixed(last, label), False)
    return joined_components(label, rest.filter("good").select("a", "b"))
