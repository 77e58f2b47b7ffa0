"""Near-duplicate vectors by a robust-pruned flat graph.

1. Exact copies of a vector within a label are one node with a count.
2. A bounded sample gives cluster centres for each label; every node goes to the shards of its nearest
   centres, OVERLAP of them, so that neighbours meet in some shard whatever the borders.
3. In each shard a graph is built: candidates are the nearest nodes of the shard, and robust pruning
   drops a candidate that lies nearer to one already kept than to the node itself by factor ALPHA.
   The adjacency lists that a node got in its shards are united.
4. Each node searches the united graph from the medoids of each of its shards, one for each
   part of the shard's graph that no edge joins to the rest (a group of more near copies than CANDIDATES
   is such a part); when the beam settles, the search widens to every node within the range, following
   neighbours of hits. A search runs in the task that holds its shard's nodes and their united lists.
5. The nodes of the shard within the range are counted by a matrix product, some rows at a time; where a
   search found fewer, the node's row of the product gives them all. So no pair is lost that meets in a shard.
6. Every pair found is verified: cosine in double precision.

Pairs are counted where they are found and never written: a task returns the number of copies linked with each
of its nodes, and a spanning forest of its links. A pair that meets in two shards counts in the first. A shard of more than
BLOCK nodes is cut into blocks with graphs of their own, and each pair of blocks is a task's work; a task
holds two blocks and the product of ROWS rows with one, however many near copies a group has.

More centres are drawn for more nodes, so that a shard has about SHARD of them; centres that would be linked are one, so that
no border cuts a group of near copies. audit() measures recall against brute force for every vector whose id is divisible by 50.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; so do
those with a null label or a null vec_id. Vectors of different length never link. Repeated vec_ids are rows of
their own. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, saved

SHARD = 2000
OVERLAP = 2
DEGREE = 24
ALPHA = 1.2
CANDIDATES = 64
BEAM = 32
#: Nodes of a shard that are compared with as many at a time, and rows of their product that are held.
BLOCK, ROWS = 4096, 256
#: Vectors that the centres are drawn from, for each label.
SAMPLE = 4000
#: Centres of a label, at most.
CENTRES = 4096


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of vectors as they are."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def centres(x: np.ndarray, n: int, seed: int = 7, least: float = 2.0) -> np.ndarray:
    """n centres of unit vectors by a few rounds of spherical k-means; of those with a cosine of `least` or more the first."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(6):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own := x[near == j].sum(axis=0)).any():
                c[j] = own / np.linalg.norm(own)
    kept = [0]
    for j in range(1, len(c)):
        if (c[kept] @ c[j]).max() < least:
            kept.append(j)
    return c[kept]


def robust_pruned(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Neighbours (up to DEGREE, -1 for none) of each unit vector among the others."""
    n, out = len(x), np.full((len(x), DEGREE), -1, np.int32)
    most = min(CANDIDATES, n - 1)
    for at in range(0, n if most > 0 else 0, block):
        sims = x[at : at + block] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -2.0
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 1 - np.take_along_axis(sims, near, 1)
        between = 1 - np.einsum("bid,bjd->bij", x[near], x[near])
        alive = np.ones(near.shape, bool)
        for slot in range(DEGREE):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            out[at + rows[some], slot] = near[rows[some], pick[some]]
            alive &= ALPHA * between[rows, pick] > far
            alive[rows, pick] = False
    return out


def lists(ids: np.ndarray, near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours (lists of ids) as places in the sorted ids: where each list begins, and all of them; those not in ids are left out."""
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    to = near.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    some = ids[at] == to
    return np.searchsorted(row[some], np.arange(len(ids) + 1)), at[some]


def around(nodes: np.ndarray, graph: tuple[np.ndarray, np.ndarray], seen: np.ndarray) -> np.ndarray:
    """The neighbours of some nodes that are not seen yet; now they are."""
    first, to = graph
    size = first[nodes + 1] - first[nodes]
    hit = np.zeros(len(seen), bool)
    hit[to[np.repeat(first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
    new = np.flatnonzero(hit & ~seen)
    seen[new] = True
    return new


def medoids(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The medoid of each part of a graph (edges go both ways) that no edge joins to the rest."""
    seen, out = np.zeros(len(x), bool), []
    for n in range(len(x)):
        if not seen[n]:
            seen[n], new, own = True, np.array([n]), []
            while len(new):
                own.append(new)
                new = around(new, graph, seen)
            part = np.concatenate(own)
            out.append(part[np.argmax(x[part] @ x[part].mean(axis=0))])
    return np.array(out, np.int64)


def searched(q: np.ndarray, x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], starts: np.ndarray, least: float) -> np.ndarray:
    """For each row of q, which rows of x it finds with cosine of about `least` or more: beam search, then range expansion."""
    found = np.zeros((len(q), len(x)), bool)
    for v, hit in zip(q, found, strict=True):
        seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
        seen[starts] = True
        beam, score = starts, x[starts] @ v
        while len(beam):  # the nodes of the beam that aren't yet expanded are, until none is left
            best = np.argsort(-score, kind="stable")[:BEAM]
            beam, score = beam[best], score[best]
            todo = beam[~done[beam]]
            if not len(todo):
                break
            done[todo] = True
            new = around(todo, graph, seen)
            beam, score = np.concatenate([beam, new]), np.concatenate([score, x[new] @ v])
        new = beam[score >= least]
        while len(new):  # range expansion: every hit's neighbours, whatever the beam's width
            hit[new] = True
            new = around(new, graph, seen)
            new = new[x[new] @ v >= least]
    return found


def verified(found: np.ndarray, sims: np.ndarray, raw: np.ndarray, others: np.ndarray, least: float, slack: float = 1e-6) -> np.ndarray:
    """found, with all within the range in rows that have more than were found, and without what is not `least` by cosines()."""
    near = sims >= least - slack
    short = near.sum(axis=1) > found.sum(axis=1)
    found = np.where(short[:, None], near, found) & near
    i, j = np.nonzero(found & (sims < least + slack))  # so close to it that the order of a sum may tell
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        found[a, b] = cosines(raw[a], others[b]) >= least
    return found


def forest(found: np.ndarray, q: np.ndarray, n: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """Links (place, place) that join parts, by places q of the rows and n of the columns; part (by place) is brought up to date."""
    out = []
    for i in np.flatnonzero(found.any(axis=1)):
        to = n[found[i]]
        parts, one = np.unique(part[to], return_index=True)
        one = to[one[parts != part[q[i]]]]
        if len(one):
            out.append(np.stack([np.full(len(one), q[i]), one]))
            known = np.union1d(parts, part[q[i]])
            part[np.isin(part, known)] = known[0]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that can link."""
    v = F.col("vector")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0))


def shard_of(sample: DataFrame, sizes: dict, least: float) -> dict:
    """Centres by (label, length), from a bounded sample."""
    got = sample.toPandas()  # SAMPLE rows a label at most
    out = {}
    for key, own in got.groupby(["label", "dim"]):
        n = int(np.clip(np.ceil(2 * OVERLAP * sizes[key] / SHARD), 1, CENTRES))
        out[key] = centres(unit(own.vector.tolist()), n, least=least)
    return out


def assigned(nodes: DataFrame, at: dict) -> DataFrame:
    """nodes with a row for each of their shards: shard (number of a centre), homes (those of all its rows)."""
    shared = nodes.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        for b in batches:
            label, dim = (b.column(c).to_pylist() for c in ("label", "dim"))
            rows, shards, homes = [], [], []
            vectors = b.column("vector").to_pylist()
            for key in set(zip(label, dim, strict=True)):
                own = [i for i, k in enumerate(zip(label, dim, strict=True)) if k == key]
                c = shared.value[key]
                near = np.argsort(-(unit([vectors[i] for i in own]) @ c.T), axis=1, kind="stable")[:, :OVERLAP]
                rows += np.repeat(own, near.shape[1]).tolist()
                shards += near.ravel().tolist()
                homes += np.repeat(near, near.shape[1], axis=0).tolist()
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(shards, pa.int32()), pa.array(homes, pa.list_(pa.int32()))], [*b.schema.names, "shard", "homes"])

    schema = nodes.schema.simpleString()[len("struct<") : -1].replace(":", " ", len(nodes.columns))
    return nodes.mapInArrow(run, f"{schema}, shard int, homes array<int>")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows with block and blocks: a shard of more than BLOCK nodes is dealt to blocks by a hash."""
    by = ["label", "dim", "shard"]
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each centre
    return rows.join(F.broadcast(sizes), by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def graphs(rows: DataFrame) -> DataFrame:
    """(node, near): each node's neighbours, from the graphs of its shards' blocks."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        graph = robust_pruned(unit(t.column("vector").to_pylist()))
        a, slot = np.nonzero(graph >= 0)
        b = graph[a, slot]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])  # edges can be walked both ways
        a, b = np.unique(np.stack([a, b]), axis=1)
        first = np.searchsorted(a, np.arange(len(ids) + 1))
        near = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids[b]))
        return pa.table({"node": pa.array(ids), "near": near})

    each = rows.groupBy("label", "dim", "shard", "block").applyInArrow(run, "node long, near array<long>")
    return each.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def links(rows: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """Of nodes that have others with cosine `least` or more: (a, null, the copies linked with it); and links (a, b, 0) that join what all of them join."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        ids, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
        raw = t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        homes = t.column("homes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x, shard, same = unit(raw), t.column("shard")[0].as_py(), block.min() == block.max()
        # of two blocks the one's nodes ask for the other's, in that one's graph
        n, asking = np.flatnonzero(block == block.max()), np.flatnonzero(block == block.min())
        busy = not same or t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        total, part, taken = np.zeros(len(ids), np.int64), np.arange(len(ids)), [np.zeros((2, 0), np.int64)]
        near = lists(ids[n], t.column("near").take(pa.array(n)))
        starts = medoids(x[n], near) if busy else n[:0]
        for at in range(0, len(asking) if busy else 0, ROWS):
            q = asking[at : at + ROWS]
            sims = x[q] @ x[n].T
            found = searched(x[q], x[n], near, starts, least - 1e-6)
            if same:
                own = np.arange(len(q)), at + np.arange(len(q))
                found[own], sims[own] = False, -2.0
            found = verified(found, sims, raw[q], raw[n], least)
            for h in homes[q].T:
                for g in homes[n].T:  # pairs that meet in an earlier shard, too
                    found &= (h[:, None] != g) | (h >= shard)[:, None]
            weight = found.astype(float)
            total[q] += (weight @ copies[n]).astype(np.int64)
            if not same:
                total[n] += (copies[q] @ weight).astype(np.int64)
            taken += forest(found, q, n, part)
        a, b = ids[np.concatenate(taken, axis=1)]
        some = total > 0
        left, right = pa.array(np.concatenate([ids[some], a])), pa.chunked_array([pa.nulls(int(some.sum()), pa.int64()), pa.array(b)])
        return pa.table({"a": left, "b": right, "others": np.concatenate([total[some], np.zeros(len(a), np.int64)])})

    by = ["label", "dim", "shard", "lo", "hi"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = rows.join(graph, "node").withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    tasks = tasks.select(*by, "node", "vector", "copies", "homes", "block", "near")
    return tasks.groupBy(*by).applyInArrow(run, "a long, b long, others long")


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.98) -> float:
    """Share of the true links of every vector with an id divisible by 50 that n_links in found counts.

    A stated set of queries against all rows; Spark deals both out by label.
    """
    good = usable(vectors)
    queries = good.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("q"), F.col("vector").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, w = F.col("vector"), F.col("w")
    near = dot(v, w) / F.sqrt(dot(v, v) * dot(w, w)) >= least
    true = good.join(queries, "label").filter((F.col("vec_id") != F.col("q")) & (F.size("vector") == F.size("w")) & near)
    true = true.groupBy(F.col("q").alias("vec_id")).agg(F.count("*").alias("true"))
    row = true.join(found, "vec_id").agg(F.sum(F.least("true", "n_links")).alias("got"), F.sum("true").alias("all")).first()
    return row["got"] / row["all"] if row["all"] else 1.0


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Links: equal labels and cosine >= least."""
    good = usable(vectors)
    copies = saved(good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
    sizes = {(r["label"], r["dim"]): r["n"] for r in copies.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label, dim in sizes:  # labels are few; each sample is bounded
        own = copies.filter((F.col("label") == label) & (F.col("dim") == dim)).orderBy(F.xxhash64("node"), "node").limit(SAMPLE)
        sample = own if sample is None else sample.unionByName(own)
    found = copies.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("copies").alias("others")).limit(0)
    if sample is not None:
        at = shard_of(sample.select("label", "dim", "vector"), sizes, least)
        rows = in_blocks(saved(assigned(copies.select("node", "label", "dim", "vector", "copies"), at)))
        found = links(rows, graphs(rows), least)
    found = saved(found)
    count = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    named = copies.join(count, "node", "left")
    pairs = found.filter("b is not null").select("a", "b")
    if not pairs.isEmpty():
        named = named.join(components(pairs).withColumnRenamed("id", "node"), "node", "left")
    else:
        named = named.withColumn("component", F.lit(None).cast("long"))
    named = named.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    mine = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select("vec_id").exceptAll(mine.select("vec_id"))
    out = mine.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
