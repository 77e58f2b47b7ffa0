"""Outlier scores of entities: (keys, features) to (keys, score in 0..1).

Rank-based detectors are plain SQL. The isolation forest draws its small samples through a bounded
top-k, builds trees with numpy and scores in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import saved
from .autoencoder import autoencoder
from .density import density_clusters
from .ranks import percentiles, running

WEIGHTS = {"isolation_forest": 1.0, "graph_rare_path": 1.5, "ecod": 0.9, "density": 0.8, "reconstruction": 1.2}
EULER = 0.5772156649015329


def long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value), NaN, infinities and nulls as 0."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    out = df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.feature", "p.value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return out.withColumn("value", F.when(bad, 0.0).otherwise(F.col("value")))


def left_tails(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value, p): p is the share of rows with a value not above this one's.

    Counts per distinct value come first, so that the running sum is over values, not rows.
    """
    rows = long(saved(df.select(*keys, *features)), keys, features)
    counts = running(rows.groupBy("feature", "value").agg(F.count("*").alias("c")), "value", ["feature"])
    return rows.join(counts.select("feature", "value", (F.col("upto") / F.col("n")).alias("p")), ["feature", "value"])


def ecod(df: DataFrame, keys: list[str], features: list[str], digits: int = 9) -> DataFrame:
    """Empirical-tail outlier score, min-max scaled over all rows."""
    tail = F.least("p", 1 - F.col("p"))
    raw = left_tails(df, keys, features).groupBy(*keys).agg(F.round(F.sum(-F.log(F.greatest(tail, F.lit(1e-10)))), digits).alias("raw"))
    return min_max(raw, "raw").select(*keys, F.col("scaled").alias("score"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """df with scaled: the column from 0 to 1; all 0 if it hardly varies."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    span = F.col("high") - F.col("low")
    return df.join(F.broadcast(ends)).withColumn("scaled", F.when(span < 1e-10, 0.0).otherwise((F.col(column) - F.col("low")) / span)).drop("low", "high")


def clipped(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """df with scaled: the column between two of its percentiles, from 0 to 1."""
    df = saved(df)
    ends = percentiles(df, column, {"low": low, "high": high}).drop("n")
    span = F.col("high") - F.col("low")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - F.col("low")) / span))
    return df.join(F.broadcast(ends)).withColumn("scaled", F.when(span < 1e-10, 0.0).otherwise(scaled)).drop("low", "high")


def average_rank(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share): rank of score, ties averaged, over the number of rows; computed over distinct scores."""
    counts = running(scores.groupBy("score").agg(F.count("*").alias("c")), "score")
    ranks = counts.select("score", ((F.col("upto") - F.col("c") + (F.col("c") + 1) / 2) / F.col("n")).alias("share"))
    return scores.join(ranks, "score").select(*keys, "share")


def ensemble(scores: dict[str, DataFrame], keys: list[str], weights: dict[str, float] | None = None, keep_constant: bool = False) -> DataFrame:
    """Weighted mean of the detectors' ranks.

    A detector that gives every row one score only pulls the mean to the middle and is left out,
    unless keep_constant.
    """
    weights, used, out = weights or WEIGHTS, [], None
    for name, s in scores.items():
        s = saved(s)
        if not keep_constant and s.agg(F.min("score") == F.max("score")).first()[0]:
            continue
        part = average_rank(s, keys).withColumnRenamed("share", name)
        out = part if out is None else out.join(part, keys)
        used.append(name)
    if out is None:
        return next(iter(scores.values())).select(*keys, F.lit(0.0).alias("score"))
    total = sum(F.col(n) * weights.get(n, 1.0) for n in used) / sum(weights.get(n, 1.0) for n in used)
    return out.select(*keys, total.alias("score"))


def alert_tier(score: Column, low: float = 0.90, high: float = 0.98) -> Column:
    return F.when(score >= high, "critical").when(score >= low, "investigation")


@dataclass
class Forest:
    """Isolation trees as arrays: feature (-1 in leaves), threshold, children, path length in leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over the expected one: near 1 for outliers."""
        depth = np.zeros(len(x))
        for feature, threshold, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            inner = feature[at] >= 0
            while inner.any():
                f = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] < threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
                inner = feature[at] >= 0
            depth += path[at]
        return 2.0 ** (-depth / len(self.trees) / max(expected_path(self.size), 1e-9))


def expected_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int, out: list) -> int:
    at = len(out)
    out.append([-1, 0.0, 0, 0, depth + expected_path(len(x))])
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth < most and len(spread):
        f = int(rng.choice(spread))
        t = rng.uniform(x[:, f].min(), x[:, f].max())
        low = x[:, f] < t
        if low.any() and not low.all():
            out[at][:2] = [f, t]
            out[at][2] = grow(x[low], rng, depth + 1, most, out)
            out[at][3] = grow(x[~low], rng, depth + 1, most, out)
    return at


def isolation_forest(df: DataFrame, keys: list[str], features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Scores clipped between their 1st and 99th percentiles; all 0 below ten rows.

    Trees are grown on the driver from at most trees * sample rows, picked by a hash of the keys.
    """
    values = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    rows = df.select(*keys, *values)
    picked = rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(trees * sample).toPandas()
    if len(picked) < 10:
        return rows.select(*keys, F.lit(0.0).alias("score"))
    x, rng, grown = picked[features].to_numpy(), np.random.default_rng(seed), []
    size = min(sample, len(x))
    for _ in range(trees):
        nodes: list = []
        grow(x[rng.choice(len(x), size, replace=False)], rng, 0, int(np.ceil(np.log2(size))), nodes)
        f, t, left, right, path = zip(*nodes, strict=True)
        grown.append((np.array(f), np.array(t), np.array(left), np.array(right), np.array(path)))
    forest = df.sparkSession.sparkContext.broadcast(Forest(grown, size))

    @F.pandas_udf("double")
    def raw(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.value.score(np.column_stack([c.to_numpy() for c in columns])))

    return clipped(rows.select(*keys, raw(*features).alias("raw")), "raw", 0.01, 0.99).select(*keys, F.col("scaled").alias("score"))


def reconstruction(df: DataFrame, keys: list[str], features: list[str], components: int = 8) -> DataFrame:
    """Error of putting rows back together from their first principal components, clipped at the 95th percentile.

    Stands in for an autoencoder: the linear one, with the same bottleneck idea.
    """
    # saved: scaler, components and errors each read the rows
    rows = saved(df.select(*keys, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]))
    vectors = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True).fit(vectors)
    pc = PCA(k=min(components, len(features)), inputCol="_scaled", outputCol="_parts").fit(scaler.transform(vectors)).pc.toArray()
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)

    @F.pandas_udf("double")
    def error(*columns: pd.Series) -> pd.Series:
        m = (np.column_stack([c.to_numpy() for c in columns]) - mean) * scale
        return pd.Series(((m - m @ pc @ pc.T) ** 2).mean(axis=1))

    raw = saved(rows.select(*keys, error(*features).alias("raw")))
    ends = percentiles(raw, "raw", {"high": 0.95}).select("high")
    score = F.least(F.lit(1.0), F.col("raw") / F.greatest("high", F.lit(1e-10)))
    return raw.join(F.broadcast(ends)).select(*keys, score.alias("score"))


def density(df: DataFrame, keys: list[str], features: list[str], bins: int = 4) -> DataFrame:
    """How few rows share a row's grid cells: one minus the mean share over pairs of neighbouring features.

    Stands in for density clustering; cells are quartile bins of two features, so it is two aggregates.
    """
    p = left_tails(df, keys, features)
    cell = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    wide = p.withColumn("cell", cell).groupBy(*keys).pivot("feature", features).agg(F.first("cell"))
    pairs = [F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(zip(features, features[1:] + features[:1], strict=True))]
    each = wide.select(*keys, F.explode(F.array(*pairs)).alias("c")).select(*keys, "c.*")
    counts = each.groupBy("pair", "a", "b").agg(F.count("*").alias("c"))
    total = counts.groupBy("pair").agg(F.sum("c").alias("n"))
    share = counts.join(F.broadcast(total), "pair").select("pair", "a", "b", (F.col("c") / F.col("n")).alias("share"))
    raw = each.join(share, ["pair", "a", "b"]).groupBy(*keys).agg((1 - F.avg("share")).alias("raw"))
    return clipped(raw, "raw", 0.01, 0.99).select(*keys, F.col("scaled").alias("score"))


def detect(features: DataFrame, keys: list[str], names: list[str], few: int = 200, paths: DataFrame | None = None, address: str = "src_ip") -> DataFrame:
    """Ensemble score of every entity; below `few` rows only the forest, the tails and the paths have a say.

    paths (id, score): the rare-path score of addresses; an entity has that of its address, 0 without one.
    """
    parts = {"isolation_forest": isolation_forest(features, keys, names), "ecod": ecod(features, keys, names)}
    if paths is not None:
        own = features.select(*keys).join(paths.select(F.col("id").alias(address), "score"), address, "left")
        parts["graph_rare_path"] = own.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))
    if features.limit(few).count() >= few:
        tails = left_tails(features, keys, names).groupBy(*keys).pivot("feature", names).agg(F.first("p"))
        parts["density"] = density_clusters(tails, keys, names).select(*keys, "score")
        parts["reconstruction"] = autoencoder(features, keys, names)
    return ensemble(parts, keys)


def gpd_threshold(scores: DataFrame, tail: float = 0.10, column: str = "score") -> DataFrame:
    """One row: threshold, critical, investigation; from a generalised Pareto tail above the 90th percentile.

    Below 100 scores the threshold is 0.95.
    """
    s = F.col(column)
    scores = saved(scores.select(column))
    base = percentiles(scores, column, {"u": 1 - tail})
    over = scores.join(F.broadcast(base)).filter(s > F.col("u")).select((s - F.col("u")).alias("y"))
    moments = over.agg(F.count("*").alias("k"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    return tail_levels(base.join(moments))


def tail_levels(df: DataFrame) -> DataFrame:
    """threshold, investigation, critical from n (scores), u (where the tail begins), k (scores beyond), m and v (mean and variance of what they exceed u by)."""
    m, v = F.col("m"), F.greatest("v", F.lit(1e-12))
    xi = F.least(F.lit(1.0), F.greatest(F.lit(-0.5), 0.5 * (1 - m * m / v)))
    sigma = 0.5 * m * (1 + xi)
    at = lambda q: F.when(F.abs(xi) < 1e-6, -sigma * F.log(F.lit(q))).otherwise(sigma / xi * (F.pow(F.lit(q), -xi) - 1))
    fitted = (F.col("n") >= 100) & (F.col("k") > 0)
    level = lambda q: F.when(fitted, F.least(F.lit(1.0), F.col("u") + at(q))).otherwise(0.95)
    t1, t2 = level(0.1), level(0.01)
    return df.select(t1.alias("threshold"), F.greatest(t1, F.lit(0.70)).alias("investigation"), F.greatest(t2, F.lit(0.85)).alias("critical"))


def score_sketch(scores: DataFrame, column: str = "score", by: list[str] | None = None, size: int = 800) -> DataFrame:
    """(by, sketch): a quantile sketch of a column's values, a few KB whatever their number; null and NaN values are left out."""
    return scores.filter(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(*(by or [])).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sketch) of the values of all sketches: so a stream's batches add up."""
    return sketches.filter(F.col("sketch").isNotNull()).groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_threshold(sketches: DataFrame, tail: float = 0.10, steps: int = 400) -> DataFrame:
    """gpd_threshold() from merged sketches: the tail's moments are those of its quantiles at even steps. One row; 0.95 without values."""
    one = merged_sketches(sketches)
    ranks = F.array(*[F.lit(1 - tail + tail * (j + 0.5) / steps) for j in range(steps)])
    one = one.withColumn("n", F.kll_sketch_get_n_double("sketch"))
    some = lambda rank: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", rank))
    q = one.select("n", some(F.lit(1 - tail)).alias("u"), some(ranks).alias("q"))
    over = F.filter(F.transform("q", lambda x: x - F.col("u")), lambda y: y > 0)
    q = q.select("n", "u", over.alias("y")).withColumn("k", F.size("y"))
    mean = F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("k"), F.lit(0))
    q = q.withColumn("m", mean).withColumn("v", F.aggregate("y", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.nullif(F.col("k"), F.lit(0)))
    return tail_levels(q.select(F.coalesce("n", F.lit(0)).alias("n"), "u", F.coalesce("k", F.lit(0)).alias("k"), "m", "v"))


def explain(df: DataFrame, keys: list[str], features: list[str], top: int = 5) -> DataFrame:
    """(keys, feature, value, tail, place): the features in which each row lies furthest out."""
    t = left_tails(df, keys, features).withColumn("tail", F.least("p", 1 - F.col("p")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("tail", "feature"))
    return t.withColumn("place", place).filter(F.col("place") <= top).select(*keys, "feature", "value", "tail", "place")
