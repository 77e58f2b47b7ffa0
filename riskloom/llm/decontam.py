"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, letters a to z (after lower-casing A to Z) and characters beyond ASCII. A
benchmark item gives a window for every `size` consecutive words, or one of all its words if it has
fewer. Documents are scanned for every window length: three words of each document window (first,
middle, last) are hashed and probed in the hash set of benchmark windows, which is broadcast up to
BROADCAST_WINDOWS windows (each counted once for every item that has it) and shuffled beyond; the words
of a probe that hits are then compared. A document's word is hit if it is in any occurrence of a window.

Null texts have no words. Items without words match nothing, and an empty benchmark hits nothing.
Items with equal windows all count as occurring. Repeated rows get a row each; rows of one doc_id with
different texts are judged each by its own text, and a null doc_id is a doc_id like others. Texts of any
length are taken whole: a row for each word, which carries no words through a shuffle. Ties can't arise.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of 13 words take about 200 bytes: 100 MB at most.
BROADCAST_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OTHER_CAPITAL = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
PIECES = rf"{ANY_CASE_WORD}|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """lower() also changes capitals beyond ASCII; texts that have such are translated letter by letter instead."""
    text = F.coalesce(text, F.lit(""))
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = F.when(text.rlike(OTHER_CAPITAL), letters).otherwise(F.lower(text))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def probe(words: Column, at: Column | int, length: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.xxhash64(F.get(words, at), F.get(words, at + length // 2), F.get(words, at + (length - 1)))


def probe_of(words: str, length: str) -> Column:
    w, n = F.col(words), F.col(length)
    return F.xxhash64(F.get(w, F.lit(0)), F.get(w, F.floor(n / 2).cast("int")), F.get(w, n - 1))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(length, window, items): the distinct windows and the ids of the items that have them."""
    n = F.size("words")
    cut = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.slice("words", i, F.lit(size)))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    each = items.select("item_id", F.explode(F.when(n >= size, cut).otherwise(F.array("words"))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("length", F.size("window"))


def scanned(docs: DataFrame, known: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """(doc_id, same, n_words, doc, start, stop, items): places of windows in documents, in words; of a document's rows
    one has doc 1, the others 0; without a place, items is null. Texts are cut into words once, for all lengths; places carry no words through a shuffle."""
    texts = docs.select("doc_id", "same", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    own = known.select(F.col("length").alias("window_length"), probe_of("window", "length").alias("probe"), "window", "items")
    at = texts.select("doc_id", "same", "n_words", "words", F.posexplode_outer("words").alias("start", "word"))
    tries = [F.struct(F.lit(n).alias("length"), probe(F.col("words"), F.col("start"), n).alias("probe")) for n in sorted(lengths)]
    none = F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("bigint").alias("probe"))
    at = at.select("*", F.inline(F.array(*tries, none) if len(tries) != 1 else F.array(*tries))).drop("word")
    whole = F.col("start") + F.col("length") <= F.col("n_words")
    same = (F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window")) & (F.col("length") == F.col("window_length"))
    first = F.coalesce("start", F.lit(0)) == 0
    if len(tries) != 1:
        first &= F.col("length").isNull()
    place = ["start", (F.col("start") + F.col("length")).alias("stop"), "items"]
    if sum(lengths.values()) <= BROADCAST_WINDOWS:
        at = at.withColumn("probe", F.when(whole, F.col("probe")))
        found = at.join(F.broadcast(own.withColumnRenamed("probe", "known")), (F.col("probe") == F.col("known")) & same, "left")
        return found.filter(F.col("window").isNotNull() | first).select("doc_id", "same", "n_words", first.cast("int").alias("doc"), *place)
    hit = at.filter(whole).select("doc_id", "same", "start", "length", "probe").join(own, "probe").drop("probe").distinct()
    key = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("same").eqNullSafe(F.col("of_same"))
    hit = hit.withColumnsRenamed({"doc_id": "of", "same": "of_same"})
    found = hit.join(texts.drop("n_words"), key).filter(same).select("doc_id", "same", F.lit(0).alias("n_words"), F.lit(0).alias("doc"), *place)
    bare = texts.select("doc_id", "same", "n_words", F.lit(1).alias("doc"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("start", "stop", "items")))
    return found.unionByName(bare)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, same, copies, n_words, spans, n_hit, n_items, item_ids) of every different document; spans: struct<start, stop>.

    same is a digest of the text: rows of one doc_id with different texts are judged each by its own, and `copies` equal
    ones together.
    """
    known = windows(benchmark, size)
    lengths = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.sum(F.size("items")).alias("n")).collect()}  # at most `size` lengths
    docs = docs.select("doc_id", digest(F.col("text")).alias("same"), "text")
    found = scanned(docs, known, lengths).groupBy("doc_id", "same").agg(
        F.sum("doc").cast("int").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "stop")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["reach"]))).alias("hit"),
        F.greatest(acc["reach"], s["stop"]).alias("reach"),
    )
    n_hit = F.aggregate("spans", zero, step, lambda acc: acc["hit"].cast("long"))
    return found.select("doc_id", "same", "copies", "n_words", "spans", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    contaminated: it has hits, and they are at least one in `share` of its words.
    """
    out = hits(docs, benchmark, size).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "item_ids").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def without_hit_words(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs with the hit words cut out of text; what stands between words stays."""
    found = hits(docs, benchmark, size).filter("n_hit > 0").select(F.col("doc_id").alias("hit_doc"), F.col("same").alias("hit_text"), "spans")
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    lead = F.when(F.col("text").rlike(rf"^{ANY_CASE_WORD}"), 0).otherwise(1)
    word = lambda i: F.floor((i - lead) / 2)
    hit = lambda i: F.exists("spans", lambda s: (word(i) >= s["start"]) & (word(i) < s["stop"]))
    kept = F.filter(pieces, lambda p, i: ((i - lead) % 2 != 0) | ~hit(i))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (digest(F.col("text")) == F.col("hit_text")), "left")
    return out.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat_ws("", kept))).select(docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS l, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) AS t
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
pos AS (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l),
hit AS (
  SELECT pos.doc_id, p, pos.l, item_id FROM pos JOIN win ON pos.l = win.l AND array_to_string(w[p : p + pos.l - 1], ' ') = win.t),
cover AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
