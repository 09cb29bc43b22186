"""Benchmark passages in documents, in DataFrame functions alone.

Windows have an item's number of words and begin at any word.  Weighted Jaccard
similarity (minima over maxima of shingle counts) decides; a similarity implies
a number of shared shingles, wherever they stand, so windows with fewer places
that hold a shingle of the item are left out and no other window is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Largest set of benchmark shingles that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(words: Column, size: Column) -> Column:
    """Hashes of the runs of ``size`` words (all words if fewer; none of none)."""
    last = F.greatest(F.size(words) - size + 1, F.lit(1))
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, size))))


def _shared(a: Column, b: Column) -> Column:
    """Sum of the minima of the shingles' counts."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


def _best_window(threshold: float) -> Column:
    """(similarity, -start) of the best window among ``hits``, the places in order that hold a shingle of the item; null if none reaches ``threshold``.

    A window is met once, from the first place in it: the places it needs follow
    there, and the place before lies outside.
    """
    hits, sh, need = F.col("hits"), F.col("sh"), F.col("need")
    n = F.size(sh)

    def windows(i: Column) -> Column:
        low = F.greatest(hits[i + need - 1]["at"] - n + 1, F.when(i > 0, hits[F.greatest(i - 1, F.lit(0))]["at"] + 1).otherwise(0), F.lit(0))
        high = F.least(hits[i]["at"], F.col("n_words") - F.col("len"))
        starts = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda s: judged(i, s))

    def judged(i: Column, start: Column) -> Column:
        inside = F.transform(F.filter(F.slice(hits, i + 1, n), lambda x: x["at"] < start + n), lambda x: x["h"])
        return F.transform(F.array(_shared(inside, sh)), lambda both: F.struct((both / (2 * n - both)).alias("similarity"), (-start).alias("back")))[0]

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - need), windows))
    return F.array_max(F.filter(found, lambda x: x["similarity"] >= threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, pos, n_words, similarity): each document's best window for each item at ``threshold`` or more.

    Ties go to the first position.  Null or empty texts and items match nothing.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).filter("size(w) > 0 and item_id is not null")
    items = items.groupBy("w").agg(F.collect_set("item_id").alias("ids")).withColumn("size", F.least(F.size("w"), F.lit(SHINGLE))).withColumn("sh", _shingles(F.col("w"), F.col("size")))
    items = items.select(F.xxhash64("w").alias("item"), "ids", F.size("w").alias("len"), "size", "sh")
    # both / (2 n - both) >= threshold; less a little, as the quotient decides
    items = items.withColumn("need", F.greatest(F.ceil(F.size("sh") * (2 * threshold / (1 + threshold)) - 1e-9), F.lit(1)).cast("int"))
    places = items.select("item", "size", F.explode("sh").alias("h")).groupBy("size", "h").agg(F.collect_set("item").alias("items"))
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # 1 to SHINGLE
    texts = docs.filter("doc_id is not null").select("doc_id", _words(F.col("text")).alias("w"))
    # before the shingles are dealt out, so once a text
    texts = texts.select("doc_id", F.xxhash64("w").alias("print"), F.size("w").alias("n_words"), "w")
    hits = None
    for s in sizes:
        found = texts.filter(F.col("n_words") >= s).select("doc_id", "print", "n_words", F.posexplode(_shingles(F.col("w"), F.lit(s))).alias("at", "h"))
        found = found.join(places.filter(F.col("size") == s).drop("size"), "h").withColumn("item", F.explode("items")).drop("items")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, pos long, n_words int, similarity double")
    # rows of one doc_id with other words are texts of their own
    hits = hits.groupBy("doc_id", "print", "n_words", "item").agg(F.sort_array(F.collect_set(F.struct("at", "h"))).alias("hits"))
    near = hits.join(items, "item").filter(F.size("hits") >= F.col("need")).withColumn("b", _best_window(threshold)).filter("b is not null")
    best = near.withColumn("item_id", F.explode("ids")).groupBy("doc_id", "item_id").agg(F.max(F.struct("b.similarity", "b.back", "len")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("pos"), F.col("b.len").cast("int").alias("n_words"), F.col("b.similarity").alias("similarity"))
