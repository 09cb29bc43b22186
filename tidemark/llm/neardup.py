"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification, components.

A link is a pair of texts whose sets of word shingles have a Jaccard similarity
of at least a threshold.  Equal sets are one class with one representative, so
copies are never compared.  A band's members are compared with its smallest
representative first.  Members of bands that still hold several components then
meet where a link demands it: linked sets share one of their rarest shingles, at
places in the order of rarity that their sizes fix (pairs inside a component add nothing).
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U, Words, mix, slices, whole_hash
from .workspace import WHOLE, Workspace, lookup

#: 32 bands of 5 minima: at a similarity of 0.8 a pair shares no band with a chance under 4e-6, at 0.85 under 1e-8.
BANDS, ROWS = 32, 5
BATCH = 32
#: Chance, after each batch of minima, that a pruned pair is a link.
MISS = 1e-9
#: Hub texts with more than 1 in HUBS of all pairs are broadcast: fewer than HUBS.
HUBS = 200
#: Pairs up to which all their signatures (640 bytes), or shingle sets (no more than of hubs), are broadcast.
WHOLE_VALUES = {"sig": 2048, "shingles": HUBS}
#: Further hubs are compared first while more pairs than so many for each open member share a rare shingle.
PAIRS_PER_MEMBER = 8
#: A turn of further hubs that links fewer than 1 in so many of its pairs is the last.
LEAST_YIELD = 50


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's bounds in them."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    starts = words.window_starts(size)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    values, owner = words.sequence_hashes(size, hashes)[starts], row[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        values = np.concatenate([values, np.array([whole_hash(hashes[words.first[i] : words.first[i + 1]]) for i in short], dtype=U)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(words.counts) + 1))


@lru_cache(maxsize=8)
def least_matches(threshold: float, seen: int, miss: float = MISS) -> int:
    """Fewest matches of ``seen`` minima with which P(similarity >= threshold) is at least ``miss``.

    Under a uniform prior the posterior is Beta(m + 1, seen - m + 1); its upper tail is a binomial sum.
    """
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def _classes(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part.column("text"), size)
                sums = []
                for salt in (0x51ED270B0A1D2F35, 0xB5026F5AA96619E9):
                    total = np.zeros(len(values) + 1, U)
                    np.cumsum(mix(values ^ U(salt)), out=total[1:])
                    sums.append(total[at[1:]] - total[at[:-1]])
                n = np.diff(at)
                keys = [f"{a:016x}{b:016x}" if k else None for a, b, k in zip(*(s.tolist() for s in sums), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "class", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, class string, n_shingles long")


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    k = BANDS * ROWS
    rng = np.random.default_rng(20240101)
    salts, odd = rng.integers(0, 2**63, k, dtype=np.int64).astype(U), rng.integers(0, 2**63, k, dtype=np.int64).astype(U) * U(2) + U(1)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, at = shingle_sets(part.column("text"), size)
                out = np.zeros((len(part), k), np.int32)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for j in range(k):
                        out[full, j] = (np.minimum.reduceat((values ^ salts[j]) * odd[j] >> U(32), at[full])).astype(np.uint32).view(np.int32)
                rows = np.arange(len(part) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(rows * k), pa.array(out.ravel())), pa.array(np.diff(at))], names=["rep", "sig", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "rep long, sig array<int>, n long")


def _sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of the documents in ``reps`` (column rep, each once), from their texts: the sets are not kept for all."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, at = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], names=["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, "rep long, shingles array<long>")


def _plausible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Drop pairs whose minima, batch after batch, leave a link too unlikely."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for end in range(BATCH, left.shape[1] + 1, BATCH):
                matches[alive] += (left[alive, end - BATCH : end] == right[alive, end - BATCH : end]).sum(axis=1)
                alive = alive[matches[alive] >= least_matches(threshold, end)]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a long, b long")


def _verify(space: Workspace, pairs: DataFrame, sigs: DataFrame, docs: DataFrame, size: int, percent: int, label: str) -> tuple[DataFrame, int, int]:
    """The pairs (a, b) that are links, as a table, and the numbers of pairs and of links."""

    def attach(rows: DataFrame, values_of: DataFrame, column: str, total: int) -> DataFrame:
        for side in ("a", "b"):
            degree = rows.groupBy(side).agg(F.count(F.lit(1)).alias("__deg"))
            values = degree.join(values_of.select(F.col("rep").alias(side), F.col(column).alias(f"{column}_{side}")), side)
            rows = lookup(rows, values, side, "__deg", total, "a" if side == "b" else "b", HUBS, WHOLE_VALUES[column])
        return rows

    pairs = space.table(pairs, f"{label}-pairs")
    n = pairs.count()
    likely = space.table(_plausible(attach(pairs, sigs, "sig", n), percent / 100), f"{label}-likely")
    space.drop(pairs)
    sets = space.table(_sets(docs, likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), size), f"{label}-sets")
    found = attach(likely, sets, "shingles", likely.count())
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = space.table(found.filter(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b"), f"{label}-links")
    space.drop(likely, sets)
    space.release()
    return links, n, links.count()


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of edges (a, b); star by star until none changes."""
    current = space.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    state = None
    while True:
        total = 2 * current.count()
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = lookup(both, least, "u", "n", total, "v", whole=WHOLE).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = space.table(large, "cc-large")
        space.drop(current)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = lookup(large, least, "u", "n", total, "v", whole=WHOLE)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = space.table(small, "cc")
        space.drop(large)
        space.release()
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        state = now


def _rare_places(members: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """(t, pos, rep, n, c): shingles of ``members`` (rep, n, c) that may be the rarest one shared with a link.

    Shingles stand in ascending order of their frequency among the members.  Two sets
    with at least ``percent`` in common share one among their first n - n * percent / 100 + 1.
    Shingles of one member alone come first and meet nothing.
    """
    shingles = sets.join(members.select("rep", "c"), "rep").select("rep", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    often = shingles.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").withColumn("often", F.col("f"))
    shared = lookup(shingles, often, "t", "f", total, "rep", whole=WHOLE).filter("often is not null")
    ranked = shared.groupBy("rep", "c", "n").agg(F.array_sort(F.collect_list(F.struct("often", "t"))).alias("ts"))
    first = F.floor((F.col("n") * (100 - percent)) / 100).cast("int") + 1
    ranked = ranked.withColumn("alone", F.col("n") - F.size("ts")).withColumn("ts", F.slice("ts", F.lit(1), F.greatest(first - F.col("alone"), F.lit(0))))
    places = ranked.select("rep", "c", "n", "alone", F.posexplode("ts").alias("i", "x"))
    return places.select(F.col("x.t").alias("t"), (F.col("alone") + F.col("i")).alias("pos"), "rep", "n", "c")


def _leading(percent: int):
    """Places that may be the rarest shared shingle with a set that is not smaller."""
    return (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")


def _rare_pairs(places: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a shingle from whose place on enough shingles follow in both sets; the smaller set is y."""
    x, y = places.alias("x"), places.filter(_leading(percent)).alias("y")
    need = percent * (F.col("x.n") + F.col("y.n"))
    enough = ((100 + percent) * (F.col("x.n") - F.col("x.pos")) >= need) & ((100 + percent) * (F.col("y.n") - F.col("y.pos")) >= need)
    turn = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.rep") < F.col("x.rep")))
    near = enough & turn & (100 * F.col("y.n") >= percent * F.col("x.n")) & (F.col("x.c") != F.col("y.c"))
    found = x.join(y, (F.col("x.t") == F.col("y.t")) & near)
    return found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id and text; other columns are ignored.  Null and wordless texts
    have no shingles, are linked with nothing and are kept.  A null doc_id is no
    document's smallest one: such a row has the id of its copies with one, or null
    as component and as kept.  ``docs`` is read several times (texts of pairs to be
    confirmed are read again rather than kept), so it should be a table.
    """
    space = Workspace(spark, "neardup")
    rows = space.table(_classes(docs, size), "classes")
    total = rows.count()
    reps = space.table(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    sigs = space.table(_signatures(docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), size), "signatures")
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    everyone = sigs.select("rep", "n", F.explode(keys).alias("band"))
    bands = everyone.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    bands = space.table(bands, "bands")
    members = space.table(lookup(everyone, bands, "band", "k", total * BANDS, "rep", whole=WHOLE).filter("hub is not null"), "members")
    space.drop(bands)
    stars = space.table(members.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links, _, _ = _verify(space, stars, sigs, docs, size, percent, "star")
    done, turn, waste = stars, 0, [stars]
    while True:
        # members of bands that hold several components; a pair inside a component adds nothing
        first = space.table(components(space, links), "labels")
        labelled = members.join(first, members.rep == first.node, "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
        order = F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "c")
        mixed = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(order).alias("pick"), F.count(F.lit(1)).alias("k")).filter("low <> high")
        open_rows = space.table(lookup(labelled, mixed, "band", "k", total * BANDS, "rep", whole=WHOLE).filter("low is not null"), "open")
        space.drop(first)
        alone = space.table(open_rows.select("rep", "n", "c").distinct(), "alone")
        size_of = alone.agg(F.count(F.lit(1)), F.sum("n")).first()
        sets = space.table(_sets(docs, alone, size), "open-sets")
        places = space.table(_rare_places(alone, sets, percent, size_of[1] or 0), "places")
        space.drop(sets, alone)
        space.release()
        met = places.groupBy("t").agg((F.count(F.lit(1)) * F.count_if(_leading(percent))).alias("k")).agg(F.sum("k")).first()[0] or 0
        if met <= PAIRS_PER_MEMBER * size_of[0]:
            break
        # one other hub for each band and turn: as many pairs as members at most
        more = open_rows.filter("c <> pick.c").select(F.least("rep", "pick.rep").alias("a"), F.greatest("rep", "pick.rep").alias("b")).distinct()
        more = space.table(more.join(done, ["a", "b"], "left_anti"), "hub-pairs")
        done, turn = done.union(more), turn + 1
        new, n_pairs, n_links = _verify(space, more, sigs, docs, size, percent, f"hub-{turn}")
        links = links.union(new)
        waste += [more, open_rows]
        if LEAST_YIELD * n_links < n_pairs:
            break
        space.drop(open_rows, places)
    space.drop(members)
    more, _, _ = _verify(space, _rare_pairs(places, percent).join(done, ["a", "b"], "left_anti"), sigs, docs, size, percent, "rest")
    space.drop(sigs, places, open_rows, *waste)
    found = components(space, links.union(more))
    named = space.table(reps.join(found, reps.rep == found.node, "left").select("class", F.coalesce("component", "rep").alias("component_id"), "n"), "named")
    out = lookup(rows, named, "class", "n", total, "doc_id", whole=WHOLE).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = space.table(out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "out")
    space.drop_all_but(out)
    space.release()
    return out
