"""A stored inverted index, and the best documents for a whole table of queries.

A term's postings lie in blocks of descending weight, each with its greatest one.
A search first finds, for each query, a score that its k-th best document reaches at least
(``_floors``).  Terms that together stay below it bring in no document, and neither
does a block whose greatest weight, with the most that all other terms can add,
stays below it: such blocks are never opened.  The documents found in the others
are scored in full, so the result is exact.  A query of many words, or one whose floor
closes few blocks, is summed over all its postings instead, which gives the same
rows: blocks of such queries meet blocks of documents, as products of matrices.  The
blocks of documents are written once and each block of queries is sent to them, so what
is shuffled and written grows with the postings and not with the products.

Scores are whole numbers (millionths), so no order of addition shows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import tokens_spark
from tidemark.sources.scratch import Scratch

# Saturation and length normalisation of BM25.
K1, B = 1.5, 0.75
#: Postings of a block; terms of a query, and documents for each wanted one, that give its first floor.
BLOCK, SEED_TERMS, SEED_DOCS = 128, 8, 3
#: A query that opens more than 1 in so many of its terms' postings is summed over all of them.
DIRECT = 8
#: So is a query of more terms than this; its floor would be below what they can add.
LONG = 32
#: Postings of queries, queries, and postings of documents in one product; scores held at a time; terms of one product of full matrices.
QUERY_ROWS, QUERIES, DOC_ROWS, SCORES, TERMS = 1 << 20, 4096, 1 << 20, 1 << 22, 512
#: Postings that a task sorts into blocks, and those of one term in a row on the way there.
SORTED, PACKED = 1 << 20, 64
#: Terms that more than 1 in so many pairs of a query and a document share are multiplied as full matrices.
DENSE = 500
#: A score's unit.
UNIT = 1_000_000


@dataclass
class Index:
    """Tables of an index: (doc_id, term, times, weight); (term, number, docs, times, lengths, weights, top); (term, numbers, found, top, idf); the mean length.

    A number stands for a term within one partition of blocks.
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    mean: float


def _weight(times, length, mean: float):
    """A posting's weight, of columns or of arrays."""
    return times * (K1 + 1) / (times + K1 * ((1 - B) + B * length / mean))


def _points(times: Column, idf: Column, weight: Column) -> Column:
    return times * F.floor(idf * weight * UNIT + 0.5)


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.concatenate([np.zeros(min(1, len(codes)), np.int64), np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _edges(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Where pieces of up to ``size`` of runs begin."""
    n = -(-lengths // size)
    return np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size


def _lists(offsets: np.ndarray, *values) -> list[pa.Array]:
    """Lists of the values between offsets."""
    return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in values]


def _counted(rows: DataFrame) -> DataFrame:
    """Postings of (doc_id, ws), packed by term within a batch of texts: (term, docs, times, lengths); a row without term has all texts of a batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ws = batch.column("doc_id").to_numpy(), batch.column("ws")
            lengths, words = ws.value_lengths().to_numpy().astype(np.int32), ws.flatten().dictionary_encode()
            met, times = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
            code, row = met // len(ids), met % len(ids)
            starts = _runs(code)
            edges = _edges(starts, np.diff(starts, append=len(code)), PACKED)
            lists = _lists(np.append(edges, len(code)), ids[row], times.astype(np.int32), lengths[row])
            names = ["term", "docs", "times", "lengths"]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[edges])), *lists], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *_lists(np.array([0, len(ids)]), ids, np.zeros(len(ids), np.int32), lengths)], names=names)

    return rows.mapInArrow(run, "term string, docs array<long>, times array<int>, lengths array<int>")


def _blocks(postings: DataFrame, size: int) -> DataFrame:
    """Runs of up to ``size`` postings of one term, from partitions in order of term and descending weight."""

    def emit(rows, first, last):
        """Blocks of all rows, where they end, and the number of the term there; of the last term only whole ones, unless it is over."""
        code = rows[0].dictionary_encode().indices.to_numpy()
        starts = _runs(code)
        n = np.diff(starts, append=len(code))
        if not last:
            n[-1] -= n[-1] % size
        stop = int(starts[-1] + n[-1])
        edges = _edges(starts, n, size)
        offsets = pa.array(np.append(edges, stop).astype(np.int32))
        numbers = pa.array(first + np.searchsorted(starts, edges, side="right") - 1)
        lists = [pa.ListArray.from_arrays(offsets, c[:stop]) for c in rows[1:4]]
        return pa.RecordBatch.from_arrays([rows[0].take(pa.array(edges)), numbers, *lists, rows[4].take(pa.array(edges))], names=["term", "number", "docs", "times", "lengths", "top"]), stop, first + len(starts) - 1

    def run(batches):
        held, over, number = None, None, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c) for c in ("term", "doc_id", "times", "lengths", "weight")]
            if held is not None:
                rows = [pa.concat_arrays(pair) for pair in zip(held, rows, strict=True)]
            number += over is not None and over != rows[0][0].as_py()
            out, stop, number = emit(rows, number, False)
            over, held = rows[0][-1].as_py(), [c[stop:] for c in rows] if stop < len(rows[0]) else None
            if out.num_rows:
                yield out
        if held is not None:
            yield emit(held, number, True)[0]

    return postings.mapInArrow(run, "term string, number long, docs array<long>, times array<int>, lengths array<int>, top double")


def build(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, block: int = BLOCK) -> Index:
    """The index of all texts, written once.  Rows without id are left out; a null text has no terms but counts in the mean length."""
    scratch = scratch or Scratch(spark, "postings")
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.expr(tokens_spark(f"`{text}`")), F.array().cast("array<string>")).alias("ws"))
    packed = scratch.written(_counted(rows), "counts")
    size, words = F.size("docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    total, length, n = packed.agg(F.sum(F.when(F.col("term").isNull(), size)), F.sum(F.when(F.col("term").isNull(), words)), F.sum(F.when(F.col("term").isNotNull(), size))).first()
    mean = (length or 0) / total if total and length else 1.0

    def each(rows: DataFrame) -> DataFrame:
        rows = rows.select("term", F.explode(F.arrays_zip("docs", "times", "lengths")).alias("p"))
        return rows.select(F.col("p.docs").alias("doc_id"), "term", F.col("p.times").alias("times"), F.col("p.lengths").alias("lengths"), _weight(F.col("p.times").cast("double"), F.col("p.lengths"), float(mean)).alias("weight"))

    packed = packed.filter("term IS NOT NULL")
    # a frequent term goes on over several partitions, in order within each
    dealt = each(packed.repartitionByRange(max(1, -(-(n or 0) // SORTED)), "term", F.get("docs", F.lit(0)))).sortWithinPartitions("term", F.desc("weight"), "doc_id")
    blocks = scratch.written(_blocks(dealt, block), "blocks")
    found = F.sum(F.size("docs"))
    idf = F.log(1 + (F.lit(float(total or 0)) - F.col("found") + 0.5) / (F.col("found") + 0.5))
    terms = blocks.groupBy("term").agg(found.alias("found"), F.max("top").alias("top"), F.collect_set("number").alias("numbers")).withColumn("idf", idf)
    weights = F.zip_with("times", "lengths", lambda t, n: _weight(t.cast("double"), n, float(mean)))
    postings = each(packed).drop("lengths").withColumn("times", F.col("times").cast("long"))
    return Index(postings, blocks.withColumn("weights", weights), scratch.written(terms, "terms"), float(mean))


def _full_scores(pairs: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score) of the pairs, from all terms that both have."""
    each = pairs.join(asked.select("query_id", "term", "times", "idf"), "query_id")
    met = each.join(index.postings.select("doc_id", "term", "weight"), ["doc_id", "term"])
    return met.groupBy("query_id", "doc_id").agg(F.sum(_points(F.col("times"), F.col("idf"), F.col("weight"))).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _floors(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, floor): the k-th best full score among documents in the first blocks of a query's weightiest terms; 0 if there are fewer."""
    strongest = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    seeds = asked.withColumn("n", F.row_number().over(strongest)).filter(F.col("n") <= SEED_TERMS)
    first = index.blocks.join(seeds.select("term").distinct(), "term").groupBy("term").agg(F.max_by(F.struct("docs", "weights"), "top").alias("first"))
    opened = seeds.join(first, "term").select("query_id", "times", "idf", F.explode(F.arrays_zip("first.docs", "first.weights")).alias("p"))
    partial = opened.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(F.sum(_points(F.col("times"), F.col("idf"), F.col("p.weights"))).alias("score"))
    scores = _full_scores(_best(partial, SEED_DOCS * k).select("query_id", "doc_id"), asked, index)
    return _best(scores, k).groupBy("query_id").agg(F.max(F.when(F.col("place") == k, F.col("score"))).alias("floor"))


def asked_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, term, numbers, times, idf, found, most): the queries' terms that the index has, their postings, and the most points each can give."""
    return queries.join(index.terms.select("term", "numbers", "idf", "top", "found"), "term").select("query_id", "term", "numbers", "times", "idf", "found", _points(F.col("times"), F.col("idf"), F.col("top")).alias("most"))


def opened_blocks(asked: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Pairs of a query's term and a block of it: those of terms that can bring in a document, and of these those that are opened.

    ``asked`` has query_id, term, times, idf, most, all (most of all terms) and floor.
    """
    rising = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = asked.withColumn("upto", F.sum("most").over(rising)).filter(F.col("upto") >= F.col("floor"))
    met = needed.join(index.blocks.select("term", "docs", "weights", "top"), "term")
    return met, met.filter(_points(F.col("times"), F.col("idf"), F.col("top")) + F.col("all") - F.col("most") >= F.col("floor"))


def _held(index: Index, n: int) -> DataFrame:
    """Documents in ``n`` blocks, one row each: (d, numbers, ids, lengths, sizes, codes, times); the postings of ids[i], of lengths[i] words, are the next sizes[i] codes (places in numbers) and times."""

    def dealt(batches):
        """Postings of a batch of lists, packed by block of documents."""
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, times, lengths = (batch.column(c).flatten().to_numpy() for c in ("docs", "times", "lengths"))
            numbers = np.repeat(batch.column("number").to_numpy(), batch.column("docs").value_lengths().to_numpy())
            mixed = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            block = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, numbers = block[order], numbers[order]
            starts = _runs(block)
            same = _runs(block.astype(np.int64) + n * np.cumsum(np.append(0, numbers[1:] != numbers[:-1])))  # a number once for all its postings in a block
            lists = _lists(np.append(starts, len(block)), docs[order], times[order], lengths[order])
            numbered = _lists(np.append(np.searchsorted(same, starts), len(same)), numbers[same], np.diff(same, append=len(block)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), *numbered, *lists], names=["d", "numbers", "sizes", "docs", "times", "lengths"])

    def together(rows: pa.Table) -> pa.Table:
        numbers, sizes, docs, times, lengths = (pa.concat_arrays([c.flatten() for c in rows.column(name).chunks]).to_numpy() for name in ("numbers", "sizes", "docs", "times", "lengths"))
        order = np.argsort(docs, kind="stable")
        ids, first, counts = np.unique(docs[order], return_index=True, return_counts=True)
        numbers, codes = np.unique(numbers, return_inverse=True)
        values = numbers, ids, lengths[order][first], counts.astype(np.int32), np.repeat(codes.astype(np.int32), sizes)[order], times[order]
        return pa.table([rows.column("d").slice(0, 1).combine_chunks(), *[_lists(np.array([0, len(v)]), v)[0] for v in values]], names=["d", "numbers", "ids", "lengths", "sizes", "codes", "times"])

    packed = index.blocks.select("number", "docs", "times", "lengths").mapInArrow(dealt, "d int, numbers array<long>, sizes array<int>, docs array<long>, times array<int>, lengths array<int>")
    return packed.groupBy("d").applyInArrow(together, "d int, numbers array<long>, ids array<long>, lengths array<int>, sizes array<int>, codes array<int>, times array<int>")


def _all_postings(asked: DataFrame, index: Index, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best documents of every query, over all postings.

    Blocks of documents are written once.  One block of queries at a time is broadcast
    to them, and a task keeps the best of the blocks of documents that it reads, so
    disk holds the postings once and the best of one block of queries.
    """
    rows, n_queries = asked.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
    if not rows:
        return asked.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    n_postings = index.terms.agg(F.sum("found")).first()[0]
    held = scratch.written(_held(index, -(-n_postings // DOC_ROWS)), "held")
    q_blocks = max(-(-rows // QUERY_ROWS), -(-n_queries // QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q")
    each = asked.select(block, F.explode("numbers").alias("number"), "query_id", F.col("times").cast("long").alias("times"), "idf")
    names = ("number", "query_id", "times", "idf")
    queries = scratch.written(each.groupBy("q").agg(*[F.collect_list(c).alias(f"q_{c}") for c in names]), "queries")
    mean = index.mean

    def run(batches):
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                *wanted, idf = (batch.column(f"q_{c}")[i].values.to_numpy() for c in names)
                numbers, ids, lengths, sizes, codes, times = (batch.column(c)[i].values.to_numpy() for c in ("numbers", "ids", "lengths", "sizes", "codes", "times"))
                terms, first = np.unique(wanted[0], return_index=True)
                at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
                met = np.flatnonzero((terms[at] == numbers)[codes])
                docs, lengths = (np.repeat(v, sizes)[met] for v in (ids, lengths))
                points = np.floor(idf[first[at[codes[met]]]] * _weight(times[met].astype(float), lengths, mean) * UNIT + 0.5).astype(np.int64)
                found = product(*wanted, numbers[codes[met]], docs, points, k)
                best = found if best is None else _greatest(*map(np.concatenate, zip(best, found, strict=True)), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), names=["query_id", "doc_id", "score"])

    found = None
    for q in range(q_blocks):
        met = held.crossJoin(F.broadcast(queries.filter(F.col("q") == q))).drop("d", "q").mapInArrow(run, "query_id long, doc_id long, score long")
        best = scratch.written(_best(met, k).drop("place"), "best")
        found = best if found is None else found.unionByName(best)
    return found


def _greatest(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest scores of each query, ties by document."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], doc[kept], score[kept]


def product(q_terms: np.ndarray, q_ids: np.ndarray, times: np.ndarray, d_terms: np.ndarray, d_ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document and score of the ``k`` best documents of each query, of scores above 0.

    Scores are sums of whole numbers below 2^53, so products of doubles are exact.
    """
    terms = np.intersect1d(q_terms, d_terms)
    held = np.isin(q_terms, terms)
    queries, q = np.unique(q_ids[held], return_inverse=True)
    qt, times = np.searchsorted(terms, q_terms[held]), times[held].astype(float)
    order = np.argsort(qt, kind="stable")
    q, qt, times = q[order], qt[order], times[order]
    held = np.isin(d_terms, terms)
    docs, d = np.unique(d_ids[held], return_inverse=True)
    dt, points = np.searchsorted(terms, d_terms[held]), points[held].astype(float)
    order = np.argsort(d, kind="stable")
    d, dt, points = d[order], dt[order], points[order]
    n_q = np.bincount(qt, minlength=len(terms))
    start = np.cumsum(n_q) - n_q
    full = np.flatnonzero(n_q * np.bincount(dt, minlength=len(terms)) * DENSE > len(queries) * len(docs))
    place = np.full(len(terms), -1)
    place[full] = np.arange(len(full))
    none = np.zeros(0, np.int64)
    best, floor, width = (none, none, np.zeros(0)), np.zeros(len(queries)), max(1, SCORES // max(1, len(queries)))
    for a in range(0, len(docs), width):  # a strip of documents at a time
        n = min(width, len(docs) - a)
        lo, hi = np.searchsorted(d, [a, a + n])
        scores = _strip(q, qt, times, d[lo:hi] - a, dt[lo:hi], points[lo:hi], n_q, start, place, len(full), (len(queries), n))
        least = floor if n < k else np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
        row, at = np.nonzero((scores >= least[:, None]) & (scores > 0))
        row, at, score = (np.concatenate(pair) for pair in zip(best, (row, at + a, scores[row, at]), strict=True))
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        floor[row[rank == k - 1]] = score[rank == k - 1]
        best = row[rank < k], at[rank < k], score[rank < k]
    return queries[best[0]], docs[best[1]], best[2].astype(np.int64)


def _strip(q, qt, times, d, dt, points, n_q, start, place, n_full, shape) -> np.ndarray:
    """Scores of all queries and a strip of documents: full matrices of frequent terms, and the pairs of the others one by one."""
    scores = np.zeros(shape)
    for a in range(0, n_full, TERMS):
        of_q, of_d = ((place[t] >= a) & (place[t] < a + TERMS) for t in (qt, dt))
        left, right = np.zeros((shape[0], min(TERMS, n_full - a))), np.zeros((min(TERMS, n_full - a), shape[1]))
        left[q[of_q], place[qt[of_q]] - a] = times[of_q]
        right[place[dt[of_d]] - a, d[of_d]] = points[of_d]
        scores += left @ right
    rest = place[dt] < 0
    d, dt, points = d[rest], dt[rest], points[rest]
    upto = np.cumsum(n_q[dt])
    a = 0
    while a < len(dt):  # about SCORES pairs at a time
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SCORES)))
        n = n_q[dt[a:b]]
        at = np.repeat(np.arange(a, b), n)
        entry = np.arange(len(at)) + np.repeat(start[dt[a:b]] - (np.cumsum(n) - n), n)
        scores += np.bincount(q[entry] * shape[1] + d[at], times[entry] * points[at], shape[0] * shape[1]).reshape(shape)
        a = b
    return scores


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, doc_id, score, place) of the ``k`` best documents of each query; only scores above 0 count.

    ``queries`` has query_id, term and times (of the term in the query), one row a
    term.  Ties go to the smaller doc_id.
    """
    scratch = scratch or Scratch(spark, "search")
    asked = scratch.written(asked_terms(queries, index).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "asked")
    n_short, n_long = asked.groupBy("query_id").agg((F.max("terms") <= LONG).alias("short")).agg(F.count_if("short"), F.count_if(~F.col("short"))).first()
    if n_short <= n_long:  # all postings are met for the long ones anyway
        return _best(_all_postings(asked, index, k, scratch), k)
    short = asked.filter(F.col("terms") <= LONG)
    floors = _floors(short, index, k)
    whole = Window.partitionBy("query_id")
    bounded = scratch.written(short.join(floors, "query_id", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0)), F.lit(1))).withColumn("all", F.sum("most").over(whole)), "bounded")
    _, opened = opened_blocks(bounded, index)
    # where most blocks would be opened, adding up all of them once costs less than scoring what they bring in
    share = opened.groupBy("query_id").agg(F.sum(F.size("docs")).alias("opened"))
    every = bounded.groupBy("query_id").agg(F.sum("found").alias("all_postings"))
    split = scratch.written(every.join(share, "query_id", "left").select("query_id", (F.coalesce("opened", F.lit(0)) * DIRECT >= F.col("all_postings")).alias("direct")), "split")
    summed = scratch.written(asked.join(split.filter("not direct"), "query_id", "left_anti").select("query_id", "term", "numbers", "times", "idf", "found"), "summed")
    entries = opened.join(split.filter("not direct"), "query_id").select("query_id", "times", "idf", "most", "all", "floor", F.explode(F.arrays_zip("docs", "weights")).alias("p"))
    # what a document may reach: all terms' most, less what the opened blocks show to be missing
    missing = F.sum(_points(F.col("times"), F.col("idf"), F.col("p.weights")) - F.col("most"))
    likely = entries.groupBy("query_id", F.col("p.docs").alias("doc_id"), "all", "floor").agg(missing.alias("short")).filter(F.col("all") + F.col("short") >= F.col("floor"))
    scores = _full_scores(scratch.written(likely.select("query_id", "doc_id"), "likely"), short, index)
    return _best(scores.unionByName(_all_postings(summed, index, k, scratch)).filter("score > 0"), k)
