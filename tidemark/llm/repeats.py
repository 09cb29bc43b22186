"""Removal of word runs that occur earlier in the corpus, by prefix-partitioned suffix trees.

Each run of ``length`` words has an anchor: the first of its prefixes of half that
many words whose fingerprint is least.  Equal runs have their anchors at equal
places, so runs meet in the group of their anchor's prefix, and prefixes that
occur once are left out before anything is dealt.  A group has two trees, over
the words after the prefix and over those before it (backwards): sorted
sequences with the lengths of their common beginnings, whose intervals are the
internal nodes.  Suffixes that share the nodes at a run's depth on both sides
repeat each other.  Groups beyond memory get longer prefixes, up to all words of an
anchor's runs: suffixes with equal ones are one class, only whose first is compared
run by run, by aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, mix, slices
from .workspace import Workspace, lookup

#: Largest group, in suffixes, of which trees are built in memory.
GROUP_ROWS = 4096
#: About so many suffixes of large groups, of whole documents, have one salt.
LIST_ROWS = 4096
#: Suffixes of whole groups that one tree holds at a time (several groups share it).
TREE_ROWS = 1 << 15


def _anchors(words: Words, length: int, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, its prefix's fingerprint, and the least and most words between a run's start and it."""
    half = length // 2
    starts = words.window_starts(length)
    if not len(starts):
        return (starts, np.zeros(0, np.int64), starts, starts)
    prefix = words.sequence_hashes(half, hashes)
    order = mix(prefix)
    best, at = order[starts].copy(), starts.copy()
    for o in range(1, length - half + 1):
        less = order[starts + o] < best
        best[less], at[less] = order[starts + o][less], starts[less] + o
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    anchor = at[first]
    return anchor, prefix[anchor].view(np.int64), anchor - starts[last], anchor - starts[first]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(prefix, doc_id, pos, lo, hi) of every anchor; its runs start lo to hi words before pos."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column("text"))
                anchor, prefix, lo, hi = _anchors(words, length, words.hashes())
                row = np.searchsorted(words.first, anchor, side="right") - 1
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(ids[row]), pa.array((anchor - words.first[row]).astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["prefix", "doc_id", "pos", "lo", "hi"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "prefix long, doc_id long, pos int, lo int, hi int")


def _gathered(prefix, whole, lo, hi, salt, ids, pos, runs: pa.ListArray) -> pa.RecordBatch:
    """One row for each class and salt of these suffixes, with its members: copies in one batch leave it as one row."""
    order = np.lexsort((pos, ids, salt, hi, lo, whole, prefix))
    columns = [c[order] for c in (prefix, whole, lo, hi, salt)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(order) else False
    heads = np.flatnonzero(fresh)
    members = pa.StructArray.from_arrays([pa.array(ids[order]), pa.array(pos[order])], names=["doc_id", "pos"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), members)
    return pa.RecordBatch.from_arrays([*(pa.array(c[heads]) for c in columns), lists, runs.take(pa.array(order[heads]))], names=["prefix", "whole", "lo", "hi", "salt", "at", "runs"])


def _suffixes(marked: DataFrame, length: int, whole: bool) -> DataFrame:
    """Suffixes at the anchors ``at`` of the texts: with the words around the prefix, or with the prints of whole runs."""
    half = length // 2
    reach = length - half

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column("text"))
                hashes = words.hashes()
                spots = part.column("at")
                row = np.repeat(np.arange(len(part)), np.diff(spots.offsets.to_numpy()))
                pos, lo, hi = (spots.flatten().field(i).to_numpy() for i in range(3))
                at = words.first[row] + pos
                prefix = words.sequence_hashes(half, hashes)[at].view(np.int64)
                ids = part.column("doc_id").to_numpy()[row]
                if whole:
                    n = hi - lo + 1
                    own = np.repeat(np.arange(len(at)), n)
                    back = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                    prints = words.sequence_hashes(length, hashes)[at[own] - back]
                    edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    # runs that overlap fix all words from the first run's start to the last one's end
                    whole_print = np.add.reduceat(mix(prints + back.astype(np.uint64)), edges[:-1]) if len(at) else prints
                    yield _gathered(prefix, whole_print.view(np.int64), lo, hi, part.column("salt").to_numpy()[row], ids, pos, pa.ListArray.from_arrays(pa.array(edges), pa.array(prints.view(np.int64))))
                    continue
                step, last = np.arange(reach), len(hashes) - 1
                before = hashes[np.maximum(at[:, None] - 1 - step, 0)] * (step < hi[:, None])
                after = hashes[np.minimum(at[:, None] + half + step, last)] * (step < (reach - lo)[:, None])
                cols = [pa.array(prefix), pa.array(ids), pa.array(pos), pa.array(lo), pa.array(hi)]
                for side in (before, after):
                    raw = np.ascontiguousarray(side)
                    offsets = np.arange(len(at) + 1, dtype=np.int32) * (8 * reach)
                    cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(cols, names=["prefix", "doc_id", "pos", "lo", "hi", "before", "after"])

    return marked.mapInArrow(run, "prefix long, whole long, lo int, hi int, salt long, at array<struct<doc_id: long, pos: int>>, runs array<long>" if whole else "prefix long, doc_id long, pos int, lo int, hi int, before binary, after binary")


def _nodes(prefix: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Of each sequence its node at each depth, 0 to all words: the interval of equal beginnings in sorted order."""
    order = np.lexsort([*side.T[::-1], prefix])
    p, s = prefix[order], side[order]
    differs = np.zeros((len(p), side.shape[1] + 1), bool)
    differs[0] = True
    differs[1:, 0] = p[1:] != p[:-1]
    differs[1:, 1:] = s[1:] != s[:-1]
    nodes = np.empty(differs.shape, np.int64)
    nodes[order] = np.cumsum(np.logical_or.accumulate(differs, axis=1), axis=0)
    return nodes


def _tree_repeats(prefix, doc, pos, lo, hi, before, after) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the runs that repeat an earlier one of the same groups."""
    reach = before.shape[1]
    left, right = _nodes(prefix, before), _nodes(prefix, after)
    docs, starts = [], []
    for back in range(reach + 1):
        rows = np.flatnonzero((lo <= back) & (back <= hi))
        if len(rows) < 2:
            continue
        a, b, d, p = left[rows, back], right[rows, reach - back], doc[rows], pos[rows] - back
        order = np.lexsort((p, d, b, a))
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        # one document and start given twice is no earlier copy of itself: the first of a run is carried on
        fresh = np.concatenate([[True], ~same])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        first = order[head]
        later = order[(d[order] != d[first]) | (p[order] != p[first])]
        docs.append(d[later])
        starts.append(p[later])
    return np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int32), *starts])


def _whole_groups(batches, key: str, rows: int):
    """Tables of ``rows`` rows or a little more that hold whole groups, from batches in order of ``key``."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_document(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """One row a document with all its starts."""
    order = np.argsort(doc, kind="stable")
    ids, first = np.unique(doc[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(start[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["doc_id", "starts"])


def _grown(suffixes: DataFrame, length: int) -> DataFrame:
    """(doc_id, starts) of repeats, from partitions that hold whole groups in order of prefix."""
    reach = length - length // 2

    def run(batches):
        for table in _whole_groups(batches, "prefix", TREE_ROWS):
            plain = [table.column(c).to_numpy() for c in ("prefix", "doc_id", "pos", "lo", "hi")]
            sides = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64).reshape(-1, reach) for c in ("before", "after")]
            yield _by_document(*_tree_repeats(*plain, *sides))

    return suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "doc_id long, starts array<int>")


def _large(space: Workspace, suffixes: DataFrame) -> DataFrame:
    """(doc_id, starts) of repeats in groups beyond memory; ``suffixes`` is a table.

    Members of a class are gathered in lists by a salt of their document before
    anything is joined, so joins see lists and classes, not members.  All lists of a
    salt, about LIST_ROWS members, then meet, and give one row a document.
    """
    total = suffixes.agg(F.sum(F.size("at"))).first()[0] or 0
    key = F.concat_ws(":", "prefix", "whole", "lo", "hi").alias("class")
    lists = suffixes.groupBy(key, "salt").agg(F.flatten(F.collect_list("at")).alias("at"), F.min(F.array_min("at")).alias("first"), F.min(F.struct("prefix", "lo", "hi", "runs")).alias("k"), F.sum(F.size("at")).alias("n"))
    lists = space.table(lists, "lists")
    classes = whole = space.table(lists.groupBy("class").agg(F.min("first").alias("first"), F.min("k").alias("k"), F.sum("n").alias("n")), "classes")
    firsts = classes.select("class", "first", F.col("k.prefix").alias("prefix"), F.col("k.lo").alias("lo"), F.posexplode("k.runs").alias("i", "run"))
    firsts = firsts.select("class", F.concat_ws(":", "prefix", "run").alias("run"), "first.doc_id", (F.col("first.pos") - F.col("lo") - F.col("i")).alias("start"), (F.col("lo") + F.col("i")).alias("back"))
    firsts = space.table(firsts, "first-runs")
    least = firsts.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = lookup(firsts, least, "run", "n", firsts.count(), "class").filter("least is not null and (doc_id <> least.doc_id or start <> least.start)")
    late = late.groupBy("class").agg(F.collect_set("back").alias("late"))
    classes = space.table(classes.select("class", "first", "n", "k.lo", "k.hi").join(late, "class", "left").filter("n > 1 or late is not null"), "late")
    space.drop(whole, firsts)
    dealt = lists.select("class", "salt", "at", F.xxhash64("class", "salt").alias("deal"))  # by list, not by salt alone: one salt stands in every class
    found = lookup(dealt, classes, "class", "n", total, "deal").filter("first is not null")

    def starts(m):
        is_first = (m["doc_id"] == F.col("first.doc_id")) & (m["pos"] == F.col("first.pos"))
        backs = F.when(is_first, F.coalesce("late", F.expr("cast(array() as array<int>)"))).otherwise(F.sequence("lo", "hi"))
        return F.struct(m["doc_id"].alias("doc_id"), F.transform(backs, lambda b: m["pos"] - b).alias("starts"))

    def run(batches):
        for table in _whole_groups(batches, "salt", 1):
            members = table.column("members").combine_chunks().flatten()
            runs = members.field("starts")
            yield _by_document(np.repeat(members.field("doc_id").to_numpy(), runs.value_lengths().to_numpy()), runs.flatten().to_numpy())

    met = found.repartition("salt").sortWithinPartitions("salt").select("salt", F.transform("at", starts).alias("members"))
    return met.mapInArrow(run, "doc_id long, starts array<int>")


def repeated_runs(space: Workspace, docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, starts), several rows a document: runs of ``length`` words that start earlier too, in a smaller doc_id or the same."""
    found = space.table(anchors(docs, length), "anchors")
    total = found.count()
    counts = space.table(found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("large", F.col("n") > GROUP_ROWS), "prefixes")
    in_large = counts.filter("large").agg(F.sum("n")).first()[0] or 0
    kept = lookup(found, counts, "prefix", "n", total, "pos").filter("large is not null")
    marks = kept.groupBy("doc_id", "large").agg(F.collect_set(F.struct("pos", "lo", "hi")).alias("at")).withColumnRenamed("doc_id", "__id")
    marks = space.table(marks, "marks")
    space.drop(found, counts)
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def at(large: bool) -> DataFrame:
        return texts.join(marks.filter(F.col("large") == large), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "at")

    out = space.table(_grown(_suffixes(at(False), length, False), length), "starts")
    if not marks.filter("large").isEmpty():
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 + in_large // LIST_ROWS))
        suffixes = space.table(_suffixes(at(True).withColumn("salt", salt), length, True), "large")
        out = out.unionByName(space.table(_large(space, suffixes), "large-starts"))
        space.drop(suffixes)
    space.drop(marks)
    return out


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = 20, join_with: str = " ") -> DataFrame:
    """``docs`` with ``text`` cut to its kept words, and n_words and n_removed added.

    A word goes if a run that covers it starts earlier too: in a smaller doc_id, or
    earlier in the same document.  Runs are judged on the input.  Kept words are
    joined by one space; a text that loses nothing stays as it is if ``join_with``
    is None.  Null texts have no words and stay null; rows without doc_id lose
    nothing.  Columns named n_words or n_removed are replaced.
    """
    space = Workspace(spark, "repeats")
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    gone = repeated_runs(space, docs, length).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("__gone"))
    gone = space.table(gone, "gone")  # the only table that the result reads
    space.drop_all_but(gone)
    rows = docs.select(*keep).join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    schema = docs.select(*keep).withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column("text"))
                raw, texts, removed = words.data.tobytes(), [], []
                olds = part.column("text")
                for i, marks in enumerate(part.column("__gone").to_pylist()):
                    a, b = words.first[i], words.first[i + 1]
                    cover = np.zeros(b - a + 1, np.int32)
                    if marks:
                        at = np.array(marks)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + length, -1)
                    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                    removed.append(int(b - a - len(stay)))
                    if not olds[i].is_valid or (join_with is None and not marks):
                        texts.append(olds[i].as_py())
                    else:
                        texts.append((join_with or " ").encode().join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]).decode())
                cols = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64())], names=[*keep, "n_words", "n_removed"])

    return rows.mapInArrow(run, schema)
