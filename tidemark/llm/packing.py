"""Packing of token ids into windows whose sources keep target proportions: deficit round-robin over source queues.

Each source is a queue: its documents' ids, one after the other, in order of the
partitions that encoded them.  A queue with weight w serves its k-th id at time
(k + 1/2) / w; in the order of these times the ids of all queues fall into blocks
of BLOCK_WINDOWS windows.  So a document's place in its queue tells its blocks
without a scan of the queues before it, and every block has the same number of
ids, whatever its sources.  Within a block windows are filled by deficit
round-robin.  A queue's deficit is what its target promised and it has not yet
served; the deficits at a block's start follow from the block's number, so they
are carried from block to block and from partition to partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .idfiles import id_encoder
from .words import slices
from .workspace import Workspace

#: Characters of stretches that an encoder remembers.
MEMORY = 10 << 20
#: Windows of a block, the unit that one step packs in memory.
BLOCK_WINDOWS = 256
#: Most queues; smaller sources share the last one.
MOST_QUEUES = 1024
#: Most rows of the table of partial sums that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


class Mixture:
    """The order in which queues with ``totals`` ids and ``weights`` serve them."""

    def __init__(self, totals: list[int], weights: list[float]):
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.float64)
        ends = np.sort(self.totals / self.weights) if totals else np.zeros(0)
        self.times = np.concatenate([[0.0], ends])
        self.served = np.array([np.minimum(self.totals, self.weights * t).sum() for t in self.times])

    def _count(self, queue: int, time: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Ids of a queue served before ``time``, or at it where ``ties``."""
        w, total = self.weights[queue], self.totals[queue]
        n = np.clip(np.floor(time * w + 0.5), 0, total).astype(np.int64)
        for _ in range(2):  # rounding may miss by one
            last = (n - 0.5) / w
            n -= (n > 0) & ((last > time) | ((last == time) & ~ties))
            following = (n + 0.5) / w
            n += (n < total) & ((following < time) | ((following == time) & ties))
        return n

    def rank(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many ids of all queues are served before the k-th of ``queue``."""
        time, out = (k + 0.5) / self.weights[queue], np.zeros(len(k), np.int64)
        for other in range(len(self.totals)):
            out += np.where(queue == other, k, self._count(other, time, queue > other))
        return out

    def cuts(self, queue: np.ndarray, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least k in [first, end] whose rank is at least ``bound`` (``end`` if none is)."""
        low, high = first.copy(), end.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            enough = self.rank(queue[open_], middle) >= bound[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low

    def due(self, x: int, queues: np.ndarray) -> np.ndarray:
        """Ids that the target promised each queue by the time all together have served ``x``."""
        return np.minimum(self.totals[queues], self.weights[queues] * np.interp(x, self.served, self.times))


def capacities(n: int, window: int) -> list[int]:
    """Sizes of the sequences for ``n`` ids: whole windows, and the rest as powers of two, which need no padding."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def deal(sizes: np.ndarray, weights: np.ndarray, deficits: np.ndarray, capacity: list[int], least: int = 1) -> np.ndarray:
    """Ids that each queue gives to each sequence (sequences x queues), by deficit round-robin.

    Each sequence adds to every queue's deficit its share of the room.  Those owed most
    come first, each with what it is owed but ``least`` ids at least, until the room is
    full; the others wait with their deficits.  ``sizes`` sum to the capacities, so
    each sequence is filled and all queues end empty.
    """
    left, out = sizes.tolist(), np.zeros((len(capacity), len(sizes)), np.int64)
    debt, live, total = deficits.astype(np.float64), np.ones(len(sizes), bool), float(weights.sum())
    for i, room in enumerate(capacity):
        debt += weights * (room / total)
        while room:
            for q in np.argsort(-debt, kind="stable").tolist():
                n = min(left[q], room, max(int(debt[q]), least)) if left[q] else 0
                out[i, q] += n
                debt[q] -= n
                left[q] -= n
                room -= n
                if n and not left[q]:  # an empty queue has no share and keeps no claim
                    live[q] = False
                    weights = np.where(live, weights, 0.0)
                    total, debt[q] = float(weights.sum()), -np.inf
                if not room:
                    break
    return out


def encode(docs: DataFrame, vocabulary_path: str, id_column: str, column: str, source: str | None, end_id: int, width: int) -> DataFrame:
    """Ids (``width`` bytes each) of whole texts, each with ``end_id`` after it, and where they stand in their partition and source."""
    key = F.lit("all") if source is None else F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(column).cast("string").alias("text"), key.alias("queue_key"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                flat, counts = id_encoder(vocabulary_path, MEMORY).encode_column(piece.column("text"))
                ids = np.full(len(flat) + len(counts), end_id, f"<u{width}")
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                counts = counts + 1
                at = []
                for name, n in zip(piece.column("queue_key").to_pylist(), counts.tolist(), strict=True):
                    at.append(seen.get(name, 0))
                    seen[name] = at[-1] + n
                ends = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("queue_key"), pa.array([part] * len(counts), pa.int32()), pa.array(at, pa.int64()), pa.array(counts), raw], names=["doc_id", "queue_key", "part", "at", "doc_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, queue_key string, part int, at long, doc_tokens long, ids binary")


def _queues(sums: DataFrame, weights: dict | None) -> tuple[list[str], Mixture]:
    """Keys of the queues (the last one takes all other sources) and how they are mixed; at most MOST_QUEUES rows reach the driver."""
    totals = sums.groupBy("queue_key").agg(F.sum("n").alias("n"))
    if weights is not None:
        if len(weights) >= MOST_QUEUES or any(w <= 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
            raise ValueError(f"weights: under {MOST_QUEUES} positive proportions that sum to 1 at most")
        names = {"null" if k is None else f"={k}": w for k, w in weights.items()}
        totals = totals.filter(F.col("queue_key").isin(list(names)))
    rows = [(r["queue_key"], r["n"]) for r in totals.orderBy(F.desc("n"), "queue_key").limit(MOST_QUEUES - 1).collect()]
    rest = (sums.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in rows)
    keys, sizes = [k for k, _ in rows], [n for _, n in rows]
    shares = [float(n) for n in sizes] if weights is None else [names[k] for k in keys]
    if rest:
        sizes.append(rest)
        # sources without a proportion get what the others leave, or come last
        shares.append(float(rest) if weights is None else max(1 - sum(names.values()), 1e-9))
    return keys, Mixture(sizes, shares)


def _bases(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(part, queue_key, queue, base): ids of the queue in partitions before, and in the same partition in sources before."""
    spark, last = sums.sparkSession, len(keys)
    names = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "queue_key string, queue int")  # under MOST_QUEUES rows
    sums = sums.join(F.broadcast(names), "queue_key", "left").withColumn("queue", F.coalesce("queue", F.lit(last)))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the input
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("n")).select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("queue", "part").orderBy("queue_key").rowsBetween(Window.unboundedPreceding, -1)
    own = sums.select("queue", "part", "queue_key", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inner"))
    return own.join(parts, ["queue", "part"]).select("part", "queue_key", "queue", (F.col("earlier") + F.col("inner")).alias("base"))


def _fragments(ids: DataFrame, mixture: Mixture, block: int, width: int) -> DataFrame:
    """Rows cut where their queue goes over to the next block: block, queue, place in the queue, start in the document, ids."""
    kind = dict(ids.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, queue = batch.column("doc_tokens").to_numpy(), batch.column("queue").to_numpy().astype(np.int64)
            first = batch.column("base").to_numpy() + batch.column("at").to_numpy()
            blocks = [mixture.rank(queue, x) // block for x in (first, first + n - 1)]
            count = blocks[1] - blocks[0] + 1
            row = np.repeat(np.arange(len(n)), count)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            number = blocks[0][row] + turn
            start, inner = np.zeros(len(row), np.int64), turn > 0
            start[inner] = mixture.cuts(queue[row[inner]], first[row[inner]], (first + n)[row[inner]], number[inner] * block) - first[row[inner]]
            end = n[row]
            same = np.flatnonzero(row[1:] == row[:-1])
            end[same] = start[same + 1]
            some = end > start
            row, start, end, number = row[some], start[some], end[some], number[some]
            texts = batch.column("ids").to_pylist()
            cut = [texts[r][a * width : b * width] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
            doc = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(queue[row].astype(np.int32)), pa.array(first[row] + start), doc, pa.array(start), pa.array(n[row]), pa.array(cut, pa.binary())], names=["block", "queue", "place", "doc_id", "start", "doc_tokens", "ids"])

    return ids.mapInArrow(run, f"block long, queue int, place long, doc_id {kind}, start long, doc_tokens long, ids binary")


def _whole_blocks(batches):
    """Tables of one block each, from batches in order of ``block``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() + [len(blocks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column("block")[0].as_py() != int(blocks[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pack_block(table: pa.Table, mixture: Mixture, window: int, block: int, width: int, least: int) -> pa.RecordBatch:
    number = table.column("block")[0].as_py()
    queue, place = table.column("queue").to_numpy(), table.column("place").to_numpy()
    texts = table.column("ids").to_pylist()
    size = np.array([len(t) for t in texts], np.int64) // width
    queues, head = np.unique(queue, return_index=True)  # rows are in order of queue and place
    sizes = np.add.reduceat(size, head)
    capacity = capacities(int(sizes.sum()), window)
    taken = deal(sizes, mixture.weights[queues], mixture.due(number * block, queues) - place[head], capacity, least)
    upto = np.concatenate([np.zeros((1, len(queues)), np.int64), np.cumsum(taken, axis=0)])
    seat = np.cumsum(taken, axis=1) - taken  # where a queue's ids begin in a sequence
    rows, starts, ends, sequence, offset = [], [], [], [], []
    for j, a in enumerate(head.tolist()):
        b = head[j + 1] if j + 1 < len(head) else len(queue)
        begin = np.cumsum(size[a:b]) - size[a:b]
        cut = np.unique(np.concatenate([begin, upto[:, j]]))
        cut, stop = cut[:-1], cut[1:]
        row = np.searchsorted(begin, cut, side="right") - 1
        where = np.searchsorted(upto[:, j], cut, side="right") - 1
        rows.append(row + a)
        starts.append(cut - begin[row])
        ends.append(stop - begin[row])
        sequence.append(where)
        offset.append(seat[where, j] + cut - upto[where, j])
    row, start, end, where, offset = (np.concatenate(x) for x in (rows, starts, ends, sequence, offset))
    kind = f"<u{width}"
    pieces = [np.frombuffer(texts[r], kind, e - s, s * width).astype("<u4").tobytes() for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
    picked = table.take(pa.array(row))
    first = picked.column("start").to_numpy() + start
    columns = [picked.column("doc_id").combine_chunks(), pa.array(first), pa.array(end - start), picked.column("doc_tokens").combine_chunks(), pa.array(queue[row].astype(np.int32)), pa.array(number * (block // window) + where), pa.array(offset), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "queue", "sequence_id", "offset", "ids"])


def pack(spark: SparkSession, docs: DataFrame, vocabulary_path: str, window: int = 1024, weights: dict | None = None, least: int = 128, end_id: int = 0, id_column: str = "doc_id", column: str = "text", source: str | None = "source", space: Workspace | None = None) -> DataFrame:
    """Pieces of all documents, packed into sequences of ``window`` ids.

    Columns: doc_id, start (ids of its document before the piece), length,
    doc_tokens (all ids of the document, the end id included), queue (source),
    sequence_id (from 0, without gaps), offset (in the sequence) and ids
    (little-endian unsigned 32-bit integers).  Each id of each document lies in one
    piece.  All sequences are full but for those of the last rest, whose sizes are
    powers of two.

    A source that is owed less than ``least`` ids waits for a later window while others
    are owed more, so that documents are not cut smaller without need; with 1 every
    window has the target proportions to within one id for each source.

    ``weights`` are the target proportions of sources (one of None for rows
    without a source); by default each gets its share of all ids, so that all end
    together.  Where a source has run out the others share its part, in proportion.
    A null text is empty and has the end id only; rows without id or with an id
    given twice are documents like others; ties are dealt in order of the source's
    size and key.  An empty table gives no rows.  Other columns of ``docs`` are not
    read.  The MOST_QUEUES - 1 largest sources have queues of their own, all others
    share one.
    """
    space = space or Workspace(spark, "packing")
    block = window * BLOCK_WINDOWS
    width = 2 if max(end_id, id_encoder(vocabulary_path).library.get_vocab_size() - 1) < 1 << 16 else 4
    ids = space.table(encode(docs, vocabulary_path, id_column, column, source, end_id, width), "ids")
    sums = space.table(ids.groupBy("part", "queue_key").agg(F.sum("doc_tokens").alias("n")), "sums")
    keys, mixture = _queues(sums, weights)
    bases = space.table(_bases(sums, keys), "bases")
    small = bases.count() <= BROADCAST_ROWS
    placed = ids.join(F.broadcast(bases) if small else bases, ["part", "queue_key"])
    cut = _fragments(placed, mixture, block, width).repartition("block").sortWithinPartitions("block", "queue", "place")
    kind = dict(ids.dtypes)["doc_id"]

    def run(batches):
        for table in _whole_blocks(batches):
            yield _pack_block(table, mixture, window, block, width, least)

    packed = cut.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, queue int, sequence_id long, offset long, ids binary")
    names = spark.createDataFrame([(i, k[1:] if k[0] == "=" else None) for i, k in enumerate(keys)], "queue int, source string")  # under MOST_QUEUES rows
    return packed.join(F.broadcast(names), "queue", "left").select("doc_id", "start", "length", "doc_tokens", "source", "sequence_id", "offset", "ids")
