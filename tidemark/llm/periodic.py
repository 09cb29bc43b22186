"""Runs (maximal periodic stretches) of words, by the linear method of Gusfield and Stoye for tandem repeats.

A square is a stretch that is some stretch twice in a row; a run holds squares of
its period at each of its places.  Over the words of many texts at once, parted by
symbols that occur once:

1. a suffix tree, with names of all stretches of 2**l words for common extensions;
2. a Lempel-Ziv parse: the first occurrence of any square has its centre in some
   block and reaches at most the next, so extensions at the blocks' borders give
   squares that cover all first occurrences;
3. from the place of each such square in the tree a walk along suffix links, as
   long as the square can be shifted by a word: the vocabulary of all squares;
4. the leaves below each place of the vocabulary are all occurrences; occurrences
   of one period at places that follow each other are one run.

Steps 3 and 4 take squares of primitive roots only, so a run has its smallest
period, and there are at most n log n occurrences.  Words that can lie in no run
that is asked for are left out first (``_stretches``), which loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, Words, mix, slices

#: Bytes of text whose words are in one tree; a longer text has one alone.
TREE_BYTES = 4 << 20
#: Words of a gram that must recur for its words to lie in a run.
GRAM = 3


class SuffixTree:
    """Suffix array, common extensions and internal nodes of a sequence whose last symbol occurs once."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable").astype(np.int64)
        self.names = [self._name(order, symbols[order])]
        self.sa = order
        slots = self._open(order, symbols[order])
        while len(slots):
            held, step = self.sa[slots], 1 << len(self.names) - 1
            names = self.names[-1]
            # a stretch that recurs never holds the last symbol, so another follows it
            key = names[held].astype(np.int64) * n + names[held + step]
            inner = np.argsort(key, kind="stable")
            self.sa[slots], key = held[inner], key[inner]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            names = names.copy()
            names[self.sa[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            self.names.append(names)
            single = first & np.concatenate([first[1:], [True]])
            slots = slots[~single]
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.arange(n)
        #: Common beginning of each suffix and the one before it in order; none of the first, and one more 0 at the end.
        self.lcp = np.zeros(n + 1, np.int64)
        self.lcp[1:n] = self.ahead(self.sa[:-1], self.sa[1:])

    @staticmethod
    def _name(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        names = np.empty(len(order), np.int32)
        names[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return names

    @staticmethod
    def _open(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        return np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (i is not j)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            a, b = np.minimum(i + out, self.n - 1), np.minimum(j + out, self.n - 1)
            out += (names[a] == names[b]).astype(np.int64) << level
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree up to i and up to j, both included; -1 is before the first."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            a, b = i - out - (1 << level) + 1, j - out - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            out += (inside & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << level
        return out

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each the longest stretch that starts earlier too, or one new word."""
        sa = self.sa.tolist()
        above, below = [-1] * self.n, [-1] * self.n
        stack: list[int] = []
        for at in sa:  # the next suffix in order, to both sides, that starts earlier
            while stack and stack[-1] > at:
                below[stack.pop()] = at
            above[at] = stack[-1] if stack else -1
            stack.append(at)
        longest = np.zeros(self.n, np.int64)
        for side in (above, below):
            other = np.array(side, np.int64)
            some = np.flatnonzero(other >= 0)
            longest[some] = np.maximum(longest[some], self.ahead(some, other[some]))
        step, starts, at = np.maximum(longest, 1).tolist(), [], 0
        while at < self.n:
            starts.append(at)
            at += step[at]
        return np.array(starts, np.int64)

    def nodes(self) -> None:
        """Internal nodes as intervals of equal beginnings: ``depth``, ``low``, ``high``, and ancestors by powers of two."""
        lcp = self.lcp.tolist()
        depth, low, high, parent = [0], [0], [self.n - 1], [0]
        stack = [0]
        leaf = [0] * self.n
        for at in range(1, self.n + 1):
            common, start, child = lcp[at] if at < self.n else 0, at - 1, -1
            home = stack[-1] if depth[stack[-1]] > common else -1
            while depth[stack[-1]] > common:
                node = stack.pop()
                high[node], start = at - 1, low[node]
                if child >= 0:
                    parent[child] = node
                child = node
            if depth[stack[-1]] < common:
                depth.append(common)
                low.append(start)
                high.append(-1)
                parent.append(stack[-1])
                stack.append(len(depth) - 1)
            if child >= 0:
                parent[child] = stack[-1]
            leaf[at - 1] = home if home >= 0 else stack[-1]
        for node in stack:
            high[node] = self.n - 1
        self.depth, self.low, self.high = (np.array(x, np.int64) for x in (depth, low, high))
        #: The lowest internal node above each leaf, in suffix order.
        self.leaf = np.array(leaf, np.int32)
        self.up = [np.array(parent, np.int32)]
        while self.up[-1].any():
            self.up.append(self.up[-1][self.up[-1]])

    def places(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node at or next below the end of the ``depth`` words from i on; the leaf's rank, as -1 - rank, where they occur once."""
        rank = self.rank[i]
        node = self.leaf[rank].astype(np.int64)
        alone = self.depth[node] < depth
        for up in reversed(self.up):
            higher = up[node].astype(np.int64)
            node = np.where(self.depth[higher] >= depth, higher, node)
        return np.where(alone, -1 - rank, node)


def _covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares that cover the first occurrence of every square."""
    starts = tree.blocks()
    edge = np.concatenate([starts, [tree.n, tree.n]])
    size = np.diff(edge)
    found = []
    # the square reaches into the next block: its root length is at most this block's
    block = np.repeat(np.arange(len(starts) - 1), size[: len(starts) - 1])
    k = np.arange(len(block)) - np.repeat(np.cumsum(size[: len(starts) - 1]) - size[: len(starts) - 1], size[: len(starts) - 1]) + 1
    right = edge[block + 1]
    left = right - k
    ahead, behind = tree.ahead(right, left), tree.behind(right - 1, left - 1)
    some = (ahead + behind >= k) & (ahead > 0)
    found.append((np.maximum(left - behind, left - k + 1)[some], k[some]))
    # the square starts before the block and has its centre in it
    reach = size[: len(starts)] + size[1 : len(starts) + 1]
    block = np.repeat(np.arange(len(starts)), reach)
    k = np.arange(len(block)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    left = edge[block]
    inside = (left + k < tree.n) & (left > 0)
    block, k, left = block[inside], k[inside], left[inside]
    ahead, behind = tree.ahead(left, left + k), tree.behind(left - 1, left + k - 1)
    at = np.maximum(left - behind, left - k + 1)
    some = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (at + k <= edge[block + 1])
    found.append((at[some], k[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _prime_divisors(values: np.ndarray) -> list[np.ndarray]:
    """Columns of prime divisors of each value, 0 where it has no more."""
    left, columns, p = values.copy(), [], 2
    factors = [[] for _ in range(len(values))]
    while len(left) and p * p <= left.max():
        hit = left % p == 0
        for i in np.flatnonzero(hit).tolist():
            factors[i].append(p)
        while hit.any():
            left[hit] //= p
            hit = left % p == 0
        p += 1 if p == 2 else 2
    for i in np.flatnonzero(left > 1).tolist():
        factors[i].append(int(left[i]))
    for j in range(max(map(len, factors), default=0)):
        columns.append(np.array([f[j] if j < len(f) else 0 for f in factors], np.int64))
    return columns


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the square's root is no repetition of a shorter one."""
    sizes, which = np.unique(k, return_inverse=True)
    out = np.ones(len(k), bool)
    for primes in _prime_divisors(sizes):
        p = primes[which]
        some = np.flatnonzero(p)
        shift = k[some] // p[some]
        out[some[tree.ahead(start[some], start[some] + shift) >= 2 * k[some] - shift]] = False
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... ``count`` of each, and whose they are."""
    own = np.repeat(np.arange(len(first)), count)
    return first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count), own


def _joined(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of equal keys that touch or overlap, as one each."""
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    if not len(key):
        return key, first, last
    width = int(last.max()) + 2
    reach = np.maximum.accumulate(key * width + last) - key * width  # the farthest end so far of this key, where it is one of this key
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] > reach[:-1] + 1)])
    heads = np.flatnonzero(fresh)
    return key[heads], first[heads], np.maximum.reduceat(last, heads)


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run with at least two periods; the last symbol occurs once."""
    tree = SuffixTree(symbols)
    start, k = _covering(tree)
    whole = _primitive(tree, start, k)
    start, k = start[whole], k[whole]
    # walks along suffix links: the square shifted by a word, as long as the next word agrees
    k, start, last = _joined(k, start, start + tree.ahead(start, start + k) - k)
    at, own = _spread(start, last - start + 1)
    if not len(at):
        return at, at, at
    tree.nodes()
    place, k = tree.places(at, 2 * k[own]), k[own]
    _, first = np.unique(place * (tree.n + 1) + k, return_index=True)
    place, k = place[first], k[first]
    alone = place < 0
    low, high = np.where(alone, -1 - place, tree.low[np.maximum(place, 0)]), np.where(alone, -1 - place, tree.high[np.maximum(place, 0)])
    leaf, own = _spread(low, high - low + 1)
    at = tree.sa[leaf]
    k, first, last = _joined(k[own], at, at)
    order = np.lexsort((k, first))
    return first[order], (last - first + 2 * k)[order], k[order]


def gram_floor(gram: int, min_length: int, min_exponent: int) -> int:
    """Times that each gram of ``gram`` words occurs, at least, in a run as long as asked for."""
    # for periods from 2 * gram on, a residue has at least min_exponent - 1 places
    return min(min_exponent, *((max(min_length, min_exponent * q) - gram + 1) // q for q in range(1, 2 * gram + 1)), max(min_exponent - 1, 1))


def _stretches(row: np.ndarray, hashes: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, count) of the stretches of words, within a row, that any run asked for lies in.

    All grams of a run recur in it, so runs lie where grams are frequent in a row,
    and then frequent within the stretch, until nothing more can be cut.
    """
    shortest = max(min_length, min_exponent)
    gram = min(GRAM, shortest)
    times = gram_floor(gram, min_length, min_exponent)
    at = np.flatnonzero(row[gram - 1 :] == row[: len(row) - gram + 1]) if len(row) >= gram else np.zeros(0, np.int64)
    part = row[at] if len(at) else at
    with np.errstate(over="ignore"):
        grams = hashes[at] * U(3)
        for j in range(1, gram):
            grams = mix(grams) ^ hashes[at + j]
        while len(at):
            _, which, counts = np.unique(mix(grams + part.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            stay = np.ones(len(at), bool) if times < 2 else counts[which] >= times
            kept = at[stay]
            fresh = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(part[stay]) != 0)]) if len(kept) else np.zeros(0, bool)
            piece = np.cumsum(fresh) - 1
            size = np.bincount(piece, minlength=1)
            long = size[piece] >= shortest - gram + 1 if len(kept) else np.zeros(0, bool)
            fewer = len(at) > int(long.sum())
            grams, at, part = grams[stay][long], kept[long], piece[long]
            if not fewer or times < 2:
                break
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else at
    return at[heads], np.diff(np.append(heads, len(at))) + gram - 1


@dataclass
class RowRuns:
    """Runs of many rows: the row, and start (word number in the row), length and period, by row, start and period."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def runs_of(words: Words, min_length: int, min_exponent: int) -> RowRuns:
    """All runs of at least ``min_length`` words and ``min_exponent`` periods, within each row."""
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    hashes = words.hashes()
    first, count = _stretches(row, hashes, min_length, min_exponent)
    at, own = _spread(first, count)
    if not len(at):
        return RowRuns(at, at, at, at)
    ids = words.exact_ids(at, hashes[at])
    # each stretch is followed by a symbol that occurs once
    symbols = np.empty(len(at) + len(first), np.int64)
    seat = np.arange(len(at)) + own
    symbols[seat] = ids
    ends = np.cumsum(count) + np.arange(len(count))
    symbols[ends] = int(ids.max()) + 1 + np.arange(len(count))
    back = np.zeros(len(symbols), np.int64)
    back[seat] = at
    start, length, period = runs(symbols)
    asked = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = back[start[asked]], length[asked], period[asked]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return RowRuns(row[start], start - words.first[row[start]], length, period)


def kept_words(words: Words, found: RowRuns) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    cover = np.zeros(len(words) + 1, np.int64)
    at = words.first[found.row] + found.start
    np.add.at(cover, at + found.period, 1)
    np.add.at(cover, at + found.length, -1)
    return np.cumsum(cover[:-1]) == 0


def find_runs(docs: DataFrame, column: str = "text", min_length: int = 6, min_exponent: int = 4, out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of words of each whole text, and the text with each run cut to its first period.

    ``runs`` lists (start, length, period) by start and then period, word numbers
    from 0; ``collapsed`` has the kept words joined by one space.  A run is a stretch
    of words with smallest period p, of at least ``min_length`` words and
    ``min_exponent`` (a whole number, 2 at least) periods, that neither neighbouring word extends.  Words are
    ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.  A null or wordless text has no
    runs and collapses to an empty one.  Rows stand for themselves: repeated ids and
    rows keep theirs.  Columns named as the two results are replaced.  Memory is
    bounded by TREE_BYTES or the longest text.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have two periods and two words at least")
    keep = [c for c in docs.columns if c not in (out, collapsed)]
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, kind, False), T.StructField(collapsed, T.StringType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, TREE_BYTES):
                words = Words(part.column(column))
                found = runs_of(words, min_length, min_exponent)
                items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (found.start, found.length, found.period)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found.row, np.arange(len(part) + 1)).astype(np.int32)), items)
                text = words.joined(kept_words(words, found)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, text], names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def repeat_from(words, start, period, count):
    """Column expression: the array ``words`` with all from ``start`` on replaced by its next ``period`` words over and over, up to ``count``."""
    times = F.ceil((count - start) / period).cast("int")
    body = F.flatten(F.array_repeat(F.slice(words, start + 1, period), times))
    return F.slice(F.concat(F.slice(words, F.lit(1), start), body), F.lit(1), count)
