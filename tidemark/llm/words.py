"""Words and word-sequence fingerprints of whole Arrow text columns, without a loop over words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return: ``[^\\x20\\x09-\\x0D]+``.  None of those bytes occurs
inside a UTF-8 sequence, so words can be found on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Words of more bytes than this are hashed one by one by blake2b.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Places:
    """Where numbers, all distinct, stand among those held: open addressing, all of them probed side by side."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.n, self.table = keys, len(keys), np.zeros(0, np.int32)
        self._put(0)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> U(self.shift)).view(np.int64)

    def _put(self, begin: int) -> None:
        """The keys from ``begin`` on into the table; into a larger one, with those before, where it gets full."""
        if not len(self.table) or 2 * self.n > len(self.table):
            self.shift, begin = 64 - max(10, 2 + self.n.bit_length()), 0
            self.table = np.full(1 << 64 - self.shift, -1, np.int32)
        left = np.arange(begin, self.n, dtype=np.int32)
        at = self._first(self.keys[begin : self.n])
        while len(left):
            free = self.table.take(at) < 0
            self.table[at[free]] = left[free]
            lost = self.table.take(at) != left
            left, at = left[lost], at[lost] + 1 & len(self.table) - 1

    def add(self, keys: np.ndarray) -> None:
        """None of them is held."""
        n, self.n = self.n, self.n + len(keys)
        if self.n > len(self.keys):
            self.keys = np.concatenate([self.keys[:n], np.zeros(n // 2 + len(keys), self.keys.dtype)])
        self.keys[n : self.n] = keys
        self._put(n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it is not among them."""
        if not self.n:
            return np.full(len(keys), -1, np.int32)
        at = self._first(keys)
        out = self.table.take(at)
        left = np.flatnonzero((self.keys.take(out, mode="clip") != keys) & (out >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.table) - 1
            out[left] = now = self.table.take(at[left])
            left = left[(self.keys.take(now, mode="clip") != keys[left]) & (now >= 0)]
        return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Runs of rows of about ``limit`` bytes of text, so that memory is bounded by it and the longest text."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a text column: byte bounds, the first word of each row, and their hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffers(column)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        n = len(space)
        if n:
            edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before, after = np.ones(n, bool), np.ones(n, bool)
            before[1:], after[:-1] = space[:-1], space[1:]
            before[edges], after[edges - 1] = True, True
            word = ~space
            self.starts, self.ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def split_ends(self) -> np.ndarray:
        """ASCII punctuation at the end of a word, after a Latin letter, becomes a word; returns the former word of each."""
        end, left = self.ends.copy(), np.arange(len(self))
        while len(left := left[_PUNCTUATION[self.data[end[left] - 1]] & (end[left] > self.starts[left])]):
            end[left] -= 1
        cut = np.flatnonzero((end < self.ends) & (end > self.starts))
        last = self.data[end[cut] - 1]
        lead = self.data[np.maximum(end[cut] - 2, 0)]  # of two-byte letters: U+00C0 to U+023F but for two signs
        wide = (last >> 6 == 2) & (end[cut] - self.starts[cut] > 1) & ((lead > 0xC3) & (lead < 0xC9) | (lead == 0xC3) & (last != 0x97) & (last != 0xB7))
        cut = cut[_LETTER[last] | wide]
        n = np.ones(len(self), np.int64)
        n[cut] = 2
        of, second = np.repeat(np.arange(len(self)), n), (np.cumsum(n) - 1)[cut]
        self.starts, self.ends, self.first = self.starts[of], self.ends[of], np.concatenate([[0], np.cumsum(n)])[self.first]
        self.starts[second] = self.ends[second - 1] = end[cut]
        self.counts = np.diff(self.first)
        return of

    def _chunks(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The up to eight bytes from each place on as a number; ``left`` bytes of each count."""
        if not hasattr(self, "_padded"):
            self._padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(self.data) + 1,), "<u8", self._padded, strides=(1,))
        return loads[at] & (~U(0) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U))))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its chunks of eight bytes, mixed in one after the other.

        No sum over the bytes: polynomials modulo 2**64 agree on pairs of long words
        whatever their base.
        """
        with np.errstate(over="ignore"):
            size = self.ends - self.starts
            out = mix(size.astype(U) * U(0xA0761D6478BD642F))
            rows, done = np.flatnonzero(size <= _LONG), 0
            while len(rows):
                out[rows] = mix(out[rows] ^ (self._chunks(self.starts[rows] + done, size[rows] - done) * U(0x9E3779B97F4A7C15)))
                done += 8
                rows = rows[size[rows] > done]
            for i in np.flatnonzero(size > _LONG).tolist():
                out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
            return out

    def exact_groups(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of the words ``at`` with equal bytes: each group's first (in ``at``), and each word's group.

        Words meet by hash, and each is then compared with the first of its hash.
        """
        _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        other, size = at[first[ids]], self.ends[at] - self.starts[at]
        same, done, rows = size == self.ends[other] - self.starts[other], 0, np.arange(len(at))
        rows = rows[same & (at != other)]
        while len(rows):
            left = size[rows] - done
            equal = self._chunks(self.starts[at[rows]] + done, left) == self._chunks(self.starts[other[rows]] + done, left)
            same[rows[~equal]] = False
            done += 8
            rows = rows[equal & (size[rows] > done)]
        if not same.all():  # never met: words that only share a hash get groups of their own
            known: dict = {}
            raw = self.data.tobytes()
            ids = np.array([known.setdefault((h, raw[self.starts[i] : self.ends[i]]), len(known)) for i, h in zip(at.tolist(), hashes.tolist(), strict=True)], np.int64)
            _, first = np.unique(ids, return_index=True)
        return first, ids

    def exact_ids(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words ``at``, equal where their bytes are."""
        return self.exact_groups(at, hashes)[1]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each row, joined by one space; ``keep`` is a mask over all words."""
        kept = np.flatnonzero(keep)
        row = np.searchsorted(self.first, kept, side="right") - 1
        inner = np.ones(len(kept), bool)  # another kept word of the row follows, so a white-space byte does too
        if len(kept):
            inner[:-1] = row[1:] == row[:-1]
            inner[-1] = False
        cover = np.zeros(len(self.data) + 1, np.int8)
        cover[self.starts[kept]] += 1
        cover[self.ends[kept]] -= 1
        mask = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
        gaps = self.ends[kept[inner]]
        mask[gaps] = True
        data = self.data.copy()
        data[gaps] = 0x20
        data = data[mask]
        sizes = np.zeros(len(self.first) - 1, np.int64)
        np.add.at(sizes, row, self.ends[kept] - self.starts[kept] + inner)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))

    def sequence_hashes(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Fingerprint of the ``length`` words from each word on (meaningful only inside a row)."""
        return sequence_hashes(hashes, length)

    def window_starts(self, length: int) -> np.ndarray:
        """Words from which ``length`` words of the same row follow."""
        ok = np.zeros(len(self) + 1, np.int32)
        full = self.counts >= length
        np.add.at(ok, self.first[:-1][full], 1)
        np.add.at(ok, self.first[1:][full] - length + 1, -1)
        return np.flatnonzero(np.cumsum(ok[:-1]))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two sequences written one after the other."""
    with np.errstate(over="ignore"):
        return mix(a * U(0xE7037ED1A0B428DB) + (b ^ (b >> U(32))) * U(0x8EBC6AF09C88C6E3) + U(0x589965CC75374CC3))


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    if k < len(a):
        out[: len(a) - k] = a[k:]
    return out


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """By doubling: runs of 1, 2, 4, ... words are joined to the wanted length."""
    run, size, out, have = hashes, 1, None, 0
    while size <= length:
        if length & size:
            out = run if out is None else pair(out, _shift(run, have))
            have += size
        size *= 2
        if size <= length:
            run = pair(run, _shift(run, size // 2))
    return out


def whole_hash(hashes: np.ndarray) -> int:
    """Fingerprint of one short sequence that has fewer words than a shingle."""
    out = np.array([len(hashes) * 0x1B873593 + 7], dtype=U)
    for h in hashes:
        out = pair(out, np.array([h], dtype=U))
    return int(out[0])
