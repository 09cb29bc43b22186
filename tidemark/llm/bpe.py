"""Byte-pair merging: a perfect hash of the vocabulary, and heaps over linked bytes.

Op 1 encodes and decodes: a whole pre-token that is in the vocabulary is one
probe of a minimal perfect hash; any other is merged by a heap over a linked
list of its bytes.  Op 9 only counts: pops of the heap are merges, and the
count is initial symbols less merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern that splits text before byte-level merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merged pre-tokens that a worker remembers; past it the memory starts anew.
MEMO = 400_000
_M64 = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace.

    Keys go to buckets by one part of a 128-bit digest; buckets, largest first,
    look for the displacement that puts all their keys on free slots; buckets of
    one key name their slot outright.  There are as many slots as keys.  A probe reads one displacement and one slot, and
    compares the key kept there, so strings outside the set are told apart.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        parts = [self._parts(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, (b, _) in enumerate(parts):
            groups.setdefault(b, []).append(i)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        free = self.n
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:  # these go straight to the slots left over
                free = next(p for p in range(free - 1, -1, -1) if self.slots[p] < 0)
                self.shift[b], self.slots[free] = ~free, members[0]
                continue
            d = 0
            while True:
                places = [self._place(parts[i][1], d) for i in members]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for i, p in zip(members, places, strict=True):
                self.slots[p] = i
        self.keys = [keys[i] for i in self.slots]

    def _parts(self, key: bytes) -> tuple[int, int]:
        x = int.from_bytes(hashlib.blake2b(key, digest_size=16).digest(), "little")
        return (x & _M64) % self.buckets, x >> 64

    def _place(self, f: int, d: int) -> int:
        """Another place for every displacement, by a multiplicative mix."""
        return (((f + d * 0x9E3779B97F4A7C15 & _M64) * 0xD1342543DE82EF95 & _M64) >> 24) % self.n

    def slot(self, key: bytes) -> int:
        """The key's place among the keys in slot order, or -1."""
        b, f = self._parts(key)
        d = self.shift[b]
        p = ~d if d < 0 else self._place(f, d)
        return p if self.keys[p] == key else -1


def merge(symbols: list, rank_of) -> Iterator[tuple[int, int]]:
    """Pop the lowest-rank adjacent pair (leftmost on ties) until none is left.

    ``symbols`` is changed in place and read through its links; each merge yields
    the position that keeps the joined symbol and the one that goes.  ``rank_of``
    gives ``(rank, joined)`` of two symbols, or None.  O(n log n) for n symbols.
    """
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []
    for i in range(n - 1):
        if (found := rank_of(symbols[i], symbols[i + 1])) is not None:
            heap.append((found[0], i, i + 1, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, j, left, right, joined = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or symbols[i] != left or symbols[j] != right:
            continue  # one side was merged since
        symbols[i], alive[j] = joined, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := rank_of(joined, symbols[k])) is not None:
                heapq.heappush(heap, (found[0], i, k, joined, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := rank_of(symbols[h], joined)) is not None:
            heapq.heappush(heap, (found[0], h, i, symbols[h], joined, found[1]))
        yield i, j


class RankCodec:
    """Encoder and decoder for a file of ranks (``base64 rank`` lines)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.find = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] for k in self.find.keys]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.ranks = ranks
        self.memo: dict[str, tuple[int, ...]] = {}

    def _rank(self, a: bytes, b: bytes):
        joined = a + b
        p = self.find.slot(joined)
        return None if p < 0 else (self.slot_id[p], joined)

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token: one probe where the vocabulary has it, else merging."""
        raw = text.encode()
        p = self.find.slot(raw)
        if p >= 0:
            return (self.slot_id[p],)
        symbols = [raw[i : i + 1] for i in range(len(raw))]
        gone = {j for _, j in merge(symbols, self._rank_plain)}
        return tuple(self.ranks[s] for i, s in enumerate(symbols) if i not in gone)

    def _rank_plain(self, a: bytes, b: bytes):
        joined = a + b
        r = self.ranks.get(joined)
        return None if r is None else (r, joined)

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        pieces = self.pattern.findall(text)
        missing = set(pieces).difference(memo)
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = set(pieces)
        for x in missing:
            memo[x] = self.piece(x)
        out: list[int] = []
        for ids in map(memo.__getitem__, pieces):
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str = PATTERN) -> RankCodec:
    return RankCodec(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Add the token ids (array of int) of ``text`` and, unless None, the bytes decoded from them.

    Null text counts as empty: no ids, no bytes.  The whole text is encoded, each
    match of the pattern by itself; text that names a special token is ordinary.
    Columns named as the outputs are replaced; all others pass through.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = docs.select(*keep).withColumn(ids, F.lit(None).cast("array<int>"))
    if decoded:
        schema = schema.withColumn(decoded, F.lit(None).cast("binary"))

    def run(batches):
        codec = rank_codec(ranks_path)
        for batch in batches:
            for part in _rows(batch, text):
                lists = [codec.encode(t or "") for t in part.column(text).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                cols = [part.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    cols.append(pa.array([codec.decode(x) for x in lists], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=keep + [ids] + ([decoded] if decoded else []))

    return docs.select(*keep).mapInArrow(run, schema.schema)


def _rows(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    from .words import slices

    return slices(batch, text, limit)


class MergeCounter:
    """Token counts by a vocabulary file of the ``tokenizers`` library, byte-level kind.

    Special strings in a text count as one token each and split it, as that
    library does by default.  Nothing is added around a text.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: (i, p[0] + p[1]) for i, p in reversed(list(enumerate(pairs)))}
        self.alphabet = byte_alphabet()
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Initial symbols less merges; no ids are made."""
        symbols = [self.alphabet[b] for b in text.encode()]
        n = len(symbols)
        return n - sum(1 for _ in merge(symbols, lambda a, b: self.ranks.get((a, b))))

    def count(self, text: str) -> int:
        special, total, parts = 0, 0, [text]
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            special = len(parts) - 1
        memo = self.memo
        for part in parts:
            pieces = self.pattern.findall(part)
            missing = set(pieces).difference(memo)
            if len(memo) + len(missing) > MEMO:
                memo.clear()
                missing = set(pieces)
            for x in missing:
                memo[x] = self.piece(x)
            total += sum(map(memo.__getitem__, pieces))
        return total + special


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else code points from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text`` as a long; null text counts as empty, with none.

    Whole texts are counted.  A column named ``out`` is replaced; all others pass through.
    """
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep).withColumn(out, F.lit(None).cast("long")).schema

    def run(batches):
        counter = merge_counter(vocabulary_path)
        for batch in batches:
            for part in _rows(batch, text):
                n = [counter.count(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(n, pa.int64())], names=[*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)
