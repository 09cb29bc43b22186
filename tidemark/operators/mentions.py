"""Where any of many names stands in texts: one pass of an automaton over each text, whatever the number of names."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of names in one automaton; more names are dealt to several, each with a pass of its own.
AUTOMATON_BYTES = 32 << 20
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
#: The worker's last list of names, and its automaton.
_built: list = [None, None]


def automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name, name)
    out.make_automaton()
    return out


def found(machine: ahocorasick.Automaton, text: str) -> Iterator[tuple[str, int]]:
    """(name, place) of names that stand in ``text`` with no letter, digit or underscore run on over either end; of one name's overlapping places the first."""
    if not len(machine):
        return
    free: dict[str, int] = {}
    for last, name in machine.iter(text):
        start, end = last - len(name) + 1, last + 1
        if start and name[0] in _WORD and text[start - 1] in _WORD:
            continue
        if end < len(text) and name[-1] in _WORD and text[end] in _WORD:
            continue
        if start >= free.get(name, 0):
            free[name] = end
            yield name, start


def _pass(texts: DataFrame, names: Broadcast, keys: list[str]) -> DataFrame:
    kinds = dict(texts.dtypes)

    def run(batches):
        if _built[0] is not names.value:
            _built[:] = names.value, automaton(names.value)
        machine = _built[1]
        for batch in batches:
            row, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                each: dict[str, list[int]] = {}
                for name, at in found(machine, text or ""):
                    each.setdefault(name, []).append(at)
                row += [i] * len(each)
                hits += each.items()
            at = pa.array(row, pa.int64())
            columns = [batch.column(k).take(at) for k in keys] + [pa.array([n for n, _ in hits], pa.string()), pa.array([p for _, p in hits], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "name", "places"])

    return texts.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", name string, places array<int>")


def mentions(spark: SparkSession, texts: DataFrame, names: DataFrame, keys: list[str], limit: int = AUTOMATON_BYTES) -> DataFrame:
    """(keys, name, places) of every name in every ``text``; places are numbers of characters from 0.

    ``names`` has a column name; null, empty and repeated ones count once or not at all.
    Names are told apart by case.  An automaton holds at most about ``limit`` bytes of
    names, so what the driver gathers and broadcasts is bounded.
    """
    given = names.filter("name is not null and name <> ''").select("name").distinct()
    size = given.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    shards = 1 + size // limit
    out = None
    for i in range(shards):
        part = [r[0] for r in given.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == i).collect()]
        one = _pass(texts, spark.sparkContext.broadcast(part), keys)
        out = one if out is None else out.unionByName(one)
    return out

