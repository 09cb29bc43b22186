"""Versioned tables: commits, lost runs, readers of old versions; vectors that are filled once."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from tests.oracle import assert_same, connect
from tidemark.operators import vectors
from tidemark.plans import sinks
from tidemark.sources.versioned import Conflict, Store

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", {"t": ["k"], "u": ["k"]}, buckets=4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, name string, n long")


@pytest.mark.parametrize("name", sorted(sinks.queries()))
def test_matches_oracle(spark, name):
    assert assert_same(sinks.queries()[name](spark, SF), connect(SF), sinks.oracle_sql()[name])


def test_upsert_keeps_what_is_not_given(spark, store):
    assert store.versions() == [] and store.read("t") is None
    store.upsert("one", "t", frame(spark, [(1, "a", 1), (2, "b", 2), (None, "no key", 0)]))
    store.upsert("two", "t", frame(spark, [(2, None, 20), (3, "c", None), (None, "still none", None), (3, "d", None)]))
    assert rows_of(store.read("t")) == sorted([(1, "a", 1), (2, "b", 20), (3, "d", None), (None, "still none", 0)], key=repr)
    assert rows_of(store.read("t", 1)) == sorted([(1, "a", 1), (2, "b", 2), (None, "no key", 0)], key=repr)
    assert store.versions() == [1, 2]


def test_a_run_counts_once(spark, store):
    for _ in range(3):
        assert store.upsert("one", "t", frame(spark, [(1, "a", 1)])) == 1
    assert store.versions() == [1]
    store.upsert("nothing", "t", frame(spark, []))
    assert rows_of(store.read("t")) == [(1, "a", 1)]


def test_a_run_lost_before_its_manifest_changes_nothing(spark, store, monkeypatch):
    store.upsert("one", "t", frame(spark, [(i, "a", i) for i in range(20)]))

    def lost(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lost)
        with pytest.raises(RuntimeError):
            store.upsert("two", "t", frame(spark, [(i, "b", i) for i in range(20)]))
    assert store.versions() == [1] and {r[1] for r in rows_of(store.read("t"))} == {"a"}
    assert store.vacuum() == 4  # the lost run's folders
    store.upsert("two", "t", frame(spark, [(i, "b", i) for i in range(20)]))
    assert {r[1] for r in rows_of(store.read("t"))} == {"b"} and {r[1] for r in rows_of(store.read("t", 1))} == {"a"}


def test_two_writers(spark, store):
    store.upsert("one", "t", frame(spark, [(1, "a", 1)]))
    late = store.manifest() | {"version": 1}
    with pytest.raises(Conflict):
        store._publish(late)
    assert not [n for n in os.listdir(store.root[7:] + "/versions") if not n.startswith(".0") and not n.startswith("0")]


def test_only_touched_buckets_are_written(spark, store):
    store.upsert("one", "t", frame(spark, [(i, "a", i) for i in range(40)]))
    before = store.manifest()["tables"]["t"]["buckets"]
    store.upsert("two", "t", frame(spark, [(7, "b", 7)]))
    after = store.manifest()["tables"]["t"]["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


def test_replace_and_delete_from_two_tables(spark, store):
    store.replace("one", "t", frame(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)]))
    store.replace("two", "u", frame(spark, [(1, "x", 1), (3, "y", 2)]))
    store.replace("three", "t", frame(spark, [(1, "new", 9)]))
    assert rows_of(store.read("t")) == sorted([(1, "new", 9), (2, "c", 3), (None, "d", 4)], key=repr)
    gone = frame(spark, [(1, "", 0), (None, "", 0)]).select("k")
    version = store.delete("four", {"t": gone, "u": gone})
    assert rows_of(store.read("t")) == [(2, "c", 3)] and rows_of(store.read("u")) == [(3, "y", 2)]
    assert len(rows_of(store.read("t", version - 1))) == 3 and len(rows_of(store.read("u", version - 1))) == 2
    store.delete("five", {"t": frame(spark, [(2, "", 0)]).select("k")})
    assert store.read("t").count() == 0 and store.read("t").columns == ["k", "name", "n"]


def test_nothing_is_embedded_twice(spark, tmp_path):
    log = tmp_path / "log"

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(hashlib.sha1(t.encode()).hexdigest() + "\n" for t in texts)
        return np.array([[len(t), 1.0] for t in texts])

    store = Store(spark, f"file://{tmp_path}/store", vectors.TABLES, buckets=4)
    texts = [f"text {i % 15}" for i in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    first = vectors.migrate(store, docs, "m", 2, embedder, batches=4, stop_after=2)
    assert first == 2 and len(log.read_text().split()) < 16
    partial = vectors.inventory(store).collect()[0]
    assert partial.total == 41 and partial.embedded + partial.unembedded == 41 and partial.unembedded > 0
    assert sum(list(r.vector) == [0.0, 0.0] for r in vectors.attached(store, "m", 2).collect()) == partial.unembedded + 1
    vectors.migrate(store, docs, "m", 2, embedder, batches=4)
    assert vectors.migrate(store, docs, "m", 2, embedder, batches=4) == 0
    counts = Counter(log.read_text().split())
    assert len(counts) == 16 and set(counts.values()) == {1}
    assert [(r.embedded, r.total, r.unembedded) for r in vectors.inventory(store).collect()] == [(41, 41, 0)]
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in vectors.attached(store, "m", 2).collect() if r.row_id != 40)
    # a changed text is stale, another model starts anew
    changed = spark.createDataFrame([(0, "another text")], "doc_id long, text string")
    assert vectors.migrate(store, changed, "m", 2, embedder, batches=4) == 1 and vectors.stale(docs, store, "m2", 2).count() == 16
    assert vectors.stale(docs, store, "m", 3).count() == 16


def test_vectors_of_another_size_stay_stale(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", vectors.TABLES, buckets=2)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    vectors.migrate(store, docs, "m", 3, lambda ts: np.ones((len(ts), 2)), batches=1)
    assert vectors.stale(docs, store, "m", 3).count() == 2
    vectors.migrate(store, docs, "m", 2, lambda ts: np.array([[np.nan, 1.0] if t == "a" else [3.0, 4.0] for t in ts]), batches=1)
    assert [r.text for r in vectors.stale(docs, store, "m", 2).collect()] == ["a"]
