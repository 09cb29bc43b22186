"""Vectors of texts, one for each distinct text and model, filled in batches that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.versioned import Store

#: The store's tables and their keys: digests of texts by row, and vectors by digest and model.
TABLES = {"texts": ["row_id"], "vectors": ["digest", "model", "dimensions"]}
Embedder = Callable[[list[str]], np.ndarray]


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, digest): rows without a text have none."""
    return docs.select(F.col(key).cast("long").alias("row_id"), F.sha1(F.col(text).cast("binary")).alias("digest"))


def stale(docs: DataFrame, store: Store, model: str, dimensions: int, text: str = "text") -> DataFrame:
    """(digest, text) of every distinct text without a vector of this model and size, or with a null one."""
    texts = docs.filter(F.col(text).isNotNull()).select(F.sha1(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text"))
    texts = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    known = store.read("vectors")
    if known is None:
        return texts
    return texts.join(known.filter((F.col("model") == model) & (F.col("dimensions") == dimensions) & F.col("vector").isNotNull()).select("digest"), "digest", "left_anti")


def embed(texts: DataFrame, model: str, dimensions: int, embedder: Embedder) -> DataFrame:
    """(digest, model, dimensions, vector): unit vectors; one of another size or not finite is null, so that it stays stale."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = np.asarray(embedder(batch.column("text").to_pylist()), np.float64)
            right = made.ndim == 2 and made.shape[1] == dimensions
            length = np.linalg.norm(made, axis=1, keepdims=True) if right else None
            rows = [(v / n if n else v).astype(np.float32).tolist() if np.isfinite(v).all() else None for v, n in zip(made, length[:, 0], strict=True)] if right else [None] * batch.num_rows
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([model] * n), pa.array([dimensions] * n, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["digest", "model", "dimensions", "vector"])

    return texts.mapInArrow(run, "digest string, model string, dimensions int, vector array<float>")


def migrate(store: Store, docs: DataFrame, model: str, dimensions: int, embedder: Embedder, key: str = "doc_id", text: str = "text", batches: int = 8, stop_after: int | None = None) -> int:
    """Give every text a vector of ``model``; how many batches were committed.

    A batch is a share of the digests; each is one commit, so a migration that was
    stopped goes on with the texts that are still stale.  A batch without stale texts
    commits nothing.  ``stop_after`` ends it after so many commits.
    """
    current = digests(docs, key, text)
    before = store.read("texts")
    if before is not None:  # only rows whose text is another one now
        current = current.join(before.withColumnRenamed("digest", "__old"), "row_id", "left").filter(~F.col("digest").eqNullSafe(F.col("__old"))).drop("__old")
    if not current.isEmpty():
        store.replace(f"texts after {store.manifest()['version']}", "texts", current)
    done = 0
    for i in range(batches):
        if stop_after is not None and done >= stop_after:
            break
        share = stale(docs, store, model, dimensions, text).filter(F.pmod(F.xxhash64("digest"), F.lit(batches)) == i)
        if share.isEmpty():
            continue
        keys = share.select("digest", F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"))
        store.upsert(f"{model} {dimensions} batch {i} after {store.manifest()['version']}", "vectors", embed(share, model, dimensions, embedder), keys)
        done += 1
    return done


def inventory(store: Store) -> DataFrame:
    """(model, dimensions, embedded, total, unembedded): rows with a vector of each model, of all rows with a text."""
    texts = store.read("texts").filter("digest is not null")
    found = texts.join(store.read("vectors").filter("vector is not null"), "digest").groupBy("model", "dimensions").agg(F.count(F.lit(1)).alias("embedded"))
    return found.crossJoin(F.broadcast(texts.agg(F.count(F.lit(1)).alias("total")))).withColumn("unembedded", F.col("total") - F.col("embedded"))  # one row is broadcast


def attached(store: Store, model: str, dimensions: int) -> DataFrame:
    """(row_id, vector): rows whose text has no vector have zeros."""
    vectors = store.read("vectors").filter((F.col("model") == model) & (F.col("dimensions") == dimensions)).select("digest", "vector")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return store.read("texts").join(vectors, "digest", "left").select("row_id", F.coalesce("vector", zeros).alias("vector"))
