"""Tables that are written by commits and read back: upserts, replaced groups, cascades and the migration of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import hybrid, vectors
from tidemark.sources.scratch import Scratch
from tidemark.sources.versioned import Store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession, keys: dict[str, list[str]]) -> Store:
    return Store(spark, Scratch(spark, "store").root, keys, buckets=8)


def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the customers, then half of all with some values missing: these keep what was known."""
    store = _store(spark, {"company": ["id"]})
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    store.upsert("load", "company", rows.filter("id % 3 <> 0"))
    changed = rows.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, F.concat("name", F.lit(" new"))).alias("name"), "segment", F.when(F.col("id") % 5 != 0, F.col("balance") + 1).alias("balance"))
    store.upsert("changes", "company", changed)
    version = store.upsert("changes", "company", changed)  # done again, it changes nothing
    return store.read("company").withColumn("version", F.lit(version).cast("long"))


UPSERT_SQL = """
WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
n AS (SELECT id, CASE WHEN id % 4 <> 0 THEN name || ' new' END AS name, segment, CASE WHEN id % 5 <> 0 THEN balance + 1 END AS balance FROM c WHERE id % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment, coalesce(n.balance, o.balance) AS balance, CAST(2 AS BIGINT) AS version
FROM (SELECT * FROM c WHERE id % 3 <> 0) o FULL JOIN n ON n.id = o.id
"""


def versioned_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early orders of all customers; then a third of the customers have theirs replaced by their late ones."""
    store = _store(spark, {"orders": ["owner"]})
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("y"))
    store.replace("load", "orders", rows.filter("y < 1995"))
    store.replace("late", "orders", rows.filter("y >= 1995 AND owner % 3 = 0"))
    return store.read("orders").select("owner", "id", "price")


REPLACE_SQL = """
WITH r AS (SELECT o_custkey AS owner, o_orderkey AS id, o_totalprice AS price, year(o_orderdate) AS y FROM orders),
late AS (SELECT * FROM r WHERE y >= 1995 AND owner % 3 = 0)
SELECT owner, id, price FROM r WHERE y < 1995 AND owner NOT IN (SELECT owner FROM late) UNION ALL SELECT owner, id, price FROM late
"""


def versioned_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of a fifth of the nations go, and their orders with them, in one commit."""
    store = _store(spark, {"company": ["owner"], "filing": ["owner"]})
    companies = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("nation"))
    filings = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"))
    store.replace("companies", "company", companies)
    store.replace("filings", "filing", filings)
    gone = companies.filter("nation % 5 = 1").select("owner")
    version = store.delete("cascade", {"company": gone, "filing": gone})
    before = store.read("filing", version - 1).groupBy("owner").agg(F.count(F.lit(1)).alias("before"))
    after = store.read("filing").groupBy("owner").agg(F.count(F.lit(1)).alias("after"))
    kept = store.read("company").select("owner", F.lit(True).alias("kept"))
    return before.join(after, "owner", "left").join(kept, "owner", "left").select("owner", "before", F.coalesce("after", F.lit(0).cast("long")).alias("after"), F.coalesce("kept", F.lit(False)).alias("kept"))


CASCADE_SQL = """
SELECT o_custkey AS owner, count(*) AS before, CAST(CASE WHEN any_value(c_nationkey) % 5 = 1 THEN 0 ELSE count(*) END AS BIGINT) AS after, any_value(c_nationkey) % 5 <> 1 AS kept
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey
"""


def hashed(dimensions: int) -> vectors.Embedder:
    return lambda texts: np.array([hybrid.hashed_vector(t, dimensions) for t in texts])


def embedding_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older model for half of the documents; then another for all, stopped after two batches and taken up again."""
    store = _store(spark, vectors.TABLES)
    docs = _table(spark, sf_dir, "documents").filter("doc_id is not null")
    vectors.migrate(store, docs.filter("doc_id % 2 = 0"), "hashed", 32, hashed(32), batches=2)
    vectors.migrate(store, docs, "hashed", 64, hashed(64), batches=4, stop_after=2)
    vectors.migrate(store, docs, "hashed", 64, hashed(64), batches=4)
    return vectors.inventory(store)


MIGRATION_SQL = """
WITH t AS (SELECT doc_id, sha1(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), total AS (SELECT count(*) AS total FROM t)
SELECT 'hashed' AS model, CAST(32 AS INTEGER) AS dimensions, count(*) AS embedded, any_value(total) AS total, any_value(total) - count(*) AS unembedded FROM t, total WHERE digest IN (SELECT digest FROM t WHERE doc_id % 2 = 0)
UNION ALL SELECT 'hashed', 64, total, total, 0 FROM total
"""


def queries() -> dict:
    return {f.__name__: f for f in (versioned_upsert, versioned_replace, versioned_cascade, embedding_migration)}


def oracle_sql() -> dict[str, str]:
    return {"versioned_upsert": UPSERT_SQL, "versioned_replace": REPLACE_SQL, "versioned_cascade": CASCADE_SQL, "embedding_migration": MIGRATION_SQL}
