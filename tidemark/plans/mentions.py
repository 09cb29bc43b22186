"""Names of issuers, and openings of benchmark items, in all documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import mentions

#: Words of an item's opening that count as a name.
OPENING = r"^[^ \n]+ [^ \n]+ [^ \n]+"


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, name, mentions, first_at): each name in each text of documents and pages."""

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    names = read("nation").select(F.col("n_name").alias("name")).union(read("supplier").select("s_name")).union(read("customer").select("c_name")).union(read("region").select("r_name"))
    names = names.union(read("benchmark").select(F.regexp_extract("text", OPENING, 0)))
    texts = read("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").union(read("pages").select(F.lit("page"), "page_id", "html"))
    found = mentions.mentions(spark, texts, names, ["kind", "id"])
    return found.select("kind", "id", "name", F.size("places").cast("long").alias("mentions"), F.element_at("places", 1).cast("long").alias("first_at"))


MENTIONS_SQL = rf"""
WITH n AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer UNION SELECT r_name FROM region UNION SELECT regexp_extract(text, '{OPENING}') FROM benchmark),
t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
m AS (SELECT kind, id, text, name, (CASE WHEN regexp_matches(name, '^[A-Za-z0-9_]') THEN '\b' ELSE '' END) || '\Q' || name || '\E' || (CASE WHEN regexp_matches(name, '[A-Za-z0-9_]$') THEN '\b' ELSE '' END) AS pattern FROM t JOIN n ON name <> '' AND contains(text, name))
SELECT kind, id, name, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS mentions,
       CAST(length(string_split_regex(text, pattern)[1]) AS BIGINT) AS first_at
FROM m WHERE regexp_matches(text, pattern)
"""


def queries() -> dict:
    return {"entity_mentions": entity_mentions}


def oracle_sql() -> dict[str, str]:
    return {"entity_mentions": MENTIONS_SQL}
