"""Search, page text and numeric claims: queries in two spellings, and those without SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import diversity, hybrid, pages, passages

from . import registry

_DOT = {"spark": "aggregate(zip_with({0}, {1}, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, x) -> s + x)", "duck": "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"}


def _dense(engine: str) -> str:
    return f"dense AS (SELECT e.vec_id AS id, round({_DOT[engine].format('e.embedding', 'p.embedding')}, 5) AS score FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) p)"


def _cosine(engine: str) -> str:
    return f"WITH {_dense(engine)} SELECT id AS vec_id, score FROM dense ORDER BY score DESC, id LIMIT 40"


def _fusion(engine: str) -> str:
    """Reciprocal ranks of both legs' best 100 rows with positive scores; the dense leg weighs 0.2."""
    legs = ", ".join(f"{leg} AS (SELECT id, rk FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM {source} WHERE score > 0) z WHERE rk <= 100)" for leg, source in (("dl", "dense"), ("ll", "(SELECT doc_id AS id, round(score, 5) AS score FROM s) b")))
    dense = _dense(engine)
    lexical = registry.BM25 if engine == "duck" else registry._spark(registry.BM25)
    return f"WITH {lexical.replace('dl AS (', 'lens AS (').replace('FROM dl)', 'FROM lens)').replace('JOIN dl ON tf.doc_id = dl.doc_id', 'JOIN lens ON tf.doc_id = lens.doc_id').replace('dl.n', 'lens.n')}, {dense}, {legs} SELECT coalesce(dl.id, ll.id) AS id, dl.rk AS dense_rank, ll.rk AS lexical_rank, round(coalesce(0.2e0 / (60 + dl.rk), 0e0) + coalesce(0.8e0 / (60 + ll.rk), 0e0), 8) AS fused FROM dl FULL JOIN ll ON dl.id = ll.id ORDER BY fused DESC, id LIMIT 40"


def _page_text(engine: str) -> str:
    text = "coalesce(html, '')"
    for pattern, new in [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?is)<head.*?</head>", " "), (r"(?is)<!--.*?-->", " "), (r"(?i)</t[dh]>", " | "), (r"(?i)<br ?/?>|</(p|div|li|tr|h[1-6])>", "\n"), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n")]:
        spelled = f"r'{pattern}', '{new}')" if engine == "spark" else f"'{pattern}', '{new}', 'g')"
        text = f"regexp_replace({text}, {spelled}"
    return f"SELECT page_id, trim({text}) AS page_text FROM pages"


def _claims(engine: str) -> str:
    """Numbers in whole texts, scaled by their unit if they have one, and how often each stands there."""
    pattern = r"[0-9][0-9,]*(?:[.][0-9]+)?(?: ?(?:%|bps|x|million|billion|k))?"
    found = f"explode(regexp_extract_all(text, r'{pattern}', 0))" if engine == "spark" else f"unnest(regexp_extract_all(text, '{pattern}'))"
    return f"WITH c AS (SELECT doc_id, {found} AS claim FROM documents), v AS (SELECT doc_id, claim, regexp_extract(claim, '[%a-z]+$', 0) AS unit, CAST(replace(regexp_extract(claim, '^[0-9,.]+', 0), ',', '') AS DOUBLE) AS number FROM c) SELECT doc_id, claim, unit, number * CASE unit WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'k' THEN 1e3 ELSE 1e0 END AS value, count(*) AS n FROM v GROUP BY doc_id, claim, unit, number"


SPELLED = {"cosine_topk": _cosine, "rrf_fusion": _fusion, "html_to_text": _page_text, "numeric_claims": _claims}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registry.run_sql(spark, sf_dir, registry._spark(SPELLED[name]("spark")))

    return run


#: Rows whose id this divides are the queries of the searches named _all.
QUERY_STEP = 20
#: Queries and rows of a block, rows of one matrix product, and bytes of queries that are broadcast at a time.
QUERY_BLOCK, ROW_BLOCK, STRIP, TURN_BYTES = 512, 32768, 4096, 32 << 20

_DENSE_ALL = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM (SELECT p.vec_id AS query_id, e.vec_id AS id, round({_DOT['duck'].format('e.embedding', 'p.embedding')}, 5) AS score FROM embeddings e CROSS JOIN embeddings p WHERE p.vec_id % {QUERY_STEP} = 0 AND e.vec_id IS NOT NULL AND e.embedding IS NOT NULL AND p.embedding IS NOT NULL) z"


def _cosine_all() -> str:
    return f"SELECT query_id, id AS vec_id, score FROM ({_DENSE_ALL}) d WHERE rk <= 40"


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Ids and vectors in blocks of about ``size`` rows, whatever the ids are."""
    n = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"{name}_block")
    return rows.groupBy(block).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list(F.col("embedding").cast("array<double>")).alias(name))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, greatest first, ties by id."""
    n = min(k, len(ids))
    at = np.flatnonzero(scores >= np.partition(scores, len(ids) - n)[len(ids) - n])
    return at[np.lexsort((ids[at], -scores[at]))][:n]


def dense_all(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rk): the ``k`` best of all rows for every query, by blocks of queries and of rows.

    Blocks of queries are broadcast, TURN_BYTES of them at a time; more queries take
    further turns over the rows.  A block of rows gives ``k`` rows a query.
    """
    rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    asked = rows.filter(F.col("vec_id") % QUERY_STEP == 0)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    turns = max(1, -(-n_blocks * QUERY_BLOCK * 8 * (width + 1) // TURN_BYTES))
    held, queries = _blocks(rows, ROW_BLOCK, "r"), _blocks(asked, QUERY_BLOCK, "q")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qs, rs = (batch.column(f"{c}_ids")[i].values.to_numpy() for c in "qr")
                q, r = (batch.column(c)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in (("q", len(qs)), ("r", len(rs))))
                ids, scores = np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0))
                for a in range(0, len(rs), STRIP):  # a strip of rows at a time, so no matrix grows with the block
                    strip = np.round(q @ r[a : a + STRIP].T, 5)
                    scores = np.concatenate([scores, strip], axis=1)
                    ids = np.concatenate([ids, np.broadcast_to(rs[a : a + STRIP], strip.shape)], axis=1)
                    best = [_best(s, x, k) for s, x in zip(scores, ids, strict=True)]
                    scores, ids = np.array([s[b] for s, b in zip(scores, best, strict=True)]), np.array([x[b] for x, b in zip(ids, best, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel() + 0.0)], names=["query_id", "id", "score"])

    found = None
    for turn in range(turns):
        part = queries.filter(F.col("q_block") % turns == turn) if turns > 1 else queries
        one = held.crossJoin(F.broadcast(part)).select("q_ids", "q", "r_ids", "r").mapInArrow(run, "query_id long, id long, score double")
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nearest rows of every row whose id QUERY_STEP divides."""
    return dense_all(_vectors(spark, sf_dir), 40).select("query_id", F.col("id").alias("vec_id"), "score")


def mmr_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diverse rows for every row whose id QUERY_STEP divides."""
    rows = _vectors(spark, sf_dir)
    hits = dense_all(rows, 60).withColumnRenamed("id", "vec_id").join(rows, "vec_id").select("query_id", "vec_id", "score", "embedding")
    return diversity.choose(hits, "query_id", "vec_id", "score", "embedding")


def passages_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.cut(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("passage")


def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every whole text (the driver's texts have no items, so each is one)."""
    return passages.split(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page's text; half of the pages are filed under two items, with the page as each one's body."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    parts = [F.lit("<h2>Item 1A. Risk Factors</h2>"), F.col("html"), F.lit("<h2>Item 7. Discussion</h2>"), F.col("html")]
    read = pages.read(rows.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat(*parts)).otherwise(F.col("html"))))
    return passages.split(read.withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of every whole text."""
    return hybrid.embed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


#: What hybrid_search asks.
QUESTION = "erbl hein attion schen risk"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight passages for QUESTION: BM25 and hashed vectors, fused, with priors, diversity and shares of two sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    lexical = registry.run_sql(spark, sf_dir, registry._spark("WITH " + registry.BM25 + " SELECT doc_id AS id, score FROM s"))
    vectors = hybrid.embed(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    asked = F.array(*[F.lit(float(x)) for x in hybrid.hashed_vector(hybrid.expand(QUESTION)[0])])
    dense = vectors.select("id", F.round(F.aggregate(F.zip_with("embedding", asked, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x), 6).alias("score"))
    items = F.element_at(F.array(*map(F.lit, ["1A", "7", "7A", "1", "3"])), F.pmod(F.col("doc_id"), F.lit(5)).cast("int") + 1)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("issuer"), items.alias("item")).join(vectors, "id")
    found = hybrid.fuse(dense, lexical, rows, QUESTION, issuers=["src0", "src1"])
    return found.select("place", "id", F.round("fused", 6).alias("fused"), "dense_rank", "lexical_rank", "prior")


def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diverse rows for vector 0."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hits = registry.run_sql(spark, sf_dir, _cosine("spark").replace("LIMIT 40", "LIMIT 60"))
    hits = hits.join(rows, "vec_id").select(F.lit(0).alias("query_id"), "vec_id", "score", "embedding")
    return diversity.choose(hits, "query_id", "vec_id", "score", "embedding")


def queries() -> dict:
    return {name: _query(name) for name in SPELLED} | {"passages_packed": passages_packed, "mmr_topk": mmr_topk, "cosine_topk_all": cosine_topk_all, "mmr_topk_all": mmr_topk_all, "split_sections": split_sections, "page_sections": page_sections, "hashed_embedding": hashed_embedding, "hybrid_search": hybrid_search}


def oracle_sql() -> dict[str, str]:
    return {name: f("duck") for name, f in SPELLED.items()} | {"cosine_topk_all": _cosine_all()}
