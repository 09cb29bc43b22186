"""The stored index and the comparison of settings against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tests.oracle import assert_same, connect
from tidemark.operators import diversity, postings
from tidemark.plans import retrieval

SF = "/root/testdata/sf0.001"


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[40 / (i + 1) for i in range(40)], k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


def brute(docs, queries, k):
    """Scores of all documents: {query: [(score, id)]}."""
    tf = {i: Counter((t or "").split()) for i, t in docs if i is not None}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, words in queries.items():
        scores = []
        for i, c in tf.items():
            s = 0
            for w, times in words.items():
                if w in c:
                    f, idf = float(c[w]), math.log(1 + (float(n) - df[w] + 0.5) / (df[w] + 0.5))
                    weight = f * (postings.K1 + 1) / (f + postings.K1 * ((1 - postings.B) + postings.B * sum(c.values()) / mean))
                    s += times * math.floor(idf * weight * postings.UNIT + 0.5)
            if s > 0:
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block,k,direct", [(3, 1, 0), (3, 5, 8), (128, 5, 0), (7, 500, 1 << 30), (3, 5, 1 << 30)])
def test_search_against_brute_force(spark, monkeypatch, block, k, direct):
    monkeypatch.setattr(postings, "DIRECT", direct)
    docs = corpus(300) + [(1000, None), (1001, ""), (None, "word1 word2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = postings.build(spark, df, block=block)
    asked = {1: {"word0": 1}, 2: {"word39": 2, "word0": 1, "word1": 1}, 3: {"none": 4}, 4: dict(Counter(docs[7][1].split())), 5: {f"word{i}": 1 for i in range(40)}}
    table = spark.createDataFrame([(q, w, n) for q, ws in asked.items() for w, n in ws.items()], "query_id long, term string, times long")
    got = {}
    for r in postings.search(spark, index, table, k).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: rows for q, rows in brute(docs, asked, k).items() if rows}
    assert got == want


def test_long_queries_are_products_of_blocks(spark, monkeypatch):
    """Several blocks of each side, strips, chunks of full matrices and of pairs; no floor is sought, and no pair of a term and a posting becomes a row."""
    for name, value in {"LONG": 3, "QUERY_ROWS": 40, "DOC_ROWS": 700, "SCORES": 60, "TERMS": 4, "DENSE": 3}.items():
        monkeypatch.setattr(postings, name, value)
    monkeypatch.setattr(postings, "_full_scores", lambda pairs, asked, index: pairs.sparkSession.createDataFrame([], "query_id long, doc_id long, score long"))
    docs = corpus(300) + [(1000, None), (None, "word1 word2")]
    index = postings.build(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    asked = {i: dict(Counter(t.split())) for i, t in docs[:30] if len(set(t.split())) > 3}
    table = spark.createDataFrame([(q, w, n) for q, ws in asked.items() for w, n in ws.items()], "query_id long, term string, times long")
    got = {}
    for r in postings.search(spark, index, table, 7).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert len(got) > 10 and got == brute(docs, asked, 7)


def _shuffled(spark) -> int:
    """Bytes that all shuffles so far have written."""
    spark.range(8).repartition(2).count()  # the store may lag behind by a job
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_postings_are_shuffled_once_however_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(postings, "LONG", 3)
    monkeypatch.setattr(postings, "DOC_ROWS", 3000)
    docs = corpus(2000)
    index = postings.build(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = {i: dict(Counter(t.split())) for i, t in docs[:120] if len(set(t.split())) > 3}
    table = spark.createDataFrame([(q, w, n) for q, ws in asked.items() for w, n in ws.items()], "query_id long, term string, times long")
    spent, got = [], []
    for rows in (1 << 20, 150):
        monkeypatch.setattr(postings, "QUERY_ROWS", rows)
        before = _shuffled(spark)
        got.append(sorted(map(tuple, postings.search(spark, index, table, 3).collect())))
        spent.append(_shuffled(spark) - before)
    assert len(asked) > 60 and got[0] == got[1] and len(got[0]) == 3 * len(asked)
    assert spent[1] < 2 * spent[0], spent


def test_short_queries_join_the_products_that_long_ones_need(spark, monkeypatch):
    docs = corpus(200)
    index = postings.build(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    asked = {1: {"word0": 1, "word30": 2}, 2: {f"word{i}": 1 for i in range(40)}}
    table = spark.createDataFrame([(q, w, n) for q, ws in asked.items() for w, n in ws.items()], "query_id long, term string, times long")
    monkeypatch.setattr(postings, "_floors", lambda *_: pytest.fail("a floor is sought"))
    got = {}
    for r in postings.search(spark, index, table, 5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == brute(docs, asked, 5)


def test_a_term_over_several_partitions_has_a_number_in_each(spark, monkeypatch):
    """Blocks of few postings, texts in many batches and partitions: each number is one term's, and all postings are found."""
    monkeypatch.setattr(postings, "SORTED", 50)
    monkeypatch.setattr(postings, "PACKED", 5)
    monkeypatch.setattr(postings, "LONG", 0)
    docs = corpus(150)
    index = postings.build(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(7), block=4)
    blocks = index.blocks.collect()
    assert len({(r.number, r.term) for r in blocks}) == len({r.number for r in blocks}) > len({r.term for r in blocks}) + 10
    assert all(len(r.docs) <= 4 and r.weights == sorted(r.weights, reverse=True) and r.top == r.weights[0] for r in blocks)
    asked = {i: dict(Counter(t.split())) for i, t in docs[:9]}
    table = spark.createDataFrame([(q, w, n) for q, ws in asked.items() for w, n in ws.items()], "query_id long, term string, times long")
    got = {}
    for r in postings.search(spark, index, table, 6).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == brute(docs, asked, 6)


@pytest.mark.parametrize("k", [1, 10, 100])
def test_product_of_a_block(monkeypatch, k):
    rng = np.random.default_rng(k)
    q, d = rng.integers(0, 4, (40, 60)) * (rng.random((40, 60)) < 0.4), rng.integers(0, 9, (500, 60)) * (rng.random((500, 60)) < np.linspace(0, 1, 60))
    scores = q @ d.T
    want = {(i, int(j), int(scores[i, j])) for i in range(40) for j in np.lexsort((np.arange(500), -scores[i]))[:k] if scores[i, j] > 0}
    (qi, qt), (di, dt) = np.nonzero(q), np.nonzero(d)
    for held, dense in ((1 << 22, 100), (2000, 2), (40, 10**9), (4000, 0)):
        monkeypatch.setattr(postings, "SCORES", held)
        monkeypatch.setattr(postings, "DENSE", dense)
        got = postings.product(qt + 5, qi, q[qi, qt], dt + 5, di, d[di, dt], k)
        assert {tuple(map(int, r)) for r in zip(*got, strict=True)} == want and len(got[0]) == len(want)


def test_blocks_hold_all_postings_in_order(spark):
    index = postings.build(spark, spark.createDataFrame(corpus(200), "doc_id long, text string"), block=4)
    rows = index.blocks.collect()
    flat = sorted((r.term, d) for r in rows for d in r.docs)
    assert flat == sorted((r.term, r.doc_id) for r in index.postings.collect())
    assert all(len(r.docs) <= 4 and r.weights == sorted(r.weights, reverse=True) and r.top == r.weights[0] for r in rows)
    found = {r.term: r.found for r in index.terms.collect()}
    assert found == Counter(t for t, _ in flat)


def test_blocks_are_skipped(spark):
    # one rare word and one frequent one: the frequent word's weak blocks stay closed
    docs = [(i, "often " * (1 + i % 7) + f"filler{i} " * (i % 40)) for i in range(2000)] + [(5000 + i, "seldom often") for i in range(12)]
    index = postings.build(spark, spark.createDataFrame(docs, "doc_id long, text string"), block=16)
    table = spark.createDataFrame([(1, "often", 1), (1, "seldom", 1), (2, "often", 1)], "query_id long, term string, times long")
    asked = postings.asked_terms(table, index)
    floors = postings._floors(asked, index, 5)
    bounded = asked.join(floors, "query_id").withColumn("all", F.sum("most").over(Window.partitionBy("query_id")))
    met, opened = postings.opened_blocks(bounded, index)
    count = lambda df, q: df.filter(F.col("query_id") == q).count()
    every = asked.join(index.blocks, "term")
    # of the first query only the rare word can bring in documents; of the second most blocks stay below the floor
    assert count(every, 1) > 100 and count(met, 1) == 1 and count(opened, 1) == 1
    assert count(met, 2) == count(every, 2) and count(opened, 2) < count(met, 2) / 3
    got = postings.search(spark, index, table, 5).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in got} == {(q, i, s) for q, rows in brute(docs, {1: {"often": 1, "seldom": 1}, 2: {"often": 1}}, 5).items() for i, s in rows}


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    index = postings.build(spark, empty)
    table = spark.createDataFrame([(1, "a1", 1)], "query_id long, term string, times long")
    assert postings.search(spark, index, table).count() == 0
    index = postings.build(spark, spark.createDataFrame([(1, "some words")], "doc_id long, text string"))
    assert postings.search(spark, index, table.limit(0)).count() == 0 and postings.search(spark, index, table).count() == 0


@pytest.mark.parametrize("name", ["index_topk_all", "rrf_fusion_all"])
def test_matches_oracle(spark, name):
    assert assert_same(retrieval.queries()[name](spark, SF), connect(SF), retrieval.oracle_sql()[name]) > 50


def test_ablation_matches_oracle(spark):
    df = retrieval.retrieval_ablation(spark, SF)
    rows = {r.setting: r for r in df.collect()}
    assert len(rows) == 5 + 24 and len({r.cases for r in rows.values()}) == 1
    assert rows["lexical_only"].ndcg_at_k == rows["dense 0.00, as ranked"].ndcg_at_k
    con = connect(SF)
    got = con.execute(retrieval.oracle_sql()["retrieval_ablation"])
    names = [d[0] for d in got.description]
    for want in got.fetchall():
        mine = rows[want[names.index("setting")]]
        assert all(math.isclose(mine[c], v, abs_tol=2e-6) if isinstance(v, float) else mine[c] == v for c, v in zip(names, want, strict=True))


def test_relevance_is_judged_for_found_rows_alone(spark, tmp_path):
    """As by all pairs of a query and a relevant row, with null sources, unlabelled rows and queries without any."""
    rng = random.Random(4)
    docs = [(i, "w", rng.choice(["a", "b", None]), rng.choice(["de", "en"])) for i in range(400)] + [(400, "w", "lonely", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, rng.randrange(2)) for i in range(0, 300)] + [(5, 1), (5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    results = spark.createDataFrame([(s, q, p, i) for s in "xy" for q in range(0, 401, 20) for p, i in enumerate(rng.sample(range(401), 8), 1)], "setting string, query_id long, place int, id long")
    every = retrieval.measures(results, retrieval.relevant_rows(spark, str(tmp_path))).orderBy("setting").collect()
    found, counts = retrieval.relevant_found(spark, str(tmp_path), results)
    assert 0 < found.count() <= results.count() and every == retrieval.measures(results, found, counts=counts).orderBy("setting").collect() and len(every) == 2


def test_picks_are_those_of_marginal_relevance():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 47, 60):
        fused = np.sort(rng.random(n))[::-1]
        vectors = rng.normal(size=(n, 4))
        for weight in (0.5, 0.85, 1.0):
            assert retrieval.pick(fused, vectors, weight) == diversity.marginal(fused, vectors, retrieval.TOP, weight, retrieval.POOL)
        assert retrieval.pick(fused, vectors, None) == list(range(min(n, 8)))


def test_measures_by_hand(spark):
    results = spark.createDataFrame([("s", 1, p, i) for p, i in enumerate([10, 11, 12], 1)] + [("s", 2, 1, 10)], "setting string, query_id long, place int, id long")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 13), (2, 99), (3, 1)], "query_id long, id long")
    r = retrieval.measures(results, relevant, k=2).collect()[0]
    assert (r.cases, r.recall_at_k, r.recall_normalized, r.precision_at_k, r.mrr) == (2, round(1 / 6, 6), 0.25, 0.25, 0.25)
    assert r.ndcg_at_k == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, 6)
