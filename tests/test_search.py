"""Search, passages and sources against DuckDB and brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diversity, hybrid, passages
from tidemark.plans import search
from tidemark.sources import companyfacts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(search.SPELLED))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = search.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({search.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


@pytest.mark.parametrize("name", ["cosine_topk_all"])
def test_every_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = search.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({search.oracle_sql()[name]})").fetchall()
    got = list(map(tuple, df.collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r[0] for r in got}) == 25


def test_blocks_turns_and_strips_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 5)), 1)
    v[40:60] = v[0]  # ties
    ids = [int(i) for i in rng.choice(1 << 40, 250, replace=False)] + [20 * i for i in range(50)]
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(ids, v, strict=True)] + [(None, [1.0] * 5), (7, None)], "vec_id long, embedding array<float>")
    want = []
    f = v.astype(np.float32).astype(float)
    for q in range(300):
        if ids[q] % 20 == 0:
            order = sorted(range(300), key=lambda j: (-round(float(np.round(f[q] @ f[j], 5)), 5), ids[j]))[:9]
            want += [(ids[q], ids[j]) for j in order]
    for name, value in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 40), ("STRIP", 8), ("TURN_BYTES", 1000)):
        monkeypatch.setattr(search, name, value)
        got = search.dense_all(rows, 9).orderBy("query_id", "rk").collect()
        assert sorted((r.query_id, r.id) for r in got) == sorted(want), name


def test_diverse_rows_of_every_query(spark):
    got = search.mmr_topk_all(spark, SF).collect()
    assert len(got) == 25 * 8 and sorted({r.query_id for r in got}) == list(range(0, 500, 20))
    one = sorted((r.place, r.vec_id) for r in search.mmr_topk(spark, SF).collect())
    assert sorted((r.place, r.vec_id) for r in got if r.query_id == 0) == one


def test_passages():
    assert passages.passages(None) == passages.passages(" \n\n ") == passages.passages("too short") == []
    assert passages.tokens("a b c") == 4
    words = [f"w{i}" for i in range(1000)]
    text = "\n\n".join(["Some Heading"] + [" ".join(words[i : i + 50]) + "." for i in range(0, 1000, 50)])
    got = passages.passages(text, "7", "Title")
    assert len(got) > 2 and all(p.n_tokens <= 380 + 60 and p.heading == "Some Heading" and p.item == "7" for p in got)
    assert [w for w in words if any(w in p.text.replace(".", "").split() for p in got)] == words
    assert got[1].text.split()[:45] == got[0].text.split()[-45:]
    assert [p.ordinal for p in got] == list(range(len(got))) and got[0].start == 0 and got[-1].end == len(text) and got[1].start == got[0].end
    one = " ".join(f"Sentence {i} has some words in it." for i in range(200))
    assert all(p.text.startswith(("Sentence", "has", "some", "words", "in", "it.")) or p.ordinal for p in passages.passages(one)) and len(passages.passages(one)) > 3
    assert list(passages.paragraphs("a\n\n\n\n b ")) == [("a", 0), ("b", 5)]


def _filing(codes, fill=900, contents=True):
    parts = [f"Item {c}. Something {i}" for i, c in enumerate(codes)] + ["cover " * 100] if contents else []
    return "\n".join(parts + [f"Item {c}. Heading\n" + "word " * (fill // 5) for c in codes])


def test_sections():
    codes = ["1", "1A", "2", "3", "7", "7A", "8"]
    assert [s.item for s in passages.sections(_filing(codes))] == codes
    assert [s.item for s in passages.sections(_filing(codes, 400))] == [None]
    assert [s.item for s in passages.sections(_filing(["1", "16", "1A", "2", "3", "7", "8"], contents=False))] == ["1", "1A", "2", "3", "7", "8"]
    # page headers repeat an item inside its section
    text = _filing(["1", "7"], contents=False) + "\nItem 7. Heading\n" + "more " * 300 + "\n" + _filing(["8"], contents=False)
    assert [s.item for s in passages.sections(text)] == ["1", "7", "8"]
    # statements are taken out of the section that holds them
    text = _filing(["1", "7", "15"], contents=False) + "\nConsolidated Balance Sheets\n" + "row " * 300
    assert [s.item for s in passages.sections(text)] == ["1", "7", "15", "8"]
    # titles stand in where a body has no items
    text = "\n".join(f"Item {c}. X" for c in codes) + "\n" + "pad " * 200 + "".join(f"\n{t}\n" + "word " * 200 for t in ("Business", "Risk Factors", "Management's Discussion and Analysis"))
    assert [s.item for s in passages.sections(text)] == ["1", "1A", "7"]
    assert passages.sections(None) == [(None, "Full document", "", 0, 0)] and passages.sections("plain")[0].text == "plain"
    parts = passages.sections(_filing(codes, 6000))
    assert [p.ordinal for p in passages.of_sections(parts)] == list(range(len(passages.of_sections(parts))))


def test_query_side():
    assert hybrid.expand("Leverage and debt")[1] == ["borrowings", "indebtedness", "notes payable"] and hybrid.expand("x") == ("x", [])
    assert hybrid.priors("liquidity risk and margin") == {"1A": 1.25, "7": 1.2} and hybrid.priors("zzz") == {}
    assert hybrid.matched("the debt Ratio of it", "RATIOS and debts") == ["debt", "Ratio"]


def test_snippets(spark):
    rows = [("a" * 500,), ("short",), ("x" * 300 + "term" + "y" * 300,), (" b " * 40,), (None,)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    got = [r.s for r in docs.select(hybrid.snippet(F.col("text"), ["none", "TERM"]).alias("s")).collect()]
    assert got[0] == "a" * 320 + "..." and got[1] == "short" and got[3] == " b ".join([""] * 41).strip() and got[4] == ""
    assert got[2].startswith("...x") and got[2].endswith("y...") and "term" in got[2] and len(got[2]) == 326
    assert [r.s for r in docs.limit(2).select(hybrid.snippet(F.col("text"), []).alias("s")).collect()] == got[:2]


def test_shares_of_issuers():
    assert hybrid.shares([0, 1, 2, 3, 4, 5, 6, 7], list(range(14)), {i: "AAAABBBBCCCDDD"[i] for i in range(14)}, ["c", "D", "a", "b"], 8) == [0, 1, 4, 5, 8, 9, 11, 12]
    issuer = {i: "A" if i < 9 else "B" for i in range(12)}
    got = hybrid.shares(list(range(8)), list(range(12)), issuer, ["a", "b"], 8)
    assert got == [0, 1, 2, 3, 4, 9, 10, 11]
    assert hybrid.shares([0, 9], list(range(12)), issuer, ["A", "B"], 2) == [0, 9]
    assert hybrid.shares([0, 1], [0, 1], {0: "A", 1: "A"}, ["A", "C"], 2) == [0, 1]


def test_hashed_vectors(spark):
    one, two = hybrid.hashed_vector("Debt covenants tighten"), hybrid.hashed_vector("debt COVENANTS tighten the")
    assert np.allclose(one, two) and abs(np.linalg.norm(one) - 1) < 1e-6
    assert not hybrid.hashed_vector(None).any() and not hybrid.hashed_vector("the of").any()
    assert search.hashed_embedding(spark, SF).count() == 200


def test_hybrid_search(spark):
    got = search.hybrid_search(spark, SF).orderBy("place").collect()
    assert len(got) == 8 and [r.place for r in got] == list(range(1, 9))
    assert all(r.dense_rank or r.lexical_rank for r in got) and {r.prior for r in got} <= {1.0, 1.25}


def test_marginal():
    v = np.array([[1.0, 0], [1, 0], [0, 1]])
    assert diversity.marginal(np.array([1.0, 0.9, 0.5]), v, 2, 0.5) == [0, 2]
    assert diversity.marginal(np.array([1.0, 0.9, 0.5]), v, 9, 1.0) == [0, 1, 2]
    assert diversity.marginal(np.zeros(0), v[:0], 3, 0.5) == []


def test_pool_takes_in_the_next_row(spark):
    # 30 alike rows fill the pool of k = 2; the 31st is unlike them and enters after the first pick
    rows = [(0, i, 1.0 - i / 1000, [1.0, 0.0]) for i in range(30)] + [(0, 30, 0.9, [0.0, 1.0]), (0, 31, 0.89, [0.0, -1.0])]
    hits = spark.createDataFrame(rows, "q int, i int, s double, v array<double>")
    assert [r.i for r in diversity.choose(hits, "q", "i", "s", "v", k=2, weight=0.7).orderBy("place").collect()] == [0, 30]


def test_query_rows(spark):
    assert search.mmr_topk(spark, SF).count() == 8
    assert search.passages_packed(spark, SF).count() > 100


def test_companyfacts(spark):
    body = '{"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2024-01-01", "end": "2024-12-31", "val": 5, "fy": 2024, "fp": "FY", "form": "10-K", "accn": "a"}, {"end": "2024-12-31", "val": 6}]}}}}}'
    rows = companyfacts.entries(spark.createDataFrame([(1, body), (2, None), (3, "{")], "cik int, body string")).collect()
    assert [(r.cik, r.tag, r.unit, r.entry_at, r.val, r.start) for r in rows] == [(1, "Revenues", "USD", 0, 5.0, "2024-01-01"), (1, "Revenues", "USD", 1, 6.0, None)]
    names = companyfacts.tickers(spark.createDataFrame([('{"0": {"ticker": "abc", "cik_str": 12, "title": "A"}}',)], "body string"))
    assert names.collect() == [("ABC", "0000000012", "A")]
