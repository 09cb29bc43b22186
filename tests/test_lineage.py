"""Derived measures, their three debt paths and the walk from a value to its facts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidemark.operators import statements
from tidemark.plans import lineage

SF = "/root/testdata/sf0.001"
SCHEMA = "issuer string, period long, concept string, value decimal(20,4), tag string"


def facts(spark, rows):
    return spark.createDataFrame([(i, p, c, Decimal(v), t) for i, p, c, v, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(lineage.queries()))
def test_matches_oracle(spark, name):
    assert assert_same(lineage.queries()[name](spark, SF), connect(SF), lineage.oracle_sql()[name]) > 100


def test_total_debt_paths(spark):
    rows = [
        ("combined", 1, "total_debt_reported", 90, "x"), ("combined", 1, "short_term_debt", 10, "x"), ("combined", 1, "long_term_debt", 50, "LongTermDebt"),
        ("both", 1, "short_term_debt", 10, "x"), ("both", 1, "long_term_debt", 50, "LongTermDebtNoncurrent"),
        ("short", 1, "short_term_debt", 10, "x"), ("long", 1, "long_term_debt", 50, "LongTermDebtNoncurrent"),
        ("inclusive", 1, "short_term_debt", 10, "x"), ("inclusive", 1, "long_term_debt", 50, "LongTermDebt"),
        ("leases", 1, "short_term_debt", 10, "x"), ("leases", 1, "long_term_debt", 50, "LongTermDebtAndCapitalLeaseObligations"),
        ("none", 1, "revenue", 5, "x"),
    ]
    got = {r.issuer: (r.debt_path, r.total_debt and int(r.total_debt), [x.concept for x in r.total_debt_from]) for r in statements.with_total_debt(statements.periods(facts(spark, rows))).collect()}
    assert got == {
        "combined": ("reported", 90, ["total_debt_reported"]), "both": ("components", 60, ["short_term_debt", "long_term_debt"]), "short": ("components", 10, ["short_term_debt"]),
        "long": ("components", 50, ["long_term_debt"]), "inclusive": ("inclusive", 50, ["long_term_debt"]), "leases": ("inclusive", 50, ["long_term_debt"]), "none": (None, None, []),
    }


def test_measures_only_where_absent_and_where_parts_are_there(spark):
    rows = [("a", 1, c, v, "x") for c, v in {"operating_income": 7, "depreciation_amortization": 2, "depreciation_only": 100, "cash_and_equivalents": 3, "short_term_debt": 10}.items()]
    rows += [("b", 1, c, v, "x") for c, v in {"operating_income": 7, "depreciation_only": 4, "total_equity": 50, "goodwill": 20, "capex": 2}.items()]
    got = {r.issuer: r for r in statements.with_measures(statements.periods(facts(spark, rows))).collect()}
    a, b = got["a"], got["b"]
    assert a.depreciation_amortization == 2 and not a.depreciation_amortization_from and a.ebitda == 9 and a.net_debt == 7
    assert [(x.concept, x.sign) for x in a.net_debt_from] == [("total_debt", 1), ("cash_and_equivalents", -1)]
    assert b.depreciation_amortization == 4 and b.ebitda == 11 and b.tangible_equity == 30 and b.free_cash_flow is None and b.net_debt is None
    assert not b.free_cash_flow_from


def test_trailing_years_need_quarters_that_follow(spark):
    rows = [("a", p, "revenue", p, "x") for p in (1, 2, 3, 4, 6, 7, 8, 9)] + [("a", p, "total_equity", 10 * p, "x") for p in (4, 9)]
    made = statements.graph(statements.with_measures(statements.periods(facts(spark, rows))))
    got = {(r.period, r.concept): int(r.value) for r in made.nodes.filter(F.col("period").startswith("TTM")).collect()}
    got = {k: v for k, v in got.items() if k[1] != "tangible_equity"}
    assert got == {("TTM 4", "revenue"): 10, ("TTM 4", "total_equity"): 40, ("TTM 9", "revenue"): 30, ("TTM 9", "total_equity"): 90}


def test_walk_ends_at_facts_turns_and_the_greatest_depth(spark):
    chain = [("i", "1", f"c{n}", "1", f"c{n + 1}", 1) for n in range(9)]
    loop = [("i", "1", "x", "1", "y", -1), ("i", "1", "y", "1", "x", 1), ("i", "1", "y", "1", "z", -1)]
    edges = spark.createDataFrame(chain + loop, "issuer string, period string, concept string, part_period string, part string, sign int")
    nodes = spark.createDataFrame([("i", "1", "z", Decimal(5), "reported")], "issuer string, period string, concept string, value decimal(20,4), kind string")
    made = statements.Graph(nodes, edges)
    roots = spark.createDataFrame([("i", "1", "c0"), ("i", "1", "x"), ("i", "1", "alone")], "issuer string, period string, concept string")
    got = {(r.root, r.concept): (r.depth, r.leaf, r.note, r.sign) for r in statements.walk(spark, made, roots).collect()}
    assert got["c0", "c6"] == (6, True, "cut at the greatest depth", 1) and ("c0", "c7") not in got
    assert got["x", "y"] == (1, False, "comes back", -1) and got["x", "z"] == (2, True, None, 1) and got["alone", "alone"] == (0, True, None, 1)
    ways = statements.walk(spark, made, roots.filter("concept = 'x'"))
    assert [(r.leaves, r.value) for r in statements.recomputed(ways, made).collect()] == [(1, 5.0)]


def test_nothing_reported(spark):
    made = statements.graph(statements.with_measures(statements.periods(facts(spark, []))), lineage.RATIOS)
    assert made.nodes.count() == 0 and statements.walk(spark, made, made.nodes.select("issuer", "period", "concept")).count() == 0
