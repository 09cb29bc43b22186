"""Fact normalisation against DuckDB, and the known results of small payloads."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidemark.functions import taxonomy
from tidemark.operators import normalise
from tidemark.plans import normalisation
from tidemark.sources import companyfacts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(normalisation.queries()))
def test_matches_oracle(spark, name):
    n = oracle.assert_same(normalisation.queries()[name](spark, SF), oracle.connect(SF), normalisation.oracle_sql()[name])
    assert n > 20


def test_every_source_occurs(spark):
    got = {r.source.split("-from-2")[0].split("-from-19")[0] for r in normalisation.carry_instants(spark, SF).select("source").distinct().collect()}
    assert {"sec-edgar-xbrl", "derived-q4", "derived-from-ytd (6M less Q1)", "derived-from-ytd (9M less YTD 6M)", "derived-from-ytd (9M less Q1 + Q2)", "carried-forward"} <= got


def _facts(spark, **tags):
    body = {"facts": {"us-gaap": {t: {"units": {"USD": e}} for t, e in tags.items()}}}
    rows = companyfacts.entries(spark.createDataFrame([(1, json.dumps(body))], "company int, body string"), "company")
    return {(r.concept, r.fiscal_year, r.fiscal_period): r for r in normalise.normalise(rows).collect()}


def _span(start, end, val, filed="2025-02-01", **more):
    return {"start": start, "end": end, "val": val, "filed": filed, "form": "10-Q", **more}


QUARTERS = [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30"), ("2024-07-01", "2024-09-30")]


def test_fourth_quarter(spark):
    got = _facts(spark, Revenues=[_span(a, b, v) for (a, b), v in zip(QUARTERS, (100, 110, 120), strict=True)] + [_span("2024-01-01", "2024-12-31", 470)])
    assert (got["revenue", 2024, "Q4"].value, got["revenue", 2024, "Q4"].source) == (140.0, "derived-q4")
    assert got["revenue", 2024, "Q4"].period_start == date(2024, 10, 1)


def test_year_to_date(spark):
    got = _facts(spark, PaymentsToAcquirePropertyPlantAndEquipment=[_span("2024-01-01", "2024-03-31", 100), _span("2024-01-01", "2024-06-30", 210)])
    assert got["capex", 2024, "Q2"].value == 110.0 and ("capex", 2024, "Q3") not in got


def test_restatement_and_trust(spark):
    first, later = _span(*QUARTERS[0], 100), _span(*QUARTERS[0], 105, "2025-06-01")
    assert _facts(spark, Revenues=[first, later])["revenue", 2024, "Q1"].value == 105.0
    assert _facts(spark, Revenues=[later], RevenueFromContractWithCustomerExcludingAssessedTax=[first])["revenue", 2024, "Q1"].value == 100.0


def test_comparatives_are_labelled_by_their_dates(spark):
    got = _facts(spark, Revenues=[_span("2023-01-01", "2023-12-31", 100, fy=2025), _span("2025-01-01", "2025-12-31", 130, fy=2025)])
    assert {k[1]: r.value for k, r in got.items()} == {2023: 100.0, 2025: 130.0}


def test_calendar_labels(spark):
    rows = [(6, 0, date(2025, 9, 30), 2026, "Q1"), (1, -1, date(2024, 11, 2), 2024, "Q3"), (9, 0, date(2022, 10, 1), 2022, "Q4"), (9, 0, date(2022, 12, 31), 2023, "Q1"), (12, 0, date(2024, 8, 15), 2024, None)]
    df = spark.createDataFrame(rows, "m int, o int, e date, y int, p string")
    got = df.select("*", (F.year(normalise.fiscal_year_end(df.e, df.m)) + df.o).alias("gy"), normalise.fiscal_period(df.e, df.m, F.lit(False)).alias("gp")).collect()
    for r in got:
        assert r.gy == r.y and (r.gp == r.p or r.p is None), r


def test_dates_and_spans(spark):
    df = spark.createDataFrame([("2024-01-01T00:00",), ("2024-13-01",), ("x",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(normalise.parse_date(df.s)).collect()] == [date(2024, 1, 1), None, None, None, None]
    spans = [(date(2024, 1, 1), date(2024, 3, 31), "quarter"), (date(2024, 1, 1), date(2024, 12, 31), "annual"), (date(2024, 1, 1), date(2024, 6, 30), "ytd"), (date(2024, 1, 1), date(2024, 1, 20), None), (None, date(2024, 1, 20), "instant")]
    df = spark.createDataFrame(spans, "a date, b date, k string")
    assert all(r.k == r.g for r in df.select("k", normalise.classify(df.a, df.b).alias("g")).collect())


def test_nothing_usable(spark):
    assert _facts(spark) == {}
    assert _facts(spark, Revenues=[{"end": "2024-03-31", "val": 1}, _span("x", "y", 1), {"start": "2024-01-01", "end": "2024-03-31"}]) == {}
    assert _facts(spark, Assets=[_span(*QUARTERS[0], 5)]) == {}


def test_taxonomy():
    assert taxonomy.resolve("Revenues") == ("revenue", 2) and taxonomy.resolve("None") is None
    assert taxonomy.is_flow("ebitda") and taxonomy.is_flow("capex") and not taxonomy.is_flow("total_assets")
    assert len({t[0] for t in taxonomy.TAGS}) == len(taxonomy.TAGS) < 200
