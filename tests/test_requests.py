"""Requests in bulk: names of periods and metrics, and what is wrong with a request."""

from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidemark.operators import requests
from tidemark.plans import requests as plan

SF = "/root/testdata/sf0.001"


def test_matches_oracle(spark):
    con = connect(SF)
    sql = plan.oracle_sql()["metric_requests"]
    assert assert_same(plan.metric_requests(spark, SF), con, sql) > 1000
    seen = {r[0] for r in con.execute(f"SELECT DISTINCT status FROM ({sql})").fetchall()}
    assert {"ok", "unknown issuer", "unknown period", "unknown metric"} <= seen


def test_answers(spark):
    periods = spark.createDataFrame([("A", 1, 2023, "Q3 2023".replace(" ", "")), ("A", 2, 2023, "Q42023"), ("A", 3, 2024, "Q12024"), ("B", 3, 2024, "Q12024")], "issuer string, k long, fy long, key string")
    values = spark.createDataFrame([("A", k, "net_margin", float(k), "ok") for k in (1, 2)] + [("A", 3, "net_margin", None, "division by zero"), ("B", 3, "net_margin", 9.0, "ok")], "issuer string, k long, metric string, value double, reason string")
    trailing = spark.createDataFrame([("A", "net_margin", 77.0, "ok")], "issuer string, metric string, value double, reason string")
    known = spark.createDataFrame([("net_margin",), ("revenue",)], "metric string")
    asked = [
        ("A", "q4-2023", "Net Margin", 2.0, "ok", True), ("A", "FY2023", "NET-MARGIN", 2.0, "ok", False), ("A", "2023", "net_margin", 2.0, "ok", False), ("A", None, "net margin", None, "division by zero", False),
        ("A", "current", " net margin ", None, "division by zero", False), ("B", "latest", "net margin", 9.0, "ok", True), ("A", "TTM", "net margin", 77.0, "ok", True), ("A", "ttm 2024", "net margin", 77.0, "ok", True),
        ("B", "TTM", "net margin", None, "no such value", False), ("A", "Q1 2031", "net margin", None, "unknown period", False), ("A", "some day", "net margin", None, "unknown period", False),
        ("C", "latest", "net margin", None, "unknown issuer", False), (None, "latest", "net margin", None, "unknown issuer", False), ("A", "Q3 2023", "sales", None, "unknown metric", False), ("A", "Q3 2023", None, None, "unknown metric", False), ("A", "Q3 2023", "revenue", None, "no such value", False),
    ]
    table = spark.createDataFrame([(i, a[0], a[1], a[2]) for i, a in enumerate(asked)], "request_id int, issuer string, period string, metric string")
    got = {r.request_id: (r.value, r.status, r.period_met) for r in requests.answer(table, periods, values, trailing, known).collect()}
    assert got == {i: a[3:] for i, a in enumerate(asked)}
    assert requests.answer(table.filter(F.col("request_id") < 0), periods, values, trailing, known).count() == 0
