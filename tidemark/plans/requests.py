"""A request for each order: a metric of the customer's nation in some period, wrong names and periods included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ratios import RATIOS, reason_sql, value_sql
from tidemark.operators import requests

from . import registry
from .registry import _with

PERIODS = ["latest", None, "Q3-1996", "q1 1995", "FY1997", "TTM", "TTM1998", "FY2050", "soon", "Most Recent", "1996", "Q9 1996"]
METRICS = ["Debt to EBITDA", "net_margin", "Current Ratio", "REVENUE", "free cash flow", "growth of sales", "days-inventory"]
CONCEPTS = ["revenue", "free_cash_flow", "total_debt", "total_assets"]
#: Flows are summed over four quarters; all else is the last quarter's.  A trailing year is a whole year: factor 1, 365 days.
SUMMED = ["revenue", "cost_of_revenue", "operating_income", "depreciation_amortization", "interest_expense", "pretax_income", "income_tax_expense", "net_income", "operating_cash_flow", "capex", "ebit", "ebitda", "free_cash_flow", "gross_profit"]
LAST = ["total_assets", "current_assets", "current_liabilities", "inventory", "accounts_receivable", "short_term_debt", "long_term_debt", "cash_and_equivalents", "total_equity", "total_liabilities", "total_debt", "net_debt", "cash_and_investments", "working_capital"]
_W = "OVER (PARTITION BY issuer ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
TRAILING = "tw AS (SELECT * FROM (SELECT issuer, k, 1 AS a, 365e0 AS days, count(*) " + _W + " AS n, row_number() OVER (PARTITION BY issuer ORDER BY k DESC) AS rn, " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(20, 7))) {_W} AS DOUBLE) AS {c}" for c in SUMMED) + ", " + ", ".join(LAST) + " FROM periods) z WHERE rn = 1 AND n = 4)"


def _rows(whole: str) -> list[str]:
    return [f"'{r.name}' AS metric, CAST({value_sql(r)} AS DOUBLE) AS value, {reason_sql(r, whole)} AS reason" for r in RATIOS] + [f"'{c}' AS metric, CAST({c} AS DOUBLE) AS value, 'ok' AS reason" for c in CONCEPTS]


def _long(name: str, source: str) -> tuple[str, str]:
    keys = "issuer, k"
    duck = f"{name} AS (" + " UNION ALL ".join(f"SELECT {keys}, {row} FROM {source}" for row in _rows(registry._DUCK_WHOLE)) + ")"
    return duck, f"{name} AS (SELECT {keys}, inline(array(" + ", ".join(f"struct({row})" for row in _rows(registry._SPARK_WHOLE)) + f")) FROM {source})"


def _choose(values: list, n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} = {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


ASKED = f"SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 41 = 0 THEN 'ELSEWHERE' ELSE n_name END AS issuer, {_choose(PERIODS, f'o_orderkey % {len(PERIODS)}')} AS period, {_choose(METRICS, f'o_custkey % {len(METRICS)}')} AS metric FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def metric_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to every request, or what is wrong with it."""

    def sql(text: str) -> DataFrame:
        return registry.run_sql(spark, sf_dir, registry._spark(text))

    periods = sql(_with("SELECT issuer, k, fy, 'Q' || fq || fy AS key FROM periods"))
    values = sql(_with("SELECT * FROM ql", _long("ql", "periods")[1]))
    trailing = sql(_with("SELECT * FROM yl", TRAILING, _long("yl", "tw")[1]))
    known = spark.createDataFrame([(r.name,) for r in RATIOS] + [(c,) for c in CONCEPTS], "metric string")
    out = requests.answer(sql(ASKED), periods, values, trailing, known)
    return out.withColumn("value", F.round("value", 4))


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"('{n}')" for n in [*(r.name for r in RATIOS), *CONCEPTS])
    body = """
SELECT request_id, issuer, metric, period, CASE WHEN status = 'ok' THEN round(value, 4) END AS value, status,
       status = 'ok' AND (norm IN ('LATEST', 'CURRENT') OR upper(period) = norm OR (norm = 'TTM' AND period LIKE 'TTM%')) AS period_met
FROM (SELECT c.request_id, c.issuer, c.metric, norm, CASE WHEN ttm THEN 'TTM' || p.fy ELSE 'Q' || p.fq || p.fy END AS period, CASE WHEN ttm THEN yl.value ELSE ql.value END AS value,
             CASE WHEN c.issuer = 'ELSEWHERE' THEN 'unknown issuer' WHEN c.k IS NULL THEN 'unknown period' WHEN c.metric IS NULL THEN 'unknown metric' WHEN ttm AND yl.value IS NULL THEN coalesce(yl.reason, 'no such value') WHEN NOT ttm AND ql.value IS NULL THEN coalesce(ql.reason, 'no such value') ELSE 'ok' END AS status
      FROM c LEFT JOIN periods p ON p.issuer = c.issuer AND p.k = c.k LEFT JOIN ql ON ql.issuer = c.issuer AND ql.k = c.k AND ql.metric = c.metric LEFT JOIN yl ON yl.issuer = c.issuer AND yl.metric = c.metric) z"""
    asked = f"asked AS ({ASKED})"
    norm = "r AS (SELECT request_id, issuer, period, upper(replace(replace(replace(coalesce(period, ''), '-', ''), ' ', ''), '_', '')) AS norm, replace(replace(lower(metric), ' ', '_'), '-', '_') AS name FROM asked)"
    last = "lk AS (SELECT issuer, max(k) AS k FROM periods GROUP BY issuer)"
    exact = "xk AS (SELECT issuer, k, 'Q' || fq || fy AS key FROM periods)"
    year = "yk AS (SELECT issuer, CAST(fy AS VARCHAR) AS y, max(k) AS k FROM periods GROUP BY issuer, fy)"
    known = f"kn(metric) AS (VALUES {names})"
    chosen = "c AS (SELECT r.request_id, r.issuer, norm, kn.metric, norm LIKE 'TTM%' AS ttm, CASE WHEN norm IN ('', 'LATEST', 'CURRENT', 'MOSTRECENT') OR norm LIKE 'TTM%' THEN lk.k ELSE coalesce(xk.k, yk.k) END AS k FROM r LEFT JOIN kn ON kn.metric = r.name LEFT JOIN lk ON lk.issuer = r.issuer LEFT JOIN xk ON xk.issuer = r.issuer AND xk.key = norm LEFT JOIN yk ON yk.issuer = r.issuer AND length(regexp_replace(norm, '[^0-9]', '', 'g')) >= 4 AND yk.y = right(regexp_replace(norm, '[^0-9]', '', 'g'), 4))"
    return {"metric_requests": _with(body, _long("ql", "periods")[0], TRAILING, _long("yl", "tw")[0], asked, norm, last, exact, year, known, chosen)}


def queries() -> dict:
    return {"metric_requests": metric_requests}
