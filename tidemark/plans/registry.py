"""Queries over the driver's tables, each as Spark SQL and as the same question to DuckDB.

Period rows stand for an issuer (nation) and a quarter; their concepts are sums
over orders and line items (of decimals, so that no order of addition shows).  Dialect differences are confined to ``_spark``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import text
from tidemark.functions.ratios import BY_NAME, FACTORS, RATIOS, band_sql, interpolate_sql, reason_sql, value_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BASE = """
sums AS (SELECT n_name AS issuer, n_nationkey AS nk, CAST(year(o_orderdate) AS BIGINT) AS fy, CAST(quarter(o_orderdate) AS BIGINT) AS fq,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6))) AS DOUBLE) AS r, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 6))) AS DOUBLE) AS c,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) * l_tax AS DECIMAL(18, 6))) AS DOUBLE) AS t, sum(l_quantity) AS q
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         GROUP BY n_name, n_nationkey, year(o_orderdate), quarter(o_orderdate)),
facts AS (SELECT issuer, nk, fy, fq, fy * 4 + fq AS k, r AS revenue, 6 * c AS cost_of_revenue, 0.7e0 * r - 6 * c AS operating_income, c / 2 AS depreciation_amortization,
          t * 0.4e0 AS interest_expense, 0.7e0 * r - 6 * c - t * 0.4e0 AS pretax_income, t / 2 AS income_tax_expense, 0.7e0 * r - 6 * c - t * 0.9e0 AS net_income,
          4 * r AS total_assets, q * 1500 AS current_assets, q * 900 AS current_liabilities, c * 2 AS inventory, r / 5 AS accounts_receivable,
          c AS short_term_debt, 12 * c AS long_term_debt, q * 300 AS cash_and_equivalents, t AS short_term_investments, 1.4e0 * r AS total_equity,
          2.6e0 * r AS total_liabilities, 0.7e0 * r - 5.6e0 * c AS operating_cash_flow, c * 0.8e0 AS capex, r / 2 AS retained_earnings, 4 AS a, 91.25e0 AS days FROM sums),
d1 AS (SELECT *, short_term_debt + long_term_debt AS total_debt, operating_income AS ebit, operating_income + depreciation_amortization AS ebitda,
       operating_cash_flow - abs(capex) AS free_cash_flow, current_assets - current_liabilities AS working_capital, revenue - cost_of_revenue AS gross_profit,
       cash_and_equivalents + coalesce(short_term_investments, 0) AS cash_and_investments FROM facts),
periods AS (SELECT *, total_debt - cash_and_investments AS net_debt FROM d1)
"""
FLOWS = ["revenue", "cost_of_revenue", "operating_income", "depreciation_amortization", "interest_expense", "net_income", "operating_cash_flow", "capex", "ebitda", "free_cash_flow"]
STOCKS = ["total_assets", "total_debt", "net_debt", "total_equity", "cash_and_investments", "working_capital"]


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + body


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _long(name: str, rows: list[str], source: str = "periods", keys: str = "issuer, fy, fq, k") -> tuple[str, str]:
    """A common table expression with one row for each of ``rows`` (aliased columns): a union in DuckDB, one pass in Spark."""
    duck = f"{name} AS (" + _union([f"SELECT {keys}, {row} FROM {source}" for row in rows]) + ")"
    return duck, f"{name} AS (SELECT {keys}, inline(array(" + ", ".join(f"struct({row})" for row in rows) + f")) FROM {source})"


def _ratio_row(r, whole: str) -> str:
    up = "NULL" if r.higher_is_better is None else str(r.higher_is_better).lower()
    return f"'{r.name}' AS ratio, CAST({up} AS BOOLEAN) AS up, CAST({value_sql(r)} AS DOUBLE) AS value, {reason_sql(r, whole)} AS reason"


_DUCK_WHOLE, _SPARK_WHOLE = "format('{{:,.0f}}', CAST({0} AS DOUBLE))", "format_number(CAST({0} AS DOUBLE), 0)"
FACTS_LONG, _FACTS = _long("long", [f"'{c}' AS concept, CAST({c} AS DOUBLE) AS value" for c in ["revenue", "cost_of_revenue", "capex", "total_assets"]])
RATIO_LONG, _RATIOS = _long("rl", [_ratio_row(r, _DUCK_WHOLE) for r in RATIOS])[0], _long("rl", [_ratio_row(r, _SPARK_WHOLE) for r in RATIOS])[1]
SCORES, _SCORES = _long("sc", [f"'{n}' AS factor, {w}e0 AS weight, CAST({interpolate_sql('(' + value_sql(BY_NAME[n]) + ')', anchors)} AS DOUBLE) AS score" for n, w, anchors in FACTORS])
SHARES, _SHARES = _long("sh", [f"'{c}' AS line, CAST({c} / nullif(revenue, 0) * 100 AS DOUBLE) AS share" for c in ("cost_of_revenue", "depreciation_amortization", "interest_expense", "income_tax_expense")])
COMPOSITE = "co AS (SELECT issuer, fy, fq, k, sum(CASE WHEN score IS NOT NULL THEN weight * score END) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) AS composite, sum(CASE WHEN score IS NOT NULL THEN weight END) / sum(weight) AS coverage FROM sc GROUP BY issuer, fy, fq, k)"
WINDOW4 = "OVER (PARTITION BY issuer ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
TTM = "ttm AS (SELECT issuer, fy, fq, k, " + ", ".join(f"CASE WHEN count({c}) {WINDOW4} = 4 THEN sum(CAST({c} AS DECIMAL(20, 7))) {WINDOW4} END AS {c}" for c in FLOWS) + ", " + ", ".join(STOCKS) + " FROM periods)"
MARGIN = "mg AS (SELECT issuer, fy, fq, k, operating_income / nullif(revenue, 0) * 100 AS y, row_number() OVER (PARTITION BY issuer ORDER BY k) - 1 AS x FROM periods)"
_TOKENS = {"duck": f"unnest({text.tokens_duck('text')})", "spark": f"explode({text.tokens_spark('text')})"}
TOKENS = f"tok AS (SELECT doc_id, lang, source, {_TOKENS['duck']} AS w FROM documents)"
#: What bm25_topk searches for, with how often a word stands in the query; stop words of a query do not count.
QUERY_WORDS = {"erbl": 1, "hein": 2, "attion": 1, "qui": 1, "schen": 1}
# Saturation and length normalisation of BM25.
K1, B = 1.5, 0.75
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day FROM events)"


def _rounded(cols: list[str]) -> str:
    """Rounded as decimals, exactly half up in both engines; no measure has more than 7 decimal places."""
    return ", ".join(f"CAST(round(CAST({c} AS DECIMAL(20, 7)), 4) AS DOUBLE) AS {c}" for c in cols)


_IDF = "ln(1 + (total - {0} + 0.5e0) / ({0} + 0.5e0))"
_QUERY_VALUES = ", ".join(f"('{w}', {n})" for w, n in QUERY_WORDS.items())
BM25 = f"""{TOKENS}, tf AS (SELECT doc_id, w, count(*) AS f FROM tok GROUP BY doc_id, w), dl AS (SELECT d.doc_id, count(tok.w) AS n FROM documents d LEFT JOIN tok ON tok.doc_id = d.doc_id GROUP BY d.doc_id), st AS (SELECT avg(n) AS av, count(*) AS total FROM dl),
words(w, times) AS (VALUES {_QUERY_VALUES}), q AS (SELECT words.w, times, count(*) AS df FROM words JOIN tf ON tf.w = words.w GROUP BY words.w, times),
s AS (SELECT tf.doc_id, sum(times * {_IDF.format('df')} * f * {K1 + 1}e0 / (f + {K1}e0 * ({1 - B}e0 + {B}e0 * dl.n / av))) AS score FROM tf JOIN q ON tf.w = q.w JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st GROUP BY tf.doc_id)"""


def _bm25_spark() -> str:
    """Counts of the query's words beside each text, so nothing is dealt out: one pass for the statistics, one for the scores."""
    words = list(QUERY_WORDS)
    counts = ", ".join(f"size(filter(ws, x -> x = '{w}')) AS f{i}" for i, w in enumerate(words))
    base = f"b0 AS (SELECT doc_id, {text.tokens_spark('text')} AS ws FROM documents), b1 AS (SELECT doc_id, greatest(size(ws), 0) AS n, {counts} FROM b0)"
    stats = ", ".join(f"count_if(f{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN {n} * {_IDF.format(f'df{i}')} * f{i} * {K1 + 1}e0 / (f{i} + {K1}e0 * ({1 - B}e0 + {B}e0 * n / av)) ELSE 0e0 END" for i, n in enumerate(QUERY_WORDS.values()))
    return f"{base}, st AS (SELECT avg(n) AS av, count(*) AS total, {stats} FROM b1), s AS (SELECT * FROM (SELECT doc_id, {score} AS score FROM b1 CROSS JOIN st) z WHERE score > 0)"


SQL: dict[str, str] = {
    "facts_unpivot": _with("SELECT issuer, fy, fq, concept, round(value, 4) AS value FROM long", FACTS_LONG),
    "facts_dedup_priority": f"WITH {EVENTS} SELECT user_id, CAST(day AS VARCHAR(10)) AS day, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END, ts DESC, event_id) AS rn FROM ev) z WHERE rn = 1",
    "fiscal_calendar_modal": "SELECT issuer, mon, n FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY n DESC, mon) AS rn FROM (SELECT c_nationkey AS issuer, CAST(month(o_orderdate) AS BIGINT) AS mon, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, month(o_orderdate)) z) y WHERE rn = 1",
    "asof_carry_forward": f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ev), c AS (SELECT *, max(CASE WHEN event_type = 'view' THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM n) SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS viewed_value FROM c p LEFT JOIN c v ON v.user_id = p.user_id AND v.k = p.seen AND v.ts >= p.ts - INTERVAL '2' DAY WHERE p.event_type = 'purchase'",
    "period_pivot": _with("SELECT issuer, fy, " + ", ".join(f"round(max(CASE WHEN fq = {q} THEN revenue END), 4) AS q{q}" for q in (1, 2, 3, 4)) + " FROM periods GROUP BY issuer, fy"),
    "derived_measures": _with(f"SELECT issuer, fy, fq, {_rounded(['total_debt', 'net_debt', 'ebit', 'ebitda', 'free_cash_flow', 'working_capital', 'gross_profit', 'cash_and_investments'])} FROM periods"),
    "ttm_rolling": _with(f"SELECT issuer, fy, fq, {_rounded([*FLOWS, *STOCKS])} FROM ttm", TTM),
    "ttm_latest": _with(f"SELECT issuer, fy, fq, {_rounded(FLOWS)} FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY k DESC) AS rn FROM ttm) z WHERE rn = 1", TTM),
    "period_select_year": _with(f"SELECT issuer, fy, fq, {_rounded(FLOWS)} FROM (SELECT *, row_number() OVER (PARTITION BY issuer, fy ORDER BY k DESC) AS rn FROM periods) z WHERE rn = 1"),
    "ratios_all_long": _with("SELECT issuer, fy, fq, ratio, round(value, 4) AS value, reason FROM rl", RATIO_LONG),
    "ratio_guard_reasons": _with("SELECT ratio, reason, count(*) AS n FROM rl GROUP BY ratio, reason", RATIO_LONG),
    "pct_growth": _with("SELECT issuer, fy, fq, round((revenue - p1) / nullif(abs(p1), 0) * 100, 2) AS qoq, round((revenue - p4) / nullif(abs(p4), 0) * 100, 2) AS yoy FROM (SELECT *, lag(revenue) OVER (PARTITION BY issuer ORDER BY k) AS p1, lag(revenue, 4) OVER (PARTITION BY issuer ORDER BY k) AS p4 FROM periods) z"),
    "ols_trend": _with("SELECT issuer, round(regr_slope(y, x), 6) AS slope, round(CASE WHEN max(y) = min(y) THEN 0 ELSE regr_r2(y, x) END, 6) AS r2, round(stddev_pop(y) / nullif(abs(avg(y)), 0) * 100, 4) AS volatility FROM mg GROUP BY issuer", MARGIN),
    "trend_direction": _with("SELECT issuer, round(last - first, 4) AS change, CASE WHEN abs(last - first) < greatest(0.05e0 * abs(mean), 1e-9) THEN 'stable' WHEN last > first THEN 'improving' ELSE 'deteriorating' END AS direction FROM (SELECT issuer, max(CASE WHEN x = 0 THEN y END) AS first, max(CASE WHEN x = n THEN y END) AS last, avg(y) AS mean FROM (SELECT *, max(x) OVER (PARTITION BY issuer) AS n FROM mg) z GROUP BY issuer) w", MARGIN),
    "signed_streak": _with("SELECT issuer, x AS at, s * row_number() OVER (PARTITION BY issuer, run ORDER BY x) AS streak FROM (SELECT *, sum(CASE WHEN s = ps THEN 0 ELSE 1 END) OVER (PARTITION BY issuer ORDER BY x) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY issuer ORDER BY x) AS ps FROM (SELECT issuer, x, CAST(sign(y - lag(y) OVER (PARTITION BY issuer ORDER BY x)) AS BIGINT) AS s FROM mg) a WHERE s IS NOT NULL) b) c", MARGIN),
    "cagr": _with("SELECT issuer, round(power(last / nullif(first, 0), 1e0 / nullif(n - 1, 0)) - 1, 6) AS cagr FROM (SELECT issuer, count(*) AS n, max(CASE WHEN i = 1 THEN rev END) AS first, max(CASE WHEN j = 1 THEN rev END) AS last FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY fy) AS i, row_number() OVER (PARTITION BY issuer ORDER BY fy DESC) AS j FROM (SELECT issuer, fy, sum(revenue) AS rev FROM periods GROUP BY issuer, fy) a) b GROUP BY issuer) c"),
    "ratio_attribution": _with("SELECT issuer, fy, fq, round((n1 - n0) / d1 * 100, 4) AS numerator_effect, round(-n0 * (d1 - d0) / (d0 * d1) * 100, 4) AS denominator_effect, round((n1 / d1 - n0 / d0) * 100, 4) AS change FROM (SELECT issuer, fy, fq, operating_income AS n1, revenue AS d1, lag(operating_income) OVER (PARTITION BY issuer ORDER BY k) AS n0, lag(revenue) OVER (PARTITION BY issuer ORDER BY k) AS d0 FROM periods) z WHERE d0 <> 0 AND d1 <> 0"),
    "margin_bridge": _with("SELECT issuer, fy, fq, line, round(-(share - lag(share) OVER (PARTITION BY issuer, line ORDER BY k)), 4) AS effect FROM sh", SHARES),
    "factor_scores": _with("SELECT issuer, fy, fq, factor, weight, round(score, 4) AS score FROM sc", SCORES),
    "scorecard_composite": _with("SELECT issuer, fy, fq, round(composite, 4) AS composite, round(coverage, 4) AS coverage, CASE WHEN coverage >= 0.85 THEN 'high' WHEN coverage >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM co", SCORES, COMPOSITE),
    "rating_band": _with(f"SELECT issuer, fy, fq, {band_sql('composite')} AS band FROM co", SCORES, COMPOSITE),
    "strengths_weaknesses": _with("SELECT issuer, fy, fq, factor, CASE WHEN up <= 3 AND score >= 60 THEN 'strength' ELSE 'weakness' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY issuer, k ORDER BY score DESC, factor) AS up, row_number() OVER (PARTITION BY issuer, k ORDER BY score, factor) AS down FROM sc WHERE score IS NOT NULL) z WHERE (up <= 3 AND score >= 60) OR (down <= 3 AND score < 55)", SCORES),
    "altman_z": _with("SELECT issuer, fy, fq, round(z, 4) AS z, CASE WHEN z > 2.6 THEN 'safe' WHEN z >= 1.1 THEN 'grey' ELSE 'distress' END AS zone FROM (SELECT *, 6.56e0 * working_capital / total_assets + 3.26e0 * retained_earnings / total_assets + 6.72e0 * ebit * a / total_assets + 1.05e0 * total_equity / total_liabilities AS z FROM periods) w"),
    "issuer_compare_winner": _with("SELECT ratio, fy, fq, issuer AS winner, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY ratio, k ORDER BY CASE WHEN up THEN -round(value, 4) ELSE round(value, 4) END, issuer) AS rn FROM rl WHERE up IS NOT NULL AND value IS NOT NULL) z WHERE rn = 1", RATIO_LONG),
    "scorecard_rank": _with("SELECT issuer, fy, fq, rank() OVER (PARTITION BY k ORDER BY round(composite, 6) DESC) AS place FROM co", SCORES, COMPOSITE),
    "coverage_report": _with("SELECT issuer, count(*) AS n, CAST(sum(CASE WHEN reason = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS available, CAST(sum(CASE WHEN reason <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM rl GROUP BY issuer", RATIO_LONG),
    "token_estimate": r"SELECT doc_id, CAST(CASE WHEN w = '' THEN 1 ELSE floor((length(w) - length(replace(w, ' ', '')) + 1) * 1.33e0) + 1 END AS BIGINT) AS tokens FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')) AS w FROM documents) z",
    "tokenize_stats": f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_terms FROM tok GROUP BY doc_id",
    "term_frequencies": f"WITH {TOKENS} SELECT w, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY w",
    "content_hash_dedup": "SELECT sha1(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha1(coalesce(text, ''))",
    "metadata_filter": "SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('en', 'de') AND n_chars >= 500",
    "bm25_topk": "WITH " + BM25 + " SELECT doc_id, round(score, 5) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 40",
    "upsert_merge": f"WITH {EVENTS}, r AS (SELECT user_id, event_type, value, ts, event_id % 2 AS side, row_number() OVER (PARTITION BY event_id % 2, user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM ev), t AS (SELECT * FROM r WHERE side = 0 AND rn = 1), i AS (SELECT * FROM r WHERE side = 1 AND rn = 1) SELECT coalesce(i.user_id, t.user_id) AS user_id, coalesce(i.event_type, t.event_type) AS event_type, coalesce(i.value, t.value) AS value, CASE WHEN t.user_id IS NULL THEN 'inserted' WHEN i.user_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM t FULL JOIN i ON i.user_id = t.user_id AND i.event_type = t.event_type",
    "stale_antijoin": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "embedding_inventory": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "histogram_buckets": "SELECT event_type, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cumulative FROM events CROSS JOIN (SELECT 1e0 AS le UNION ALL SELECT 5e0 UNION ALL SELECT 10e0 UNION ALL SELECT 50e0 UNION ALL SELECT 1e9) b GROUP BY event_type, le",
    "counter_by_label": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "percentile_nearest_rank": "SELECT event_type, max(CASE WHEN rn = p50 THEN value END) AS p50, max(CASE WHEN rn = p95 THEN value END) AS p95 FROM (SELECT *, CAST(round_even((n - 1) * 0.5e0, 0) AS BIGINT) + 1 AS p50, CAST(round_even((n - 1) * 0.95e0, 0) AS BIGINT) + 1 AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) z) y GROUP BY event_type",
    "slice_grouping_sets": "SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "reciprocal_rank": "WITH r AS (SELECT l.doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rk, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT source, coalesce(round(1e0 / min(CASE WHEN quality = 1 THEN rk END), 6), 0) AS mrr, round(sum(CASE WHEN rk <= 8 AND quality = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN rk <= 8 THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS precision_at_8, round(sum(CASE WHEN rk <= 8 AND quality = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(quality) AS DOUBLE), 0), 6) AS recall_at_8, round(sum(CASE WHEN rk <= 8 AND quality = 1 THEN 1e0 / log2(rk + 1) ELSE 0e0 END), 6) AS dcg_at_8 FROM r GROUP BY source",
}


#: DuckDB's text and Spark's, where the plans differ or the words do.
_SPELLED = [(RATIO_LONG, _RATIOS), (SCORES, _SCORES), (FACTS_LONG, _FACTS), (SHARES, _SHARES), (BM25, _bm25_spark()), (_TOKENS["duck"], _TOKENS["spark"]), (", 'g')", ")"), ("round_even(", "bround(")]


def _spark(sql: str) -> str:
    """DuckDB's spelling to Spark's."""
    for duck, ours in _SPELLED:
        sql = sql.replace(duck, ours)
    return text.printed_spark(sql)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables it names, which are common table expressions, so that no view of the session changes."""
    ctes = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", sql))
    body = sql.lstrip()
    if not ctes:
        return spark.sql(body)
    return spark.sql(f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}")


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, _spark(SQL[name]))

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
