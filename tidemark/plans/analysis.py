"""Series comparison, attribution, selection, set operations, sinks, evaluation and lineage as SQL.

A text is DuckDB's; ``registry._spark`` and the pairs in SPARK give Spark's where
the plans or words differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import text
from tidemark.functions.ratios import RATIOS, display_spark, display_sql, inputs, unit, value_sql

from . import registry
from .registry import COMPOSITE, EVENTS, RATIO_LONG, SCORES, TTM, _long, _with

_TWO_INPUT = [r for r in RATIOS if len(inputs(r)) == 2]
# A trend is stable below this share of the mean; expense lines of a margin; headline concepts.
STABLE_SHARE = 0.05
MARGIN_LINES = ["cost_of_revenue", "rd_expense", "sga_expense", "depreciation_amortization"]
_HEADLINE = ["revenue", "gross_profit", "operating_income", "ebitda", "net_income", "interest_expense", "operating_cash_flow", "capex", "free_cash_flow"]

EFFECTS, _EFFECTS = _long("eff", [f"'{r.name}' AS ratio, '{inputs(r)[0]}' AS numerator, '{inputs(r)[1]}' AS denominator, CAST({inputs(r)[0]} AS DOUBLE) AS num, CAST({inputs(r)[1]} AS DOUBLE) AS den, CAST({value_sql(r)} AS DOUBLE) AS value, {100 if unit(r) == '%' else 1} AS scale" for r in _TWO_INPUT])
LINES, _LINES = _long("ln", [f"'{c}' AS line, CAST({c if c in ('cost_of_revenue', 'depreciation_amortization') else 'NULL'} AS DOUBLE) / nullif(revenue, 0) * 100 AS share" for c in MARGIN_LINES])
SHOWN, _SHOWN = (_long("disp", [f"'{r.name}' AS ratio, {shown(f'CAST({value_sql(r)} AS DOUBLE)', unit(r))} AS display" for r in RATIOS])[i] for i, shown in enumerate((display_sql, display_spark)))
CONCEPTS, _CONCEPTS = _long("cl", [f"'{c}' AS concept, CAST({c} AS DOUBLE) AS value" for c in ("revenue", "operating_income", "total_assets", "total_debt")])
HAVE = ["revenue", "capex", "total_assets", "inventory", "goodwill", "rd_expense"]
_KNOWN = {"goodwill": "CAST(NULL AS DOUBLE)", "rd_expense": "CAST(NULL AS DOUBLE)"}


def _trend(source: str, key: str, up: str, words: tuple[str, str]) -> str:
    """Endpoints, slope, fit, volatility, streak and direction of each series of ``source`` (issuer, key, k, value); under two points give none."""
    series = f"(SELECT *, row_number() OVER (PARTITION BY issuer, {key} ORDER BY k) - 1 AS x, count(*) OVER (PARTITION BY issuer, {key}) AS n FROM {source} WHERE value IS NOT NULL)"
    moves = f"pt AS (SELECT issuer, {key}, {up} AS up, x, n, value AS y, CAST(sign(round(value - lag(value) OVER (PARTITION BY issuer, {key} ORDER BY x), 9)) AS BIGINT) AS s FROM {series} z)"
    # the streak is the number of last moves of one sign: those after the last move of another
    last = f"ls AS (SELECT *, arg_max(s, x) OVER (PARTITION BY issuer, {key}) AS final FROM pt)"
    agg = f"ag AS (SELECT issuer, {key}, up, n, arg_min(y, x) AS first, arg_max(y, x) AS last, avg(y) AS mean, regr_slope(y, x) AS slope, CASE WHEN max(y) - min(y) <= 1e-9 * abs(max(y)) THEN 0 ELSE regr_r2(y, x) END AS r2, stddev_pop(y) / nullif(abs(avg(y)), 0) * 100 AS vol, max(final) * (n - 1 - coalesce(max(CASE WHEN s IS NOT NULL AND s <> final THEN x END), 0)) AS streak FROM ls WHERE n >= 2 GROUP BY issuer, {key}, up, n)"
    direction = f"CASE WHEN abs(last - first) < greatest({STABLE_SHARE}e0 * abs(mean), 1e-9) THEN 'stable' WHEN up IS NULL THEN 'mixed' WHEN (last > first) = up THEN '{words[0]}' ELSE '{words[1]}' END"
    return f"{moves}, {last}, {agg} SELECT issuer, {key}, n, round(last - first, 4) AS total_change, round((last - first) / nullif(abs(first), 0) * 100, 3) AS percent_change, round(slope, 4) AS slope, round(r2, 4) AS r_squared, round(vol, 3) AS volatility, streak AS consecutive_moves, {direction} AS direction, CASE WHEN r2 < 0.4e0 THEN 'low fit' ELSE '' END AS note FROM ag"


def _key(fy: str = "fy", fq: str = "fq") -> str:
    return f"'Q' || {fq} || {fy}"


SQL: dict[str, str] = {
    "lead_next": _with("SELECT issuer, fy, fq, round(revenue, 2) AS revenue, round(lead(revenue) OVER (PARTITION BY issuer ORDER BY k), 2) AS next_revenue FROM periods"),
    "first_last_nonnull": f"WITH {EVENTS}, v AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM v) SELECT user_id, arg_min(paid, at) FILTER (WHERE paid IS NOT NULL) AS first_paid, arg_max(paid, at) FILTER (WHERE paid IS NOT NULL) AS last_paid FROM o GROUP BY user_id".replace("AS at ", "AS spot ").replace("(paid, at)", "(paid, spot)"),
    "last_n_per_series": _with("SELECT issuer, fy, fq, round(revenue, 2) AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY k DESC) AS rn FROM periods) z WHERE rn <= 8"),
    "latest_by_day": f"WITH {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS spot FROM ev) SELECT user_id, CAST(day AS VARCHAR(10)) AS day, count(*) AS n, bool_or(event_type = 'error') AS any_error, arg_max(value, spot) AS last_value, max(value) AS most FROM o GROUP BY user_id, day",
    "set_operations": "SELECT 'without_orders' AS what, c_custkey AS id FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) a UNION ALL SELECT 'nations_of_both', n FROM (SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier) b",
    "dissimilar_pairs": "WITH m AS (SELECT r_name AS sector, n_name AS name, round(avg(c_acctbal), 4) AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name) SELECT sector, a_name, b_name, round(gap, 3) AS gap FROM (SELECT a.sector, a.name AS a_name, b.name AS b_name, abs(a.profile - b.profile) AS gap, row_number() OVER (PARTITION BY a.sector ORDER BY abs(a.profile - b.profile) DESC, a.name, b.name) AS rn FROM m a JOIN m b ON a.sector = b.sector AND a.name < b.name AND a.profile <> b.profile) z WHERE rn = 1",
    "nearest_match": "SELECT s_suppkey, c_custkey, round(gap, 2) AS gap FROM (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS rn FROM supplier JOIN customer ON s_nationkey = c_nationkey) z WHERE rn = 1",
    "ordered_distinct": f"WITH {EVENTS}, f AS (SELECT user_id, event_type, min(ts) AS first FROM ev GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM f GROUP BY user_id",
    "snapshot_scan": "SELECT o_orderkey AS chunk_id, o_orderpriority AS item, c_name AS company, n_name AS ticker, r_name AS sector, l.n AS parts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey",
    "snapshot_version": "SELECT count(*) AS n, coalesce(max(doc_id), 0) AS newest FROM documents",
    "concept_trend": _with(_trend("cl", "concept", "true", ("increasing", "decreasing")), CONCEPTS).replace("\npt AS", ",\npt AS", 1),
    "ratio_trends": _with(_trend("rl", "ratio", "up", ("improving", "deteriorating")), RATIO_LONG).replace("\npt AS", ",\npt AS", 1),
    "compare_periods": _with("SELECT issuer, ratio, fy, fq, round(old, 4) AS from_value, round(value, 4) AS to_value, round(value - old, 4) AS absolute_change, round((value - old) / nullif(abs(old), 0) * 100, 3) AS percent_change, CASE WHEN value - old IS NULL OR (up IS NULL AND value = old) THEN 'stable' WHEN up IS NULL THEN 'mixed' WHEN abs(value - old) < 1e-12 THEN 'stable' WHEN (value > old) = up THEN 'improving' ELSE 'deteriorating' END AS direction FROM (SELECT *, lag(value, 4) OVER (PARTITION BY issuer, ratio ORDER BY k) AS old, row_number() OVER (PARTITION BY issuer, ratio ORDER BY k DESC) AS rn FROM rl) z WHERE rn <= 4", RATIO_LONG),
    "attribution_all": _with("SELECT issuer, ratio, fy, fq, round(value - v0, 4) AS total_change, round(ne, 4) AS numerator_effect, round(de, 4) AS denominator_effect, round(ne / nullif(round(value - v0, 6), 0) * 100, 0) AS numerator_share, abs(value - v0 - ne - de) > greatest(abs(value - v0) * 1e-6, 1e-9) AND abs(value - v0) > 1e-6 AS residual FROM (SELECT *, (num - n0) / den * scale AS ne, -n0 * (den - d0) / (d0 * den) * scale AS de FROM (SELECT *, lag(num) OVER w AS n0, lag(den) OVER w AS d0, lag(value) OVER w AS v0 FROM eff WINDOW w AS (PARTITION BY issuer, ratio ORDER BY k)) a WHERE d0 <> 0 AND den <> 0 AND v0 IS NOT NULL AND value IS NOT NULL) z WHERE ratio IN ('operating_margin', 'gross_margin', 'debt_to_equity', 'debt_to_ebitda')", EFFECTS),
    "margin_attribution": _with("SELECT issuer, fy, fq, line, round(effect, 4) AS effect_pp, row_number() OVER (PARTITION BY issuer, k ORDER BY abs(round(effect, 6)) DESC, line) AS place FROM e2", LINES, "e1 AS (SELECT issuer, fy, fq, k, line, -(share - lag(share) OVER (PARTITION BY issuer, line ORDER BY k)) AS effect FROM ln)", "mv AS (SELECT issuer, fy, fq, k, operating_income / revenue * 100 - lag(operating_income / revenue * 100) OVER (PARTITION BY issuer ORDER BY k) AS total FROM periods)", "e2 AS (SELECT issuer, fy, fq, k, line, effect FROM e1 WHERE effect IS NOT NULL UNION ALL SELECT mv.issuer, mv.fy, mv.fq, mv.k, 'other / untagged items', total - s FROM mv JOIN (SELECT issuer, k, sum(effect) AS s FROM e1 WHERE effect IS NOT NULL GROUP BY issuer, k) t ON t.issuer = mv.issuer AND t.k = mv.k)"),
    "prior_period": _with(f"SELECT issuer, {_key()} AS period, coalesce(lag({_key()}) OVER (PARTITION BY issuer ORDER BY k), first_value({_key()}) OVER (PARTITION BY issuer ORDER BY k)) AS prior FROM periods"),
    "headline_table": _with("SELECT issuer, 'Q' || fq || fy AS period, " + ", ".join(f"round({c}, 2) AS {c}" for c in _HEADLINE) + " FROM periods UNION ALL SELECT issuer, 'TTM' || fy, " + ", ".join("round(CAST(" + ("revenue - cost_of_revenue" if c == "gross_profit" else c) + " AS DOUBLE), 2)" for c in _HEADLINE) + " FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY k DESC) AS rn FROM ttm) z WHERE rn = 1", TTM),
    "period_select": _with("SELECT spec, s.issuer, CASE WHEN norm LIKE 'TTM%' THEN 'TTM' || p.fy ELSE 'Q' || p.fq || p.fy END AS period FROM (SELECT spec, norm, issuer, max(CASE WHEN norm IN ('', 'LATEST', 'CURRENT', 'MOSTRECENT') OR norm LIKE 'TTM%' OR 'Q' || fq || fy = norm OR (norm LIKE 'FY%' AND CAST(fy AS VARCHAR(4)) = right(norm, 4)) THEN k END) AS k FROM periods CROSS JOIN (SELECT spec, upper(replace(replace(replace(coalesce(spec, ''), '-', ''), ' ', ''), '_', '')) AS norm FROM specs) x GROUP BY spec, norm, issuer) s LEFT JOIN periods p ON p.issuer = s.issuer AND p.k = s.k", "specs(spec) AS (VALUES ('latest'), (NULL), ('FY1996'), ('Q3-1997'), ('TTM'), ('TTM1997'), ('FY2050'), ('most_recent'), ('q1 1995'))"),
    "coverage_lists": _with("SELECT issuer, " + " || ".join(f"CASE WHEN {_KNOWN.get(c, c)} IS NOT NULL THEN '{c},' ELSE '' END" for c in HAVE) + " AS available, " + " || ".join(f"CASE WHEN {_KNOWN.get(c, c)} IS NULL THEN '{c},' ELSE '' END" for c in HAVE) + " AS missing FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY k DESC) AS rn FROM periods) z WHERE rn = 1"),
    "scorecard_pivot_rank": _with("SELECT p.*, rank() OVER (ORDER BY p.composite DESC) AS place FROM (SELECT sc.issuer, " + ", ".join(f"round(max(CASE WHEN factor = '{n}' THEN score END), 3) AS {n}" for n in ("debt_to_ebitda", "debt_to_capital", "current_ratio", "ebitda_margin", "return_on_assets")) + ", round(max(co.composite), 4) AS composite FROM sc JOIN co ON co.issuer = sc.issuer AND co.k = sc.k JOIN (SELECT issuer, max(k) AS k FROM periods GROUP BY issuer) l ON l.issuer = sc.issuer AND l.k = sc.k GROUP BY sc.issuer) p", SCORES, COMPOSITE),
    "direction_vote": _with("SELECT issuer, round(sum(vote), 4) AS score, CASE WHEN sum(vote) >= 1 THEN 'improving' WHEN sum(vote) <= -1 THEN 'deteriorating' WHEN abs(sum(vote)) < 0.5e0 THEN 'stable' ELSE 'mixed' END AS direction FROM (SELECT issuer, ratio, CASE ratio WHEN 'debt_to_ebitda' THEN 1.5e0 WHEN 'ebitda_interest_coverage' THEN 1.5e0 ELSE 1e0 END * CASE WHEN round(d, 9) = 0 THEN 0 WHEN (d > 0) = up THEN 1 ELSE -1 END AS vote FROM (SELECT issuer, ratio, up, arg_max(value, k) - arg_min(value, k) AS d FROM rl WHERE ratio IN ('debt_to_ebitda', 'ebitda_interest_coverage', 'operating_margin', 'current_ratio') AND value IS NOT NULL GROUP BY issuer, ratio, up) a) b GROUP BY issuer", RATIO_LONG),
    "ratio_display": _with("SELECT issuer, fy, fq, ratio, display FROM disp", SHOWN),
    "money_format": "SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN '$' || printf('%.2f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN '$' || printf('%.1f', v / 1e6) || 'M' ELSE '$' || printf('%.0f', v) END AS money FROM (SELECT o_orderkey, floor(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1013 ELSE 1000003 END AS v FROM orders) z".replace("printf('%.0f', v)", "CAST(CAST(v AS BIGINT) AS VARCHAR(20))"),
    "retrieval_metrics": "WITH r AS (SELECT source, d.doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rk FROM documents d JOIN labels l ON d.doc_id = l.doc_id), m AS (SELECT source, count(*) AS n, sum(1 - quality) AS rel, sum(CASE WHEN rk <= 8 THEN 1 - quality ELSE 0 END) AS hits, sum(CASE WHEN rk <= 8 THEN (1 - quality) / log2(rk + 1) ELSE 0e0 END) AS dcg, min(CASE WHEN quality = 0 THEN rk END) AS first FROM r GROUP BY source), i AS (SELECT rk AS j, sum(1e0 / log2(rk + 1)) OVER (ORDER BY rk) AS idcg FROM (SELECT DISTINCT rk FROM r WHERE rk <= 8) x) SELECT source, CAST(hits AS DOUBLE) / nullif(rel, 0) AS recall_at_8, CAST(hits AS DOUBLE) / nullif(rel, 0) / least(1e0, 8e0 / nullif(rel, 0)) AS recall_normalised, coalesce(CAST(hits AS DOUBLE) / nullif(least(n, 8), 0), 0) AS precision_at_8, coalesce(1e0 / first, 0e0) AS reciprocal_rank, round(CASE WHEN rel > 0 THEN dcg / idcg END, 6) AS ndcg_at_8 FROM m LEFT JOIN i ON i.j = least(m.rel, 8)",
    "set_f1": f"WITH {EVENTS}, s AS (SELECT DISTINCT user_id, event_type, CAST(event_id % 2 AS BIGINT) AS side FROM ev), c AS (SELECT user_id, count(CASE WHEN n = 2 THEN 1 END) AS common, count(CASE WHEN low = 0 THEN 1 END) AS predicted, count(CASE WHEN high = 1 THEN 1 END) AS expected FROM (SELECT user_id, event_type, count(*) AS n, min(side) AS low, max(side) AS high FROM s GROUP BY user_id, event_type) z GROUP BY user_id), p AS (SELECT user_id, CASE WHEN expected > 0 THEN coalesce(CAST(common AS DOUBLE) / nullif(predicted, 0), 0e0) END AS prec, CAST(common AS DOUBLE) / nullif(expected, 0) AS rec FROM c) SELECT user_id, round(prec, 6) AS precision_, round(rec, 6) AS recall_, round(CASE WHEN prec + rec = 0 THEN 0e0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1 FROM p",
    "metric_aggregate": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(avg(value), 3) AS mean, max(CASE WHEN i = CAST(round_even((n - 1) * 0.5e0, 0) AS BIGINT) THEN round(value, 4) END) AS p50, max(CASE WHEN i = CAST(round_even((n - 1) * 0.95e0, 0) AS BIGINT) THEN round(value, 4) END) AS p95, round(min(value), 4) AS least_, round(max(value), 4) AS most FROM o GROUP BY event_type",
    "metric_compare": "WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN printf('%.2fx', o_totalprice / 1000) WHEN 2 THEN '$' || printf('%.1f', o_totalprice / 1000 * 1.02e0) ELSE printf('%.1f%%', o_totalprice / 1000 * 1.004e0) END AS reported, o_totalprice / 1000 AS truth FROM orders), p AS (SELECT *, TRY_CAST(trim(replace(replace(replace(replace(replace(reported, ',', ''), '$', ''), 'x', ''), '%', ''), 'days', '')) AS DOUBLE) AS v, 0.5e0 * power(10, -length(split_part(regexp_replace(reported, '[^0-9.]', '', 'g'), '.', 2))) AS tol FROM c) SELECT id, reported, CASE WHEN v IS NULL THEN false WHEN abs(v - truth) <= tol THEN true ELSE abs(v - truth) / abs(truth) * 100 <= 1 END AS agrees FROM p WHERE v IS NULL OR abs(abs(v - truth) - tol) > 1e-9",
    "relevance_predicate": "SELECT doc_id FROM documents WHERE lower(lang) IN ('en', 'fr') AND (contains(lower(text), 'the') OR contains(lower(text), 'que')) AND (contains(lower(text), 'ation') OR contains(lower(text), 'ment'))",
    "validate_suite": "SELECT cases.id, CASE WHEN n.n_name IS NULL THEN 'issuer absent' WHEN coalesce(d.n, 0) = 0 THEN 'no relevant passage' ELSE 'kept' END AS verdict FROM cases LEFT JOIN nation n ON n.n_name = cases.issuer LEFT JOIN (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 2000 GROUP BY lang) d ON d.lang = cases.lang".replace("SELECT cases.id", "WITH cases AS (SELECT 'c' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'ATLANTIS' ELSE n_name END AS issuer, CASE n_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'xx' END AS lang FROM nation) SELECT cases.id"),
    "span_summary": "SELECT event_type AS name, count(*) AS n, round(sum(value), 2) AS total_ms, count(CASE WHEN value > 100 THEN 1 END) AS errors FROM events GROUP BY event_type",
    "settings_fingerprint": "SELECT source, substr(sha256('{\"docs\": ' || n || ', \"lang\": \"' || lang || '\"}'), 1, 16) AS fingerprint FROM (SELECT source, min(lang) AS lang, count(*) AS n FROM documents GROUP BY source) z",
    "token_cost": "SELECT user_id, round(sum(CASE event_type WHEN 'view' THEN 0.1e0 WHEN 'purchase' THEN 1.25e0 ELSE 1e0 END * value * 3 / 1e6), 7) AS cost FROM events GROUP BY user_id",
    "delete_cascade": "SELECT o_orderkey, o_custkey, 'orders' AS kept_in FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') UNION ALL SELECT l_orderkey, l_linenumber, 'lineitem' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING')",
    "replace_partition": "SELECT doc_id, lang, 'old' AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents x ON x.doc_id = l.doc_id WHERE x.source = d.source) UNION ALL SELECT d.doc_id, lang, 'new' FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "upsert_company": "WITH t AS (SELECT c_custkey AS cik, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS sector FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_name) END AS name, c_mktsegment AS sector FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(t.cik, i.cik) AS cik, coalesce(i.name, t.name) AS name, coalesce(i.sector, t.sector) AS sector FROM t FULL JOIN i ON t.cik = i.cik",
    "already_ingested": "SELECT c_custkey, count(o_orderkey) >= 12 AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "relabel_lookup": _with("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form, p.label FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS fy, CAST(quarter(o_orderdate) AS BIGINT) AS fq, c_nationkey AS nk FROM orders JOIN customer ON c_custkey = o_custkey) f LEFT JOIN (SELECT nk, fy, fq, kind, min(label) AS label FROM (SELECT nk, fy, fq, 'Q' AS kind, fy || 'Q' || fq AS label FROM periods UNION ALL SELECT nk, fy, fq, 'K', fy || 'FY' FROM periods WHERE fq = 4) u GROUP BY nk, fy, fq, kind) p ON p.nk = f.nk AND p.fy = f.fy AND p.fq = f.fq AND p.kind = CASE WHEN o_orderkey % 4 = 0 THEN 'K' ELSE 'Q' END"),
    "additive_migration": "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR(10)) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "universe_composition": "SELECT 'sector' AS dim, r_name AS value, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'profile', CASE WHEN n_nationkey % 3 = 0 THEN 'stressed' ELSE 'sound' END, count(*) FROM nation GROUP BY CASE WHEN n_nationkey % 3 = 0 THEN 'stressed' ELSE 'sound' END",
    "bigram_counts": f"SELECT g, count(*) AS n FROM (SELECT unnest({text.bigrams_duck('ws')}) AS g FROM (SELECT {text.tokens_duck('text')} AS ws FROM documents) z) y GROUP BY g",
    "paragraph_explode": "SELECT doc_id, ordinal, length(p) AS chars FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ordinal, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents) z) y WHERE trim(p) <> ''",
    "snippet": "SELECT doc_id, CASE WHEN at = 0 THEN trim(substr(text, 1, 320)) || CASE WHEN length(text) > 320 THEN '...' ELSE '' END ELSE CASE WHEN at > 107 THEN '...' ELSE '' END || trim(substr(text, greatest(at - 106, 1), least(length(text), greatest(at - 107, 0) + 320) - greatest(at - 107, 0))) || CASE WHEN greatest(at - 107, 0) + 320 < length(text) THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, coalesce(nullif(instr(lower(text), 'ation'), 0), nullif(instr(lower(text), 'ment'), 0), 0) AS at FROM documents WHERE text IS NOT NULL) z".replace(" AS at ", " AS spot ").replace("at - ", "spot - ").replace("at = 0", "spot = 0").replace("at > 107", "spot > 107"),
    "matched_terms": "SELECT doc_id, " + " || ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w},' ELSE '' END" for w in ("ation", "ment", "cion", "schaft")) + " AS terms FROM documents",
}

#: Spark's text for DuckDB's, in this order, after those of the registry.
SPARK = [
    (EFFECTS, _EFFECTS), (LINES, _LINES), (SHOWN, _SHOWN), (CONCEPTS, _CONCEPTS), ("arg_min(", "min_by("), ("arg_max(", "max_by("),
    ("string_agg(event_type, ',' ORDER BY first, event_type)", "array_join(transform(array_sort(collect_list(struct(first, event_type))), x -> x.event_type), ',')"),
    ("sha256(", "sha2(256, "), (f"unnest({text.bigrams_duck('ws')})", f"explode({text.bigrams_spark('ws')})"), (text.tokens_duck("text"), text.tokens_spark("text")),
    ("SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ordinal, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents) z", "SELECT doc_id, posexplode(split(text, '\\n')) AS (ordinal, p) FROM documents"),
]
SPARK_ONLY = {
    "settings_fingerprint": SQL["settings_fingerprint"].replace("sha256('", "sha2('").replace("'\"}')", "'\"}', 256)"),
    # neighbours in the order of balances instead of all pairs of a nation; both windows run from their start, so each row is added once, and
    # equal balances are one row.  A balance that is unknown, or meets none that is known, has the first customer and no gap
    "nearest_match": """WITH c AS (SELECT c_nationkey AS nk, c_acctbal AS bal, min(c_custkey) AS ck FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey, c_acctbal),
s AS (SELECT DISTINCT s_nationkey AS nk, s_acctbal AS bal FROM supplier WHERE s_acctbal IS NOT NULL),
u AS (SELECT nk, bal, ck FROM c WHERE bal IS NOT NULL UNION ALL SELECT nk, bal, NULL FROM s),
n AS (SELECT nk, bal, ck, max(CASE WHEN ck IS NOT NULL THEN struct(bal, -ck AS ck) END) OVER (PARTITION BY nk ORDER BY bal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below, min(CASE WHEN ck IS NOT NULL THEN struct(bal, ck) END) OVER (PARTITION BY nk ORDER BY bal DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM u),
x AS (SELECT nk, bal, array_min(array_compact(array(CASE WHEN below IS NOT NULL THEN struct(abs(bal - below.bal) AS gap, -below.ck AS ck) END, CASE WHEN above IS NOT NULL THEN struct(abs(bal - above.bal) AS gap, above.ck AS ck) END))) AS x FROM n WHERE ck IS NULL),
f AS (SELECT nk, min(ck) AS ck FROM c GROUP BY nk)
SELECT s_suppkey, coalesce(x.x.ck, f.ck) AS c_custkey, round(x.x.gap, 2) AS gap FROM supplier JOIN f ON f.nk = s_nationkey LEFT JOIN x ON x.nk = s_nationkey AND x.bal = s_acctbal""",
}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = SPARK_ONLY.get(name)
        if sql is None:
            sql = registry._spark(SQL[name])
            for duck, ours in SPARK:
                sql = sql.replace(duck, ours)
        return registry.run_sql(spark, sf_dir, sql)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


