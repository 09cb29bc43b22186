"""Fact normalisation over reported entries made of orders: DataFrame steps, and the same questions put to DuckDB as SQL.

A customer's nation stands for a company.  Its entries are quarters of revenue
(some restated, some under a more trusted tag), year-to-date spans of capital
expenditure, years, balances, and rows that cannot be used.  Fiscal years end in
other months for other companies, some a few days late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import taxonomy
from tidemark.operators import normalise

# Spelled alike in both engines; {dd} is date arithmetic, {s} a date's text.
_ENTRIES = """
q AS (SELECT c_nationkey AS company, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)),
m AS (SELECT *, y * 12 + (q - 1) * 3 + 3 * (company % 4) AS m0, y * 12 + 3 * (company % 4) AS y0, CASE WHEN company % 3 = 1 THEN 3 ELSE 0 END AS late FROM q),
d AS (SELECT company, y, q, v, late, make_date(CAST(floor(m0 / 12) AS INT), m0 % 12 + 1, 1) AS a, make_date(CAST(floor(y0 / 12) AS INT), y0 % 12 + 1, 1) AS ya, last_day(make_date(CAST(floor((m0 + 2) / 12) AS INT), (m0 + 2) % 12 + 1, 1)) AS b,
      sum(v) OVER (PARTITION BY company, y ORDER BY q) AS ytd, count(*) OVER (PARTITION BY company, y) AS n FROM m)
"""
# (tag_at, tag, unit, start, end, value, fy, form, filed, entry_at, which quarters) of each sort of entry
_SORTS = [
    (3, "Revenues", "USD", "a", "{b_late}", "v", "y", "10-Q", "{b_filed}", "y * 4 + q", "q < 4 OR company % 2 = 0"),
    (3, "Revenues", "USD", "a", "{b_late}", "v + 1", "y + 1", "10-Q", "{b_again}", "100000 + y * 4 + q", "company % 3 = 0"),
    (9, "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "a", "{b_late}", "v + 5", "y", "10-Q", "{b_filed}", "y * 4 + q", "company % 5 = 0 AND q = 2"),
    (3, "Revenues", "USD", "ya", "{b_late}", "ytd", "y + company % 2", "10-K", "{b_filed}", "200000 + y", "q = 4"),
    (4, "PaymentsToAcquirePropertyPlantAndEquipment", "USD", "ya", "{b_late}", "ytd / 10", "y", "10-Q", "{b_filed}", "y * 4 + q", "company % 7 <> 3 OR q <> 2"),
    (4, "PaymentsToAcquirePropertyPlantAndEquipment", "USD", "a", "{b_late}", "v / 10", "y", "10-Q", "{b_filed}", "300000 + y * 4 + q", "company % 7 = 3 AND q < 3"),
    (5, "Assets", "USD", "CAST(NULL AS DATE)", "{b_late}", "v * 8", "y", "10-Q", "{b_filed}", "y * 4 + q", "q <> 3 OR company % 2 = 1"),
    (6, "NoSuchTag", "USD", "a", "{b_late}", "v", "y", "10-Q", "{b_filed}", "y * 4 + q", "true"),
    (7, "GrossProfit", "EUR", "a", "{b_late}", "v", "y", "10-Q", "{b_filed}", "y * 4 + q", "true"),
    (8, "NetIncomeLoss", "USD", "a", "{b_late}", "CASE WHEN q = 1 THEN NULL ELSE v / 20 END", "y", "10-Q", "{b_filed}", "y * 4 + q", "true"),
    (8, "NetIncomeLoss", "USD", "a", "{b_short}", "v / 3", "y", "10-Q", "{b_filed}", "400000 + y * 4 + q", "true"),
]


def _entry(sort: tuple) -> str:
    at, tag, unit, s, t, val, fy, form, filed, entry_at, _ = sort
    return f"'us-gaap' AS taxonomy, {at} AS tag_at, '{tag}' AS tag, '{unit}' AS unit, {s} AS s, {t} AS t, {val} AS val, {fy} AS fy, '{form}' AS form, {filed} AS filed, {entry_at} AS entry_at"


def _duck_entries() -> str:
    rows = " UNION ALL ".join(f"SELECT company, q, {_entry(sort)} FROM d WHERE {sort[-1]}" for sort in _SORTS)
    return f"{_ENTRIES}, e AS ({rows})".format(**_DUCK)


def _spark_entries() -> str:
    """All sorts from one pass over the quarters."""
    rows = ", ".join(f"CASE WHEN {sort[-1]} THEN struct({_entry(sort)}) END" for sort in _SORTS)
    return f"{_ENTRIES}, e AS (SELECT company, q, inline(array_compact(array({rows}))) FROM d)".format(**_SPARK)


_DUCK = {"b_late": "CAST(b + late AS DATE)", "b_filed": "CAST(b + 40 AS DATE)", "b_again": "CAST(b + 400 AS DATE)", "b_short": "CAST(a + 20 AS DATE)"}
_SPARK = {"b_late": "date_add(b, late)", "b_filed": "date_add(b, 40)", "b_again": "date_add(b, 400)", "b_short": "date_add(a, 20)"}
_COLUMNS = "company, taxonomy, tag_at, tag, 0 AS unit_at, unit, {0}s{1} AS start, {0}t{1} AS {2}, val, fy, CASE WHEN q = 4 AND tag = 'Assets' THEN NULL ELSE form END AS form, CAST(company AS VARCHAR(9)) AS accn, {0}filed{1} AS filed, entry_at"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries as a payload would give them: dates are text."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    columns = _COLUMNS.format("CAST(", " AS STRING)", "`end`")
    return spark.sql(f"WITH orders AS (SELECT * FROM {{o}}), customer AS (SELECT * FROM {{c}}), {_spark_entries()} SELECT {columns} FROM e", o=orders, c=customers)


_TAIL = ["company", "concept", "fiscal_year", "fiscal_period"]


def _shown(facts: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return facts.select(F.col("company").cast("long").alias("company"), "concept", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", day("period_end"), day("period_start"), F.round("value", 4).alias("value"), "kind", F.col("alias_priority").cast("long").alias("alias_priority"), F.col("ytd_months").cast("long").alias("ytd_months"), "source")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.dated(entries(spark, sf_dir))


def fiscal_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.calendars(_rows(spark, sf_dir)).select(F.col("company").cast("long").alias("company"), F.col("fye_month").cast("long").alias("fye_month"), F.col("year_offset").cast("long").alias("year_offset"), "calibrated")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return normalise.candidates(rows, normalise.calendars(rows))


def fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_facts(spark, sf_dir))


def fact_candidates_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only fiscal years from 2000 on, a filter on the label."""
    rows = _rows(spark, sf_dir)
    return _shown(normalise.candidates(rows, normalise.calendars(rows), min_fiscal_year=2000))


def mirror_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalise.mirror_year_end(_facts(spark, sf_dir)).filter("kind = 'instant'"))


def facts_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalise.deduplicate(normalise.mirror_year_end(_facts(spark, sf_dir))))


def ytd_to_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalise.difference_ytd(normalise.deduplicate(normalise.mirror_year_end(_facts(spark, sf_dir)))))


def fact_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalise.normalise(entries(spark, sf_dir)))


def carry_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(normalise.carry_instants(normalise.normalise(entries(spark, sf_dir))))


def filing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing's label by its company's calendar; companies whose number 4 divides are taken as unknown."""
    rows = _rows(spark, sf_dir).filter("period_end is not null")
    found = rows.join(normalise.calendars(rows).filter("company % 4 <> 0"), "company", "left")
    year, period = normalise.filing_label(F.coalesce("form", F.lit("8-K")), F.col("period_end"), F.col("fye_month"), F.col("year_offset"))
    return found.select(F.col("company").cast("long").alias("company"), F.coalesce("form", F.lit("8-K")).alias("form"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), year.cast("long").alias("fiscal_year"), period.alias("fiscal_period")).distinct()


def _duck() -> dict[str, str]:
    """Each step as one more common table expression."""
    close = "CASE WHEN {0} - last_day(make_date(CAST(year({0}) AS INT), fye_month, 1)) > 10 THEN last_day(make_date(CAST(year({0}) AS INT) + 1, fye_month, 1)) ELSE last_day(make_date(CAST(year({0}) AS INT), fye_month, 1)) END"
    label = "(['Q4', 'Q4', 'Q3', 'Q3', 'Q3', 'Q2', 'Q2', 'Q2', 'Q1', 'Q1', 'Q1'])[CAST(greatest(round_even(({0} - t) / 30.44, 0), 0) AS INT) + 1]"
    ctes = [
        _duck_entries(),
        f"x AS (SELECT {_COLUMNS.format('', '', 't')}, row_number() OVER (ORDER BY CASE taxonomy WHEN 'us-gaap' THEN 0 ELSE 1 END, tag_at, entry_at) AS ord FROM e)",
        "y AS (SELECT *, CASE WHEN start IS NULL THEN 'instant' WHEN t - start BETWEEN 75 AND 115 THEN 'quarter' WHEN t - start BETWEEN 330 AND 400 THEN 'annual' WHEN t - start BETWEEN 150 AND 210 OR t - start BETWEEN 240 AND 300 THEN 'ytd' END AS span FROM x)",
        "mo AS (SELECT company, arg_min(mon, (-n, f)) AS fye FROM (SELECT company, month(t) AS mon, count(*) AS n, min((tag_at, entry_at)) AS f FROM y WHERE span = 'annual' GROUP BY ALL) GROUP BY company)",
        "sh AS (SELECT company, arg_min(o, (-n, f)) AS off FROM (SELECT company, fy - year(t) AS o, count(*) AS n, min((tag_at, entry_at)) AS f FROM y WHERE span = 'annual' AND form = '10-K' AND filed - t BETWEEN 1 AND 119 AND abs(fy - year(t)) <= 1 GROUP BY ALL) GROUP BY company)",
        "cal AS (SELECT DISTINCT y.company, CAST(coalesce(fye, 12) AS INT) AS fye_month, CAST(coalesce(off, 0) AS INT) AS year_offset, off IS NOT NULL AS calibrated FROM y LEFT JOIN mo USING (company) LEFT JOIN sh USING (company))",
        f"tags(tag, concept, statement, kind, alias_priority) AS (VALUES {taxonomy.values_sql()})",
        f"lab AS (SELECT y.*, cal.* EXCLUDE (company), {close.format('t')} AS closing FROM y JOIN cal USING (company))",
        f"cand AS (SELECT company, concept, year(closing) + year_offset AS fiscal_year, CASE WHEN span = 'annual' THEN 'FY' ELSE {label.format('closing')} END AS fiscal_period, t AS period_end, start AS period_start, val AS value, kind, filed, alias_priority, CASE WHEN span <> 'ytd' THEN 0 WHEN t - start < 225 THEN 6 ELSE 9 END AS ytd_months, (tag_at, entry_at) AS ord FROM lab JOIN tags USING (tag) WHERE unit IN ('USD', 'USD/shares', 'shares') AND val IS NOT NULL AND span IS NOT NULL AND (kind = 'instant') = (span = 'instant'))",
        "c2 AS (SELECT *, CASE WHEN ytd_months > 0 THEN 'ytd-staging' ELSE 'sec-edgar-xbrl' END AS source FROM cand WHERE fiscal_period IS NOT NULL)",
        "mir AS (SELECT * FROM c2 UNION ALL SELECT * REPLACE ('FY' AS fiscal_period) FROM c2 WHERE kind = 'instant' AND fiscal_period = 'Q4')",
        "ded AS (SELECT * EXCLUDE (first) REPLACE (first AS ord) FROM (SELECT *, min(ord) OVER (PARTITION BY company, concept, fiscal_year, fiscal_period, period_end) AS first FROM mir) QUALIFY row_number() OVER (PARTITION BY company, concept, fiscal_year, fiscal_period, period_end ORDER BY alias_priority, coalesce(filed, DATE '1900-01-01') DESC, ord) = 1)",
        "dis AS (SELECT company, concept, fiscal_year, fiscal_period, arg_max(value, ord) AS value FROM ded WHERE ytd_months = 0 AND kind = 'duration' GROUP BY ALL)",
        "stg AS (SELECT * FROM ded WHERE ytd_months > 0 QUALIFY row_number() OVER (PARTITION BY company, concept, fiscal_year, ytd_months ORDER BY fiscal_period DESC, ord DESC) = 1)",
        "new AS (SELECT s.* REPLACE ('Q2' AS fiscal_period, s.value - q1.value AS value, 0 AS ytd_months, 'derived-from-ytd (6M less Q1)' AS source) FROM stg s JOIN dis q1 ON q1.company = s.company AND q1.concept = s.concept AND q1.fiscal_year = s.fiscal_year AND q1.fiscal_period = 'Q1' WHERE s.ytd_months = 6 AND NOT EXISTS (SELECT 1 FROM dis d WHERE d.company = s.company AND d.concept = s.concept AND d.fiscal_year = s.fiscal_year AND d.fiscal_period = 'Q2')"
        " UNION ALL SELECT s.* REPLACE ('Q3' AS fiscal_period, s.value - coalesce(h.value, q1.value + q2.value) AS value, 0 AS ytd_months, CASE WHEN h.value IS NULL THEN 'derived-from-ytd (9M less Q1 + Q2)' ELSE 'derived-from-ytd (9M less YTD 6M)' END AS source) FROM stg s LEFT JOIN stg h ON h.company = s.company AND h.concept = s.concept AND h.fiscal_year = s.fiscal_year AND h.ytd_months = 6 LEFT JOIN dis q1 ON q1.company = s.company AND q1.concept = s.concept AND q1.fiscal_year = s.fiscal_year AND q1.fiscal_period = 'Q1' LEFT JOIN dis q2 ON q2.company = s.company AND q2.concept = s.concept AND q2.fiscal_year = s.fiscal_year AND q2.fiscal_period = 'Q2'"
        " WHERE s.ytd_months = 9 AND coalesce(h.value, q1.value + q2.value) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dis d WHERE d.company = s.company AND d.concept = s.concept AND d.fiscal_year = s.fiscal_year AND d.fiscal_period = 'Q3'))",
        "qtr AS (SELECT * FROM ded WHERE ytd_months = 0 UNION ALL SELECT * FROM new)",
        f"flow AS (SELECT * FROM qtr WHERE concept IN ({', '.join(repr(c) for c in taxonomy.FLOWS)}) QUALIFY row_number() OVER (PARTITION BY company, concept, fiscal_year, fiscal_period ORDER BY ord DESC) = 1)",
        "q4 AS (SELECT f.* REPLACE ('Q4' AS fiscal_period, f.value - w.s AS value, w.e AS period_start, 'derived-q4' AS source) FROM flow f JOIN (SELECT company, concept, fiscal_year, sum(value) FILTER (fiscal_period IN ('Q1', 'Q2', 'Q3')) AS s, CAST(max(period_end) FILTER (fiscal_period = 'Q3') + 1 AS DATE) AS e, list_sort(list(fiscal_period)) AS have FROM flow GROUP BY ALL) w ON w.company = f.company AND w.concept = f.concept AND w.fiscal_year = f.fiscal_year WHERE f.fiscal_period = 'FY' AND have = ['FY', 'Q1', 'Q2', 'Q3'])",
        "fin AS (SELECT * FROM qtr UNION ALL SELECT * FROM q4)",
        "per AS (SELECT DISTINCT company, fiscal_year, fiscal_period, period_end FROM fin WHERE kind = 'duration')",
        "ins AS (SELECT *, period_end AS had FROM fin WHERE kind = 'instant')",
        "car AS (SELECT i.* REPLACE (p.period_end AS period_end, p.fiscal_year AS fiscal_year, p.fiscal_period AS fiscal_period, 'carried-forward-from-' || CAST(i.had AS VARCHAR) AS source) FROM per p JOIN ins i ON i.company = p.company AND i.had <= p.period_end WHERE NOT EXISTS (SELECT 1 FROM ins k WHERE k.company = p.company AND k.concept = i.concept AND k.fiscal_year = p.fiscal_year AND k.fiscal_period = p.fiscal_period) QUALIFY row_number() OVER (PARTITION BY p.company, i.concept, p.fiscal_year, p.fiscal_period, p.period_end ORDER BY i.had DESC, i.fiscal_year DESC, i.fiscal_period DESC) = 1)",
        "ends AS (SELECT DISTINCT y.company, coalesce(form, '8-K') AS form, t, fye_month, year_offset, y.company % 4 <> 0 AS known FROM y JOIN cal ON cal.company = y.company WHERE t IS NOT NULL)",
    ]
    shown = "SELECT CAST(company AS BIGINT) AS company, concept, CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period, CAST(period_end AS VARCHAR) AS period_end, CAST(period_start AS VARCHAR) AS period_start, round(value, 4) AS value, kind, CAST(alias_priority AS BIGINT) AS alias_priority, CAST(ytd_months AS BIGINT) AS ytd_months, source FROM "

    head = "WITH " + ",\n".join(ctes) + "\n"
    return {
        "fiscal_calendar": head + "SELECT CAST(company AS BIGINT) AS company, CAST(fye_month AS BIGINT) AS fye_month, CAST(year_offset AS BIGINT) AS year_offset, calibrated FROM cal",
        "fact_candidates": head + shown + "c2",
        "fact_candidates_since": head + shown + "c2 WHERE fiscal_year >= 2000",
        "mirror_instants": head + shown + "mir WHERE kind = 'instant'",
        "facts_deduplicated": head + shown + "ded",
        "ytd_to_quarters": head + shown + "qtr",
        "fact_normalise": head + shown + "fin",
        "carry_instants": head + shown + "(SELECT * FROM fin UNION ALL SELECT * EXCLUDE (had) FROM car WHERE period_end - had <= 200)",
        "filing_labels": head + f"SELECT DISTINCT CAST(company AS BIGINT) AS company, form, CAST(t AS VARCHAR) AS period_end, CASE WHEN known THEN year(closing) + year_offset ELSE year(t) END AS fiscal_year, CASE WHEN form = '10-K' THEN 'FY' WHEN known THEN {label.format('closing')} ELSE 'Q' || quarter(t) END AS fiscal_period FROM (SELECT *, {close.format('t')} AS closing FROM ends) z",
    }


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (fiscal_calendar, fact_candidates, fact_candidates_since, mirror_instants, facts_deduplicated, ytd_to_quarters, fact_normalise, carry_instants, filing_labels)}


def oracle_sql() -> dict[str, str]:
    return _duck()
