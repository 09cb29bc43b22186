"""Where trailing-year measures of every issuer come from, down to facts summed from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import statements
from tidemark.sources.scratch import Scratch

from . import registry

RATIOS = {"net_debt_to_ebitda": ("net_debt", "ebitda"), "fcf_to_debt": ("free_cash_flow", "total_debt")}
ROOTS = ["net_debt_to_ebitda", "fcf_to_debt", "net_debt", "ebitda"]
#: What issuers report, by their number: a combined debt, short and long, a long-term tag that takes in current maturities, short only; some have no investments or report one sum of depreciation.
REPORTED = {
    "revenue": "revenue", "cost_of_revenue": "cost_of_revenue", "operating_income": "operating_income", "operating_cash_flow": "operating_cash_flow", "capex": "capex",
    "cash_and_equivalents": "cash_and_equivalents", "current_assets": "current_assets", "current_liabilities": "current_liabilities", "total_equity": "total_equity",
    "short_term_investments": "CASE WHEN nk % 5 <> 0 THEN short_term_investments END",
    "depreciation_amortization": "CASE WHEN nk % 2 = 0 THEN depreciation_amortization END",
    "depreciation_only": "CASE WHEN nk % 2 = 1 THEN depreciation_amortization END",
    "amortization_intangibles": "CASE WHEN nk % 6 = 1 THEN depreciation_amortization * 0.2e0 END",
    "total_debt_reported": "CASE WHEN nk % 4 = 0 THEN 13 * short_term_debt END",
    "short_term_debt": "CASE WHEN nk % 4 <> 2 OR fq = 1 THEN short_term_debt END",
    "long_term_debt": "CASE WHEN nk % 4 IN (1, 2) THEN long_term_debt END",
}
TAG = "CASE WHEN nk % 4 = 2 THEN 'LongTermDebt' ELSE 'LongTermDebtNoncurrent' END"
_DUCK_FACTS = "rep AS (" + " UNION ALL ".join(f"SELECT issuer, nk, k, '{c}' AS concept, CAST({e} AS DECIMAL(20, 7)) AS value FROM facts" for c, e in REPORTED.items()) + "), fx AS (SELECT issuer, nk, k, concept, value FROM rep WHERE value IS NOT NULL)"


def reported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issuer, period, concept, value, tag, source): sums of orders, one row a fact."""
    rows = ", ".join(f"struct('{c}' AS concept, CAST({e} AS DECIMAL(20, 7)) AS value)" for c, e in REPORTED.items())
    sql = registry._spark(registry._with(f"SELECT issuer, k AS period, tag, 'reported' AS source, inline(array({rows})) FROM (SELECT *, {TAG} AS tag FROM facts) z"))
    return registry.run_sql(spark, sf_dir, sql).filter("value is not null")


def _graph(spark: SparkSession, sf_dir: str, scratch: Scratch) -> statements.Graph:
    facts = scratch.written(reported_facts(spark, sf_dir), "facts")
    made = statements.graph(scratch.written(statements.with_measures(statements.periods(facts)), "periods"), RATIOS)
    return statements.Graph(scratch.written(made.nodes, "nodes"), made.edges)


def total_debt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total debt of every period and the path that gave it."""
    rows = statements.with_total_debt(statements.periods(reported_facts(spark, sf_dir)))
    return rows.select("issuer", F.col("period").alias("k"), "debt_path", F.round("total_debt", 4).cast("double").alias("total_debt"), F.array_join(F.col("total_debt_from.concept"), ",").alias("parts"))


def _roots(made: statements.Graph) -> DataFrame:
    return made.nodes.filter(F.col("concept").isin(ROOTS) & F.col("period").startswith("TTM"))


def lineage_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node under the roots of all trailing years, with its depth, its way and what it is."""
    scratch = Scratch(spark, "lineage")
    made = _graph(spark, sf_dir, scratch)
    ways = statements.walk(spark, made, _roots(made), scratch)
    out = ways.join(made.nodes, ["issuer", "period", "concept"], "left")
    return out.select("issuer", "root_period", "root", F.array_join("path", " < ").alias("way"), "depth", "period", "concept", "sign", "side", "kind", F.round("value", 4).cast("double").alias("value"), "leaf")


def lineage_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root as derived and as computed again from its leaves."""
    scratch = Scratch(spark, "lineage")
    made = _graph(spark, sf_dir, scratch)
    roots = _roots(made)
    again = statements.recomputed(statements.walk(spark, made, roots, scratch), made)
    both = roots.select("issuer", F.col("period").alias("root_period"), F.col("concept").alias("root"), F.col("value").alias("derived")).join(again, ["issuer", "root_period", "root"])
    return both.select("issuer", "root_period", "root", "leaves", F.round("derived", 4).cast("double").alias("derived"), F.when(F.col("below").isNull(), F.round("above", 4).cast("double")).otherwise(F.round("value", 4)).alias("from_leaves"))


def _sum(name: str, parts: list[statements.Part], source: str) -> tuple[str, str]:
    """(value, edges) of a measure in DuckDB, from the wide rows ``source``."""
    ready = " AND ".join([f"{p.concept} IS NOT NULL" for p in parts if not p.optional] or ["TRUE"])
    value = " + ".join(f"({p.sign}) * coalesce({p.concept}, 0)" for p in parts)
    return f"CASE WHEN {ready} THEN {value} END", " UNION ALL ".join(f"SELECT issuer, k, '{name}' AS concept, '{p.concept}' AS part, {p.sign} AS sign FROM {source} WHERE {name}_made AND {p.concept} IS NOT NULL" for p in parts)


def _graph_sql() -> list[str]:
    wide = ", ".join(f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}" for c in statements.READ)
    parts = [
        registry.BASE.strip(), _DUCK_FACTS,
        f"w AS (SELECT issuer, k, any_value(nk) AS nk, {wide} FROM fx GROUP BY issuer, k)",
        "m0 AS (SELECT *, CASE WHEN total_debt_reported IS NOT NULL THEN 'reported' WHEN nk % 4 = 2 AND long_term_debt IS NOT NULL THEN 'inclusive' WHEN short_term_debt IS NOT NULL OR long_term_debt IS NOT NULL THEN 'components' END AS debt_path FROM w)",
        "m1 AS (SELECT *, CASE debt_path WHEN 'reported' THEN total_debt_reported WHEN 'inclusive' THEN long_term_debt WHEN 'components' THEN coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) END AS total_debt FROM m0)",
    ]
    edges = ["SELECT issuer, k, 'total_debt' AS concept, 'total_debt_reported' AS part, 1 AS sign FROM m1 WHERE debt_path = 'reported'", "SELECT issuer, k, 'total_debt', 'short_term_debt', 1 FROM m1 WHERE debt_path = 'components' AND short_term_debt IS NOT NULL", "SELECT issuer, k, 'total_debt', 'long_term_debt', 1 FROM m1 WHERE (debt_path = 'components' AND long_term_debt IS NOT NULL) OR debt_path = 'inclusive'"]
    last, made = "m1", ["total_debt"]
    for i, (name, rule) in enumerate(statements.RULES.items(), 2):
        known = name in statements.READ
        value, found = _sum(name, rule, f"m{i}")
        keep = f"* REPLACE (coalesce({name}, {value}) AS {name})" if known else f"*, {value} AS {name}"
        parts.append(f"m{i} AS (SELECT {keep}, {f'{name} IS NULL AND ' if known else ''}({value}) IS NOT NULL AS {name}_made FROM {last})")
        edges.append(found)
        last = f"m{i}"
        made.append(name)
    concepts = list(dict.fromkeys([*statements.READ, *made]))
    flows = ", ".join(f"'{c}'" for c in [*statements.taxonomy.FLOWS, "depreciation_only", "amortization_intangibles"])
    ratios = ", ".join(f"('{r}', '{a}', '{b}')" for r, (a, b) in RATIOS.items())
    parts += [
        "ei AS (" + " UNION ALL ".join(edges) + ")",
        "v AS (" + " UNION ALL ".join(f"SELECT issuer, k, '{c}' AS concept, CAST({c} AS DECIMAL(38, 7)) AS value FROM {last} WHERE {c} IS NOT NULL" for c in concepts) + ")",
        f"q4 AS (SELECT a.issuer, a.k FROM {last} a WHERE (SELECT count(*) FROM {last} b WHERE b.issuer = a.issuer AND b.k BETWEEN a.k - 3 AND a.k) = 4)",
        f"ty AS (SELECT v.*, concept IN ({flows}) AS flow, count(*) OVER y AS n, sum(value) OVER y AS s FROM v WINDOW y AS (PARTITION BY issuer, concept ORDER BY k RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))",
        "tt AS (SELECT issuer, 'TTM ' || k AS period, k, concept, flow, CAST(CASE WHEN flow THEN s ELSE value END AS DECIMAL(38, 7)) AS value FROM ty JOIN q4 USING (issuer, k) WHERE NOT flow OR n = 4)",
        f"rt(concept, top, base) AS (VALUES {ratios})",
        "rv AS (SELECT a.issuer, a.period, rt.concept, top, base, CAST(CAST(a.value AS DOUBLE) / CAST(b.value AS DOUBLE) AS DECIMAL(38, 7)) AS value FROM rt JOIN tt a ON a.concept = top JOIN tt b ON b.concept = base AND b.issuer = a.issuer AND b.period = a.period WHERE b.value <> 0)",
        "nodes AS (SELECT issuer, CAST(k AS VARCHAR) AS period, concept, value, CASE WHEN EXISTS (SELECT 1 FROM ei WHERE ei.issuer = v.issuer AND ei.k = v.k AND ei.concept = v.concept) THEN 'derived' ELSE 'reported' END AS kind FROM v UNION ALL SELECT issuer, period, concept, value, CASE WHEN flow THEN 'derived-ttm' ELSE 'latest' END FROM tt UNION ALL SELECT issuer, period, concept, value, 'computed' FROM rv)",
        "edges AS (SELECT issuer, CAST(k AS VARCHAR) AS period, concept, CAST(k AS VARCHAR) AS part_period, part, sign FROM ei UNION ALL SELECT issuer, period, concept, CAST(k - i AS VARCHAR), concept, 1 FROM tt, range(4) z(i) WHERE flow OR i = 0 UNION ALL SELECT issuer, period, concept, period, top, 1 FROM rv UNION ALL SELECT issuer, period, concept, period, base, 0 FROM rv)",
        f"ways AS (SELECT issuer, period AS root_period, concept AS root, period, concept, 1 AS sign, 1 AS side, concept || ' ' || period AS way, 0 AS depth FROM nodes WHERE concept IN ({', '.join(repr(r) for r in ROOTS)}) AND period LIKE 'TTM%' UNION ALL SELECT w.issuer, root_period, root, part_period, part, CASE WHEN e.sign < 0 THEN -w.sign ELSE w.sign END, CASE WHEN e.sign = 0 THEN 0 ELSE side END, way || ' < ' || part || ' ' || part_period, depth + 1 FROM ways w JOIN edges e ON e.issuer = w.issuer AND e.period = w.period AND e.concept = w.concept)",
        "ends AS (SELECT w.*, NOT EXISTS (SELECT 1 FROM edges e WHERE e.issuer = w.issuer AND e.period = w.period AND e.concept = w.concept) AS leaf FROM ways w)",
    ]
    return parts


def oracle_sql() -> dict[str, str]:
    head = "WITH RECURSIVE " + ",\n".join(_graph_sql())
    return {
        "total_debt_paths": head + "\nSELECT issuer, k, debt_path, CAST(round(total_debt, 4) AS DOUBLE) AS total_debt, CASE debt_path WHEN 'reported' THEN 'total_debt_reported' WHEN 'inclusive' THEN 'long_term_debt' ELSE concat_ws(',', CASE WHEN short_term_debt IS NOT NULL THEN 'short_term_debt' END, CASE WHEN long_term_debt IS NOT NULL THEN 'long_term_debt' END) END AS parts FROM m1",
        "lineage_recursive": head + "\nSELECT issuer, root_period, root, way, depth, period, concept, sign, side, kind, CAST(round(value, 4) AS DOUBLE) AS value, leaf FROM ends LEFT JOIN nodes USING (issuer, period, concept)",
        "lineage_leaves": head + ",\nes AS (SELECT issuer, root_period, root, count(DISTINCT (period, concept)) AS leaves, sum(CASE WHEN side = 1 THEN sign * value END) AS above, sum(CASE WHEN side = 0 THEN sign * value END) AS below FROM ends JOIN nodes USING (issuer, period, concept) WHERE leaf GROUP BY issuer, root_period, root)\nSELECT s.issuer, root_period, root, leaves, CAST(round(n.value, 4) AS DOUBLE) AS derived, CASE WHEN below IS NULL THEN CAST(round(above, 4) AS DOUBLE) ELSE round(CAST(above AS DOUBLE) / CAST(below AS DOUBLE), 4) END AS from_leaves FROM es s JOIN nodes n ON n.issuer = s.issuer AND n.period = root_period AND n.concept = root",
    }


def queries() -> dict:
    return {f.__name__: f for f in (total_debt_paths, lineage_recursive, lineage_leaves)}
