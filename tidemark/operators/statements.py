"""Measures derived from reported facts, and where each one comes from.

Facts (issuer, period, concept, value, tag, source) become one row a period, to
which each rule adds its measure where none is reported.  A derivation is kept as
edges from a node (issuer, period, concept) to its parts, each with a sign, so any value
can be walked down to reported facts, and computed again from them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import taxonomy
from tidemark.sources.scratch import Scratch


class Part(NamedTuple):
    sign: int
    concept: str
    optional: bool = False


# What derived measures consist of, in the order in which they are derived; depth of a walk; words for origins.
RULES = {
    "depreciation_amortization": [Part(1, "depreciation_only"), Part(1, "amortization_intangibles", True)],
    "net_debt": [Part(1, "total_debt"), Part(-1, "cash_and_equivalents"), Part(-1, "short_term_investments", True)],
    "ebit": [Part(1, "operating_income")],
    "ebitda": [Part(1, "operating_income"), Part(1, "depreciation_amortization")],
    "free_cash_flow": [Part(1, "operating_cash_flow"), Part(-1, "capex")],
    "working_capital": [Part(1, "current_assets"), Part(-1, "current_liabilities")],
    "gross_profit": [Part(1, "revenue"), Part(-1, "cost_of_revenue")],
    "tangible_equity": [Part(1, "total_equity"), Part(-1, "goodwill", True), Part(-1, "intangible_assets", True)],
    "cash_and_investments": [Part(1, "cash_and_equivalents"), Part(1, "short_term_investments", True)],
}
MAX_DEPTH = 6
ORIGINS = {
    "sec-edgar-xbrl": "reported by the filer in XBRL",
    "derived": "computed from other values in the same period",
    "derived-ttm": "summed across a trailing twelve-month window",
    "derived-q4": "reconstructed: fiscal year minus the first three quarters",
    "deterministic-calculation": "computed by the ratio engine",
    "reported": "reported by the filer",
}
#: Every concept that a rule reads or makes.
DEBT = ["short_term_debt", "long_term_debt", "total_debt_reported"]
READ = list(dict.fromkeys([*DEBT, *(p.concept for parts in RULES.values() for p in parts if p.concept not in RULES and p.concept != "total_debt"), "depreciation_amortization"]))
MEASURES = ["total_debt", *RULES]


def _parts(*parts: tuple[int, str, Column]) -> Column:
    """An array of (concept, sign) of the parts that are there."""
    some = [F.when(there, F.struct(F.lit(c).alias("concept"), F.lit(s).alias("sign"))) for s, c, there in parts]
    return F.array_compact(F.array(*some))


def periods(facts: DataFrame) -> DataFrame:
    """One row an issuer and period, a column for each concept that is read, and the tag of long-term debt: one shuffle."""
    cells = [F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in READ]
    tag = F.max(F.when(F.col("concept") == "long_term_debt", F.col("tag"))).alias("long_term_tag")
    return facts.filter(F.col("concept").isin(READ)).groupBy("issuer", "period").agg(*cells, tag)


def with_total_debt(rows: DataFrame) -> DataFrame:
    """``total_debt``, with the path taken in ``debt_path`` and its parts in ``total_debt_from``.

    A combined amount that the filer reports counts first; a long-term tag that takes
    in current maturities counts alone; else short and long add up, a missing one as 0.
    """
    have = {c: F.col(c).isNotNull() for c in DEBT}
    inclusive = have["long_term_debt"] & F.coalesce(F.col("long_term_tag").isin(taxonomy.INCLUSIVE_DEBT_TAGS), F.lit(False))
    either = have["short_term_debt"] | have["long_term_debt"]
    zero = F.lit(0)
    path = F.when(have["total_debt_reported"], "reported").when(inclusive, "inclusive").when(either, "components")
    rows = rows.withColumn("debt_path", path)
    value = F.when(F.col("debt_path") == "reported", F.col("total_debt_reported")).when(F.col("debt_path") == "inclusive", F.col("long_term_debt"))
    value = value.when(F.col("debt_path") == "components", F.coalesce("short_term_debt", zero) + F.coalesce("long_term_debt", zero))
    added = F.col("debt_path") == "components"
    parts = _parts((1, "total_debt_reported", F.col("debt_path") == "reported"), (1, "short_term_debt", added & have["short_term_debt"]), (1, "long_term_debt", (F.col("debt_path") == "inclusive") | (added & have["long_term_debt"])))
    return rows.withColumn("total_debt", value).withColumn("total_debt_from", parts)


def with_measures(rows: DataFrame) -> DataFrame:
    """Every measure of RULES that is not reported and whose needed parts are there; ``<measure>_from`` lists its parts, none if reported."""
    rows = with_total_debt(rows)
    for name, parts in RULES.items():
        reported = F.col(name) if name in rows.columns else F.lit(None)
        ready = F.lit(True)
        value = F.lit(0)
        for p in parts:
            ready = ready if p.optional else ready & F.col(p.concept).isNotNull()
            value = value + p.sign * F.coalesce(F.col(p.concept), F.lit(0))
        made = reported.isNull() & ready
        listed = _parts(*((p.sign, p.concept, made & F.col(p.concept).isNotNull()) for p in parts))
        rows = rows.withColumn(f"{name}_from", listed).withColumn(name, F.coalesce(reported, F.when(ready, value)))
    return rows


@dataclass
class Graph:
    """``nodes``: issuer, period, concept, value, kind; ``edges``: issuer, period, concept, part_period, part, sign."""

    nodes: DataFrame
    edges: DataFrame


def _values(rows: DataFrame, kind_of) -> DataFrame:
    each = [F.struct(F.lit(c).alias("concept"), F.col(c).cast("decimal(38,7)").alias("value"), kind_of(c).alias("kind")) for c in [*READ, *[m for m in MEASURES if m not in READ]]]
    return rows.select("issuer", "period", F.inline(F.array(*each))).filter("value is not null")


def graph(rows: DataFrame, ratios: dict[str, tuple[str, str]] | None = None) -> Graph:
    """Nodes and edges of periods (from ``with_measures``, with ``period`` a running number of quarters) and of their trailing years.

    A trailing year, named ``TTM`` and its last quarter, has sums of four quarters
    that follow each other for flows, and the last quarter's value for all else.
    ``ratios`` (numerator, denominator) are taken of trailing years; their parts have
    signs 1 and 0.
    """
    derived = lambda c: F.when(F.size(f"{c}_from") > 0, "derived").otherwise("reported") if c in MEASURES else F.lit("reported")
    plain = _values(rows, derived).select("issuer", F.col("period").cast("string").alias("period"), F.col("period").alias("at"), "concept", "value", "kind")

    def named(measure: str) -> Column:
        return F.transform(f"{measure}_from", lambda x: F.struct(F.lit(measure).alias("concept"), x["concept"].alias("part"), x["sign"].alias("sign")))

    parts = [named(m) for m in MEASURES]
    inner = rows.select("issuer", F.col("period").cast("string").alias("period"), F.inline(F.flatten(F.array(*parts)))).withColumn("part_period", F.col("period"))
    year = Window.partitionBy("issuer", "concept").orderBy("at").rowsBetween(-3, 0)
    flow = F.col("concept").isin(taxonomy.FLOWS + ["depreciation_only", "amortization_intangibles"])
    rolled = plain.withColumn("first", F.min("at").over(year)).withColumn("n", F.count(F.lit(1)).over(year)).withColumn("sum", F.sum("value").over(year))
    whole = (F.col("n") == 4) & (F.col("at") - F.col("first") == 3)
    rolled = rolled.filter(whole | ~flow)
    # a trailing year needs four quarters of the issuer, whatever they report
    quarters = rows.select("issuer", F.col("period").alias("at"), F.lag("period", 3).over(Window.partitionBy("issuer").orderBy("period")).alias("early")).filter("at - early = 3").select("issuer", "at")
    rolled = rolled.join(quarters, ["issuer", "at"])
    name = F.concat(F.lit("TTM "), F.col("at").cast("string"))
    ttm = rolled.select("issuer", name.alias("period"), "at", "concept", F.when(flow, F.col("sum").cast("decimal(38,7)")).otherwise(F.col("value")).alias("value"), F.when(flow, "derived-ttm").otherwise("latest").alias("kind"))
    steps = F.when(flow, F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    outer = rolled.select("issuer", name.alias("period"), "concept", F.col("concept").alias("part"), F.lit(1).alias("sign"), F.explode(F.transform(steps, lambda i: (F.col("at") - i).cast("string"))).alias("part_period"))
    nodes, edges = plain.drop("at").unionByName(ttm.drop("at")), inner.unionByName(outer)
    if ratios:
        pairs = F.array(*[F.struct(F.lit(r).alias("concept"), F.lit(n).alias("top"), F.lit(d).alias("base")) for r, (n, d) in ratios.items()])
        asked = ttm.select("issuer", "period").distinct().select("issuer", "period", F.inline(pairs))
        value = lambda c, v: ttm.select("issuer", "period", F.col("concept").alias(c), F.col("value").alias(v))
        known = asked.join(value("top", "above"), ["issuer", "period", "top"]).join(value("base", "below"), ["issuer", "period", "base"]).filter("below <> 0")
        nodes = nodes.unionByName(known.select("issuer", "period", "concept", (F.col("above").cast("double") / F.col("below").cast("double")).cast("decimal(38,7)").alias("value"), F.lit("computed").alias("kind")))
        both = F.array(F.struct(F.col("top").alias("part"), F.lit(1).alias("sign")), F.struct(F.col("base").alias("part"), F.lit(0).alias("sign")))
        edges = edges.unionByName(known.select("issuer", "period", "concept", F.col("period").alias("part_period"), F.inline(both)))
    return Graph(nodes, edges)


def walk(spark: SparkSession, made: Graph, roots: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every way from the roots (issuer, period, concept) down to their parts.

    Columns: root_period, root, issuer, depth, period, concept, sign (product along the
    way), side (1 above the line of a ratio or in no ratio, 0 below), path, leaf, and
    note where a walk ends at MAX_DEPTH or would come back to a node of its way.  One
    join of the frontier with the edges for each depth.
    """
    scratch = scratch or Scratch(spark, "lineage")
    edges = scratch.written(made.edges, "edges")
    key = F.concat_ws(" ", "concept", "period")
    frontier = roots.select("issuer", F.col("period").alias("root_period"), F.col("concept").alias("root"), "period", "concept", F.lit(1).alias("sign"), F.lit(1).alias("side"), F.array(key).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("note"))
    levels = []
    for depth in range(MAX_DEPTH + 1):
        parents = edges.select("issuer", "period", "concept", "part", "part_period", F.col("sign").alias("edge_sign"))
        met = frontier.join(parents, ["issuer", "period", "concept"], "left")
        step = F.concat_ws(" ", "part", "part_period")
        note = F.when(F.col("part").isNotNull() & F.array_contains("path", step), "comes back").when(F.col("part").isNotNull() & F.lit(depth == MAX_DEPTH), "cut at the greatest depth")
        met = scratch.written(met.withColumn("note", note), f"depth-{depth}")
        # a node with no part that goes on is where its walk ends
        nodes = met.groupBy(*frontier.columns[:-1]).agg(F.max("note").alias("note"), (F.count(F.when(F.col("note").isNull(), F.col("part"))) == 0).alias("leaf"))
        levels.append(nodes)
        onward = met.filter("part is not null and note is null")
        frontier = onward.select("issuer", "root_period", "root", F.col("part_period").alias("period"), F.col("part").alias("concept"), F.when(F.col("edge_sign") < 0, -F.col("sign")).otherwise(F.col("sign")).alias("sign"), F.when(F.col("edge_sign") == 0, 0).otherwise(F.col("side")).alias("side"), F.concat("path", F.array(step)).alias("path"), F.lit(depth + 1).alias("depth"), F.lit(None).cast("string").alias("note"))
        if onward.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def recomputed(ways: DataFrame, made: Graph) -> DataFrame:
    """(issuer, root_period, root, leaves, above, below, value): each root from the reported facts at its walks' ends, a ratio from both sides."""
    ends = ways.filter("leaf").join(made.nodes.select("issuer", "period", "concept", F.col("value").alias("fact")), ["issuer", "period", "concept"])
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("sign") * F.col("fact")))
    sums = ends.groupBy("issuer", "root_period", "root").agg(F.countDistinct("period", "concept").alias("leaves"), side(1).alias("above"), side(0).alias("below"))
    value = F.when(F.col("below").isNull(), F.col("above").cast("double")).otherwise(F.col("above").cast("double") / F.col("below").cast("double"))
    return sums.withColumn("value", value)
