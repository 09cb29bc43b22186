"""Ratio registry: formula, unit, guarded input and polarity, as SQL over a period row."""

from __future__ import annotations

import re
from typing import NamedTuple

from .text import fixed_spark


class Ratio(NamedTuple):
    name: str
    numerator: str
    denominator: str
    scale: str
    guard: str | None
    higher_is_better: bool | None


# Names, formulas, scales, guards and polarity of the ratios.
# ``a`` is the annualisation factor of the period, ``days`` its length.
_DAYS = "days"
RATIOS = [
    Ratio("debt_to_ebitda", "total_debt", "(ebitda * a)", "1", "ebitda", False),
    Ratio("net_debt_to_ebitda", "net_debt", "(ebitda * a)", "1", "ebitda", False),
    Ratio("debt_to_equity", "total_debt", "total_equity", "1", "total_equity", False),
    Ratio("debt_to_assets", "total_debt", "total_assets", "100", "total_assets", False),
    Ratio("debt_to_capital", "total_debt", "(total_debt + total_equity)", "100", None, False),
    Ratio("liabilities_to_assets", "total_liabilities", "total_assets", "100", "total_assets", False),
    Ratio("ebitda_interest_coverage", "ebitda", "abs(interest_expense)", "1", "interest_expense", True),
    Ratio("ebit_interest_coverage", "ebit", "abs(interest_expense)", "1", "interest_expense", True),
    Ratio("fcf_interest_coverage", "free_cash_flow", "abs(interest_expense)", "1", "interest_expense", True),
    Ratio("average_cost_of_debt", "(abs(interest_expense) * a)", "total_debt", "100", "total_debt", False),
    Ratio("current_ratio", "current_assets", "current_liabilities", "1", "current_liabilities", True),
    Ratio("quick_ratio", "(current_assets - inventory)", "current_liabilities", "1", "current_liabilities", True),
    Ratio("cash_ratio", "cash_and_investments", "current_liabilities", "1", "current_liabilities", True),
    Ratio("cash_to_debt", "cash_and_investments", "total_debt", "100", "total_debt", True),
    Ratio("gross_margin", "gross_profit", "revenue", "100", "revenue", True),
    Ratio("operating_margin", "operating_income", "revenue", "100", "revenue", True),
    Ratio("ebitda_margin", "ebitda", "revenue", "100", "revenue", True),
    Ratio("net_margin", "net_income", "revenue", "100", "revenue", True),
    Ratio("return_on_assets", "(net_income * a)", "total_assets", "100", "total_assets", True),
    Ratio("return_on_equity", "(net_income * a)", "total_equity", "100", "total_equity", True),
    Ratio("return_on_invested_capital", "(ebit * (1 - CASE WHEN pretax_income <= 0 THEN 0.21 ELSE least(greatest(income_tax_expense / nullif(pretax_income, 0), 0), 0.6) END) * a)", "(total_debt + total_equity)", "100", None, True),
    Ratio("ocf_margin", "operating_cash_flow", "revenue", "100", "revenue", True),
    Ratio("fcf_margin", "free_cash_flow", "revenue", "100", "revenue", True),
    Ratio("fcf_conversion", "free_cash_flow", "ebitda", "100", "ebitda", True),
    Ratio("cfo_to_debt", "(operating_cash_flow * a)", "total_debt", "100", "total_debt", True),
    Ratio("capex_to_revenue", "capex", "revenue", "100", "revenue", None),
    Ratio("asset_turnover", "(revenue * a)", "total_assets", "1", "total_assets", True),
    Ratio("days_sales_outstanding", "accounts_receivable", "revenue", _DAYS, "revenue", False),
    Ratio("days_inventory", "inventory", "cost_of_revenue", _DAYS, "cost_of_revenue", False),
]
BY_NAME = {r.name: r for r in RATIOS}


#: Words of the formulas that are no concepts.
_NOT_INPUTS = {"a", "days", "abs", "case", "when", "then", "else", "end", "least", "greatest", "nullif"}


def inputs(r: Ratio) -> list[str]:
    """Concepts of a ratio in the order of its formula."""
    if r.name == "return_on_invested_capital":
        return ["ebit", "income_tax_expense", "pretax_income", "total_debt", "total_equity"]
    found = re.findall(r"[a-z_]+", f"{r.numerator} {r.denominator}".lower())
    return [w for w in dict.fromkeys(found) if w not in _NOT_INPUTS]


def value_sql(r: Ratio) -> str:
    """The ratio, or null where an input is missing, its guarded input is not positive or its denominator is zero."""
    have = " AND ".join([f"{c} IS NOT NULL" for c in inputs(r)] + ([f"{r.guard} > 0"] if r.guard else []))
    return f"CASE WHEN {have} THEN {r.numerator} / nullif({r.denominator}, 0) * {r.scale} END"


def reason_sql(r: Ratio, whole: str = "format('{{:,.0f}}', CAST({0} AS DOUBLE))") -> str:
    """Why a ratio is null, else 'ok'; ``whole`` spells a number without decimals."""
    missing = " || ".join(f"CASE WHEN {c} IS NULL THEN ', {c}' ELSE '' END" for c in inputs(r))
    absent = " OR ".join(f"{c} IS NULL" for c in inputs(r))
    guard = f"WHEN {r.guard} <= 0 THEN '{r.guard} is ' || {whole.format(r.guard)} || '; the ratio is not economically meaningful with a non-positive denominator' " if r.guard else ""
    return f"CASE WHEN {absent} THEN 'missing inputs: ' || substr({missing}, 3) {guard}WHEN {r.denominator} = 0 THEN 'division by zero' ELSE 'ok' END"


def display_sql(value: str, unit: str) -> str:
    """A ratio as text, by its unit; null is n/a."""
    spelled = {"%": f"printf('%.1f%%', {value})", "x": f"printf('%.2fx', {value})", "days": f"printf('%.0f days', {value})"}[unit]
    return f"CASE WHEN {value} IS NULL THEN 'n/a' ELSE {spelled} END"


def display_spark(value: str, unit: str) -> str:
    """The same in Spark."""
    places, tail = {"%": (1, "%"), "x": (2, "x"), "days": (0, " days")}[unit]
    return f"coalesce(concat({fixed_spark(value, places)}, '{tail}'), 'n/a')"


def unit(r: Ratio) -> str:
    return {"100": "%", "days": "days"}.get(r.scale, "x")


# Weight and score curve (ratio, score) of each scorecard factor; composite floors of the rating bands.
FACTORS = [
    ("debt_to_ebitda", 0.18, [(0, 100), (1, 92), (2, 80), (3, 66), (4, 52), (5, 40), (6, 28), (8, 12), (12, 0)]),
    ("debt_to_capital", 0.12, [(0, 100), (20, 88), (35, 74), (50, 58), (65, 40), (80, 22), (95, 5)]),
    ("ebitda_interest_coverage", 0.15, [(0, 0), (1, 15), (2, 32), (3, 48), (5, 65), (8, 80), (15, 92), (30, 100)]),
    ("fcf_interest_coverage", 0.10, [(-5, 0), (0, 20), (1, 40), (2, 56), (4, 72), (8, 88), (15, 100)]),
    ("cfo_to_debt", 0.09, [(-10, 0), (0, 12), (10, 35), (20, 55), (35, 74), (60, 90), (100, 100)]),
    ("fcf_margin", 0.06, [(-20, 0), (-5, 20), (0, 40), (5, 58), (12, 76), (20, 90), (35, 100)]),
    ("current_ratio", 0.07, [(0.5, 5), (0.8, 25), (1, 45), (1.3, 62), (1.8, 80), (2.5, 92), (4, 100)]),
    ("cash_to_debt", 0.08, [(0, 5), (10, 28), (25, 50), (50, 70), (100, 88), (200, 100)]),
    ("ebitda_margin", 0.08, [(-10, 0), (0, 18), (8, 38), (15, 55), (25, 74), (40, 90), (60, 100)]),
    ("return_on_assets", 0.07, [(-15, 0), (0, 22), (3, 42), (6, 60), (10, 78), (18, 92), (30, 100)]),
]
BANDS = [(88, "aa or higher"), (78, "a"), (66, "bbb"), (56, "bb"), (44, "b"), (0, "ccc or lower")]


def interpolate_sql(x: str, anchors: list[tuple[float, float]]) -> str:
    """Piecewise linear through ascending anchors, clamped at both ends; null stays null."""
    parts = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {x} <= {anchors[0][0]} THEN {anchors[0][1]}"]
    for (a, s), (b, t) in zip(anchors, anchors[1:], strict=False):
        parts.append(f"WHEN {x} <= {b} THEN {s} + ({x} - {a}) * {(t - s) / (b - a)}e0")
    return f"CASE {' '.join(parts)} ELSE {anchors[-1][1]} END"


def band_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {floor} THEN '{name}'" for floor, name in BANDS) + " END"
