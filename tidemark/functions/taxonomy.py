"""Canonical concepts and the reported tags that stand for them."""

from __future__ import annotations

# Concept, statement, kind of period, and its tags in order of trust.
CONCEPTS = [
    ("revenue", "income", "duration", ["RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet"]),
    ("cost_of_revenue", "income", "duration", ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"]),
    ("gross_profit", "income", "duration", ["GrossProfit"]),
    ("rd_expense", "income", "duration", ["ResearchAndDevelopmentExpense"]),
    ("sga_expense", "income", "duration", ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"]),
    ("operating_income", "income", "duration", ["OperatingIncomeLoss"]),
    ("depreciation_amortization", "cashflow", "duration", ["DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization", "DepreciationAmortizationAndOther"]),
    ("depreciation_only", "cashflow", "duration", ["Depreciation", "DepreciationNonproduction"]),
    ("amortization_intangibles", "cashflow", "duration", ["AmortizationOfIntangibleAssets", "AmortizationOfAcquisitionCosts"]),
    ("interest_expense", "income", "duration", ["InterestExpense", "InterestExpenseDebt", "InterestAndDebtExpense", "InterestExpenseBorrowings", "InterestExpenseNonoperating", "InterestExpenseOther", "InterestIncomeExpenseNet"]),
    ("pretax_income", "income", "duration", ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"]),
    ("income_tax_expense", "income", "duration", ["IncomeTaxExpenseBenefit"]),
    ("net_income", "income", "duration", ["NetIncomeLoss", "ProfitLoss"]),
    ("eps_diluted", "income", "duration", ["EarningsPerShareDiluted"]),
    ("cash_and_equivalents", "balance", "instant", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
    ("short_term_investments", "balance", "instant", ["ShortTermInvestments", "AvailableForSaleSecuritiesDebtSecuritiesCurrent", "MarketableSecuritiesCurrent"]),
    ("accounts_receivable", "balance", "instant", ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"]),
    ("inventory", "balance", "instant", ["InventoryNet", "InventoryFinishedGoods"]),
    ("current_assets", "balance", "instant", ["AssetsCurrent"]),
    ("total_assets", "balance", "instant", ["Assets"]),
    ("goodwill", "balance", "instant", ["Goodwill"]),
    ("intangible_assets", "balance", "instant", ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"]),
    ("accounts_payable", "balance", "instant", ["AccountsPayableCurrent", "AccountsPayableTradeCurrent"]),
    ("current_liabilities", "balance", "instant", ["LiabilitiesCurrent"]),
    ("short_term_debt", "balance", "instant", ["DebtCurrent", "ShortTermBorrowings", "LongTermDebtCurrent", "NotesPayableCurrent", "OtherShortTermBorrowings", "CommercialPaper"]),
    ("long_term_debt", "balance", "instant", ["LongTermDebtNoncurrent", "LongTermNotesPayable", "SeniorNotesNoncurrent", "OtherLongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations", "UnsecuredDebt", "LongTermDebt"]),
    ("total_debt_reported", "balance", "instant", ["DebtLongtermAndShorttermCombinedAmount"]),
    ("operating_lease_liability", "balance", "instant", ["OperatingLeaseLiabilityNoncurrent", "OperatingLeaseLiability"]),
    ("total_liabilities", "balance", "instant", ["Liabilities"]),
    ("total_equity", "balance", "instant", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    ("retained_earnings", "balance", "instant", ["RetainedEarningsAccumulatedDeficit"]),
    ("operating_cash_flow", "cashflow", "duration", ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]),
    ("capex", "cashflow", "duration", ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]),
    ("investing_cash_flow", "cashflow", "duration", ["NetCashProvidedByUsedInInvestingActivities"]),
    ("financing_cash_flow", "cashflow", "duration", ["NetCashProvidedByUsedInFinancingActivities"]),
    ("dividends_paid", "cashflow", "duration", ["PaymentsOfDividendsCommonStock", "PaymentsOfDividends"]),
    ("share_repurchase", "cashflow", "duration", ["PaymentsForRepurchaseOfCommonStock"]),
]
# Long-term debt tags that hold the current part too; derived concepts that are flows; accepted units.
INCLUSIVE_DEBT_TAGS = ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"]
DERIVED_FLOWS = ["ebitda", "ebit", "free_cash_flow"]
UNITS = ["USD", "USD/shares", "shares"]

#: (tag, concept, statement, kind, alias_priority); a tag keeps its first concept.
TAGS = [(tag, concept, statement, kind, rank) for concept, statement, kind, tags in CONCEPTS for rank, tag in enumerate(tags)]
FLOWS = [c for c, _, kind, _ in CONCEPTS if kind == "duration"] + DERIVED_FLOWS


def resolve(tag: str) -> tuple[str, int] | None:
    """The concept of a tag and its place among the concept's tags, or None."""
    return next(((c, rank) for t, c, _, _, rank in TAGS if t == tag), None)


def is_flow(concept: str) -> bool:
    """Flows add up over periods; stocks stand at a date."""
    return concept in FLOWS


def values_sql() -> str:
    """The tags as the rows of a VALUES list."""
    return ", ".join(f"('{t}', '{c}', '{s}', '{k}', {r})" for t, c, s, k, r in TAGS)
