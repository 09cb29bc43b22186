"""Reported entries to canonical facts: calendars, labels, duplicates, year-to-date spans and fourth quarters.

All steps work company by company and concept by concept, so they shuffle on
those keys; the tags (under 100) are the only side that is broadcast.  ``ordinal``
(taxonomy, tag, unit and entry in their order in the payload) decides all ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import taxonomy

KEY = ["company", "concept", "fiscal_year", "fiscal_period", "period_end"]
FACT = [*KEY, "value", "unit", "kind", "period_start", "accession", "filed", "alias_priority", "ytd_months", "source", "raw_concept", "statement", "seen"]
# Days of quarters, halves, nine months and years; drift past a month's end; days from year end to filing.
QUARTER_DAYS, HALF_DAYS, NINE_MONTH_DAYS, ANNUAL_DAYS, DRIFT_DAYS, FILING_DAYS = (75, 115), (150, 210), (240, 300), (330, 400), 10, 120


def parse_date(text: Column) -> Column:
    """The date that the first ten characters spell, else null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def classify(start: Column, end: Column) -> Column:
    """'instant' without a start, else 'quarter', 'annual', 'ytd' or null by the days between."""
    days = F.datediff(end, start)
    return F.when(start.isNull(), "instant").when(days.between(*QUARTER_DAYS), "quarter").when(days.between(*ANNUAL_DAYS), "annual").when(days.between(*HALF_DAYS) | days.between(*NINE_MONTH_DAYS), "ytd")


def dated(entries: DataFrame) -> DataFrame:
    """Entries with period_start, period_end, filed as dates, their kind of span and ordinal."""
    order = F.struct(F.when(F.col("taxonomy") == "us-gaap", 0).otherwise(1).alias("t"), "tag_at", "unit_at", "entry_at")
    out = entries.withColumns({"period_start": parse_date(F.col("start")), "period_end": parse_date(F.col("end")), "filed": parse_date(F.col("filed")), "ordinal": order})
    return out.withColumn("span", F.when(F.col("period_end").isNotNull(), classify(F.col("period_start"), F.col("period_end"))))


def calendars(rows: DataFrame) -> DataFrame:
    """(company, fye_month, year_offset, calibrated) from the annual spans of all tags; December and 0 without any.

    Each is the most frequent value, of equally frequent ones the first met: one
    count over (company, what, value) finds both.
    """
    annual, shift = F.col("span") == "annual", F.col("fy") - F.year("period_end")
    own = annual & (F.col("form") == "10-K") & F.datediff("filed", "period_end").between(1, FILING_DAYS - 1) & shift.between(-1, 1)
    vote = lambda what, v: F.struct(F.lit(what).alias("what"), v.cast("int").alias("v"))
    votes = F.array(vote("any", F.lit(0)), vote("month", F.when(annual, F.month("period_end"))), vote("shift", F.when(own, shift)))
    counts = rows.select("company", "ordinal", F.inline(votes)).filter("v is not null").groupBy("company", "what", "v").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    best = Window.partitionBy("company", "what").orderBy(F.desc("n"), "first")
    wide = counts.withColumn("rn", F.row_number().over(best)).filter("rn = 1").groupBy("company").agg(*[F.max(F.when(F.col("what") == w, F.col("v"))).alias(w) for w in ("month", "shift")])
    return wide.select("company", F.coalesce("month", F.lit(12)).cast("int").alias("fye_month"), F.coalesce("shift", F.lit(0)).cast("int").alias("year_offset"), F.col("shift").isNotNull().alias("calibrated"))


def fiscal_year_end(end: Column, fye_month: Column) -> Column:
    """The nominal end of the fiscal year that ``end`` closes into; up to DRIFT_DAYS past a year's end belong to it."""
    nominal = F.last_day(F.make_date(F.year(end), fye_month, F.lit(1)))
    late = F.datediff(end, nominal) > DRIFT_DAYS
    return F.when(late, F.last_day(F.make_date(F.year(end) + 1, fye_month, F.lit(1)))).otherwise(nominal)


def fiscal_period(end: Column, fye_month: Column, annual: Column) -> Column:
    """FY, or the quarter whose distance from the year end is nearest (within a month), else null."""
    months = F.bround(F.datediff(fiscal_year_end(end, fye_month), end) / 30.44)
    quarter = F.when(months <= 1, "Q4").when(months.between(2, 4), "Q3").when(months.between(5, 7), "Q2").when(months.between(8, 10), "Q1")
    return F.when(annual, "FY").otherwise(F.when(months >= -1, quarter))


def labelled(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    rows = rows.join(calendar, "company")
    end, month = F.col("period_end"), F.col("fye_month")
    return rows.withColumn("fiscal_year", F.year(fiscal_year_end(end, month)) + F.col("year_offset")).withColumn("fiscal_period", fiscal_period(end, month, F.col("span") == "annual"))


def candidates(rows: DataFrame, calendar: DataFrame, units: list[str] = taxonomy.UNITS, min_fiscal_year: int | None = None) -> DataFrame:
    """Facts of the entries whose tag, unit, dates and span can be used; labels come from the dates alone."""
    spark = rows.sparkSession
    tags = spark.createDataFrame(taxonomy.TAGS, "tag string, concept string, statement string, kind string, alias_priority int")
    usable = rows.filter(F.col("unit").isin(units) & F.col("val").isNotNull() & F.col("span").isNotNull() & F.col("taxonomy").isin("us-gaap", "ifrs-full")).join(F.broadcast(tags), "tag")
    usable = labelled(usable.filter((F.col("kind") == "instant") == (F.col("span") == "instant")), calendar).filter("fiscal_period is not null")
    months = F.when(F.col("span") == "ytd", F.when(F.datediff("period_end", "period_start") < 225, 6).otherwise(9)).otherwise(0)
    out = usable.select("company", "concept", "fiscal_year", "fiscal_period", "period_end", F.col("val").alias("value"), "unit", "kind", "period_start", F.col("accn").alias("accession"), "filed", "alias_priority", months.alias("ytd_months"), F.when(months > 0, "ytd-staging").otherwise("sec-edgar-xbrl").alias("source"), F.col("tag").alias("raw_concept"), "statement", F.col("ordinal").alias("seen"))
    return out if min_fiscal_year is None else out.filter(F.col("fiscal_year") >= min_fiscal_year)


def mirror_year_end(facts: DataFrame) -> DataFrame:
    """Balances of a fourth quarter stand under FY too."""
    both = F.when((F.col("kind") == "instant") & (F.col("fiscal_period") == "Q4"), F.array(F.lit("Q4"), F.lit("FY"))).otherwise(F.array("fiscal_period"))
    return facts.withColumn("fiscal_period", F.explode(both)).select(FACT)


def deduplicate(facts: DataFrame) -> DataFrame:
    """One fact a key: most trusted tag, then latest filed (none: 1900), then first met; ``seen`` is the key's first ordinal."""
    key = Window.partitionBy(*KEY)
    best = key.orderBy("alias_priority", F.desc(F.coalesce("filed", F.lit("1900-01-01").cast("date"))), "seen")
    return facts.withColumn("rn", F.row_number().over(best)).withColumn("seen", F.min("seen").over(key)).filter("rn = 1").select(FACT)


_PART = [c for c in FACT if c not in ("company", "concept", "fiscal_year")]


def _years(facts: DataFrame) -> DataFrame:
    """One row for a company's concept and fiscal year, with its facts (a few a period) in an array."""
    return facts.groupBy("company", "concept", "fiscal_year").agg(F.collect_list(F.struct(*_PART)).alias("facts"))


def _is(field: str, value, also=None):
    """A condition on a fact: its field has the value (and ``also`` holds)."""
    return lambda f: (f[field] == value) & also(f) if also else f[field] == value


def _last(condition, *order: str) -> Column:
    """The last of a year's facts, in ``order``, that meets a condition; null if none does."""
    met = F.filter("facts", condition)
    return F.array_max(F.transform(met, lambda f: F.struct(*[f[c].alias(f"o{i}") for i, c in enumerate(order)], f.alias("f"))))["f"]


def _derived(basis: Column, period: str, value: Column, start: Column, source: Column) -> Column:
    new = {"fiscal_period": F.lit(period), "value": value, "kind": F.lit("duration"), "period_start": start, "ytd_months": F.lit(0), "source": source}
    return F.struct(*[new.get(c, basis[c]).alias(c) for c in _PART])


def _with(rows: DataFrame, kept: Column, *added: Column) -> DataFrame:
    """The kept facts and those added that are not null, as rows again."""
    return rows.select("company", "concept", "fiscal_year", F.inline(F.concat(kept, F.array_compact(F.array(*added))))).select(FACT)


def difference_ytd(facts: DataFrame) -> DataFrame:
    """Quarters that are only in year-to-date spans: Q2 = 6M - Q1, Q3 = 9M - 6M (else less Q1 and Q2 as reported).

    Staged spans go.  Quarters that stand by themselves are kept as they are.
    """
    plain = lambda f: (f["kind"] == "duration") & (f["ytd_months"] == 0)
    wide = _years(facts)
    wide = wide.select("*", *[_last(_is("fiscal_period", q, plain), "seen").alias(q) for q in ("Q1", "Q2", "Q3")], *[_last(_is("ytd_months", m), "fiscal_period", "seen").alias(f"y{m}") for m in (6, 9)])
    c = F.col
    second = F.when(c("y6").isNotNull() & c("Q2").isNull() & c("Q1").isNotNull(), _derived(c("y6"), "Q2", c("y6.value") - c("Q1.value"), c("y6.period_start"), F.lit("derived-from-ytd (6M less Q1)")))
    known = c("y6").isNotNull()
    less = F.when(known, c("y6.value")).otherwise(c("Q1.value") + c("Q2.value"))
    source = F.when(known, F.lit("derived-from-ytd (9M less YTD 6M)")).otherwise(F.lit("derived-from-ytd (9M less Q1 + Q2)"))
    third = F.when(c("y9").isNotNull() & c("Q3").isNull() & less.isNotNull(), _derived(c("y9"), "Q3", c("y9.value") - less, c("y9.period_start"), source))
    return _with(wide, F.filter("facts", lambda f: f["ytd_months"] == 0), second, third)


def reconstruct_q4(facts: DataFrame) -> DataFrame:
    """Fourth quarters of flows that have a year and three quarters: the year less the three."""
    wide = _years(facts)
    wide = wide.select("*", *[_last(_is("fiscal_period", p), "seen").alias(p) for p in ("Q1", "Q2", "Q3", "Q4", "FY")])
    c = F.col
    whole = c("concept").isin(taxonomy.FLOWS) & c("Q4").isNull() & c("FY").isNotNull() & c("Q1").isNotNull() & c("Q2").isNotNull() & c("Q3").isNotNull()
    value = c("FY.value") - (c("Q1.value") + c("Q2.value") + c("Q3.value"))
    return _with(wide, c("facts"), F.when(whole, _derived(c("FY"), "Q4", value, F.date_add("Q3.period_end", 1), F.lit("derived-q4"))))


def carry_instants(facts: DataFrame, most_days: int = 200) -> DataFrame:
    """Balances for the periods that have flows but lack them: the latest earlier one, if at most ``most_days`` old.

    A company's periods, and a concept's balances, are one array each (quarters of its history).
    """
    periods = facts.filter("kind = 'duration'").groupBy("company").agg(F.collect_set(F.struct("fiscal_year", "fiscal_period", "period_end")).alias("periods"))
    series = facts.filter("kind = 'instant'").groupBy("company", "concept").agg(F.collect_list(F.struct(F.col("period_end").alias("at"), "fiscal_year", "fiscal_period", F.struct(*_PART).alias("f"))).alias("series"))
    wanted = series.join(periods, "company").select("company", "concept", "series", F.explode("periods").alias("p"))
    wanted = wanted.filter(~F.exists("series", lambda s: (s["fiscal_year"] == F.col("p.fiscal_year")) & (s["fiscal_period"] == F.col("p.fiscal_period"))))
    found = wanted.select("company", "concept", "p", F.array_max(F.filter("series", lambda s: s["at"] <= F.col("p.period_end"))).alias("x")).filter(F.datediff("p.period_end", "x.at") <= most_days)
    new = {"fiscal_year": F.col("p.fiscal_year"), "fiscal_period": F.col("p.fiscal_period"), "period_end": F.col("p.period_end"), "period_start": F.lit(None).cast("date"), "source": F.concat(F.lit("carried-forward-from-"), F.date_format("x.at", "yyyy-MM-dd"))}
    return facts.unionByName(found.select(*[(F.col(c) if c in ("company", "concept") else new[c] if c in new else F.col(f"x.f.{c}")).alias(c) for c in FACT]))


def normalise(entries: DataFrame, units: list[str] = taxonomy.UNITS, min_fiscal_year: int | None = None) -> DataFrame:
    """Entries (of sources.companyfacts, with ``company`` for their key) to facts."""
    rows = dated(entries)
    facts = candidates(rows, calendars(rows), units, min_fiscal_year)
    return reconstruct_q4(difference_ytd(deduplicate(mirror_year_end(facts))))


def filing_label(form: Column, period_end: Column, fye_month: Column, year_offset: Column) -> tuple[Column, Column]:
    """(fiscal_year, fiscal_period) of a filing: FY for a 10-K, else its quarter; by the calendar year where no fiscal calendar is known."""
    known = fye_month.isNotNull()
    year = F.when(known, F.year(fiscal_year_end(period_end, fye_month)) + year_offset).otherwise(F.year(period_end))
    quarter = F.when(known, fiscal_period(period_end, fye_month, F.lit(False))).otherwise(F.concat(F.lit("Q"), F.quarter(period_end).cast("string")))
    return year, F.when(period_end.isNotNull(), F.when(form == "10-K", F.lit("FY")).otherwise(quarter))
