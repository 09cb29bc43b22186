"""Many questions for a metric of an issuer in some period, answered together by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for the last period.
LATEST = ["LATEST", "CURRENT", "MOSTRECENT"]


def plain(text: Column) -> Column:
    """A period's text without case, blanks, dashes and underscores."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[-_ ]", "")


def metric_key(text: Column) -> Column:
    """A metric's name or label as a name: lower case, other signs as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def period_names(periods: DataFrame) -> DataFrame:
    """(issuer, name, k): the period that each name stands for: its key, the last one of a year, the last one of all.

    ``periods`` has issuer, k (ascending), fy and key.
    """
    exact = periods.select("issuer", F.upper("key").alias("name"), "k")
    yearly = periods.groupBy("issuer", F.concat(F.lit("YEAR "), F.col("fy").cast("string")).alias("name")).agg(F.max("k").alias("k"))
    return exact.unionByName(yearly).unionByName(periods.groupBy("issuer").agg(F.max("k").alias("k")).select("issuer", F.lit("LAST").alias("name"), "k"))


def _asked_names(text: Column) -> Column:
    """Names to try for a period's text, the first one that is known counts."""
    name = plain(text)
    year = F.regexp_extract(F.regexp_replace(name, r"[^0-9]", ""), r"([0-9]{4})$", 1)
    any_year = F.when(year != "", F.concat(F.lit("YEAR "), year))
    return F.when((name == "") | name.isin(LATEST), F.array(F.lit("LAST"))).when(name.startswith("TTM"), F.array(F.lit("LAST"))).otherwise(F.array_compact(F.array(name, any_year)))


def period_met(reported: Column, asked: Column) -> Column:
    """Whether a reported period is the one asked for: alike without blanks and dashes; any for the last one; any trailing year for TTM."""
    left, right = plain(reported), plain(asked)
    return F.coalesce((left != "") & (right.isin(LATEST[:2]) | (left == right) | ((right == "TTM") & left.startswith("TTM"))), F.lit(False))


def answer(asked: DataFrame, periods: DataFrame, values: DataFrame, trailing: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, issuer, metric, period, value, status, period_met) of every request.

    ``asked`` has request_id, issuer, period and metric (texts); ``periods`` issuer, k, fy and
    key; ``values`` issuer, k, metric, value and reason; ``trailing`` the same of the last
    four quarters, by issuer; ``known`` the metrics that exist (a bounded list).
    A null or empty period is the last one; a year stands for its last period.
    """
    names = known.select(F.col("metric").alias("__m")).distinct()
    rows = asked.select("request_id", F.col("issuer").alias("__i"), F.col("period").alias("__p"), metric_key(F.col("metric")).alias("__k")).join(F.broadcast(names), F.col("__k") == F.col("__m"), "left")
    tried = rows.select("*", F.posexplode_outer(_asked_names(F.col("__p"))).alias("__n", "__name"))
    found = tried.join(period_names(periods).select(F.col("issuer").alias("__j"), "name", F.col("k").alias("__at")), (F.col("__i") == F.col("__j")) & (F.col("__name") == F.col("name")), "left")
    first = found.groupBy("request_id", "__i", "__p", "__m").agg(F.min(F.when(F.col("__at").isNotNull(), F.struct("__n", "__at")))["__at"].alias("k"))
    issuers = periods.select(F.col("issuer").alias("__x")).distinct()
    first = first.join(issuers, F.col("__i") == F.col("__x"), "left").withColumn("ttm", plain(F.col("__p")).startswith("TTM"))
    keys = periods.select(F.col("issuer").alias("__a"), F.col("k").alias("__b"), "fy", "key")
    first = first.join(keys, (F.col("__i") == F.col("__a")) & (F.col("k") == F.col("__b")), "left")
    quarter = values.select(F.col("issuer").alias("__qi"), F.col("k").alias("__qk"), F.col("metric").alias("__qm"), F.col("value").alias("__qv"), F.col("reason").alias("__qr"))
    year = trailing.select(F.col("issuer").alias("__yi"), F.col("metric").alias("__ym"), F.col("value").alias("__yv"), F.col("reason").alias("__yr"))
    out = first.join(quarter, (F.col("__i") == F.col("__qi")) & (F.col("k") == F.col("__qk")) & (F.col("__m") == F.col("__qm")) & ~F.col("ttm"), "left")
    out = out.join(year, (F.col("__i") == F.col("__yi")) & (F.col("__m") == F.col("__ym")) & F.col("ttm"), "left")
    period = F.when(F.col("ttm"), F.concat(F.lit("TTM"), F.col("fy").cast("string"))).otherwise(F.col("key"))
    value, reason = F.coalesce("__qv", "__yv"), F.coalesce("__qr", "__yr", F.lit("no such value"))
    status = F.when(F.col("__x").isNull(), "unknown issuer").when(F.col("k").isNull(), "unknown period").when(F.col("__m").isNull(), "unknown metric").when(value.isNull(), reason).otherwise("ok")
    there = status == "ok"
    return out.select("request_id", F.col("__i").alias("issuer"), F.col("__m").alias("metric"), period.alias("period"), F.when(there, value).alias("value"), status.alias("status"), (there & period_met(period, F.col("__p"))).alias("period_met"))
