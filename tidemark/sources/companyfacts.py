"""Company fact payloads (JSON) as rows, with the order of their tags, units and entries kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "struct<start:string,end:string,val:double,fy:int,fp:string,form:string,accn:string,filed:string>"
SCHEMA = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"


def entries(payloads: DataFrame, key: str = "cik", body: str = "body") -> DataFrame:
    """One row per reported entry: key, taxonomy, tag, unit, the entry's fields and tag_at, unit_at, entry_at.

    A null or unreadable payload gives no rows; an instant has a null start.
    """
    rows = payloads.select(key, F.from_json(body, SCHEMA)["facts"].alias("f")).select(key, F.explode("f").alias("taxonomy", "tags"))
    rows = rows.select(key, "taxonomy", F.posexplode("tags").alias("tag_at", "tag", "t"))
    rows = rows.select(key, "taxonomy", "tag_at", "tag", F.posexplode("t.units").alias("unit_at", "unit", "e"))
    return rows.select(key, "taxonomy", "tag_at", "tag", "unit_at", "unit", F.posexplode("e").alias("entry_at", "x")).select("*", "x.*").drop("x")


def tickers(payload: DataFrame, body: str = "body") -> DataFrame:
    """(ticker, cik, name) of a ticker index; cik has ten digits."""
    rows = payload.select(F.explode(F.from_json(body, "map<string,struct<ticker:string,cik_str:long,title:string>>")).alias("k", "v"))
    return rows.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik"), F.col("v.title").alias("name"))
