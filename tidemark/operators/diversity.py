"""Choice among a search's best rows: marginal relevance over a pool that takes in one more row after each pick."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def marginal(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float, pool: int | None = None) -> list[int]:
    """Row after row the one with most weight * relevance - (1 - weight) * greatest likeness to those chosen.

    The first choice is among the first ``pool`` rows (all if None); after each the next row enters.
    """
    chosen: list[int] = []
    near = np.zeros(len(relevance))
    while len(chosen) < min(k, len(relevance)):
        score = weight * relevance - (1 - weight) * near
        score[chosen] = -np.inf
        if pool is not None:
            score[pool + len(chosen) :] = -np.inf
        best = int(np.argmax(score))
        likeness = vectors @ vectors[best]
        near = likeness if not chosen else np.maximum(near, likeness)
        chosen.append(best)
    return chosen


def choose(hits: DataFrame, query: str, row: str, relevance: str, vector: str, k: int = 8, weight: float = 0.95) -> DataFrame:
    """(query, row, place) of ``k`` hits for each query, from a pool of its max(6k, 30) most relevant, refilled after each pick."""
    size = max(6 * k, 30)
    pool = Window.partitionBy(query).orderBy(F.desc(relevance), row)
    top = hits.withColumn("__n", F.row_number().over(pool)).filter(F.col("__n") <= size + k - 1).select(query, row, F.col(relevance).cast("double").alias("__r"), F.col(vector).cast("array<double>").alias("__v"), "__n")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__n")
        at = marginal(f["__r"].to_numpy(), np.stack(f["__v"].to_numpy()), k, weight, size)
        return pd.DataFrame({query: f[query].iloc[at], row: f[row].iloc[at], "place": range(1, len(at) + 1)})

    kinds = dict(top.dtypes)
    return top.groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, {row} {kinds[row]}, place int")
