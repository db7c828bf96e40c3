"""Top k, latest, budgets: everything that needs an order, each with its tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups down before the shuffle."""
    return ranked(df, by, order, out).filter(F.col(out) <= k)


def latest(df: DataFrame, by: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key, the smaller tie value of equals; combined before the shuffle, so no group is sorted."""
    row = F.struct(*df.columns)
    best = df.groupBy(*by).agg(F.max_by(row, F.struct(F.col(when), (-F.col(tie)).alias("t"))).alias("_row"))
    return best.select("_row.*")


def budgeted(df: DataFrame, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """df with taken (within the first `budget` of its group) and skipped (how many of the group are not)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return ranked(df, by, order).withColumn("taken", F.col("rank") <= budget).withColumn("skipped", F.greatest(F.lit(0), n - budget))


def running_budget(df: DataFrame, by: list[str], order: list[Column], want: Column, each: int, total: int) -> DataFrame:
    """df with shown: in order, each row gets `each` at most of what is left of `total`."""
    capped = F.least(F.lit(each), want)
    before = F.coalesce(F.sum(capped).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("shown", F.greatest(F.lit(0), F.least(capped, total - before)))
