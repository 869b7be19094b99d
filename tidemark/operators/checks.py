"""Data-quality checks: each is one row of a name, a value and the limit it must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_most(name: str, df: DataFrame, value: Column, limit: float) -> DataFrame:
    """Passes if value, an aggregate over df, is no more than limit. No rows count as 0."""
    found = df.agg(F.round(F.coalesce(value.cast("double"), F.lit(0.0)), 6).alias("value"))
    return found.select(F.lit(name).alias("name"), "value", F.lit(float(limit)).alias("bound"), (F.col("value") <= limit).alias("passed"))


def at_least(name: str, df: DataFrame, value: Column, limit: float) -> DataFrame:
    found = at_most(name, df, value, limit)
    return found.withColumn("passed", F.col("value") >= limit)


def share(condition: Column) -> Column:
    """The part of rows for which a condition holds; null without rows."""
    return F.count(F.when(condition, 1)) / F.nullif(F.count("*"), F.lit(0))


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
