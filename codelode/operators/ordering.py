"""Pages, first-wins duplicates, top rows of groups, last states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page of a total order; sizes are cut to ``most``."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 20, by: list[str] | None = None) -> DataFrame:
    """Rows and pages, for each group if any."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return top_of(df, keys, 1, *order)


def top_of(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def running_budget(df: DataFrame, size: Column, cap: int, keys: list[str], *order: Column) -> DataFrame:
    """Rows of each key while their running size stays within the cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= cap)


def min_max(value: Column, *keys: str) -> Column:
    """Value scaled to [0, 1] within its group; 1 if all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))
