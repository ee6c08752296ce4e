"""Deduplication in an order: first wins, last wins, best wins, and first accepted wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; an aggregation with map-side combine, so a hot key is no burden."""
    return _pick(df, keys, F.min_by, order)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, F.max_by, order)


def best_wins(df: DataFrame, keys: list[str], quality: Column, order: list[Column]) -> DataFrame:
    """The row of the highest quality of each key; of equals the last."""
    return _pick(df, keys, F.max_by, [quality, *order])


def _pick(df: DataFrame, keys: list[str], pick, order: list[Column]) -> DataFrame:
    whole = pick(F.struct(*(F.col(c) for c in df.columns)), F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(whole.alias("_row")).select("_row.*")


def pair_key(row_source: Column, row_target: Column, instruction: Column) -> list[Column]:
    """What makes two edit pairs the same: both digests and the normalized instruction, each empty if it is null."""
    return [F.trim(F.coalesce(row_source, F.lit(""))), F.trim(F.coalesce(row_target, F.lit(""))), T.normalize(F.coalesce(instruction, F.lit("")))]


def first_accepted(df: DataFrame, keys: list[str], order: list[Column], passes: Column, history: DataFrame | None = None) -> DataFrame:
    """`df` with `duplicate`: whether a row before it of the same key passed all other gates, or the key is in `history`.

    Only rows that are accepted count, so a rejected row never hides a later one. The first passing row of each key is
    found by an aggregation and joined back, which leaves no task with all rows of a hot key.
    """
    o = F.struct(*order)
    lead = df.filter(passes).groupBy(*keys).agg(F.min(o).alias("_lead"))
    out = df.join(lead, keys, "left").withColumn("duplicate", F.coalesce(F.col("_lead") < o, F.lit(False))).drop("_lead")
    if history is not None:
        out = out.join(history.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left")
        out = out.withColumn("duplicate", F.col("duplicate") | F.coalesce("_old", F.lit(False))).drop("_old")
    return out


def overlay(base: DataFrame, redo: DataFrame, key: str) -> DataFrame:
    """`base` with the rows of `redo` in place of those of the same key."""
    return base.join(redo.select(key).distinct(), key, "left_anti").unionByName(redo, allowMissingColumns=True)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def quality(*fields: Column) -> Column:
    """How many fields are neither null, empty text nor an empty list."""
    total = F.lit(0)
    for f in fields:
        text = F.coalesce(f.cast("string"), F.lit(""))
        total = total + F.when((text != "") & (text != "[]"), 1).otherwise(0)
    return total


def running(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`df` with `seq`, the place of each row within its key."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
