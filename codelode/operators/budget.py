"""Estimated sizes of texts in tokens, and as many rows as a budget holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHARACTERS_PER_TOKEN = 3.5  # a fixed value


def estimate_tokens(text: Column) -> Column:
    """0 for null, else at least 1."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / F.lit(CHARACTERS_PER_TOKEN)).cast("long") + 1))


def within_budget(rows: DataFrame, cost: str, budget: int, key: Sequence[str], *order: Column) -> DataFrame:
    """The rows of each key, in their order, whose running cost stays within the budget; the order must not have ties.

    Without a key the rows are those of one answer (a pack for one target): more than budget / least
    cost rows are never looked at, so they are limited first.
    """
    if not key:
        rows = rows.orderBy(*order).limit(budget)  # each row costs 1 at least
    spent = F.sum(cost).over(W.partitionBy(*(key or [F.lit(1)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)
