"""Problem 6: per-key results where a few keys hold most rows.

Everything is an algebraic aggregate in two steps: by (key, other) first, then by key. Each step
is combined in the map tasks, so a key with a third of all rows reaches the shuffle as one partial
row per task, and no task reads the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def once(rows: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """One row per id, the largest tuple of columns if repeated rows differ; rows with a null id are left out."""
    best = F.max(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))))
    return rows.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(best.alias("x")).select("id", *(F.col(f"x.c{i}").alias(c) for i, c in enumerate(columns)))


def key_profile(rows: DataFrame, key: str, other: str, key_as: str = "key") -> DataFrame:
    """(key, rows, others): rows and distinct non-null values of `other` for each non-null key; empty for no rows."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), F.col(other).alias("o")).agg(F.count("*").alias("n"))
    return pairs.groupBy("k").agg(F.sum("n").alias("rows"), F.count("o").alias("others")).select(F.col("k").alias(key_as), "rows", "others")


def heavy_keys(rows: DataFrame, fields: Sequence[str], share: float = 0.01) -> DataFrame:
    """(field, hot_key, rows): values that hold at least `share` of the rows in which their field is not null.

    The rows are read and shuffled once for all fields; ties with the share are in; nulls never count.
    """
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("hot_key")) for f in fields)))
    counts = rows.select(named.alias("x")).select("x.*").where("hot_key is not null").groupBy("field", "hot_key").agg(F.count("*").alias("rows"))
    totals = counts.groupBy("field").agg(F.sum("rows").alias("total"))
    # one total per field: as small as the list of fields
    return counts.join(F.broadcast(totals), "field").where(F.col("rows") >= F.col("total") * F.lit(share)).select("field", "hot_key", "rows")
