"""As-of and range joins of places in files: which definition a line belongs to.

The definitions of a file are one sorted array (as long as the file has definitions), so the
references of a file, however many, are looked up where they lie; no task sorts all rows of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

LAST_BODY = 200  # lines below the last definition of a file


def bodies(symbols: DataFrame) -> DataFrame:
    """(file, line, end_line, name): each line with definitions, the first name on it, to the line before the next definition."""
    firsts = symbols.where("file is not null and line is not null").groupBy("file", "line").agg(F.min("name").alias("name"))
    after = F.lead("line").over(W.partitionBy("file").orderBy("line"))  # definitions of one file
    return firsts.select("file", "line", F.coalesce(after - 1, F.col("line") + LAST_BODY).alias("end_line"), "name")


def _arrays(symbols: DataFrame) -> DataFrame:
    return bodies(symbols).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "end_line", "name"))).alias("defs"))


def preceding(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """The rows (file, line, ...) with name and def_line of the nearest definition at or above their line; nulls if there is none."""
    joined = rows.drop("name").join(_arrays(symbols), "file", "left")
    found = F.try_element_at(F.filter("defs", lambda d: d["line"] <= F.col("line")), F.lit(-1))  # the last one
    return joined.withColumn("_d", found).select(*(c for c in joined.columns if c != "defs"), F.col("_d.name").alias("name"), F.col("_d.line").alias("def_line"), F.col("_d.end_line").alias("end_line"))


def enclosing(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """As preceding, but only where the line lies within the body."""
    near = preceding(rows, symbols)
    inside = F.col("line") <= F.col("end_line")
    return near.select(*(c for c in near.columns if c not in ("name", "def_line", "end_line")), F.when(inside, F.col("name")).alias("name"), F.when(inside, F.col("def_line")).alias("def_line"))


def call_edges(refs: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
    """(file, caller, callee): distinct calls within bodies."""
    calls = refs.where(F.col("kind").isin(*kinds) & F.col("name").isNotNull()).select("file", "line", F.col("name").alias("callee"))
    return enclosing(calls, symbols).where("name is not null").select("file", F.col("name").alias("caller"), "callee").distinct()


def cross_file_calls(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_file, caller, callee, candidates, callee_file): files other than the caller's that define the callee, and which if only one does."""
    calls = call_edges(refs, symbols)
    places = symbols.where("name is not null and file is not null").select("name", "file").distinct()
    known = places.groupBy("name").agg(F.count("*").alias("files"), F.min("file").alias("least"), F.max("file").alias("greatest"))
    own = places.select(F.col("name").alias("callee"), "file").withColumn("own", F.lit(1))
    joined = calls.join(known.withColumnRenamed("name", "callee"), "callee", "left").join(own, ["callee", "file"], "left")
    others = F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0))
    # of two files one is the caller's, so the other is the least or the greatest
    other = F.when(F.col("least") != F.col("file"), F.col("least")).otherwise(F.col("greatest"))
    return joined.select(F.col("file").alias("caller_file"), "caller", "callee", others.cast("long").alias("candidates"), F.when(others == 1, other).alias("callee_file"))
