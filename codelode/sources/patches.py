"""Unified diffs as hunks, and what they do to cited lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_PAIR = re.compile(r"^---[ \t]+(\S+).*\n\+\+\+[ \t]+(\S+)", re.M)
_HUNK = re.compile(r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@", re.M)


def hunks_of(patch: str) -> list[tuple[str, int, int, int, int, int]]:
    """(file, number, old_start, old_count, new_start, new_count) of a patch; deleted files go under their old name."""
    out, heads = [], list(_PAIR.finditer(patch))
    for k, m in enumerate(heads):
        old, new = (None if p == "/dev/null" else re.sub(r"^[ab]/", "", p) for p in m.groups())
        body = patch[m.end() : heads[k + 1].start() if k + 1 < len(heads) else len(patch)]
        for n, h in enumerate(_HUNK.finditer(body)):
            a, b, c, d = h.groups()
            out.append((new or old, n, int(a), int(b or 1), int(c), int(d or 1)))
    return [r for r in out if r[0]]


def parse_patches(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file, hunk, old_start, old_count, new_start, new_count) of patches; null and empty ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *h) for k, t in zip(pdf["k"], pdf["t"]) for h in hunks_of(t or "")]
            yield pd.DataFrame(rows, columns=["k", "file", "hunk", "old_start", "old_count", "new_start", "new_count"])

    out = patches.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k string, file string, hunk int, old_start int, old_count int, new_start int, new_count int")
    return out.withColumnRenamed("k", key)


def classify_lines(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, line, status, new_line) of cited lines: at_risk within a hunk's old range, moved by the hunks before it, or unaffected.

    A hunk that only adds shifts the lines from its place on.
    """
    asked = lines.select("file", "line").distinct()
    h = hunks.select("file", "old_start", "old_count", "new_count")
    joined = asked.join(h, "file", "left")  # hunks of one file and patch are few
    last = F.col("old_start") + F.col("old_count") - 1
    within = (F.col("old_count") > 0) & F.col("line").between(F.col("old_start"), last)
    past = F.when(F.col("old_count") == 0, F.col("line") >= F.col("old_start")).otherwise(F.col("line") > last)
    sums = joined.groupBy("file", "line").agg(F.coalesce(F.bool_or(within), F.lit(False)).alias("hit"), F.coalesce(F.sum(F.when(past, F.col("new_count") - F.col("old_count"))), F.lit(0)).alias("shift"))
    status = F.when(F.col("hit"), "at_risk").when(F.col("shift") != 0, "moved").otherwise("unaffected")
    return sums.select("file", "line", status.alias("status"), F.when(~F.col("hit") & (F.col("shift") != 0), F.col("line") + F.col("shift")).cast("int").alias("new_line"))
