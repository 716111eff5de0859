"""The language of a file: as the index says, else by the extension of its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.plans.sizing import by_key

EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "json": "json", "css": "css"}


def language(lang: Column, path: Column) -> Column:
    """lang in lower case unless it is null, empty or `other`; then by extension; null if that is unknown."""
    said = F.lower(F.trim(lang))
    by_name = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(said.isNull() | said.isin("", "other"), by_name[ext]).otherwise(said)


def with_language(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text, lang) of the texts: the lang that files gives last (indexed_at) and is not null, else by extension.

    texts are unique by path or repeat exactly (then they come once); null paths are left out.
    """
    last = F.max(F.when(F.col("lang").isNotNull(), F.struct(F.coalesce(F.col("indexed_at"), F.lit(0.0)).alias("t"), F.col("lang").alias("lang"))))
    said = by_key(files.where("path is not null").select("path", "lang", "indexed_at"), "path").groupBy("path").agg(last.alias("x")).select("path", F.col("x.lang").alias("said"))
    # both sides by path in the session's number of partitions: lexing and parsing follow in the same tasks
    rows = by_key(texts.where("path is not null").select("path", "text"), "path").join(said, "path", "left")
    return rows.select("path", "text", language(F.col("said"), F.col("path")).alias("lang"))
