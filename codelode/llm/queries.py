"""Queries of the problems over texts, over their whole tables. None has an oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm.lang import with_language
from codelode.llm.origin import file_origins
from codelode.llm.packing import pack
from codelode.llm.prose import not_prose, text_statistics
from codelode.llm.syntax import broken_files, broken_rates
from codelode.llm.tokens import encode_corpus
from codelode.plans.scratch import cut
from codelode.sources.tables import table

CAPACITY = 4096  # tokens of a context window of problem 9


def _sources(spark: SparkSession, base: str) -> DataFrame:
    return with_language(table(spark, base, "file_texts"), table(spark, base, "files"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return broken_files(_sources(spark, base))


def p3_rates(spark: SparkSession, base: str) -> DataFrame:
    return broken_rates(_sources(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return file_origins(_sources(spark, base)).where("kind is not null").select("path").distinct()


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_corpus(table(spark, base, "documents"))


def p9_windows(spark: SparkSession, base: str) -> DataFrame:
    sizes = encode_corpus(table(spark, base, "documents")).select("doc_id", F.size("ids").alias("tokens"))
    return pack(cut(sizes), CAPACITY)  # pack reads its items twice


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return not_prose(table(spark, base, "documents"))


def p10_statistics(spark: SparkSession, base: str) -> DataFrame:
    return text_statistics(table(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p5_found": p5_found,
    "p8_ids": p8_ids,
    "p9_windows": p9_windows,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

ORACLE: dict[str, str] = {}
