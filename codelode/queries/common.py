"""What the queries over an index share: the time they are asked at, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.sources.index import Index

#: The time at which the queries ask what is alive or recent (epoch seconds).
AS_OF = 1_766_000_000.0
DAY = 86_400.0

SQL = {
    "files": """files AS (SELECT path, indexed_at, hash, mtime, size, lang, parser, stale, lifeline_id FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, hash DESC NULLS LAST, mtime DESC NULLS LAST, size DESC NULLS LAST,
    lang DESC NULLS LAST, parser DESC NULLS LAST, stale DESC NULLS LAST, lifeline_id DESC NULLS LAST) AS rn FROM main.files WHERE path IS NOT NULL) WHERE rn = 1)""",
    "symbols": """symbols AS (SELECT DISTINCT file, name, kind, line, symbol_id FROM symbol_snapshots WHERE label = (
  SELECT label FROM snapshot_labels WHERE label IS NOT NULL AND taken_at IS NOT NULL GROUP BY label ORDER BY max(taken_at) DESC, label DESC LIMIT 1))""",
    "labels": """labels AS (SELECT label, row_number() OVER (ORDER BY max(taken_at), label) AS pos FROM snapshot_labels
  WHERE label IS NOT NULL AND taken_at IS NOT NULL GROUP BY label)""",
    "refs": "refs AS (SELECT DISTINCT * FROM main.refs)",
    "edges": "edges AS (SELECT DISTINCT * FROM main.edges)",
    "annotations": "annotations AS (SELECT DISTINCT * FROM main.annotations)",
    "events": "events AS (SELECT DISTINCT * FROM file_event)",
    "leases": "leases AS (SELECT DISTINCT * FROM edit_lease)",
    "edits": "edits AS (SELECT DISTINCT * FROM file_edits)",
}


def sql(body: str, *relations: str) -> str:
    """The body with the relations it uses defined before it; more relations may follow as `name AS (...)`."""
    return "WITH " + ",\n".join(SQL.get(r, r) for r in relations) + "\n" + body


def ancestors_sql(path: str) -> str:
    """The directories of a path with a final slash, as a list."""
    return f"list_transform(range(1, len(string_split({path}, '/'))), lambda i: array_to_string(list_slice(string_split({path}, '/'), 1, i), '/') || '/')"


def registry():
    """(queries, oracle, decorator): the decorator registers a function of an index under its name, with its SQL (None: none)."""
    queries: dict = {}
    oracle: dict = {}

    def query(text: str | None, *relations: str):
        def register(f):
            def call(spark: SparkSession, base: str) -> DataFrame:
                return f(Index(spark, base))

            queries[f.__name__] = call
            if text is not None:
                oracle[f.__name__] = sql(text, *relations) if relations else text
            return f

        return register

    return queries, oracle, query
