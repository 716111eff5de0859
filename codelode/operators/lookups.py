"""Point lookups, filters and search over the relations of an index.

All take DataFrames and columns named as in the index, so predicates and columns reach the scan.
`now` is a time in epoch seconds. Null names and targets never match; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import SYMBOL_SUFFIXES, ancestors, matches_any

#: Kinds of notes by their group.
GUIDANCE_KINDS = ("guidance", "constraint", "preference", "critical", "exclude")
#: The bits of roles, lowest first.
ROLE_BITS = ("def", "import", "write", "read", "generated", "test", "forward_def", "call", "new", "import_binding", "callback", "shorthand")
#: Kinds of references and their bits.
ROLES_OF_KIND = {"call": 136, "new": 264, "import_binding": 522, "callback": 1032, "shorthand": 2056, "name": 8, "extends": 8, "implements": 8}


def alive(now: float, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now)


def contains(column: Column, query: str) -> Column:
    """Substring search that ignores case; wildcards in the query are ordinary characters."""
    return F.coalesce(F.contains(F.lower(column), F.lit(query.lower())), F.lit(False))


def by_value(rows: DataFrame, column: str, value: str, **others: str | Sequence[str] | None) -> DataFrame:
    """Rows with the value, and with one of the values given for other columns (None: any)."""
    out = rows.where(F.col(column) == value)
    for name, wanted in others.items():
        if wanted is not None:
            out = out.where(F.col(name).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    return out


def unique_symbol(symbols: DataFrame, prefer_kind: str | None = None) -> DataFrame:
    """(name, symbol_id) of each name: its only symbol, or its only one of the preferred kind; null if that is ambiguous."""
    preferred = F.col("kind") == (prefer_kind or "")
    groups = symbols.where("name is not null").groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(preferred).alias("p"), F.max("symbol_id").alias("only"), F.max(F.when(preferred, F.col("symbol_id"))).alias("chosen")
    )
    return groups.select("name", F.when(F.col("p") == 1, F.col("chosen")).when(F.col("n") == 1, F.col("only")).alias("symbol_id"))


def list_annotations(annotations: DataFrame, now: float, target: str | None = None, kind: str | None = None, expired: bool = False) -> DataFrame:
    out = annotations
    if target is not None:
        out = out.where(F.col("target") == target)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return (out if expired else out.where(alive(now))).orderBy(F.desc_nulls_last("created_at"), "id")


def search_annotations(annotations: DataFrame, query: str, now: float) -> DataFrame:
    hit = contains(F.col("body"), query) | contains(F.col("target"), query) | contains(F.col("kind"), query)
    return annotations.where(hit & alive(now))


def targets_of_file(path: Column, names: Column, project: bool = True) -> Column:
    """All targets that mean a file: itself, its symbols with and without suffix, its directories, and the project."""
    ends = F.array(F.lit(""), *(F.lit(s) for s in SYMBOL_SUFFIXES))
    symbols = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.transform(ends, lambda s: F.concat(path, F.lit("#"), n, s))))
    return F.array_distinct(F.concat(F.array(path), symbols, ancestors(path), F.array(F.lit("@project")) if project else F.array().cast("array<string>")))


def annotations_of_files(annotations: DataFrame, paths: DataFrame, symbols: DataFrame, now: float) -> DataFrame:
    """(path, id) of the living notes about each path of paths: the file, its symbols, its directories."""
    names = symbols.join(paths.withColumnRenamed("path", "file"), "file", "left_semi").groupBy("file").agg(F.collect_set("name").alias("names"))
    wanted = paths.join(names.withColumnRenamed("file", "path"), "path", "left").select("path", F.explode(targets_of_file(F.col("path"), F.col("names"), project=False)).alias("target"))
    return annotations.where(alive(now)).select("id", "target").join(wanted, "target").select("path", "id").distinct()


def search(query: str, limit: int, now: float, annotations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(bucket, key, place): up to `limit` hits of each of notes, symbols and files; the limit is the feature."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1: {limit}")
    if not query.strip():
        raise ValueError("empty query")
    query = query.strip()
    notes = search_annotations(annotations, query, now).orderBy(F.desc_nulls_last("created_at"), "id").limit(limit).select(F.lit("notes").alias("bucket"), F.col("id").cast("string").alias("key"), F.col("target").alias("place"))
    names = symbols.where(contains(F.col("name"), query)).orderBy("name", "file", "kind", "line").limit(limit).select(F.lit("symbols"), "name", "file")
    paths = files.where(contains(F.col("path"), query)).orderBy("path").limit(limit).select(F.lit("files"), "path", F.coalesce("lang", F.lit("other")))
    return notes.union(names).union(paths)


def suggestions(files: DataFrame, symbols: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(kind, value): the k shortest paths and the k shortest names that contain the query."""
    paths = files.where(contains(F.col("path"), query)).select(F.lit("file").alias("kind"), F.col("path").alias("value")).orderBy(F.length("value"), "value").limit(k)
    names = symbols.where(contains(F.col("name"), query)).select(F.lit("symbol").alias("kind"), F.col("name").alias("value")).distinct().orderBy(F.length("value"), "value").limit(k)
    return paths.unionByName(names)


def locate(targets: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, found_as) for each distinct target: symbol_id, file#symbol, file:symbol, file, directory, symbol, or null."""
    asked = targets.where("target is not null").select("target").distinct()
    named = symbols.where("file is not null and name is not null").select("file", "name")
    forms = (
        symbols.where("symbol_id is not null").select(F.col("symbol_id").alias("target"), F.lit(1).alias("rank"))
        .unionByName(named.select(F.concat_ws("#", "file", "name").alias("target"), F.lit(2).alias("rank")))
        .unionByName(named.select(F.concat_ws(":", "file", "name").alias("target"), F.lit(3).alias("rank")))
        .unionByName(files.select(F.col("path").alias("target"), F.lit(4).alias("rank")))
        .unionByName(files.select(F.explode(ancestors(F.col("path"))).alias("target"), F.lit(5).alias("rank")))
        .unionByName(named.select(F.col("name").alias("target"), F.lit(6).alias("rank")))
    )
    hits = forms.join(asked, "target", "left_semi").groupBy("target").agg(F.min("rank").alias("rank"))
    names = F.create_map(*(F.lit(x) for pair in enumerate(("symbol_id", "file#symbol", "file:symbol", "file", "directory", "symbol"), 1) for x in pair))
    return asked.join(hits, "target", "left").select("target", names[F.col("rank")].alias("found_as"))


def with_roles(refs: DataFrame, mask: int) -> DataFrame:
    """References that have one of the bits of the mask."""
    return refs.where(F.col("roles").bitwiseAND(F.lit(mask)) != 0)


def describe_roles(roles: Column) -> Column:
    """The names of the bits that are set, lowest first."""
    return F.filter(F.array(*(F.when(roles.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(ROLE_BITS))), lambda x: x.isNotNull())


def roles_of_kind(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES_OF_KIND.items() for x in pair))[kind], F.lit(0))


def covering_targets(paths: DataFrame, annotations: DataFrame, now: float, kinds: Sequence[str] = ("exclude",)) -> DataFrame:
    """(path, id, scope) of living notes of the kinds on a path, a directory above it, or the project."""
    notes = annotations.where(F.col("kind").isin(list(kinds)) & alive(now)).select("id", "target")
    wanted = paths.where("path is not null").select("path", F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("target"))
    scope = F.when(F.col("target") == F.col("path"), "file").otherwise("dir")
    return wanted.join(notes, "target").select("path", "id", scope.alias("scope"))


def project_notes(annotations: DataFrame, now: float, kinds: Sequence[str]) -> DataFrame:
    """(id) of living notes of the kinds on the whole project; they cover every path, so they aren't joined to paths."""
    return annotations.where((F.col("target") == "@project") & F.col("kind").isin(list(kinds)) & alive(now)).select("id")


def recent_edits(edits: DataFrame, session: str | None = None, since: float | None = None, last: int | None = None) -> DataFrame:
    """Edits of a session, from a time on, or the last n; newest first."""
    out = edits
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    out = out.orderBy(F.desc_nulls_last("ts"), "path", "new_hash")
    return out if last is None else out.limit(last)


def reference_sites(refs: DataFrame, name: str, examples: int = 5) -> DataFrame:
    """(name, total, file, line): the first sites of references by a name, with the count of all."""
    hits = refs.where(F.col("name") == name)
    total = hits.count()
    return hits.where("file is not null").select("file", "line").distinct().orderBy("file", "line").limit(examples).select(F.lit(name).alias("name"), F.lit(total).cast("long").alias("total"), "file", "line")


def symbol_references(symbols: DataFrame, refs: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """(what, file, line): definitions of a name (in a file), and references bound to them, or by name if none is bound."""
    defs = symbols.where(F.col("name") == name)
    if file is not None:
        defs = defs.where(F.col("file") == file)
    uses = refs.where(F.col("name") == name)
    bound = uses.join(defs.where("symbol_id is not null").select(F.col("symbol_id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
    chosen = bound if not bound.isEmpty() else uses
    return defs.select(F.lit("def").alias("what"), "file", "line").distinct().unionByName(chosen.select(F.lit("ref").alias("what"), "file", "line"))


def list_files(files: DataFrame, patterns: Sequence[str], lang: str | None, limit: int) -> DataFrame:
    """(path, lang, matched, total): the first `limit` matching paths, with the counts before the limit."""
    hit = matches_any(F.col("path"), list(patterns)) if patterns else F.lit(True)
    if lang is not None:
        hit = hit & F.coalesce(F.col("lang") == lang, F.lit(False))
    total, matched = files.agg(F.count("*"), F.count_if(hit)).first()
    return files.where(hit).select("path", "lang", F.lit(matched).cast("long").alias("matched"), F.lit(total).cast("long").alias("total")).orderBy("path").limit(limit)
