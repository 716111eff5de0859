"""What belongs to one target: excerpts, consumers, findings and a pack of it all as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import is_test, matches_segments
from codelode.operators.lookups import alive

#: Macros by which native code gives functions to scripts, and included headers.
BINDING = r"SetMethod\w*\(\s*[\w>.\-]+\s*,\s*(?:[\w>.\-]+\s*,\s*)?\"(\w+)\"\s*,\s*(?:\w+::)*(\w+)"
INCLUDE = r"(?m)^\s*#\s*include\s+\"([^\"\n]+)\""


def excerpts(places: DataFrame, texts: DataFrame, most_lines: int, most_characters: int) -> DataFrame:
    """(file, line, text): the lines from each place on, at most so many and so long; places beyond the text give no row."""
    split = texts.where("text is not null").select(F.col("path").alias("file"), F.split("text", "\n").alias("ls"))
    joined = places.where("line >= 1").select("file", "line").distinct().join(split, "file").where(F.col("line") <= F.size("ls"))
    return joined.select("file", "line", F.substring(F.array_join(F.slice("ls", F.col("line"), most_lines), "\n"), 1, most_characters).alias("text"))


def body_hashes(bodies: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, name, line, hash): SHA-1 of the lines of each body (file, name, line, end_line)."""
    split = texts.where("text is not null").select(F.col("path").alias("file"), F.split("text", "\n").alias("ls"))
    joined = bodies.where("line >= 1 and end_line >= line").join(split, "file").where(F.col("line") <= F.size("ls"))
    body = F.array_join(F.slice("ls", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    return joined.select("file", "name", "line", F.sha1(F.encode(body, "UTF-8")).alias("hash"))


def consumers(edges: DataFrame, texts: DataFrame, target: str, name: str) -> DataFrame:
    """(file, hits): files that import the target, and how often they have the name as a whole word."""
    importers = edges.where((F.col("dst") == target) & (F.col("type") == "imports") & F.col("src").isNotNull()).select(F.col("src").alias("path")).distinct()
    return texts.join(importers, "path", "left_semi").where("text is not null").select(F.col("path").alias("file"), F.regexp_count("text", F.lit(rf"\b{name}\b")).alias("hits"))


def includes(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, dst): quoted includes of C files: beside the file, else from the root of its repository; null if neither is indexed."""
    found = texts.where("text is not null").select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(1)))).alias("spec"))
    beside = F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "spec")
    root = F.concat(F.substring_index("path", "/", 1), F.lit("/"), "spec")
    known = files.select(F.col("path").alias("dst")).distinct()
    near = found.withColumn("a", beside).withColumn("b", root)
    near = near.join(known.select(F.col("dst").alias("a"), F.lit(True).alias("ha")), "a", "left").join(known.select(F.col("dst").alias("b"), F.lit(True).alias("hb")), "b", "left")
    return near.select("path", "spec", F.when(F.col("ha"), F.col("a")).when(F.col("hb"), F.col("b")).alias("dst"))


def native_bindings(texts: DataFrame) -> DataFrame:
    """(path, js_name, cpp_name) of functions that native code gives to scripts by macros."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(BINDING), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(BINDING), F.lit(2)).alias("b"))
    return texts.where("text is not null").select("path", F.explode(both).alias("x")).select("path", F.col("x.a").alias("js_name"), F.col("x.b").alias("cpp_name")).distinct()


def matching_skills(paths: DataFrame, lifelines: DataFrame, skills: DataFrame, attachments: DataFrame) -> DataFrame:
    """(path, name, via) of enabled skills (id, name, scope_pattern, enabled) that match a path by pattern or are attached to its lifeline.

    The patterns are a short list that people keep; they are compiled on the driver.
    """
    patterns = skills.where("enabled = 1 and scope_pattern is not null").select("name", "scope_pattern").collect()
    hits: list[Column] = [F.when(matches_segments(F.col("path"), r["scope_pattern"]), F.lit(r["name"])) for r in patterns]
    by_pattern = paths.select("path", F.explode(F.filter(F.array(*hits) if hits else F.array().cast("array<string>"), lambda x: x.isNotNull())).alias("name")).withColumn("via", F.lit("pattern"))
    pinned = attachments.join(skills.where("enabled = 1").select(F.col("id").alias("skill_id"), "name"), "skill_id").join(lifelines.select(F.col("id").alias("lifeline_id"), F.col("current_path").alias("path")), "lifeline_id").join(paths.select("path"), "path", "left_semi").select("path", "name", F.lit("attached").alias("via"))
    return by_pattern.unionByName(pinned).distinct()


def trail(log: DataFrame, target: str, limit: int, column: str = "target", time: str = "created_at") -> DataFrame:
    """The newest rows about a target or something within it (`target#...`); the limit is the feature."""
    return log.where((F.col(column) == target) | F.col(column).startswith(target + "#")).orderBy(F.desc_nulls_last(time), "id").limit(limit)


def relevant_entrypoints(entrypoints: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(path, kind) of entrypoints that are the target or import it."""
    users = edges.where((F.col("dst") == target) & (F.col("type") == "imports")).select(F.col("src").alias("path")).distinct()
    own = entrypoints.where(F.col("path") == target)
    return own.unionByName(entrypoints.join(users, "path", "left_semi")).distinct()


def refresh_list(stale: DataFrame, most: int) -> DataFrame:
    """(path) of stale files if there are at most so many, else none: then the whole index is due."""
    return stale.select("path") if stale.count() <= most else stale.select("path").limit(0)


def seeds(ranked: Sequence[tuple[str, DataFrame]], annotations: DataFrame, most: int) -> DataFrame:
    """(reason, target, score): the highest scores over several rankings (target, score) whose target has no note yet."""
    out = None
    for reason, df in ranked:
        one = df.select(F.lit(reason).alias("reason"), "target", "score")
        out = one if out is None else out.unionByName(one)
    noted = annotations.where("target is not null").select("target").distinct()
    return out.join(noted, "target", "left_anti").orderBy(F.desc("score"), "reason", "target").limit(most).select("reason", "target", "score")


def pack(target: str, symbols: DataFrame, refs: DataFrame, edges: DataFrame, annotations: DataFrame, now: float) -> DataFrame:
    """(section, item): what there is about a file: its symbols, what it imports, what imports it, tests among those, and living notes."""
    own = symbols.where((F.col("file") == target) & F.col("name").isNotNull()).select(F.lit("symbols").alias("section"), F.col("name").alias("item"))
    imports = edges.where("type = 'imports'")
    out = imports.where(F.col("src") == target).select(F.lit("imports").alias("section"), F.col("dst").alias("item"))
    users = imports.where(F.col("dst") == target).select(F.lit("importers").alias("section"), F.col("src").alias("item"))
    tests = users.where(is_test(F.col("item"))).select(F.lit("tests").alias("section"), "item")
    called = refs.where((F.col("file") == target) & F.col("name").isNotNull()).select(F.lit("refers_to").alias("section"), F.col("name").alias("item"))
    about = annotations.where(alive(now) & ((F.col("target") == target) | F.col("target").startswith(target + "#"))).select(F.lit("notes").alias("section"), F.col("id").cast("string").alias("item"))
    return own.unionByName(out).unionByName(users).unionByName(tests).unionByName(called).unionByName(about).where("item is not null").distinct()


def pack_markdown(target: str, rows: DataFrame, most: int = 25) -> str:
    """A pack as Markdown, the first items of each section and how many more there are."""
    counts = {r["section"]: r["n"] for r in rows.groupBy("section").agg(F.count("*").alias("n")).collect()}
    lines = [f"# {target}"]
    for section in sorted(counts):
        first = [r["item"] for r in rows.where(F.col("section") == section).orderBy("item").limit(most).collect()]
        lines += ["", f"## {section}", *(f"- {x}" for x in first)]
        if counts[section] > most:
            lines.append(f"- and {counts[section] - most} more")
    return "\n".join(lines) + "\n"


def completeness(target: str, symbols: DataFrame, edges: DataFrame, files: DataFrame, annotations: DataFrame) -> DataFrame:
    """(finding, items): what may make answers about a file incomplete."""
    users = edges.where((F.col("dst") == target) & (F.col("type") == "imports")).select(F.col("src").alias("path")).distinct()
    parts = {
        "regex_consumers": users.join(files.where("parser = 'regex'").select("path"), "path", "left_semi"),
        "unindexed_consumers": users.where("path is not null").join(files.select("path"), "path", "left_anti"),
        "unresolved_imports": edges.where((F.col("src") == target) & (F.col("type") == "imports") & F.col("dst").startswith("module:")).select("dst"),
        "ambiguous_names": symbols.where("name is not null").groupBy("name").agg(F.count_distinct("file").alias("n"), F.max((F.col("file") == target).cast("int")).alias("own")).where("n > 1 and own = 1"),
        "stale_notes": annotations.where((F.col("target") == target) & F.col("staleness").isin("weakly_stale", "strongly_stale", "contradicted")),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("items")).select(F.lit(name).alias("finding"), "items")
        out = one if out is None else out.unionByName(one)
    return out
