"""Anti and semi joins between definitions and references, and binding of references to definitions by tiers.

References are first combined to distinct (file, name) pairs, so a name or file that holds a third of
all references takes part in the joins once; the rows are joined to the result last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import is_virtual, suffixes
from codelode.plans.scratch import cut

HOPS = 4  # of export-star chains that binding follows


def unused_symbols(symbols: DataFrame, refs: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Symbols whose name no reference has; a null name is never referred to."""
    out = symbols if kinds is None else symbols.where(F.col("kind").isin(list(kinds)))
    return out.join(refs.where("name is not null").select("name").distinct(), "name", "left_anti")


def undefined_references(refs: DataFrame, symbols: DataFrame, files: DataFrame, builtins: DataFrame | None = None) -> DataFrame:
    """(name, lang, refs): referenced names that nothing defines, per language of the referring file, without its builtins (lang, name)."""
    pairs = refs.where("name is not null").groupBy("name", "file").agg(F.count("*").alias("n"))
    lost = pairs.join(symbols.where("name is not null").select("name").distinct(), "name", "left_anti")
    spoken = lost.join(files.select(F.col("path").alias("file"), "lang"), "file", "left").groupBy("name", "lang").agg(F.sum("n").alias("refs"))
    return spoken if builtins is None else spoken.join(builtins, ["lang", "name"], "left_anti")


def untouched_symbols(symbols: DataFrame, touched: DataFrame) -> DataFrame:
    """Symbols of which neither the name nor the file is among the touched targets."""
    seen = touched.where("target is not null").select("target").distinct()
    return symbols.join(seen.withColumnRenamed("target", "name"), "name", "left_anti").join(seen.withColumnRenamed("target", "file"), "file", "left_anti")


def bindable(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    return refs.join(symbols.where("name is not null").select("name").distinct(), "name", "left_semi")


def closure(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hop): what each src reaches in at most `hops` steps, by its shortest way; a loop of joins, each cut."""
    step = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    found = frontier = cut(step.withColumn("hop", F.lit(1)))
    for hop in range(2, hops + 1):
        further = frontier.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(further.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _only(defs: DataFrame, reach: DataFrame) -> DataFrame:
    """(file, name, symbol_id) of names with exactly one definition among the files that `file` reaches."""
    near = reach.select(F.col("src").alias("at"), F.col("dst").alias("file")).distinct().join(defs, "file")
    return near.groupBy("at", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").select(F.col("at").alias("file"), "name", "symbol_id")


def resolve_refs(refs: DataFrame, symbols: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, target_symbol_id, tier) of each reference.

    tier is already_bound; same_file (the first definition in the file); imported (the only one in
    imported files); reexport (the only one that export-star chains of imported files reach);
    global_unique (the only one at all); else ambiguous or no_match with a null target.
    """
    defs = symbols.where("symbol_id is not null and name is not null").select("file", "name", "line", "symbol_id")
    imports = edges.where("type = 'imports' and src is not null and dst is not null").select("src", "dst").distinct()
    chains = closure(edges.where("type = 'reexport_star'"), hops).select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    behind = imports.withColumnRenamed("dst", "mid").join(chains, "mid").select("src", F.col("far").alias("dst"))
    own = defs.groupBy("file", "name").agg(F.min(F.struct("line", "symbol_id"))["symbol_id"].alias("own"))
    everywhere = defs.groupBy("name").agg(F.count("*").alias("defs"), F.min("symbol_id").alias("single"))
    pairs = refs.where("target_symbol_id is null and name is not null").select("file", "name").distinct()
    tiers = (
        pairs.join(own, ["file", "name"], "left")
        .join(_only(defs, imports).withColumnRenamed("symbol_id", "imported"), ["file", "name"], "left")
        .join(_only(defs, behind).withColumnRenamed("symbol_id", "chained"), ["file", "name"], "left")
        .join(everywhere, "name", "left")
    )
    single = F.when(F.col("defs") == 1, F.col("single"))
    tier: Column = F.when(F.col("own").isNotNull(), "same_file").when(F.col("imported").isNotNull(), "imported").when(F.col("chained").isNotNull(), "reexport")
    tier = tier.when(single.isNotNull(), "global_unique").when(F.col("defs") > 1, "ambiguous").otherwise("no_match")
    known = tiers.select("file", "name", F.coalesce("own", "imported", "chained", single).alias("bound"), tier.alias("how"))
    rows = refs.select("id", "file", "name", "target_symbol_id")
    joined = rows.join(known, rows["file"].eqNullSafe(known["file"]) & (rows["name"] == known["name"]), "left")
    how = F.when(F.col("target_symbol_id").isNotNull(), "already_bound").otherwise(F.coalesce("how", F.lit("no_match")))
    return joined.select("id", F.coalesce("target_symbol_id", "bound").alias("target_symbol_id"), how.alias("tier"))


def binding_summary(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: total, bound and bindable references, and their shares in percent."""
    named = refs.groupBy("name").agg(F.count("*").alias("n"), F.count("target_symbol_id").alias("bound"))
    marked = named.join(symbols.where("name is not null").select("name").distinct().withColumn("known", F.lit(True)), "name", "left")
    sums = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_refs"), F.coalesce(F.sum("bound"), F.lit(0)).alias("bound_refs"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("internal_bindable"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.lit(100.0) * F.col(a) / F.col(b), 1)).otherwise(0.0)
    return sums.select("total_refs", "bound_refs", (F.col("total_refs") - F.col("bound_refs")).alias("unbound_refs"), share("bound_refs", "total_refs").alias("bound_pct"), "internal_bindable", (F.col("total_refs") - F.col("internal_bindable")).alias("external_refs"), share("bound_refs", "internal_bindable").alias("internal_bound_pct"))


def default_import_refs(imports: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, name, symbol_id) for imports (file, dst, name) of a file with one symbol only, where no such reference is known yet."""
    sole = symbols.where("symbol_id is not null").groupBy("file").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1")
    new = imports.join(sole.withColumnRenamed("file", "dst"), "dst").select("file", "name", "symbol_id")
    return new.join(refs.select("file", "name").distinct(), ["file", "name"], "left_anti")


def peers(rows: DataFrame, keys: Sequence[str], file: str, of: str, most_files: int = 6) -> DataFrame:
    """(keys, file) of other files that share a key with the file `of`; keys in more than most_files files are too common to mean something."""
    pairs = rows.select(*keys, file).distinct()
    few = pairs.groupBy(*keys).agg(F.count(file).alias("files"), F.max((F.col(file) == of).cast("int")).alias("here")).where((F.col("files") <= most_files) & (F.col("here") == 1))
    return pairs.join(few.select(*keys), list(keys), "left_semi").where(F.col(file) != of)


def two_sided(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, both counts, status) of keys of both sides: `<name>_only` or `both`."""
    counts = left.groupBy(key).agg(F.count("*").alias(names[0])).join(right.groupBy(key).agg(F.count("*").alias(names[1])), key, "full").fillna(0, list(names))
    status = F.when(F.col(names[1]) == 0, f"{names[0]}_only").when(F.col(names[0]) == 0, f"{names[1]}_only").otherwise("both")
    return counts.where(F.col(key).isNotNull()).withColumn("status", status)


def cited_paths(cited: DataFrame, files: DataFrame) -> DataFrame:
    """(cited, path, matches): the only path that ends in the cited one at a segment; null path if there are several or none."""
    asked = cited.where("cited is not null").select("cited").distinct()
    ends = files.select("path", F.explode(suffixes(F.col("path"))).alias("cited")).join(asked, "cited", "left_semi")
    found = ends.groupBy("cited").agg(F.count("*").alias("matches"), F.min("path").alias("path"))
    return asked.join(found, "cited", "left").select("cited", F.when(F.col("matches") == 1, F.col("path")).alias("path"), F.coalesce("matches", F.lit(0)).alias("matches"))


def shadowed_modules(edges: DataFrame) -> DataFrame:
    """(dst, prefix): dotted modules that are imported although a strict prefix of them is imported too."""
    modules = edges.where(F.col("dst").startswith("module:")).select(F.substring("dst", 8, 1 << 20).alias("module")).distinct()
    parts = F.split("module", r"\.")
    prefixes = modules.where(F.size(parts) > 1).select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    return prefixes.join(modules.withColumnRenamed("module", "prefix"), "prefix", "left_semi")


def is_internal(dst: Column) -> Column:
    return dst.isNotNull() & ~is_virtual(dst)
