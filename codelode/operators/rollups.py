"""Counts, shares, top-k and conditional aggregates over the relations of an index.

All are algebraic aggregates that combine in the map tasks; a limit stands only where a top-k report
is the feature, and ties are broken by the key so that results are the same in every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelode.functions.paths import is_artifact, is_test, is_virtual, module_of

#: Ranks of labels.
CONFIDENCE_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3}
STALENESS_RANK = {"fresh": 0, "recovered": 1, "unknown": 2, "weakly_stale": 3, "strongly_stale": 4, "contradicted": 5}


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1)).otherwise(0.0)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def parser_coverage(files: DataFrame) -> DataFrame:
    """(lang, ast, regex, none, total, ast_pct) per language, and the grand total with a null lang."""
    parser = F.coalesce("parser", F.lit("none"))
    ast, regex = parser.startswith("treesitter:") | (parser == "ast"), parser == "regex"
    marked = files.select(F.coalesce("lang", F.lit("unknown")).alias("lang"), ast.alias("a"), regex.alias("r"))
    sums = marked.rollup("lang").agg(F.count_if("a").alias("ast"), F.count_if("r").alias("regex"), F.count_if(~F.col("a") & ~F.col("r")).alias("none"), F.count("*").alias("total"))
    return sums.withColumn("ast_pct", percent(F.col("ast"), F.col("total")))


def in_degree(edges: DataFrame, kind: str = "imports") -> DataFrame:
    """(dst, edges) of nodes that aren't virtual."""
    return edges.where((F.col("type") == kind) & F.col("dst").isNotNull() & ~is_virtual(F.col("dst"))).groupBy("dst").agg(F.count("*").alias("edges"))


def hot_files(edges: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """(file, reverse_deps): the k indexed files that most edges import."""
    known = in_degree(edges).join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    return known.select(F.col("dst").alias("file"), F.col("edges").alias("reverse_deps")).orderBy(F.desc("reverse_deps"), "file").limit(k)


def barrel_candidates(edges: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """As hot_files, among files named index or barrel and those in namespace directories."""
    barrel = F.col("dst").rlike(r"(^|/)(index|barrel)(\.[^/]*)?$") | F.col("dst").rlike("/(_namespaces|_ns)/")
    return hot_files(edges.where(barrel), files, k)


def first_definitions(symbols: DataFrame) -> DataFrame:
    """(name, file, line, kind): the first definition of each name by file and line."""
    return symbols.where("name is not null").groupBy("name").agg(F.min(F.struct("file", "line", "kind")).alias("d")).select("name", "d.file", "d.line", "d.kind")


def gateway_symbols(refs: DataFrame, symbols: DataFrame, k: int, kinds: Sequence[str] = ("function", "method", "exported")) -> DataFrame:
    """(name, ref_count, file, line): the k most called names of 3 letters or more, with their first definition."""
    calls = refs.where("kind = 'call' and length(name) >= 3").groupBy("name").agg(F.count("*").alias("ref_count"))
    defs = first_definitions(symbols.where(F.col("kind").isin(list(kinds)))).drop("kind")
    return calls.join(defs, "name").orderBy(F.desc("ref_count"), "name").limit(k)


def god_symbols(symbols: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(name, file, kind, refcount): the k most referred names that aren't dunder names, by their first source definition."""
    defs = first_definitions(symbols.where(~F.col("name").rlike("^__.*__$") & F.col("kind").isNotNull() & ~is_artifact(F.col("file")))).drop("line")
    counts = refs.where("name is not null").groupBy("name").agg(F.count("*").alias("refcount"))
    return defs.join(counts, "name", "left").select("name", "file", "kind", F.coalesce("refcount", F.lit(0)).alias("refcount")).orderBy(F.desc("refcount"), "name").limit(k)


def ambiguous_refs(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, def_count, ref_count) of names with several definitions."""
    defs = symbols.where("name is not null").groupBy("name").agg(F.count("*").alias("def_count")).where("def_count > 1")
    counts = refs.groupBy("name").agg(F.count("*").alias("ref_count"))
    return defs.join(counts, "name", "left").fillna(0, ["ref_count"])


def source_root(files: DataFrame, roots: Sequence[str]) -> str | None:
    """The most frequent first segment among roots if a quarter of the files lie under it."""
    first = F.regexp_extract("path", "^([^/]*)/", 1)
    total = files.count()
    best = files.where(first.isin(list(roots))).groupBy(first.alias("r")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r").first()
    return best["r"] if best and best["n"] >= max(1, total // 4) else None


def module_stats(files: DataFrame, symbols: DataFrame, refs: DataFrame, root: str | None) -> DataFrame:
    """(module, files, symbols, functions, classes, refs) per module."""
    m = lambda c: module_of(F.col(c), root).alias("module")
    counts = files.groupBy(m("path")).agg(F.count("*").alias("files"))
    defs = symbols.join(files.select(F.col("path").alias("file")), "file", "left_semi").groupBy(m("file")).agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    uses = refs.where("file is not null").groupBy(m("file")).agg(F.count("*").alias("refs"))
    return counts.join(defs, "module", "left").join(uses, "module", "left").fillna(0)


def cross_module_edges(edges: DataFrame, root: str | None, examples: int = 3) -> DataFrame:
    """(from_module, to_module, edge_count, examples): imports between modules, with the first examples."""
    pairs = edges.where((F.col("type") == "imports") & F.col("src").isNotNull() & F.col("dst").isNotNull() & ~is_virtual(F.col("dst")))
    pairs = pairs.select(module_of(F.col("src"), root).alias("from_module"), module_of(F.col("dst"), root).alias("to_module"), "src", "dst").where("from_module <> to_module")
    counts = pairs.groupBy("from_module", "to_module").agg(F.count("*").alias("edge_count"))
    rank = F.row_number().over(W.partitionBy("from_module", "to_module").orderBy("src", "dst"))  # keeps the first few of each group in the map tasks
    some = pairs.distinct().withColumn("rn", rank).where(F.col("rn") <= examples)
    some = some.groupBy("from_module", "to_module").agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "src", "dst"))).alias("examples"))
    return counts.join(some, ["from_module", "to_module"])


def note_totals(annotations: DataFrame) -> DataFrame:
    """(dimension, value, notes) by staleness, truth_class, kind and author, in one pass."""
    dims = {"staleness": "unknown", "truth_class": "INFERENCE", "kind": "note", "author": None}
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), (F.coalesce(d, F.lit(x)) if x else F.col(d)).alias("value")) for d, x in dims.items())))
    return annotations.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("notes"))


def rank_of(label: Column, ranks: Mapping[str, int], missing: int = 0) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[label], F.lit(missing))


def label_of(rank: Column, ranks: Mapping[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in ranks.items() for x in (v, k)))[rank]


def target_risk(annotations: DataFrame) -> DataFrame:
    """(target, note_count, stale_note_count, contradicted_count) per target with something to attend to."""
    stale = F.col("staleness").isin("weakly_stale", "strongly_stale", "contradicted")
    sums = annotations.where("target is not null").groupBy("target").agg(F.count("*").alias("note_count"), F.count_if(stale).alias("stale_note_count"), F.count_if(F.col("staleness") == "contradicted").alias("contradicted_count"))
    return sums.where("stale_note_count > 0")


def worst_staleness(annotations: DataFrame) -> DataFrame:
    """(target, staleness, critical): the worst label per target, and whether a note of it is of kind critical or high severity."""
    worst = F.max(rank_of(F.col("staleness"), STALENESS_RANK, STALENESS_RANK["unknown"]))
    critical = F.bool_or((F.col("kind") == "critical") | F.coalesce(F.col("severity").isin("critical", "high"), F.lit(False)))
    return annotations.where("target is not null").groupBy("target").agg(label_of(worst, STALENESS_RANK).alias("staleness"), F.coalesce(critical, F.lit(False)).alias("critical"))


def min_confidence(rows: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    """(key, confidence, rows): the lowest label per key; unknown labels rank lowest."""
    least = F.min(rank_of(F.col(confidence), CONFIDENCE_RANK))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(label_of(least, CONFIDENCE_RANK).alias("confidence"), F.count("*").alias("rows"))


def level_summary(rows: DataFrame, level: str) -> DataFrame:
    """(level, rows, total, dominant): counts per level, their total and whether it is the most frequent one."""
    counts = rows.groupBy(F.coalesce(level, F.lit("unknown")).alias("level")).agg(F.count("*").alias("rows"))
    whole = W.partitionBy(F.lit(1))  # one row per level
    best = F.max(F.struct("rows", "level")).over(whole)["level"]
    return counts.select("level", "rows", F.sum("rows").over(whole).alias("total"), (F.col("level") == best).alias("dominant"))


def touched_files(edits: DataFrame, start: float, end: float) -> DataFrame:
    """(path, edits, last_ts, summary) per path edited within a time window."""
    inside = edits.where(F.col("ts").between(start, end) & F.col("path").isNotNull())
    return inside.groupBy("path").agg(F.count("*").alias("edits"), F.max("ts").alias("last_ts"), F.max("summary").alias("summary"))


def list_snapshots(snapshots: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, taken_at, rows) of labels with rows and of registered ones without."""
    held = snapshots.where("label is not null").groupBy("label").agg(F.min("ts").alias("first_ts"), F.count("*").alias("rows"))
    known = labels.where("label is not null").groupBy("label").agg(F.max("taken_at").alias("registered"))
    return held.join(known, "label", "full").select("label", F.coalesce("registered", "first_ts").alias("taken_at"), F.coalesce("rows", F.lit(0)).alias("rows"))


def collapse_edits(edits: DataFrame) -> DataFrame:
    """(path, first_ts, last_ts, edit_count, sessions, prev_hash, new_hash, was_added, was_deleted) per path.

    prev_hash is that of the earliest edit, new_hash that of the latest (ties: the smaller, the larger
    one); edits without a time count last for the first and first for the last.
    """
    first = F.min(F.struct(F.col("ts").isNull().alias("n"), "ts", "prev_hash", "new_hash", "session_id"))
    last = F.max(F.struct("ts", "new_hash", "prev_hash", "session_id"))
    return edits.where("path is not null").groupBy("path").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("edit_count"), F.count_distinct("session_id").alias("sessions"), first["prev_hash"].alias("prev_hash"), last["new_hash"].alias("new_hash"),
        F.bool_or(F.col("prev_hash").isNull()).alias("was_added"), F.bool_or(F.col("new_hash").isNull()).alias("was_deleted"),
    )


def first_of_each(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key, all columns."""
    others = [c for c in rows.columns if c not in key and c != order]
    best = F.min(F.struct(order, *others)).alias("x")
    return rows.groupBy(*key).agg(best).select(*key, *(F.col(f"x.{c}").alias(c) for c in (order, *others)))


def primary_definitions(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, file, share): of each ambiguous name the definition to show first and its share of references bound by name.

    Source goes before tests and artifacts, then more bound references, then the shorter, then the smaller path.
    """
    defs = symbols.where("name is not null and file is not null").select("name", "file").distinct()
    bound = refs.where("target_symbol_id is not null and name is not null").select("name", F.substring_index("target_symbol_id", "#", 1).alias("file")).groupBy("name", "file").agg(F.count("*").alias("bound"))
    scored = defs.join(bound, ["name", "file"], "left").fillna(0, ["bound"])
    key = F.struct((is_test(F.col("file")) | is_artifact(F.col("file"))).cast("int"), -F.col("bound"), F.length("file"), "file")
    best = scored.groupBy("name").agg(F.count("*").alias("defs"), F.min_by("file", key).alias("file"), F.min_by("bound", key).alias("own"), F.sum("bound").alias("all"))
    return best.where("defs > 1").select("name", "file", F.when(F.col("all") > 0, F.round(F.col("own") / F.col("all"), 4)).otherwise(0.0).alias("share"))


def size_class(count: Column, small: int = 5, medium: int = 50) -> Column:
    return F.when(count <= small, "small").when(count <= medium, "medium").otherwise("large")


def top_k(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; each task keeps k rows, so nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(k)


def top_k_per_key(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; ranks are limited before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= k)


def distinct_values(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, values) of keys with several distinct non-null values."""
    pairs = rows.where(F.col(value).isNotNull()).select(*key, value).distinct()
    return pairs.groupBy(*key).agg(F.count("*").alias("values")).where("values > 1")


def differing_members(rows: DataFrame, name: str, layer: str, members: str) -> DataFrame:
    """(name, layer_a, layer_b, only_a, only_b) of pairs of layers, in order, in which one name has different members."""
    sides = rows.groupBy(name, layer).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(members)))).alias("m"))
    a = sides.select(F.col(name).alias("name"), F.col(layer).alias("layer_a"), F.col("m").alias("ma"))
    b = sides.select(F.col(name).alias("name"), F.col(layer).alias("layer_b"), F.col("m").alias("mb"))
    # layers of one name are few: a name comes once per layer
    pairs = a.join(b, "name").where("layer_a < layer_b")
    out = pairs.select("name", "layer_a", "layer_b", F.array_except("ma", "mb").alias("only_a"), F.array_except("mb", "ma").alias("only_b"))
    return out.where((F.size("only_a") > 0) | (F.size("only_b") > 0))
