"""Graph queries over edge tables: level by level, each level one join, cut to a written table.

A level visits only nodes that no earlier level has (an anti join), so cycles end; a loop runs for
at most the hops that were asked. Parents are the smallest ones, so results don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import ancestors, is_artifact, is_test, is_virtual
from codelode.operators.binding import closure
from codelode.operators.positions import call_edges
from codelode.operators.rollups import worst_staleness
from codelode.plans.scratch import cut

BARREL_HOPS = 8  # of export-star chains upwards


def reach(edges: DataFrame, seeds: DataFrame, hops: int, forward: bool = True) -> DataFrame:
    """(node, hop, through) of what seeds (node) reach along edges (src, dst), seeds with hop 0 and a null through."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    frontier = cut(seeds.select("node").distinct().withColumns({"hop": F.lit(0), "through": F.lit(None).cast("string")}))
    found = frontier
    for hop in range(1, hops + 1):
        near = step.join(frontier.select("node"), "node").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("through"))
        frontier = cut(near.join(found.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "through"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def reach_all(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hop): all pairs within a few hops, by their shortest way; for sparse graphs and few hops only."""
    return closure(edges, hops)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(node): what imports a node, and what it imports."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).union(edges.where(F.col("src") == node).select("dst")).where("node is not null").distinct()


def forward_deps(edges: DataFrame, node: str, kinds: tuple[str, ...] = ("imports", "pair_inspect")) -> DataFrame:
    """(file, type) that a file depends on."""
    return edges.where((F.col("src") == node) & F.col("type").isin(*kinds)).select(F.col("dst").alias("file"), "type").distinct()


def java_module(path: str) -> str | None:
    """The dotted name by which other files import a Java file; null for other files."""
    if not path.endswith(".java"):
        return None
    for root in ("java/", "src/main/java/", "src/"):
        if path.startswith(root):
            path = path[len(root) :]
            break
    return path[: -len(".java")].replace("/", ".")


def reverse_deps(edges: DataFrame, target: str, symbols: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(file, type): what depends on a file. imports and pair_inspect are direct; reexport_via imports a file that passes the target on.

    Of a Java file, imports of its dotted name count too, and references to its classes from other
    files (same_package_ref), which need no import.
    """
    direct = edges.where((F.col("dst") == target) & F.col("type").isin("imports", "pair_inspect")).select(F.col("src").alias("file"), "type")
    spark = edges.sparkSession
    seed = spark.createDataFrame([(target,)], "node string")
    barrels = reach(edges.where("type = 'reexport_star'"), seed, BARREL_HOPS, forward=False).where("hop > 0").select(F.col("node").alias("dst"))
    out = direct.unionByName(edges.where("type = 'imports'").join(barrels, "dst", "left_semi").select(F.col("src").alias("file"), F.lit("reexport_via").alias("type")))
    module = java_module(target)
    if module and symbols is not None and refs is not None:
        out = out.unionByName(edges.where((F.col("dst") == f"module:{module}") & (F.col("type") == "imports")).select(F.col("src").alias("file"), "type"))
        classes = symbols.where((F.col("file") == target) & F.col("kind").isin("class", "interface", "enum")).select("name").distinct()
        uses = refs.where((F.col("file") != target) & F.col("kind").isin("new", "name", "call")).join(F.broadcast(classes), "name", "left_semi")  # classes of one file
        out = out.unionByName(uses.select("file", F.lit("same_package_ref").alias("type")))
    return out.where("file is not null").distinct()


def analyze_change(edges: DataFrame, target: str, hops: int = 2) -> DataFrame:
    """(file, hop, what): files that a change of the target reaches: artifact, test or source."""
    seed = edges.sparkSession.createDataFrame([(target,)], "node string")
    near = reach(edges.where("type = 'imports'"), seed, hops, forward=False).where("hop > 0")
    what = F.when(is_artifact(F.col("node")), "artifact").when(is_test(F.col("node")), "test").otherwise("source")
    return near.select(F.col("node").alias("file"), "hop", what.alias("what"))


def call_graph(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, caller, callee): calls whose callee is defined in the caller's own file, without calls of itself."""
    own = symbols.where("name is not null").select("file", F.col("name").alias("callee")).distinct()
    return call_edges(refs, symbols).where("caller <> callee").join(own, ["file", "callee"], "left_semi").select("file", "caller", "callee")


def callees_of(refs: DataFrame, symbols: DataFrame, file: str, name: str, hops: int) -> DataFrame:
    """(node, hop, through): what a symbol calls within its file, also through others."""
    calls = call_graph(refs.where(F.col("file") == file), symbols.where(F.col("file") == file)).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return reach(calls, refs.sparkSession.createDataFrame([(name,)], "node string"), hops).where("hop > 0")


def node(file: Column, name: Column) -> Column:
    return F.concat_ws("#", file, name)


def trace_edges(refs: DataFrame, symbols: DataFrame, relaxed: bool = False, most_defs: int | None = None) -> DataFrame:
    """(src, dst): from each calling symbol (file#name) to every definition of the called name.

    most_defs drops names with more definitions, which mean too much; by default none is dropped.
    """
    kinds = ("call", "new", "callback") if relaxed else ("call",)
    defs = symbols.where("name is not null and file is not null").select(F.col("name").alias("callee"), F.col("file").alias("at")).distinct()
    if most_defs is not None:
        defs = defs.join(defs.groupBy("callee").agg(F.count("*").alias("n")).where(F.col("n") <= most_defs), "callee", "left_semi")
    calls = call_edges(refs, symbols, kinds).where("caller <> callee")
    return calls.join(defs, "callee").select(node(F.col("file"), F.col("caller")).alias("src"), node(F.col("at"), F.col("callee")).alias("dst"))


def trace(edges: DataFrame, source: str, sink: str, hops: int) -> DataFrame:
    """(step, node) of a shortest way from source to sink, the smallest parent at each step; no rows if there is none."""
    edges = cut(edges)
    found = cut(reach(edges, edges.sparkSession.createDataFrame([(source,)], "node string"), hops))
    way, at = [], sink
    while at is not None:  # as long as the way, which has at most `hops` steps
        row = found.where(F.col("node") == at).first()
        if row is None:
            return edges.sparkSession.createDataFrame([], "step int, node string")
        way.append((row["hop"], at))
        at = row["through"]
    return edges.sparkSession.createDataFrame(way, "step int, node string")


def neighbourhood(edges: DataFrame, target: str, hops: int) -> DataFrame:
    """(node, hop) around a node, along edges in both directions."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, edges.sparkSession.createDataFrame([(target,)], "node string"), hops).select("node", "hop")


def lifeline_graph(lifelines: DataFrame, annotations: DataFrame, edges: DataFrame, leases: DataFrame) -> DataFrame:
    """(id, path, ghost, in_degree, staleness, open_leases) per lifeline: the nodes of the whole graph with what lies over them."""
    degree = edges.where("type = 'imports'").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    stale = worst_staleness(annotations).select(F.col("target").alias("path"), "staleness")
    held = leases.where("state = 'open' and lifeline_id is not null").groupBy(F.col("lifeline_id").alias("id")).agg(F.count("*").alias("open_leases"))
    nodes = lifelines.select("id", F.col("current_path").alias("path"), F.col("tombstoned_at").isNotNull().alias("ghost"))
    return nodes.join(degree, "path", "left").join(stale, "path", "left").join(held, "id", "left").fillna(0, ["in_degree", "open_leases"]).select("id", "path", "ghost", "in_degree", "staleness", "open_leases")


def ambiguous_inheritance(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, dst, confidence): extends edges; low confidence where the bare name has several definitions."""
    name = F.regexp_extract("dst", r"#([^.#/!]*)", 1)
    counts = symbols.where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    out = edges.where("type = 'extends' and dst is not null").withColumn("name", name).join(counts, "name", "left")
    return out.select("id", "dst", F.when(F.col("n") > 1, "low").otherwise(F.col("confidence")).alias("confidence"))


def external_share(edges: DataFrame) -> DataFrame:
    """(src, edges, external): edges of each file and how many lead to virtual nodes."""
    return edges.where("src is not null").groupBy("src").agg(F.count("*").alias("edges"), F.count_if(is_virtual(F.col("dst"))).alias("external"))


def guess_tests(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, test): test files that import a source file, or that carry its stem in a name of test form."""
    sources = files.where(~is_test(F.col("path"))).select("path")
    tests = files.where(is_test(F.col("path"))).select(F.col("path").alias("test"))
    by_import = edges.where("type = 'imports'").select(F.col("src").alias("test"), F.col("dst").alias("path")).join(tests, "test", "left_semi").join(sources, "path", "left_semi")
    stem = lambda c: F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r"^([^.]*)", 1)
    bare = F.regexp_replace(stem("test"), "^test_|_test$", "")
    named = tests.withColumn("stem", bare).where(F.length("stem") > 3).withColumn("repo", F.split("test", "/")[0]).join(sources.withColumn("stem", stem("path")).withColumn("repo", F.split("path", "/")[0]), ["repo", "stem"])
    return by_import.select("path", "test").unionByName(named.select("path", "test")).distinct()


def directory_tree(files: DataFrame) -> DataFrame:
    """(dir, files): files below each directory."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
