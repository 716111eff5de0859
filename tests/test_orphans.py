from pyspark.sql import functions as F

from codelode.operators import orphans as module
from codelode.operators.orphans import BEFORE, HERE, _keys, orphan_references, orphans, parent_keys


def parents(spark, rows):
    df = spark.createDataFrame(rows, "key string, flags int, b double, d double")
    return df.select(*parent_keys("x", F.col("key"), F.col("flags"), F.col("b"), F.col("d")))


def refs(spark, rows):
    df = spark.createDataFrame(rows, "id long, key string, at double")
    return df.select("id", *_keys(F.lit("x"), F.col("key")), "at")


def test_states(spark):
    known = parents(spark, [("a", HERE, None, None), ("b", BEFORE, None, None), ("c", HERE, 5.0, 9.0), ("b", BEFORE, None, None), ("d", BEFORE, None, None), ("d", HERE, None, None)])
    rows = [(1, "a", None), (2, "b", None), (3, "c", 4.0), (4, "c", 5.0), (5, "c", 9.0), (6, "c", 9.5), (7, "z", 1.0), (8, "c", None), (9, "d", 1.0), (7, "z", 1.0)]
    out = orphan_references(refs(spark, rows), known)
    assert sorted((r["id"], r["state"]) for r in out.collect()) == [(2, "deleted"), (3, "late"), (6, "deleted"), (7, "missing"), (7, "missing")]
    assert orphan_references(refs(spark, rows), known.limit(0)).count() == len(rows)
    assert orphan_references(refs(spark, []), known).count() == 0


def test_many_missing_keys_against_few_parents_take_many_ranges(spark):
    known = parents(spark, [(f"k{i}", HERE, None, None) for i in range(10)])
    many = spark.range(200_000).select(F.col("id"), *_keys(F.lit("x"), F.concat(F.lit("k"), F.col("id").cast("string"))), F.lit(None).cast("double").alias("at"))
    out = orphan_references(many, known, keys_per_range=1000)
    assert out.count() == 200_000 - 10
    assert out.where("id < 10").count() == 0


def test_a_hot_missing_key(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_PARTS", 4)
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    asked = rows.select("id", *_keys(F.lit("x"), F.col("key")), F.lit(None).cast("double").alias("at"))
    assert orphan_references(asked, parents(spark, [("1", HERE, None, None)])).count() == 8999


def test_tables_of_an_index(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = orphans(
        t([(1, "f"), (1, "f"), (2, "old"), (3, "no"), (None, "no"), (4, None)], "id long, name string"),
        t([(1, "a.py#f."), (2, "a.py#old"), (3, "b.py"), (4, "module:x"), (5, "d/"), (6, "src/"), (7, None), (8, "gone.py")], "id long, dst string"),
        t([(1, "@project"), (2, "src/"), (3, "SRC/")], "id long, target string"),
        t([(1, "l", 3.0), (2, "l", 9.0), (3, "l", 1.0), (4, "m", 3.0), (5, None, 1.0), (6, "l", None)], "id long, lifeline_id string, at double"),
        t([("n", "a.py", "f"), ("o", "a.py", "old"), ("x", "a.py", "no"), ("n", None, "g")], "label string, file string, name string"),
        t([("o", 1.0), ("n", 2.0), ("o", 1.5), ("z", None)], "label string, taken_at double"),
        t([("a.py", 1.0), ("src/x/b.py", 1.0), (None, 1.0)], "path string, indexed_at double"),
        t([("l", "a.py", 2.0, 5.0), ("q", "gone.py", 1.0, 2.0)], "id string, current_path string, created_at double, tombstoned_at double"),
    )
    assert sorted(tuple(r) for r in out.collect()) == [
        ("annotations", 3, "missing"), ("edges", 2, "deleted"), ("edges", 3, "missing"), ("edges", 5, "missing"), ("edges", 8, "deleted"),
        ("file_event", 2, "deleted"), ("file_event", 3, "late"), ("file_event", 4, "missing"), ("refs", 2, "deleted"), ("refs", 3, "missing"),
    ]
