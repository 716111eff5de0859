from codelode.operators.hot_keys import heavy_keys, key_profile, once

SCHEMA = "id long, name string, file string, rows string, total int"


def refs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_heavy_keys(spark):
    rows = [(i, "hot" if i < 34 else f"n{i}" if i < 99 else None, "f" if i % 2 else None) for i in range(100)] + [(0, "hot", None)] * 500 + [(None, "x", "x")] * 500
    found = {tuple(r) for r in heavy_keys(once(refs(spark, rows), "id", ("name", "file")), ("name", "file"), 0.02).collect()}
    assert found == {("name", "hot", 34), ("file", "f", 50)}


def test_a_tie_with_the_share_is_in(spark):
    rows = [(i, "a" if i < 2 else f"n{i}", None) for i in range(200)]
    assert [r["hot_key"] for r in heavy_keys(once(refs(spark, rows), "id", ("name", "file")), ("name", "file"), 0.01).collect()] == ["a"]
    assert heavy_keys(refs(spark, []), ("name", "file")).count() == 0


def test_profiles(spark):
    rows = [(1, "a", "f"), (1, "a", "f"), (2, "a", "g"), (3, "a", None), (4, None, "f"), (5, "b", None)]
    found = {tuple(r) for r in key_profile(once(refs(spark, rows), "id", ("name", "file")), "name", "file", "name").collect()}
    assert found == {("a", 3, 2), ("b", 1, 0)}
