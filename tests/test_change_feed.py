import itertools
import random

from codelode.operators.change_feed import current_rows, fold_changes

SCHEMA = "path string, prev_hash string, new_hash string, ts double, session_id string, summary string, k string, state string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", "clash") for r in rows], SCHEMA)


def ends(df):
    return {r["path"]: (r["op"], r["state"]) for r in df.collect()}


def test_walks(spark):
    rows = [
        ("open", None, "a", 5.0, "s1"),
        ("open", "a", "b", 1.0, "s2"),  # clocks differ
        ("open", "a", "b", 9.0, "s2"),  # delivered again
        ("gone", None, "a", 7.0, "s1"),
        ("gone", "a", None, 7.0, "s1"),  # created and deleted at the same time
        ("late", None, "a", 9.0, "s1"),
        ("late", "a", "b", 1.0, "s1"),
        ("late", "b", None, 2.0, "s1"),  # created after what follows
        ("back", "a", "b", 1.0, "s1"),
        ("back", "b", "a", 2.0, "s1"),  # an existing file, changed and changed back
        ("self", "a", "a", 1.0, None),
        ("null", None, "a", None, None),
        (None, None, "a", 1.0, "s1"),
    ]
    out = ends(fold_changes(feed(spark, rows)))
    assert out == {"open": ("upsert", "b"), "gone": ("delete", None), "late": ("delete", None), "back": ("upsert", "a"), "self": ("upsert", "a"), "null": ("upsert", "a")}
    assert {r["path"]: r["hash"] for r in current_rows(feed(spark, rows)).collect()} == {k: v for k, (op, v) in out.items() if op == "upsert"}


def test_base_rows_hold_where_nothing_changed(spark):
    base = spark.createDataFrame([("kept", "x"), ("gone", "a"), ("round", "a")], "path string, new_hash string")
    rows = [("gone", "a", None, 1.0, "s"), ("round", "a", None, 1.0, "s"), ("round", None, "a", 2.0, "s")]
    assert ends(fold_changes(feed(spark, rows), base)) == {"kept": ("upsert", "x"), "gone": ("delete", None), "round": ("upsert", "a")}
    assert fold_changes(feed(spark, [])).count() == 0


def test_random_walks_in_any_order(spark):
    random.seed(3)
    rows, truth = [], {}
    for p in range(200):
        at, seen = None, set()
        for step in range(random.randrange(1, 9)):
            to = random.choice(["a", "b", "c", None])
            edit = (at, to, random.choice("xyz"))
            if to == at or edit in seen:
                continue
            seen.add(edit)
            rows += [(f"p{p}", at, to, random.random(), edit[2])] * random.randrange(1, 3)
            at = to
        if seen:
            truth[f"p{p}"] = at
    random.shuffle(rows)
    assert {k: v for k, (_, v) in ends(fold_changes(feed(spark, rows))).items()} == truth
