import random

import numpy as np
import pytest

from codelode.functions.fingerprints import fingerprint, xxh64_longs
from codelode.operators import snapshot_diff as module
from codelode.operators.snapshot_diff import snapshot_changes

ROWS = "label string, ts double, file string, name string, kind string, line int, symbol_id string, pos string, k1 int"
LABELS = "label string, taken_at double"


def brute(rows, labels):
    last = {}
    for label, at in labels:
        if label is not None and at is not None:
            last[label] = max(at, last.get(label, at))
    order = sorted(last, key=lambda x: (last[x], x))
    states = {x: {} for x in order}
    for label, _, file, name, kind, line, sid in rows:
        if label in states:
            states[label].setdefault((file, name, kind), set()).add((line, sid))
    out = set()
    for a, b in zip(order, order[1:]):
        for key in states[a].keys() | states[b].keys():
            old, new = states[a].get(key), states[b].get(key)
            if old != new:
                out.add((b, *key, "added" if old is None else "removed" if new is None else "changed"))
    return out


def check(spark, rows, labels, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)
    found = [tuple(r) for r in snapshot_changes(df, spark.createDataFrame(labels, LABELS), **options).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, labels)


def test_cases(spark):
    labels = [("b", 2.0), ("a", 1.0), ("c", 3.0), ("c", 0.5), (None, 9.0), ("never", None), ("empty", 2.5)]
    rows = [
        ("a", 1.0, "f", "n", "k", 1, "s"), ("b", 1.0, "f", "n", "k", 1, "s"), ("b", 7.0, "f", "n", "k", 1, "s"),  # equal, repeated
        ("a", 1.0, "f", "m", "k", 1, None), ("b", 1.0, "f", "m", "k", 1, "x"),  # null to a value
        ("a", 1.0, None, "m", None, 1, None), ("b", 1.0, "m", None, None, 1, None),  # nulls in keys
        ("b", 1.0, "f", "p", "k", 1, "s"), ("b", 1.0, "f", "p", "k", 2, "s"), ("c", 1.0, "f", "p", "k", 2, "s"),  # a set of values
        ("x", 1.0, "f", "q", "k", 1, "s"), (None, 1.0, "f", "q", "k", 1, "s"),  # not registered
    ]
    check(spark, rows, labels)
    check(spark, [], labels)
    check(spark, rows, [])
    check(spark, rows, [("a", 1.0)])
    check(spark, rows, [("a", 1.0), ("b", 1.0)])  # a tie


def test_many_changes_need_larger_tables(spark):
    random.seed(1)
    rows = [(label, 0.0, f"f{i % 50}", f"n{i}", "k", random.randrange(3), None) for label in "ab" for i in range(1500)]
    check(spark, rows, [("a", 1.0), ("b", 2.0)], records_per_bucket=400, first_cells=4)


def test_a_hot_key_with_a_third_of_all_rows(spark):
    rows = [(label, 0.0, "hot", "n", "k", i, None) for label in "ab" for i in range(500)] + [("b", 0.0, "hot", "n", "k", 999, None)] + [("a", 0.0, f"f{i}", "n", "k", 1, None) for i in range(1000)]
    check(spark, rows, [("a", 1.0), ("b", 2.0)])


def test_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(module, "MOST_ROUNDS", 1)
    rows = [("b", 0.0, f"f{i}", "n", "k", 1, None) for i in range(500)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], ROWS)
    with pytest.raises(RuntimeError):
        snapshot_changes(df, spark.createDataFrame([("a", 1.0), ("b", 2.0)], LABELS), first_cells=4)


def test_hashes_are_those_of_the_engine(spark):
    values = [0, 1, -1, 2**62, -(2**63)]
    df = spark.createDataFrame([(v, v // 3) for v in values], "a long, b long")
    ours = xxh64_longs(np.array(values), np.array([v // 3 for v in values]))
    assert [r[0] for r in df.selectExpr("xxhash64(a, b)").collect()] == ours.tolist()
    pairs = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert pairs.select(fingerprint(pairs["a"], pairs["b"])).distinct().count() == 2
