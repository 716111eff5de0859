import random

import numpy as np
import pandas as pd
import pytest

from codelode.operators import intervals
from codelode.operators.intervals import periods_and_gaps, union_runs


def brute(rows, unit=0.25):
    out, by = set(), {}
    for entity, a, b in rows:
        if entity is not None and a is not None and b is not None and b > a and abs(a) != float("inf") and abs(b) != float("inf"):
            by.setdefault(entity, []).append((round(a / unit), round(b / unit)))
    for entity, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(entity, "covered", a, b) for a, b in merged}
        out |= {(entity, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "e string, s double, t double, entity string, block int")
    found = [tuple(r) for r in periods_and_gaps(df, "e", "s", "t").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_cases(spark):
    year_9999 = 253402300799.0
    check(
        spark,
        [
            ("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 0.25, 0.5), ("a", 3.0, 4.0), ("a", 3.0, 4.0),  # touching, nested, repeated
            ("b", 5.0, 5.0), ("b", 6.0, 5.0), (None, 0.0, 1.0), ("c", None, 1.0), ("c", 1.0, None), ("c", float("nan"), 1.0), ("c", 1.0, float("inf")),
            ("d", 1.7e9, year_9999), ("d", 1.8e9, 1.9e9), ("d", 0.0, 1.0), ("d", year_9999 + 1, year_9999 + 2), ("d", 2.0**24, 2.0**24 + 1),
            ("e", -5.0e12, -4.0e12), ("e", -3.9e12, 8.0e16), ("e", 2.0**22, 2.0**22 + 0.25), ("e", 9.0e16, 9.1e16),
            ("f", 0.0, 2.0**22), ("f", 2.0**22, 2.0**23), ("f", 2.0**23 + 0.25, 2.0**24), ("f", 2.0**25, 2.0**26),
        ],
    )
    assert periods_and_gaps(spark.createDataFrame([], "e string, s double, t double"), "e", "s", "t").count() == 0


def test_times_that_do_not_fit_stop_the_query(spark):
    df = spark.createDataFrame([("a", 0.0, 1e19)], "e string, s double, t double")
    with pytest.raises(Exception, match="too far"):
        periods_and_gaps(df, "e", "s", "t").collect()


def test_random(spark, monkeypatch):
    random.seed(7)
    rows = []
    for scale in (50.0, 3.0e4, 2.0e7, 4.0e8):
        for _ in range(400):
            a = random.uniform(-scale, scale) // 0.25 * 0.25
            rows.append((random.choice("aaaaab"), a, a + random.choice([0.25, 5.0, scale / 50, scale / 400]) // 0.25 * 0.25))
    check(spark, rows)


def test_one_block_is_held_as_one_container_a_shard(monkeypatch):
    monkeypatch.setattr(intervals, "HELD_CONTAINERS", 3)
    runs = lambda *pairs: np.array([(a, b - a - 1) for a, b in pairs], "<u2").tobytes()
    batch = lambda rows: pd.DataFrame(rows, columns=["entity", "block", "shard", "runs"])
    parts = [batch([("a", 0, 0, runs((k, k + 2))), ("a", 0, 1, runs((k, k + 1)))]) for k in range(0, 20, 2)]
    out = pd.concat(intervals._blocks(iter([*parts, batch([("b", 0, 0, runs((1, 2)))])])))
    assert {tuple(r) for r in out[["entity", "what", "lo", "hi"]].itertuples(index=False)} >= {("a", "edge", 0, 20), ("a", "edge", 65554, 65555), ("a", "gap", 20, 65536)}


def test_union_runs_far_apart():
    group, start, end = union_runs(np.array([1, 0, 1, 0]), np.array([0, -(1 << 61), 5, 1 << 61]), np.array([5, 0, 1 << 61, 1 << 62]))
    assert list(zip(group, start, end)) == [(0, -(1 << 61), 0), (0, 1 << 61, 1 << 62), (1, 0, 1 << 61)]
