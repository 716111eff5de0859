import random

import numpy as np

from codelode.llm.packing import best_fit_decreasing, pack, windows


def plain_best_fit(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= size]
        if fits:
            best = min(fits, key=lambda i: bins[i])
            bins[best] -= size
        else:
            bins.append(capacity - size)
    return len(bins)


def test_as_many_windows_as_plain_best_fit():
    rng = random.Random(4)
    for capacity in (1, 7, 100, 512):
        sizes = np.array([rng.randrange(0, capacity + 1) for _ in range(400)])
        window, offset, count = best_fit_decreasing(sizes, capacity)
        assert count == plain_best_fit(sizes.tolist(), capacity)
        for w in range(count):
            inside = sorted((offset[i], sizes[i]) for i in np.flatnonzero(window == w) if sizes[i])
            assert all(a + n <= b for (a, n), (b, _) in zip(inside, inside[1:]))
            assert not inside or sum(inside[-1]) <= capacity


def test_rows(spark):
    rows = [(1, 5), (2, 0), (3, None), (4, -2), (5, 25), (5, 25), (None, 3), (6, 10)]
    items = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, tokens long, part int, window int")
    out = pack(items, 10).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
    assert {k: sorted(v) for k, v in by.items()} == {1: [(0, 5)], 2: [(0, 0)], 3: [(0, 0)], 4: [(0, 0)], 5: [(0, 10), (0, 10), (1, 10), (1, 10), (2, 5), (2, 5)], 6: [(0, 10)]}
    fill = {}
    for r in out:
        fill[r["window"]] = fill.get(r["window"], 0) + r["tokens"]
        assert r["offset"] + r["tokens"] <= 10
    assert max(fill.values()) <= 10 and len([w for w, n in fill.items() if n]) == 7
    assert sum(r["windows"] for r in windows(pack(items, 10), 10).collect()) == len(fill)
    assert pack(items.limit(0), 10).count() == 0
