import pytest

from codelode.streaming import logs as L

EVENTS = "id long, lifeline_id string, kind string, at double"


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows, schema, n):
        path = str(tmp_path / "log")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        return path

    return write


def drain(df, name, tmp_path, mode="append"):
    """The rows that one run over what has arrived since the last run gives."""
    found = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).foreachBatch(lambda rows, n: found.extend(rows.collect())).start()
    assert query.awaitTermination(120)
    return found


def test_tail_with_lifelines(spark, folder, tmp_path):
    path = folder([(1, "l", "edited", 1.0), (2, "m", "edited", 2.0)], EVENTS, 0)
    lifelines = spark.createDataFrame([("l", "a.py")], "id string, current_path string")
    stream = L.with_lifelines(L.tail(spark, path, EVENTS), lifelines)
    assert {(r["id"], r["current_path"]) for r in drain(stream, "tail1", tmp_path)} == {(1, "a.py"), (2, None)}
    folder([(3, "l", "moved", 3.0)], EVENTS, 1)
    stream = L.with_lifelines(L.tail(spark, path, EVENTS), lifelines)
    assert [r["id"] for r in drain(stream, "tail1", tmp_path)] == [3]


def test_repeated_events_come_once_and_count_in_windows(spark, folder, tmp_path):
    path = folder([(1, "l", "e", 10.0), (1, "l", "e", 10.0), (2, "l", "e", 70.0)], EVENTS, 0)
    assert sorted(r["id"] for r in drain(L.once_within(L.tail(spark, path, EVENTS), "id", "at"), "once", tmp_path)) == [1, 2]
    counts = drain(L.counts_per_window(L.tail(spark, path, EVENTS), "at", "1 minute", "10 seconds", "kind"), "windows", tmp_path, "complete")
    assert sorted(r["events"] for r in counts) == [1, 2]


def test_labels_report_changes_only(spark, folder, tmp_path):
    schema = "id long, label string, at double"
    path = folder([(1, "fresh", 1.0), (1, "fresh", 2.0), (1, "stale", 3.0), (2, "fresh", 1.0)], schema, 0)
    out = {(r["id"], r["before"], r["label"]) for r in drain(L.label_transitions(L.tail(spark, path, schema)), "labels", tmp_path)}
    assert out == {("1", None, "fresh"), ("1", "fresh", "stale"), ("2", None, "fresh")}


def test_leases_expire_unless_closed(spark, folder, tmp_path):
    schema = "id string, at double, due double, closed boolean"
    path = folder([("a", 1.0, 5.0, False), ("b", 1.0, 5.0, False), ("b", 2.0, 5.0, True), ("c", 1.0, 500.0, False)], schema, 0)
    assert drain(L.lease_expiries(L.tail(spark, path, schema)), "leases", tmp_path) == []
    found = []
    for n, at in enumerate((100.0, 101.0), 1):
        folder([(f"d{n}", at, 900.0, False)], schema, n)
        found += drain(L.lease_expiries(L.tail(spark, path, schema)), "leases", tmp_path)
    assert [(r["id"], r["due"]) for r in found] == [("a", 5.0)]


def test_sweep_emits_changes(spark):
    seen = []
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, hash string")
    query = L.sweep(spark, lambda: files(("a", "1"), ("b", "2"), ("c", "3")), lambda: files(("a", "1"), ("b", "9"), ("d", "4")), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect())), seconds=1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen[0] == [("b", "modified"), ("c", "added"), ("d", "deleted")]
