import os

from codelode.plans.scratch import cut, scope, shared_dir
from codelode.plans.sizing import parts_for


def test_a_scope_deletes_its_tables(spark):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    kept = cut(spark.range(3))
    before = set(os.listdir(folder))
    with scope():
        inside = cut(spark.range(5))
        assert inside.count() == 5
        assert len(os.listdir(folder)) == len(before) + 1
    assert set(os.listdir(folder)) == before
    assert kept.count() == 3


def test_parts():
    assert parts_for(0, 10) == 1 and parts_for(11, 10) == 2 and parts_for(10**9, 1, most=50) == 50
