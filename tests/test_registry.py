import __spark_entry__


def test_every_general_problem_has_a_query():
    numbers = {int(name[1:].split("_")[0]) for name in __spark_entry__.queries() if name[0] == "p" and name[1].isdigit()}
    assert {1, 2, 4, 6, 7} <= numbers


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
