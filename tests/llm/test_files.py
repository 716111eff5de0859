from codelode.llm.lang import with_language
from codelode.llm.syntax import broken_files, broken_rates, parse_files


def sources(spark):
    texts = spark.createDataFrame(
        [("r/a.py", "x = 1\n"), ("r/b.py", "x = \n"), ("r/b.py", "x = \n"), ("r/c.js", "let x = 1"), ("r/d.x", "?"), ("r/e.py", ""), ("r/f.json", ""), ("r/g.py", None), (None, "x ="), ("s/h.h", "int f(void) {"), ("s/i.py", "let x = 1;")],
        "path string, text string",
    )
    files = spark.createDataFrame(
        [("r/a.py", "python", 1.0, "clash"), ("r/c.js", "other", 1.0, "c"), ("s/i.py", "python", 1.0, "c"), ("s/i.py", "JavaScript ", 2.0, "c"), ("s/i.py", None, 3.0, "c"), (None, "python", 1.0, "c")],
        "path string, lang string, indexed_at double, text string",
    )
    return with_language(texts, files)


def test_the_last_known_language_holds_else_the_extension(spark):
    said = {r["path"]: r["lang"] for r in sources(spark).collect()}
    assert said == {"r/a.py": "python", "r/b.py": "python", "r/c.js": "javascript", "r/d.x": None, "r/e.py": "python", "r/f.json": "json", "r/g.py": "python", "s/h.h": "c", "s/i.py": "javascript"}


def test_broken_files_and_rates(spark):
    rows = sources(spark)
    assert sorted(r["path"] for r in broken_files(rows).collect()) == ["r/b.py", "r/f.json", "s/h.h"]
    parsed = {r["path"]: (r["parsed"], r["error_line"]) for r in parse_files(rows).collect()}
    assert parsed["r/d.x"] == (False, None) and parsed["r/b.py"] == (True, 1) and "r/g.py" not in parsed
    rates = {(r["repository"], r["lang"]): (r["files"], r["broken"], r["rate"]) for r in broken_rates(rows).collect()}
    assert rates[("r", "python")] == (4, 2, 0.5) and rates[("s", "c")] == (1, 1, 1.0)
    assert broken_files(rows.limit(0)).count() == 0


def test_a_very_long_text_is_parsed_whole(spark):
    rows = spark.createDataFrame([("a.js", "f(1);\n" * 50_000 + "f(;", "javascript"), ("b.py", "f(1)\n" * 50_000, "python")], "path string, text string, lang string")
    assert {r["path"]: r["error_line"] for r in parse_files(rows).collect()} == {"a.js": 50_001, "b.py": None}
