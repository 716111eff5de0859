import pytest

from codelode.llm.origin import Layout, by_path, file_origins, judge

HAND = "import os\n\n\ndef f(a):\n    # generated ids are checked by the caller\n    return a\n"


@pytest.mark.parametrize(
    "path,text,lang,kind",
    [
        ("r/a.py", HAND, "python", None),
        ("r/a.py", "# Code generated by x 1.2. DO NOT EDIT.\n" + HAND, "python", "generated"),
        ("r/a.py", "# automatically written from the q schema\n" + HAND, "python", "generated"),
        ("r/a.py", HAND + "# This file was produced by x from y.idl\n", "python", "generated"),
        ("r/a.py", HAND + "# the header we emit says DO NOT EDIT\n", "python", None),
        ("r/a.py", 'S = """\nCode generated by x. DO NOT EDIT.\n"""\n' + HAND, "python", None),
        ("r/a.py", "# Part of r. Licensed with the rest of r.\n" + HAND, "python", None),
        ("r/a.py", "# Released under the MIT licence\n" + HAND, "python", None),
        ("r/a.py", "# Copyright (c) 2020 the otherlib project\n" + HAND, "python", "vendored"),
        ("r/a.js", "/*! otherlib v1.2.3 | (c) otherlib contributors */\nlet a = 1;\n", "javascript", "vendored"),
        ("r/third_party/x/a.py", HAND, "python", "vendored"),
        ("r/vendor_portal/a.py", HAND, "python", None),
        ("r/web/lib/1.4.2/a.py", HAND, "python", "vendored"),
        ("r/x/lib-1.4.2.py", HAND, "python", "vendored"),
        ("r/x/a.min.js", "let a = 1\n", "javascript", "minified"),
        ("r/x/a.js", "function f(a){return a+1};" * 40, "javascript", "minified"),
        ("r/x/a.py", "T = [\n" + "    'abcdefgh', 123456789,\n" * 20 + "]\n", "python", "data"),
        ("r/x/a.json", '{"a": 1, "b": {"generatedBy": "x"}}', "json", None),
        ("r/x/a.json", '{"a": [1, {"c": 2}], "b": 3, "d": 4, "e": 5, "f": 6, "generatedBy": "x"}', "json", "generated"),
        ("r/x/a.go", "package p\n" + "".join(f"func Get{i}() int {{\nreturn x.a{i};\n}}\n" for i in range(60)), "go", "generated"),
        ("r/a.py", "", None, None),
    ],
)
def test_kinds(path, text, lang, kind):
    assert judge(path, text, lang)[0] == kind


def test_canonical_form():
    layout = Layout("if (a) { b(1, 2); c = [1, 2] }", "javascript")
    assert layout.emit() == "if ( a ) {\n  b ( 1 , 2 ) ;\n  c = [ 1 ,\n    2 ]\n}"
    assert layout.expansion == 5
    assert Layout("a = 1;\nb = 2;\n", "javascript").uniformity == 1.0
    assert Layout("", "javascript").expansion == 0.0


def test_paths():
    assert by_path("r/gen/a.py") == "generated"
    assert by_path("gen/src/a.py") is None


def test_rows(spark):
    rows = spark.createDataFrame(
        [("r/a.py", None, "python", 1), (None, "x", "python", 1), ("r/b.py", "", None, 1), ("r/b.py", "", None, 1), ("r/c.js", "let a=1;" * 100_000, "javascript", 1)],
        "path string, text string, lang string, kind int",
    )
    out = file_origins(rows)
    assert sorted((r["path"], r["kind"]) for r in out.collect()) == [("r/b.py", None), ("r/b.py", None), ("r/c.js", "minified")]
    assert file_origins(rows.limit(0)).count() == 0
