import random

import pytest

from codelode.llm.prose import Profiler, aligned_lines, autocorrelation, first_shapes, indent_period, not_prose, text_statistics

PROSE = {
    "en": "We looked at the parser for a while and it was not clear to us why it would fail. The test that was there before is gone, so we wrote another one for it.",
    "de": "Wir haben den Parser geprüft, und es ist noch nicht klar, warum er bei dieser Datei nicht mehr läuft. Der Test ist weg, weil er nur einmal im Jahr lief.",
    "fr": "Nous avons regardé le code et il n'est pas clair pour nous que cela soit encore utile dans ce cas. Le test est parti avec la première version du module.",
    "es": "No se sabe por qué la prueba no funciona con los datos que hay en el archivo. El equipo ya no está y todavía hay dos cosas que se tienen que hacer.",
}
random.seed(5)
NOUNS = "parser token record shard ledger bucket cursor window filter packet".split()
SALAD = " ".join(random.choice(NOUNS) for _ in range(200))
NOT_PROSE = {
    "table": "| a | b |\n|---|---|\n| parser | 12 |\n| token | 15 |\n| record | n/a |",
    "comma": "name,size,kind\nparser,12,x\ntoken,,y\nrecord,7,z",
    "columns": "name      size\nparser      12\ntoken       15\nrecord       7",
    "list": "Things to do.\n- parser\n- the token file\n  - record\n- shard",
    "pairs": "parser: 12\ntoken = yes\nrecord .... no\nshard: 7",
    "code": "def f(a):\n    if a is None:\n        return b[0]\n    for x in c:\n        g(x, y=1)\n    return {'a': d}",
    "salad": SALAD,
    "again": "the test is not in the file and it is so. " * 50,
    "hex": "\n".join(f"{random.randrange(16**12):012x} {random.randrange(16**12):012x}" for _ in range(12)),
}


@pytest.mark.parametrize("lang", PROSE)
def test_prose(lang):
    assert Profiler().profile(PROSE[lang])[-1] > 0.9
    assert Profiler().profile(PROSE[lang].replace(" ", "\n", 3) + "\n- parser\n- token\n")[-1] >= 0.5


@pytest.mark.parametrize("kind", NOT_PROSE)
def test_not_prose(kind):
    assert Profiler().profile(NOT_PROSE[kind])[-1] < 0.5


def test_wrapped_prose_is_prose_at_every_length():
    words = (PROSE["en"] + " " + PROSE["de"]).split()
    for n in (40, 400, 40_000):
        random.seed(n)
        some = [w for _ in range(n // 40) for w in random.sample(words, 40)]
        lines = [" ".join(some[i : i + 7]) for i in range(0, len(some), 7)]
        assert Profiler().profile("\n".join(lines))[-1] > 0.7, n


def test_layout():
    assert aligned_lines(["a | b", "c | d", "plain words of a sentence"]) == [True, True, False]
    assert first_shapes(["- a", "- b", "c"]) == ["mark-", "mark-", None]
    assert indent_period(["a", "  b", "a", "  b", "    c"])[0] == 2
    assert autocorrelation([3, 9] * 10) > 0.9
    assert autocorrelation([1, 2]) == 0.0


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, PROSE["en"], "x"), (4, PROSE["en"], "x"), (5, NOT_PROSE["list"], "x"), (None, NOT_PROSE["table"], "x"), (6, "a" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    out = {r["doc_id"]: r for r in text_statistics(docs).collect()}
    assert out[1]["blank"] and out[3]["blank"] and out[2]["words"] == 0
    assert out[4]["words"] == 34
    assert sorted((r[0] or 0) for r in not_prose(docs).collect()) == [0, 5, 6]
    assert not_prose(docs.limit(0)).count() == 0
