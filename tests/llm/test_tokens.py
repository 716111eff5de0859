import random

import numpy as np

from codelode.llm import tokens
from codelode.llm.tokens import chunks, encode_corpus, encoder, join_chunks, parts_of, vocabulary


def random_text(rng, n):
    alphabet = ["a", "b", "the", "Über", "世界", "é", "'s", "'", "123", "4", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "!", "...", "😀", "<|endoftext|>", "_", "\x1c", "﻿"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_chunks_make_the_text_and_repeat_where_it_repeats():
    rng = random.Random(1)
    shared = random_text(rng, 4000)
    a, b = random_text(rng, 900) + shared, random_text(rng, 1700) + shared
    assert "".join(chunks(a)) == a and "".join(chunks(b)) == b
    assert len(set(chunks(a)) & set(chunks(b))) > 5
    assert all(len(c) <= tokens.LONGEST + tokens.SHORTEST for c in chunks("x" * 100_000))
    assert chunks("") == [""]


def test_joined_chunks_equal_direct_encoding():
    encode = encoder(vocabulary()).encode_ordinary
    rng = random.Random(2)
    texts = [random_text(rng, n) for n in (1, 50, 600, 3000, 8000) for _ in range(6)] + ["x" * 9000, " " * 9000, "ab" * 5000, "\n" * 3000 + "a" + " " * 3000, "世" * 4000]
    for text in texts:
        pieces = []
        for chunk in chunks(text):
            split = parts_of(chunk)
            head, middle, tail = split or (chunk, "", "")
            pieces.append((split is None, head, np.asarray(encode(middle), "<u4").tobytes(), tail))
        assert join_chunks(pieces, encode).tolist() == encode(text)


def test_rows(spark):
    encode = encoder(vocabulary()).encode_ordinary
    long = "The parser was not there, so we wrote it again. " * 2000
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b"), (5, "a b"), (6, long), (7, "x" + long), (None, "a b"), (None, "c"), (8, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    out = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in encode_corpus(docs).collect()))
    assert out == sorted((d or 0, encode(t) if t else []) for d, t in set(rows))
    assert encode_corpus(docs.limit(0)).count() == 0
