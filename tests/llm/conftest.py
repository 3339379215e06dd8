import random

import pytest

WORDS = "the of lorem ipsum dolor sit amet consectetur élan straße naïve 日本 don't 42 3.14 a-b_c <|endoftext|> &amp; x".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, simhash string, n_tokens string, payload string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, copies, near copies, shared passages."""
    r = random.Random(11)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", ".", "\n", "\t"]) for _ in range(n))
    passage = make(80)
    base = make(300)
    texts = [None, "", " \n\t", "one", "one two", "ONE two", make(30), base, base, base + " extra", passage, make(20) + passage, passage + make(40), make(25_000), "a" * 3000, "é" * 40 + "ü" * 40, "x<|endoftext|>y", "\x00 \x1c nul", passage[3:]]
    rows = [(i * 7 % 19, t, "en", "s", None if t is None else len(t), 1.0, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (100, base[:-40], "en", "s", 5, 1.0, "x", "y", "z")]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
