"""Small tables with everything that may go wrong, shared by the tests of the corpus operators."""

import random

import pytest

LONG = "thé quick brown Fox, jumps over 12 lazy dogs\n" * 4000
PASSAGE = "This passage of some sixty bytes stands in several documents."


def make_texts():
    rng = random.Random(5)
    words = "alpha beta Gamma delta épsilon zeta eta theta ### | iota MIT License apache license general public".split()
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(25)]
    near = prose[3] + " one more word"
    odd = ["", " ", "\n\n", "a", "  two  words ", "tab\tand\x0bothers\x0c\r\n", "\xa0nbsp\u2003x", "日本語 テキスト", "<|endoftext|> x <s> </s> <unk>", "\x00\x01 zero", "😀" * 50]
    return prose + [prose[0], prose[0], near, *odd, PASSAGE, f"before {PASSAGE} after", f"{PASSAGE}{PASSAGE}", LONG]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def hard(spark, texts):
    """doc_id, text and columns whose names clash with what operators return; null ids and texts, repeated rows."""
    rows = [(i, t, "en", -1, "x", "y", 1.5) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None), (None, "alpha beta gamma", "en", 1, "x", "y", 0.0), (None, None, None, None, None, None, None)]
    rows += [rows[1], rows[1]]
    random.Random(1).shuffle(rows)
    schema = "doc_id long, text string, lang string, n_tokens int, fp string, kept string, row double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def hard_rows(hard):
    return [(r.doc_id, r.text or "") for r in hard.select("doc_id", "text").collect()]
