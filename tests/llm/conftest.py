import random

import pytest
from plain import near, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, white space, several scripts."""
    rng = random.Random(5)
    base = words(rng, 120)
    texts = [None, "", "   ", "\n\n\t", "one", "two words", "a b c d", "a b c d e", "A B C D E", base, base, base.upper(), near(rng, base, 1), near(rng, base, 2), near(rng, base, 60)]
    texts += ["x" * 3000, "é" * 700, "ab " * 9000, words(rng, 6000), "日本語 テスト です 。 " * 30, "tab\tand  two   spaces \n end ", "don't I'll we've 12 345 !!! ?? <|endoftext|>", "line\nline\nline\nother line\n\nother line"]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 else "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "text without an id here", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([r for r in odd_rows if r[0] is not None], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
