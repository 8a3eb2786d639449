import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, score double, part int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and ids."""
    long_text = "word " * 30_000 + "x" * 50_000
    base = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, base + " extra"), (5, ""), (6, None), (7, "   \n\t "), (8, "one two"),
        (9, "one  two"), (10, long_text), (10, "other text of the same id"), (None, base), (None, None), (None, "a b c d e f"),
        (11, "é ñ 日本語 😀"), (12, "one three"), (-5, "negative id text with a few words"), (2**40, "big id"),
    ]
    return [(i, t, None if n % 3 else "en", None, None if t is None else len(t), n, 1, 0.5, n) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
