import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lower string, row long, score double"


def doc(doc_id, text, lang="en", source="src0"):
    """A row with extra columns whose names clash with those the operators use inside."""
    return (doc_id, text, lang, source, len(text) if text is not None else None, "x", 7, 0.5)


@pytest.fixture
def docs(spark):
    def build(*rows):
        return spark.createDataFrame([x if len(x) > 4 else doc(*x) for x in rows], SCHEMA)

    return build


def prose(seed, words, vocabulary=400):
    chosen = random.Random(seed)
    names = ["".join(chosen.choice("aeioubcdfgklmnprst") for _ in range(chosen.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(chosen.choice(names) for _ in range(words))


LONG = prose(99, 20_000)
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "!!!"), (5, LONG), (6, LONG), (6, LONG), (None, "a b"), (None, None), (7, "a  b")]
