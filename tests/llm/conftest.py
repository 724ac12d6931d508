import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words) + "."


@pytest.fixture(scope="session")
def texts():
    """Seeded prose: 60 different texts of 20 to 200 words."""
    rng = random.Random(7)
    return [" ".join(sentence(rng, 10) for _ in range(rng.randint(2, 20))) for _ in range(60)]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Prose with copies in other case, near copies, null and empty texts, a null id, repeated rows and a long text."""
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper(), "de", None, None) for i, t in enumerate(texts[:5])]
    rows += [(200 + i, " ".join([*t.split(" ")[:-1], "changed."]), "en", "s", 1) for i, t in enumerate(texts[10:20])]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "   ", "en", "s", 3), (303, "Two words", "en", "s", 9)]
    rows += [(None, texts[3], "en", "s", 1), (7, texts[7], "en", "s", len(texts[7]))]
    rows += [(400, " ".join(texts * 3), "en", "s", 1), (401, "x" * 50_000, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "node", "row", "norm", "range", "run", "root", "value", "weight", "kept", "digest", "tokens", "a", "b"]
    return documents.withColumns({n: F.lit(n) for n in names})
