import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, starts string, fp int, _to int"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "ri", "so", "en", "to", "ka"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and odd texts, copies, near copies, repeats, and a long text; extra columns with clashing names."""
    rng = random.Random(7)
    shared = "\n".join(words(rng, 8) for _ in range(5))
    long_text = "\n".join(words(rng, 40) for _ in range(400))
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " ", "x", "ÄÖ ß", "ＡＢＣ  d", "abc d", "日本語", "a\x00b", "1234 !!", long_text, long_text, base, " ".join(near), base.upper()]
    texts += [words(rng, 30) + "\n" + shared + "\n" + words(rng, 12) for _ in range(6)]
    texts += [words(rng, rng.randint(1, 200)) for _ in range(25)] + ["same text here"] * 5
    return [(i * 3, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[3]], DOCS).repartition(3)  # one row twice


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
