import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row string, rate double, key string, held_out string, html string, doc_lang string, source_2 string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(3)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(25)]
    long = " ".join(word() for _ in range(40_000))
    texts = [None, "", " ", "\n\n", "one", "two words", "é ü ß 漢字 🙂 x", "A" * 30_000, long, "<b>&amp;</b> &lt; tag", "tab\tand\x0bvt\x0cff\rcr", "nul\x00byte", *prose, prose[0], prose[0], prose[1] + " extra"]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, prose[2], None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 9, 9, "row", 9.0, "key", "held", "html", "xx", "s") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")

