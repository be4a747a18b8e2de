import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, rid string, k string, size string, held_out string, spans string, bin string, uid string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(("an", "er", "on", "th", "st", "io", "ei", "ou")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts by id: prose, copies, near copies, a shared passage, nulls, blanks, a very long text, odd characters."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(20, 160)) for _ in range(24)]
    passage = sentence(rng, 60)
    texts += [texts[0], texts[0], texts[1] + " end", texts[2].replace("an", "AN", 1)]
    texts += [f"{sentence(rng, 10)} {passage} {sentence(rng, 10)}" for _ in range(6)]
    texts += [None, "", "  \t\n ", "12345 !!! ###", "Ünïcödé 日本語 ☃", "a", "a b", "x" * 5000, "ab " * 9000, "line\nline\nline\n\nother\nline"]
    texts += ["the the the " * 40, "mail a.b@c.de, 10.0.0.256 or 10.0.0.1; +1 (974) 555-3436; 4111 1111 1111 1111 and 5500000000000004"]
    return texts


@pytest.fixture(scope="session")
def rows(corpus):
    """Rows of SCHEMA, with clashing column names, null columns, repeated rows and a null id."""
    made = [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], (None, "s1", "s2", "s3")[i % 4], None, "x", None, "x", "x", "x", None, "x", "x", "x") for i, t in enumerate(corpus)]
    return made + [made[3], made[3], (None, "text without an id " * 12, *made[0][2:]), (5, "another text of an id that is there", *made[0][2:])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
