import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every hard case: nulls, empty and very long texts, repeated rows, copies, near copies, no letters."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 60, "p")
    out = [
        (0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), None, "a"),
        (3, None, "en", "b"), (4, "", "fr", None), (5, "!!! ... 12", None, "b"), (None, "no id here at all", "en", "a"),
        (6, words(rng, 40, "x") + " " + passage + " " + words(rng, 40, "y"), "fr", "b"),
        (7, passage + "\n" + words(rng, 30, "z"), "fr", "b"),
        (8, words(rng, 30_000, "long"), "en", "a"),
        (9, "one two three", "en", "a"), (10, "one two three", "fr", "a"),
        (11, "Straße  des\tFriedens\x0b<|endoftext|> don't 12,5 «fin»…", "fr", "b"),
    ]
    out += [(100 + k, words(rng, rng.randrange(5, 90)), "en" if k % 2 else "fr", "c") for k in range(30)]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def odd(docs):
    """The same documents with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "key", "rid", "node", "score", "marks", "n_words", "class", "lowered_text", "ids", "rest", "salt", "h", "n", "letter")
    return docs.withColumns({n: F.lit(f"clash {n}") for n in names})
