import random

import pytest

WORDS = "the of and a to in is that it was for on are as with his they be at one have this from or had by not but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(11)
    return lambda n, seed=None: " ".join((random.Random(seed) if seed is not None else rng).choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = prose(20_000, 5)
    rows = [
        (1, prose(40, 1), "a"), (2, None, "a"), (3, "", None), (None, prose(40, 1), "b"), (5, prose(40, 1), None), (5, prose(40, 1), None), (6, "one two", "b"), (7, "one two", "b"),
        (8, "  \n\t ", "c"), (9, long, "c"), (10, long + " tail", "c"), (11, "x" * 70_000, "d"), (12, "naïve été 漢字 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "d"), (13, "<|im_end|> \\ <|endoftext|>", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", "7L AS n_chars", "'x' AS id", "1 AS uid", "2 AS size", "'k' AS kept", "3 AS `a.b`", "0 AS _")
