import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with names that operators use themselves."""
    long = prose(1, 3000)
    near = long.split(" ")
    near[5] = "changed"
    rows = [
        (1, prose(2, 60), "en", "s", 10, "x"), (2, prose(2, 60), "en", None, 10, "x"), (3, None, None, None, None, None), (None, prose(3, 40), "de", "s", 5, "x"), (None, prose(3, 40), "de", "s", 5, "x"),
        (4, "", "en", "s", 0, "x"), (5, " \n\t ", None, "s", 4, "x"), (6, long, "fr", "s", 1, "x"), (7, " ".join(near), "fr", "s", 1, "x"), (8, "two words", "en", "s", 9, "x"), (8, "two words", "en", "s", 9, "x"),
        (8, prose(9, 30), "en", "s", 9, "x"), (9, "1 2 3", "en", "s", 9, "x"), (10, "Two  WORDS", "en", "s", 9, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return df.selectExpr("*", "1 AS slot", "'a' AS cid", "2 AS n", "true AS kept", "3 AS _text")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
