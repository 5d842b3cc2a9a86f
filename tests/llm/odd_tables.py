"""Fixtures: small tables with every kind of odd row."""

import pytest

#: columns whose names the operators use inside
EXTRA = ["_text", "uid", "key", "rep", "spans", "t", "host", "hash", "score", "label", "text_", "turns", "_k_text"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeats, ties, very long texts, clashes."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(20_000))
    texts = [
        (1, base * 2), (2, base * 2), (2, base * 2), (3, base.upper() * 2), (4, base * 2 + "one more"),
        (5, None), (6, ""), (7, "  \n\t "), (8, "a b"), (9, "A  b"), (None, base), (None, None), (10, long), (11, long + " end"),
        (12, "password = hunter2222 and AKIA" + "A1" * 10 + " then " + "0123456789abcdef" * 3),
        (13, "naïve café 日本語 ▁ \U0001d11e mail a.b@c.example.org or +49 30 1234567 ip 10.0.0.1 card 4111 1111 1111 1111"),
        (14, "no letters? 123 456 !!!"), (15, "ç " * 120 + "tail"), (16, "a" * 5000), (17, "12345 !!! ???"),
    ]
    return [(i, t, ("en" if (i or 0) % 2 else "fr") if i != 4 else None, f"src{(i or 0) % 3}", len(t) if t else None) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(EXTRA)}).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
