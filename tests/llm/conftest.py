import os

import pytest

SF = "/root/testdata/sf0.001"

#: Names that the operators use for themselves.
CLASHES = {"n": 1, "h": "x", "size": 5, "key": "k", "host": "a", "kept": True, "cut": 1, "fp": 2, "component": 3, "u": 4, "v": 5, "rank": 6, "before": 7, "th": 8, "pos": 9, "line": "l", "target": 0.5, "w": 1, "__own": 2, "gram": "g"}


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s1"),
        (1, "alpha beta gamma delta epsilon", "en", "s1"),
        (2, None, "en", "s1"),
        (3, "", None, None),
        (4, " \t\n ", "de", "s2"),
        (None, "nobody knows this document by name", None, None),
        (5, "word", "fr", "s2"),
        (6, "Two words", "fr", "s3"),
        (7, "long " * 60_000, "en", "s3"),
        (8, "é ü 漢字 😀 \x00 \x85 text", None, "s1"),
        (9, "\n".join(["the same line stands here again"] * 5), "en", "s2"),
        (10, " ".join(f"w{k}" for k in range(200)), "en", "s4"),
        (11, " ".join(f"w{k}" for k in range(200)), "de", "s5"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF
