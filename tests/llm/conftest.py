import random

import pytest

CLASHING = ["group_id", "keep", "a", "b", "key", "n", "regs", "text_a", "length", "rank", "salt", "total", "s", "kind", "id", "gram", "ts", "digest", "unit", "score", "name", "item_id", "bands", "lang_id", "runs", "piece", "h1", "__gone", "toxic", "value"]


def prose(seed, n):
    r = random.Random(seed)
    words = "the of and to in that is was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which".split()
    return " ".join(r.choice(words) + r.choice(["", "", "", "ing", "er", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, copies, repeated rows and columns of clashing names."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "s", 10), (2, base, "en", None, None), (2, base, "en", None, None), (3, base.upper().replace(" ", "  "), None, "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \n\t ", "en", "s", 3),
        (None, base, "en", "s", 5), (None, None, None, None, None), (7, prose(7, 200_000), "en", "s", 1), (8, "x", "en", "s", 1), (9, prose(9, 50), "en", "s", 2), (10, "…—é漢字🙂" * 20, "en", "s", 4), (11, "\x00\x7f" * 30, "en", "s", 4),
        (12, prose(9, 50).replace("the", "THE!"), "fr", "s", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHING}).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
