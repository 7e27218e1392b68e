import pytest

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta."), (2, None), (3, ""), (4, " \t\n "), (None, "Alpha beta gamma delta epsilon zeta."),
    (5, "tie " * 30), (6, "tie " * 30), (6, "tie " * 30), (7, "é😀 token = \"abcDEF123456\" x"), (8, "wort " * 30_000),
    (9, "one"),
]


def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, None if k % 2 else "x", k, 1.0, "y") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard int, spans double, ids string")


@pytest.fixture
def odd_docs(spark):
    return odd(spark)


@pytest.fixture
def no_docs(spark):
    return odd(spark).limit(0)


@pytest.fixture(scope="session")
def small(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}
