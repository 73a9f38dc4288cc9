import pytest

ODD = [
    (1, "the same text here"),
    (2, "the  same\ttext here"),
    (3, None),
    (4, ""),
    (5, "a b"),
    (2, "the  same\ttext here"),
    (None, "no id but some words to read here"),
    (7, "word " * 20_000),
    (8, "x" * 100_000),
    (9, "the same text here!"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    extra = "kept string, digest int, node string, row int, id int, bands int, maybe string, first int"
    rows = [(i, t, "s", i, "s", 1, 1, 1, "s", 1) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")
