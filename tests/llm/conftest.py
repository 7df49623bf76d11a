import pytest

CLASH = ["lang_pred", "score", "kept", "spans", "sequence_id", "offset", "item_id", "chunk", "n_words", "fail_bits", "component_id", "node", "body", "redacted"]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and blank texts, repeated rows, ties, one very long text, odd characters."""
    prose = "The cat sat on the mat and looked at the moon over the quiet house by the river while rain fell. "
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(60_000))
    return [
        (1, prose * 3), (2, prose * 3), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "a"), (8, "%%% ### 42"), (9, "Ünïcödé ñandú été 中文字 🙂 " * 40),
        (10, prose * 3 + "extra words here"), (10, prose * 3 + "extra words here"), (None, prose * 2), (None, None), (12, "x" * 50_000),
        (13, "mail me at jane.doe@example.org or +1 (017) 555-7713 from 10.0.0.1, card 4111111111111111"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in edge_rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    """A small driver table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
