import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, a very long text, ties, repeated rows and a clashing extra column."""
    same = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, same, "en", "a", 5), (2, same, None, None, None), (3, None, "en", "a", 0), (4, "", "de", "b", 0), (5, " \n\t ", "de", "b", 4), (None, same, "en", "a", 3), (None, None, None, None, None),
        (6, "x " * 30_000, "en", "c", 60_000), (7, "tiny", "fr", "d", 4), (7, "tiny", "fr", "d", 4), (8, same + " and a tail of other words", "en", "a", 9), (9, "日本語 テキスト é ß \U0001f600 <|endoftext|> 12 'll", "ja", "e", 9),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({"n_words": F.lit("clash"), "row": F.lit(1), "doc": F.lit(2), "score": F.lit(0.5)})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
