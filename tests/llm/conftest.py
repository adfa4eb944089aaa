import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and then the cat ran away", "en", "a", 48),
        (1, "the cat sat on the mat and then the cat ran away", "en", "a", 48),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "el gato come en la casa de la gata y luego duerme", None, "b", 3),
        (None, None, None, None, None),
        (4, "word " * 60_000, "en", "b", 300_000),
        (5, "x" * 200_000, "es", "c", 200_000),
        (6, "?! 123", "es", "c", 6),
        (7, "日本語のテキスト \U0001f600 <|endoftext|> é", "es", "c", 9),
        (8, " \t\n", "en", "", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("score", "size", "target", "_id", "n_words", "spans", "items", "lang_pred", "quality_score", "toxicity", "c", "x", "fp")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
