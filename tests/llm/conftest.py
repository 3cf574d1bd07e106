import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside.
CLASHES = ("norm", "recipe", "chunks", "h", "key", "a", "b", "_l", "covered", "_cid", "rep", "bands", "ids", "decoded", "lang_pred", "lang_score", "_kept", "_topic", "_cs", "_id", "score", "text_sha256", "_n_lines", "label_a", "small", "text_hash", "node", "r", "t", "u")

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, "   \n\t ", "en", "src0", 5),
    (4, "A b c", "en", None, 5),
    (4, "A b c", "en", None, 5),
    (None, "no id here", None, "src1", 10),
    (6, "A  b\tc", None, "src1", 6),
    (7, "ünï cödé — text\n…\n\x00 nul 😀 end", "de", "src2", 30),
    (8, "12345 !!! ???", "fr", "src2", 13),
    (9, "one", "es", "src3", 3),
]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows and clashing extra columns."""
    df = spark.createDataFrame(ODD + [(10, "word " * 40_000, "en", "src0", 200_000), (11, "x" * 100_000, "en", "src0", 100_000)], SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
