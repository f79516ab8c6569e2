"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows."""

LONG = "alpha beta gamma delta. " * 20_000
ROWS = [
    (1, "one two three. Four five!\nsix seven", "en", "s", 10),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "   \n\t \n", "en", "s", 7),
    (5, LONG, "en", "s", len(LONG)),
    (6, "é ñ ü 中文 \U00010348 word", "de", "s", 12),
    (None, "a text without an id", "en", "s", 20),
    (7, "twice the same row", "en", "s", 18),
    (7, "twice the same row", "en", "s", 18),
    (8, "x" * 5000, "en", "s", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """The rows, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("k_id", "k_text", "fp", "cell", "score", "kept", "t_text", "t_id", "t_bucket", "bucket", "ids", "n_words", "low", "root", "label", "component_id", "d_id", "value")})


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
