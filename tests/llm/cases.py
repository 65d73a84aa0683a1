"""Small tables with the cases every operator must handle."""

AWKWARD = [
    (1, "the cat sat on the mat and the dog lay by the fire", "en", "s1", 50),
    (2, "the cat sat on the mat and the dog lay by the fire", "en", "s1", 50),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, " \t\n ", "en", "s2", 3),
    (None, "no id here but some words", "en", "s1", 5),
    (1, "the cat sat on the mat and the dog lay by the fire", "en", "s1", 50),
    (7, "é ü 漢字   x y \x00 z", "xx", "s3", 7),
    (8, "word " * 60_000, "en", "s3", 300_000),
    (9, "0123456789" * 40, "en", "s3", 400),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, clashing=()):
    """The table, with extra columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in clashing})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
