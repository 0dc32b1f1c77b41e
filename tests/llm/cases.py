"""Awkward tables that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(made))[:-1] + "."


COPY = prose(1, 120)
LONG = prose(2, 60_000)
ROWS = [
    (1, COPY, "en", "a", 5),
    (2, COPY, "en", "b", 5),
    (3, prose(3, 80) + " " + " ".join(COPY.split()[10:80]), None, "a", None),
    (4, None, "en", "a", 0),
    (5, "", "en", None, 0),
    (6, "  \n\t ", "en", "b", 3),
    (None, prose(4, 70), "fr", "c", 1),
    (8, LONG, "en", "a", 1),
    (9, "one two three.", None, None, None),
    (9, "one two three.", None, None, None),
    (10, "the the the the the the the the the the the the. " * 40, "en", "a", 1),
    (11, "Ünïcode — текст 漢字 \U0001f600 ​  line. " * 9, "xx", "c", 1),
    (12, prose(5, 100), "en", "a", 1),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(spark, rows=ROWS):
    """The same with further columns, one of them clashing but for case, one in full."""
    from pyspark.sql import functions as F

    df = table(spark, rows).withColumn("extra", F.lit(1))
    return df.select("*", F.lit("x").alias("TEXT"), F.lit("y").alias("Doc_ID"), F.lit(7).alias("label"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
