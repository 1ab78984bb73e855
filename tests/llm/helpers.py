"""Small tables with the awkward rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur " * 6000
AWKWARD = [
    (1, "The cat sat on the mat near the door and looked at the bird outside", "en"),
    (1, "The cat sat on the mat near the door and looked at the bird outside", "en"),
    (2, "", "en"),
    (3, None, None),
    (None, "a text without an identifier", "en"),
    (4, LONG, "en"),
    (5, "word", None),
    (6, "éè \U0001f600 !?  \t\n", "fr"),
    (7, "Der Hund lief über die Straße", "de"),
]
#: Names that operators use inside.
CLASHES = ["node", "sig", "score", "key", "kind", "shard", "ids", "media", "toxic", "level", "pair", "rank", "n"]


def docs(spark, rows=AWKWARD):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def empty(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
