"""Rows with nulls, empty and long texts, ties and repeated rows, and columns whose names clash with the operators' own."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "rep long, root long, k string, shard int, z string, block int, size long, whole string, at long, th long, node long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def clashing(df):
    from pyspark.sql import functions as F

    for part in CLASHING.split(", "):
        name, kind = part.split()
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def odd_texts(seed=1):
    rng = random.Random(seed)
    return [None, "", "   \n", "one", "Ünïcödé 漢字 ́x", "a b c d", words(rng, 60), words(rng, 12_000), "x" * 5000, "same text here now again", "same text here now again"]
