"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as Parquet to
the shared folder and read again. All but the last return the columns of documents, and keep any further ones.

Defined results for odd rows, unless a stage says otherwise: columns other than doc_id, text, lang and source may be missing or
null; an empty table gives no rows; columns whose names clash with the stages' own are kept as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.llm import langid, minhash, mixing, packing, pii
from pagevault.llm.common import bounded, cut
from pagevault.llm.queries import vocabulary
from pagevault.shared import delete, own_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language's centroids come near, and those without letters; only these if no document tells
    its language.

    Null and empty texts have no letters and go; null lang, source and doc_id change nothing; of repeated rows and equal texts
    all stay or all go; very long texts are judged whole.
    """
    bounded(spark)
    model = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return langid.accepted_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: similarity 0.80 or more over five-word shingles.

    Of rows with the same id and text, or the same text and no id, one stays. Different texts with one id are one document,
    and all stay; rows without id are not compared with others further than that. Null, empty and blank texts are no near
    copies of each other; repeated rows of them are reduced like others.
    """
    dropped = minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # one column, so that no name clashes with those beside it
    key = ["id", "text_1", "text_2"]
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_1"), F.xxhash64("text", F.lit(2)).alias("text_2"), row)
    rest = rows.join(dropped, "id", "left_anti")
    repeated = cut(rows.groupBy(*key).count().where("count > 1").select(*[F.col(k).alias(f"{k}_r") for k in key]), docs.count())
    if not repeated.isEmpty():
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in key])
        told_apart = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
        first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*told_apart)))
        one = rest.join(repeated, same, "left_semi").withColumn("first", first).where("first = 1")
        rest = rest.join(repeated, same, "left_anti").select("row").unionAll(one.select("row"))
    return rest.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and counts the characters anew where there is a count.

    Every row stays. Null texts stay null; equal texts are changed alike; very long texts are searched whole.
    """
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources up to their targets; a document is there as often as it is taken.

    Rows without source are a source of their own, the last; null and empty texts have no words and come as often as their
    block is taken; rows that share an id are taken alike, and rows without id are one block of their source.
    """
    return mixing.mixed_rows(docs, weights=(1, 2, 3), most=3)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token sequences: one row per piece.

    Each row is a document of its own, also if ids repeat or are null; null and empty texts are their end id alone; texts
    above 4096 tokens, however long, are cut and nothing is lost.
    """
    return packing.pack(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII", private_data),
    ("mixing", source_mixing),
    ("best-fit packing", sequence_packing),
]

#: No SQL expresses a tokenizer or a trained model: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stage folders go as soon as the next stage is written, and the last when the session ends."""
    folder = own_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            delete(spark, f"{folder}/{n - 1}")
    return docs
