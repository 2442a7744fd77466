"""The operators applied to their whole tables with production parameters, and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, langid, lloyd, media, minhash, mixing, negatives, packing, phrases, pii, quality, urlfilter, vecdedup
from .common import read

#: A vocabulary file's name; queries take it from the public_tokenizers package.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(read(spark, sf_dir, "documents"), with_rgb=True)


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = langid.fit(documents.where(langid.remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    held_out = (langid.remainder("doc_id", 4) == 2).alias("held_out")
    return langid.predict(documents, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


#: The rules of the url filter: action, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    model, rates = urlfilter.fit(urlfilter.labelled_by_rules(pages, URL_RULES))
    return urlfilter.judge(pages, URL_RULES, model, rates)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op7_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=5, percent=85)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = quality.fit(documents, read(spark, sf_dir, "labels").where(langid.remainder("doc_id", 3) != 1))
    held_out = (langid.remainder("doc_id", 3) == 1).alias("held_out")
    return quality.score(documents, model).select("doc_id", held_out, "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.deduplicate(read(spark, sf_dir, "documents"), size=50)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    judged = cascade.judge(documents, cascade.plan(documents), with_counts=cascade.REPORTED)
    return judged.select("doc_id", *cascade.REPORTED, cascade.base_failed().alias("base_failed"), "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), anchors=F.col("id") % 100 == 0, positives=5, negatives=10, least_percent=30, most_percent=90, scale=256, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_private_data": op2_private_data,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filter": op5_url_filter,
    "op6_source_mixing": op6_source_mixing,
    "op7_vector_neardup": op7_vector_neardup,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op6_source_mixing": mixing.oracle(),
    "op11_centroid_clustering": lloyd.oracle(),
    "op12_quality_rules": cascade.oracle(),
    "op13_hard_negatives": negatives.oracle(),
}
