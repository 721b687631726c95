"""The registered queries: each runs its operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.llm import byte_bpe, decontaminate, dominance, exact_dedup, gif_media, ngram_join, packing, quality, secret_scan, suffix_dedup, token_counts, url_filter, vector_codes
from provark.llm.common import table

#: The rules of op4, and the sites whose pages make up its list.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LISTED_SITES = r"(^|\.)(spam-farm|cheap-pills)\.example\.(com|net|org)$"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_gifs(table(spark, sf_dir, "documents"), keep_media=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_path(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).filter(F.col("host").rlike(LISTED_SITES))
    listed = listed.select(url_filter.canonical(F.col("host"), F.col("path")).alias("canonical"))
    return url_filter.url_filter(pages, RULES, listed).drop("probes_passed")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    rated = quality.rate(docs, model)
    return rated.withColumn("selected", F.col("tail_prob") >= quality.LEAST_TAIL)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), keep_ids=False)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(table(spark, sf_dir, "sales"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_gif_media,
        op3_exact_dedup,
        op4_url_filter,
        op5_quality,
        op6_secret_scan,
        op7_byte_bpe,
        op8_suffix_dedup,
        op9_ngram_join,
        op10_packing,
        op11_dominance,
        op12_decontamination,
        op13_vector_codes,
    )
}
