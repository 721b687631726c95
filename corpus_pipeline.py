"""Corpus pipeline: five stages over documents, each working on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from provark.llm.common import materialise, table

#: Near copies: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: fitted on the labelled documents of this table; what it rejects goes."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.select(docs, model)


def by_id() -> tuple[Column, Column]:
    """The order of ids: ascending, null last."""
    return F.col("doc_id").isNull(), F.col("doc_id")


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a key of each row, stored so that it stays, and the key's name, which no column has: ids may be null
    or repeated."""
    key, taken = "row_key", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), f"{name}-rows"), key


def first_keys(rows: DataFrame, key: str, groups: DataFrame, group: str, *order: Column) -> DataFrame:
    """The row key of each group's first row by `order`, then by row key; `groups` has the row key as doc_id."""
    members = groups.select(F.col("doc_id").alias(key), F.col(group).alias("group"))
    ranked = rows.select(key, F.struct(*order, F.col(key).alias("key")).alias("rank")).join(members, key)
    return ranked.groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias(key))


def firsts(rows: DataFrame, key: str, groups: DataFrame, group: str, *order: Column) -> DataFrame:
    """Exactly one row of each group, as by `first_keys`."""
    return rows.join(first_keys(rows, key, groups, group, *order), key, "left_semi").drop(key)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the row with the most code points, then the smallest id, stays.

    One row of each group stays, whatever its id: a null id sorts last and a row that is repeated as it is
    stays once. Rows with the same id and other texts are documents of their own. Null text counts as empty."""
    rows, key = keyed(docs, "exact")
    length = F.length(F.coalesce("text", F.lit("")))
    return firsts(rows, key, exact_dedup.exact_dedup(rows, id_col=key), "keep_id", -length, *by_id()).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies, the smallest id stays.

    One row of each group stays, as in `drop_copies`; texts without words are near to none, so all of them stay.
    Only rows that may have to go, by a fixed number of bits, are shuffled with their texts."""
    rows, key = keyed(docs, "near")
    groups = ngram_join.ngram_components(rows, id_col=key, k=WORDS, percent=PERCENT)
    others = rows.select(key).join(first_keys(rows, key, groups, "component_id", *by_id()), key, "left_anti")
    others = materialise(others, "near-others")
    may_go = ngram_join.held_marks(others.select(F.xxhash64(key).alias("mark")))(F.xxhash64(key))
    kept = rows.filter(may_go).join(others, key, "left_anti").unionByName(rows.filter(~may_go))
    return kept.select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: what it finds is masked; every document stays, n_chars, where there is one, follows its text."""
    masked = secret_scan.redact(docs)
    if kind := dict(docs.dtypes).get("n_chars"):
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: concatenated and cut into sequences of 4096 tokens; one row a piece, with its ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Training, near-copy groups and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
