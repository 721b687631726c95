"""Exact deduplication by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import lookup, materialise

#: The white space that the normal form drops, [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


#: What ids count down from in a winner's number; a null id counts as one beyond the largest.
TOP = "9223372036854775808"


def _winner(length: Column, doc_id: Column) -> Column:
    """One number that is larger for a longer text and, among equals, for a smaller id."""
    top = F.lit(TOP).cast("decimal(20,0)")
    tail = top - F.coalesce(doc_id.cast("decimal(20,0)"), top)
    return (length.cast("decimal(11,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + tail).cast("decimal(38,0)")


def _winner_id(winner: Column) -> Column:
    """The id in a winner's number; null where it is that of no id."""
    tail = (winner % F.lit("100000000000000000000").cast("decimal(21,0)")).cast("decimal(20,0)")
    return F.when(tail > 0, (F.lit(TOP).cast("decimal(20,0)") - tail).cast("long"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, salts: int = 16) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their forms without [\\x20\\x09-\\x0D] are. The row with the most code points
    in the original text stays, then the smallest id. Stages, each grouping by digest and full content:
    within a task (the map side of the first aggregation, one salt a task), by (digest, salt), then the
    salts' winners by digest. The documents then look up their digest's winner; only digests that stand for
    several contents, which a sound digest never has, are looked up by content again.

    Null text counts as empty; a null id sorts behind every other and comes back null. Rows with the same id (or
    without one) and as many code points in their original texts are one document repeated: each gets the same values;
    of rows with the same id and different lengths only the longest is kept. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    `digest`: text column -> digest column, SHA-256 by default (a weak one still gives right results)."""
    digest = digest or (lambda c: F.sha2(c, 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), _winner(F.col("n"), F.col("doc_id")).alias("win"))
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "norm", "salt").agg(F.max("win").alias("win"), F.count("*").alias("size"))
    whole = salted.groupBy("digest", "norm").agg(F.max("win").alias("win"), F.sum("size").alias("size"))
    contents = whole.select("digest", F.sha2("norm", 256).alias("text_sha256"), "win", "size")
    classes = materialise(contents.withColumnRenamed("win", "best"), "exact-classes")
    several = classes.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1")
    own = ["doc_id", "win"]
    if several.head(1):
        wide = classes.select(F.col("text_sha256").alias("key"), "best", "size")
        found = lookup(rows.select(*own, F.sha2("norm", 256).alias("key")), wide, "key", "size").withColumnRenamed("key", "text_sha256")
    else:
        found = lookup(rows.select(*own, "digest"), classes, "digest", "size")
    return found.select("doc_id", _winner_id(F.col("best")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("win") == F.col("best")).alias("kept"), "text_sha256")
