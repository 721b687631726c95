"""Sinks: event and checkpoint tables, artifacts by content, audit appends, reports, metric registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.functions.text import digest


#: Folders of the event table.
BUCKETS = 64


def run_bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def append_events(events: DataFrame, path: str) -> None:
    """Appends run events in order of bucket, run and sequence number, in a bounded number of folders and files: a replay
    reads one bucket, and the statistics of its files show where its run is. A long run is spread over several files."""
    rows = events.withColumn("bucket", run_bucket(F.col("run_id")))
    rows.repartitionByRange("bucket", "run_id", "seq").sortWithinPartitions("bucket", "run_id", "seq").write.mode("append").partitionBy("bucket").parquet(path)


def run_of(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's events, read from its bucket only."""
    rows = spark.read.schema("run_id string, seq long, ts timestamp, t string, payload string, bucket int").parquet(path)
    return rows.filter((F.col("bucket") == run_bucket(F.lit(run_id))) & (F.col("run_id") == run_id)).drop("bucket")


def checkpoint(state: DataFrame, root: str, run_id: str, stage: str, seq: int) -> DataFrame:
    """Stores a stage's state and one manifest row (run_id, seq, stage, rows, state_hash); returns the stored state."""
    from provark.operators.graph import content_hash

    path = f"{root}/state/{run_id}/{seq:04d}-{stage}"
    state.write.mode("overwrite").parquet(path)
    back = state.sparkSession.read.schema(state.schema).parquet(path)
    counted = back.agg(F.count("*").alias("rows")).crossJoin(content_hash(back, back.columns))  # one row each
    manifest = counted.select(F.lit(run_id).alias("run_id"), F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), "rows", F.col("content_hash").alias("state_hash"))
    manifest.write.mode("append").parquet(f"{root}/manifest")
    return back


def artifacts(rows: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """name, digest, bytes, body of contents, one row a digest and name."""
    return rows.select(F.col(name).alias("name"), F.sha2(F.col(body), 256).alias("digest"), F.octet_length(body).alias("bytes"), F.col(body).alias("body")).dropDuplicates(["name", "digest"])


def append_audit(chain: DataFrame | None, records: DataFrame, key: str, order: str, evidence: list[str]) -> DataFrame:
    """The chain's new records, each key's first linked to its head; keys advance independently of each other."""
    from provark.operators.integrity import GENESIS, chain_head, linked

    base = records.select(F.col(key).alias("key"), F.col(order).alias("o"), digest(*[F.col(c) for c in evidence]).alias("e"))
    if chain is None:
        return linked(base.withColumns({"head": F.lit(GENESIS), "at": F.lit(0)}))
    heads = chain_head(chain).select("key", "head", F.col("seq").cast("int").alias("at"))
    return linked(base.join(heads, "key", "left").select("key", "o", "e", F.coalesce("head", F.lit(GENESIS)).alias("head"), F.coalesce("at", F.lit(0)).alias("at")))


def remaining_work(changes: DataFrame, results: DataFrame) -> DataFrame:
    """Changes with the first result of their (iteration, finding), and whether work remains."""
    first = results.groupBy("iteration", "finding").agg(F.min_by(F.struct("stage", "ok"), "seq").alias("r"))
    out = changes.join(first, ["iteration", "finding"], "left").select(*changes.columns, F.col("r.stage").alias("stage"), F.col("r.ok").alias("ok"))
    return out.withColumn("remaining", F.coalesce(~F.col("ok"), F.lit(True)))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Exposition lines `name{label="value"} v` of (name, labels map, value), sorted."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("line")
