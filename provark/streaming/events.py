"""Run events as streams: dedup, replay, validation, reducers. The same functions work on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.sources.sinks import run_bucket

EVENT = "run_id string, seq long, ts timestamp, t string, payload string"
#: The fields that an event of each type may have.
FIELDS = {
    "phase": ("phase", "status"),
    "log": ("level", "message"),
    "finding": ("finding_id", "severity", "title"),
    "metric": ("name", "value"),
    "done": ("status",),
}


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The event table as a stream; a slow reader lags behind a bounded batch, nothing is dropped."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(path)


def dedup_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run_id, seq) once. State is bounded by a watermark, an extension over the plain sequence order."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def dedup(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "seq").agg(F.min(F.struct("ts", "t", "payload")).alias("e")).select("run_id", "seq", "e.*")


def replay_after(events: DataFrame, run_id: str, after: int, limit: int = 5000) -> DataFrame:
    """A run's events behind a sequence number, once each, in order."""
    return dedup(events.filter((F.col("run_id") == run_id) & (F.col("seq") > after))).orderBy("seq").limit(limit)


def next_sequence(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg((F.max("seq") + 1).alias("next_seq"))


def validated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a known type, a payload that parses and no field beyond the type's own."""
    allowed = F.create_map(*[x for k, v in FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("t")]
    keys = F.json_object_keys("payload")
    good = F.coalesce(allowed.isNotNull() & keys.isNotNull() & (F.size(F.array_except(keys, allowed)) == 0), F.lit(False))
    return events.filter(good), events.filter(~good)


def phase_status(events: DataFrame) -> DataFrame:
    """run_id, phase, status: the last status of each phase by seq."""
    rows = events.filter("t = 'phase'").select("run_id", "seq", F.get_json_object("payload", "$.phase").alias("phase"), F.get_json_object("payload", "$.status").alias("status"))
    return rows.groupBy("run_id", "phase").agg(F.max_by("status", "seq").alias("status"))


def latest_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "t").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def finished(events: DataFrame) -> DataFrame:
    """Runs with a terminal event."""
    return events.filter("t = 'done'").select("run_id").distinct()


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what there is and ends: for finished runs and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_slices(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to the event table once per trigger, exactly once by the sink's own log."""
    rows = stream.withColumn("bucket", run_bucket(F.col("run_id")))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("bucket").trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; an extension, event time plays no part in the sequence order."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "t").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "t", "n")
