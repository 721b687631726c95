"""What the training-data operators share: shared-folder tables, Arrow batches, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset in local mode, as in tests."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    The table is read with df's own schema, so an empty one is fine too. Its forget() deletes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.forget = lambda: _delete(spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more; a run that fails before leaves it in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes, so that a worker's memory does not follow the batch."""
    for batch in batches:
        size = max(1, batch.nbytes)
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * limit // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array and the n + 1 offsets of its documents; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(left: DataFrame, right: DataFrame, key: str, size: str, shares: int = 1000) -> DataFrame:
    """left joined (left outer) with right's row of the same key, where a key may hold any share of left.

    `right` is a stored table with one row a key; `size` names its column of left rows a key.
    Keys with over a `shares`-th of all rows number fewer than `shares` by counting, so they are
    broadcast; every other key is small and goes through a shuffled join. Hot rows get a key of
    their own there, so no partition collects them."""
    total = right.agg(F.sum(size)).head()[0] or 0
    bar = total // shares
    value = [c for c in right.columns if c != key]
    pack = F.struct(*value)
    hot = right.filter(F.col(size) > bar).select(F.col(key).alias("_hot"), pack.alias("_hot_value"))
    cold = right.filter(F.col(size) <= bar).select(F.col(key).cast("string").alias("_cold"), pack.alias("_cold_value"))
    wide = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread = F.concat(F.lit("hot:"), F.monotonically_increasing_id().cast("string"))
    wide = wide.withColumn("_key", F.when(F.col("_hot").isNull(), F.coalesce(F.col(key).cast("string"), spread)).otherwise(spread))
    found = F.coalesce("_hot_value", "_cold_value")
    return wide.join(cold, F.col("_key") == F.col("_cold"), "left").select(*left.columns, *[found[c].alias(c) for c in value])
