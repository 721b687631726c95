"""Dominance counting: for each row, the rows of a smaller slot and a strictly larger level, by count and by weight.

Rows are range-partitioned by (slot, level) into shards, and again by (level, shard) into buckets; both are cut by rows,
so neither a hot slot nor a hot level falls into one task. A row's answer is the sum of three routed parts:

1. its own shard: a wavelet matrix over level ranks in slot order, prefix up to its slot;
2. its own bucket: a wavelet matrix over level ranks in shard order, prefix up to its shard;
3. whole cells (shard, bucket) of smaller shards and larger buckets: prefix sums over the grid of cells.

The orders make ties safe wherever a cut falls: rows of one slot in earlier shards have no larger level, rows of one level
in later buckets have no smaller shard. The shards number sqrt(rows) / 16 (and enough for `most` rows each), so the grid
has rows / 256 cells and no task holds more than about max(16 * sqrt(rows), rows / shards) rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import materialise
from provark.llm.wavelet import prefix_greater

_ROWS = "id string, slot long, level long, weight long, tie short, shard int, n_above long, w_above long"


def minute(moment: Column, kind: str) -> Column:
    """Whole minutes since 1970, floored. A timestamp without a zone is taken as UTC, whatever the session's zone."""
    if kind == "timestamp_ntz":
        return F.unix_date(moment.cast("date")).cast("long") * 1440 + F.hour(moment) * 60 + F.minute(moment)
    micros = F.unix_micros(moment)
    return ((micros - F.pmod(micros, F.lit(60_000_000))) / 60_000_000).cast("long")


def level_of(total: Column, width: int = 1) -> Column:
    """floor(floor(100 * total + 0.5) / width) in double arithmetic; null for null, NaN and infinite totals."""
    level = F.floor(F.floor(total * 100.0 + 0.5).cast("double") / float(width))
    return F.when(~F.isnan(total) & (F.abs(total) != F.lit(float("inf"))), level.cast("long"))


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def _ranked(first: np.ndarray, level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and weights, by row, of the rows with a smaller `first` and a larger level in this partition."""
    order = np.lexsort((level, first))
    ranks = np.unique(level[order], return_inverse=True)[1]
    ends = np.searchsorted(first[order], first[order], "left")
    out = np.empty((2, len(order)), np.int64)
    out[:, order] = prefix_greater(ranks, weight[order], ends, ranks)
    return out[0], out[1]


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[n].combine_chunks().to_numpy(zero_copy_only=False) if isinstance(rows[n], pa.ChunkedArray) else rows[n].to_numpy() for n in names]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its number, and what its rows have above them within it."""
    from pyspark import TaskContext

    if (rows := _read(batches)) is None:
        return
    slot, level, weight = _numbers(rows, "slot", "level", "weight")
    n, w = _ranked(slot, level, weight)
    shard = np.full(len(slot), TaskContext.get().partitionId(), np.int32)
    for name, values in (("shard", shard), ("n_above", n), ("w_above", w)):
        rows = rows.append_column(name, pa.array(values))
    yield from rows.to_batches(max_chunksize=1 << 16)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: its number, and what its rows have above them in the same bucket of earlier shards."""
    from pyspark import TaskContext

    if (rows := _read(batches)) is None:
        return
    shard, level, weight, n0, w0 = _numbers(rows, "shard", "level", "weight", "n_above", "w_above")
    n, w = _ranked(shard, level, weight)
    rows = rows.drop_columns(["n_above", "w_above", "tie"])
    bucket = np.full(len(shard), TaskContext.get().partitionId(), np.int32)
    for name, values in (("n_above", n0 + n), ("w_above", w0 + w), ("bucket", bucket)):
        rows = rows.append_column(name, pa.array(values))
    yield from rows.to_batches(max_chunksize=1 << 16)


def _later(buckets: int):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """One shard's cells: the sums of its larger buckets, for every bucket."""
        out = {"shard": int(cells["shard"].iloc[0]), "bucket": np.arange(buckets, dtype=np.int32)}
        for c in ("n", "w"):
            dense = np.zeros(buckets, np.int64)
            dense[cells["bucket"].to_numpy()] = cells[c].to_numpy()
            out[c] = dense[::-1].cumsum()[::-1] - dense
        return pd.DataFrame(out)

    return run


def _earlier(cells: pd.DataFrame) -> pd.DataFrame:
    """One bucket's sums: those of smaller shards, for every shard."""
    cells = cells.sort_values("shard")
    return cells.assign(**{c: cells[c].cumsum() - cells[c] for c in ("n", "w")})


def dominance(rows: DataFrame, id_col: str, slot: Column, level: Column, weight: Column, most: int = 8 << 20) -> DataFrame:
    """id_col, slot, level, n_above and w_above of every row: rows with a smaller slot and a larger level, their weight.

    Every row counts for itself: repeated ids and repeated rows are rows of their own. A null slot or level counts
    nowhere and has null counts. The id may be of any type, null and repeated; other columns are left behind. An empty
    table gives an empty one. Weights are whole numbers; their sums must fit 64 bits."""
    id_type = rows.schema[id_col].dataType
    given = rows.select(F.col(id_col).alias("id"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), weight.cast("long").alias("weight"))
    whole = F.col("slot").isNotNull() & F.col("level").isNotNull()
    valid = given.filter(whole).withColumn("tie", (F.monotonically_increasing_id() % 1024).cast("short"))
    count = valid.count()
    parts = max(1, math.ceil(math.sqrt(count) / 16), math.ceil(count / most))
    typed = lambda text: text.replace("id string", f"id {id_type.simpleString()}")
    sharded = valid.repartitionByRange(parts, "slot", "level", "tie").mapInArrow(_shards, typed(_ROWS))
    sharded = materialise(sharded, "shards")
    bucketed = sharded.repartitionByRange(parts, "level", "shard", "tie")
    bucketed = bucketed.mapInArrow(_buckets, typed("id string, slot long, level long, weight long, shard int, n_above long, w_above long, bucket int"))
    bucketed = materialise(bucketed, "buckets")
    sharded.forget()
    cells = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    buckets = (bucketed.agg(F.max("bucket")).head()[0] or 0) + 1
    grid = "shard int, bucket int, n long, w long"
    cells = cells.groupBy("shard").applyInPandas(_later(buckets), grid).groupBy("bucket").applyInPandas(_earlier, grid)
    found = bucketed.join(cells.filter("n > 0"), ["shard", "bucket"], "left")
    add = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    found = found.select("id", "slot", "level", add("n_above", "n"), add("w_above", "w"))
    none = F.lit(None).cast("long")
    out = found.unionByName(given.filter(~whole).select("id", "slot", "level", none.alias("n_above"), none.alias("w_above")))
    return out.withColumnRenamed("id", id_col)


def sales_above(sales: DataFrame) -> DataFrame:
    """Per sale: sale_id, slot, level, n_sales and n_rows of the sales above it (an earlier minute, a higher total).

    A sale stands for 1 + (crc32 of its id in decimal, mod 5) rows; one without an id for one."""
    weight = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5, F.lit(0)) + 1
    slot, level = minute(F.col("sold_at"), dict(sales.dtypes)["sold_at"]), level_of(F.col("total"))
    return dominance(sales, "sale_id", slot, level, weight).withColumnsRenamed({"n_above": "n_sales", "w_above": "n_rows"})
