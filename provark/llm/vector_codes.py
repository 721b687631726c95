"""Vector code compression: a codebook for each part of a vector, fitted by Lloyd rounds with Elkan's bounds.

Components become integers floor(256 * x); all distances that decide are exact integers. A stored state keeps, for each
part of a row, an upper bound of the distance to its entry and one lower bound an entry. After entries move, bounds are
shifted by the movement; an entry is compared only if its lower bound and half its distance to the present entry both
are at most the upper bound, so an entry that could tie is always compared. Codebooks, and sums by entry, have a fixed size."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import lookup, materialise

#: A float's error is far below these factors; they round bounds to the safe side.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
#: Lower bounds are stored as sixteen steps of a quarter of the upper bound, the last of which means "or further": few
#: values, which compress well, and still a bound for every entry.
_UNITS, _MOST = 4.0, 15
_STATE = "vec_id {}, label {}, vector array<int>, code binary, upper binary, lower binary"


def whole_vectors(rows: DataFrame, id_col: str, vector: str, label: str, parts: int) -> DataFrame:
    """vec_id, label and vector of the rows whose vector is not null, holds only finite numbers, and cuts into `parts`."""
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return kept.filter(F.col("vector").isNotNull() & ~broken & (F.size("vector") > 0) & (F.size("vector") % parts == 0))


def _widest(dim: int) -> int:
    """The largest magnitude of a component with which sums of squared differences stay within 62 bits."""
    return math.isqrt((1 << 60) // dim)


def _integers(values: np.ndarray, dim: int) -> np.ndarray:
    most = _widest(dim)
    return np.clip(np.floor(values.astype(np.float64) * 256), -most, most).astype(np.int64).reshape(-1, dim)


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Codebooks:
    """entries: part x entry x place, as integers; moved: how far each entry came since the bounds were taken, rounded up."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries, self.moved = entries, moved
        gap = entries[:, :, None, :] - entries[:, None, :, :]
        self.half = np.sqrt((gap * gap).sum(-1).astype(np.float64)) * (_DOWN / 2)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, squared distance and lower bounds (row x part x entry) of x (row x part x place)."""
        n, parts, _ = x.shape
        k = self.entries.shape[1]
        codes, squares, bounds = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64), np.zeros((n, parts, k))
        rows = np.arange(n)
        for p in range(parts):
            book = self.entries[p]
            exact = np.full((n, k), np.iinfo(np.int64).max)
            if code is None:
                open_ = np.ones((n, k), bool)
                low = np.zeros((n, k))
            else:
                own = code[:, p].astype(np.int64)
                gap = x[:, p] - book[own]
                near = (gap * gap).sum(-1)
                bound = np.minimum(upper[:, p] + self.moved[p][own], np.sqrt(near.astype(np.float64))) * _UP
                low = np.maximum(lower[:, p] - self.moved[p], 0) * _DOWN
                open_ = (low <= bound[:, None]) & (self.half[p][own] <= bound[:, None])
                open_[rows, own] = True
            i, j = np.nonzero(open_)
            gap = x[i, p] - book[j]
            exact[i, j] = (gap * gap).sum(-1)
            low[i, j] = np.sqrt(exact[i, j].astype(np.float64)) * _DOWN
            best = exact.argmin(1)  # of equal distances the first
            codes[:, p], squares[:, p], bounds[:, p] = best, exact[rows, best], low
        return codes, squares, bounds


def _fixed(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _state_of(batch: pa.RecordBatch, parts: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    upper = _fixed(batch["upper"], "<f4", n).astype(np.float64)
    lower = _fixed(batch["lower"], np.uint8, n).reshape(n, parts, entries) * (upper[:, :, None] / _UNITS * _DOWN)
    return _fixed(batch["code"], np.uint8, n), upper, lower


def _round(books: Codebooks, dim: int, final: bool):
    """Assigns every part of every row: to a state with bounds, or at last to codes and errors."""
    parts, entries = books.entries.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values, begun = _values(batch["vector"]), "code" in batch.schema.names
            x = values.astype(np.int64).reshape(-1, dim) if begun else _integers(values, dim)
            known = _state_of(batch, parts, entries) if begun else (None, None, None)
            code, squares, low = books.assign(x.reshape(len(x), parts, -1), *known)
            if final:
                columns = {"code": pa.array([r.tobytes().hex() for r in code], pa.string()), "error": pa.array(squares.sum(1), pa.int64())}
            else:
                upper = np.maximum(np.sqrt(squares.astype(np.float64)) * _UP, 1.0).astype(np.float32)
                upper = np.nextafter(upper, np.float32(np.inf))
                lower = np.minimum(low / (upper[:, :, None].astype(np.float64) / _UNITS), _MOST).astype(np.uint8)
                ints = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel(), pa.int32()))
                columns = {"vector": ints, "code": _bytes(code), "upper": _bytes(upper.astype("<f4")), "lower": _bytes(lower.reshape(len(x), -1))}
            columns = {"vec_id": batch["vec_id"], "label": batch["label"]} | columns
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _partial_sums(parts: int, entries: int, dim: int):
    """A task's number of rows and component sums for each part, entry and place: as many rows from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = dim // parts
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, wide), np.int64)
        for batch in _slices(batches):
            x = _values(batch["vector"]).astype(np.int64).reshape(batch.num_rows, parts, wide)
            cell = (_fixed(batch["code"], np.uint8, batch.num_rows) + np.arange(parts) * entries).ravel()
            counts += np.bincount(cell, minlength=len(counts))
            np.add.at(sums, cell, x.reshape(-1, wide))
        used = np.flatnonzero(counts)
        cells = np.repeat(used, wide)
        arrays = cells.astype(np.int32), np.tile(np.arange(wide, dtype=np.int32), len(used)), np.repeat(counts[used], wide), sums[used].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["cell", "place", "n", "total"])

    return run


def _moved(state: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Every used entry becomes the floored mean of its parts; sums are exact decimals of up to 38 digits."""
    parts, entries, wide = books.entries.shape
    sums = state.select("vector", "code").mapInArrow(_partial_sums(parts, entries, dim), "cell int, place int, n long, total long")
    means = sums.groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = books.entries.reshape(parts * entries, wide).copy()
    for r in means.collect():  # parts x entries x places of them, whatever the table's size
        new[r["cell"], r["place"]] = int(r["total"]) // r["n"]
    new = new.reshape(books.entries.shape)
    gap = (new - books.entries).astype(np.float64)
    return Codebooks(new, np.sqrt((gap * gap).sum(-1)) * _UP)


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts); and the codebooks.

    Dropped: rows whose vector is null, empty, holds a null or a number that is not finite, or has another length than
    the first kept one, or one that is no multiple of `parts`. First entries: the vectors of the smallest ids (nulls
    last; equal ids by their vectors); with fewer rows than entries, fewer entries. Equal distances: the smaller index.
    Repeated ids and rows are rows of their own. Integers are clipped at sqrt(2 ** 60 / length), so that errors fit 64
    bits. No rows: an empty table and no codebooks. Codes are one byte: at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    kept = whole_vectors(rows, id_col, vector, label, parts)
    types = dict(kept.dtypes)
    coded = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    order = F.col("vec_id").asc_nulls_last(), F.col("vector")
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], coded), None
    dim = len(first[0]["vector"])
    kept = kept.filter(F.size("vector") == dim)
    begun = np.array([r["vector"] for r in kept.orderBy(*order).limit(entries).select("vector").collect()], np.float64)
    books = Codebooks(_integers(begun, dim).reshape(len(begun), parts, -1).transpose(1, 0, 2).copy())
    state = kept
    for _ in range(rounds):
        last, state = state, materialise(state.mapInArrow(_round(books, dim, False), _STATE.format(types["vec_id"], types["label"])), "bounds")
        if last is not kept:
            last.forget()
        books = _moved(state, books, dim)
    out = materialise(state.mapInArrow(_round(books, dim, True), coded), "codes")
    if state is not kept:
        state.forget()
    return out, books


def _label_key(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit("null"))


def coded_embeddings(embeddings: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, the sum of errors of its label (nulls are one label), digest of the codebooks."""
    coded, books = vector_codes(embeddings)
    rows = coded.withColumn("label_key", _label_key(F.col("label")))
    sums = rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = materialise(sums, "label-errors")
    found = lookup(rows, sums, "label_key", "n")
    sha = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return found.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
