"""Quality classifier: ordinal cumulative-link regression over hashed text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.llm.common import text_batches, texts_of

BITS = 17
TRIM = ".,;:!?\"'()[]{}"
#: Buckets above the hashed words: shares of the text's words, a bucket for each step that a share reaches.
SHARES = ("marked", "shouted", "bare", "repeated", "lines")
STEPS = 10
#: A document is selected at this probability of the best grade.
LEAST_TAIL = 0.35
SIZE = (1 << BITS) + len(SHARES) * STEPS


class Features:
    """A text's distinct buckets: its hashed words, and those of its shares of odd words.

    marked: words with marks other than closing punctuation; shouted: words of capitals; bare: no letter at
    all; repeated: words that occurred before; lines: lines that occurred before."""

    def __init__(self, max_cached: int = 200_000):
        self.words: dict[str, tuple[int, bool, bool, bool]] = {}
        self.max_cached = max_cached

    def word(self, raw: str) -> tuple[int, bool, bool, bool]:
        core = raw.strip(TRIM)
        letters = any(map(str.isalpha, core))
        marked = bool(core) and not core.isalnum() or raw.endswith("!!")
        base = "".join(filter(str.isalpha, core)).lower() or core
        return zlib.crc32(base.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1), marked, len(core) > 2 and core.isupper(), not letters

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        distinct = set(words)
        known = self.words
        if len(known) > self.max_cached:
            known.clear()
        for w in distinct.difference(known):
            known[w] = self.word(w)
        seen = [known[w] for w in distinct]
        # shares over distinct words, which a text's length moves least
        n = len(distinct)
        lines = [x for x in text.split("\n") if x]
        shares = (sum(s[1] for s in seen) / n, sum(s[2] for s in seen) / n, sum(s[3] for s in seen) / n, 1 - n / len(words), 1 - len(set(lines)) / len(lines) if lines else 0.0)
        extra = [(1 << BITS) + i * STEPS + k for i, x in enumerate(shares) for k in range(min(STEPS, int(x * 2 * STEPS)))]
        return np.array(sorted({s[0] for s in seen} | set(extra)), np.int64)


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(cut[k] - score); cuts ascend. score: the sum of a text's weights."""

    weights: np.ndarray
    cuts: np.ndarray

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Sum over k of P(grade > k)."""
        return (1 - self.cumulative(score)).sum(1)

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade or better)."""
        return 1 - self.cumulative(score)[:, grade - 1] if grade > 0 else np.ones(len(score))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 120, rate: float = 0.3, l1: float = 0.03, balance: float = 0.0, least_docs: int = 5) -> OrdinalModel:
    """Full-batch proportional-odds fit: Adagrad with soft thresholds of l1 / sqrt(rows), so that words
    without a say keep weight 0, as do buckets in fewer than `least_docs` texts. Rare grades weigh more, by
    their share to the power -`balance`. Without rows all weights are 0."""
    cuts = np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(n_grades - 1)
    weights = np.zeros(SIZE)
    if not len(rows):
        return OrdinalModel(weights, cuts)
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64)
    keep = (np.bincount(col, minlength=SIZE) >= least_docs)[col]
    doc, col = doc[keep], col[keep]
    names, col = np.unique(col, return_inverse=True)
    w, g2, c2 = np.zeros(len(names)), np.full(len(names), 1e-6), np.full(len(cuts), 1e-6)
    # gaps between cuts as logarithms keep them in order
    first, gaps = cuts[:1].copy(), np.log(np.maximum(np.diff(cuts), 1e-3))
    share = (n / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1)))[grades] ** balance
    for _ in range(epochs):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(doc, w[col], n)
        edge = np.concatenate([np.full(1, -40.0), cuts, np.full(1, 40.0)])
        up = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - score, -40, 40)))
        low = 1 / (1 + np.exp(-np.clip(edge[grades] - score, -40, 40)))
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p * share, low * (1 - low) / p * share
        g = np.bincount(col, (d_up - d_low)[doc], len(names)) / n
        g2 += g * g
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1 / np.sqrt(n))
        d_edge = (np.bincount(grades, d_low, n_grades)[1:] - np.bincount(grades, d_up, n_grades)[:-1]) / n
        d_cut = np.concatenate([[d_edge.sum()], np.cumsum(d_edge[::-1])[::-1][1:] * np.exp(gaps)])
        c2 += d_cut**2
        move = rate * d_cut / np.sqrt(c2)
        first, gaps = first - move[:1], gaps - move[1:]
    weights[names] = w
    return OrdinalModel(weights, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 toxic, 1 of low quality, 2 good; rows with a null are left out, the worst of
    several labels of one document counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most `max_rows` rated documents, taken in the order of a hash of their ids.

    Several rows with one id count as one, the one with the least features, so the bound is one of rows. Only the
    sample's features, never its texts, reach the driver: below `max_rows` x 2 ** 17 buckets."""
    sample = ratings.select(F.col("doc_id").alias("rated"), F.col("grade").cast("int")).orderBy(F.xxhash64("rated"), "rated").limit(max_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in text_batches(batches):
            blobs = [features.of(t).astype("<i4").tobytes() for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "grade", "buckets"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("rated")).select("doc_id", "grade", "text")
    found = rows.mapInArrow(featurise, "doc_id long, grade int, buckets binary")
    found = found.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("buckets").alias("buckets")).toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    blobs, grades = found.column("buckets").to_pylist(), found.column("grade").to_numpy()
    return fit([np.frombuffer(blobs[i], "<i4") for i in order], grades[order].astype(np.int64), n_grades)


def rate(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, score, expected_grade, tail_prob (of the best grade) and the `keep` columns.

    A text without words has the features of none: score 0. Null counts as empty. A narrow map; the model
    (about a megabyte, whatever the corpus) goes along with the task."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))
    best = len(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = sent.value
        own, features = OrdinalModel(weights, cuts), Features()
        for batch in text_batches(batches):
            score = np.array([weights[features.of(t)].sum(dtype=np.float64) for t in texts_of(batch.column(1))], np.float64)
            made = [pa.array(x, pa.float64()) for x in (score, own.expected(score), own.tail(score, best))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *[batch.column(i) for i in range(2, batch.num_columns)]], names=["doc_id", "score", "expected_grade", "tail_prob", *keep_names])

    keep_names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, keep_names)])
    kept = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep_names)
    out = rows.mapInArrow(run, f"doc_id long, score double, expected_grade double, tail_prob double{kept}")
    return out.select("doc_id", "score", "expected_grade", "tail_prob", *[F.col(k).alias(c) for c, k in zip(keep, keep_names)])


def select(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL, text_col: str = "text") -> DataFrame:
    """The documents whose probability of the best grade is at least `least_tail`, with their own columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("none", F.lit(None).cast("long"))
    out = rate(plain, model, "none", f"c{columns.index(text_col)}", keep=tuple(plain.columns[:-1]))
    return out.filter(F.col("tail_prob") >= least_tail).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
