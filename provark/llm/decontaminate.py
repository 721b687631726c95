"""Benchmark decontamination: words of documents that lie in a window of ten words that a benchmark item also has.

Texts are lower-cased in A-Z and cut into words of digits, a-z and characters beyond ASCII. A window, with one space before,
between and behind its words, is a test string of a Wu-Manber search over the documents' words, spaced alike. Items come to
the driver in blocks of bounded bytes; each block is one pass over the documents, and nothing of them is shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.llm.common import ascii_lower, materialise, text_batches, text_bytes
from provark.llm.wu_manber import tables

#: Fixed value: what is a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of item texts that one pass searches for.
BLOCK_BYTES = 2 << 20
_SPACE = 32
_BYTES = np.full(256, _SPACE, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _BYTES[_low : _high + 1] = np.arange(_low, _high + 1)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space around each; where each word's leading space is; each word's text."""
    wide = np.insert(_BYTES[data], offsets, np.uint8(_SPACE))
    keep = wide != _SPACE
    keep[:-1] |= wide[1:] != _SPACE
    keep[-1] = True
    sizes = np.add.reduceat(keep, offsets[:-1] + np.arange(len(offsets) - 1), dtype=np.int64)
    words = wide[keep]
    spaces = np.flatnonzero(words == _SPACE)[:-1]
    return words, spaces, np.searchsorted(np.cumsum(sizes), spaces + 1, "right")


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, list[str]]]]:
    """Item words, spaced, with the ids that have them, in blocks of about block_bytes; equal items are one."""
    words = F.array_join(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)), " ")
    texts = items.select(words.alias("words"), F.col(id_col).cast("string").alias("item")).filter("words <> ''")
    texts = texts.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    total = texts.agg(F.sum(F.octet_length("words"))).head()[0] or 0
    n = math.ceil(total / block_bytes)
    part = F.pmod(F.xxhash64("words"), F.lit(n))
    return [b for k in range(n) if (b := [(r["words"], r["ids"]) for r in texts.filter(part == k).orderBy("words").collect()])]


class Windows:
    """The distinct windows of some items: test strings, their number of words, and the items that each is in."""

    def __init__(self, block: list[tuple[str, list[str]]], width: int):
        starts, sizes, counts, owners, seen, at = [], [], [], [], {}, 0
        data = []
        for k, (words, _) in enumerate(block):
            text = b" " + words.encode() + b" "
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == _SPACE).tolist()
            n = min(width, len(spaces) - 1)
            for i in range(len(spaces) - n):
                window = text[spaces[i] : spaces[i + n] + 1]
                if (number := seen.setdefault(window, len(starts))) == len(starts):
                    starts.append(at + spaces[i])
                    sizes.append(len(window))
                    counts.append(n)
                    owners.append(set())
                owners[number].add(k)
            data.append(text)
            at += len(text)
        self.counts = np.array(counts, np.int64)
        self.owner_at = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([k for o in owners for k in sorted(o)], np.int64)
        self.ids = [ids for _, ids in block]
        self.tables = tables(np.frombuffer(b"".join(data) or b" ", np.uint8), np.array(starts, np.int64), np.array(sizes, np.int64))

    def hits(self, words: np.ndarray, spaces: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, first word, end word and window of each occurrence that lies in one text."""
        for t in self.tables:
            at, window = t.search(words)
            first = np.searchsorted(spaces, at)
            end = first + self.counts[window]
            whole = owner[first] == owner[end - 1]
            yield owner[first[whole]], first[whole], end[whole], window[whole]


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals: overlapping and touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(starts) else ends


def _pass(windows: Windows, keep_text: bool):
    """One block's search: each document's intervals of hit words and its items join those of earlier blocks."""
    names = ["id", *["text"] * keep_text, "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words, spaces, owner = spaced(*text_bytes(batch["text"]))
            n = batch.num_rows
            first_word = np.searchsorted(owner, np.arange(n + 1))
            hits = [np.concatenate(x) for x in zip(*windows.hits(words, spaces, owner), strict=True)] if windows.tables else [np.zeros(0, np.int64)] * 4
            order = np.argsort(hits[0], kind="stable")
            text, first, end, window = (x[order] for x in hits)
            bounds = np.searchsorted(text, np.arange(n + 1))
            spans, items = batch["spans"].to_pylist(), batch["items"].to_pylist()
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                old = np.array(spans[k], np.int64).reshape(-1, 2)
                low, high = _merged(np.concatenate([old[:, 0], first[part] - first_word[k]]), np.concatenate([old[:, 1], end[part] - first_word[k]]))
                spans[k] = np.stack([low, high], 1).ravel().tolist()
                found = np.unique(window[part])
                who = np.unique(np.concatenate([windows.owners[windows.owner_at[w] : windows.owner_at[w + 1]] for w in found.tolist()]))
                items[k] = sorted({*items[k], *(i for o in who.tolist() for i in windows.ids[o])})
            counts = pa.array(np.diff(first_word), pa.int64())
            kept = [batch[c] for c in names[: 1 + keep_text]]
            yield pa.RecordBatch.from_arrays([*kept, counts, pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names)

    return run


def contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: id, n_words, spans (start and end word of each run of hit words, flat) and items (ids with
    windows in it, as strings, sorted).

    Null and wordless texts have no words; items without words are found nowhere, items of fewer than `width` words are
    one window. Items with equal words share their windows and all are listed; an item without an id hits words and is
    not listed. Ids of documents may be null or repeated: each row is judged by itself. No items: no hits."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(items, item_id, item_text, block_bytes) or [[]]
    for k, block in enumerate(blocks):
        again = k + 1 < len(blocks)
        schema = f"id {id_type}, {'text string, ' * again}n_words long, spans array<long>, items array<string>"
        rows = rows.mapInArrow(_pass(Windows(block, width), again), schema)
        if again and k % 4 == 3:
            rows = materialise(rows, "searched")
    return rows.withColumnRenamed("id", id_col)


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and whether any word is hit."""
    found = contaminated(docs, items)
    place = F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2))
    hit = F.when(F.size("spans") > 0, F.aggregate(place, F.lit(0).cast("long"), lambda a, i: a + F.get("spans", i + 1) - F.get("spans", i))).otherwise(F.lit(0).cast("long"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
