"""Packing: concatenate all documents' tokens and cut into windows, by prefix sums over partition totals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.llm.common import materialise, text_batches, texts_of

#: The vocabulary file's pre-tokenizer over the characters of PLAIN: what it matches are the words, the rest goes.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Not cached: a text with other characters than these, for which the normal form is more than lower() or the
#: pattern's classes differ (numbers that are no digits, combining marks, other scripts), goes to the library whole.
PLAIN = re.compile(r"[^\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u017e]")


class WordTokenizer:
    """Ids of whole texts by the library's tokenizer, word by word: a BPE never crosses its pre-tokens.

    Distinct words are encoded by the library once and cached. Texts with characters for which the normal
    form is more than lower(), or with the literal of a special token, are encoded by the library as they are."""

    def __init__(self, vocabulary: str, max_cached: int = 500_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.find = WORDS.findall
        ends = [t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.max_cached = max_cached
        self.ids: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """Each word's ids: the library encodes them with spaces between, a word ends with its end token."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or (len(stops) and stops[-1] != len(ids)):
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(words, add_special_tokens=False)]
        raw, edge = ids.tobytes(), [0, *(stops * 4).tolist()]
        return [raw[a:b] for a, b in zip(edge, edge[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        plain = [PLAIN.search(t) is None and self.special.search(t) is None for t in texts]
        words = [self.find(t.lower()) if p else None for t, p in zip(texts, plain)]
        needed = set().union(*(w for w in words if w))
        new = needed.difference(self.ids)
        if len(self.ids) + len(new) > self.max_cached:
            self.ids.clear()
            new = needed
        ordered = sorted(new)
        for at in range(0, len(ordered), 5_000):
            part = ordered[at : at + 5_000]
            self.ids.update(zip(part, self._words(part)))
        get = self.ids.__getitem__
        return [b"".join(map(get, w)) if w is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, w in zip(texts, words)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    if vocabulary not in _TOKENIZERS:
        _TOKENIZERS[vocabulary] = WordTokenizer(vocabulary)
    return _TOKENIZERS[vocabulary]


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, part, before, n, width, ids: each document's ids (16 bits each, or 32 where one needs more) and
    the number of ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, before = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_batches(batches):
            ids = [np.frombuffer(x + end, "<u4") for x in own.encode(texts_of(batch.column(1)))]
            n, sizes = len(ids), np.array([len(x) for x in ids], np.int64)
            wide = max((int(x.max()) for x in ids), default=0) > 0xFFFF
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(n, part, np.int64)),
                    pa.array(before + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array(np.full(n, 4 if wide else 2, np.int32)),
                    pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in ids], pa.binary()),
                ],
                names=["doc_id", "part", "before", "n", "width", "ids"],
            )
            before += int(sizes.sum())

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, part long, before long, n long, width int, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary and, with
    `keep_ids`, the piece's ids.

    First pass: every partition's documents are tokenised, each followed by `end_id`, and stored; partition
    totals are added up. Second pass: a partition's first global offset is the sum of the totals before
    it, so all partitions cut at multiples of `length` by themselves. A piece whose window goes on in
    another piece of the same document carries boundary = true. Only the last sequence is short; what pads
    it is left to the reader, who needs none where its length is a power of two.

    Null text counts as empty and still gives the end id; null ids come back null, rows with the same id
    stay apart, an empty table gives no rows, other columns are ignored. The totals (a number a
    partition) are all that reaches the driver."""
    stored = materialise(tokenised(docs, id_col, text_col, vocabulary, end_id), "packed-ids")
    totals = stored.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    starts = docs.sparkSession.sparkContext.broadcast(dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = starts.value
        for slice_ in text_batches(batches):
            rows = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "sequence", "offset", "boundary", "ids")}
            ids_of = slice_.column(5)
            for i, (part, before, n, width) in enumerate(zip(*[slice_.column(k).to_pylist() for k in (1, 2, 3, 4)])):
                ids = np.frombuffer(ids_of[i].as_buffer(), "<u4" if width == 4 else "<u2").astype("<u4")
                first, at = base[part] + before, 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    m = min(length - offset, n - at)
                    piece = ids[at : at + m].tobytes()
                    for k, v in zip(rows, (i, at, m, zlib.crc32(piece), n, sequence, offset, at + m < n, piece)):
                        rows[k].append(v)
                    at += m
            columns = [slice_.column(0).take(pa.array(rows["doc"], pa.int64())), *[pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "sequence", "offset")], pa.array(rows["boundary"], pa.bool_())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
            if keep_ids:
                columns, names = [*columns, pa.array([np.frombuffer(b, "<i4") for b in rows["ids"]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean" + (", ids array<int>" if keep_ids else ""))
