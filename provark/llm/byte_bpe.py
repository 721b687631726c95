"""Byte-level BPE encoding and decoding by recursive queries in DuckDB."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from provark.llm.common import text_batches, texts_of

#: Each step contracts, in every word that still has a known pair, the leftmost pair of least rank. A row is a
#: token at its first byte's place in the block; nxt and follow are the next token's place and id, none at a word's
#: end. A word without a pair is written once more as done and leaves the state.
FIXPOINT = """
WITH RECURSIVE state(done, wid, pos, tok, nxt, follow) AS (
    SELECT false, wid, pos, tok, nxt, follow FROM start
  UNION ALL
    (WITH pair AS MATERIALIZED (
       SELECT wid, pos, tok, nxt, follow, (rank << 32) | pos AS key
       FROM state LEFT JOIN merges ON (tok::BIGINT << 32) | follow = joint WHERE NOT done),
     best AS (SELECT wid, min(key) AS key, arg_min(nxt, key) AS gone FROM pair GROUP BY wid),
     contracted AS (
       SELECT b.wid, (b.key & 4294967295)::INT AS spot, (b.key >> 32)::INT AS made, gone, p.nxt AS gone_nxt, p.follow AS gone_follow
       FROM best b LEFT JOIN pair p ON p.pos = b.gone)
     SELECT gone IS NULL, wid, pos,
            CASE WHEN pos = spot THEN made ELSE tok END,
            CASE WHEN pos = spot THEN gone_nxt ELSE nxt END,
            CASE WHEN pos = spot THEN gone_follow WHEN nxt = spot THEN made ELSE follow END
     FROM pair JOIN contracted USING (wid) WHERE pos IS DISTINCT FROM gone)
)
SELECT wid, tok FROM state WHERE done ORDER BY pos
"""

#: Decoding: the tokens' bytes, in hexadecimal, in the order of their positions.
DECODE = "SELECT wid, string_agg(hex, '' ORDER BY pos) AS hex FROM coded JOIN vocabulary USING (tok) GROUP BY wid ORDER BY wid"

#: Rows that one recursion may write: a word of n bytes writes n (n + 1) / 2 of them at most, and its last ones twice.
BLOCK_ROWS = 2_000_000


class ByteBPE:
    """Encodes pieces of text as a rank vocabulary does; one in-memory database a worker process, without spilling.

    A piece that is itself a token is that token. The one exception to the recursive query: a piece longer than
    `long_bytes`, which needs a step and a state of all its tokens for each merge (a million equal letters would
    take a million steps), goes through a heap of pairs with the same order of merges; tests hold both equal."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_cached: int = 500_000, long_bytes: int = 256):
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.long_bytes, self.max_cached = long_bytes, max_cached
        self.single = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": "false", "temp_directory": ""})
        joint, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    joint.append(a << 32 | b), made.append(rank)
        self.db.register("m", pa.table({"joint": pa.array(joint, pa.int64()), "rank": pa.array(made, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks], pa.string())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")

    def _by_heap(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        n = len(piece)
        tokens: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or j >= n or ranks.get(tokens[i] + tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = tokens[i] + tokens[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := ranks.get(tokens[a] + tokens[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [ranks[t] for t in tokens if t is not None]

    def _by_query(self, words: list[bytes], wids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and tokens, in order, of one block of words by the recursive query."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        pos = np.arange(len(ids), dtype=np.int32)
        after, follow = pa.array(pos + 1, mask=last), pa.array(np.append(ids[1:], np.int32(0)), mask=last)
        self.db.register("start", pa.table({"wid": np.repeat(np.array(wids, np.int32), sizes), "pos": pos, "tok": ids, "nxt": after, "follow": follow}))
        got = self.db.sql(FIXPOINT).to_arrow_table()
        self.db.unregister("start")
        return got.column("wid").to_numpy(), got.column("tok").to_numpy()

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids one after the other, and the offsets of pieces in them: whole tokens at once, the others
        by the recursive query in blocks of bounded work. An empty piece has no ids."""
        wids, toks = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        whole = [(w, r) for w, r in enumerate(map(self.ranks.get, pieces)) if r is not None]
        if whole:
            a, b = zip(*whole)
            wids.append(np.array(a, np.int32)), toks.append(np.array(b, np.int32))
        block, rows = [], 0
        for w, piece in enumerate(pieces):
            n = len(piece)
            if piece in self.ranks or not n:
                continue
            if n > self.long_bytes:
                ids = self._by_heap(piece)
                wids.append(np.full(len(ids), w, np.int32)), toks.append(np.array(ids, np.int32))
                continue
            if rows + n * (n + 3) // 2 > BLOCK_ROWS:
                a, b = self._by_query([pieces[i] for i in block], block)
                wids.append(a), toks.append(b)
                block, rows = [], 0
            block.append(w)
            rows += n * (n + 3) // 2
        if block:
            a, b = self._by_query([pieces[i] for i in block], block)
            wids.append(a), toks.append(b)
        wid, tok = np.concatenate(wids), np.concatenate(toks)
        order = np.argsort(wid, kind="stable")
        return tok[order], np.concatenate([[0], np.cumsum(np.bincount(wid, minlength=len(pieces)))])

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each run of tokens, by ordered aggregation."""
        counts = np.diff(offsets)
        wid = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.db.register("coded", pa.table({"wid": wid, "pos": np.arange(len(tokens), dtype=np.int32), "tok": tokens}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        out = [b""] * len(counts)
        for w, h in zip(got.column("wid").to_pylist(), got.column("hex").to_pylist()):
            out[w] = bytes.fromhex(h)
        return out

    def learn(self, texts_pieces: list[list[str]]) -> None:
        """Codes the pieces that are not cached yet; what a call needs is kept until the next."""
        needed = set().union(*texts_pieces) if texts_pieces else set()
        new = needed.difference(self.known)
        if len(self.known) + len(new) > self.max_cached:
            self.known.clear()
            new = needed
        pieces = list(new)
        tokens, offsets = self.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        strings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.cast(pa.array(tokens), pa.string()))
        self.known.update(zip(pieces, zip(pc.binary_join(strings, ",").to_pylist(), self.decode(tokens, offsets))))


_CODERS: dict[str, ByteBPE] = {}


def coder(vocabulary: str) -> ByteBPE:
    if vocabulary not in _CODERS:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[vocabulary] = ByteBPE(ranks, public_tokenizers.PATTERN)
    return _CODERS[vocabulary]


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", keep_ids: bool = True) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes) and, with `keep_ids`, ids and the decoded bytes.

    Each match of the pattern is coded by itself, without special tokens. Null counts as empty: no ids.
    Null ids come back null, rows with the same id stay apart, other columns are ignored. A narrow map:
    each task's database holds the merge table and one block of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in text_batches(batches, 8 << 20):
            pieces = [own.find(t) for t in texts_of(batch.column(1))]
            own.learn(pieces)
            joined, decoded = [], []
            for p in pieces:
                ids, raw = zip(*map(own.known.__getitem__, p)) if p else ((), ())
                joined.append(",".join(ids)), decoded.append(b"".join(raw))
            columns = [
                batch.column(0),
                pa.array([j.count(",") + 1 if j else 0 for j in joined], pa.int64()),
                pa.array([sha(j.encode()) for j in joined]),
                pa.array([sha(d) for d in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([list(map(int, j.split(","))) if j else [] for j in joined], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else ""))
