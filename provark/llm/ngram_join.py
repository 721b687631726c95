"""N-gram Jaccard self-join by T-occurrence search (DivideSkip) inside closed shards."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import lookup, materialise, partitions, text_batches, text_bytes
from provark.llm.hashing import mix, word_hashes

#: White space [\x20\x09-\x0D], and A-Z in lower case.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as ascending 64-bit hashes.

    Words are runs without white space, A-Z lower-cased. Fewer than k words are one shingle as a whole;
    no words, none. A shingle's hash folds its words' hashes and their number."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    data = LOWER[data]
    word = ~SPACE[data]
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = word_hashes(data, starts, stops)
    first = np.searchsorted(starts, offsets)

    def fold(at: np.ndarray, m: int) -> np.ndarray:
        h = np.full(len(at), mix(np.array([m], np.uint64))[0])
        for j in range(m):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[at + j])
        return h

    counts = np.diff(first)
    whole = fold(np.arange(max(0, len(hashes) - k + 1)), k)
    out = []
    for d in range(n):
        m = counts[d]
        if m >= k:
            out.append(np.unique(whole[first[d] : first[d + 1] - k + 1]))
        elif m:
            out.append(fold(np.array([first[d]]), int(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Prefixes:
    """Keys such that any two sets with num-hundredths Jaccard similarity share one: prefixes of a set's parts by size class.

    Size classes grow by the threshold, so a partner's class is the same or a neighbour; a set signs for its
    own class and the next. Linked sets of a class differ in at most h tokens. The space of tokens is cut into
    1.5 h + 1 ranges, of which all but h hold the same tokens in both, so in any order of all (range, tokens in it) the
    prefixes of h + 1 ranges meet. A key stands for all tokens of a range, about six at 90 and two at 80 hundredths:
    texts that share a word or a passage seldom share one, however many texts there are. The order puts ranges of few or
    frequent tokens last: a token counts by how far its counter's level is below the highest. A wrong level costs time,
    never a pair."""

    def __init__(self, num: int, levels: np.ndarray, den: int = 100):
        self.num, self.den, self.levels = num, den, levels
        self.above = int(levels.max()) + 1
        self.tops = [0, 1]
        self.cuts: dict[int, tuple[int, np.ndarray]] = {}

    def group(self, size: int) -> int:
        """The class of a size: the first whose top reaches it."""
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    def cut(self, group: int) -> tuple[int, np.ndarray]:
        """By how many tokens linked sets of a class differ at most, and where its ranges but the first begin."""
        if group not in self.cuts:
            while len(self.tops) <= group:
                self.group(self.tops[-1] + 1)
            h = 2 * self.tops[group] * (self.den - self.num) // (self.den + self.num)
            n = h + h // 2 + 1
            self.cuts[group] = h, np.array([(i << 64) // n for i in range(1, n)], np.uint64)
        return self.cuts[group]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Keys of a set given as ascending tokens."""
        n = len(tokens)
        own = self.group(n)
        sums, common = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        np.cumsum(tokens, out=sums[1:])
        np.cumsum(self.levels[tokens & np.uint64(len(self.levels) - 1)], out=common[1:])
        folds = []
        for group in (own, own + 1):
            h, begins = self.cut(group)
            at = np.zeros(len(begins) + 2, np.int64)
            at[1:-1], at[-1] = np.searchsorted(tokens, begins), n
            first = np.argsort(np.diff(common[at] - self.above * at), kind="stable")[: h + 1]
            folds.append(np.diff(sums[at])[first] ^ mix(first.astype(np.uint64) << np.uint64(20) ^ np.uint64(group)))
        return mix(np.concatenate(folds))


def token_levels(rows: DataFrame, k: int, counters: int = 1 << 22, pieces: int = 128) -> np.ndarray:
    """Levels of frequency, one a counter, of all documents' distinct shingles (rows: doc_id, text, mark).

    Every shingle of every document is counted in one of `counters` cells (a power of two); tasks add up their own
    cells, then pieces of the cells are added up across tasks. A level is a twelfth of a doubling of the count, so a
    token of a low level is rare for certain. The size is fixed, whatever the corpus: a byte a cell to the
    driver and to tasks. It is enough that words and passages of very many documents stand out."""
    spark = rows.sparkSession
    width = counters // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(counters, np.uint32)
        held, size = [], 0

        def add() -> None:
            if held:
                own, times = np.unique(np.concatenate(held), return_counts=True)
                cells[own] += times.astype(np.uint32)
                held.clear()

        for batch in text_batches(batches, 2 << 20):
            for tokens in shingle_sets(batch.column(1), k):
                held.append((tokens & np.uint64(counters - 1)).astype(np.uint32))
                size += len(tokens)
            if size > 1_000_000:
                add()
                size = 0
        add()
        blobs = [zstandard.compress(cells[i * width : (i + 1) * width].tobytes(), 1) for i in range(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(blobs, pa.binary())], names=["piece", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zstandard.decompress(blob), np.uint32).astype(np.uint64)
                sums[piece] = sums[piece] + own if piece in sums else own
        for piece, own in sums.items():
            level = np.minimum(12 * np.log2(1 + own), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zstandard.compress(level.tobytes(), 1)], pa.binary())], names=["piece", "cells"])

    counted = rows.mapInArrow(count, "piece int, cells binary").repartition(min(pieces, partitions(spark)), "piece").mapInArrow(total, "piece int, cells binary")
    levels = np.zeros(counters, np.uint8)
    for r in counted.collect():  # at most `pieces` rows of fixed size
        levels[r.piece * width : (r.piece + 1) * width] = np.frombuffer(zstandard.decompress(bytes(r.cells)), np.uint8)
    return levels


def word_lists(column: pa.Array) -> list[list[bytes]]:
    """Each text's words, A-Z lower-cased; bytes.split() parts at just the white space of SPACE. Null has none."""
    lower = LOWER.tobytes()
    return [t.translate(lower).split() for t in column.cast(pa.binary()).fill_null(b"").to_pylist()]


def exact_sets(lists: Iterable[list[bytes]], k: int) -> list[np.ndarray]:
    """The sets of `shingle_sets` with numbers for shingles in place of hashes: equal numbers, equal words.

    Words are numbered, then pairs of the number so far and the next word, k - 1 times."""
    names: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    parts, few = [], {}
    for d, words in enumerate(lists):
        if len(words) < k:
            few[d] = np.array([-1 - short.setdefault(tuple(words), len(short))] if words else [], np.int64)
        parts.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    code = ids = np.concatenate([np.zeros(0, np.int64), *parts])
    place = np.arange(len(ids))
    left = np.repeat(at[1:], np.diff(at)) - place  # words from here to the end
    for j in range(1, k):
        on = left > j
        place, left = place[on], left[on]
        _, code = np.unique(code[on] << 32 | ids[place + j], return_inverse=True)
    low = np.searchsorted(place, at)
    return [few[d] if d in few else np.unique(code[low[d] : low[d + 1]]) for d in range(len(parts))]


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """What occurs in at least `need` (one or more) ascending lists, and how often, from a heap of their heads.

    A head that too few lists share goes with the next ones up to need - 1 lists: those jump, by binary search,
    to the head that is then least, since nothing before it can occur often enough."""
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= need:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need:
            yield top, len(taken)
            for i in taken:
                at[i] += 1
        else:
            while len(taken) < need - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            least = heap[0][0]
            for i in taken:
                at[i] = bisect_left(lists[i], least, at[i])
        for i in taken:
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def divide_skip(sets: list[np.ndarray], num: int, den: int = 100, weight: float = 0.01, labels: list | None = None) -> np.ndarray:
    """The least index reachable by links from each set of a shard. Linked: den * both >= num * either.

    Sets go in order of size; each asks for the earlier ones with at least T = ceil(num / den * size) common
    tokens. Its L longest inverted lists stay aside; the short ones are merged by a heap, and what occurs T - L
    times there is probed for in the long ones by binary search. Candidates already in the set's component are passed
    over; components are a union-find. `labels`: sets with the same label are in one component from the start."""
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)

    alike: dict = {}
    for i, label in enumerate(labels or []):
        join(alike.setdefault(label, i), i)
    first: dict[bytes, int] = {}
    for i, s in enumerate(sets):
        if len(s):
            join(first.setdefault(s.tobytes(), i), i)
    order = sorted(first.values(), key=lambda i: (len(sets[i]), i))  # equal sets are one
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    tokens = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.int64)
    _, token, df = np.unique(tokens, return_inverse=True, return_counts=True)
    lists = np.repeat(np.arange(len(order)), sizes)[np.argsort(token, kind="stable")].tolist()
    begin = np.concatenate([[0], np.cumsum(df)]).tolist()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    lowest = np.searchsorted(sizes, -(-num * sizes // den), "left").tolist()
    for x, me in enumerate(order):
        size, low = int(sizes[x]), lowest[x]
        if low >= x:
            continue
        own = token[bounds[x] : bounds[x + 1]]
        own = own[df[own] > 1]
        need = -(-num * size // den)
        if len(own) < need:
            continue
        own = own[np.argsort(df[own], kind="stable")]
        aside = int(min(need - 1, need / (weight * np.log2(int(df[own[-1]])) + 1)))
        own = own.tolist()
        short = []
        for t in own[: len(own) - aside]:
            a = bisect_left(lists, low, begin[t], begin[t + 1])
            short.append(lists[a : bisect_left(lists, x, a, begin[t + 1])])
        long_ = own[len(own) - aside :]
        mine = find(me)
        for y, both in merge_skip(short, need - aside):
            if find(order[y]) == mine:
                continue
            bar, left = num * (size + int(sizes[y])), len(long_)
            for t in long_:
                if (den + num) * (both + left) < bar:  # too few lists are left
                    break
                left -= 1
                a = bisect_left(lists, y, begin[t], begin[t + 1])
                both += a < begin[t + 1] and lists[a] == y
            if (den + num) * both >= bar:
                join(me, order[y])
                mine = find(me)
    return np.array([find(i) for i in range(n)], np.int64)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: connected components of edges (a, b) by rounds of contraction; root is one of the nodes.

    In a round every node takes its least neighbour below it as parent, parents' parents are taken until
    nothing moves, and edges are carried to the roots: what was joined is one node then, so rounds and jumps
    are logarithmic. No node's neighbours are ever gathered; tables are stored at each step and deleted when read."""
    labels = None
    current = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}-edges")
    while current.head(1):
        both = current.select(F.col("b").alias("v"), F.col("a").alias("u")).union(current.select(F.col("a").alias("v"), F.col("a").alias("u")))
        step = materialise(both.groupBy("v").agg(F.min("u").alias("p")), f"{name}-step")
        while True:
            jump = step.alias("x").join(step.alias("y"), F.col("x.p") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved"))
            jumped = materialise(jump, f"{name}-step")
            if not jumped.filter("moved").head(1):
                jumped.forget()
                break
            step.forget()
            step = jumped.select("v", "p")
            step.forget = jumped.forget
        if labels is None:
            new = step.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            new = materialise(labels.join(step, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")), f"{name}-labels")
        to = lambda end: step.select(F.col("v").alias(end), F.col("p").alias(f"p{end}"))  # noqa: E731, B023
        moved = current.join(to("a"), "a").join(to("b"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        before, current = current, materialise(moved.filter("a < b").distinct(), f"{name}-edges")
        before.forget()
        if labels is None:
            new.forget = step.forget
        else:
            labels.forget(), step.forget()
        labels = new
    if labels is None:
        labels = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        labels.forget = current.forget
    else:
        current.forget()
    return labels


def _searcher(k: int, percent: int):
    """What a group of (node, label, text) does: the links between labels, as (a, b) where a is another label than b."""

    def search(table: pa.Table) -> pa.Table:
        batches = text_batches(iter(table.select(["text"]).to_batches()), 1 << 20)
        sets = exact_sets((w for batch in batches for w in word_lists(batch.column(0))), k)
        labels = table.column("label").to_pylist()
        found = [labels[i] for i in divide_skip(sets, percent, labels=labels).tolist()]
        moved = sorted({(a, b) for a, b in zip(labels, found) if a != b})
        return pa.table({"a": pa.array([a for a, _ in moved], pa.int64()), "b": pa.array([b for _, b in moved], pa.int64())})

    return search


def _keyed(k: int, percent: int, levels):
    """Batches of (..., text) to one row a prefix key: the other columns and the key, as a long."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Prefixes(percent, levels.value)
        for batch in text_batches(batches, 1 << 20):
            found = [np.unique(signer.of(tokens)) if len(tokens) else np.zeros(0, np.uint64) for tokens in shingle_sets(batch.column(batch.num_columns - 1), k)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            rest = [batch.column(i).take(at) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(found).view(np.int64))], names=[*batch.schema.names[:-1], "key"])

    return keys


def _block(n: Column, salt: int) -> Column:
    """A node's block among those of a component of n nodes, each of about `per` nodes."""
    return F.when(n > F.col("per"), F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(n / (F.col("per") * 0.9)))).otherwise(F.lit(0)).cast("long")


def _follow(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, root, label) with each label replaced by the one that it is linked to; a label may hold most nodes."""
    sized = labels.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("size"))
    moves = materialise(links.join(sized, "a").select(F.col("a").alias("label"), "b", "size"), "ngram-moves")
    return lookup(labels, moves, "label", "size").select("node", "root", F.coalesce("b", "label").alias("label"))


def linked_labels(texts: DataFrame, search, keys) -> DataFrame:
    """(node, label): nodes with the same label are reachable by links within their candidate component.

    texts: stored (node, root, n, per, text), n the nodes of the component and per those of a block. 1. A component of up
    to `per` nodes is searched in one task, a larger one in blocks. 2. The blocks' labels stand for their members and are
    searched in turn, as long as that joins them. 3. Members outside of a component's largest label are asked against
    those blocks only in which another label holds one of their prefix keys: linked sets share a key, so no link between
    different labels is left out, and no task holds more than two blocks."""
    edges = "a long, b long"
    tasks = partitions(texts.sparkSession)  # searches take longer than their bytes tell, so small ones are not put together
    blocks = texts.withColumn("sub", _block(F.col("n"), 0))
    found = materialise(blocks.withColumn("label", F.col("node")).repartition(tasks, "root", "sub").groupBy("root", "sub").applyInArrow(search, edges), "ngram-links")
    labels = texts.select("node", "root", F.col("node").alias("label")).join(found, F.col("label") == F.col("a"), "left").select("node", "root", F.coalesce("b", "label").alias("label"))
    if not texts.filter("n > per").head(1):
        return labels.select("node", "label")
    small = labels.join(texts.filter("n <= per").select("node"), "node", "left_semi")
    large = blocks.filter("n > per")
    labels = materialise(labels.join(large.select("node"), "node", "left_semi"), "ngram-labels")
    for turn in range(1, 40):
        leaders = labels.filter("node = label").select("node", "root")
        many = materialise(leaders.groupBy("root").agg(F.count("*").alias("m")).filter("m > 1"), "ngram-many")
        total = many.agg(F.sum("m")).head()[0]
        if not total:
            break
        asked = lookup(leaders, many, "root", "m").filter("m is not null")
        asked = large.select("node", "per", "text").join(asked, "node").withColumn("part", _block(F.col("m"), turn)).withColumn("label", F.col("node")).drop("per")
        found = materialise(asked.repartition(tasks, "root", "part").groupBy("root", "part").applyInArrow(search, edges), "ngram-links")
        whole = not large.select("root", "per").distinct().join(many, "root").filter("m > per").head(1)
        labels = materialise(_follow(labels, found), "ngram-labels")
        if whole or found.count() * 10 < total:
            break
    sizes = labels.groupBy("root", "label").agg(F.count("*").alias("c")).groupBy("root").agg(F.max(F.struct("c", "label"))["label"].alias("most"), F.sum("c").alias("all"), F.max("c").alias("c"))
    open_ = materialise(sizes.filter(F.col("all") > F.col("c")).select("root", "most", F.col("all").alias("n_all")), "ngram-open")
    if open_.head(1):
        known = lookup(large.select("node", "sub", "text").join(labels, "node"), open_, "root", "n_all").filter("n_all is not null")
        signed = known.select("root", "sub", "node", "label", "most", "text").mapInArrow(keys, "root long, sub long, node long, label long, most long, key long")
        signed = materialise(signed, "ngram-keys")
        mixed = signed.groupBy("root", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        live = materialise(signed.join(mixed, ["root", "key"], "left_semi"), "ngram-mixed")
        signed.forget()
        salt = F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")
        asks = live.filter("label != most").select("root", "key", "node", "label", salt.alias("salt"))
        held = live.groupBy("root", "key", "sub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        pairs = asks.join(held, ["root", "key", "salt"]).filter("label != lo or label != hi").select("root", "node", "sub").distinct()
        pairs = materialise(pairs, "ngram-pairs")
        live.forget()
        asked = pairs.groupBy("root", "sub").agg(F.count("*").alias("asked"))
        sized = large.select("root", "sub", "per").distinct().join(asked, ["root", "sub"])
        sized = materialise(sized.select("root", "sub", F.ceil(F.col("asked") / F.col("per")).alias("groups")), "ngram-groups")
        columns = ["root", "sub", "group", "label", "text"]
        content = large.select("node", "text").join(labels.select("node", "label"), "node")
        members = large.select("root", "sub", "node").join(sized, ["root", "sub"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        rest = pairs.join(sized, ["root", "sub"]).withColumn("group", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("groups")))
        both = members.select("root", "sub", "node", "group").union(rest.select("root", "sub", "node", "group")).join(content, "node").select(columns)
        met = materialise(both.repartition(tasks, "root", "sub", "group").groupBy("root", "sub", "group").applyInArrow(search, edges), "ngram-links")
        joined = components(met, "ngram-last").select(F.col("node").alias("a"), F.col("root").alias("b"))
        labels = _follow(labels, joined)
    return small.select("node", "label").union(labels.select("node", "label"))


def held_marks(marks: DataFrame, bits: int = 1 << 26, pieces: int = 64):
    """A function of a column of longs: whether it may be among marks (one column). A bit a mark, of fixed number whatever
    the corpus: more marks let more others pass, and lose none."""
    spark = marks.sparkSession
    mark, width = marks.columns[0], bits // pieces

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            for piece in np.unique(at // np.uint64(width)).tolist():
                own = sets.setdefault(piece, np.zeros(width, bool))
                own[(at[at // np.uint64(width) == piece] % np.uint64(width)).astype(np.int64)] = True
        for piece, own in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["piece", "cells"])

    dealt = marks.repartition(min(pieces, partitions(spark)), F.floor(F.pmod(mark, F.lit(bits)) / width))
    cells = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(put, "piece int, cells binary").collect():  # at most `pieces` rows of fixed size
        cells[r.piece * width // 8 : (r.piece + 1) * width // 8] |= np.frombuffer(bytes(r.cells), np.uint8)
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("boolean")
    def held(mark: pd.Series) -> pd.Series:
        at = (mark.to_numpy(np.int64).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
        return pd.Series(shared.value[at >> 3] >> (7 - (at & 7)) & 1 == 1)

    return held


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, block: int = 256, block_shingles: int = 1 << 20) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Documents link when 100 * common >= percent * all distinct shingles of both; component_id is the smallest id
    reachable by links. Within a task texts of the same words are one representative. Representatives' prefix keys,
    packed by hash bucket, meet once; those that share one form candidate components, which are closed under
    linking; in a component texts of the same words are one again. Only texts of components with different words are
    fetched and shuffled, found by a fixed number of bits, and each such component is searched by `divide_skip`,
    in blocks of about `block` representatives, fewer where they hold over `block_shingles` (`linked_labels`), over the
    words themselves: hashes of words only bring texts together. Tables are deleted when nothing reads them any more.

    Null text counts as empty; documents without words link with nothing. Rows with the same id count as one
    document with several texts. A null id sorts last. Empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    buckets = partitions(spark) * 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    pair = np.dtype([("key", "<u4"), ("node", "<u4")])  # a bucket and half a key tell keys apart well enough to be candidates
    levels = spark.sparkContext.broadcast(token_levels(rows, k))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        signer, seen, count = Prefixes(percent, levels.value), {}, 0
        held: list[tuple[np.ndarray, int]] = []
        names = ["doc_id", "mark", "n_shingles", "node", "first", "words", "bucket", "base", "blob"]

        def packed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, node = np.concatenate([k for k, _ in held]), np.repeat(np.array([n for _, n in held], np.uint32), [len(k) for k, _ in held])
            held.clear()
            bucket = (key >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            every, bucket = np.empty(len(key), pair), bucket[order]
            every["key"], every["node"] = key[order] & np.uint64(0xFFFFFFFF), node[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [every[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(every)))]
            n = len(at)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(bucket[at].astype(np.int64)), pa.array(np.full(n, base)), pa.array(blobs, pa.binary())], names=names)

        size = 0
        for batch in text_batches(batches, 2 << 20):
            nodes, firsts, sizes, contents = [], [], [], []
            for tokens, words in zip(shingle_sets(batch.column(1), k), word_lists(batch.column(1))):
                sizes.append(len(tokens))
                content = hashlib.blake2b(b" ".join(words), digest_size=20).digest()
                node = seen.get(content) if len(tokens) else None
                firsts.append(node is None)
                if node is None:
                    node, count = count, count + 1
                    if len(tokens):
                        seen[content] = node
                        held.append((signer.of(tokens), node))
                        size += len(held[-1][0])
                nodes.append(base | node)
                contents.append(content if firsts[-1] else None)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(firsts, pa.bool_()), pa.array(contents, pa.binary()), pa.array(np.arange(n) % buckets), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            if size > 2_000_000:
                yield from packed()
                size = 0
        yield from packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' rows go through; blobs become edges between the nodes that share a key."""
        keys, nodes = [], []
        names = ["doc_id", "mark", "n_shingles", "node", "first", "words", "other"]
        for batch in batches:
            blob = batch.column(8)
            own = batch.filter(blob.is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(6)], pa.nulls(own.num_rows, pa.int64())], names=names)
            signed = batch.filter(blob.is_valid())
            for i, (bucket, base) in enumerate(zip(signed.column(6).to_pylist(), signed.column(7).to_pylist())):
                got = np.frombuffer(signed.column(8)[i].as_buffer(), pair)
                keys.append(got["key"].astype(np.uint64) | np.uint64(bucket << 32))
                nodes.append(got["node"].astype(np.int64) | base)
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        keys.clear(), nodes.clear()
        order = np.argsort(key)
        key, node = key[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(node, at), np.diff(np.append(at, len(key))))
        apart = least != node
        edges = np.unique(np.stack([least[apart], node[apart]], 1), axis=0)
        for a in range(0, len(edges), 100_000):
            part = edges[a : a + 100_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(part[:, 0]), pa.nulls(len(part), pa.bool_()), pa.nulls(len(part), pa.binary()), pa.array(part[:, 1])], names=names)

    about = "doc_id long, mark long, n_shingles long, node long, first boolean, words binary"
    signed = rows.mapInArrow(sign, f"{about}, bucket long, base long, blob binary")
    met = materialise(signed.repartition(partitions(spark), "bucket").mapInArrow(meet, f"{about}, other long"), "ngram-met")
    members = met.filter("other is null")
    labels = components(met.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "ngram")

    own = materialise(members.filter("first").join(labels, "node").select("root", "words", "node", F.col("doc_id").alias("id"), F.col("mark").alias("m"), "n_shingles"), "ngram-own")
    same = own.groupBy("root", "words").agg(F.min(F.struct("node", "id", "m", "n_shingles")).alias("first"))
    same = materialise(same.select("root", "words", "first.*"), "ngram-same")
    counts = same.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")).filter("n > 1")
    per = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("n") * block_shingles / F.greatest("all", F.lit(1))))).cast("long")
    counts = materialise(counts.select("root", "n", per.alias("per")), "ngram-counts")
    wanted = materialise(lookup(same, counts, "root", "n").filter("n is not null").select("node", "root", "n", "per", "id", "m"), "ngram-wanted")
    near = rows.filter(held_marks(wanted.select("m"))("mark"))
    near = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")))
    texts = materialise(near.select("node", "root", "n", "per", "text"), "ngram-texts")
    if texts.count() > wanted.count():  # rows that are repeated as they are
        texts, again = materialise(texts.dropDuplicates(["node"]), "ngram-texts"), texts
        again.forget()
    linked = linked_labels(texts, _searcher(k, percent), _keyed(k, percent, levels))
    linked = materialise(linked.select(F.col("node").alias("one"), "label"), "ngram-linked")
    texts.forget(), wanted.forget(), counts.forget()
    named = own.select("root", "words", "node").join(same.select("root", "words", F.col("node").alias("one")), ["root", "words"])
    named = named.join(linked, "one", "left").select("node", F.coalesce("label", "one").alias("label"))
    rooted = materialise(members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("root")), "ngram-rooted")
    for done in (met, labels, own, same, linked):
        done.forget()
    least = materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), "ngram-least")
    return lookup(rooted, least, "root", "size").select("doc_id", "n_shingles", "component_id")
