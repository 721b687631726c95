"""Searches over graphs: what many roots reach, as bits; and trees of predecessors, from which paths are walked back.

Roots are numbered; a row (uid, block, w0 .. w3) says by 256 bits which roots of a block have reached a node. A level is one
join with the edges and one aggregation that ors words, so rows and bytes do not follow the number of (root, node) pairs.
Every level is a stored table: lineage stays flat, and a loop ends where nothing new comes. A node of very many edges is a
hot key of the join with the edges; adaptive execution splits such partitions.

Where most nodes reach most others, rows of a level follow edges times blocks; `every_pair` multiplies tiles of bits for
such graphs instead."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.plans.storage import numbered, stored

WORDS = 4
_BITS = 64 * WORDS
_F, _S = [f"w{i}" for i in range(WORDS)], [f"s{i}" for i in range(WORDS)]


def _any(columns: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.col(c) != 0
    return out


def _ored(columns: Iterable[str]) -> list[Column]:
    return [F.bit_or(c).alias(c) for c in columns]


@dataclass
class Reach:
    """sets: uid, block, hops, w0 ..: for each node and level the roots that first reach it there. roots: root, number."""

    sets: DataFrame
    roots: DataFrame

    def _numbers(self, rows: DataFrame, *columns: str) -> DataFrame:
        """columns and the number of each root whose bit is set."""
        place = [F.expr(f"transform(filter(sequence(0, 63), i -> bit_get({w}, i) = 1), i -> block * {_BITS} + {64 * k} + i)") for k, w in enumerate(_F)]
        return rows.select(*columns, F.explode(F.concat(*place)).alias("number"))

    def counts(self) -> DataFrame:
        """root, hops, n: how many nodes a root reaches in so many steps. Bits are counted where they are."""
        n = self._numbers(self.sets, "hops").groupBy("number", "hops").agg(F.count("*").alias("n"))
        return n.join(self.roots, "number").select("root", "hops", "n")

    def groups(self, labels: DataFrame) -> DataFrame:
        """root, n: how many distinct labels (uid, label) the nodes that a root reaches have; null is none."""
        met = self.sets.join(labels.filter("label is not null"), "uid").groupBy("label", "block").agg(*_ored(_F))
        return self._numbers(met).groupBy("number").agg(F.count("*").alias("n")).join(self.roots, "number").select("root", "n")

    def pairs(self) -> DataFrame:
        """root, uid, hops: every pair, on request."""
        return self._numbers(self.sets, "uid", "hops").join(self.roots, "number").select("root", "uid", "hops")


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 6, reverse: bool = False, together: bool = False) -> Reach:
    """What each seed (column uid) reaches within `depth` steps, itself left out; with `together` what any of them reaches,
    under one empty root. Null ends and repeated rows say nothing."""
    steps = edges.select(F.col("dst" if reverse else "src").alias("a"), F.col("src" if reverse else "dst").alias("b")).dropna().distinct()
    steps = stored(steps, "steps")
    own = seeds.select("uid").dropna().distinct()
    known = own.withColumn("number", F.lit(0).cast("long")) if together else numbered(own, [F.col("uid")], "number")
    known = stored(known.select("uid", F.col("number").cast("long").alias("number")), "roots")
    n = F.col("number")
    word, bit = F.floor(n % _BITS / 64), F.lit(1).cast("long")
    start = known.select("uid", F.floor(n / _BITS).alias("block"), *[F.when(word == k, F.expr("shiftleft(1L, int(number % 64))")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(_F)])
    start = start.groupBy("uid", "block").agg(*_ored(_F))
    table = stored(start.select("*", *[F.col(w).alias(s) for w, s in zip(_F, _S)]), "reach")
    found = table.select("uid", "block", *_F).withColumn("hops", F.lit(0)).filter("false")
    none = [F.lit(0).cast("long").alias(c) for c in _S]
    for level in range(1, depth + 1):
        front = table.filter(_any(_F)).select("uid", "block", *_F)
        come = front.join(steps, front["uid"] == steps["a"]).groupBy(F.col("b").alias("uid"), "block").agg(*_ored(_F)).select("uid", "block", *_F, *none)
        before = table.select("uid", "block", *[F.lit(0).cast("long").alias(w) for w in _F], *_S)
        both = come.unionByName(before).groupBy("uid", "block").agg(*_ored(_F), *_ored(_S))
        fresh = {w: F.col(w).bitwiseAND(F.bitwise_not(s)) for w, s in zip(_F, _S)}
        table = stored(both.select("uid", "block", *[fresh[w].alias(w) for w in _F], *[F.col(s).bitwiseOR(F.col(w)).alias(s) for w, s in zip(_F, _S)]), "reach")
        if not table.filter(_any(_F)).head(1):
            break
        found = found.unionByName(table.filter(_any(_F)).select("uid", "block", *_F, F.lit(level).alias("hops")))
    return Reach(found, known.select(F.lit("").alias("root") if together else F.col("uid").alias("root"), "number").distinct())


#: Fixed sizes: words of a tile (32 MB), tiles to have at least, edges of a part, and pairs of a batch.
_TILE, _TILES, _PART, _BATCH = 1 << 22, 32, 1 << 21, 1 << 19


def every_pair(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """root, uid, hops as by `reach(...).pairs()`, for graphs in which most nodes reach most others.

    Nodes are numbered in order, a tile is all nodes' bits of a stretch of roots, and a level is a product of tiles with the
    edges into a part of the nodes. A node's bits in a tile go, with the edges from it, to each part that these lead into, and
    no other edges go to the tile: what a level moves follows the bits and the edges from where they are new, neither edges
    times bits nor edges times tiles. More nodes make narrower tiles, more edges more parts. The search stops where every
    pair is known. Pairs are made at the end."""
    steps = stored(edges.select("src", "dst").dropna().distinct(), "steps")
    own = seeds.select("uid").dropna().distinct()
    ends = steps.select(F.col("src").alias("uid")).union(steps.select("dst")).union(own).distinct()
    nodes = stored(numbered(ends, [F.col("uid")], "number").select("uid", F.col("number").cast("int").alias("node")), "nodes")
    n, parts = nodes.count(), steps.count() // _PART + 1
    words = max(1, min(_TILE // max(n, 1), -(-n // (64 * _TILES))))
    end = lambda name, to: nodes.select(F.col("uid").alias(name), F.col("node").alias(to))
    leads = steps.join(end("src", "a"), "src").join(end("dst", "b"), "dst").groupBy(F.col("a").alias("node"), (F.col("b") % parts).alias("part")).agg(F.collect_list("b").alias("targets"))
    leads = stored(leads, "leads")
    schema = "tile int, node int, new int, front binary, seen binary"
    table = stored(nodes.join(own, "uid").select("node").mapInArrow(_first(words), schema), "tiles")
    left, found = table.count() * (n - 1), []
    for level in range(1, depth + 1):
        fresh = F.col("new") > 0
        if left == 0 or not table.filter(fresh).head(1):
            break
        ahead = table.filter(fresh).select(F.col("tile").alias("tile"), F.col("node").alias("source"), F.col("front").alias("front"))
        ahead = ahead.join(leads, F.col("source") == leads["node"]).select("tile", "part", "front", "targets")
        known = table.select("tile", (F.col("node") % parts).alias("part"), "node", "seen")
        table = stored(known.groupBy("tile", "part").cogroup(ahead.groupBy("tile", "part")).applyInArrow(_level(words), schema), "tiles")
        left -= table.agg(F.sum("new")).head()[0] or 0
        found.append(table.filter(fresh).select("tile", "node", "front", F.lit(level).alias("hops")))
    key = nodes.schema["uid"].dataType.simpleString()
    rows = None
    for one in found:
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return own.sparkSession.createDataFrame([], f"root {key}, uid {key}, hops int")
    made = rows.join(F.broadcast(nodes), "node").select("tile", "uid", "front", "hops").mapInArrow(_pairs(words), f"node int, uid {key}, hops int")
    return made.join(F.broadcast(end("root", "node")), "node").select("root", "uid", "hops")  # a row a node, counted


def _bits(column: pa.ChunkedArray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _first(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each root's own bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            rows = [(1 << int(k)).to_bytes(8 * words, "little") for k in node % (64 * words)]
            tile = (node // (64 * words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tile), batch["node"], pa.array(np.ones(len(node), np.int32)), pa.array(rows, pa.binary()), pa.array(rows, pa.binary())], ["tile", "node", "new", "front", "seen"])

    return run


def _level(words: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A tile's next level in one part of the nodes: each node takes the bits in front of its sources, less what it has."""

    def run(key: tuple, known: pa.Table, ahead: pa.Table) -> pa.Table:
        lists = ahead["targets"].combine_chunks()
        values, bits = lists.flatten().to_numpy(), _bits(ahead["front"], words)
        node = np.union1d(known["node"].to_numpy(), values)
        seen = np.zeros((len(node), words), np.uint64)
        seen[np.searchsorted(node, known["node"].to_numpy())] = _bits(known["seen"], words)
        come = np.zeros_like(seen)
        if len(values):
            to, at = np.searchsorted(node, values), np.repeat(np.arange(len(bits)), lists.value_lengths().to_numpy())
            order = np.argsort(to, kind="stable")
            to, at = to[order], at[order]
            size = max(1, _TILE // 2 // words)
            for low in range(0, len(to), size):
                here = to[low : low + size]
                starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                come[here[starts]] |= np.bitwise_or.reduceat(bits[at[low : low + size]], starts, axis=0)
        come &= ~seen
        seen |= come
        new = np.bitwise_count(come).sum(axis=1, dtype=np.int32)
        kept = np.flatnonzero(seen.any(axis=1))
        front = [come[i].tobytes() if new[i] else None for i in kept]
        whole = [seen[i].tobytes() for i in kept]
        tile = np.full(len(kept), key[0].as_py(), np.int32)
        return pa.table({"tile": tile, "node": node[kept].astype(np.int32), "new": new[kept], "front": pa.array(front, pa.binary()), "seen": pa.array(whole, pa.binary())})

    return run


def _pairs(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each bit: the root's number, what it reaches, and in how many steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, _BATCH // (64 * words))
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                own = batch.slice(low, size)
                bits = np.frombuffer(b"".join(own["front"].to_pylist()), np.uint8).reshape(own.num_rows, 8 * words)
                row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                root = own["tile"].to_numpy()[row] * (64 * words) + bit
                yield pa.RecordBatch.from_arrays([pa.array(root.astype(np.int32)), own["uid"].take(pa.array(row)), own["hops"].take(pa.array(row))], ["node", "uid", "hops"])

    return run


@dataclass
class Tree:
    """levels: one table each of root, uid, parent, confidence; steps: src, dst, c, p (merged edges)."""

    levels: list[DataFrame]
    steps: DataFrame

    def found(self) -> DataFrame:
        """root, uid, hops, confidence."""
        out = None
        for k, level in enumerate(self.levels):
            rows = level.select("root", "uid", F.lit(k).alias("hops"), "confidence")
            out = rows if out is None else out.unionByName(rows)
        return out

    def paths(self, asked: DataFrame | None = None) -> DataFrame:
        """root, uid, path, confidence, providers of the nodes asked for (root, uid; all without): from the last level back,
        only parents of what is needed are kept; then paths grow from their roots."""
        wanted = asked.select("root", "uid").distinct() if asked is not None else None
        needed, more = list(self.levels), None
        if wanted is not None:
            for k in reversed(range(len(needed))):
                keys = wanted if more is None else wanted.unionByName(more).distinct()
                needed[k] = needed[k].join(keys, ["root", "uid"], "left_semi")
                more = needed[k].select("root", F.col("parent").alias("uid"))
        grown = needed[0].select("root", "uid", F.array("uid").alias("path"), "confidence", F.array().cast("array<string>").alias("providers"))
        out = grown
        for level in needed[1:]:
            before = grown.select("root", F.col("uid").alias("parent"), F.col("path").alias("_path"), F.col("providers").alias("_providers"))
            rows = level.join(before, ["root", "parent"]).join(self.steps.select(F.col("src").alias("parent"), F.col("dst").alias("uid"), "p"), ["parent", "uid"])
            grown = rows.select("root", "uid", F.concat("_path", F.array("uid")).alias("path"), "confidence", F.array_sort(F.array_union("_providers", "p")).alias("providers"))
            out = out.unionByName(grown)
        return out.join(wanted, ["root", "uid"], "left_semi") if wanted is not None else out


def search(edges: DataFrame, sources: DataFrame, max_nodes: int, nearest: bool = False) -> Tree:
    """A tree of shortest paths from each source (uid) along edges (src, dst, confidence, provenance).

    A level's row is a node, its parent and the weakest confidence so far: paths are not carried. Of equally short paths the
    least stays, compared from the root on: a level is stored in the order of its paths, and its rows' places in that order
    decide between parents at the next one. With `nearest` all sources search as one (root is empty), and of equally short
    paths the one stays that is least when read from the node back: the least parent, which is what a search back from the
    node over sorted callers meets first."""
    steps = edges.groupBy("src", "dst").agg(F.max("confidence").alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("p"))
    steps = stored(steps.dropna(subset=["src", "dst"]), "steps")
    start = sources.select((F.lit("") if nearest else F.col("uid")).alias("root"), "uid", F.lit(None).cast("string").alias("parent"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("place")).dropna(subset=["uid"]).distinct()
    levels = [stored(start, "tree")]
    for _ in range(max_nodes - 1):
        last = levels[-1]
        step = last.join(steps, last["uid"] == steps["src"]).select("root", F.col("dst").alias("uid"), F.col("src").alias("parent"), F.least("confidence", "c").alias("confidence"), "place")
        by = F.struct("parent") if nearest else F.struct("place", "parent")
        best = step.groupBy("root", "uid").agg(F.min_by(F.struct("parent", "confidence", "place"), by).alias("b")).select("root", "uid", "b.*")
        for level in levels:
            best = best.join(level.select("root", "uid"), ["root", "uid"], "left_anti")
        if not nearest:
            best = best.repartitionByRange("place", "uid").sortWithinPartitions("place", "uid").withColumn("place", F.monotonically_increasing_id())
        best = stored(best, "tree")
        if not best.head(1):
            break
        levels.append(best)
    return Tree(levels, steps)
