"""Suffix-array deduplication: bytes of long strings that occurred earlier are removed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.llm.common import materialise, partitions, shared_dir, text_batches, text_bytes
from provark.llm.hashing import PrefixHash, mix
from provark.llm.suffix_array import permuted_lcp, suffix_array

#: Characters of an anchor; every window of `length` bytes holds length - ANCHOR + 1 of them.
ANCHOR = 32
LAST = np.iinfo(np.int64).max

SEGMENT = np.dtype([("doc", "<u4"), ("start", "<u4"), ("count", "<u4")])
KEYED = np.dtype([("anchor", "<u8"), ("segment", "<u4")])
#: In KEYED a segment's number carries this bit where the anchor occurs twice within the segment's own text.
TWICE = np.uint32(1 << 31)
#: And this one where the anchor is a hot one.
HOT = np.uint32(1 << 30)
#: Windows of a hot anchor go on by the anchor's place in the window, in ranges of so many places.
RANGE = 8
RUN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("count", "<u4")])


def pack(array: np.ndarray) -> bytes:
    """Columns of a structured array one after the other, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(array[c]).tobytes() for c in array.dtype.names), 1)


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n, at = len(raw) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for c in dtype.names:
        size = dtype[c].itemsize * n
        out[c] = np.frombuffer(raw, dtype[c], n, at)
        at += size
    return out


def _sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `span` neighbouring values."""
    out, have = values, 1
    while have < span:
        move = min(have, span - have)
        out = pick(out[: len(out) - move], out[move:])
        have += move
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: SEGMENT rows, anchors, content hashes, and whether the anchor
    occurs twice within the run's text. A window's anchor is the least hash of its strings of ANCHOR
    bytes, so equal windows have equal anchors wherever they are."""
    n = len(data)
    empty = np.zeros(0, SEGMENT), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    if n < length:
        return empty
    prefix = PrefixHash(data)
    at = np.arange(n - ANCHOR + 1)
    hashes = prefix.of(at, at + ANCHOR)
    span = length - ANCHOR + 1
    least = _sliding(hashes, span, np.minimum)
    # a string is the anchor of some window if its hash is the largest of the least ones of the windows that hold it
    edge = np.zeros(span - 1, np.uint64)
    leading = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == hashes)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = np.arange(len(least)) + length <= offsets[doc + 1]
    where = np.flatnonzero(valid)
    if not len(where):
        return empty
    least, doc = least[where], doc[where]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (where[1:] != where[:-1] + 1) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(where)))
    start, anchor, owner = where[first], least[first], doc[first]
    out = np.empty(len(first), SEGMENT)
    out["doc"], out["start"], out["count"] = owner, start - offsets[owner], count
    content = prefix.of(start, start + count - 1 + length)
    # how often the anchor occurs among the run's own strings
    lo, hi = np.searchsorted(leading, start), np.searchsorted(leading, start + count + span - 1)
    edge = np.concatenate([[0], np.cumsum(hi - lo)])
    flat = np.arange(edge[-1]) + np.repeat(lo - edge[:-1], hi - lo)
    times = np.add.reduceat(hashes[leading[flat]] == np.repeat(anchor, hi - lo), edge[:-1], dtype=np.int64)
    return out, anchor, content, times > 1


def gathered(data: np.ndarray, begin: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `reach` bytes from `begin`, one after the other, and where each begins there."""
    at = np.concatenate([[0], np.cumsum(reach)])
    return data[np.arange(at[-1]) + np.repeat(begin - at[:-1], reach)], at[:-1]


def refined(data: np.ndarray, begin: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of hot anchors (window starts `begin`, `count` windows each) in parts: their segment, the first
    window's place in it, windows, and key.

    Windows that equal one another hold their anchor first at the same place, so they have what all windows of
    one range of places have in common: bytes from RANGE - 1 behind the first window's start to its end."""
    prefix, whole = PrefixHash(data), np.repeat(np.arange(len(begin)), count)
    start = np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count)
    window = begin[whole] + start
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = prefix.of(at, at + ANCHOR)
    place = np.flatnonzero(np.isin(hashes, anchor))
    by = np.lexsort((place, hashes[place]))
    place, value = place[by], hashes[place[by]]
    names = np.unique(value)
    group = np.searchsorted(names, anchor[whole])
    # the anchor's first occurrence at or behind the window's start: both sides are ordered by (anchor, place)
    joint = np.searchsorted(np.searchsorted(names, value) * (len(data) + 1) + place, group * (len(data) + 1) + window)
    offset = place[joint] - window
    part = offset // RANGE
    fresh = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (part[1:] != part[:-1]) | (place[joint][1:] != place[joint][:-1])]))
    core = place[joint][fresh] - part[fresh] * RANGE
    key = mix(mix(anchor[whole[fresh]]) ^ prefix.of(core, core + length - RANGE + 1) ^ part[fresh].astype(np.uint64))
    return whole[fresh], start[fresh], np.diff(np.append(fresh, len(whole))), key


def covered_windows(data: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For segments laid out in order of age (starts `at`, `count` windows each): the places of windows that an
    earlier window equals. Suffixes that share `length` bytes are neighbours in the suffix array."""
    sa = suffix_array(data)
    lcp = permuted_lcp(data, sa)[sa]
    window = np.zeros(len(data) + 1, np.int64)
    np.add.at(window, at, 1)
    np.add.at(window, at + count, -1)
    ours = np.cumsum(window[:-1])[sa] > 0
    group = np.cumsum(lcp < length)[ours]
    place = sa[ours]
    if not len(place):
        return place
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(place))))
    return np.sort(place[place != least])


def runs(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """RUN rows of windows given one by one in order."""
    if not len(doc):
        return np.zeros(0, RUN)
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    out = np.empty(len(fresh), RUN)
    out["doc"], out["start"], out["count"] = doc[fresh], start[fresh], np.diff(np.append(fresh, len(doc)))
    return out


def _bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as a table in the shared folder, dealt by `key` as it is written: joins by that key move only the other side.

    The session's catalogue knows the table by a name of its own, since a bare path has no buckets."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk_bytes: int = 6 << 20, shard_bytes: int = 1 << 20, task_bytes: int = 128 << 20, hot_segments: int = 4096, keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_text`, kept (bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. 1. Texts are stored in chunks with their segments (runs of windows with
    the same anchor); equal segments of a chunk are one. 2. Anchors meet by hash bucket; those of one segment
    only, without a repeat inside, are done: no window of theirs occurs twice. 3. The others' segments go to
    shards by anchor, where equal ones are again one; of those that differ under one anchor, or repeat it, each
    shard's suffix array and permuted common prefixes tell which windows an earlier one equals. 4. Chunks put the
    windows together and cut the texts. Chunks are bucketed as they are stored, so texts are never shuffled, only
    segments that meet others. Buckets number at least one for each `task_bytes` of text, counted before. An anchor of
    over `hot_segments` segments is split: its windows go on by the place of the anchor in them and by
    the bytes that all windows of that place share. Hashes only bring together; bytes decide.

    Null text counts as empty. A null id comes last; rows with the same id follow each other in stored order.
    Empty tables give no rows; other columns are ignored. Offsets in a text are below 2 ** 32."""
    spark = docs.sparkSession
    counted = docs.agg(F.sum(F.octet_length(F.col(text_col)))).head()[0] or 0
    n_parts = max(partitions(spark), -(-counted // task_bytes))
    buckets = n_parts * 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    none64, nothing = (lambda n: pa.nulls(n, pa.int64())), (lambda n: pa.nulls(n, pa.binary()))
    first_names = ["chunk", "bucket", "ids", "sizes", "texts", "found", "local", "keyed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            size = np.concatenate(sizes)
            order = np.argsort(np.array([LAST if i is None else i for i in ids], np.int64), kind="stable")
            data, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])
            if (order[1:] < order[:-1]).any():
                data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order])
            size = size[order]
            offsets = np.concatenate([[0], np.cumsum(size)])
            own_ids = pa.array([ids[i] for i in order], pa.int64())
            found, anchors, content, twice = [], [], [], []
            at = 0
            while at < len(size):  # a few documents at a time bound the arrays
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
                seg, anchor, hashed, two = segments(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], length)
                seg["doc"] += at
                found.append(seg), anchors.append(anchor), content.append(hashed), twice.append(two)
                at = to
            seg, anchor, content_, two = np.concatenate(found), np.concatenate(anchors), np.concatenate(content), np.concatenate(twice)
            key = mix(content_ ^ mix(anchor))
            by = np.argsort(key, kind="stable")
            begin, reach = offsets[seg["doc"]] + seg["start"], seg["count"].astype(np.int64) - 1 + length
            again = np.zeros(len(seg), bool)
            again[by[1:]] = key[by[1:]] == key[by[:-1]]
            first = by[np.maximum.accumulate(np.where(again[by], 0, np.arange(len(by))))]
            raw = memoryview(data)
            for i, j in zip(by[again[by]].tolist(), first[again[by]].tolist()):  # equal keys, so equal texts but for a collision
                if raw[begin[i] : begin[i] + reach[i]] != raw[begin[j] : begin[j] + reach[j]]:
                    again[i] = False
            keyed = np.empty(int((~again).sum()) + int((two & ~again).sum()), KEYED)
            fresh = np.flatnonzero(~again)
            fresh = np.concatenate([fresh, np.flatnonzero(two & ~again)])  # counted twice: to be looked at in any case
            keyed["anchor"], keyed["segment"] = anchor[fresh], fresh.astype(np.uint32) | np.where(two[fresh], TWICE, np.uint32(0))
            bucket = (keyed["anchor"] >> np.uint64(20)) % np.uint64(buckets)
            order = np.lexsort((keyed["segment"], bucket))
            keyed, bucket = keyed[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keyed) else np.zeros(0, np.int64)
            local = np.empty(int(again.sum()), RUN)
            for c in RUN.names:
                local[c] = seg[c][again]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), none64(1), pa.array([own_ids.to_pylist()], pa.list_(pa.int64())), pa.array([size.astype("<i8").tobytes()]), pa.array([zstandard.compress(data.tobytes(), 3)]), pa.array([pack(seg)]), pa.array([pack(local)]), nothing(1)],
                names=first_names,
            )
            n = len(edge)
            blobs = [pack(keyed[a:b]) for a, b in zip(edge, np.append(edge[1:], len(keyed)))]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(bucket[edge].astype(np.int64)), pa.nulls(n, pa.list_(pa.int64())), *[nothing(n) for _ in range(4)], pa.array(blobs, pa.binary())], names=first_names)
            chunk += 1
            held = 0
            ids.clear(), parts.clear(), sizes.clear()

        for batch in text_batches(batches, 1 << 20):
            data, offsets = text_bytes(batch.column(1))
            ids.extend(batch.column(0).to_pylist())
            parts.append(data.copy())
            sizes.append(np.diff(offsets))
            held += len(data)
            if held >= chunk_bytes:
                yield from flush()
        if ids:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments whose anchor another one has too, by chunk."""
        keyed, chunks = [], []
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keyed.append(unpack(blob, KEYED))
                chunks.append(np.full(len(keyed[-1]), c))
        if not keyed:
            return
        every, chunk = np.concatenate(keyed), np.concatenate(chunks)
        keyed.clear(), chunks.clear()
        order = np.argsort(every["anchor"])
        anchor = every["anchor"][order]
        same = np.zeros(len(anchor), bool)
        same[1:] = anchor[1:] == anchor[:-1]
        same[:-1] |= same[1:].copy()
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        hot = np.repeat(np.diff(np.append(edge, len(anchor))) > hot_segments, np.diff(np.append(edge, len(anchor))))
        every["segment"][order[hot]] |= HOT
        wanted = order[same]
        every, chunk = every[wanted], chunk[wanted]
        order = np.lexsort((every["segment"], chunk))
        every, chunk = every[order], chunk[order]
        if len(every):
            fresh = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (every["segment"][1:] != every["segment"][:-1])])
            every, chunk = every[fresh], chunk[fresh]
        edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
        for a, b in zip(edge, np.append(edge[1:], len(chunk))):
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a])]), pa.array([pack(every[a:b])])], names=["chunk", "wanted"])

    # a shard's segments: chunk, its number, its age (id, chunk, number), windows and text
    shard_names = ["bucket", "chunk", "anchors", "segments", "ids", "counts", "texts"]

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, ids, sizes, texts, found, wanted = (batch.column(i)[r].as_py() for i in range(6))
                if not wanted:
                    continue
                want = np.concatenate([unpack(w, KEYED) for w in wanted])
                want = want[np.argsort(want["segment"] & ~(TWICE | HOT), kind="stable")]
                number, twice, hot = want["segment"] & ~(TWICE | HOT), want["segment"] & TWICE, want["segment"] & HOT > 0
                seg = unpack(found, SEGMENT)[number]
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
                data = np.frombuffer(zstandard.decompress(texts), np.uint8)
                id_of = np.array([LAST if i is None else i for i in ids], np.int64)
                begin, count, key, skip = offsets[seg["doc"]] + seg["start"], seg["count"].astype(np.int64), want["anchor"], np.zeros(len(want), np.int64)
                if hot.any():
                    own = np.flatnonzero(hot)
                    split = []
                    ends = np.cumsum(count[own] - 1 + length)
                    for at in np.split(own, np.unique(np.searchsorted(ends, np.arange(1 << 19, ends[-1], 1 << 19)))):  # some text at a time
                        if len(at):
                            which, *more = refined(*gathered(data, begin[at], count[at] - 1 + length), count[at], key[at], length)
                            split.append((at[which], *more))
                    which, shift, parts_, keys = (np.concatenate(x) for x in zip(*split))
                    cold = np.flatnonzero(~hot)
                    origin = np.concatenate([cold, which])
                    skip = np.concatenate([skip[cold], shift])
                    begin, count = begin[origin] + skip, np.concatenate([count[cold], parts_])
                    key, number, twice, seg = np.concatenate([key[cold], keys]), number[origin], twice[origin], seg[origin]
                bucket = (key >> np.uint64(20)) % np.uint64(buckets)
                reach = count - 1 + length
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
                for a, b in zip(edge, np.append(edge[1:], len(order))):
                    own = order[a:b]
                    text, _ = gathered(data, begin[own], reach[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[own[0]])]), pa.array([chunk]), pa.array([key[own].tobytes()]), pa.array([np.stack([number[own] | twice[own], skip[own].astype(np.uint32)]).tobytes()]), pa.array([zstandard.compress(id_of[seg["doc"][own]].tobytes(), 1)]), pa.array([count[own].astype("<u4").tobytes()]), pa.array([zstandard.compress(text.tobytes(), 3)])],
                        names=shard_names,
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk, the windows (segment number and offset in it) that an earlier one equals."""
        rows: list[tuple] = []
        for batch in batches:
            for r in range(batch.num_rows):
                _, chunk, anchors, numbers, ids, counts, texts = (batch.column(i)[r].as_py() for i in range(7))
                a = np.frombuffer(anchors, "<u8")
                rows.append((np.full(len(a), chunk), a, *np.frombuffer(numbers, "<u4").reshape(2, -1), np.frombuffer(zstandard.decompress(ids), "<i8"), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(zstandard.decompress(texts), np.uint8)))
        if not rows:
            return
        chunk, anchor, number, skip, id_, count, data = (np.concatenate(x) for x in zip(*rows))
        rows.clear()
        twice, number = number & TWICE > 0, number & ~TWICE
        reach = count - 1 + length
        begin = np.concatenate([[0], np.cumsum(reach)])[:-1]
        by = np.argsort(anchor, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]]))
        edge = np.append(edge, len(by))
        size = np.add.reduceat(reach[by], edge[:-1])
        total = np.concatenate([[0], np.cumsum(size)])
        gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(edge) - 1:
            to = max(at + 1, int(np.searchsorted(total, total[at] + shard_bytes, "right")) - 1)
            own = by[edge[at] : edge[to]]
            own = own[np.lexsort((skip[own], number[own], chunk[own], id_[own]))]  # by age
            seen: dict[bytes, int] = {}
            keep, again = [], []
            for i in own.tolist():
                text = data[begin[i] : begin[i] + reach[i]].tobytes()
                (again if text in seen else keep).append(i)
                seen.setdefault(text, i)
            if again:
                old = np.array(again)
                gone.append((chunk[old].repeat(count[old]), number[old].repeat(count[old]), np.arange(count[old].sum()) - np.repeat(np.cumsum(count[old]) - count[old] - skip[old], count[old])))
            # a segment alone with its anchor, which it holds once, has no window that occurs again
            kept = np.array(keep)
            _, group, alike = np.unique(anchor[kept], return_inverse=True, return_counts=True)
            kept = kept[(alike[group] > 1) | twice[kept]]
            if len(kept):
                shard = np.frombuffer(b"".join(data[begin[i] : begin[i] + reach[i]].tobytes() for i in kept.tolist()), np.uint8)
                place = np.concatenate([[0], np.cumsum(reach[kept])])
                hit = covered_windows(shard, place[:-1], count[kept], length)
                which = np.searchsorted(place, hit, "right") - 1
                gone.append((chunk[kept[which]], number[kept[which]], hit - place[which] + skip[kept[which]]))
            at = to
        if not gone:
            return
        c, s, o = (np.concatenate(x) for x in zip(*gone))
        order = np.lexsort((o, s, c))
        c, s, o = c[order], s[order], o[order]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        for a, b in zip(edge, np.append(edge[1:], len(c))):
            yield pa.RecordBatch.from_arrays([pa.array([int(c[a])]), pa.array([pack(runs(s[a:b], o[a:b]))])], names=["chunk", "gone"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, texts, found, local, gone = (batch.column(i)[r].as_py() for i in range(6))
                size = np.frombuffer(sizes, "<i8")
                offsets = np.concatenate([[0], np.cumsum(size)])
                data = np.frombuffer(zstandard.decompress(texts), np.uint8)
                seg = unpack(found, SEGMENT)
                change = np.zeros(len(data) + 1, np.int64)
                every = [unpack(local, RUN)]
                for blob in gone or []:
                    own = unpack(blob, RUN)  # here doc is the segment's number, start the offset in it
                    out = own.copy()
                    out["doc"], out["start"] = seg["doc"][own["doc"]], seg["start"][own["doc"]] + own["start"]
                    every.append(out)
                cut_ = np.concatenate(every)
                begin = offsets[cut_["doc"]] + cut_["start"]
                np.add.at(change, begin, 1)
                np.add.at(change, begin + cut_["count"] - 1 + length, -1)
                away = np.cumsum(change[:-1]) > 0
                heads = away.copy()
                heads[1:] &= ~away[:-1]
                inner = offsets[offsets < len(data)]
                heads[inner] = away[inner]
                removed = np.concatenate([[0], np.cumsum(away)])
                spans = np.concatenate([[0], np.cumsum(heads)])
                kept = data[~away]
                kept_at = offsets - removed[offsets]
                texts_kept = [kept[a:b].tobytes() for a, b in zip(kept_at, kept_at[1:])]
                columns = [pa.array(ids, pa.int64()), pa.array(size), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(t).hexdigest() for t in texts_kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns, names = [*columns, pa.array(texts_kept, pa.binary())], [*names, "kept"]
                if ids:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    cut_rows = rows.mapInArrow(cut, "chunk long, bucket long, ids array<long>, sizes binary, texts binary, found binary, local binary, keyed binary")
    stored = _bucketed(cut_rows, "chunk", min(n_parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))), "suffix_chunks")
    chunks = stored.filter("bucket is null")
    met = stored.filter("bucket is not null").select("chunk", "keyed", "bucket").repartition(n_parts, "bucket").select("chunk", "keyed").mapInArrow(meet, "chunk long, wanted binary")
    wanted = met.groupBy("chunk").agg(F.collect_list("wanted").alias("wanted"))
    asked = chunks.select("chunk", "ids", "sizes", "texts", "found").join(wanted.hint("shuffle_hash"), "chunk").select("chunk", "ids", "sizes", "texts", "found", "wanted")
    shipped = asked.mapInArrow(ship, "bucket long, chunk long, anchors binary, segments binary, ids binary, counts binary, texts binary")
    gone = materialise(shipped.repartition(n_parts, "bucket").mapInArrow(search, "chunk long, gone binary"), "suffix-gone")
    by_chunk = gone.groupBy("chunk").agg(F.collect_list("gone").alias("gone"))
    whole = chunks.join(by_chunk.hint("shuffle_hash"), "chunk", "left").select("ids", "sizes", "texts", "found", "local", "gone")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
