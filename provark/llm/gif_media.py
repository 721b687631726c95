"""Media columns: GIF files written, read back and turned into timed frames with histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provark.llm.common import text_batches, texts_of

UNIT, TABLE = 64, 4096
#: Canvases and images of more pixels are refused: a header of a few bytes may claim four billion.
MOST_PIXELS = 1 << 26


@dataclass
class Frame:
    """One image: its own samples, and the canvas as shown while it lasts (RGBA, H x W x 4)."""

    samples: bytes
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    start_cs: int
    canvas: np.ndarray | None


def _widths(bits: int, n: int = TABLE + 2) -> np.ndarray:
    """Width of the k-th code after a clear: the reader's table then holds 2 ** bits + 1 + k entries."""
    held = (1 << bits) + 1 + np.arange(n)
    return np.minimum(np.floor(np.log2(held)).astype(np.int64) + 1, 12)


WIDTHS = {bits: _widths(bits) for bits in range(2, 9)}
STARTS = {bits: np.concatenate([[0], np.cumsum(w)]) for bits, w in WIDTHS.items()}


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    """Codes as bits, least significant first; the first is a clear, and a table is never kept when full."""
    values = np.asarray(codes, np.int64)
    at = np.flatnonzero(values == 1 << bits)
    order = np.arange(len(values))
    since = order - at[np.maximum(np.searchsorted(at, order, "left") - 1, 0)] - 1
    widths = WIDTHS[bits][np.maximum(since, 0)]
    widths[0] = bits + 1
    ends = np.cumsum(widths)
    starts = ends - widths
    byte, moved = starts >> 3, values << (starts & 7)
    size = int(ends[-1] + 7) // 8
    out = sum(np.bincount(byte + k, moved >> 8 * k & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


_SEEN: list[int] = []


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """Greedy longest matches; a full table is cleared. The table is one flat list, kept between calls."""
    if not _SEEN:
        _SEEN.extend([0] * (TABLE << 8))
    table, used = _SEEN, []
    clear, stop = 1 << bits, (1 << bits) + 1
    codes = [clear]
    put, note = codes.append, used.append
    size = stop + 1
    prefix = samples[0] if samples else None
    for b in samples[1:]:
        key = prefix << 8 | b
        code = table[key]
        if code:
            prefix = code
            continue
        put(prefix)
        if size < TABLE:
            table[key] = size
            note(key)
            size += 1
        else:
            put(clear)
            for k in used:
                table[k] = 0
            used.clear()
            size = stop + 1
        prefix = b
    for k in used:
        table[k] = 0
    if prefix is not None:
        put(prefix)
    put(stop)
    return pack_codes(codes, bits)


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """Samples of a code stream; ends at the stop code, at `limit` samples or where the data end.

    Between clears a code's width follows from its number alone, so a stretch of codes is unpacked at once."""
    clear, stop = 1 << bits, (1 << bits) + 1
    octets = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at = 8 * len(data), 0
    widths, starts = WIDTHS[bits], STARTS[bits]
    root = [bytes((i,)) for i in range(clear)] + [b"", b""]
    pieces: list[bytes] = []
    made = 0
    while made < limit:
        full = 0
        table = root[:]
        last = None
        while True:  # a table that stays full goes on with codes of 12 bits
            first = full
            own = starts[:-1] if not first else 12 * np.arange(len(widths))
            wide = widths if not first else np.full(len(widths), 12)
            n = int(np.searchsorted(own + wide, total - at, "right"))
            if not n:
                return b"".join(pieces)[:limit]
            place = at + own[:n]
            byte = place >> 3
            codes = (octets[byte] | octets[byte + 1] << 8 | octets[byte + 2] << 16) >> (place & 7) & ((1 << wide[:n]) - 1)
            ends = np.flatnonzero((codes == clear) | (codes == stop))
            m = int(ends[0]) if len(ends) else n
            for code in codes[:m].tolist():
                if last is None:
                    word = table[code]
                else:
                    if code < len(table):
                        word = table[code]
                    elif code == len(table) < TABLE:
                        word = last + last[:1]
                    else:
                        raise ValueError("a code beyond the table")
                    if len(table) < TABLE:
                        table.append(last + word[:1])
                pieces.append(word)
                made += len(word)
                last = word
            if len(ends):
                at += int(own[m] + wide[m])
                if codes[m] == stop:
                    return b"".join(pieces)[:limit]
                break
            at += int(own[n - 1] + wide[n - 1])
            if made >= limit:
                break
            full += n
    return b"".join(pieces)[:limit]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(samples: bytes, width: int = UNIT, rows: int = 1024, delay_cs: int = 10) -> bytes:
    """A GIF89a with frames of up to `rows` full rows: grey palette, no transparency, each left in place."""
    lines = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0), GREY]
    for at in range(0, lines, rows):
        part = samples[at * width : (at + rows) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _interlaced(height: int) -> list[int]:
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and all frames of `frames_of`, held together."""
    frames = list(frames_of(data))
    return *struct.unpack("<HH", data[6:10]), frames


def frames_of(data: bytes) -> Iterator[Frame]:
    """Frames one by one, each with its canvas. Palettes, interlacing, transparency and disposal (keep,
    background, previous) apply. A broken file raises ValueError, struct.error or LookupError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("too large a canvas")
    at = 13
    palette = b""
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + n], at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent, clock = 0, 0, None, 0

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                mode, delay, clear = struct.unpack("<BHB", body[:4])
                disposal, transparent = mode >> 2 & 7, clear if mode & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            own = palette
            if local & 0x80:
                n = 3 << ((local & 7) + 1)
                own, at = data[at : at + n], at + n
            bits = data[at]
            if bits not in WIDTHS or w * h > MOST_PIXELS:
                raise ValueError("a code size beyond 2 to 8, or too large an image")
            body, at = sub_blocks(at + 1)
            samples = lzw_decode(body, bits, w * h)
            if local & 0x40:
                rows = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
                straight = np.empty_like(rows)
                straight[_interlaced(h)] = rows
                samples = straight.tobytes()
            before = canvas.copy() if disposal == 3 else None
            index = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)[: max(0, height - top), : max(0, width - left)]
            colours = np.zeros((256, 4), np.uint8)
            rgb = np.frombuffer(own, np.uint8).reshape(-1, 3)
            colours[: len(rgb), :3], colours[: len(rgb), 3] = rgb, 255
            area = canvas[top : top + h, left : left + w]
            drawn = colours[index]
            if transparent is None:
                area[:] = drawn
            else:
                seen = index != transparent
                area[seen] = drawn[seen]
            yield Frame(samples, left, top, w, h, delay, disposal, transparent, clock, canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas[:] = before
            clock += delay
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")


def histogram(values: np.ndarray, bins: int = 8) -> list[int]:
    return np.bincount(values.reshape(-1), minlength=256).reshape(bins, -1).sum(1).tolist()


FRAME = pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("red", "green", "blue")], ("transparent_px", pa.int64())])
FRAME_SQL = "start_cs long, delay_cs long, red array<long>, green array<long>, blue array<long>, transparent_px long"


def shown(frame: Frame) -> dict:
    """A timed frame's columns: when it starts and how long it lasts, 8-bin histograms of the opaque pixels shown."""
    opaque = frame.canvas[..., 3] > 0
    own = frame.canvas if opaque.all() else frame.canvas[opaque]
    return {"start_cs": frame.start_cs, "delay_cs": frame.delay_cs, "red": histogram(own[..., 0]), "green": histogram(own[..., 1]), "blue": histogram(own[..., 2]), "transparent_px": int(opaque.size - opaque.sum())}


def gif_frames(media: DataFrame, id_col: str = "doc_id", gif_col: str = "gif") -> DataFrame:
    """One row a frame of stored GIFs: id, frame, start_cs, delay_cs, width, height, red, green, blue (8-bin
    histograms of the opaque pixels shown) and transparent_px. Null or broken files, and those of over
    MOST_PIXELS pixels, give no rows."""
    schema = pa.schema([("id", pa.int64()), ("frame", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), *FRAME])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            for i, gif in enumerate(batch.column(1).to_pylist()):
                try:
                    rows = [{"id": batch.column(0)[i].as_py(), "frame": k, "width": f.canvas.shape[1], "height": f.canvas.shape[0]} | shown(f) for k, f in enumerate(frames_of(gif or b""))]
                except (ValueError, struct.error, LookupError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = media.select(media[id_col].cast("long").alias("id"), media[gif_col].alias("gif"))
    return rows.mapInArrow(run, f"id long, frame long, width long, height long, {FRAME_SQL}")


def text_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_frames, duration_cs, frames (timed, each with its colour histograms: `shown`) and,
    with `keep_media`, the stored gif.

    The payload is the UTF-8 text with bytes 0 up to a positive multiple of 64, one 8-bit sample a byte in
    rows of 64. The stored bytes are read back frame by frame, through palette, transparency and disposal. feature:
    frames, duration and the sum of the shown frames' 8-bin red histograms (the palette is grey). Null text counts as empty; equal texts give equal values; null ids come
    back null, rows with the same id stay apart, other columns are ignored. A narrow map."""

    def one(text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        payload = raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))
        gif = write_gif(payload)
        parts, timed = [], []
        for frame in frames_of(gif):
            parts.append(frame.samples)
            timed.append(shown(frame))
        back = b"".join(parts)
        counts, lasts = [sum(c) for c in zip(*[f["red"] for f in timed])], sum(f["delay_cs"] for f in timed)
        feature = f"frames={len(timed)};cs={lasts};grey={'/'.join(map(str, counts))}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, len(timed), lasts, timed, gif

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_cs", "frames"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(FRAME)]
    if keep_media:
        names, types = [*names, "gif"], [*types, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            rows = [one(t)[: len(names)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_cs long, frames array<struct<start_cs:bigint,delay_cs:bigint,red:array<bigint>,green:array<bigint>,blue:array<bigint>,transparent_px:bigint>>"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, schema + (", gif binary" if keep_media else ""))
