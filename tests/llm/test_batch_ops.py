"""Token counts, GIF, quality, BPE and packing against their libraries, round trips and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provark.llm import byte_bpe, gif_media, packing, quality, token_counts

DOC = "doc_id long, text string"
ODD = [(1, "plain words and more"), (2, None), (3, ""), (4, "  two  spaces \n\n lines "), (5, "日本語 𝔘 é̂ Σ ΑΣ İ"), (6, "a" * 5000), (7, "it's 12,345.67 naïve—dash"), (7, "same id"), (None, "no id"), (8, "\x00\x01 control")]


def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)


def keyed(df, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in df.collect()), key=str)


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = [(sp.id_to_piece(i), float(sp.get_score(i)) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) else 0.0) for i in range(sp.get_piece_size())]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    want = sorted(((i, len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in ODD), key=str)
    assert keyed(token_counts.token_counts(odd(spark)), "n_tokens") == want
    assert token_counts.token_counts(odd(spark).filter("false")).count() == 0


def test_viterbi_on_random_vocabularies():
    from tokenizers import Tokenizer, models

    rnd = random.Random(7)
    for _ in range(60):
        pieces = {"".join(rnd.choice("ab▁") for _ in range(rnd.randrange(1, 5))) for _ in range(8)}
        scores = [(p, float(-rnd.randrange(6))) for p in sorted(pieces)]
        own = token_counts.UnigramCounter(scores)
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *scores], 0, False))
        for _ in range(20):
            t = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 12)))
            if all(c in "".join(pieces) for c in "▁" + t.replace(" ", "▁")) and all(c in pieces for c in "▁" + t.replace(" ", "▁")):
                tokens = library.encode("▁" + t.replace(" ", "▁")).tokens
                assert own.count(t) == (len(tokens), sum(dict(scores)[x] for x in tokens)), (scores, t)


@pytest.mark.parametrize("kind", ["random", "run", "text"])
def test_gif_round_trip(kind):
    rnd = random.Random(3)
    for n in (64, 128, 4096, 70_016, 200_000 // 64 * 64):
        data = bytes(rnd.randrange(256) for _ in range(n)) if kind == "random" else b"A" * n if kind == "run" else bytes(rnd.choice(b"the cat ") for _ in range(n))
        _, _, frames = gif_media.read_gif(gif_media.write_gif(data, rows=512))
        assert b"".join(f.samples for f in frames) == data


def gif(frames, width=2, height=2, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff"):
    """A GIF with a palette of four colours; frames: (left, top, w, h, samples, delay, disposal, transparent)."""
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette
    for left, top, w, h, samples, delay, disposal, clear in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02" + gif_media._blocks(gif_media.lzw_encode(samples, 2))
    return out + b"\x3b"


def test_disposal_transparency_and_timing(spark):
    data = gif([(0, 0, 2, 2, b"\1\1\1\1", 5, 1, None), (0, 0, 1, 1, b"\2", 7, 3, None), (1, 1, 1, 1, b"\3", 2, 2, None), (0, 0, 2, 1, b"\0\2", 1, 1, 0)])
    _, _, frames = gif_media.read_gif(data)
    colour = lambda f: [tuple(int(v) for v in p) for p in f.canvas.reshape(-1, 4)]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert colour(frames[0]) == [red] * 4
    assert colour(frames[1]) == [green, red, red, red]
    assert colour(frames[2]) == [red, red, red, blue]  # the frame before was taken back
    assert colour(frames[3]) == [red, green, red, none]  # the frame before was cleared, colour 0 is clear
    assert [f.start_cs for f in frames] == [0, 5, 12, 14]
    size = lambda d, w, h: d[:6] + w.to_bytes(2, "little") + h.to_bytes(2, "little") + d[10:]
    code = data.index(b"\x2c") + 10  # the first image's least code size
    bad = [b"GIF89a broken", size(data, 65535, 65535), data[:code] + b"\x0b" + data[code + 1 :], data[:20], data[: code + 3] + b"\xff" * 40]
    media = spark.createDataFrame([(1, bytearray(data)), (2, None), *[(3 + i, bytearray(b)) for i, b in enumerate(bad)]], "doc_id long, gif binary")
    rows = gif_media.gif_frames(media).orderBy("frame").collect()
    assert [(r.id, r.start_cs, r.transparent_px) for r in rows] == [(1, 0, 0), (1, 5, 0), (1, 12, 0), (1, 14, 1)]
    assert rows[0].red == [0, 0, 0, 0, 0, 0, 0, 4]


def plain_decode(data):
    """Samples of a GIF without local palettes, code by code and bit by bit."""
    at, out = 13 + 3 * 2 ** ((data[10] & 7) + 1), b""
    while data[at] != 0x3B:
        image = data[at] == 0x2C
        at += 10 if image else 2
        least, at = (data[at], at + 1) if image else (0, at)
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if not image:
            continue
        bits = "".join(f"{b:08b}"[::-1] for b in body)
        width, place, last, words = least + 1, 0, None, {}
        while True:
            code = int(bits[place : place + width][::-1], 2)
            place += width
            if code == 1 << least:
                words, width, last = {i: bytes([i]) for i in range(1 << least)}, least + 1, None
                continue
            if code == (1 << least) + 1:
                break
            word = words[code] if code in words else last + last[:1]
            if last is not None and len(words) < 4094:
                words[len(words) + 2] = last + word[:1]
            out, last = out + word, word
            if len(words) + 2 >= 1 << width and width < 12:
                width += 1
    return out


def test_text_gifs(spark):
    rows = gif_media.text_gifs(odd(spark)).collect()
    texts = sorted(((i, (t or "").encode()) for i, t in ODD), key=str)
    assert len(rows) == len(ODD)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str)
    padded = [(i, b, b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))) for i, b in texts]
    assert got == sorted(((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, b, p in padded), key=str)
    assert all(plain_decode(bytes(r.gif)) == next(p for i, b, p in padded if (i, len(b)) == (r.doc_id, r.n_bytes)) for r in rows if r.n_bytes < 20_000)
    assert all(sum(f.red) == sum(f.blue) == r.payload_bytes and r.feature.endswith("/".join(map(str, f.red))) for r in rows for f in r.frames if len(r.frames) == 1)
    assert all([f.start_cs for f in r.frames] == list(range(0, 10 * r.n_frames, 10)) for r in rows)
    assert all(hashlib.sha256(r.gif).hexdigest() == r.media_sha256 and len(r.gif) == r.media_bytes for r in rows)
    assert gif_media.text_gifs(odd(spark).filter("false")).count() == 0


def rated(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        grade = rnd.randrange(3)
        text = [rnd.choice(words) for _ in range(40)]
        if grade == 0:
            text += [rnd.choice(["awful", "nasty", "vile"]) for _ in range(3)]
        elif grade == 1:
            text = [w + "%%%" if rnd.random() < 0.8 else w for w in text]
        rows.append((i, " ".join(text), grade))
    return rows


def test_quality_on_held_out_ratings(spark):
    rows = rated(1600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOC)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 1000], "doc_id long, grade int")
    model = quality.train(docs, ratings)
    assert np.all(np.diff(model.cuts) > 0)
    got = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    held = [(got[i], g) for i, _, g in rows if i >= 1000]
    kept = [(r.tail_prob >= quality.LEAST_TAIL) == (g == 2) for r, g in held]
    assert np.mean(kept) > 0.95
    assert np.corrcoef([r.expected_grade for r, _ in held], [g for _, g in held])[0, 1] > 0.8
    again = quality.train(docs.repartition(5), ratings)
    assert np.array_equal(again.weights, model.weights)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.graded(labels).collect()} == {1: 1, 3: 0}
    model = quality.train(odd(spark), quality.graded(labels).filter("false"))
    assert {r.score for r in quality.rate(odd(spark), model).collect()} == {0.0}
    assert quality.select(odd(spark), model).columns == odd(spark).columns
    assert quality.rate(odd(spark).filter("false"), model).count() == 0


def test_bpe_matches_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.coder("byte_bpe_multi_50k.tiktoken").ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd(spark)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, len(e := library.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in ODD), key=str)
    assert keyed(byte_bpe.byte_bpe(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want
    for r in byte_bpe.byte_bpe(docs).collect():
        assert library.decode_bytes(r.ids) == bytes(r.decoded)


def test_recursion_and_heap_agree():
    own = byte_bpe.coder("byte_bpe_multi_50k.tiktoken")
    rnd = random.Random(9)
    pieces = [bytes(rnd.choice(b"aeinrst \xc3\xa9") for _ in range(rnd.randrange(1, 40))) for _ in range(500)]
    pieces += [bytes(rnd.choice(letters) for _ in range(n)) for n in (200, 256, 257, 700, 1500) for letters in (b"a", b"ab", b"aeinrst", bytes(range(256)))]
    pieces += [b"", *pieces[:5]]
    heap = [[own.ranks[p]] if p in own.ranks else own._by_heap(p) for p in pieces]
    for least in (0, 256, 2000):  # all by the heap, as in production, all by the recursion
        own.long_bytes, before = least, own.long_bytes
        try:
            tokens, offsets = own.encode(pieces)
        finally:
            own.long_bytes = before
        assert [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == heap
    assert own.decode(tokens, offsets) == pieces


def test_long_pieces_as_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.coder("byte_bpe_multi_50k.tiktoken").ranks
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (1, 30, 255, 256, 257, 1000, 5000) for letters in ("a", "abcdefgh", "\u00e9\u4e2d\U0001f600")]
    rows = byte_bpe.byte_bpe(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    assert {r.doc_id: r.ids for r in rows} == dict(enumerate(map(library.encode_ordinary, texts)))
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("length", [16, 4096])
def test_packing(spark, length):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = {}
    for i, t in ODD:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(odd(spark), length=length).orderBy("sequence_id", "offset").collect()
    at = 0
    for p in pieces:  # gapless from 0, cut at multiples of the length
        assert p.sequence_id * length + p.offset == at and p.length == len(p.ids) > 0 and p.offset + p.length <= length
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        at += p.length
    assert at == sum(len(x) for v in want.values() for x in v)
    docs = {}
    for p in pieces:
        if p.start == 0:
            docs.setdefault(p.doc_id, []).append([])
        docs[p.doc_id][-1] += p.ids
        assert p.boundary == (p.start + p.length < p.doc_tokens)
    assert {k: sorted(v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(odd(spark).filter("false")).count() == 0


def test_word_tokenizer_is_the_plain_library():
    """Underscores beside other punctuation are one pre-token; literals of special tokens keep the library's default."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(10)
    parts = [*"ab_Z9 \t\n.,-()'<|>{}/é", "__init__(self)", "'s", "_'s", "'ll_", "</w>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["__init__(self)", "x_, y", "(_a)", "-_-", "a_-b", "a <|endoftext|>b_"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(4000)]
    texts += ["".join(chr(rnd.randrange(32, 127)) for _ in range(rnd.randrange(1, 40))) for _ in range(4000)]
    got = packing.WordTokenizer("word_bpe_49k.json").encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
