"""Dominance counts, decontamination and vector codes against brute force."""

import hashlib
import random
import re
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from provark.llm import decontaminate, dominance, vector_codes
from provark.llm.wavelet import prefix_greater
from provark.llm.wu_manber import tables

SALE = "sale_id long, total double, sold_at timestamp_ntz, slot string, n_above int"


def test_wavelet_prefixes_match_counting():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 64, 500):
        ranks, weights = rng.integers(0, max(1, n // 2), n), rng.integers(0, 9, n)
        ends, bounds = rng.integers(0, n + 1, 40), rng.integers(0, n + 3, 40)
        counts, sums = prefix_greater(ranks, weights, ends, bounds)
        for k in range(40):
            hit = ranks[: ends[k]] > bounds[k]
            assert (counts[k], sums[k]) == (hit.sum(), weights[: ends[k]][hit].sum())


@pytest.mark.parametrize("kind", ["mixed", "one slot", "one level", "copies"])
def test_dominance_matches_brute_force(spark, kind):
    rnd = random.Random(kind)
    rows = []
    for i in range(3000):
        slot = 7 if kind == "one slot" and i % 3 else rnd.randrange(200)
        level = 5 if kind == "one level" and i % 3 else rnd.randrange(100)
        rows.append((i, 7, 9, 2) if kind == "copies" and i % 3 else (i, slot, level, rnd.randrange(1, 6)))
    rows += [(None, None, 3, 1), (4, 3, None, 1), (5, None, None, 1), (None, 3, 2, 1)]
    df = spark.createDataFrame(rows, "key long, slot long, level long, weight long").withColumn("shard", F.lit("clash")).repartition(5)
    col = F.col
    found = dominance.dominance(df, "key", col("slot"), col("level"), col("weight"), most=400).collect()
    valid = np.array([r[1:] for r in rows if None not in r[1:]])
    want = []
    for key, slot, level, _ in rows:
        if slot is None or level is None:
            want.append((key, slot, level, None, None))
        else:
            hit = (valid[:, 0] < slot) & (valid[:, 1] > level)
            want.append((key, slot, level, int(hit.sum()), int(valid[hit, 2].sum())))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))


def test_sales_in_any_zone(spark):
    t = datetime(2024, 3, 10, 2, 30, 59)
    rows = [(1, 5.0, t, "x", 1), (2, 4.994, datetime(2024, 3, 10, 2, 31), "x", 1), (3, None, t, "x", 1), (4, 1.0, None, "x", 1), (5, float("nan"), t, "x", 1), (None, 0.5, datetime(2024, 3, 10, 3, 0), "x", 1), (6, float("inf"), t, "x", 1), (7, -0.005, datetime(1969, 12, 31, 23, 59, 59), "x", 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = {r["sale_id"]: r for r in dominance.sales_above(spark.createDataFrame(rows, SALE)).collect()}
        assert dominance.sales_above(spark.createDataFrame([], SALE)).collect() == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    w = lambda i: 1 + zlib.crc32(str(i).encode()) % 5
    assert (found[1]["slot"], found[1]["level"], found[1]["n_sales"]) == (int((t - datetime(1970, 1, 1)).total_seconds()) // 60, 500, 0)
    assert (found[2]["n_sales"], found[2]["n_rows"], found[None]["n_sales"], found[None]["n_rows"]) == (1, w(1), 2, w(1) + w(2))
    assert [found[i]["n_sales"] for i in (3, 4, 5, 6)] == [None] * 4 and found[5]["level"] is None
    assert (found[7]["slot"], found[7]["level"]) == (-1, 0)


def test_wu_manber_finds_every_string():
    rnd = random.Random(11)
    for round_ in range(60):
        letters = "ab " if round_ % 2 else "abcdefgh "
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 300, 5000])))
        found = {text[a : a + n] for a, n in ((rnd.randrange(len(text)), rnd.choice([1, 2, 3, 8, 9, 20, 40, 90])) for _ in range(12)) if a + n <= len(text)}
        strings = sorted(found | {"zz", "a" * 30})
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        sizes = np.array([len(x) for x in strings])
        got = set()
        for t in tables(data, np.cumsum(sizes) - sizes, sizes):
            at, number = t.search(np.frombuffer(text.encode(), np.uint8), most=50)
            got |= set(zip(at.tolist(), number.tolist(), strict=True))
        assert got == {(m.start(), k) for k, x in enumerate(strings) for m in re.finditer(f"(?={re.escape(x)})", text)}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = ["a", "bb", "naïve", "日本", "x1", "the", "of", "Stop", "zz9"]
    item = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, item(rnd.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(99, "of"), (12, None), (13, "--"), (None, item(14)), (3, item(25)), (14, "x " * 9 + "x")]
    items.append((15, items[0][1].upper()))
    docs = [(1, None), (2, ""), (2, "!!! -- ?"), (None, "no item here at"), (3, "x " * 40)]
    for i in range(60):
        parts = [item(rnd.randrange(8)) if rnd.random() < 0.6 else rnd.choice(items)[1] or "" for _ in range(rnd.randrange(1, 7))]
        docs.append((i, rnd.choice(["  ", "\n", ", ", "--"]).join(parts)))
    docs += [(100, "word " * 30_000 + items[4][1] + ", " + items[5][1]), (101, items[4][1][:-1])]
    windows = set()
    for i, text in items:
        w = words_of(text)
        n = min(10, len(w))
        windows |= {(tuple(w[k : k + n]), i) for k in range(len(w) - n + 1) if n}
    want = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x, _ in windows}:
            own = {}
            for k in range(len(w) - n + 1):
                own.setdefault(tuple(w[k : k + n]), []).append(k)
            for x, i in windows:
                for k in own.get(x, ()):
                    hit |= set(range(k, k + n))
                    found |= {str(i)} - {"None"}
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("items", F.lit("x")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = [tuple(r) for r in decontaminate.decontamination(d, b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    wide = decontaminate.contaminated(d, b, block_bytes=120)  # several passes give the same
    keep = lambda rows: sorted(str((r["doc_id"], r["n_words"], r["spans"], r["items"])) for r in rows.collect())
    assert keep(wide) == keep(decontaminate.contaminated(d, b))
    none = decontaminate.decontamination(d, b.filter("false")).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert decontaminate.decontamination(d.filter("false"), b).collect() == []


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every distance, every round."""
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    wide = len(kept[0][2]) // parts
    cut = lambda v, p: tuple(v[p * wide : (p + 1) * wide])
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for r in kept:
                members.setdefault(near(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j], strict=True)) if j in members else e for j, e in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sums[lab], sha) for i, lab, c, e in out]


@pytest.mark.parametrize("n", [5, 400])
def test_vector_codes_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 32) / (256 if i % 3 else 20)], int(i % 4) if i % 5 else None) for i in range(n)]
    rows += [(3, list(rows[3][1]), 9), (None, list(rows[2][1]), None), (7001, None, 1), (7002, [None, *rows[1][1][1:]], 1), (7003, [float("nan"), *rows[1][1][1:]], 1), (7004, [float("-inf"), *rows[1][1][1:]], 1), (7005, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = [tuple(r) for r in vector_codes.coded_embeddings(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_codes(rows)))
    assert vector_codes.coded_embeddings(df.filter("false")).collect() == []


def test_bounds_prune_and_hold(monkeypatch):
    """Shifted bounds stay below the true distances, and most entries are not compared."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 100, (300, 2, 4))).astype(np.int64)
    first = vector_codes.Codebooks(x[:64].transpose(1, 0, 2).copy())
    code, squares, low = first.assign(x, None, None, None)
    new = first.entries + rng.integers(-2, 3, first.entries.shape)
    gap = (new - first.entries).astype(float)
    second = vector_codes.Codebooks(new, np.sqrt((gap * gap).sum(-1)) * (1 + 1e-9))
    code2, squares2, low2 = second.assign(x, code, np.sqrt(squares), low)
    true = ((x[:, :, None, :] - new[None]) ** 2).sum(-1)
    assert (code2 == true.argmin(2)).all() and (squares2 == true.min(2)).all() and (low2 <= np.sqrt(true)).all()
    assert (low2 < np.sqrt(true) * (1 - 1e-6)).mean() > 0.5
