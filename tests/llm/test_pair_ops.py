"""Suffix-array dedup and the n-gram join against brute force; the pipeline against its stages."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provark.llm import ngram_join, suffix_dedup
from provark.llm.suffix_array import permuted_lcp, suffix_array

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def test_suffix_arrays_and_common_prefixes():
    rnd = random.Random(5)
    for trial in range(300):
        n, k = rnd.choice([1, 2, 3, 8, 30, 200]), rnd.choice([1, 2, 3, 256])
        b = bytes(rnd.randrange(k) for _ in range(n))
        b = (b[: max(1, n // 5)] * 7)[:n] if trial % 3 == 0 else b
        n = len(b)
        text = np.frombuffer(b, np.uint8)
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        plcp = permuted_lcp(text, sa)
        for x, y in zip(sa, sa[1:]):
            m = next((j for j in range(n - max(x, y)) if b[x + j] != b[y + j]), n - max(x, y))
            assert plcp[y] == m
    assert len(suffix_array(np.zeros(0, np.uint8))) == 0


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        away = bytearray(len(b))
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                away[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, gone in zip(b, away) if not gone)
        out[i] = (len(b), sum(away), sum(1 for a in range(len(b)) if away[a] and (a == 0 or not away[a - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefg hij") for _ in range(3000))
    return [(5, base[:500]), (2, base[100:700]), (9, None), (8, ""), (7, "a" * 5000), (1, "ab" * 300), (4, base[:150] + "zz" + base[:150] + base[50:240]), (6, base), (3, "é" * 400), (10, base[1000:1100]), (11, base[1000:1099]), (12, ("xyz123" * 20)[:110] * 3), (None, base[200:400]), (13, base[:500])]


@pytest.mark.parametrize("parts, options", [(1, {}), (4, {"chunk_bytes": 300, "shard_bytes": 500}), (3, {"chunk_bytes": 300, "hot_segments": 1, "task_bytes": 1000})])
def test_suffix_dedup(spark, parts, options):
    docs = spark.createDataFrame(passages(), DOC).withColumn("chunk", F.lit("clash")).withColumn("n_bytes", F.lit(1)).repartition(parts)
    rows = suffix_dedup.suffix_dedup(docs, keep_text=True, **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_suffix(passages())
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert suffix_dedup.suffix_dedup(docs.filter("false")).count() == 0


def test_suffix_dedup_with_hot_passages_and_repeated_rows(spark):
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abcdefg hij") for _ in range(180))
    texts = ["".join(rnd.choice("klmno pq") for _ in range(rnd.randrange(60))) + shared[rnd.randrange(70) :] + "".join(rnd.choice("klmno pq") for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts + texts[:20] + ["a" * 400, "ab" * 200, "a" * 300]))
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    for options in ({"hot_segments": 4}, {"hot_segments": 4, "chunk_bytes": 2000, "shard_bytes": 2000}, {}):
        got = suffix_dedup.suffix_dedup(docs, **options).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffix(rows), options
    same = spark.createDataFrame([(1, texts[0])] * 3 + [(None, texts[0])] * 2, DOC)  # a row repeated: the first stored one keeps its text
    assert sorted(r.n_removed for r in suffix_dedup.suffix_dedup(same).collect()) == [0] + [len(texts[0])] * 4


def brute_join(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        both = collections.Counter(j for s in sets[i] for j in inverted[s])
        for s in sets[i]:
            inverted[s].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(words) for _ in range(30)]
    bases = [[rnd.choice(words) for _ in range(rnd.randrange(1, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = rnd.choice(words).upper()
        if rnd.random() < 0.3:
            text += passage
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "x " * 5000)]


@pytest.mark.parametrize("k, percent, block", [(3, 90, 256), (5, 80, 4), (2, 50, 10)])
def test_ngram_components(spark, k, percent, block):
    rows = near_copies(k, 250)
    docs = spark.createDataFrame(rows, DOC).withColumn("node", F.lit("clash")).withColumn("root", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, k=k, percent=percent, block=block).collect()}
    assert got == brute_join(rows, k, percent)
    assert ngram_join.ngram_components(docs.filter("false"), k=k, percent=percent).count() == 0


def chained(n_groups, width=30):
    """Groups of near copies of which the next shares a third of its words: one candidate component of many labels."""
    words = [f"c{i}" for i in range((n_groups + 3) * 10)]
    rows = []
    for g in range(n_groups):
        base = words[g * 10 : g * 10 + width]
        for c in range(9):
            rows.append((len(rows), " ".join(base + [f"end{(g + c) % 4}"] * (c % 3 == 0))))
    return rows


@pytest.mark.parametrize("block, shingles", [(8, 1 << 20), (16, 200), (256, 60)])
def test_labels_of_other_blocks_meet_by_prefix_keys(spark, block, shingles):
    rows = chained(40) + [(1000 + i, t.upper()) for i, t in near_copies(11, 120)[:120]]
    docs = spark.createDataFrame(rows, DOC).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, k=3, percent=60, block=block, block_shingles=shingles).collect()}
    assert got == brute_join(rows, 3, 60)


def test_words_that_a_sum_of_powers_cannot_tell_apart(spark):
    words = ["a", "b"]
    for _ in range(10):
        words = [words[0] + words[1], words[1] + words[0]]
    rows = [(1, words[0]), (2, words[1]), (3, f"{words[0]} {words[1]} x"), (4, f"{words[1]} {words[0]} x"), (5, words[0].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


def test_word_hashes_and_exact_sets():
    from provark.llm.hashing import word_hashes

    rnd = random.Random(6)
    words = {bytes(rnd.choice(b"ab\0\xff") for _ in range(rnd.randrange(0, 30))) for _ in range(3000)} | {b"q" * 70_000, b"q" * 70_001, b"\0", b"\0\0"}
    words = sorted(words)
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert len(set(word_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(words)
    lists = [[rnd.choice([b"x", b"y", b"z"]) for _ in range(rnd.randrange(0, 9))] for _ in range(200)]
    for k in (1, 2, 3, 5):
        sets = ngram_join.exact_sets(lists, k)
        want = [{tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set() for w in lists]
        assert [len(s) for s in sets] == [len(s) for s in want]
        for i in range(0, 200, 7):
            for j in range(200):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_merge_skip():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randrange(0, 25))) for _ in range(rnd.randrange(1, 9))]
        times = collections.Counter(v for x in lists for v in x)
        for need in (1, 2, 4, 9):
            assert list(ngram_join.merge_skip(lists, need)) == sorted((v, n) for v, n in times.items() if n >= need)


def test_divide_skip_on_random_sets():
    rnd = random.Random(2)
    for percent in (50, 80, 90):
        sets = [np.array(sorted(rnd.sample(range(12), rnd.randrange(0, 10))), np.uint64) for _ in range(60)]
        got = ngram_join.divide_skip(sets, percent)
        root = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    both = len(np.intersect1d(a, b))
                    if len(a) and 100 * both >= percent * (len(a) + len(b) - both):
                        root[i] = root[j] = min(root[i], root[j])
        groups = lambda x: {frozenset(i for i in range(len(x)) if x[i] == g) for g in set(x)}
        assert groups(list(got)) == groups(root)


def test_prefix_keys_never_lose_a_pair():
    rnd = random.Random(8)
    universe = np.array(sorted(rnd.sample(range(1 << 40), 4000)), np.uint64)
    levels = np.array([rnd.randrange(4) for _ in range(1 << 10)], np.uint8)
    for percent in (80, 90):
        signer = ngram_join.Prefixes(percent, levels)
        for _ in range(400):
            n = rnd.randrange(1, 120)
            a = set(rnd.sample(range(len(universe)), n))
            b = set(a)
            for _ in range(rnd.randrange(0, max(1, n // 8) + 1)):
                b.discard(rnd.choice(sorted(a)))
                if rnd.random() < 0.5:
                    b.add(rnd.randrange(len(universe)))
            if b and 100 * len(a & b) >= percent * len(a | b):
                keys = [set(signer.of(universe[sorted(x)]).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_keys_of_many_sets_keep_apart():
    """sets that share a token here and there share hardly a key, or candidates grow with the square of the sets."""
    rnd = np.random.default_rng(5)
    universe = np.unique(rnd.integers(0, 1 << 64, 60_000, np.uint64))
    for percent in (80, 90):
        signer = ngram_join.Prefixes(percent, np.full(1 << 10, 80, np.uint8))
        keys = [np.unique(signer.of(np.sort(rnd.permutation(universe)[:300]))) for _ in range(100)]
        shared = np.unique(np.concatenate(keys), return_counts=True)[1] > 1
        assert shared.sum() < 100


def test_keys_of_sets_as_far_apart_as_links_allow():
    """over whole hashes, at the greatest difference that still links, in sizes and in tokens."""
    rnd = np.random.default_rng(6)
    for percent in (80, 90):
        signer = ngram_join.Prefixes(percent, rnd.integers(0, 200, 1 << 10).astype(np.uint8))
        for n in [*range(1, 70), 200, 431]:
            for drop in range(n):
                both, add = n - drop, (n - drop) * 100 // percent - n
                if add < 0:
                    break
                a = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
                b = np.unique(np.concatenate([rnd.permutation(a)[:both], rnd.integers(0, 1 << 64, add, np.uint64)]))
                assert np.intersect1d(signer.of(a), signer.of(b)).size


def test_marks_held_by_a_fixed_number_of_bits(spark):
    """every mark passes, few others do; when more come than there are bits, all pass."""
    rows = spark.range(0, 2000).select(F.xxhash64("id").alias("m"), (F.col("id") % 4 == 0).alias("own"))
    for bits, most in ((1 << 20, 20), (64, 1500)):
        held = ngram_join.held_marks(rows.filter("own").select("m"), bits=bits, pieces=8)
        got = {r.own: r.n for r in rows.filter(held("m")).groupBy("own").agg(F.count("*").alias("n")).collect()}
        assert got[True] == 500 and got.get(False, 0) <= most


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(df).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[1] != got[100]
    assert ngram_join.components(df.filter("false")).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    from provark.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_pipeline_stages(spark, stages):
    docs, rated, exact, near, clean, packed = stages
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert all(df.columns == docs.columns for df in (rated, exact, near, clean))
    assert 0 < rated.count() < docs.count()
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    best = {}
    for i, t in rows(rated):
        best[squeeze(t)] = min(best.get(squeeze(t), (0, 1 << 62)), (-len(t), i))
    assert sorted(i for i, _ in rows(exact)) == sorted(i for _, i in best.values())
    assert sorted(i for i, _ in rows(near)) == sorted({c for _, c in brute_join(rows(exact), 5, 80).values()})
    assert sorted(i for i, _ in rows(clean)) == sorted(i for i, _ in rows(near))
    assert clean.filter(F.col("n_chars") != F.length("text")).count() == 0
    from provark.llm.secret_scan import secret_scan

    before, after = (secret_scan(df).agg(F.sum(F.col("n_access") + F.col("n_assign") + F.col("n_hex"))).head()[0] for df in (near, clean))
    assert after == 0 <= before
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows(clean)}


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    runs = [sum(n for _, _, n, _, _ in key(df)) for df in (corpus_pipeline.run(spark, SF), stages[-1])]
    assert runs[0] == runs[1]


def test_stages_keep_one_row_of_each_group(spark):
    """Null ids, repeated rows and repeated ids: no text is lost, and no copy stays beside its winner."""
    rnd = random.Random(12)
    words = lambda n: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(999)) for _ in range(n))
    a, b, c, d, e = (words(60) for _ in range(5))
    rows = [(None, a), (None, a + " "), (1, a), (2, b), (2, b), (3, c), (3, d), (4, d), (None, e), (None, e), (5, None), (6, ""), (7, c + "\n\n"), (7, b + " ")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    best = {}
    for i, t in rows:
        best.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0, i, t))
    want = [min(v)[3:] for v in best.values()]
    exact = corpus_pipeline.drop_copies(spark, docs, SF)
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert exact.columns == docs.columns and got(exact) == sorted(want, key=str)
    near = [(None, a), (None, a + " x"), (9, b), (9, b), (8, b + " y"), (8, c), (None, c + " z"), (8, d), (None, e), (None, e), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame(near, DOC).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    out = got(kept)
    assert kept.columns == docs.columns
    assert [x for x in out if x[0] is not None or not x[1] or x[1] == e] == sorted([(8, b + " y"), (8, c), (8, d), (None, e), (6, ""), (6, ""), (None, None)], key=str)
    assert len(out) == 8 and sum(bool(t) and t.startswith(a) for _, t in out) == 1


def test_near_copies_shuffle_only_rows_that_may_go(spark):
    """of all texts only those that may be copies are dealt out; null and repeated ids, and rows repeated as they are."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, "a b"), (4, text + " x"), (4, "a b"), (4, "c d"), (4, "c d"), (2, text + " y"), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, DOC)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(2, text + " y"), (4, "a b"), (4, "c d"), (9, ""), (9, None)], DOC).collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftSemi" not in plan
