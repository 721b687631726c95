"""Exact dedup, URL filter and secret scan: hand-worked edge cases, and brute force in plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from provark.llm import common, exact_dedup, secret_scan, url_filter

DOC = "doc_id long, text string"
EDGE_DOCS = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\n"), (6, "a  b"), (7, "x" * 200_000), (7, "x" * 200_000), (8, "é b"), (None, "a b "), (None, "n n"), (None, "n  n"), (9, "x y"), (9, "x y "), (9223372036854775807, "top"), (None, "top"), (-9223372036854775808, "low"), (0, "low")]


def brute_dedup(rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i if i is not None else 1 << 63, i))
    out = []
    for i, t in rows:
        own = groups[squeeze(t)]
        keep = min(own)[2]
        out.append((i, keep, len(own), (-len(t or ""), i if i is not None else 1 << 63) == min(own)[:2], hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_dedup_edges(spark):
    docs = spark.createDataFrame(EDGE_DOCS, DOC).withColumn("keep_id", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    assert as_rows(exact_dedup.exact_dedup(docs)) == brute_dedup(EDGE_DOCS)
    assert exact_dedup.exact_dedup(docs.filter("false")).count() == 0


def test_exact_dedup_compares_content_under_a_weak_digest(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab \n") for _ in range(rnd.randrange(6)))) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    weak = exact_dedup.exact_dedup(docs, digest=lambda c: F.length(c).cast("string"))
    assert as_rows(weak) == brute_dedup(rows)


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "id int, k string")
    right = left.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    out = common.lookup(left, common.materialise(right, "t"), "k", "size", shares=10)
    assert out.count() == 3000 and out.filter("least is null").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow")]


def test_url_filter_edges(spark):
    urls = [None, "", "nope", "HTTP://A.Example.COM/en/71?x#y", "https://example.com/en/8", "x://com/en/", "x://notcom/en/", "x://listed.org/a/", "x://www.listed.org/a?q", "x://h?/en/", "x://com#/en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None)], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("row", F.lit(7))
    listed = spark.createDataFrame([("listed.org/a",), ("listed.org/a",), (None,)], "canonical string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, RULES, listed).collect()}
    assert url_filter.url_filter(pages, RULES, listed).count() == len(urls) + 1
    verdicts = [got[i].verdict for i in range(len(urls))]
    assert verdicts == ["allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[3].host, got[3].path, got[3].rule) == ("a.example.com", "/en/71", "example.com/en/7")
    assert (got[9].host, got[9].path, got[11].host, got[11].path) == ("h", "", "b:", "//c/d")
    assert {r.verdict for r in url_filter.url_filter(pages, [], listed.filter("false")).collect()} == {"allow"}
    assert url_filter.url_filter(pages.filter("false"), RULES, listed).count() == 0


def test_url_filter_shuffled_equals_broadcast(spark):
    rnd = random.Random(3)
    urls = ["http://hot.example.com/en/x"] * 300 + [f"http://h{rnd.randrange(40)}.org/{rnd.randrange(30)}/" for _ in range(600)] + [None] * 100
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    listed = spark.createDataFrame([(f"h{i}.org/{j}",) for i in range(0, 40, 3) for j in range(0, 30, 2)] + [("hot.example.com/en/x",)], "canonical string")
    want = {u: u is not None and re.sub("^http://|/$", "", u) in {r.canonical for r in listed.collect()} for u in set(urls)}
    for limit in (0, 32 << 20):
        out = url_filter.url_filter(pages, RULES, listed, broadcast_bytes=limit)
        got = {r.page_id: r for r in out.collect()}
        assert {i: got[i].listed for i in got} == {i: want[u] for i, u in enumerate(urls)}
        assert all(r.probes_passed for r in got.values() if r.listed) and sum(r.probes_passed for r in got.values()) < 900


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    blocks = url_filter.bloom_blocks(keys, "key", 512)
    probe = lambda df: df.select(url_filter._block(F.col("key"), 512).alias("at"), url_filter._mask(F.col("key")).alias("bits")).join(blocks, F.col("at") == F.col("block")).filter(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits")).count()
    assert probe(keys) == 2000
    assert probe(spark.range(2000).select(F.concat(F.lit("no"), F.col("id").cast("string")).alias("key"))) < 400


def brute_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, t) if len(m.group()) >= 24]
    return sorted(out)


def brute_found(t, scope=200):
    t = t or ""
    base = brute_base(t)
    mixed = lambda s: re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.OPAQUE, t) if mixed(m.group())] + [(m.start(), 4, m.end()) for m in re.finditer(secret_scan.ENDPOINT, t)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    complement = {3: (1, 4), 4: (0, 1, 2, 3)}
    return sorted(base + [w for w in weak if any(abs(b[0] - w[0]) <= scope and b[1] in complement[w[1]] for b in base + weak)])


def secret_texts(seed, n):
    rnd = random.Random(seed)
    bits = ["token=", "token: 'abcdef12'", "password = \"", "SECRET:", "token=token: abcdef", "api_key=xY12345", "AKIA" + "A1" * 9, "AKIAX", "deadbeef" * 4, "10.0.0.1", "https://a.b/c", "aB3" * 14, " ", "é", "\n", "x" * 150, "=", "\"", "word "]
    return [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))) for i in range(n)]


def test_secret_scan_against_brute_force(spark):
    rows = secret_texts(1, 400) + [(900, None), (901, ""), (901, "token=abcdef"), (None, "token=abcdef")]
    docs = spark.createDataFrame(rows, DOC).withColumn("base", F.lit(1)).withColumn("row", F.lit(2)).repartition(4)
    text = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted(((i, sum(k == 0 for _, k, _ in brute_base(t)), sum(k == 1 for _, k, _ in brute_base(t)), sum(k == 2 for _, k, _ in brute_base(t)), hashlib.sha256(text(brute_base(t)).encode()).hexdigest(), text(brute_found(t))) for i, t in rows), key=str)
    got = sorted((tuple(r)[:6] for r in secret_scan.secret_scan(docs).collect()), key=str)
    assert got == want
    assert secret_scan.secret_scan(docs.filter("false")).count() == 0


def test_weak_parts_need_their_complement(spark):
    key, opaque, ip = "AKIA" + "B2" * 8, "aB3" * 12, "10.1.2.3"
    rows = [(1, f"{opaque} {ip}"), (2, f"{key} {opaque} {ip}"), (3, f"{key}{' ' * 300}{opaque}"), (4, f"token=abcdef {ip} {opaque}")]
    got = {r.doc_id: r.n_linked for r in secret_scan.secret_scan(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 2}
    alone = spark.createDataFrame([(1, opaque), (2, ip), (3, f"{opaque} {opaque}"), (4, f"{ip} {ip}"), (5, f"{opaque}{' ' * 200}{ip}")], DOC)
    assert {r.n_linked for r in secret_scan.secret_scan(alone).collect()} == {0}  # parts of one kind, or too far apart


def test_very_many_secrets_in_one_text(spark):
    text = "".join(f"token=abc{i:05d} 10.0.0.{i % 256} " for i in range(4000))
    row = secret_scan.secret_scan(spark.createDataFrame([(1, text)], DOC)).collect()[0]
    assert (row.n_assign, row.n_linked) == (4000, 4000)
    want = brute_found(text)
    assert row.spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
    masked = secret_scan.redact(spark.createDataFrame([(1, text)], DOC)).collect()[0].text
    assert masked == "[SECRET] [SECRET] " * 4000


def test_redaction_keeps_columns_and_hides_spans(spark):
    rows = [(1, "é token=abcdef12 end", "en"), (2, None, "en"), (3, "clean", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert secret_scan.redact(docs).columns == docs.columns
    assert (out[1].text, out[2].text, out[3].text, out[1].base) == ("é [SECRET] end", None, "clean", "en")
