"""Rules tried by their literals against trying every rule on every line."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from provark.operators import rules


@pytest.mark.parametrize(
    ("pattern", "needed"),
    [
        (r"AKIA[A-Z0-9]{16}", ("akia",)),
        (r"(password|token)[ ]*[:=]", ("password", "token")),
        (r"a?b+cde(fg)*", ("cde",)),
        (r"[0-9]+\.[0-9]+", (".",)),
        (r"[ñó]", ()),
        (r"(abc|d*)", ()),
        (r"(?:foo|barbar)x\s+eval\(", ("eval(",)),
        (r"x(?=secret)", ("x",)),
        (r"(?i)Debug\s*=\s*true", ("debug",)),
        (r"(", ()),
    ],
)
def test_needed_literals(pattern, needed):
    assert rules.needed_literals(rules.Rule("r", "c", "k", pattern)) == needed


def some_rules(rnd, n):
    part = lambda: "".join(rnd.choice("abcdAB_.") for _ in range(rnd.randrange(1, 5)))
    shapes = [lambda: re.escape(part()), lambda: f"({re.escape(part())}|{re.escape(part())})[ab]*", lambda: f"[abc]+{re.escape(part())}", lambda: "(?i)" + re.escape(part()), lambda: f"[cd]{{2}}[ab]", lambda: f"{re.escape(part())}\\s*={re.escape(part())}?"]
    out = []
    for i in range(n):
        out.append(rules.Rule(f"r{i}", rnd.choice("xy"), "k", rnd.choice(shapes)(), languages=rnd.choice([("*",), ("en",), ("en", "de")]), unless=rnd.choice(["", "", "bad"])))
    return out


def test_prefilter_changes_nothing(spark):
    rnd = random.Random(6)
    made = some_rules(rnd, 80)
    texts = ["".join(rnd.choice("abcdAB_. =") for _ in range(rnd.randrange(40))) + rnd.choice(["", " bad"]) for _ in range(400)] + ["", None]
    rows = [(i, rnd.choice(["en", "de", "fr", None]), t) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "id int, lang string, content string")
    got = sorted((r.id, r.rule_seq, r.snippet) for r in rules.match_rules(lines, made, "lang").collect())
    want = []
    for i, lang, t in rows:
        for n, r in enumerate(made):
            if t is not None and (m := re.search(r.pattern, t)) and not (r.unless and re.search(r.unless, t)) and ("*" in r.languages or lang in r.languages):
                want.append((i, n, m[0]))
    assert got == sorted(want)
    assert rules.match_rules(lines, []).collect() == []


def test_many_rules_cost_little_more(spark):
    """Two hundred rules take no more than twice the time of twelve (best of three each)."""
    words = "the quick brown fox jumps over a lazy dog while seven sleepy otters watch from below"
    lines = spark.range(60_000).select(F.col("id"), F.concat(F.lit(words), F.col("id").cast("string")).alias("content")).repartition(4).cache()
    lines.count()
    made = [rules.Rule(f"r{i}", "c", "k", rf"call_{chr(97 + i % 26)}{i}x\s*\(\s*[a-z]+") for i in range(200)]

    def seconds(rs):
        best = 1e9
        for _ in range(3):
            began = time.time()
            rules.match_rules(lines, rs).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        return best

    seconds(made[:2])
    few, many = seconds(made[:12]), seconds(made)
    assert many < 2 * few + 0.5, (few, many)


def test_scan_order(spark):
    rows = [("b", 1, "x"), ("a", 10, "x"), ("a", 9, "y"), ("a", 9, "x"), (None, 1, "x"), ("a", None, "x"), ("a", 9, "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, line int, rule string, other int").repartition(4)
    got = sorted(rules.scan_order(df).collect(), key=lambda r: r.at)
    assert [r.at for r in got] == list(range(7))
    assert [(r.file, r.line, r.rule) for r in got] == [(None, 1, "x"), ("a", None, "x"), ("a", 9, "x"), ("a", 9, "x"), ("a", 9, "y"), ("a", 10, "x"), ("b", 1, "x")]
    assert rules.scan_order(df.filter("false")).count() == 0
