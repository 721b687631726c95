"""Contracts, candidates, comparisons, integrity, sources and streams against hand-worked cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provark.functions import arrow_udfs, text
from provark.operators import candidates, compare, contract, flows, integrity, kpi, rules, tools
from provark.sources import manifests, readers, sinks, taint
from provark.streaming import events

RECORDS = "seq long, scope string, case_id string, metrics map<string,double>"


def verdict(spark, predicate, *values, metric="arg_lines_raw", mode="full"):
    rows = [(i, "m.py:f", f"c{v}", {metric: float(v)}) for i, v in enumerate(values)]
    return contract.verdicts(spark.createDataFrame(rows, RECORDS), [("c", "*", predicate)], mode).head()


def test_clause_verdicts(spark):
    ok = verdict(spark, "arg_lines_raw <= 8", 3, 8)
    assert (ok.status, ok.passed) == ("SURVIVING", 2)
    bad = verdict(spark, "arg_lines_raw <= 3", 2, 9)
    assert (bad.status, bad.counterexample, bad.failed) == ("FALSIFIED", "c9", 1)
    assert verdict(spark, "never <= 3", 2).status == "UNSUPPORTED"
    first = verdict(spark, "arg_lines_raw <= 3", 1, 9, 2, 9, mode="first")
    assert (first.passed, first.failed) == (1, 1)
    assert verdict(spark, "arg_lines_raw % 0 == 1", 5).status == "UNSUPPORTED"


@pytest.mark.parametrize("text_", ["__import__('os')", "a.b > 1", "a[0] > 1", "1 < 2", "a + 1", "", "a > " + "1" * 500, "(lambda: 1)() > a", "a > 1 if b else c", "a > 1; b", "(a >\n 1)", "[x for x in a] == 1"])
def test_hostile_predicates(text_):
    with pytest.raises(contract.Rejected):
        contract.Predicate(text_)


def test_python_arithmetic(spark):
    row = spark.createDataFrame([(-7.0, 2.0, 7.0, -2.0)], "a double, b double, c double, d double")
    ok = lambda p: row.select(contract.Predicate(p).column({k: F.col(k) for k in "abcd"})).head()[0]
    assert ok("a // b == -4") and ok("c % d == -1") and ok("-8 < a < 0") and ok("not (a > 0) and b in [1, 2]")
    assert ok("a / (b - 2) > 0") is None


def test_profiles(spark):
    num = lambda s, m, v: (s, "m:f", f"c{s}", "call", m, "num", float(v), None, None)
    rows = [num(1, "arg_len_x", 4), num(2, "arg_len_x", 9), num(1, "shell", 0), num(2, "shell", 0), num(1, "ret_seq", 1), num(2, "ret_seq", 3), num(1, "mixed", 1)]
    rows += [(2, "m:f", "c2", "call", "mixed", "str", None, "x", None), (1, "m:f", "c1", "call", "flag", "bool", None, None, True), (2, "m:f", "c2", "call", "flag", "bool", None, None, True), (1, "m:f", "c1", "call", "op", "str", None, "ping", None), (2, "m:f", "c2", "call", "op", "str", None, "status", None)]
    got = {r.metric: r for r in contract.profiles(spark.createDataFrame(rows, contract.METRICS)).collect()}
    assert {k: r.kind for k, r in got.items()} == {"arg_len_x": "length", "shell": "zero", "ret_seq": "monotonic", "flag": "boolean", "op": "enum"}
    assert got["arg_len_x"].high == 9 and got["flag"].all_true and got["op"]["values"] == ["ping", "status"]
    clauses = {r.metric: r.predicate for r in contract.propose(contract.profiles(spark.createDataFrame(rows, contract.METRICS))).collect()}
    assert clauses == {"arg_len_x": "arg_len_x <= 9", "shell": "shell == 0", "ret_seq": "ret_seq >= 1", "flag": "flag == True", "op": "op in ['ping', 'status']"}
    assert contract.profiles(spark.createDataFrame([], contract.METRICS)).count() == 0


def test_falsification_widens(spark):
    num = lambda s, v: (s, "m:f", f"c{s}", "call", "x", "num", float(v), None, None)
    base = contract.profiles(spark.createDataFrame([num(1, 3), num(2, 5)], contract.METRICS))
    records = spark.createDataFrame([(1, "m:f", "c1", {"x": 7.0})], RECORDS)
    wide, last = contract.falsify(base, records, spark.createDataFrame([num(3, 7)], contract.METRICS))
    assert wide.head().high == 7 and last.head().status == "SURVIVING"


def test_holdout(spark):
    rows = contract.holdout(spark.createDataFrame([(f"{i:03d}",) for i in range(12)], "case_id string")).collect()
    assert sorted(r.case_id for r in rows if r.held) == ["001", "003", "005", "007", "009", "011"] and len(rows) == 12


CAND = "seq long, channel string, location string, severity string, reachability double, confidence double, blast_radius double, cwe string, rule_id string, evidence_refs array<string>, has_plan boolean, reachability_measured boolean"


def test_correlation_and_priority(spark):
    rows = [(1, "static", "a.py:40", "high", 0.5, 0.7, 0.5, "CWE-78", "r.x", ["e1"], True, True), (2, "runtime", "a.py:42", "high", 0.5, 0.85, 0.5, "CWE-78", "q.x", ["e2"], True, True), (3, "config", "b.py:1", "low", 0.5, 0.4, 0.5, "", "z.port", [], False, True)]
    out = candidates.statuses(candidates.correlate(spark.createDataFrame(rows, CAND)))
    assert {r.status: r.n for r in candidates.status_counts(out).collect()} == {"QUEUED": 1, "UNKNOWN": 1}
    merged = out.filter("merged = 2").head()
    assert 0.85 < merged.confidence <= 0.95 and merged.evidence_refs == ["e1", "e2"] and merged.channels == ["runtime", "static"]
    assert spark.range(1).select(flows.hypothesis_priority(F.lit(0.5), F.lit(0.8), F.lit(0.5), F.lit(True), F.lit("low"))).head()[0] == pytest.approx(0.2)
    ranks = spark.createDataFrame([("low", True, 1.0), ("critical", False, 1.0)], "severity string, m boolean, c double").select("severity", flows.hypothesis_priority(F.lit(0.2), F.col("c"), F.lit(0.5), F.col("m"), F.col("severity")).alias("p"))
    assert ranks.orderBy(F.desc("p")).head().severity == "critical"


def test_correlation_keeps_what_a_fold_in_order_keeps(spark):
    import random

    dice = random.Random(5)
    rows = [(i, "static", f"{dice.choice('ab')}.py:{i}", dice.choice(["low", "medium", "high", "odd"]), 0.5, 0.5, 0.5, "", "r.x", [], False, True, dice.choice([None, "", f"c{i}"]), dice.choice([None, "", "d1", "d2"])) for i in range(60)]
    rows += [(100 + i, "static", f"lone{i}.py:1", s, 0.5, 0.5, 0.5, "", "r.x", [], False, True, c, None) for i, (s, c) in enumerate([("low", None), ("odd", "k")])]
    want: dict = {}
    for r in rows:
        file, rank = r[2].split(":")[0], rules.SEVERITY.get(r[3], 0)
        top, clause, said = want.get(file, (-1, "", []))
        clause = (r[12] or clause) if rank > top else (clause or r[12] or "")
        want[file] = (max(top, rank), clause, said + [r[13]] * bool(r[13] and r[13] not in said))
    got = candidates.correlate(spark.createDataFrame(rows, CAND + ", clause_id string, description string")).collect()
    assert {r.file: (r.clause_id or "", r.descriptions) for r in got} == {f: v[1:] for f, v in want.items()}
    assert {r.cwe for r in got} == {None}


def test_replay(spark):
    side = lambda rows: spark.createDataFrame(rows, "case_id string, exit_code int, response_hash string")
    out = compare.replay(side([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")]), side([("a", 0, "x"), ("b", 0, "other"), ("d", 0, "w")]))
    assert {r.case_id: r.divergence for r in out.collect()} == {"a": None, "b": "response", "c": "missing"}
    v = compare.replay_verdict(out).head()
    assert (v.matched, v.verdict) == (1, "FAIL")
    assert compare.replay_verdict(out.filter("false")).head().verdict == "FAIL"


def test_assurance(spark):
    good = dict(gauntlet_passed=True, exploit_eliminated=True, replay_passed=True, contract_passed=True, unsupported=0, coverage_before=70.0, coverage_after=71.0, unproved_siblings=0)
    cases = [("A", {}), ("A", {"coverage_after": 80.0}), ("B", {"unproved_siblings": 2}), ("C", {"unsupported": 1}), ("C", {"coverage_after": 59.9}), ("C", {"coverage_after": None}), ("C", {"replay_passed": False, "unproved_siblings": 1}), ("C", {"contract_passed": None}), ("R", {"gauntlet_passed": False}), ("R", {"exploit_eliminated": False, "unsupported": 1})]
    schema = "want string, gauntlet_passed boolean, exploit_eliminated boolean, replay_passed boolean, contract_passed boolean, unsupported int, coverage_before double, coverage_after double, unproved_siblings int"
    df = spark.createDataFrame([(want, *(good | more).values()) for want, more in cases], schema)
    assert all(r.want == r.level for r in integrity.assurance_level(df).collect())
    risks = integrity.residual_risks(spark.createDataFrame([(x, x, ["unproved: a.py:3", "coverage moved"]) for x in "ABCR"], "run_id string, level string, limitations array<string>"))
    assert sorted(map(tuple, risks.collect())) == [("B", "unproved: a.py:3"), ("C", "coverage moved"), ("C", "unproved: a.py:3"), ("R", "the change was refuted")]


INDEX = dict(nodes=50, relationships=40, calls=20, discovered=10, indexed=10, symbols=30, functions=20, code_files=10, resolved_ratio=0.7, entrypoints=3, missing_grammars=0, provider="contributed", configs=1, dependencies=1, tests=1, silent_languages=0)


@pytest.mark.parametrize("change, failing, grade", [
    ({}, {}, "A"), ({"indexed": 9}, {"file_coverage": "WARN"}, "B"), ({"indexed": 7}, {"file_coverage": "FAIL"}, "F"), ({"nodes": 0}, {"non_empty": "FAIL"}, "F"), ({"functions": 4}, {"symbols": "WARN"}, "B"), ({"symbols": 0}, {"symbols": "FAIL"}, "F"),
    ({"relationships": 0}, {"relationships": "FAIL", "resolution": "INFO"}, "F"), ({"calls": 0}, {"relationships": "WARN"}, "C"), ({"entrypoints": 0}, {"entrypoints": "WARN"}, "C"), ({"tests": 0, "provider": "off"}, {"sections": "INFO", "provider": "INFO"}, "A"),
    ({"resolved_ratio": 0.5, "missing_grammars": 1, "silent_languages": 1}, {"resolution": "WARN", "grammars": "WARN", "language_parity": "WARN"}, "C"),
])
def test_index_health(spark, change, failing, grade):
    row = INDEX | change
    schema = ", ".join(f"{k} {'string' if k == 'provider' else 'double' if k == 'resolved_ratio' else 'int'}" for k in row)
    checks = integrity.health_checks(spark.createDataFrame([tuple(row.values())], schema))
    assert {r.check: r.severity for r in checks.collect() if r.severity != "OK"} == failing
    assert integrity.health_grade(checks).head().grade == grade


def test_flow_confidences(spark):
    from provark.operators import flows

    lit = lambda *xs: [F.lit(x) for x in xs]
    value = lambda c: spark.range(1).select(c).head()[0]
    assert value(flows.call_path_confidence(*lit(0.5, 0.5, True, 1, False))) == 0.5  # one node is no longer a path than two
    assert value(flows.call_path_confidence(*lit(0.7, 0.9, False, 4, False))) == 0.353
    assert value(flows.taint_confidence(*lit(0.123456, 1, False, False, False))) == 0.093


def test_clauses_over_texts_and_flags(spark):
    rows = [(1, "m:f", "c1", {"n": 3.0}, {"op": "ping"}, {"ok": True}), (2, "m:f", "c2", {"n": 4.0}, {"op": "x"}, {"ok": False}), (3, "m:f", "c3", {}, {}, {})]
    records = spark.createDataFrame(rows, "seq long, scope string, case_id string, metrics map<string,double>, texts map<string,string>, flags map<string,boolean>")
    judge = lambda p, scope="": tuple(contract.verdicts(records, [("c", scope, p)]).select("passed", "failed").head())
    assert judge("op in ['ping', 'x']") == (2, 0) and judge("op == 'ping'") == (1, 1) and judge("op not in ['ping']", "m:*") == (1, 1)
    assert judge("ok == True") == (1, 1) and judge("not (ok == True)") == (1, 1) and judge("ok and n <= 3") == (1, 1) and judge("ok + n == 4") == (2, 0)
    assert judge("op == 5") == (0, 0)  # a number is asked for and there is none
    assert judge("op in ['ping', 3] and op != 'x'") == (1, 1)
    long = [(s, "m:f", f"c{s}", "call", m, t, n, x, b) for s, m, t, n, x, b in [(1, "op", "str", None, "ping", None), (2, "op", "str", None, "x", None), (1, "ok", "bool", None, None, True), (2, "ok", "bool", None, None, False), (1, "n", "num", 3.0, None, None), (2, "n", "num", 4.0, None, None)]]
    metrics = spark.createDataFrame(long, contract.METRICS)
    wide, last = contract.falsify(contract.profiles(metrics.filter("seq = 1")), records, metrics)
    assert {r.metric: (r.high, r["values"]) for r in wide.collect()} == {"n": (4.0, None), "op": (None, ["ping", "x"]), "ok": (None, None)}
    assert {r.clause_id: r.status for r in last.collect()} == {"m:f/n": "SURVIVING", "m:f/op": "SURVIVING", "m:f/ok": "FALSIFIED"}


def test_chain(spark):
    chain = integrity.build_chain(spark.createDataFrame([("t", i, f"x{i}") for i in range(3)], "k string, o int, v string"), "k", "o", ["v"])
    assert integrity.verify_chain(chain).head().valid
    bad = integrity.verify_chain(chain.withColumn("evidence_hash", F.when(F.col("seq") == 2, "0").otherwise(F.col("evidence_hash")))).head()
    assert (bad.break_seq, bad.reason) == (2, "hash does not match")
    gap = integrity.verify_chain(chain.filter("seq <> 2")).head()
    assert (gap.break_seq, gap.reason) == (3, "sequence gap")
    more = sinks.append_audit(chain, spark.createDataFrame([("t", 9, "y")], "k string, o int, v string"), "k", "o", ["v"])
    assert integrity.verify_chain(chain.unionByName(more)).head().valid


def test_certificates(spark):
    nodes = spark.createDataFrame([("a", "T", "t", "c"), ("b", "T", "t", "c")], "ref string, type string, title string, content string")
    edges = spark.createDataFrame([("a", "SUPPORTS", "b")], "source_ref string, relation string, target_ref string")
    doc = integrity.certificate(nodes, edges, b"k")
    assert integrity.verify_certificate(doc, nodes, edges, b"k") and not integrity.verify_certificate(doc, nodes, edges, b"other")
    assert not integrity.verify_certificate(doc, nodes.withColumn("content", F.lit("changed")), edges, b"k")
    with pytest.raises(ValueError):
        integrity.certificate(nodes, edges.withColumn("target_ref", F.lit("x")), b"k")


def test_reproductions(spark):
    rows = [("a", "FIRED"), ("a", "FIRED"), ("b", "FIRED"), ("b", "HELD"), ("c", "UNSUPPORTED"), ("d", "HELD"), ("d", "UNSUPPORTED"), ("e", "HELD")]
    got = {r.plan_id: r.outcome for r in compare.reproduction_gate(spark.createDataFrame(rows, "plan_id string, verdict string")).collect()}
    assert got == {"a": "reproduced", "b": "below threshold", "c": "unresolved", "d": "unresolved", "e": "held"}


def test_calls_and_returns(spark):
    rows = [("x", 1, "f", "call"), ("x", 2, "f", "call"), ("x", 3, "f", "return"), ("x", 4, "f", "return"), ("x", 5, "g", "return")]
    got = {r.return_seq: r.call_seq for r in compare.call_pairs(spark.createDataFrame(rows, "case_id string, seq int, function string, kind string")).collect()}
    assert got == {3: 2, 4: 1, 5: None}


def test_patches(spark):
    before, after = "a\nb\nc\n", "a\nx\nc\nd\n"
    df = spark.createDataFrame([(1, before, after)], "id int, before string, after string").withColumn("patch", arrow_udfs.unified_diff("before", "after"))
    row = df.select("patch", arrow_udfs.patched("before", "patch").alias("p"), arrow_udfs.hunk_summary("patch").alias("s")).head()
    assert row.p == after and row.s == "hunk: -1 +2"
    stats = compare.diff_stats(df).head()
    assert (stats.files, stats.hunks, stats.added, stats.removed) == (1, 1, 2, 1)
    bad = spark.createDataFrame([(1, "--- a/x\n+++ b/infra/deep/x.py\n@@ -1 +1 @@\n-a\n+import pickle\n")], "id int, patch string")
    assert {r.rule for r in compare.policy_violations(bad, ["infra/**"]).collect()} == {"protected_path", "import"}


def test_hmac_and_canonical_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"pid":3,"z":[1,2]}}',), ("no json",), (None,)], "t string")
    got = [tuple(r) for r in df.select(arrow_udfs.canonical_json("t"), arrow_udfs.without_volatile("t")).collect()]
    assert got == [('{"a":{"pid":3,"z":[1,2]},"b":1}', '{"a":{"z":[1,2]},"b":1}'), (None, None), (None, None)]
    signed = df.filter("t is not null").withColumn("s", arrow_udfs.hmac_sha256(b"k")("t"))
    assert all(r[0] for r in signed.select(arrow_udfs.hmac_verify(b"k")("t", "s")).collect())


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(text.dirname(F.lit("a/b/c.py"))) == "a/b" and one(text.dirname(F.lit("c.py"))) == "."
    assert one(text.last_identifier(F.lit("a.b.c(x.y)"))) == "c"
    file, line = text.split_location(F.lit("a:b.py:12"))
    assert (one(file), one(line)) == ("a:b.py", 12)
    assert one(text.lines_of(F.lit("a\r\nb\n"))) == ["a", "b"] and one(text.lines_of(F.lit("a\n\n"))) == ["a", ""]
    assert one(text.normalised_path(F.lit("/x/12/00000000-0000-0000-0000-000000000000"))) == "/x/{n}/{id}"
    assert one(text.redact_map(F.create_map(F.lit("api_key"), F.lit("v"), F.lit("user"), F.lit("w")))) == {"api_key": "***", "user": "w"}
    trace = 'File "/p/a.py", line 3, in f\n File "/lib/b.py", line 9, in g'
    assert one(text.crash_site(F.lit(trace), "/p/")) == "/p/a.py:3"
    assert one(text.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == {"a": 2, "b": 3}
    assert one(F.lit("x/y/z.py").rlike(text.glob_to_regex("x/**"))) and not one(F.lit("x/y/z.py").rlike(text.glob_to_regex("x/*.py")))
    assert one(text.digest(F.lit("a|b"), F.lit("c"))) != one(text.digest(F.lit("a"), F.lit("b|c")))


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n\n\ndef f():\n    x = input()\n    os.system(f'ls {x}')\n")
    (tmp_path / "node_modules/b.js").write_text("x")
    (tmp_path / "requirements.txt").write_text("Flask==2.0\nflask==1.0\nrequests>=2\n")
    assert [r.path for r in readers.list_files(spark, str(tmp_path)).collect()] == ["requirements.txt", "src/a.py"]
    record = readers.index_tree(spark, str(tmp_path)).head()
    assert (record.path, record.language, record.lines) == ("src/a.py", "python", 7)
    files = readers.list_files(spark, str(tmp_path)).select("path", F.decode("content", "UTF-8").alias("text"))
    assert sorted((r.name, r.version) for r in manifests.dependencies(files).collect()) == [("Flask", "2.0"), ("requests", "2")]
    flow = taint.taint_flows(files).head()
    assert (flow.function, flow.source_kind, flow.sink_kind, flow.interpolated, flow.sanitized) == ("f", "stdin", "command", True, False)
    table = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | x\\|y |\n| 2 |\n|  | z |")], "id int, t string")
    assert [r.cells for r in readers.pipe_table(table, "id", "t").orderBy("row").collect()] == [{"a": "1", "b": "x|y"}, {"a": None, "b": "z"}]
    env = spark.createDataFrame([(1, "# c\nexport A=1\nB='x y'\nA=2\nbad line\n")], "id int, t string")
    assert {r.key: r.value for r in readers.dotenv(env, "id", "t").collect()} == {"A": "2", "B": "x y"}
    (tmp_path / "json").mkdir()
    (tmp_path / "json/1.json").write_text('{"op": "ping"}')
    (tmp_path / "json/2.json").write_text("{bad")
    assert [r.op for r in readers.json_corpus(spark, str(tmp_path / "json"), "op string").collect()] == ["ping"]


def brute_verify(rows):
    out = {}
    for key in {r["key"] for r in rows}:
        own, last, found = sorted((r for r in rows if r["key"] == key), key=lambda r: r["seq"]), integrity.GENESIS, None
        for n, r in enumerate(own, 1):
            text = "|".join(map(str, (r["previous_hash"], key, r["seq"], r["evidence_hash"])))
            why = "sequence gap" if r["seq"] != n else "previous hash does not match" if r["previous_hash"] != last else "hash does not match" if r["hash"] != hashlib.sha256(text.encode()).hexdigest() else None
            if why and not found:
                found = (r["seq"], why)
            last = r["hash"]
        out[key] = (len(own), found is None, *(found or (None, None)))
    return out


def test_chains_verified_in_blocks(spark):
    rnd = random.Random(8)
    records = spark.createDataFrame([(f"k{i % 7}", rnd.randrange(50), f"x{i}") for i in range(300)], "k string, o int, v string")
    chain = integrity.build_chain(records, "k", "o", ["v"]).collect()
    assert all(v[1] for v in brute_verify([r.asDict() for r in chain]).values())
    for round_ in range(4):
        rows = [r.asDict() for r in chain if rnd.random() > 0.01 * round_]
        for r in rnd.sample(rows, round_ * 2):
            r[rnd.choice(["previous_hash", "hash", "evidence_hash"])] = "0" * 64
        df = spark.createDataFrame(rows, "key string, seq int, evidence_hash string, previous_hash string, hash string").repartition(5)
        for block in (3, 8, 1 << 16):
            got = {r.key: tuple(r)[1:] for r in integrity.verify_chain(df, block).select("key", "records", "valid", "break_seq", "reason").collect()}
            assert got == brute_verify(rows)


def test_events_by_bucket(spark, tmp_path):
    rows = [(f"r{i % 90}", i, None, "log", "{}") for i in range(900)]
    events = spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, t string, payload string")
    sinks.append_events(events.filter("seq < 500"), f"{tmp_path}/e")
    sinks.append_events(events.filter("seq >= 500"), f"{tmp_path}/e")
    assert sorted(r.seq for r in sinks.run_of(spark, f"{tmp_path}/e", "r7").collect()) == list(range(7, 900, 90))
    plan = sinks.run_of(spark, f"{tmp_path}/e", "r7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_sanitized_flow_and_broken_file():
    assert taint.flows_of("a.py", "def f(:") == []
    (flow,) = taint.flows_of("a.py", "import os, shlex\ndef f():\n  x = shlex.quote(input())\n  os.system(x)\n")
    assert flow[-1] is True


def test_rules(spark):
    lines = rules.explode_lines(spark.createDataFrame([(1, "# note\n\nmail a@b.co\npassword: changeme", "en"), (2, None, "en")], "id int, text string, lang string"), "id", "text")
    got = [(r.line, r.rule_id) for r in rules.match_rules(lines, rules.TEXT_RULES, "lang").collect()]
    assert got == [(3, "email")]


def test_streams(spark, tmp_path):
    rows = [("r", 1, "2024-01-01 00:00:00", "phase", '{"phase":"p","status":"ok"}'), ("r", 2, "2024-01-01 00:00:01", "done", '{"status":"ok"}'), ("r", 2, "2024-01-01 00:00:01", "done", '{"status":"ok"}'), ("r", 3, "2024-01-01 00:00:02", "log", '{"evil":1}'), ("r", 4, "2024-01-01 00:00:02", "what", "{}")]
    df = spark.createDataFrame(rows, "run_id string, seq long, ts string, t string, payload string").withColumn("ts", F.to_timestamp("ts"))
    sinks.append_events(df, str(tmp_path / "events"))
    stream = events.dedup_stream(events.read_events(spark, str(tmp_path / "events")))
    events.drain(stream, "seen", str(tmp_path / "cp"))
    assert sorted(r.seq for r in spark.table("seen").collect()) == [1, 2, 3, 4]
    assert [r.seq for r in events.replay_after(df, "r", 1).collect()] == [2, 3, 4]
    good, bad = events.validated(events.dedup(df))
    assert sorted(r.seq for r in bad.collect()) == [3, 4] and good.count() == 2
    assert events.finished(df).count() == 1


def test_tools_say_absence(spark):
    nodes = spark.createDataFrame([("a.py:f", "function", "f", "f", "a.py", 1, 9, 1), ("a.py:g", "function", "g", "g", "a.py", 3, 4, 2)], "uid string, kind string, name string, qualname string, file string, start_line int, end_line int, seq int")
    edges = spark.createDataFrame([("a.py:f", "a.py:g", "CALLS", ["p"], 0.5)], "src string, dst string, kind string, provenance array<string>, confidence double")
    m = tools.Model(nodes, edges, files=spark.createDataFrame([("a.py", "one\ntwo\nneedle\n")], "path string, text string"))
    assert len(tools.TOOLS) == 24
    assert [r.uid for r in tools.get_callers(m, "a.py:g").collect()] == ["a.py:f"]
    assert tools.get_coverage(m, "a.py").head().available is False
    with pytest.raises(tools.Absent):
        tools.get_dataflow(m, "x")
    hit = tools.search_code(m, "needle").head()
    assert (hit.line, hit.owner) == (3, "a.py:g")
    assert [r.content for r in tools.get_file(m, "a.py", 2, 3).collect()] == ["two", "needle"]
    assert tools.search_symbols(m, "G").head().uid == "a.py:g"


def test_rollups(spark):
    assert [r.truncated for r in kpi.capped(spark.range(3), 2).collect()] == [True, True]
    runs = spark.createDataFrame([("SUCCEEDED", 0, 1), ("SUCCEEDED", 5, 1), ("FAILED", None, 1)], "status string, duration_ms int, findings int")
    assert kpi.dashboard(runs).head().avg_duration_ms == 5
    assert kpi.dashboard(runs.filter("false")).head().success_rate is None
    one = sinks.metric_lines(spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.0)], "name string, labels map<string,string>, value double")).head()
    assert one.line == 'm{a="1",b="2"} 3.0'


def test_checkpoint_rows(spark, tmp_path):
    back = sinks.checkpoint(spark.range(5).withColumn("x", F.lit("v")), str(tmp_path), "r", "index", 1)
    assert back.count() == 5
    row = spark.read.parquet(str(tmp_path / "manifest")).head()
    assert row.rows == 5 and len(row.state_hash) == 64


def test_root_cause_by_frame_or_scope_and_branches_by_owner(spark):
    symbols = spark.createDataFrame([("a.py", "a.py#f", "f", 1, 50, 1), ("a.py", "a.py#g", "g", 10, 20, 2), ("a.py", "a.py#h", "h", 200, 210, 3)], "file string, uid string, name string, start_line int, end_line int, seq long")
    claims = spark.createDataFrame([("frame", "a.py", 95), ("uid", "a.py", 5), ("name", "a.py", 15), ("cold", "a.py", 205), ("past", "a.py", 999), ("gone", "b.py", 5), ("void", "a.py", None), ("none", None, 3)], "id string, file string, line int")
    frames = spark.createDataFrame([("a.py", 135), ("a.py", 999)], "file string, line int")
    sizes = spark.createDataFrame([("a.py", 300)], "file string, lines int")
    scopes = spark.createDataFrame([("a.py#f",), ("x.py:g",), ("h",), (None,)], "scope string")
    ran = lambda **more: {r.id for r in compare.root_cause(claims, frames, sizes, **more).collect() if r.verified}
    assert ran() == {"frame"}
    assert ran(symbols=symbols, scopes=scopes) == {"frame", "uid", "name"}
    branches, covered = claims.select("file", "line"), claims.filter("id = 'uid'").select("file", "line")
    owned = compare.uncovered(branches, covered, symbols=symbols).collect()
    assert {r.line: r.owner for r in owned if r.file == "a.py" and r.line} == {95: None, 15: "a.py#g", 205: "a.py#h", 999: None}
    assert [r.line for r in compare.uncovered(branches, covered, symbols=symbols, focus=symbols.filter("name = 'g'").select("uid")).collect()] == [15]


def test_evidence_is_counted_without_its_pairs(spark):
    """counts of edges equal those of the edges themselves, also where a pair meets at two places."""
    from provark.operators import integrity

    place = "ref string, file string, line int"
    findings = spark.createDataFrame([("f1", "a", 1), ("f1", "a", 2), ("f2", "a", 1), ("f3", "b", 9), ("f4", None, 1), ("f2", "a", 1)], place)
    flows = spark.createDataFrame([("w1", "a", 1), ("w1", "a", 2), ("w2", "a", 2), ("w3", "a", 1), ("w4", "c", 1)], place)
    symbols = spark.createDataFrame([("s1", "a", 1, 1, 1), ("s2", "b", 1, 20, 2)], "uid string, file string, start_line int, end_line int, seq long")
    tests = spark.createDataFrame([("s1", "t1"), ("s1", "t2")], "uid string, test string")
    found = integrity.attach(findings, symbols, flows, tests)
    edges = [tuple(r) for r in found.edges().collect()]
    assert len(edges) == len(set(edges))
    assert {e for e in edges if e[1] == "EXHIBITS"} == {(f, "EXHIBITS", w) for f, w in (("f1", "w1"), ("f1", "w2"), ("f1", "w3"), ("f2", "w1"), ("f2", "w3"))}
    want = {r: (len([e for e in edges if e[1] == r]), len({e[0] for e in edges if e[1] == r}), len({e[2] for e in edges if e[1] == r}), 0) for r in {e[1] for e in edges}}
    assert {r[0]: tuple(r)[1:] for r in found.counts().collect()} == want
    assert {r.ref for r in found.nodes().collect()} == {x for e in edges for x in (e[0], e[2])} | {"f4"}


def test_repeated_texts_are_analysed_once():
    """A text that comes again is not parsed again; long texts are not kept."""
    from unittest import mock

    text = "def f():\n  x = input()\n  eval(x)  # kept\n"
    with mock.patch.object(taint.ast, "parse", wraps=taint.ast.parse) as parse:
        first, second = taint.flows_of("a.py", text), taint.flows_of("b.py", text)
        assert parse.call_count == 1
        assert [f[1:] for f in first] == [f[1:] for f in second] and {f[0] for f in first + second} == {"a.py", "b.py"}
        assert taint.literals_of("x > 41 and y == 'kept'") == taint.literals_of("x > 41 and y == 'kept'") == [("int", "41"), ("str", "kept")]
        assert parse.call_count == 2
        long = "x = 1\n" * 1000
        assert taint.flows_of("a.py", long) == taint.flows_of("a.py", long) == []
        assert parse.call_count == 4


def test_policy_walks_each_patch_once(spark):
    """lines of patches are walked in one pass, without a list that grows along."""
    from provark.operators import compare

    text = "--- a/secrets/k\n+++ b/secrets/k\n@@ -1,2 +1,2 @@\n c\n--- x\n+++ y\n\\ No newline\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n-import os\nBinary files a and b differ"
    patches = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "id long, patch string")
    rows = compare.diff_lines(patches)
    got = [(r.file, r.op) for r in rows.filter("id = 4").orderBy("at").collect()]
    assert got == [(None, None), ("secrets/k", "f"), ("secrets/k", "@"), ("secrets/k", " "), ("secrets/k", "-"), ("secrets/k", "+"), ("secrets/k", None), ("secrets/k", None), ("z", "f"), ("z", "@"), ("z", "-"), ("z", None)]
    assert {r.id for r in rows.collect()} == {1, 3, 4}
    levels = spark.createDataFrame([(1, "C"), (2, "R"), (9, "R")], "id long, level string")
    broken = compare.policy_violations(patches, ["secrets/**"], max_files=1, levels=levels)
    each = {("protected_path", "secrets/k"), ("binary", ""), ("file_count", "2")}
    assert sorted(map(tuple, broken.collect())) == sorted([(i, *x) for i in (1, 4) for x in each] + [(1, "assurance_level", "C"), (2, "assurance_level", "R")])
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_first_verdicts_need_no_window(spark):
    """the place of a clause's first failure is an aggregate; a window would gather all records of a clause in one task."""
    from provark.plans.analysis_queries import clause_verdicts_first

    assert "Window" not in clause_verdicts_first(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_root_cause_deals_claims_out_once(spark):
    """Frames on both sides of a bucket's bounds count, and no copy of a claim is made for them."""
    from provark.operators import compare

    claims = spark.createDataFrame([(f"c{i}", "a", i) for i in range(0, 400)] + [("n", "a", None), ("x", "b", 10)], "id string, file string, line int")
    frames = spark.createDataFrame([("a", 39), ("a", 160), ("a", 161), ("a", 320), ("b", None)], "file string, line int")
    sizes = spark.createDataFrame([("a", 390), ("b", 20)], "file string, lines int")
    out = compare.root_cause(claims, frames, sizes)
    assert {r.id for r in out.filter("verified").collect()} == {f"c{i}" for i in range(1, 391) if any(abs(i - at) <= 40 for at in (39, 160, 161, 320))}
    assert out.count() == 402
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # of frames


def test_whole_texts_do_not_travel_in_batches_counted_in_rows(spark):
    """a page's diff takes a hundred pages' memory in a Python process, not that of a batch of Arrow."""
    from provark.plans.source_queries import patch_round_trip

    plan = patch_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_routes_are_read_once_and_counted(spark):
    """one read of a file for all families, no row of a route's files; null texts and paths of a file are none."""
    from provark.plans.shape_queries import order_routes
    from provark.sources import readers

    plan = order_routes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
    rows = [("a.py", "@app.get('/x/{id}')\n@app.get('/x/{id}')\n@app.route('/y', methods=['GET', 'POST'])\nrequest.args.get('q')"), ("b.py", "app.get('/x/{id}')\npathname === '/y'"), ("pages/api/u.ts", None), (None, "app.get('/z')"), ("web/app/route.ts", "export function GET() {}"), ("c.py", "app.get('no')")]
    files = spark.createDataFrame(rows[:3] + rows[4:], "path string, text string")
    got = {(r.method, r.path): (r.params, r.files) for r in readers.http_routes(files).collect()}
    assert got == {("GET", "/x/{id}"): (["id", "q"], ["a.py", "b.py"]), ("GET", "/y"): (["q"], ["a.py", "b.py"]), ("POST", "/y"): (["q"], ["a.py"]), ("ANY", "/api/u"): ([], ["pages/api/u.ts"]), ("GET", "/"): ([], ["web/app/route.ts"])}
    assert {(r.method, r.path): (r.params, r.files) for r in readers.route_counts(files).collect()} == {k: (p, len(f)) for k, (p, f) in got.items()}


def test_typed_records_are_rows_of_the_log_and_meet_their_scopes_clauses_only(spark, tmp_path):
    """A repeated event is two records, as in SQL; nothing is grouped, and a record makes a row a clause of its scope."""
    from provark.plans import analysis_queries

    rows = [(1, "click", 2.0, '{"k": 3}'), (1, "click", 2.0, '{"k": 3}'), (6, "view", None, "{}")]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, props string").selectExpr("*", "1L as user_id", "timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/events.parquet")
    records = analysis_queries.typed_records(spark, str(tmp_path))
    assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    clauses = [("a", "click", "k <= 2"), ("b", "*", "tag == 't1'"), ("c", "", "big == True"), ("d", "none", "k > 0")]
    got = {r.clause_id: (r.applicable, r.passed, r.failed, r.status, r.counterexample) for r in contract.verdicts(records, clauses).collect()}
    assert got == {"a": (2, 0, 2, "FALSIFIED", "c1"), "b": (3, 3, 0, "SURVIVING", None), "c": (2, 2, 0, "SURVIVING", None), "d": (0, 0, 0, "UNSUPPORTED", None)}
    assert contract.verdicts(records.limit(0), clauses).count() == 0
