"""Graph operators against hand-worked cases and a plain search over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from provark.operators import graph

NODE = "uid string, kind string, name string, qualname string, file string, start_line int, end_line int, language string, exported boolean, signature string, parameters array<string>, decorators array<string>, docline string, provenance array<string>, attrs map<string,string>, seq long"
EDGE = "src string, dst string, kind string, provenance array<string>, confidence double, seq long"


def node(uid, kind="function", seq=0, **more):
    row = dict(uid=uid, kind=kind, name=uid, qualname=uid, file="a.py", start_line=1, end_line=1, language="python", exported=False, signature="", parameters=[], decorators=[], docline="", provenance=["p"], attrs={}, seq=seq)
    return tuple((row | more).values())


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, k, p, c, i) for i, (a, b, k, p, c) in enumerate(rows)], EDGE)


def test_nodes_keep_the_more_informative_value(spark):
    rows = [node("a.py:f", exported=True, start_line=10, end_line=12, provenance=["gitnexus"], seq=1), node("a.py:f", start_line=10, end_line=40, parameters=["x"], decorators=["d"], provenance=["treesitter"], attrs={"k": "2"}, seq=2)]
    out = graph.merge_nodes(spark.createDataFrame(rows, NODE)).head()
    assert (out.exported, out.parameters, out.end_line, out.provenance, out.attrs) == (True, ["x"], 40, ["gitnexus", "treesitter"], {"k": "2"})


def test_a_vague_kind_yields_and_empty_tables_work(spark):
    out = graph.merge_nodes(spark.createDataFrame([node("u", "unknown", 1), node("u", "class", 2), node("u", "function", 3)], NODE)).head()
    assert out.kind == "class"
    assert graph.merge_nodes(spark.createDataFrame([], NODE)).count() == 0
    assert graph.merge_edges(spark.createDataFrame([], EDGE)).count() == 0


def test_corroboration(spark):
    e = edges_of(spark, [("f", "g", "CALLS", ["treesitter"], 0.55), ("f", "g", "CALLS", ["gitnexus"], 0.9), ("f", "h", "CALLS", ["a"], 0.3), ("f", "h", "CALLS", ["b"], 0.4)])
    rows = {r.dst: r for r in graph.merge_edges(e).collect()}
    assert rows["g"].resolved and rows["g"].confidence == 1.0
    assert not rows["h"].resolved and rows["h"].confidence == 1.0
    strict = {r.dst: r.confidence for r in graph.merge_edges(e, resolving_only=True).collect()}
    assert strict == {"g": 1.0, "h": 0.4}


def test_precision_and_measurement(spark):
    nodes = spark.createDataFrame([node(u) for u in ("main", "f", "g")], NODE)
    e = graph.merge_edges(edges_of(spark, [("main", "f", "CALLS", ["treesitter"], 0.35)]))
    entry = spark.createDataFrame([("main",)], "uid string")
    union = {r.uid: r for r in graph.reachability(nodes, e, entry).collect()}
    assert union["f"].reachable and union["f"].confidence == 0.35 and union["f"].providers == ["treesitter"]
    resolved = {r.uid: r for r in graph.reachability(nodes, e, entry, "resolved").collect()}
    assert not resolved["f"].reachable and resolved["f"].measured
    nobody = {r.uid: r for r in graph.reachability(nodes, e, entry.filter("false")).collect()}
    assert not nobody["f"].reachable and not nobody["f"].measured


def test_weakest_hop(spark):
    nodes = spark.createDataFrame([node(u) for u in ("main", "f", "g")], NODE)
    e = graph.merge_edges(edges_of(spark, [("main", "f", "CALLS", ["runtime"], 1.0), ("f", "g", "CALLS", ["t"], 0.35)]))
    g = {r.uid: r for r in graph.reachability(nodes, e, spark.createDataFrame([("main",)], "uid string")).collect()}["g"]
    assert (g.reachable, g.confidence, g.path, g.hops) == (True, 0.35, ["main", "f", "g"], 2)


def test_hash_ignores_what_is_left_out(spark):
    a = spark.createDataFrame([node("u", start_line=10), node("v")], NODE)
    b = spark.createDataFrame([node("v"), node("u", start_line=99)], NODE)
    of = lambda df, cols: graph.content_hash(df, cols).head()[0]
    assert of(a, ["uid", "kind"]) == of(b, ["uid", "kind"])
    assert of(a, ["uid", "start_line"]) != of(b, ["uid", "start_line"])


def test_innermost_owner_and_ties(spark):
    spans = spark.createDataFrame([("a.py", "outer", 1, 50, 1), ("a.py", "inner", 10, 20, 2), ("a.py", "late", 10, 20, 3), ("b.py", "one", 5, 0, 4)], "file string, uid string, start_line int, end_line int, seq int")
    points = spark.createDataFrame([("a.py", 15), ("a.py", 30), ("a.py", 60), ("b.py", 5), (None, 5)], "file string, line int")
    got = {(r.file, r.line): r.owner for r in graph.innermost(points, spans).collect()}
    assert got == {("a.py", 15): "inner", ("a.py", 30): "outer", ("a.py", 60): None, ("b.py", 5): "one", (None, 5): None}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_innermost_by_blocks_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    spans = [(f"f{rnd.randrange(3)}", f"u{i}", (a := rnd.randrange(-20, 300)), rnd.choice([0, a, a + rnd.randrange(200), a - 5]), rnd.randrange(50) * 100 + i) for i in range(150)]
    points = [(f"f{rnd.randrange(4)}", rnd.randrange(-30, 520)) for _ in range(400)] + [("f1", None), (None, 4)]
    s = spark.createDataFrame(spans, "file string, uid string, start_line int, end_line int, seq int")
    p = spark.createDataFrame(points, "file string, line int").withColumn("owner_", F.lit(1))

    def brute(file, line):
        inside = [(a, -q, u) for f, u, a, b, q in spans if f == file and line is not None and a <= line <= (b if b > 0 else a)]
        return max(inside)[2] if inside else None

    got = sorted(((r.file, r.line, r.owner) for r in graph.innermost(p, s).collect()), key=str)
    assert got == sorted(((f, n, brute(f, n)) for f, n in points), key=str)
    assert {r.owner for r in graph.innermost(p, s.filter("false")).collect()} == {None}


def test_innermost_of_one_large_file(spark):
    """A hundred thousand spans and points in one file, nested and flat: rows stay near both, not their product."""
    n = 100_000
    spans = spark.range(n).select(F.lit("a").alias("file"), F.col("id").cast("string").alias("uid"), F.col("id").alias("start_line"), (F.lit(2 * n) - F.col("id")).alias("end_line"), F.col("id").alias("seq"))
    points = spark.range(n).select(F.lit("a").alias("file"), F.col("id").alias("line"))
    assert graph.innermost(points, spans).filter("owner = cast(line as string)").count() == n


def test_innermost_span_is_few_ranges_and_a_block_a_short_row(spark):
    """A span of a million places is two ranges a group of levels; more ranges than a block has parts become a best one a part."""
    as_spans = "file string, uid string, start_line long, end_line long, seq long"
    inner = lambda rows: spark.createDataFrame(rows, as_spans).selectExpr("file", "uid as owner", "start_line as _start", "end_line as _end", "seq as _seq")
    cut = graph._pieces(inner([("a", "u", 5, 5 + 2**20, 1)]), ["file"]).select("_group", F.size("_in").alias("n")).collect()
    assert sum(r.n for r in cut) <= 5
    rnd = random.Random(4)
    spans = [("a", f"u{i}", (a := rnd.randrange(256, 380)), rnd.randrange(a, 384), i) for i in range(900)] + [("a", "far", -(2**40), 2**40, 900), ("a", "one", 2**33, 2**33, 901)]
    rows = graph._pieces(inner(spans), ["file"])
    assert rows.agg(F.max(F.size("_in"))).head()[0] <= 128 < len({s[2:4] for s in spans})
    points = [("a", n) for n in [*range(250, 390), -(2**40) - 1, -(2**40), 2**40, 2**40 + 1, 2**33]]
    got = {r.line: r.owner for r in graph.innermost(spark.createDataFrame(points, "file string, line long"), spark.createDataFrame(spans, as_spans)).collect()}
    assert got == {n: max([(a, -q, u) for _, u, a, b, q in spans if a <= n <= b], default=(None,) * 3)[2] for _, n in points}


def brute_paths(steps, roots, most):
    out = {}
    for r in roots:
        seen, frontier = {r: [r]}, [[r]]
        for _ in range(most - 1):
            nxt = {}
            for p in frontier:
                for b in steps.get(p[-1], ()):
                    if b not in seen and (b not in nxt or p + [b] < nxt[b]):
                        nxt[b] = p + [b]
            seen |= nxt
            frontier = list(nxt.values())
        out |= {(r, k): v for k, v in seen.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_closures_on_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(30)}
    e = edges_of(spark, [(a, b, "CALLS", ["p"], 0.5) for a, b in sorted(pairs)])
    steps = {}
    for a, b in pairs:
        steps.setdefault(a, set()).add(b)
    roots = names[:3]
    want = brute_paths(steps, roots, 5)
    seeds = spark.createDataFrame([(r,) for r in roots], "uid string")
    got = {(r.root, r.uid): r.path for r in graph.shortest_paths(e, seeds, 5).collect()}
    assert got == want
    hops = {(r.root, r.uid): r.hops for r in graph.closure(e, seeds, 4).collect()}
    assert hops == {k: len(v) - 1 for k, v in want.items() if len(v) > 1}


@pytest.mark.parametrize("seed", [3, 4])
def test_bits_of_many_roots(spark, seed):
    """Over two blocks of roots, with cycles and a hub: pairs, counts and label counts equal plain searches."""
    rnd = random.Random(seed)
    names = [f"n{i:03d}" for i in range(330)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(420)} | {("n000", n) for n in names[::7]} | {(n, "n000") for n in names[::11]}
    e = edges_of(spark, [(a, b, "CALLS", ["p"], 0.5) for a, b in sorted(pairs)])
    steps, back = {}, {}
    for a, b in pairs:
        steps.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def plain(steps, root):
        hops, level = {root: 0}, {root}
        for h in range(1, 4):
            level = {b for a in level for b in steps.get(a, ())} - set(hops)
            hops |= dict.fromkeys(level, h)
        return {u: h for u, h in hops.items() if h}

    seeds = spark.createDataFrame([(n,) for n in [*names, names[5], None]], "uid string")
    found = graph.reach(e, seeds, 3)
    want = {(r, u): h for r in names for u, h in plain(steps, r).items()}
    assert {(r.root, r.uid): r.hops for r in found.pairs().collect()} == want
    counts = {}
    for (r, _), h in want.items():
        counts[r, h] = counts.get((r, h), 0) + 1
    assert {(r.root, r.hops): r.n for r in found.counts().collect()} == counts
    nodes = spark.createDataFrame([node(n, file=f"d{int(n[1:]) % 9}/{n}.py") for n in names[:-5]], NODE)
    for r in graph.blast_radius(e, nodes, seeds.dropna(), 3).collect():
        callers = plain(back, r.uid)
        modules = {int(u[1:]) % 9 for u in callers if u in names[:-5]}
        assert (r.direct, r.transitive, r.modules) == (sum(h == 1 for h in callers.values()), len(callers), len(modules))
    assert graph.reach(e, seeds.filter("false"), 3).counts().collect() == []


@pytest.mark.parametrize("seed", [5, 6])
def test_nearest_entrypoint_paths(spark, seed):
    """The path is the one that a search back over sorted callers meets first."""
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(20)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(45)}
    weight = {p: rnd.choice([0.35, 0.55, 1.0]) for p in pairs}
    e = graph.merge_edges(edges_of(spark, [(a, b, "CALLS", ["p"], weight[a, b]) for a, b in sorted(pairs)] + [("n00", "n19", "READS", ["p"], 1.0)]))
    entries = {"n00", "n01", "n02"}

    def back(uid):
        if uid in entries:
            return [uid], 1.0
        queue, seen = [([uid], 1.0)], {uid}
        while queue:
            path, c = queue.pop(0)
            for caller in sorted(a for a, b in pairs if b == path[0]):
                if caller not in seen:
                    seen.add(caller)
                    new = [caller, *path], min(c, weight[caller, path[0]])
                    if caller in entries:
                        return new
                    if len(new[0]) < 12:
                        queue.append(new)
        return None, None

    nodes = spark.createDataFrame([node(n) for n in names], NODE)
    got = graph.reachability(nodes, e, spark.createDataFrame([(n,) for n in sorted(entries)], "uid string"), kinds=("CALLS",))
    for r in graph.reachability_score(got).collect():
        path, c = back(r.uid)
        assert (r.path, r.confidence) == (path, c), r.uid
        called = any(b == r.uid for _, b in pairs)
        assert r.score == (round(max(0.4, 1 - 0.08 * (len(path) - 1)) * max(c, 0.5), 3) if path else 0.15 if called else 0.05)
    asked = spark.createDataFrame([("n00", n) for n in names[5:9]], "root string, uid string")
    some = {r.uid: r.path for r in graph.shortest_paths(e, spark.createDataFrame([("n00",)], "uid string"), 6, asked).collect()}
    every = {r.uid: r.path for r in graph.shortest_paths(e, spark.createDataFrame([("n00",)], "uid string"), 6).collect()}
    assert some == {u: p for u, p in every.items() if u in names[5:9]}


def test_dangling_and_orphans(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    e = edges_of(spark, [("a", "b", "K", ["p"], 1.0), ("a", "x", "K", ["p"], 1.0)])
    assert [(r.side, r.missing) for r in graph.dangling(nodes, e).collect()] == [("target", "x")]
    assert [r.uid for r in graph.orphans(nodes, e).collect()] == ["c"]


def test_no_nested_loops_in_interval_joins(spark):
    spans = spark.createDataFrame([("a", "u", 1, 2, 1)], "file string, uid string, start_line int, end_line int, seq int")
    points = spark.createDataFrame([("a", 1)], "file string, line int")
    plan = graph.innermost(points, spans)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_name_resolution_tiers(spark):
    symbols = spark.createDataFrame([("x/a.py:f", "x/a.py", "f"), ("x/b.py:f", "x/b.py", "f"), ("y/c.py:f", "y/c.py", "f"), ("y/d.py:f", "y/d.py", "f")], "uid string, file string, name string")
    calls = spark.createDataFrame([(1, "x/a.py:g", "x/a.py", "f"), (2, "y/e.py:g", "y/e.py", "f"), (3, "z/e.py:g", "z/e.py", "f")], "call_id int, caller string, file string, name string")
    got = {}
    for r in graph.resolve_names(calls, symbols).collect():
        got.setdefault(r.call_id, []).append((r.dst, r.confidence))
    assert sorted(got[1]) == [("x/a.py:f", 0.75)]
    assert sorted(got[2]) == [("y/c.py:f", 0.275), ("y/d.py:f", 0.275)]
    assert len(got[3]) == 3 and {c for _, c in got[3]} == {0.117}


def test_entrypoints(spark):
    nodes = [node("a", decorators=["@app.get('/x')"]), node("main"), node("on_load"), node("serve"), node("Dispatch"), node("serve_all"), node("b", decorators=["@pytest.mark.task"]), node("app", kind="class"), node("c", decorators=["@cli.command"]), node("LLVMFuzzerTestOneInput"), node("d", decorators=["x", "@Router.post('/')"])]
    got = {r.uid: r.entrypoint for r in graph.mark_entrypoints(spark.createDataFrame(nodes, NODE)).select("uid", "entrypoint").collect()}
    assert got == {"a": "http", "main": "cli", "on_load": None, "serve": "library", "Dispatch": "library", "serve_all": None, "b": None, "app": None, "c": None, "LLVMFuzzerTestOneInput": "cli", "d": "http"}


def test_rings(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdexyz"], "uid string")
    e = edges_of(spark, [("a", "b", "K", ["p"], 1.0), ("c", "b", "K", ["p"], 1.0), ("c", "d", "K", ["p"], 1.0), ("d", "e", "K", ["p"], 1.0), ("x", "y", "K", ["p"], 1.0)])
    assert {r.uid: r.ring for r in graph.rings(nodes, e, "a", 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": 4, "y": 4, "z": 4}


def test_stats_of_nothing(spark):
    out = graph.graph_stats(spark.createDataFrame([], NODE), graph.merge_edges(spark.createDataFrame([], EDGE))).filter(F.col("metric") == "resolved_ratio").head()
    assert out.value is None


def brute_resolve(calls, symbols):
    pairs, out = {}, []
    for call, caller, file, name in calls:
        pairs.setdefault(call, []).extend((1 if f == file else 2 if f.rpartition("/")[0] == file.rpartition("/")[0] else 3, u) for u, f, n in symbols if n == name and u != caller)
    for call, own in pairs.items():
        best = sorted(x for x in own if x[0] == min(own)[0])
        out += [(call, u, t, round({1: 0.75, 2: 0.55, 3: 0.35}[t] / min(len(best), 3), 3)) for t, u in best[:3]]
    return sorted(out)


def test_resolve_names_against_brute_force(spark):
    rnd = random.Random(6)
    file = lambda: f"d{rnd.randrange(3)}/f{rnd.randrange(3)}"
    symbols = [(u, file(), f"n{rnd.randrange(9)}") for u in range(60)]
    calls = [(i % 350, rnd.choice([-1, rnd.randrange(60)]), file(), f"n{rnd.randrange(10)}") for i in range(400)]
    got = graph.resolve_names(spark.createDataFrame(calls, "call_id long, caller long, file string, name string"), spark.createDataFrame(symbols, "uid long, file string, name string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_resolve(calls, symbols)


def test_resolve_names_reads_whole_tables(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    symbols = [(p, f"d{z % 5}/f{p % 11}", b) for p, z, b in spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_brand").collect()]
    calls = {(o * 10 + n, -1, f"d{s % 5}/f{p % 11}", f"Brand#{p % 5 + 1}{s % 5 + 1}") for o, n, p, s in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()}
    assert sorted(tuple(r) for r in entry.queries()["resolve_names"](spark, d).collect()) == brute_resolve(calls, symbols)


def test_root_cause_claims_every_line_item(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    assert entry.queries()["root_cause_band"](spark, d).count() == spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()


def test_closure_of_the_whole_event_log(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    users = [r.user_id for r in spark.read.parquet(f"{d}/events.parquet").orderBy("ts", "event_id").collect()]
    steps, want = {}, set()
    for a, b in zip(users, users[1:]):
        steps.setdefault(a, set()).add(b)
    for root in set(users):
        hops, level = {root: 0}, {root}
        for h in range(1, 7):
            level = {b for a in level for b in steps.get(a, ())} - set(hops)
            hops |= dict.fromkeys(level, h)
        want |= {(root, h, sum(x == h for x in hops.values())) for h in set(hops.values()) - {0}}
    got = [tuple(r) for r in entry.queries()["closure_cyclic"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_affected_and_boundaries_read_whole_tables(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    symbols = entry.queries()["affected_closure"](spark, d).filter("kind = 'symbol'").count()
    assert symbols == spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 10 = 3").count()
    assert entry.queries()["boundary_values"](spark, d).count() == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_closure_cyclic_gives_every_pair(spark):
    """a row a pair of users, not counts by steps."""
    from provark.plans.graph_queries import closure_cyclic

    d = "/root/testdata/sf0.001"
    rows = closure_cyclic(spark, d).collect()
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count()
    assert {tuple(r.asDict()) for r in rows} == {("root", "uid", "hops")}
    assert len(rows) == len({(r.root, r.uid) for r in rows}) == users * (users - 1)


def test_orphans_query_groups_no_edges(spark):
    """ends of edges are those of the raw ones; no task gathers all pairs of its split to merge them first."""
    from provark.plans.graph_queries import orphans

    plan = orphans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_innermost_over_many_levels_deals_points_once_a_group(spark):
    """Spans of all lengths against brute force, with fewer joins than levels."""
    import random

    pick = random.Random(7)
    made = [(("a", "b")[i % 2], f"s{i}", a, a + pick.choice((0, 3, 60, 900, 40_000)), i) for i in range(120) for a in [pick.randrange(0, 50_000)]]
    at = [(("a", "b", "c")[i % 3], pick.randrange(0, 90_000)) for i in range(300)] + [("a", None)]
    spans = spark.createDataFrame(made, "file string, uid string, start_line long, end_line long, seq long")
    found = graph.innermost(spark.createDataFrame(at, "file string, line long"), spans)
    def want(file, line):
        held = [s for s in made if s[0] == file and line is not None and s[2] <= line <= s[3]]
        return max(held, key=lambda s: (s[2], -s[4]))[1] if held else None
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame([(f, x, want(f, x)) for f, x in at], "file string, line long, owner string").collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_every_pair_in_tiles(spark, monkeypatch):
    """pairs as by reach, over narrow tiles, several parts of edges, cycles, null ends and a node of many sources."""
    import random

    from provark.operators import reach

    pick = random.Random(3)
    made = [(pick.randrange(300), pick.randrange(300)) for _ in range(500)] + [(k, 7) for k in range(300)] + [(5, 5), (None, 3), (4, None), (900, 901)]
    edges = spark.createDataFrame(made, "src long, dst long")
    seeds = spark.createDataFrame([(k,) for k in range(0, 300, 2)] + [(900,), (5000,), (None,)], "uid long")
    want = {(int(r.root), int(r.uid), r.hops) for r in reach.reach(edges.selectExpr("string(src) src", "string(dst) dst"), seeds.selectExpr("string(uid) uid"), 5).pairs().filter("root <> uid").collect()}
    monkeypatch.setattr(reach, "_PART", 300)
    monkeypatch.setattr(reach, "_TILE", 320)
    got = [tuple(r) for r in reach.every_pair(edges, seeds, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_closure_cyclic_moves_no_row_an_edge_and_block(spark):
    """levels are products of tiles; rows of edges joined with bits were what filled the disk."""
    from provark.plans.graph_queries import closure_cyclic

    plan = closure_cyclic(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "front" in plan and "bit_get" not in plan


def test_every_pair_deals_no_edge_to_every_tile(spark, monkeypatch):
    """a long chain makes many tiles, of which each needs the edges from its own front only."""
    from provark.operators import reach

    plans, put = [], reach.stored
    monkeypatch.setattr(reach, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "tiles" else None, put(df, name))[1])
    monkeypatch.setattr(reach, "_TILE", 64)
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "src long, dst long")
    got = {tuple(r) for r in reach.every_pair(edges, spark.range(0, 401).toDF("uid"), 3).collect()}
    assert got == {(k, k + h, h) for k in range(400) for h in (1, 2, 3) if k + h <= 400}
    assert len(plans) == 4 and not any("Generate" in x for x in plans)
