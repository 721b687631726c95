"""Provenance graphs on DataFrames: merging, neighbours, closures, paths, reachability, scores.

nodes: uid, kind, name, qualname, file, start_line, end_line, language, exported, signature, parameters,
decorators, docline, provenance, attrs, seq. edges: src, dst, kind, provenance, confidence, attrs, seq.
`seq` is the order of insertion: every "first" is the least of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import digest, dirname, merge_maps
from provark.operators.reach import reach, search
from provark.plans.storage import stored

#: The providers that resolve, and the kinds that say nothing.
RESOLVING = ("gitnexus", "runtime", "semgrep")
VAGUE = ("unknown", "symbol")
CALLABLE = ("function", "method")


def union_sets(column: str) -> Column:
    """Distinct members of a group's arrays, sorted. A group is one entity's providers: bounded."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def first_filled(column: str) -> Column:
    value = F.col(column)
    empty = F.length(value.cast("string")) == 0
    return F.min_by(value, F.when(value.isNotNull() & ~empty, F.col("seq")))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a uid: the more informative value of each field, by order of seq; provenance united; the
    widest end line; exported if anyone says so; the last attrs win; a vague kind yields to a specific one."""
    vague = F.lower("kind").isin(*VAGUE)
    kind = F.coalesce(F.min_by("kind", F.when(~vague, F.col("seq"))), F.min_by("kind", "seq"))
    listed = lambda c: F.min_by(c, F.when(F.size(c) > 0, F.col("seq")))
    maps = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.map_entries("attrs").alias("e")))), lambda s: F.map_from_entries(s["e"]))
    attrs = F.aggregate(maps, F.create_map().cast("map<string,string>"), merge_maps)
    return nodes.groupBy("uid").agg(
        kind.alias("kind"),
        *[first_filled(c).alias(c) for c in ("name", "qualname", "file", "language", "signature", "docline")],
        F.min_by("start_line", F.when(F.col("start_line") > 0, F.col("seq"))).alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.bool_or("exported").alias("exported"),
        listed("parameters").alias("parameters"),
        listed("decorators").alias("decorators"),
        union_sets("provenance").alias("provenance"),
        attrs.alias("attrs"),
        F.min("seq").alias("seq"),
    )


def resolved(provenance: Column) -> Column:
    return F.arrays_overlap(provenance, F.array(*map(F.lit, RESOLVING)))


def merge_edges(edges: DataFrame, resolving_only: bool = False) -> DataFrame:
    """One row a (src, kind, dst): provenance united, the best confidence, 1.0 where several providers agree
    (with `resolving_only`, only where one of them resolves), whether it is resolved, and the last attrs if there are any."""
    attrs = [F.max_by("attrs", "seq").alias("attrs")] if "attrs" in edges.columns else []
    merged = edges.groupBy("src", "kind", "dst").agg(union_sets("provenance").alias("provenance"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq"), *attrs)
    agreed = F.size("provenance") > 1
    promoted = agreed & resolved(F.col("provenance")) if resolving_only else agreed
    return merged.withColumns({"confidence": F.when(promoted, 1.0).otherwise(F.col("confidence")), "resolved": resolved(F.col("provenance"))})


def merge_report(edges: DataFrame) -> DataFrame:
    """One row over merged edges: total, corroborated, resolved by one provider alone, matched by name only."""
    several = F.size("provenance") > 1
    return edges.agg(
        F.count("*").alias("edges_total"),
        F.count_if(several).alias("edges_corroborated"),
        F.count_if(F.col("resolved") & ~several).alias("edges_resolved_only"),
        F.count_if(~F.col("resolved")).alias("edges_name_only"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, value: counts by node kind, edge kind, provider and language, and the resolved ratio."""
    count = lambda df, metric, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    providers = edges.select(F.explode("provenance").alias("provider"))
    ratio = edges.agg(F.round(F.try_divide(F.count_if(resolved(F.col("provenance"))), F.count("*")), 4).alias("value")).select(F.lit("resolved_ratio").alias("metric"), F.lit("all").alias("key"), "value")
    parts = [count(nodes, "node_kind", "kind"), count(edges, "edge_kind", "kind"), count(providers, "provider", "provider"), count(nodes.filter("language is not null"), "language", "language"), ratio]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nodes_of(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds)).orderBy("uid")


def admitted(edges: DataFrame, precision: str = "union") -> DataFrame:
    """Edges that a precision admits: all for union, resolved ones for resolved."""
    return edges if precision == "union" else edges.filter(resolved(F.col("provenance")))


def out_edges(edges: DataFrame, uid: str, kinds: Iterable[str] = (), precision: str = "union") -> DataFrame:
    own = admitted(edges, precision).filter(F.col("src") == uid)
    return own.filter(F.col("kind").isin(*kinds)) if kinds else own


def in_edges(edges: DataFrame, uid: str, kinds: Iterable[str] = (), precision: str = "union") -> DataFrame:
    own = admitted(edges, precision).filter(F.col("dst") == uid)
    return own.filter(F.col("kind").isin(*kinds)) if kinds else own


def search_symbols(nodes: DataFrame, needle: str, limit: int = 40) -> DataFrame:
    """Substring of name, qualname or uid in lower case; exact names first, then short uids."""
    n = F.lit(needle.lower().strip())
    hit = F.contains(F.lower("name"), n) | F.contains(F.lower("qualname"), n) | F.contains(F.lower("uid"), n)
    return nodes.filter(hit & (n != "")).orderBy(F.lower("name") != n, F.length("uid"), "uid").limit(limit)


def neighbours(edges: DataFrame, kind: str = "CALLS") -> DataFrame:
    """uid, callees, callers: distinct neighbours by an edge kind, sorted."""
    own = edges.filter(F.col("kind") == kind)
    out = own.groupBy(F.col("src").alias("uid")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    into = own.groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    none = F.array().cast("array<string>")
    return out.join(into, "uid", "full").select("uid", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def closure(edges: DataFrame, seeds: DataFrame, depth: int = 6, reverse: bool = False, together: bool = False) -> DataFrame:
    """root, uid, hops: what each seed (column uid) reaches within `depth` steps, itself left out; with `together`
    what any of them reaches, under one empty root.

    Roots travel as bits (see reach); pairs are made of them at the end. Who needs counts only asks reach for those."""
    return reach(edges, seeds, depth, reverse, together).pairs()


def shortest_paths(edges: DataFrame, sources: DataFrame, max_nodes: int = 11, asked: DataFrame | None = None) -> DataFrame:
    """root, uid, path, confidence, providers: a shortest path from each source to whatever it reaches, or to what is
    asked for (root, uid).

    Among shortest paths the least one stays, which is what a first-in-first-out search over sorted
    neighbours finds. confidence is the weakest hop of that path; providers are united over it."""
    return search(edges, sources, max_nodes).paths(asked)


def reachability(nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, precision: str = "union", max_nodes: int = 12, kinds: Iterable[str] = (), paths: bool = True) -> DataFrame:
    """uid, reachable, measured, hops, confidence, called, and path and providers if `paths`, for every node.

    One search from all entrypoints at once over edges of the kinds given (all without); of equally short paths a node has
    the one that a search back from it over sorted callers meets first, confidence is that path's weakest hop. called: an
    edge of those kinds leads to the node, at any precision. Without any entrypoint nothing is measured: reachable is
    false and measured too. Providers of an entrypoint itself are none."""
    measured = bool(entrypoints.head(1))
    own = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    tree = search(admitted(own, precision), entrypoints, max_nodes, nearest=True)
    seen = tree.found().drop("root")
    if paths:
        seen = seen.join(tree.paths().select("uid", "path", "providers"), "uid")
    called = own.select(F.col("dst").alias("uid")).distinct().withColumn("called", F.lit(True))
    found = nodes.select("uid").distinct().join(seen, "uid", "left").join(called, "uid", "left")
    told = ["path", "providers"] if paths else []
    return found.select("uid", F.col("hops").isNotNull().alias("reachable"), F.lit(measured).alias("measured"), "hops", "confidence", *told, F.coalesce("called", F.lit(False)).alias("called"))


def reachability_score(reach: DataFrame) -> DataFrame:
    """.05 unmeasured; unreachable .15 if anything calls it, else .05; else the hops' decay by confidence."""
    decay = F.greatest(F.lit(0.4), 1 - 0.08 * F.col("hops")) * F.greatest("confidence", F.lit(0.5))
    score = F.when(~F.col("measured"), 0.05).when(~F.col("reachable"), F.when(F.col("called"), 0.15).otherwise(0.05)).otherwise(decay)
    return reach.withColumn("score", F.round(score, 3))


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """uid, direct, transitive, modules, score: callers within `depth`, their directories, min(1, .2 + .03 n + .08 m).

    Callers and directories are counted as bits; no pair of a seed and a caller is made."""
    found = reach(edges, seeds, depth, reverse=True)
    counts = found.counts().groupBy(F.col("root").alias("uid")).agg(F.sum(F.when(F.col("hops") == 1, F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("transitive"))
    modules = found.groups(nodes.select("uid", dirname(F.col("file")).alias("label")).distinct()).select(F.col("root").alias("uid"), F.col("n").alias("modules"))
    out = seeds.select("uid").distinct().join(counts, "uid", "left").join(modules, "uid", "left").fillna(0, ["direct", "transitive", "modules"])
    return out.withColumn("score", F.round(F.least(F.lit(1.0), 0.2 + 0.03 * F.col("transitive") + 0.08 * F.col("modules")), 3))


def subgraph(edges: DataFrame, uid: str, depth: int = 2, limit: int = 200, directed: bool = False) -> DataFrame:
    """uid, hops of the neighbourhood of a node, nearest first and then by uid, at most `limit` nodes."""
    both = edges.select("src", "dst")
    both = both if directed else both.union(edges.select(F.col("dst"), F.col("src")))
    seed = edges.sparkSession.createDataFrame([(uid,)], "uid string")
    found = closure(both, seed, depth, together=True).select("uid", "hops").union(seed.select("uid", F.lit(0).alias("hops")))
    return found.groupBy("uid").agg(F.min("hops").alias("hops")).orderBy("hops", "uid").limit(limit)


def rings(nodes: DataFrame, edges: DataFrame, uid: str, depth: int = 6) -> DataFrame:
    """uid, ring of every node around one: steps along edges in either direction, and for what `depth` steps do not reach
    one ring further out than the last."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    seed = edges.sparkSession.createDataFrame([(uid,)], "uid string")
    found = closure(both, seed, depth, together=True).select("uid", "hops").union(seed.select("uid", F.lit(0).alias("hops")))
    met = stored(nodes.select("uid").distinct().join(found, "uid", "left"), "rings")
    last = met.agg(F.max("hops")).head()[0]
    return met.select("uid", F.coalesce("hops", F.lit(0 if last is None else last + 1)).alias("ring"))


def enriched(findings: DataFrame, symbols: DataFrame, edges: DataFrame, entrypoints: DataFrame, depth: int = 6) -> DataFrame:
    """findings (file, line) with owner (the innermost symbol), callers, reachable, measured, exposure and radius of it.

    callers: distinct ones over CALLS; exposure: reachability_score; radius: blast_radius. Without an owner they are null."""
    calls = stored(edges.filter("kind = 'CALLS'").select("src", "dst", "kind", "confidence", "provenance"), "calls")  # read by four steps
    owned = stored(innermost(findings, symbols), "owned")
    own = owned.select(F.col("owner").alias("uid")).dropna().distinct()
    called = calls.groupBy(F.col("dst").alias("owner")).agg(F.count_distinct("src").alias("callers"))
    reached = reachability_score(reachability(own, calls, entrypoints, paths=False)).select(F.col("uid").alias("owner"), "reachable", "measured", F.col("score").alias("exposure"))
    radius = blast_radius(calls, symbols, own, depth).select(F.col("uid").alias("owner"), F.col("score").alias("radius"))
    out = owned.join(called, "owner", "left").join(reached, "owner", "left").join(radius, "owner", "left")
    known = F.when(F.col("owner").isNotNull(), F.coalesce("callers", F.lit(0)))
    return out.select(*findings.columns, "owner", known.alias("callers"), "reachable", "measured", "exposure", "radius")


def siblings(nodes: DataFrame, limit: int = 40) -> DataFrame:
    """uid, sibling, tier, rank: others of the same file (1), then of the same directory (2), `limit` of them.

    A node meets only the first of its file and of its directory, never all of either: the first limit + 1 of each
    file, and of a directory the first 2 * limit of those, of which a file of its own can hold `limit` at most."""
    own = nodes.select("uid", "file", dirname(F.col("file")).alias("dir"))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("uid"))
    first = own.withColumn("_n", nth("file", "dir")).filter(F.col("_n") <= limit + 1)
    listed = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("uid", "file"))).alias(name))
    near = first.filter(F.col("_n") <= limit).withColumn("_n", nth("dir")).filter(F.col("_n") <= 2 * limit)
    met = own.join(listed(first, "file", "_file"), "file").join(listed(near, "dir", "_dir"), "dir")
    same = F.filter("_file", lambda s: s["uid"] != F.col("uid"))
    others = F.filter("_dir", lambda s: s["file"] != F.col("file"))
    tiered = lambda a, t: F.transform(a, lambda s: F.struct(s["uid"].alias("sibling"), F.lit(t).alias("tier")))
    every = met.select("uid", F.posexplode(F.slice(F.concat(tiered(same, 1), tiered(others, 2)), 1, limit)).alias("_at", "s"))
    return every.select("uid", "s.sibling", "s.tier", (F.col("_at") + 1).alias("rank"))


#: Fixed value: a block holds 2 ** _STEP of the next lower ones.
_STEP = 7


def _pieces(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _group, _top, _in: the spans (_start to _end) by blocks of 2 ** _STEP parts, a part of group g being 2 ** (_STEP * g)
    places. A span has a range of parts in two blocks a group at most: those before and after the whole blocks that it
    holds, which are parts of the next group. Of equal ranges in a block the best span stays, and of more than 2 ** _STEP
    ranges the best of each part, so _in, an array of (a, b, best), is no longer than that."""
    low = lambda g: f"shiftright(_start + shiftleft(1L, {_STEP} * ({g})) - 1, {_STEP} * ({g}))"
    high = lambda g: f"shiftright(_end + 1, {_STEP} * ({g}))"
    groups = f"transform(sequence(0, int((length(bin(_end + 1 - _start)) - 1) div {_STEP})), g -> struct(g, {low('g')} as low, {high('g')} as high, {low('g + 1')} as up, {high('g + 1')} as down))"
    left = f"struct(x.g, shiftright(x.low, {_STEP}) as top, int(x.low & {(1 << _STEP) - 1}) as a, int(least(x.high, shiftleft(x.up, {_STEP})) - shiftleft(shiftright(x.low, {_STEP}), {_STEP})) as b)"
    right = f"if(x.up <= x.down, struct(x.g, x.down as top, 0 as a, int(x.high - shiftleft(x.down, {_STEP})) as b), null)"
    ranges = F.expr(f"filter(flatten(transform({groups}, x -> array({left}, {right}))), y -> y is not null and y.a < y.b)")
    cut = spans.filter("_start <= _end").select(*keys, F.struct("_start", (-F.col("_seq")).alias("_seq"), "owner").alias("best"), F.explode(ranges).alias("r"))
    place = [*keys, "_group", "_top"]
    best = cut.groupBy(*keys, F.col("r.g").alias("_group"), F.col("r.top").alias("_top"), F.col("r.a").alias("a"), F.col("r.b").alias("b")).agg(F.max("best").alias("best"))
    rows = best.groupBy(*place).agg(F.collect_list(F.struct("a", "b", "best")).alias("_in"))
    parts = f"transform(sequence(0, {(1 << _STEP) - 1}), i -> struct(i as a, i + 1 as b, array_max(transform(filter(_in, x -> x.a <= i and i < x.b), x -> x.best)) as best))"
    return rows.select(*place, F.expr(f"if(size(_in) <= {1 << _STEP}, _in, filter({parts}, x -> x.best is not null))").alias("_in"))


def innermost(points: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("file",), at: str = "line", order: str = "seq") -> DataFrame:
    """points with the uid of the innermost span that holds them (null without one): the latest start, then
    the first inserted. points: keys, `at`; spans: keys, uid, start_line, end_line, seq.

    A span becomes ranges of parts of aligned blocks, two a group of seven levels at most, and a block is a row: a place looks
    up one row a group, by equality, and points are dealt out once for that. A file of many spans and many points costs
    their sum. Spans without an end are one line; places and ends are whole numbers."""
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    inner = spans.select(*keys, F.col("uid").alias("owner"), start.alias("_start"), F.coalesce(F.when(end > 0, end), start).alias("_end"), F.col(order).alias("_seq"))
    rows = stored(_pieces(inner, list(keys)), "blocks")
    groups = sorted(r[0] for r in rows.select("_group").distinct().collect())  # ten of them at most
    out, best = points.withColumn("_at", F.col(at).cast("long")), []
    for g in groups:
        own = rows.filter(F.col("_group") == g).select(*keys, "_top", F.col("_in").alias(f"_in{g}"))
        out = out.withColumn("_top", F.shiftright("_at", _STEP * (g + 1))).join(own, [*keys, "_top"], "left").drop("_top")
        part = f"(shiftright(_at, {_STEP * g}) & {(1 << _STEP) - 1})"
        out = out.withColumn(f"_in{g}", F.expr(f"array_max(transform(filter(_in{g}, x -> x.a <= {part} and {part} < x.b), x -> x.best))"))
        best.append(F.col(f"_in{g}"))
    owner = F.array_max(F.array_compact(F.array(*best)))["owner"] if best else F.lit(None).cast(spans.schema["uid"].dataType)
    return out.select(*points.columns, owner.alias("owner"))


def untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("src").alias("uid"))
    return nodes.filter(F.col("kind").isin(*CALLABLE)).join(tested, "uid", "left_anti")


def _targets(known: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, n_<tag>, to_<tag>: how many targets share the keys, and the four least of them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("dst"))
    least = known.withColumn("rank", rank).filter("rank <= 4").groupBy(*keys).agg(F.array_sort(F.collect_list("dst")).alias(f"to_{tag}"))
    return known.groupBy(*keys).agg(F.count("*").alias(f"n_{tag}")).join(least, keys)


def resolve_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, dst, confidence: a called name's targets in the nearest tier that has any: the same file
    (.75), else the same directory (.55), else anywhere (.35), divided by min(targets, 3); three at most.
    calls: call_id, caller, file, name; symbols: uid, file, name. A call to its own caller is none.

    One row a uid in symbols; rows of calls with the same call_id are one call from several places. Each row meets the counts and least targets of its file, directory and name,
    never all symbols of its name, so rows do not grow with the square of a name's share."""
    own = calls.filter("caller is not null").withColumn("dir", dirname(F.col("file")))
    known = symbols.select(F.col("uid").alias("dst"), "file", dirname(F.col("file")).alias("dir"), "name")
    self_ = known.select("name", F.col("dst").alias("caller"), F.col("file").alias("own_file"), F.col("dir").alias("own_dir"), F.lit(1).alias("own"))
    met = own.join(self_, ["name", "caller"], "left")
    scopes = {"file": ["name", "file"], "dir": ["name", "dir"], "any": ["name"]}
    for tag, keys in scopes.items():
        met = met.join(_targets(known, keys, tag), keys, "left")
    within = {"file": F.col("own_file") == F.col("file"), "dir": F.col("own_dir") == F.col("dir"), "any": F.col("own") == 1}
    n = {t: F.coalesce(f"n_{t}", F.lit(0)) - F.when(within[t], 1).otherwise(0) for t in scopes}
    pick = lambda f: F.when(n["file"] > 0, f("file", 1)).when(n["dir"] > 0, f("dir", 2)).when(n["any"] > 0, f("any", 3))
    found = met.select("call_id", "caller", pick(lambda t, k: F.lit(k)).alias("tier"), pick(lambda t, k: n[t]).alias("n"), pick(lambda t, k: F.col(f"to_{t}")).alias("to"))
    by = Window.partitionBy("call_id")
    near = found.withColumn("best", F.min("tier").over(by)).filter("tier = best").withColumn("n", F.sum("n").over(by))
    near = near.select("call_id", "tier", "n", F.explode(F.slice(F.filter("to", lambda x: x != F.col("caller")), 1, 3)).alias("dst"))
    near = near.withColumn("rank", F.row_number().over(by.orderBy("dst"))).filter("rank <= 3")
    prior = F.when(F.col("tier") == 1, 0.75).when(F.col("tier") == 2, 0.55).otherwise(0.35)
    return near.select("call_id", "dst", "tier", F.round(prior / F.least("n", F.lit(3)), 3).alias("confidence"))


#: Names of callables that a program or a library is entered by, and how decorators of routes begin.
PROGRAM = ("main", "lambda_handler", "llvmfuzzertestoneinput")
LIBRARY = ("handle", "handler", "entrypoint", "dispatch", "serve", "app")
ROUTES = ("@app.", "@router.", "@get", "@post", "@route")


def mark_entrypoints(nodes: DataFrame) -> DataFrame:
    """nodes with entrypoint: cli, library or http by exact names, then by the beginnings of decorators, in lower case;
    null for none and for classes. A name that only begins or ends like one is none: reachability hangs on it."""
    name = F.lower("name")
    given = F.coalesce("decorators", F.array().cast("array<string>"))
    at = lambda d: F.when(d.startswith("@"), d).otherwise(F.concat(F.lit("@"), d))
    routed = F.exists(given, lambda d: F.exists(F.array(*map(F.lit, ROUTES)), lambda r: F.startswith(F.lower(at(d)), r)))
    kind = F.when(name.isin(*PROGRAM), "cli").when(name.isin(*LIBRARY), "library").when(routed, "http")
    return nodes.withColumn("entrypoint", F.when(~F.col("kind").eqNullSafe("class"), kind))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the digest of a set of rows, whatever their order.

    A tree over the rows' digests by their leading characters, six, then three, then none: at most 4096 branches
    meet at an inner node, and a leaf holds a sixteen-millionth of all rows."""
    level = df.select(digest(*[F.col(c) for c in columns]).alias("h")).distinct().withColumn("b", F.col("h"))
    folded = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256)
    for wide in (6, 3):
        level = level.withColumn("g", F.substring("b", 1, wide)).groupBy("g").agg(folded.alias("h")).withColumnRenamed("g", "b")
    return level.agg(folded.alias("content_hash"))


def dangling(nodes: DataFrame, edges: DataFrame, uid: str = "uid", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with an endpoint that is no node: which end, and the missing id."""
    known = nodes.select(F.col(uid).alias("missing"))
    end = lambda c, side: edges.withColumns({"missing": F.col(c), "side": F.lit(side)}).join(known, "missing", "left_anti")
    return end(src, "source").unionByName(end(dst, "target"))


def orphans(nodes: DataFrame, edges: DataFrame, uid: str = "uid", src: str = "src", dst: str = "dst") -> DataFrame:
    used = edges.select(F.col(src).alias(uid)).union(edges.select(F.col(dst).alias(uid)))
    return nodes.join(used, uid, "left_anti")


def affected(changed: DataFrame, nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, depth: int = 6, cap: int = 4000) -> DataFrame:
    """What a change of files touches: kind (symbol, dependent, file, entrypoint) and uid.

    Dependents are what one search from all symbols at once finds beyond them; those beyond `cap` (by hops, then
    uid) are left out, as the report is bounded."""
    symbols = nodes.join(changed.select("file"), "file", "left_semi").select("uid")
    up = closure(edges, symbols, depth, reverse=True, together=True).orderBy("hops", "uid").limit(cap).select("uid")
    every = symbols.union(up).distinct()
    files = nodes.join(every, "uid", "left_semi").select(F.col("file").alias("uid")).distinct()
    label = lambda df, kind: df.select(F.lit(kind).alias("kind"), "uid")
    out = label(symbols, "symbol").union(label(up, "dependent")).union(label(files, "file"))
    return out.union(label(entrypoints.select("uid").join(every, "uid", "left_semi"), "entrypoint"))
