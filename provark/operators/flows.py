"""Flows from sources to sinks: pairing through the closure, confidences, boundaries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.operators.rules import severity_rank


def pair_flows(sources: DataFrame, sinks: DataFrame, paths: DataFrame, cap: int = 20_000) -> DataFrame:
    """source_ref, sink_ref, path, confidence ...: pairs whose owners a path joins, best first, at most `cap`.

    sources, sinks: ref, owner, confidence. paths: root, uid, path, confidence, providers. The pairs come
    out of two equi-joins with the paths, never from all sources by all sinks; the cap is the feature."""
    left = sources.select(F.col("ref").alias("source_ref"), F.col("owner").alias("root"), F.col("confidence").alias("source_confidence"))
    right = sinks.select(F.col("ref").alias("sink_ref"), F.col("owner").alias("uid"), F.col("confidence").alias("sink_confidence"))
    found = left.join(paths.select("root", "uid", "path", F.col("confidence").alias("path_confidence")), "root").join(right, "uid")
    return found.orderBy(F.desc("source_confidence"), F.desc("sink_confidence"), "source_ref", "sink_ref").limit(cap)


def coalesce_paths(resolved: DataFrame, union: DataFrame) -> DataFrame:
    """root, uid, path, precision: the resolved path where there is one, else the union's."""
    a = resolved.select("root", "uid", F.col("path").alias("_r"))
    b = union.select("root", "uid", F.col("path").alias("_u"))
    return a.join(b, ["root", "uid"], "full").select("root", "uid", F.coalesce("_r", "_u").alias("path"), F.when(F.col("_r").isNotNull(), "resolved").otherwise("union").alias("precision"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def taint_confidence(prior: Column, hops: Column, interpolated: Column, validated: Column, sanitized: Column) -> Column:
    bonus = F.when(interpolated, 0.15).otherwise(0.0) - F.when(validated, 0.15).otherwise(0.0) - F.when(sanitized, 0.35).otherwise(0.0)
    return F.round(clamp(prior + bonus - F.least(F.lit(0.2), 0.03 * hops), 0.05, 0.95), 3)


def call_path_confidence(source: Column, sink: Column, resolved: Column, nodes: Column, sanitized: Column) -> Column:
    base = F.least(source, sink) * F.when(resolved, 1.0).otherwise(0.6) * F.greatest(F.lit(0.4), 1 - 0.08 * F.greatest(F.lit(0), nodes - 2))
    return F.round(clamp(base * F.when(sanitized, 0.55).otherwise(1.0), 0.05, 0.9), 3)


def proximity_confidence(source: Column, sink: Column) -> Column:
    return F.least(source, sink) * 0.5


def surface_priority(flows: DataFrame) -> DataFrame:
    """flows with factors (a struct) and priority, their product to 6 places.

    Columns: severity, controllability (direct, indirect, weak), reachable, measured, confidence, controls,
    sanitized, covered. Unmeasured reachability takes the severity's own share, so that nothing sinks
    only because nobody looked."""
    share = severity_rank(F.col("severity")) / 5
    factors = F.struct(
        share.alias("severity"),
        F.when(F.col("controllability") == "direct", 1.0).when(F.col("controllability") == "indirect", 0.7).otherwise(0.4).alias("controllability"),
        F.when(~F.col("measured"), share).when(F.col("reachable"), 1.0).otherwise(0.25).alias("reach"),
        F.greatest(F.lit(0.05), F.col("confidence")).alias("confidence"),
        F.when(F.col("controls"), 0.6).otherwise(1.0).alias("controls"),
        F.when(F.col("sanitized"), 0.7).otherwise(1.0).alias("sanitizer"),
        F.when(F.col("covered"), 0.85).otherwise(1.0).alias("coverage"),
    )
    out = flows.withColumn("factors", factors)
    product = F.lit(1.0)
    for name in ("severity", "controllability", "reach", "confidence", "controls", "sanitizer", "coverage"):
        product = product * F.col(f"factors.{name}")
    return out.withColumn("priority", F.round(product, 6))


def hypothesis_priority(reach: Column, confidence: Column, radius: Column, measured: Column, severity: Column) -> Column:
    """reach x confidence x radius with floors of .01; unmeasured: severity x confidence, which never inverts ranks."""
    floor = lambda c: F.greatest(F.lit(0.01), c)
    return F.when(measured, floor(reach) * floor(confidence) * floor(radius)).otherwise(severity_rank(severity) / 5 * floor(confidence))


def boundaries(source_kind: Column, sink_kind: Column, by_source: dict[str, str], by_sink: dict[str, str]) -> Column:
    """Trust boundaries of both ends: distinct, the source's first."""
    of = lambda kind, table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[kind]
    return F.array_distinct(F.array_compact(F.array(of(source_kind, by_source), of(sink_kind, by_sink))))


def covering_tests(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """flow_ref, tests: distinct tests of any element of a flow's path, sorted. edges: src TESTED_BY dst."""
    steps = flows.select("flow_ref", F.explode("path").alias("src"))
    tests = edges.filter("kind = 'TESTED_BY'").select("src", F.col("dst").alias("test"))
    return steps.join(tests, "src").groupBy("flow_ref").agg(F.array_sort(F.collect_set("test")).alias("tests"))


def on_path(flows: DataFrame, roles: DataFrame) -> DataFrame:
    """flow_ref, refs: sanitizers or validators (ref, owner) whose owner lies on the path, sorted."""
    steps = flows.select("flow_ref", F.explode("path").alias("owner"))
    return steps.join(roles, "owner").groupBy("flow_ref").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def score_flow(confidence: Column, measured: Column, reachable: Column) -> Column:
    """Halved where unreachability was measured."""
    return F.when(measured & ~reachable, confidence * 0.5).otherwise(confidence)


def top_flows(flows: DataFrame, k: int = 2000) -> DataFrame:
    """Reachable first, then severity, confidence and ref; the cut keeps the best by this order."""
    return flows.orderBy(F.desc("reachable"), F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "ref").limit(k)


def best_flows(flows: DataFrame) -> DataFrame:
    """One flow a ref: the higher confidence, then the first."""
    return flows.groupBy("ref").agg(F.max_by(F.struct(*[c for c in flows.columns if c != "ref"]), F.struct("confidence", -F.col("seq"))).alias("b")).select("ref", "b.*")


def flow_endpoints(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes and those that flows name but nobody made, so that no reference dangles."""
    ends = flows.select(F.col("source_ref").alias("ref")).union(flows.select(F.col("sink_ref").alias("ref"))).distinct()
    missing = ends.join(nodes, "ref", "left_anti")
    return nodes.unionByName(missing.withColumn("kind", F.lit("inferred")), allowMissingColumns=True)


def best_match(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """findings (id, file, line) with the flow that starts at the same line, else the first of the file.

    Each place and each file has one flow to give, so findings meet two rows at most."""
    first = lambda name: F.min_by("ref", F.struct("seq", "ref")).alias(name)
    own = flows.filter("ref is not null")
    found = findings.select("id", "file", "line").distinct()
    found = found.join(own.groupBy("file", "line").agg(first("_at")), ["file", "line"], "left").join(own.groupBy("file").agg(first("_in")), "file", "left")
    return found.select("id", "file", "line", F.coalesce("_at", "_in").alias("flow_ref"))


def match_clause(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """findings (id, kind, file, function) with a clause (clause_id, kind, file, function, seq): of the same
    function the first, else of the same file the last, else the first of the kind.

    Each function, file and kind has one clause to give, so findings meet three rows at most."""
    own = clauses.filter("clause_id is not null")
    first, last = F.min_by("clause_id", F.struct("seq", "clause_id")), F.max_by("clause_id", F.struct("seq", "clause_id"))
    found = findings.select("id", "kind", "file", "function").distinct()
    for keys, pick, name in ((["kind", "file", "function"], first, "_function"), (["kind", "file"], last, "_file"), (["kind"], first, "_kind")):
        found = found.join(own.groupBy(*keys).agg(pick.alias(name)), keys, "left")
    return found.select("id", "kind", "file", "function", F.coalesce("_function", "_file", "_kind").alias("clause_id"))


def within_budget(items: DataFrame, budget: int, by: str, order: list[str], size: str = "size") -> DataFrame:
    """items with kept: a section's items in order of priority as long as their sizes add up to the budget."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("total", total).withColumn("kept", F.col("total") <= budget)


def specificity(clauses: DataFrame, key: str = "id") -> DataFrame:
    """The most specific clause of each key: the best score, then the first."""
    return clauses.groupBy(key).agg(F.max_by("clause_id", F.struct("score", -F.col("seq"))).alias("clause_id"))


def testability(kind: Column) -> Column:
    """Entrypoints of a program or a route are driven directly, those of a library need a harness."""
    return F.when(kind.isin("http", "cli"), "direct").when(kind == "library", "harness").otherwise("unknown")


def triage(confidence_cwe: Column, reachable: Column, callers: Column) -> Column:
    """.55, .2 more with a class, .15 if reachable, .02 a caller up to .1; at most .97."""
    value = 0.55 + F.when(confidence_cwe != "", 0.2).otherwise(0.0) + F.when(reachable, 0.15).otherwise(0.0) + F.least(F.lit(0.1), 0.02 * callers)
    return F.round(F.least(F.lit(0.97), value), 2)


#: Fixed value: how many raw findings are looked at.
MOST_TRIAGED = 40


def triaged(findings: DataFrame, classes: DataFrame, most: int = MOST_TRIAGED) -> DataFrame:
    """rule_id, location, cwe, severity, clause_kind, confidence of the first `most` findings (seq, rule_id, location,
    reachable, callers). classes: rule_id, cwe, severity, clause_kind, one row a rule; a rule that has none is of MEDIUM
    severity and no class. The cut comes before the lookup, so it is the report's and not the rules'."""
    first = findings.orderBy("seq").limit(most)
    known = first.join(classes, "rule_id", "left")
    value = triage(F.coalesce("cwe", F.lit("")), F.coalesce("reachable", F.lit(False)), F.greatest(F.lit(0), F.coalesce("callers", F.lit(0))))
    none = lambda c, default="": F.coalesce(c, F.lit(default)).alias(c)
    return known.select("rule_id", F.substring("location", 1, 300).alias("location"), none("cwe"), none("severity", "MEDIUM"), none("clause_kind"), value.alias("confidence"))


def security_stats(flows: DataFrame) -> DataFrame:
    """metric, key, flows, reachable, sanitized: flows by source kind, by sink kind and by basis."""
    def by(metric: str) -> DataFrame:
        own = flows.groupBy(F.col(metric).alias("key"))
        return own.agg(F.count("*").alias("flows"), F.count_if("reachable").alias("reachable"), F.count_if("sanitized").alias("sanitized")).select(F.lit(metric).alias("metric"), "key", "flows", "reachable", "sanitized")

    return by("source_kind").union(by("sink_kind")).union(by("basis"))
