"""The read tools: bounded questions over a model of tables, each a filter on what was computed once.

Every tool returns rows with `truncated` where more would have come; absence is said, never shown as 0."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.functions.text import dirname, lines_of
from provark.operators import graph, kpi
from provark.operators.rules import severity_rank

#: The most rows, hits and lines of one answer.
ROWS, HITS, LINES = 40, 30, 160


@dataclass(frozen=True)
class Model:
    """Tables that the tools read; a missing one answers as absent."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None  # path, text
    roles: DataFrame | None = None  # ref, category, kind, file, line, owner, severity, confidence
    flows: DataFrame | None = None  # ref, source_ref, sink_ref, path, file, reachable, measured, severity, confidence
    paths: DataFrame | None = None  # root, uid, path, precision
    settings: DataFrame | None = None
    dependencies: DataFrame | None = None
    observations: DataFrame | None = None
    coverage: DataFrame | None = None  # file, line
    boundaries: DataFrame | None = None


class Absent(LookupError):
    """The model has no such table: not the same as an empty answer."""


def _need(table: DataFrame | None, what: str) -> DataFrame:
    if table is None:
        raise Absent(what)
    return table


def get_file(m: Model, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    rows = _need(m.files, "files").filter(F.col("path") == path).select(F.posexplode(lines_of(F.col("text"))).alias("at", "content"))
    end = min(end or start + LINES - 1, start + LINES - 1)
    return rows.select((F.col("at") + 1).alias("line"), "content").filter(F.col("line").between(start, end)).orderBy("line")


def get_function(m: Model, uid: str) -> DataFrame:
    own = m.nodes.filter((F.col("uid") == uid) & F.col("kind").isin(*graph.CALLABLE))
    return own.join(graph.neighbours(m.edges.filter((F.col("src") == uid) | (F.col("dst") == uid))), "uid", "left")


def get_class(m: Model, uid: str) -> DataFrame:
    members = graph.out_edges(m.edges, uid, ("CONTAINS", "HAS_METHOD")).select(F.col("dst").alias("uid"))
    return kpi.capped(m.nodes.join(members, "uid", "left_semi").orderBy("uid"), ROWS)


def get_callers(m: Model, uid: str) -> DataFrame:
    return kpi.capped(graph.in_edges(m.edges, uid, ("CALLS",)).select(F.col("src").alias("uid"), "confidence").orderBy("uid"), ROWS)


def get_callees(m: Model, uid: str) -> DataFrame:
    return kpi.capped(graph.out_edges(m.edges, uid, ("CALLS",)).select(F.col("dst").alias("uid"), "confidence").orderBy("uid"), ROWS)


def get_imports(m: Model, uid: str) -> DataFrame:
    return kpi.capped(graph.out_edges(m.edges, uid, ("IMPORTS",)).select(F.col("dst").alias("uid")).orderBy("uid"), ROWS)


def get_dependents(m: Model, uid: str, depth: int = 6) -> DataFrame:
    seed = m.nodes.sparkSession.createDataFrame([(uid,)], "uid string")
    return kpi.capped(graph.closure(m.edges.filter("kind = 'CALLS'"), seed, depth, reverse=True).select("uid", "hops").orderBy("hops", "uid"), ROWS)


def get_siblings(m: Model, uid: str) -> DataFrame:
    folder = m.nodes.filter(F.col("uid") == uid).select(dirname(F.col("file")).alias("_dir"))
    near = m.nodes.withColumn("_dir", dirname(F.col("file"))).join(folder, "_dir", "left_semi").drop("_dir")
    return graph.siblings(near, ROWS).filter(F.col("uid") == uid).orderBy("rank")


def get_execution_path(m: Model, source: str, target: str) -> DataFrame:
    return _need(m.paths, "paths").filter((F.col("root") == source) & (F.col("uid") == target))


def get_dataflow(m: Model, uid: str) -> DataFrame:
    return kpi.capped(_need(m.flows, "flows").filter(F.array_contains("path", uid)).orderBy(F.desc("confidence"), "ref"), ROWS)


def _roles(m: Model, *categories: str) -> DataFrame:
    rows = _need(m.roles, "roles").filter(F.col("category").isin(*categories))
    return kpi.capped(rows.orderBy(F.desc("confidence"), "ref"), ROWS)


def get_sources(m: Model) -> DataFrame:
    return _roles(m, "source")


def get_sinks(m: Model) -> DataFrame:
    return _roles(m, "sink")


def get_sanitizers(m: Model) -> DataFrame:
    return _roles(m, "sanitizer", "validator")


def get_controls(m: Model) -> DataFrame:
    return _roles(m, "control")


def get_trust_boundaries(m: Model) -> DataFrame:
    return kpi.capped(_need(m.boundaries, "boundaries").distinct(), ROWS)


def get_security_candidates(m: Model, k: int = ROWS) -> DataFrame:
    return _need(m.flows, "flows").orderBy(F.desc("reachable"), F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), "ref").limit(min(k, ROWS))


def get_related_tests(m: Model, uid: str) -> DataFrame:
    return kpi.capped(graph.out_edges(m.edges, uid, ("TESTED_BY",)).select(F.col("dst").alias("test")).distinct().orderBy("test"), ROWS)


def get_coverage(m: Model, file: str) -> DataFrame:
    """available, covered: where no run measured coverage, available is false and covered null."""
    if m.coverage is None:
        return m.nodes.sparkSession.createDataFrame([(False, None)], "available boolean, covered long")
    return m.coverage.filter(F.col("file") == file).agg(F.lit(True).alias("available"), F.count_distinct("line").alias("covered"))


def get_runtime_observations(m: Model, scope: str) -> DataFrame:
    return kpi.capped(_need(m.observations, "observations").filter(F.col("scope") == scope).orderBy("seq"), ROWS)


def get_configuration(m: Model) -> DataFrame:
    return kpi.capped(_need(m.settings, "settings").orderBy("id", "line"), ROWS)


def get_dependencies(m: Model, ecosystem: str | None = None) -> DataFrame:
    rows = _need(m.dependencies, "dependencies")
    return kpi.capped((rows.filter(F.col("ecosystem") == ecosystem) if ecosystem else rows).orderBy("ecosystem", "name"), ROWS)


def get_architecture_summary(m: Model) -> DataFrame:
    own = m.nodes.groupBy(graph.dirname(F.col("file")).alias("module"))
    return kpi.capped(own.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind").isin(*graph.CALLABLE)).alias("callables")).orderBy(F.desc("callables"), "module"), ROWS)


def search_symbols(m: Model, needle: str) -> DataFrame:
    return graph.search_symbols(m.nodes, needle, ROWS)


def search_code(m: Model, needle: str) -> DataFrame:
    """path, line, content, owner: lines that contain a text, with the innermost callable around each."""
    rows = _need(m.files, "files").select(F.col("path").alias("file"), F.posexplode(lines_of(F.col("text"))).alias("at", "content"))
    hits = rows.filter(F.contains("content", F.lit(needle))).select("file", (F.col("at") + 1).alias("line"), "content").orderBy("file", "line").limit(HITS)
    return graph.innermost(hits, m.nodes.filter(F.col("kind").isin(*graph.CALLABLE))).orderBy("file", "line")


TOOLS: dict[str, Callable] = {
    f.__name__: f
    for f in (get_file, get_function, get_class, get_callers, get_callees, get_imports, get_dependents, get_siblings, get_execution_path, get_dataflow, get_sources, get_sinks, get_sanitizers, get_controls, get_trust_boundaries, get_security_candidates, get_related_tests, get_coverage, get_runtime_observations, get_configuration, get_dependencies, get_architecture_summary, search_symbols, search_code)
}


def classify_application(facts: DataFrame) -> DataFrame:
    """facts (routes, commands, exported, tests, containers) with type and evidence, by ordered rules."""
    kind = F.when(F.col("routes") > 0, "web service").when(F.col("commands") > 0, "command line").when(F.col("exported") > 0, "library").otherwise("unknown")
    told = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}")))
    return facts.withColumns({"type": kind, "evidence": F.array_compact(F.array(told("routes", "routes"), told("commands", "commands"), told("exported", "exported symbols"), told("containers", "containers")))})


def gaps(facts: DataFrame) -> DataFrame:
    """facts with gaps: what is unknown, in a fixed order; an unmeasured count (null) is a gap of its own."""
    gap = lambda c, label: F.when(F.col(c).isNull(), F.lit(f"{label}: not measured")).when(F.col(c) == 0, F.lit(f"{label}: none found"))
    return facts.withColumn("gaps", F.array_compact(F.array(gap("routes", "routes"), gap("tests", "tests"), gap("containers", "containers"))))
