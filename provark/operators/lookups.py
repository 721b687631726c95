"""Small joins and filters of the query surface: list filters, roles, enrichment, references in text, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.operators.graph import closure


def list_runs(runs: DataFrame, status: str | None = None, project: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """Runs by any of the criteria, the newest first; limits are held to 1..200."""
    rows = runs
    for column, wanted in (("status", status), ("project_id", project)):
        if wanted is not None:
            rows = rows.filter(F.upper(column) == wanted.upper())
    if since is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc("created_at"), "run_id").limit(min(max(1, limit), 200))


def with_status(clauses: DataFrame, status: str) -> DataFrame:
    return clauses.filter(F.upper("status") == status.upper())


def visible_columns(rows: DataFrame, role: str, secret: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows without the columns that a role may not see: withheld as null, so that the schema stays."""
    hidden = [c for c in rows.columns if role not in secret.get(c, (role,))]
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in hidden}) if hidden else rows


def permitted(users: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """Users whose role grants a permission (role, permission: a table of a few rows)."""
    own = grants.filter(F.col("permission") == permission).select("role").distinct()
    return users.join(own, "role", "left_semi")


def with_handles(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows with the handle of their finding, empty where there is none."""
    return rows.join(findings.select("finding_id", "handle"), "finding_id", "left").withColumn("handle", F.coalesce("handle", F.lit("")))


def importers(files: DataFrame, stems: list[str]) -> DataFrame:
    """Files with an import statement that holds a changed stem: one projection over the stems, no join.

    files: file, imports (array of statements). file, stem, once each."""
    held = lambda stem: F.exists("imports", lambda i: F.contains(i, F.lit(stem)))
    hit = F.array_compact(F.array(*[F.when(held(s), F.lit(s)) for s in stems]))
    return files.select("file", F.explode(hit).alias("stem"))


def name_references(texts: DataFrame, symbols: DataFrame, least: int = 3) -> DataFrame:
    """path, uid: whole words of texts that are names of symbols of at least `least` characters.

    Words are joined by equality, so no pattern is tried against every text."""
    words = texts.select("path", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("name")).filter(F.length("name") >= least)
    return words.join(symbols.select("uid", "name"), "name").select("path", "uid").distinct()


def entrypoint_rollup(entrypoints: DataFrame, edges: DataFrame, roles: DataFrame, flows: DataFrame, depth: int = 6) -> DataFrame:
    """uid, controls, sinks, flows: what an entrypoint reaches, and the flows that start there."""
    reached = closure(edges, entrypoints, depth).select(F.col("root").alias("entry"), F.col("uid").alias("owner")).union(entrypoints.select(F.col("uid").alias("entry"), F.col("uid").alias("owner")))
    found = reached.join(roles.select("ref", "owner", "category"), "owner").groupBy(F.col("entry").alias("uid")).agg(
        F.count_distinct(F.when(F.col("category") == "control", F.col("ref"))).alias("controls"), F.count_distinct(F.when(F.col("category") == "sink", F.col("ref"))).alias("sinks")
    )
    counts = flows.groupBy(F.col("entry").alias("uid")).agg(F.count("*").alias("flows"))
    return entrypoints.select("uid").join(found, "uid", "left").join(counts, "uid", "left").fillna(0, ["controls", "sinks", "flows"])


def observation_support(verdicts: DataFrame) -> DataFrame:
    """clause_id, support: on how many records a clause could be judged."""
    return verdicts.select("clause_id", F.col("applicable").alias("support"))


def best_certificate(certificates: DataFrame, key: str = "run_id") -> DataFrame:
    """One certificate a run: the final one, else the best level, else the newest."""
    level = F.create_map(*[x for k, v in {"A": 3, "B": 2, "C": 1, "R": 0}.items() for x in (F.lit(k), F.lit(v))])[F.col("level")]
    return certificates.groupBy(key).agg(F.max_by("certificate_id", F.struct("final", F.coalesce(level, F.lit(-1)), "created_at", "certificate_id")).alias("certificate_id"))


def sensitivity(name: Column, table: dict[str, str]) -> Column:
    """What a dependency is sensitive for; a scope before the name does not count."""
    own = F.lower(F.regexp_replace(name, "^@[^/]+/", ""))
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[own]


def plan_counts(plans: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return plans.agg(F.count("*").alias("total"), one("PLANNED"), one("EXECUTED"), one("REPRODUCED"), one("SKIPPED"))
