"""Candidates of independent channels: correlation, corroboration, handles, ledger, and the channels' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import split_location
from provark.operators.flows import hypothesis_priority
from provark.operators.rules import SEVERITY, severity_rank
from provark.plans.storage import numbered

#: What each further channel adds, and the most that corroboration reaches.
STEP, MOST = 0.06, 0.95


def correlation_key(candidates: DataFrame) -> DataFrame:
    """candidates with file and class: the CWE, else the last part of the rule id."""
    file, _ = split_location(F.col("location"))
    kind = F.when(F.coalesce(F.col("cwe"), F.lit("")) != "", F.col("cwe")).otherwise(F.substring_index("rule_id", ".", -1))
    return candidates.withColumns({"file": file, "class": kind})


def corroborated(confidence: Column, channels: Column) -> Column:
    return F.when(channels > 1, F.least(F.lit(MOST), confidence + STEP * (channels - 1))).otherwise(confidence)


def correlate(candidates: DataFrame) -> DataFrame:
    """One row a (file, class): maxima of confidence, reachability and radius, all evidence, the channels, severity and
    location of the worst severity (then the first), the class's CWE, and whether any has a plan.

    Rule ids, and descriptions where candidates have them, come as arrays in order of their first seq. The clause_id,
    where candidates have one, is what folding in order of seq leaves: a worse severity brings its own, an empty place
    takes what comes. Confidence rises by .06 for each further channel."""
    best = lambda c: F.max_by(c, F.struct(severity_rank(F.col("severity")), -F.col("seq"))).alias(c)
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda s: s["x"]))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    extra = [F.filter(ordered("description"), lambda x: x != "").alias("descriptions")] if "description" in candidates.columns else []
    if "clause_id" in candidates.columns:
        # The row that first reached each severity, the worst first; then whatever came first.
        reached = [F.min_by(filled("clause_id"), F.when(severity_rank(F.col("severity")) >= r, F.col("seq"))) for r in range(max(SEVERITY.values()), -1, -1)]
        extra.append(F.coalesce(*reached, F.min_by(filled("clause_id"), F.when(filled("clause_id").isNotNull(), F.col("seq")))).alias("clause_id"))
    out = correlation_key(candidates).groupBy("file", "class").agg(
        *extra,
        F.max(filled("cwe")).alias("cwe"),
        F.min("seq").alias("seq"),
        F.max("confidence").alias("_confidence"),
        F.max("reachability").alias("reachability"),
        F.max("blast_radius").alias("blast_radius"),
        F.bool_or("reachability_measured").alias("reachability_measured"),
        F.bool_or("has_plan").alias("has_plan"),
        best("severity"),
        best("location"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        ordered("rule_id").alias("rule_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_refs")))).alias("evidence_refs"),
        F.count("*").alias("merged"),
    )
    return out.withColumn("confidence", F.round(corroborated(F.col("_confidence"), F.size("channels")), 4)).drop("_confidence")


def prioritise(rows: DataFrame) -> DataFrame:
    value = hypothesis_priority(F.col("reachability"), F.col("confidence"), F.col("blast_radius"), F.col("reachability_measured"), F.col("severity"))
    return rows.withColumn("priority", F.round(value, 6))


def handles(rows: DataFrame) -> DataFrame:
    """rows with handle V01, V02 ... by priority, then seq, numbered over range partitions."""
    return numbered(rows, [F.desc("priority"), F.col("seq")], "_at").withColumn("handle", F.format_string("V%02d", F.col("_at") + 1)).drop("_at")


def statuses(rows: DataFrame) -> DataFrame:
    """queued with a plan, unknown without, with the reason why."""
    status = F.when(F.col("has_plan"), "QUEUED").otherwise("UNKNOWN")
    return rows.withColumns({"status": status, "reason": F.when(~F.col("has_plan"), F.lit("no plan"))})


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def ledger(rows: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """Every hypothesis that is not validated, with its reason or the status's own."""
    known = F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), F.lit(v))])
    return rows.filter("status <> 'VALIDATED'").withColumn("reason", F.coalesce("reason", known[F.col("status")], F.lit("not established")))


def claim_next(rows: DataFrame) -> DataFrame:
    """The queued row of the highest priority, then the first; claiming is an append to the transition log."""
    return rows.filter("status = 'QUEUED'").orderBy(F.desc("priority"), "seq").limit(1)


def transitions(log: DataFrame, key: str = "id") -> DataFrame:
    """The log with the status before; rows that change nothing are left out."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy("seq"))
    return log.withColumn("before", before).filter(~F.col("status").eqNullSafe(F.col("before")))


def static_channel(hits: DataFrame) -> DataFrame:
    """Rule hits as candidates of channel `static`; what the rule says of severity, class and plan.

    Where hits come enriched (exposure, radius, measured: see graph.enriched) these are the candidate's reachability and
    radius; a hit whose owner is not known is not measured. Hits of plain texts, which no call graph knows, count as
    reached as they stand (1.0) with the least radius (.2)."""
    known = {"exposure", "radius", "measured"} <= set(hits.columns)
    reach = F.coalesce("exposure", F.lit(0.05)) if known else F.lit(1.0)
    radius = F.coalesce("radius", F.lit(0.2)) if known else F.lit(0.2)
    return hits.select(
        F.col("seq"),
        F.lit("static").alias("channel"),
        F.concat_ws(":", F.col("id").cast("string"), F.col("line").cast("string")).alias("location"),
        "severity",
        reach.alias("reachability"),
        "confidence",
        radius.alias("blast_radius"),
        "cwe",
        F.concat(F.lit("static."), F.col("rule_id")).alias("rule_id"),
        F.array(F.concat_ws("#", F.col("id").cast("string"), "rule_id")).alias("evidence_refs"),
        F.col("severity").isin("critical", "high").alias("has_plan"),
        (F.coalesce("measured", F.lit(False)) if known else F.lit(True)).alias("reachability_measured"),
    )


def runtime_channel(counters: DataFrame) -> DataFrame:
    """Guard counters (scope, guard, hits) above zero as candidates of channel `runtime`."""
    return counters.filter("hits > 0").select(
        F.lit("runtime").alias("channel"), F.col("scope").alias("location"), F.concat(F.lit("runtime."), F.col("guard")).alias("rule_id"), F.round(F.least(F.lit(0.95), 0.5 + 0.1 * F.col("hits")), 3).alias("confidence")
    )


def config_channel(settings: DataFrame, risky: dict[str, float]) -> DataFrame:
    """Settings of a risky name as candidates of channel `config` with constant scores."""
    score = F.create_map(*[x for k, v in risky.items() for x in (F.lit(k), F.lit(v))])[F.col("setting")]
    return settings.withColumn("confidence", score).filter("confidence is not null").select(F.lit("config").alias("channel"), F.concat_ws(":", F.col("id").cast("string"), F.col("line").cast("string")).alias("location"), F.concat(F.lit("config."), F.col("setting")).alias("rule_id"), "confidence")


def all_channels(parts: list[DataFrame]) -> DataFrame:
    """Results of the channels that gave any, one after the other."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def sibling_shortlist(hits: DataFrame, tokens: list[str], repaired: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Places like a repaired one: hits whose snippet, in lower case, holds any of the tokens, outside repaired and test
    files; confidence .35 and .15 a token, at most .9.

    With symbols (uid, parameters, body; one row a uid) a hit with an owner (uid) is kept only if one of the owner's
    parameters is named in its snippet or body: what nobody outside can reach is no sibling. A hit whose owner is not
    known stays, as nothing was measured."""
    held = F.filter(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower("snippet"), t))
    rows = hits.withColumn("hits", F.size(held)).filter("hits > 0").join(repaired.select("file"), "file", "left_anti")
    rows = rows.filter(~F.col("file").rlike(r"(^|/)tests?/"))
    if symbols is not None:
        known = symbols.select(F.col("uid").alias("owner"), F.coalesce("parameters", F.array().cast("array<string>")).alias("_given"), F.coalesce("body", F.lit("")).alias("_body"))
        place = F.concat_ws("\n", "snippet", "_body")
        rows = rows.join(known, "owner", "left").filter(F.col("_given").isNull() | F.exists("_given", lambda p: F.contains(place, p))).drop("_given", "_body")
    return rows.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.35 + 0.15 * F.col("hits")), 3))
