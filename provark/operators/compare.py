"""Before and after: change sets, replays, coverage, deltas, crash buckets, reproductions, oracles, patches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import glob_to_regex
from provark.operators.graph import innermost


def change_set(before: DataFrame, after: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """key, change: added, removed or modified; unchanged rows are left out."""
    a = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def replay(baseline: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, divergence (missing, exit_code, response or null) for every case of the baseline.

    Cases that only the later run has are ignored."""
    b = after.select("case_id", F.col("exit_code").alias("_exit"), F.col("response_hash").alias("_hash"), F.lit(True).alias("_there"))
    kind = F.when(F.col("_there").isNull(), "missing").when(~F.col("exit_code").eqNullSafe(F.col("_exit")), "exit_code").when(~F.col("response_hash").eqNullSafe(F.col("_hash")), "response")
    return baseline.join(b, "case_id", "left").select("case_id", kind.alias("divergence"))


def replay_verdict(divergences: DataFrame) -> DataFrame:
    """matched, diverged, verdict; an empty baseline fails."""
    out = divergences.agg(F.count("*").alias("cases"), F.count_if(F.col("divergence").isNull()).alias("matched"), F.count_if(F.col("divergence").isNotNull()).alias("diverged"))
    return out.withColumn("verdict", F.when((F.col("cases") > 0) & (F.col("diverged") == 0), "PASS").otherwise("FAIL"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", at).filter("_n = 1").drop("_n")


def coverage_growth(lines: DataFrame, keys: list[str], step: str) -> DataFrame:
    """step, new, total: keys first seen at each step, and so far. The running sum is over steps, not lines."""
    new = lines.groupBy(*keys).agg(F.min(step).alias(step)).groupBy(step).agg(F.count("*").alias("new"))
    return new.withColumn("total", F.sum("new").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def coverage(lines: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """covered, total, percent (2 places) of distinct (file, line); without totals the last two stay null."""
    covered = lines.agg(F.count_distinct("file", "line").alias("covered"))
    if totals is None:
        return covered.withColumns({"total": F.lit(None).cast("long"), "percent": F.lit(None).cast("double")})
    top = totals.groupBy("file").agg(F.max("total").alias("t")).agg(F.sum("t").alias("total"))
    return covered.crossJoin(F.broadcast(top)).withColumn("percent", F.round(F.try_divide(100 * F.col("covered"), F.col("total")), 2))  # one row each


def deltas(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with delta: a cumulative counter less its value before, the first in full."""
    return rows.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(key).orderBy(order)))


def crash_buckets(crashes: DataFrame) -> DataFrame:
    """error_type, site, hits, shortest (the first of the least size). All hits count, whichever input stays."""
    return crashes.groupBy("error_type", "site").agg(F.count("*").alias("hits"), F.min_by("input_id", F.struct("size", "seq")).alias("shortest"), F.min("size").alias("size"))


def reproduction_gate(executions: DataFrame, required: int = 2) -> DataFrame:
    """plan_id, fired, outcome: reproduced, below threshold, unresolved (nothing fired and some execution could not be
    judged), or held."""
    out = executions.groupBy("plan_id").agg(F.count_if(F.col("verdict") == "FIRED").alias("fired"), F.count_if(F.col("verdict") == "HELD").alias("held"), F.count("*").alias("_all"))
    outcome = F.when(F.col("fired") >= required, "reproduced").when(F.col("fired") > 0, "below threshold").when(F.col("held") == F.col("_all"), "held").otherwise("unresolved")
    return out.withColumn("outcome", outcome).drop("_all")


def uncovered(branches: DataFrame, covered: DataFrame, limit: int = 200, symbols: DataFrame | None = None, focus: DataFrame | None = None) -> DataFrame:
    """Branches (file, line) on lines that nothing covered, the first `limit` by file and line. With symbols (file, uid,
    start_line, end_line, seq) each has its owner, the innermost one; with a focus (uid) too, those of other owners and
    of none are left out, before the limit."""
    out = branches.join(covered.select("file", "line").distinct(), ["file", "line"], "left_anti")
    if symbols is not None:
        out = innermost(out, symbols)
        if focus is not None:
            out = out.join(focus.select(F.col("uid").alias("owner")), "owner", "left_semi")
    return out.orderBy("file", "line").limit(limit)


def root_cause(claims: DataFrame, frames: DataFrame, sizes: DataFrame, band: int = 40, symbols: DataFrame | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """claims (id, file, line) with verified: the file exists, the line is in it, and a frame lies within the band or,
    where symbols (file, uid, name, start_line, end_line, seq) and scopes (scope) are given, the innermost symbol around
    it ran: a scope is its uid, or ends with a colon and its name. Beyond the last line and at null lines nothing is.

    A band join of which claims are dealt out once: a bucket is as wide as the band, so a frame of a claim's own bucket is
    near, and of the buckets beside it only the nearest frame matters. Each claim is judged by itself."""
    d, line = F.col("_d"), F.col("line")
    at = frames.select("file", line.alias("_at"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("_d")).withColumn("_b", F.floor(F.col("_at") / band) + d)
    near = at.groupBy("file", "_b").agg(F.bool_or(d == 0).alias("_own"), F.max(F.when(d == 1, F.col("_at"))).alias("_before"), F.min(F.when(d == -1, F.col("_at"))).alias("_behind"))
    rows = claims.select("id", "file", "line").withColumn("_b", F.floor(line / band)).join(near, ["file", "_b"], "left")
    either = lambda *cs: F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs])
    rows = rows.select("id", "file", "line", either(F.col("_own"), line - F.col("_before") <= band, F.col("_behind") - line <= band).alias("_ran"))
    if symbols is not None and scopes is not None:
        ended = scopes.filter(F.contains("scope", F.lit(":"))).select(F.substring_index("scope", ":", -1).alias("name"))
        ran = symbols.join(scopes.select(F.col("scope").alias("uid")), "uid", "left_semi").select("uid").union(symbols.join(ended, "name", "left_semi").select("uid")).distinct()
        told = symbols.join(ran.withColumn("_in", F.lit(True)), "uid", "left").withColumn("uid", F.coalesce("_in", F.lit(False)))  # what is asked of the innermost one
        rows = innermost(rows, told).withColumn("_ran", either(F.col("_ran"), F.col("owner")))
    known = rows.join(sizes.select("file", "lines"), "file", "left")
    return known.select("id", "file", "line", F.coalesce((F.col("line") >= 1) & (F.col("line") <= F.col("lines")) & F.col("_ran"), F.lit(False)).alias("verified"))


def call_pairs(events: DataFrame) -> DataFrame:
    """Returns with the call they close: the latest open call of the same function in a case.

    events: case_id, seq, function, kind (call, return). Depth is the running balance of a function; a
    return closes the last call of its own depth."""
    by = Window.partitionBy("case_id", "function").orderBy("seq")
    step = F.when(F.col("kind") == "call", 1).otherwise(-1)
    depth = F.sum(step).over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("kind") == "call", 0).otherwise(1)
    leveled = events.withColumn("_d", depth)
    last = F.last(F.when(F.col("kind") == "call", F.col("seq")), ignorenulls=True).over(Window.partitionBy("case_id", "function", "_d").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return leveled.withColumn("call_seq", last).filter("kind = 'return'").select("case_id", "function", F.col("seq").alias("return_seq"), "call_seq")


def oracle_verdict(kind: Column, exit_code: Column, timed_out: Column, signals: Column, output: Column, expected: Column) -> Column:
    """FIRED, HELD or UNSUPPORTED of one execution by the kind of its oracle; what is missing or unknown is UNSUPPORTED."""
    fired = lambda c: F.when(c.isNull(), "UNSUPPORTED").when(c, "FIRED").otherwise("HELD")
    return (
        F.when(kind == "exit_nonzero", fired(exit_code != 0))
        .when(kind == "exit_equals", fired(exit_code == expected.try_cast("int")))
        .when(kind == "timeout", fired(timed_out))
        .when(kind == "signal", fired(F.array_contains(signals, expected)))
        .when(kind == "any_signal", fired(F.size(signals) > 0))
        .when(kind == "output_contains", fired(F.contains(output, expected)))
        .when(kind == "output_absent", fired(~F.contains(output, expected)))
        .when(kind == "output_equals", fired(output == expected))
        .when(kind == "output_matches", fired(F.call_function("rlike", output, expected)))
        .when(kind == "crash", fired((exit_code < 0) | (exit_code >= 128)))
        .when(kind == "no_crash", fired((exit_code >= 0) & (exit_code < 128)))
        .when(kind == "output_empty", fired(F.length(output) == 0))
        .when(kind == "output_longer", fired(F.length(output) > expected.try_cast("int")))
        .otherwise(F.lit("UNSUPPORTED"))
    )


_OLD, _NEW = re.compile(r"^@@ -[0-9]+(?:,([0-9]+))?"), re.compile(r"^@@ -\S+ \+[0-9]+(?:,([0-9]+))?")


def _walked(patch: str) -> Iterator[tuple[str | None, str | None, str]]:
    """file, op, raw of a patch's lines; what diff_lines says of them."""

    def length(head: re.Pattern, raw: str) -> int:
        found = head.match(raw)
        return int(found[1]) if found and found[1] else 1

    def name(raw: str) -> str:
        found = re.match(r"(?:---|\+\+\+) ([^\t]*)", raw)[1]
        return found[2:] if found[:2] in ("a/", "b/") else found

    old = new = 0
    was = file = None
    for raw in patch.split("\n"):
        op = None
        if old > 0 or new > 0:
            op = raw[:1] if raw[:1] in ("+", "-") else None if raw[:1] == "\\" else " "
            old -= op in ("-", " ")
            new -= op in ("+", " ")
        elif raw.startswith("@@ "):
            op, old, new = "@", length(_OLD, raw), length(_NEW, raw)
        elif raw.startswith("+++ "):
            op, own = "f", name(raw)
            file = was if own == "/dev/null" else own
        elif raw.startswith("--- "):
            was = name(raw)
        yield file, op, raw


def diff_lines(patches: DataFrame, id_col: str = "id", patch_col: str = "patch") -> DataFrame:
    """id, at, file, op, raw of the lines of unified diffs. op: `@` a hunk's head, `f` the file that the lines behind
    it change (the old name where it is removed), `+`, `-` or a blank inside a hunk, null for anything else.

    A hunk's head says how many lines it has, so a removed line that begins with dashes is no file's head. Lines are
    walked in batches: what a line is depends on all before it, and an expression would carry the whole list along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                lines = [None if t is None else list(_walked(t)) for t in part["patch"].to_pylist()]
                n = [len(x or ()) for x in lines]
                rows = [x for own in lines for x in own or ()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                at = [i for k in n for i in range(k)]
                ids = part["id"].take(pa.array([i for i, k in enumerate(n) for _ in range(k)], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), *[pa.array(c, pa.string()) for c in columns]], ["id", "at", "file", "op", "raw"])

    own = patches.select(F.col(id_col).alias("id"), F.col(patch_col).alias("patch"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, at int, file string, op string, raw string")


def diff_stats(patches: DataFrame, id_col: str = "id", patch_col: str = "patch") -> DataFrame:
    """id, files (different ones), hunks, added, removed."""
    n = lambda op: F.count_if(F.col("op") == op)
    rows = diff_lines(patches, id_col, patch_col)
    return rows.groupBy("id").agg(F.size(F.collect_set(F.when(F.col("op") == "f", F.col("file")))).cast("long").alias("files"), n("@").alias("hunks"), n("+").alias("added"), n("-").alias("removed"))


#: The order of assurance levels, the best first.
LEVELS = ("A", "B", "C", "R")


def policy_violations(
    patches: DataFrame,
    protected: list[str],
    max_files: int = 10,
    max_added: int = 400,
    banned_imports: tuple[str, ...] = ("os.system", "ctypes", "pickle"),
    radius: DataFrame | None = None,
    max_radius: float = 0.8,
    levels: DataFrame | None = None,
    least_level: str = "B",
) -> DataFrame:
    """id, rule, detail: a row for each broken rule: protected path, binary, too many files, too large, import and,
    where given, a blast radius (id, score) beyond its bound and a certificate's level (id, level) below the least."""
    guard = "|".join(glob_to_regex(p) for p in protected) or "$^"
    named = r"^\+\s*(import|from)\s+(" + "|".join(i.replace(".", r"\.") for i in banned_imports) + r")\b"
    told = lambda df, rule, detail: df.select("id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    op, raw, file = F.col("op"), F.col("raw"), F.col("file")
    said = diff_lines(patches).groupBy("id").agg(
        F.collect_set(F.when((op == "f") & file.rlike(guard), file)).alias("protected_path"),
        F.bool_or(op.isNull() & raw.startswith("Binary files")).alias("binary"),
        F.collect_list(F.when((op == "+") & raw.rlike(named), raw)).alias("import"),
        F.size(F.collect_set(F.when(op == "f", file))).alias("files"),
        F.count_if(op == "+").alias("added"),
    )
    rule = lambda name, details: F.transform(details, lambda x: F.struct(F.lit(name).alias("rule"), x.cast("string").alias("detail")))
    one = lambda cond, detail: F.array_compact(F.array(F.when(cond, detail.cast("string"))))
    every = [
        rule("protected_path", F.col("protected_path")),
        rule("binary", one(F.col("binary"), F.lit(""))),
        rule("import", F.col("import")),
        rule("file_count", one(F.col("files") > max_files, F.col("files"))),
        rule("size", one(F.col("added") > max_added, F.col("added"))),
    ]
    out = said.select("id", F.explode(F.concat(*every)).alias("v")).select("id", "v.*")
    given = []
    if radius is not None:
        given.append(told(radius.filter(F.col("score") > max_radius), "blast_radius", F.col("score")))
    if levels is not None:
        below = levels.filter(F.col("level").isin(*LEVELS[LEVELS.index(least_level) + 1 :]))
        given.append(told(below, "assurance_level", F.col("level")))
    if given:
        beyond = given[0] if len(given) == 1 else given[0].union(given[1])
        out = out.union(beyond.join(patches.select("id"), "id", "left_semi"))
    return out


def before_after(patches: DataFrame) -> DataFrame:
    """id, before, after: the texts on both sides of a diff's hunks."""
    rows = diff_lines(patches).filter(F.col("op").isin("+", "-", " "))
    side = lambda op: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin(op, " "), F.struct("at", F.substring("raw", 2, 1 << 20).alias("x"))))), lambda s: s["x"]), "\n")
    return rows.groupBy("id").agg(side("-").alias("before"), side("+").alias("after"))


def spec_dedup(specs: DataFrame) -> DataFrame:
    """The first of the specs with the same strategy, target, oracle and payloads in any order."""
    key = F.array_join(F.array_sort("payloads"), "\x01")
    return first_seen(specs.withColumn("_k", key), ["strategy", "target", "oracle", "_k"], ["seq"]).drop("_k")


def select_engine(engines: DataFrame, language: str, strategy: str) -> DataFrame:
    """One row: the engine to use (coverage feedback first, fallbacks last, then by id), or why there is none."""
    fit = engines.filter(F.array_contains("languages", language) & F.array_contains("strategies", strategy) & F.col("available"))
    best = fit.agg(F.min_by("id", F.struct(~F.col("feedback"), "fallback", "id")).alias("engine"))
    return best.withColumn("reason", F.when(F.col("engine").isNull(), F.lit(f"no engine for {language} and {strategy}")))


def select_engines(engines: DataFrame, wanted: DataFrame) -> DataFrame:
    """language, strategy, engine, reason for each wanted (language, strategy): as select_engine, for all of them at once."""
    each = engines.filter("available").select("id", "feedback", "fallback", F.explode("languages").alias("language"), "strategies").withColumn("strategy", F.explode("strategies"))
    best = each.groupBy("language", "strategy").agg(F.min_by("id", F.struct(~F.col("feedback"), "fallback", "id")).alias("engine"))
    out = wanted.select("language", "strategy").distinct().join(best, ["language", "strategy"], "left")
    return out.withColumn("reason", F.when(F.col("engine").isNull(), F.concat(F.lit("no engine for "), "language", F.lit(" and "), "strategy")))


def cross_checked(ours: DataFrame, others: DataFrame) -> DataFrame:
    """Changed files by either source: a cross-check can only widen the set."""
    return ours.select("path").union(others.select("path")).distinct()
