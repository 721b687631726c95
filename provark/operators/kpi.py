"""Rollups: dashboards, histograms, module and index summaries, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import dirname
from provark.plans.storage import stored


def dashboard(runs: DataFrame) -> DataFrame:
    """One pass over runs (status, duration_ms, findings, cost): counts, averages that pass over null and 0,
    cut to whole numbers, the success rate and sums."""
    mean = lambda c: F.floor(F.avg(F.nullif(F.col(c), F.lit(0)))).cast("long")
    done = F.count_if(F.col("status").isin("SUCCEEDED", "FAILED"))
    return runs.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        mean("duration_ms").alias("avg_duration_ms"),
        F.round(F.try_divide(F.count_if(F.col("status") == "SUCCEEDED"), done), 4).alias("success_rate"),
        F.sum("findings").alias("findings"),
    )


def histogram(rows: DataFrame, value: str, bounds: list[float], by: str) -> DataFrame:
    """by, le, count, cumulative: fixed cumulative buckets, the last without a bound."""
    edges = [*bounds, float("inf")]
    counts = rows.groupBy(by).agg(*[F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)])
    pairs = F.array(*[F.struct(F.lit(str(e) if e != float("inf") else "+Inf").alias("le"), F.col(f"b{i}").alias("cumulative")) for i, e in enumerate(edges)])
    return counts.select(by, F.explode(pairs).alias("p")).select(by, "p.le", "p.cumulative")


def module_rollup(files: DataFrame, hits: DataFrame) -> DataFrame:
    """module, files, callables, entrypoints and counts by category; most callables first."""
    own = files.withColumn("module", dirname(F.col("file"))).groupBy("module").agg(F.count("*").alias("files"), F.sum("callables").alias("callables"), F.sum("entrypoints").alias("entrypoints"))
    counts = hits.withColumn("module", dirname(F.col("file"))).groupBy("module", "category").agg(F.count("*").alias("n"))
    maps = counts.groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    return own.join(maps, "module", "left").orderBy(F.desc("callables"), "module")


def project_counts(projects: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Projects with their counts of runs and findings, 0 where there are none: two grouped counts, two joins."""
    r = runs.groupBy("project_id").agg(F.count("*").alias("runs"))
    f = findings.groupBy("project_id").agg(F.count("*").alias("findings"))
    return projects.join(r, "project_id", "left").join(f, "project_id", "left").fillna(0, ["runs", "findings"])


def level_counts(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Counts of a fixed list of levels, 0 where none has it."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(levels)], "ord int, level string")
    counts = rows.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    return F.broadcast(wanted).join(counts, "level", "left").select("ord", "level", F.coalesce("n", F.lit(0)).alias("n"))


def top_languages(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k languages with most bytes, and their share of those k."""
    top = rows.groupBy("language").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "language").limit(k)
    return top.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy(F.lit(1))), 4))


def nest(parents: DataFrame, children: DataFrame, key: str, order: str) -> DataFrame:
    """Parents with their children as an ordered array of structs."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias("children"))
    return parents.join(lists, key, "left")


def index_summary(files: DataFrame) -> DataFrame:
    """By indexer and language: files, symbols, lines, skipped."""
    return files.groupBy("indexer", "language").agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("lines").alias("lines"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))


def page(rows: DataFrame, order: list, offset: int, limit: int, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """A page and, apart, the total; limits are held to 1..`most`, offsets to 0 and up."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most)), rows.agg(F.count("*").alias("total"))


def capped(rows: DataFrame, n: int = 40) -> DataFrame:
    """At most n rows with truncated: whether there were more. One row too many is read to know; they are stored, so
    that rows and answer come from one read."""
    more = stored(rows.limit(n + 1), "capped")
    flag = more.agg((F.count("*") > n).alias("truncated"))
    return more.limit(n).crossJoin(F.broadcast(flag))  # one row


def sandbox_totals(executions: DataFrame) -> DataFrame:
    """executions, bytes, peak_ram, cpu_ms of sandbox executions; null measurements count as none."""
    return executions.agg(F.count("*").alias("executions"), F.sum("bytes").alias("bytes"), F.max("ram").alias("peak_ram"), F.sum("cpu_ms").alias("cpu_ms"))


def language_parity(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Languages that have files and no callable symbol: a parser that failed rather than code that is not there."""
    return files.select("language").filter("language is not null").distinct().join(symbols.select("language"), "language", "left_anti")
