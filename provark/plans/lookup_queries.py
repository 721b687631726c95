"""Registered queries: list filters, references, enrichments and the remaining projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.operators import candidates, compare, flows, integrity, lookups
from provark.plans.graph_queries import RULES_SQL, hits
from provark.plans.storage import query, table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def run_list(spark: SparkSession, d: str) -> DataFrame:
    return lookups.list_runs(_runs(spark, d), "f", since="1996-01-01", limit=100).select("run_id")


@query("SELECT c_custkey AS id, c_name, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def permitted_view(spark: SparkSession, d: str) -> DataFrame:
    """Who may read, and what of it: roles by a semi join, a withheld column as null."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal", F.col("c_mktsegment").alias("role"))
    grants = spark.createDataFrame([("BUILDING", "read"), ("MACHINERY", "read"), ("HOUSEHOLD", "list")], "role string, permission string")
    return lookups.visible_columns(lookups.permitted(users, grants, "read"), "viewer", {"c_acctbal": ("owner",)}).drop("role")


@query("SELECT o_orderkey, coalesce(c_name, '') AS handle FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 = 0) ON o_custkey = c_custkey")
def with_handles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("finding_id"))
    return lookups.with_handles(rows, table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("finding_id"), F.col("c_name").alias("handle"))).select("o_orderkey", "handle")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS name FROM documents), s AS (SELECT DISTINCT split_part(text, ' ', 2) AS name, item_id AS uid FROM benchmark)
SELECT uid, count(DISTINCT doc_id) AS docs FROM w JOIN s USING (name) WHERE length(name) >= 3 GROUP BY uid""")
def name_references(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    symbols = table(spark, d, "benchmark").select(F.col("item_id").alias("uid"), F.split("text", " ")[1].alias("name"))
    return lookups.name_references(texts, symbols).groupBy("uid").agg(F.count("*").alias("docs"))


@query("SELECT page_id AS file, stem FROM pages, (SELECT unnest(['cheap', 'farm', 'href']) AS stem) WHERE contains(html, stem) OR contains(url, stem)")
def importers(spark: SparkSession, d: str) -> DataFrame:
    return lookups.importers(table(spark, d, "pages").select(F.col("page_id").alias("file"), F.array("html", "url").alias("imports")), ["cheap", "farm", "href"])


@query("""SELECT o_custkey AS run_id, arg_max(o_orderkey, (CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) * 1e15 + (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) * 1e13 + (epoch(o_orderdate) // 86400) * 1e7 + o_orderkey) AS certificate_id FROM orders GROUP BY o_custkey""")
def best_certificate(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("certificate_id"), (F.col("o_orderkey") % 13 == 0).alias("final"), level.alias("level"), F.col("o_orderdate").alias("created_at"))
    return lookups.best_certificate(rows)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS planned, count(*) FILTER (o_orderstatus = 'F') AS executed, 0::BIGINT AS reproduced, count(*) FILTER (o_orderstatus = 'P') AS skipped FROM orders")
def plan_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "PLANNED").when(F.col("o_orderstatus") == "F", "EXECUTED").otherwise("SKIPPED")
    return lookups.plan_counts(table(spark, d, "orders").select(status.alias("status")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) <= 60 AS kept FROM lineitem""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = flows.within_budget(table(spark, d, "lineitem"), 60, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kept")


@query("""SELECT o_orderkey AS id, arg_min(l_linenumber * 1000000 + l_partkey, CASE WHEN l_linenumber = o_orderkey % 7 + 1 THEN 0 ELSE 1 END * 1e9 + l_linenumber * 1000000 + l_partkey) AS flow_ref FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def best_flow_match(spark: SparkSession, d: str) -> DataFrame:
    findings = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 7 + 1).alias("line"))
    ref = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), ref.alias("ref"), ref.alias("seq"))
    return flows.best_match(findings, rows).select("id", "flow_ref")


@query("SELECT conv_id AS id, turn AS seq, role AS status, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations QUALIFY lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return candidates.transitions(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.col("role").alias("status")))


@query(f"""WITH {RULES_SQL} SELECT id, line, rule_id, round(least(0.9, 0.35 + 0.15 * (CASE WHEN contains(snippet, '@') THEN 1 ELSE 0 END + CASE WHEN contains(snippet, '1') THEN 1 ELSE 0 END)), 3)::DOUBLE AS confidence FROM hits WHERE (contains(snippet, '@') OR contains(snippet, '1')) AND id % 10 <> 0""")
def sibling_shortlist(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).withColumn("file", F.concat(F.lit("doc/"), F.col("id").cast("string")))
    repaired = table(spark, d, "documents").filter("doc_id % 10 = 0").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"))
    return candidates.sibling_shortlist(rows, ["@", "1"], repaired).select("id", "line", "rule_id", "confidence")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders) SELECT k AS run_id, 'unproved: ' || s AS risk FROM o WHERE k % 3 = 0 AND k % 4 IN (1, 2) UNION ALL
SELECT k, 'coverage moved' FROM o WHERE k % 4 = 1 UNION ALL SELECT k, 'the change was refuted' FROM o WHERE k % 4 = 0""")
def residual_risks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    stated = F.array_compact(F.array(F.when(k % 3 == 0, F.concat(F.lit("unproved: "), F.col("o_orderstatus"))), F.lit("coverage moved")))
    level = F.when(k % 4 == 0, "R").when(k % 4 == 1, "C").when(k % 4 == 2, "B").otherwise("A")
    return integrity.residual_risks(table(spark, d, "orders").select(k.alias("run_id"), stated.alias("limitations"), level.alias("level")))


@query("""SELECT s.ref, q.question, CASE WHEN e.n IS NULL THEN 'NOT ESTABLISHED' ELSE 'ESTABLISHED' END AS answer FROM (SELECT c_custkey AS ref FROM customer) s CROSS JOIN (SELECT unnest(['F', 'O', 'X']) AS question) q
LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) e ON e.o_custkey = s.ref AND e.o_orderstatus = q.question""")
def how_do_you_know(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "orders").select(F.col("o_custkey").alias("ref"), F.col("o_orderstatus").alias("question"), F.col("o_orderkey").alias("evidence_ref"))
    return integrity.claims(evidence, table(spark, d, "customer").select(F.col("c_custkey").alias("ref")), ["F", "O", "X"]).select("ref", "question", "answer")


@query("SELECT l_suppkey AS file, l_partkey AS line FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') WHERE (l_suppkey, l_partkey) NOT IN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A') ORDER BY file, line LIMIT 200")
def uncovered_branches(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"), "l_returnflag")
    return compare.uncovered(li.filter("l_returnflag = 'A'").select("file", "line").distinct(), li.filter("l_returnflag <> 'A'"))


@query("""SELECT l_suppkey AS file, l_partkey AS line, l_suppkey * 100 + l_partkey // 500 AS owner FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') WHERE (l_suppkey, l_partkey) NOT IN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A') AND l_partkey // 500 = 1 ORDER BY file, line LIMIT 200""")
def uncovered_in_focus(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered branches with their owners, of two symbols a file; only the second is in focus."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"), "l_returnflag")
    k = F.col("s_suppkey")
    symbols = table(spark, d, "supplier").select(k.alias("file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select("file", (F.col("file") * 100 + F.col("j")).alias("uid"), (F.col("j") * 500).alias("start_line"), (F.col("j") * 500 + 499).alias("end_line"), F.col("j").alias("seq"))
    branches, covered = li.filter("l_returnflag = 'A'").select("file", "line").distinct(), li.filter("l_returnflag <> 'A'")
    return compare.uncovered(branches, covered, symbols=symbols, focus=symbols.filter("seq = 1").select("uid"))


@query("SELECT count(DISTINCT (l_suppkey, l_partkey)) AS covered, (SELECT count(*) * 50 FROM supplier) AS total, round(100 * count(DISTINCT (l_suppkey, l_partkey)) / (SELECT count(*) * 50 FROM supplier), 2) AS percent FROM lineitem WHERE l_returnflag = 'A'")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"))
    return compare.coverage(li, table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(50).alias("total")))


@query("SELECT p_brand AS strategy, p_size AS target, min(p_partkey) AS first FROM part GROUP BY p_brand, p_size, p_partkey % 2")
def spec_dedup(spark: SparkSession, d: str) -> DataFrame:
    odd = (F.col("p_partkey") % 2).cast("string")
    payloads = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("x"), odd)).otherwise(F.array(odd, F.lit("x")))
    specs = table(spark, d, "part").select(F.col("p_brand").alias("strategy"), F.col("p_size").alias("target"), F.lit("o").alias("oracle"), payloads.alias("payloads"), F.col("p_partkey").alias("seq"))
    return compare.spec_dedup(specs).select("strategy", "target", F.col("seq").alias("first"))


