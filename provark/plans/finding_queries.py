"""Registered queries: findings with what the graph knows of them, triage, assurance with its reasons, and what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.functions import text as tx
from provark.operators import candidates, flows, graph, integrity
from provark.plans.bindings import EDGES_SQL, key_edges, key_nodes
from provark.plans.storage import query, table
from provark.sources import taint

#: Calls: whoever places or holds something calls it; regions below 3 are entered from outside.
_CALLS_SQL = f"""{EDGES_SQL}, calls AS (SELECT src, dst, confidence FROM edges),
entry AS (SELECT 'region:' || r_regionkey AS uid FROM region WHERE r_regionkey < 3),
hop1 AS (SELECT dst AS uid, confidence AS c FROM calls WHERE src IN (SELECT uid FROM entry)),
hop2 AS (SELECT dst AS uid, least(c, confidence) AS c FROM hop1 JOIN calls ON src = hop1.uid),
o AS (SELECT o_orderkey, o_custkey, 'crm/customer/' || o_custkey % 10 AS file, o_custkey + o_orderkey % 47 AS line FROM orders),
owned AS (SELECT o.*, arg_max(c_custkey, c_custkey) AS k FROM o LEFT JOIN customer ON c_custkey % 10 = o_custkey % 10 AND line BETWEEN c_custkey AND c_custkey + 25 GROUP BY ALL)"""


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Customers as symbols of ten files, each over 26 lines from its key on."""
    own = key_nodes(spark, d).filter("kind = 'customer'")
    return own.withColumns({"start_line": F.col("seq"), "end_line": F.col("seq") + 25})


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_edges(key_edges(spark, d)).withColumn("kind", F.lit("CALLS"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    found = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("crm/customer/"), (k % 10).cast("string")).alias("file"), (k + F.col("o_orderkey") % 47).alias("line"))
    entry = key_nodes(spark, d).filter("kind = 'region' and seq < 3").select("uid")
    return graph.enriched(found, _symbols(spark, d), _calls(spark, d), entry)


_ENRICHED_SQL = f"""WITH {_CALLS_SQL},
f AS (SELECT o_orderkey, file, line, CASE WHEN k IS NOT NULL THEN 'customer:' || k END AS owner FROM owned),
up1 AS (SELECT dst AS uid, src AS by1 FROM calls), up AS (SELECT a.uid, count(DISTINCT a.by1) AS callers, count(DISTINCT a.by1) + count(DISTINCT b.by1) AS above FROM up1 a LEFT JOIN up1 b ON b.uid = a.by1 GROUP BY a.uid)
SELECT o_orderkey, owner, CASE WHEN owner IS NOT NULL THEN coalesce(callers, 0) END AS callers, CASE WHEN owner IS NOT NULL THEN hop2.uid IS NOT NULL END AS reachable,
  CASE WHEN owner IS NOT NULL THEN round(CASE WHEN hop2.uid IS NULL THEN CASE WHEN callers > 0 THEN 0.15 ELSE 0.05 END ELSE 0.84 * greatest(c, 0.5) END, 3)::DOUBLE END AS exposure,
  CASE WHEN owner IS NOT NULL THEN round(least(1.0, 0.2 + 0.03 * coalesce(above, 0)), 3)::DOUBLE END AS radius
FROM f LEFT JOIN up ON up.uid = owner LEFT JOIN (SELECT uid, max(c) AS c FROM hop2 GROUP BY uid) hop2 ON hop2.uid = owner"""


@query(_ENRICHED_SQL)
def scan_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their innermost symbol, its callers, exposure and radius."""
    return _enriched(spark, d).select("o_orderkey", "owner", "callers", "reachable", "exposure", "radius")


@query(f"""WITH e AS ({_ENRICHED_SQL}) SELECT o_orderkey AS seq, coalesce(exposure, 0.05)::DOUBLE AS reachability, coalesce(radius, 0.2)::DOUBLE AS blast_radius, owner IS NOT NULL AS reachability_measured, o_orderkey % 3 < 2 AS has_plan FROM e""")
def static_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Enriched findings as candidates: exposure and radius are those of their symbols."""
    k = F.col("o_orderkey")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "low"))), (k % 3 + 1).cast("int"))
    hits = _enriched(spark, d).select(k.alias("seq"), F.col("file").alias("id"), "line", severity.alias("severity"), F.lit(0.5).alias("confidence"), F.lit("").alias("cwe"), F.lit("r").alias("rule_id"), "exposure", "radius", "measured")
    return candidates.static_channel(hits).select("seq", "reachability", "blast_radius", "reachability_measured", "has_plan")


@query("""WITH f AS (SELECT o_orderkey AS seq, o_orderpriority AS rule_id, o_orderkey || ':1' AS location, o_custkey % 2 = 0 AS reachable, o_custkey % 9 AS callers FROM orders ORDER BY seq LIMIT 40)
SELECT rule_id, location, CASE rule_id WHEN '1-URGENT' THEN 'CWE-78' WHEN '2-HIGH' THEN 'CWE-22' ELSE '' END AS cwe, CASE rule_id WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE rule_id WHEN '1-URGENT' THEN 'forbidden_shell_invocation' WHEN '2-HIGH' THEN 'path_containment' ELSE '' END AS clause_kind,
  round(least(0.97, 0.55 + CASE WHEN rule_id IN ('1-URGENT', '2-HIGH') THEN 0.2 ELSE 0 END + CASE WHEN reachable THEN 0.15 ELSE 0 END + least(0.1, 0.02 * callers)), 2)::DOUBLE AS confidence FROM f""")
def triage_report(spark: SparkSession, d: str) -> DataFrame:
    """The first forty findings (the report's bound) with their rules' classes."""
    classes = spark.createDataFrame([("1-URGENT", "CWE-78", "CRITICAL", "forbidden_shell_invocation"), ("2-HIGH", "CWE-22", "HIGH", "path_containment")], "rule_id string, cwe string, severity string, clause_kind string")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(k.alias("seq"), F.col("o_orderpriority").alias("rule_id"), F.concat(k.cast("string"), F.lit(":1")).alias("location"), (c % 2 == 0).alias("reachable"), (c % 9).alias("callers"))
    return flows.triaged(rows, classes)


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src AS a, dst AS z FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT 'nation:4' AS uid, 0 AS hops UNION SELECT z, hops + 1 FROM c JOIN b ON uid = a WHERE hops < 3),
n AS (SELECT DISTINCT a AS uid FROM b UNION SELECT 'lonely:' || p_partkey FROM part), m AS (SELECT uid, min(hops) AS hops FROM c GROUP BY uid)
SELECT coalesce(hops, (SELECT max(hops) + 1 FROM m)) AS ring, count(*) AS nodes FROM n LEFT JOIN m USING (uid) GROUP BY 1""")
def layout_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings around a nation over every key, parts that nothing leads to on the outermost."""
    edges = graph.merge_edges(key_edges(spark, d))
    lonely = table(spark, d, "part").select(F.concat(F.lit("lonely:"), F.col("p_partkey").cast("string")).alias("uid"))
    nodes = edges.select(F.col("src").alias("uid")).union(edges.select("dst")).union(lonely)
    return graph.rings(nodes, edges, "nation:4", 3).groupBy("ring").agg(F.count("*").alias("nodes"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 AS kind, l_quantity::INTEGER AS q, l_returnflag || l_linestatus AS s, l_linenumber + 0.5 AS h FROM lineitem),
v AS (SELECT *, CASE kind WHEN 0 THEN [(q - 1)::VARCHAR, q::VARCHAR, (q + 1)::VARCHAR, s, upper(s), s || 'x', ''] WHEN 1 THEN [h::VARCHAR, (h - 1)::VARCHAR, (h + 1)::VARCHAR, 'true', 'false']
  WHEN 2 THEN [(q - 1)::VARCHAR, q::VARCHAR, (q + 1)::VARCHAR, '', 'x', repeat('x', 64), repeat('x', 1024)] ELSE [s, upper(s), s || 'x', '', (q - 1)::VARCHAR, q::VARCHAR, (q + 1)::VARCHAR, q::VARCHAR, (q + 1)::VARCHAR, (q + 2)::VARCHAR] END AS every FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter(every, lambda x, i: list_position(every, x) = i) AS inputs FROM v""")
def condition_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs around the literals of conditions: numbers, fractions, texts, flags and lengths, in four shapes."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    s = F.concat("l_returnflag", "l_linestatus")
    condition = (
        F.when(n % 4 == 0, F.concat(F.lit("x > "), q, F.lit(" and name == '"), s, F.lit("'")))
        .when(n % 4 == 1, F.concat((n + 0.5).cast("string"), F.lit(" <= "), (n + 0.5).cast("string"), F.lit(" or flag is not True")))
        .when(n % 4 == 2, F.concat(F.lit("not len(name) >= "), q))
        .otherwise(F.concat(F.lit("(x < "), q, F.lit(" or x >= "), (F.col("l_quantity").cast("int") + 1).cast("string"), F.lit(") and name in ('a',) and name != '"), s, F.lit("'")))
    )
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", taint.condition_literals(condition).alias("literals"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.boundary_inputs(F.col("literals")).alias("inputs"))


_RUNS_SQL = """r AS (SELECT o_orderkey AS k, o_custkey AS c, [struct_pack(location := 'f' || o_custkey || ':' || 1, why := 'like'), struct_pack(location := 'g:' || o_orderkey % 9, why := 'like')][:o_orderkey % 3] AS sib,
    o_orderkey % 7 <> 0 AS g, o_orderkey % 13 <> 0 AS e, CASE WHEN o_orderkey % 17 <> 0 THEN true END AS rp, o_orderkey % 19 <> 0 AS ct, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS un, CASE WHEN o_orderkey % 11 <> 0 THEN 50.0 - o_custkey % 30 END AS after FROM orders),
lv AS (SELECT *, CASE WHEN NOT g OR NOT e THEN 'R' WHEN rp IS NULL OR NOT ct OR un > 0 OR after IS NULL OR 50 - after > 10 THEN 'C' WHEN len(sib) > 0 THEN 'B' ELSE 'A' END AS level FROM r),
st AS (SELECT *, list_filter(CASE level WHEN 'R' THEN ['not repaired', CASE WHEN c % 2 = 0 THEN 'a reversible shield blocks the exploit' ELSE 'no shield stands' END, 'round ' || (k % 3 + 1) || ' of 3', CASE WHEN NOT g THEN 'mutation: failed' END]
  WHEN 'C' THEN [CASE WHEN rp IS NULL THEN 'replay did not show every benign case unchanged' END, CASE WHEN NOT ct THEN 'a clause in scope is not confirmed' END, CASE WHEN un > 0 THEN un || ' clauses could not be evaluated' END,
    CASE WHEN after IS NULL THEN 'coverage was not measured' WHEN 50 - after > 10 THEN 'coverage moved by ' || printf('%.1f', (50 - after)::DOUBLE) || ' points: 50.0% to ' || printf('%.1f', after::DOUBLE) || '%' END]
  WHEN 'B' THEN list_concat([len(sib) || ' places with the same pattern are unproved'], list_transform(sib, lambda s: 'unproved: ' || s.location || ' - ' || s.why))
  ELSE ['bounded evidence, no proof', 'lines run: ' || printf('%.1f', after::DOUBLE) || '%'] END, lambda x: x IS NOT NULL) AS limitations,
  CASE level WHEN 'R' THEN 2 + CASE WHEN NOT e THEN 1 ELSE 0 END WHEN 'A' THEN 7 ELSE 5 END AS reasons FROM lv)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = lambda at: F.struct(at.alias("location"), F.lit("like").alias("why"))
    siblings = F.slice(F.array(place(F.concat(F.lit("f"), c.cast("string"), F.lit(":1"))), place(F.concat(F.lit("g:"), (k % 9).cast("string")))), F.lit(1), (k % 3).cast("int"))
    rows = table(spark, d, "orders").select(
        k.alias("run_id"), F.concat(F.lit("V"), k.cast("string")).alias("handle"), (k % 7 != 0).alias("gauntlet_passed"), (k % 13 != 0).alias("exploit_eliminated"), F.when(k % 17 != 0, True).alias("replay_passed"), (k % 19 != 0).alias("contract_passed"),
        F.when(k % 5 == 0, 2).otherwise(0).alias("unsupported"), F.lit(50.0).alias("coverage_before"), F.when(k % 11 != 0, 50.0 - c % 30).alias("coverage_after"), siblings.alias("siblings"), F.when(k % 7 == 0, "mutation").alias("failing_stage"),
        F.when(k % 7 == 0, F.array(F.struct(F.lit("mutation").alias("stage"), F.lit("failed").alias("detail")))).alias("failed"), (c % 2 == 0).alias("shield_active"), F.lit(4).alias("clauses"), F.lit(3).alias("held"), (k % 3 + 1).alias("iteration"), F.lit(3).alias("iterations"),
    )
    return integrity.assurance(rows)


@query(f"WITH {_RUNS_SQL} SELECT k AS run_id, level, limitations, reasons FROM st")
def assurance_report(spark: SparkSession, d: str) -> DataFrame:
    """The level of each run, why, and what it leaves open."""
    return _runs(spark, d).select("run_id", "level", "limitations", F.size("rationale").alias("reasons"))


@query(f"""WITH {_RUNS_SQL}, each AS (SELECT k, c, level, unnest(limitations) AS detail FROM st)
SELECT k AS run_id, 'unproved sibling' AS kind, trim(regexp_extract(detail, '^unproved: (.*?) - ', 1)) AS location, detail FROM each WHERE level = 'B' AND starts_with(detail, 'unproved:') UNION ALL
SELECT k, 'incomplete verification', 'V' || k, detail FROM each WHERE level = 'C' UNION ALL SELECT k, 'unrepaired, shield only', 'V' || k, 'the change was refuted and withdrawn' FROM st WHERE level = 'R' UNION ALL
SELECT k, 'execution boundary', CASE WHEN k % 4 = 1 THEN 'plain' ELSE 'unknown' END, '' FROM st WHERE k % 4 < 2 UNION ALL SELECT k, 'review: unknown', 'V' || k || ' at f:' || c, 'no plan' FROM st WHERE c % 6 = 0 UNION ALL
SELECT k, 'review: publish', 'V' || k, 'level ' || level FROM st WHERE level IN ('C', 'R')""")
def residual_report(spark: SparkSession, d: str) -> DataFrame:
    """What stays open of every run: limitations, sandboxes that bound nothing, unknown hypotheses, decisions of people."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    boxes = o.filter("o_orderkey % 4 <> 0").select(k.alias("run_id"), F.when(k % 4 == 1, "plain").otherwise("strong").alias("adapter"), (k % 4 != 1).alias("suitable"), F.lit(None).cast("string").alias("notes"))
    book = o.select(k.alias("run_id"), F.concat(F.lit("V"), k.cast("string")).alias("handle"), F.concat(F.lit("f:"), c.cast("string")).alias("location"), F.when(c % 6 == 0, "UNKNOWN").otherwise("VALIDATED").alias("status"), F.lit("no plan").alias("reason"))
    return integrity.residuals(_runs(spark, d), boxes, book)
