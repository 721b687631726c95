"""Registered queries: text, rules and graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provark.functions import text as tx
from provark.operators import flows, graph, reach, rules
from provark.plans.bindings import EDGES_SQL, LINES_SQL, NODES_SQL, key_edges, key_nodes, lines
from provark.plans.storage import query, table
from provark.sources import readers

_q = lambda s: "'" + s.replace("'", "''") + "'"


# -- text and files ---------------------------------------------------------------------------------
@query(f"""WITH {LINES_SQL} SELECT lang, count(*) AS n_lines, sum(length(content)) AS n_chars, max(line) AS last_line FROM lines GROUP BY lang""")
def line_explode_stats(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("content")).alias("n_chars"), F.max("line").alias("last_line"))


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, sha256(text) AS sha256,
  CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 2000 THEN 'long line'
       WHEN len(string_split(text, chr(10))) > 20 AND length(text) / len(string_split(text, chr(10))) > 400 THEN 'dense lines' END AS skip_reason FROM documents""")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    rows = readers.file_records(docs)
    return rows.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), "lines", "sha256", "skip_reason")


@query("""SELECT CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS n FROM (SELECT 'site/' || page_id % 7 || '/' || page_id || '.html' AS p FROM pages) GROUP BY 1""")
def dirname_rollup(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("site/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, d, "pages").groupBy(tx.dirname(path).alias("dir")).agg(F.count("*").alias("n"))


@query(r"""SELECT array_to_string(list_transform(string_split(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{n}' ELSE x END), '/') AS path, count(*) AS n FROM pages GROUP BY 1""")
def path_normalise(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"://[^/]*([^?#]*)", 1)
    return table(spark, d, "pages").groupBy(tx.normalised_path(path).alias("path")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(lower(p_type), '[^a-z0-9_]+', '_', 'g') AS metric,
  regexp_full_match(p_name, '[A-Za-z0-9._/@:+-]*') AS safe, length(p_type) - length(translate(p_type, 'AEIOU ', '')) AS vowels, split_part(p_type, ' ', -1) AS last_word FROM part""")
def identifier_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"), tx.clean_metric(F.col("p_type")).alias("metric"), tx.safe_charset(F.col("p_name")).alias("safe"), tx.count_of(F.col("p_type"), "AEIOU ").cast("long").alias("vowels"), tx.last_identifier(F.replace("p_type", F.lit(" "), F.lit("."))).alias("last_word"))


@query(r"""SELECT l_orderkey, l_linenumber, [l_linenumber - 1, l_linenumber, l_linenumber + 1, l_linenumber + 2] AS bounds FROM lineitem""")
def boundary_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.boundary_values(F.array("l_linenumber", F.col("l_linenumber") + 1)).alias("bounds"))


@query(r"""SELECT doc_id, list_filter([CASE WHEN contains(text, 'MIT License') THEN 'mit' END, CASE WHEN contains(text, 'All rights reserved') THEN 'reserved' END, CASE WHEN contains(text, '@') THEN 'at' END], lambda x: x IS NOT NULL) AS labels FROM documents""")
def marker_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.markers(F.col("text"), {"MIT License": "mit", "All rights reserved": "reserved", "@": "at"}).alias("labels"))


@query(r"""SELECT o_orderkey, printf('%02d:%02d', o_orderkey // 60, o_orderkey % 60) AS clock FROM orders""")
def clock_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.clock(F.col("o_orderkey") * 1000).alias("clock"))


# -- rules ------------------------------------------------------------------------------------------
def _rule_sql(rs=rules.TEXT_RULES) -> str:
    parts = []
    for i, r in enumerate(rs):
        where = f"regexp_matches(content, {_q(r.pattern)})" + (f" AND NOT regexp_matches(content, {_q(r.unless)})" if r.unless else "") + ("" if "*" in r.languages else f" AND lang IN ({', '.join(map(_q, r.languages))})")
        parts.append(f"SELECT id, lang, line, {_q(r.id)} AS rule_id, {_q(r.category)} AS category, {_q(r.severity)} AS severity, {r.confidence}::DOUBLE AS confidence, regexp_extract(content, {_q(r.pattern)}) AS snippet, {i} AS rule_seq, {_q(r.cwe)} AS cwe FROM lines WHERE {where}")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


RULES_SQL = f"{LINES_SQL}, {_rule_sql()}"


def hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_rules(lines(spark, d), rules.TEXT_RULES, "lang")


@query(f"WITH {RULES_SQL} SELECT rule_id, severity, count(*) AS n, count(DISTINCT id) AS docs FROM hits GROUP BY ALL")
def rule_hits_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"))


@query(f"WITH {RULES_SQL} SELECT category, id, line, rule_id, confidence, snippet FROM (SELECT *, row_number() OVER (PARTITION BY category, id, line ORDER BY confidence DESC, rule_seq) AS rn FROM hits) WHERE rn = 1")
def rule_hit_dedup(spark: SparkSession, d: str) -> DataFrame:
    return rules.dedup_hits(hits(spark, d)).select("category", "id", "line", "rule_id", "confidence", "snippet")


@query(f"WITH {LINES_SQL}, {_rule_sql(rules.override(rules.TEXT_RULES, [rules.Rule('ip', 'source', 'network', r'[0-9]{1,3}[.][0-9]{1,3}[.]', severity='high', confidence=0.9)]))} SELECT rule_id, severity, count(*) AS n FROM hits GROUP BY ALL")
def rule_override(spark: SparkSession, d: str) -> DataFrame:
    """An extension replaces a rule by id; one with a pattern that does not compile is refused."""
    extension = [rules.Rule("ip", "source", "network", r"[0-9]{1,3}[.][0-9]{1,3}[.]", severity="high", confidence=0.9), rules.Rule("email", "source", "x", "(")]
    found = rules.match_rules(lines(spark, d), rules.override(rules.TEXT_RULES, extension), "lang")
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {RULES_SQL}, every AS (SELECT rule_id AS rule, id::VARCHAR AS file, line, 0 AS e FROM hits UNION ALL SELECT 'email', doc_id::VARCHAR, 1, 1 FROM documents WHERE contains(text, '@'))
SELECT rule, file, line, CASE min(e) WHEN 0 THEN 'lines' ELSE 'whole' END AS engine FROM every GROUP BY rule, file, line""")
def engine_dedup(spark: SparkSession, d: str) -> DataFrame:
    first = hits(spark, d).select(F.col("rule_id").alias("rule"), F.col("id").cast("string").alias("file"), "line", F.lit("lines").alias("engine"))
    whole = table(spark, d, "documents").filter(F.contains("text", F.lit("@"))).select(F.lit("email").alias("rule"), F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit("whole").alias("engine"))
    return rules.union_engines([first, whole])


@query(rf"""WITH {LINES_SQL}, s AS (SELECT id, line, lower(regexp_extract(content, '([A-Za-z_]+) *[:=] *"?([^" ]+)', 1)) AS setting, regexp_extract(content, '([A-Za-z_]+) *[:=] *"?([^" ]+)', 2) AS value FROM lines)
SELECT setting, count(*) AS n, min(value) AS least FROM s WHERE setting <> '' AND NOT regexp_matches(lower(value), '^(changeme|placeholder|example|xxx+|your[-_].*)$') GROUP BY setting""")
def setting_scan(spark: SparkSession, d: str) -> DataFrame:
    return rules.setting_hits(lines(spark, d)).groupBy("setting").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query(f"""WITH {RULES_SQL} SELECT id, count(*) AS hits, round(max(confidence), 4) AS confidence FROM hits WHERE category = 'sink' GROUP BY id ORDER BY confidence DESC, hits DESC, id LIMIT 40""")
def top_sink_documents(spark: SparkSession, d: str) -> DataFrame:
    own = hits(spark, d).filter("category = 'sink'").groupBy("id").agg(F.count("*").alias("hits"), F.round(F.max("confidence"), 4).alias("confidence"))
    return own.orderBy(F.desc("confidence"), F.desc("hits"), "id").limit(40)


# -- graph ------------------------------------------------------------------------------------------
@query(f"WITH {EDGES_SQL} SELECT src, kind, dst, provenance, confidence, resolved FROM edges")
def graph_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_edges(key_edges(spark, d)).select("src", "kind", "dst", "provenance", "confidence", "resolved")


@query(f"""WITH {EDGES_SQL} SELECT count(*) AS edges_total, count(*) FILTER (len(provenance) > 1) AS edges_corroborated,
  count(*) FILTER (resolved AND len(provenance) = 1) AS edges_resolved_only, count(*) FILTER (NOT resolved) AS edges_name_only FROM edges""")
def graph_merge_report(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_report(graph.merge_edges(key_edges(spark, d)))


@query(f"""WITH {EDGES_SQL}, {NODES_SQL}
SELECT 'node_kind' AS metric, kind AS key, count(*)::DOUBLE AS value FROM nodes GROUP BY kind UNION ALL
SELECT 'edge_kind', kind, count(*) FROM edges GROUP BY kind UNION ALL
SELECT 'provider', p, count(*) FROM (SELECT unnest(provenance) AS p FROM edges) GROUP BY p UNION ALL
SELECT 'language', 'none', count(*) FROM nodes UNION ALL
SELECT 'resolved_ratio', 'all', round(count(*) FILTER (resolved) / count(*), 4) FROM edges""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(key_nodes(spark, d).withColumn("language", F.lit("none")), graph.merge_edges(key_edges(spark, d)))


@query("""WITH n AS (SELECT s_suppkey AS k, s_suppkey % 40 AS u, s_name AS name, s_acctbal AS b FROM supplier)
SELECT 'u:' || u AS uid, arg_min(CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'function' END, CASE WHEN k % 3 = 0 THEN k + 1000000000 ELSE k END) AS kind,
  arg_min(name, k) FILTER (k % 2 = 1) AS name, min(k) FILTER (k % 5 > 0) % 5 AS first_mod, max(k) AS end_line, bool_or(k % 7 = 0) AS exported,
  list_sort(list(DISTINCT 'p' || k % 3)) AS provenance, arg_max(k, k)::VARCHAR AS last_attr FROM n GROUP BY u""")
def graph_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    raw = table(spark, d, "supplier").select(
        F.concat(F.lit("u:"), (k % 40).cast("string")).alias("uid"), F.when(k % 3 == 0, "unknown").otherwise("function").alias("kind"), F.when(k % 2 == 1, F.col("s_name")).otherwise("").alias("name"),
        F.lit("q").alias("qualname"), F.lit("f").alias("file"), F.lit("l").alias("language"), F.lit("").alias("signature"), F.lit("").alias("docline"), (k % 5).alias("start_line"), k.alias("end_line"), (k % 7 == 0).alias("exported"),
        none.alias("parameters"), none.alias("decorators"), F.array(F.concat(F.lit("p"), (k % 3).cast("string"))).alias("provenance"), F.create_map(F.lit("a"), k.cast("string")).alias("attrs"), k.alias("seq"),
    )
    return graph.merge_nodes(raw).select("uid", "kind", "name", F.col("start_line").alias("first_mod"), "end_line", "exported", "provenance", F.col("attrs")["a"].alias("last_attr"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, confidence FROM edges WHERE resolved AND kind IN ('HAS_CUSTOMER', 'HAS_SUPPLIER') AND src = 'nation:3'")
def out_edges_resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_edges(graph.merge_edges(key_edges(spark, d)), "nation:3", ("HAS_CUSTOMER", "HAS_SUPPLIER"), "resolved").select("src", "dst", "confidence")


@query(f"""WITH {EDGES_SQL}, o AS (SELECT src AS uid, list_sort(list(DISTINCT dst)) AS callees FROM edges WHERE kind = 'PLACED' GROUP BY src), i AS (SELECT dst AS uid, list_sort(list(DISTINCT src)) AS callers FROM edges WHERE kind = 'PLACED' GROUP BY dst)
SELECT coalesce(o.uid, i.uid) AS uid, len(coalesce(callees, [])) AS n_out, len(coalesce(callers, [])) AS n_in, callees[1] AS first_out FROM o FULL JOIN i ON o.uid = i.uid""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    own = graph.neighbours(graph.merge_edges(key_edges(spark, d)), "PLACED")
    return own.select("uid", F.size("callees").alias("n_out"), F.size("callers").alias("n_in"), F.try_element_at("callees", F.lit(1)).alias("first_out"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT DISTINCT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS uid, 0 AS hops FROM region UNION SELECT root, dst, hops + 1 FROM c JOIN edges ON uid = src WHERE hops < 6)
SELECT root, hops, count(*) AS n FROM (SELECT root, uid, min(hops) AS hops FROM c GROUP BY root, uid) WHERE hops > 0 GROUP BY root, hops""")
def closure_depth6(spark: SparkSession, d: str) -> DataFrame:
    seeds = key_nodes(spark, d).filter("kind = 'region'").select("uid")
    return graph.reach(graph.merge_edges(key_edges(spark, d)), seeds, 6).counts()


@query("""WITH RECURSIVE n AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT DISTINCT a, b FROM n WHERE a IS NOT NULL AND b IS NOT NULL), c AS (SELECT DISTINCT a AS root, a AS uid, 0 AS hops FROM (SELECT user_id AS a FROM events WHERE user_id IS NOT NULL) UNION SELECT root, b, hops + 1 FROM c JOIN e ON uid = a WHERE hops < 6)
SELECT root, uid, min(hops) AS hops FROM c WHERE uid <> root GROUP BY root, uid""")
def closure_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """A dense graph with cycles: who follows whom in the event log, from every user to every other. Users travel as
    tiles of bits, pairs are made at the end. What follows a row is read within its day, and across days between their ends, so
    no task orders the whole log."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id").withColumn("day", F.to_date("ts"))
    inner = e.withColumn("b", F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))).select("user_id", "b")
    ends = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.col("last").alias("user_id"), F.lead("first").over(Window.orderBy("day")).alias("b"))  # a row a day
    step = inner.union(across).filter("user_id is not null and b is not null")
    edges = step.select(F.col("user_id").alias("src"), F.col("b").alias("dst"))
    return reach.every_pair(edges, e.select(F.col("user_id").alias("uid")), 6)


@query(f"""WITH {EDGES_SQL}, p1 AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS uid FROM region)
SELECT p1.root, e3.dst AS uid, [p1.uid, e1.dst, e2.dst, e3.dst] AS path, least(e1.confidence, e2.confidence, e3.confidence) AS confidence
FROM p1 JOIN edges e1 ON e1.src = p1.uid JOIN edges e2 ON e2.src = e1.dst JOIN edges e3 ON e3.src = e2.dst WHERE e3.kind = 'PLACED'""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    seeds = key_nodes(spark, d).filter("kind = 'region'").select("uid")
    return graph.shortest_paths(graph.merge_edges(key_edges(spark, d)), seeds, 4).filter(F.size("path") == 4).select("root", "uid", "path", "confidence")


_REACH = f"""WITH {EDGES_SQL}, {NODES_SQL},
l0 AS (SELECT 'region:' || r_regionkey AS uid, 0 AS hops, 1.0::DOUBLE AS confidence FROM region WHERE r_regionkey < 3),
l1 AS (SELECT dst AS uid, 1 AS hops, least(l0.confidence, e.confidence) AS confidence FROM l0 JOIN edges e ON e.src = l0.uid),
l2 AS (SELECT dst AS uid, 2 AS hops, least(l1.confidence, e.confidence) AS confidence FROM l1 JOIN edges e ON e.src = l1.uid),
r AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def _reach(spark: SparkSession, d: str) -> DataFrame:
    nodes = key_nodes(spark, d)
    edges = graph.merge_edges(key_edges(spark, d))
    entry = nodes.filter("kind = 'region' and seq < 3").select("uid")
    return graph.reachability(nodes, edges, entry, paths=False)


@query(_REACH + " SELECT n.uid, r.uid IS NOT NULL AS reachable, true AS measured, r.hops, r.confidence FROM nodes n LEFT JOIN r ON n.uid = r.uid")
def reach_depth(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d).select("uid", "reachable", "measured", "hops", "confidence")


@query(_REACH + " SELECT n.uid, round(CASE WHEN r.uid IS NULL THEN CASE WHEN n.uid IN (SELECT dst FROM edges) THEN 0.15 ELSE 0.05 END ELSE greatest(0.4, 1 - 0.08 * r.hops) * greatest(r.confidence, 0.5) END, 3) AS score FROM nodes n LEFT JOIN r ON n.uid = r.uid")
def reach_score(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachability_score(_reach(spark, d)).select("uid", "score")


@query(f"WITH {NODES_SQL} SELECT uid, false AS reachable, false AS measured, 0.05::DOUBLE AS score FROM nodes WHERE kind = 'nation'")
def reach_unmeasured(spark: SparkSession, d: str) -> DataFrame:
    """Without entrypoints nothing is measured, which is told from unreachable."""
    nodes = key_nodes(spark, d).filter("kind = 'nation'")
    none = spark.createDataFrame([], "uid string")
    return graph.reachability_score(graph.reachability(nodes, graph.merge_edges(key_edges(spark, d)), none, paths=False)).select("uid", "reachable", "measured", "score")


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, s AS (SELECT uid FROM nodes WHERE kind = 'supplier'), c AS (SELECT uid AS root, uid, 0 AS hops FROM s UNION SELECT root, src, hops + 1 FROM c JOIN edges ON uid = dst WHERE hops < 6),
k AS (SELECT root, c.uid, regexp_replace(n.file, '/[^/]*$', '') AS module, min(hops) AS hops FROM c LEFT JOIN nodes n ON n.uid = c.uid WHERE hops > 0 GROUP BY ALL),
g AS (SELECT root, count(*) FILTER (hops = 1) AS direct, count(*) AS transitive, count(DISTINCT module) AS modules FROM k GROUP BY root)
SELECT s.uid, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(modules, 0) AS modules, round(least(1.0, 0.2 + 0.03 * coalesce(transitive, 0) + 0.08 * coalesce(modules, 0)), 3)::DOUBLE AS score FROM s LEFT JOIN g ON g.root = s.uid""")
def blast_score(spark: SparkSession, d: str) -> DataFrame:
    nodes = key_nodes(spark, d)
    return graph.blast_radius(graph.merge_edges(key_edges(spark, d)), nodes, nodes.filter("kind = 'supplier'").select("uid"))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT dst AS uid FROM b WHERE src = 'nation:4'), h2 AS (SELECT DISTINCT dst AS uid FROM b JOIN h1 ON src = h1.uid WHERE dst <> 'nation:4' AND dst NOT IN (SELECT uid FROM h1))
SELECT uid, hops FROM (SELECT 'nation:4' AS uid, 0 AS hops UNION ALL SELECT uid, 1 FROM h1 UNION ALL SELECT uid, 2 FROM h2) ORDER BY hops, uid LIMIT 200""")
def subgraph2(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(graph.merge_edges(key_edges(spark, d)), "nation:4", 2, 200)


@query(f"""WITH {NODES_SQL}, o AS (SELECT uid, file, regexp_replace(file, '/[^/]*$', '') AS dir FROM nodes)
SELECT uid, sibling, tier, rank FROM (SELECT a.uid, b.uid AS sibling, CASE WHEN a.file = b.file THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY a.uid ORDER BY CASE WHEN a.file = b.file THEN 1 ELSE 2 END, b.uid) AS rank FROM o a JOIN o b ON a.dir = b.dir AND a.uid <> b.uid) WHERE rank <= 40""")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    return graph.siblings(key_nodes(spark, d))


@query(f"WITH {NODES_SQL} SELECT uid, name FROM nodes WHERE contains(lower(name), '12') OR contains(lower(uid), '12') ORDER BY lower(name) <> '12', length(uid), uid LIMIT 40")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_symbols(key_nodes(spark, d).withColumn("qualname", F.lit("")), "12").select("uid", "name")


@query("""WITH s AS (SELECT user_id, event_id AS uid, epoch_us(ts) // 1000000 AS a, lead(epoch_us(ts) // 1000000, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type <> 'view'),
p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS line FROM events WHERE event_type = 'view')
SELECT event_id, arg_max(uid, a * 100000000 - uid) AS owner FROM (SELECT p.event_id, s.uid, s.a FROM p LEFT JOIN s ON s.user_id = p.user_id AND p.line BETWEEN s.a AND coalesce(s.b, s.a)) GROUP BY event_id""")
def innermost_interval(spark: SparkSession, d: str) -> DataFrame:
    """Views in the innermost span of their user's other events (each spans to the third next)."""
    e = table(spark, d, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    own = e.filter("event_type <> 'view'")
    spans = own.select("user_id", F.col("event_id").alias("uid"), F.col("sec").alias("start_line"), F.lead("sec", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("end_line"), F.col("event_id").alias("seq"))
    points = e.filter("event_type = 'view'").select("event_id", "user_id", F.col("sec").alias("line"))
    return graph.innermost(points, spans, ("user_id",)).select("event_id", "owner")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT uid FROM nodes WHERE kind = 'customer' AND uid NOT IN (SELECT src FROM edges WHERE kind = 'PLACED')""")
def untested_entities(spark: SparkSession, d: str) -> DataFrame:
    nodes = key_nodes(spark, d).filter("kind = 'customer'").withColumn("kind", F.lit("function"))
    return graph.untested(nodes, graph.merge_edges(key_edges(spark, d)).filter("kind = 'PLACED'").withColumn("kind", F.lit("TESTED_BY"))).select("uid")


@query("""WITH s AS (SELECT p_partkey AS uid, 'd' || p_size % 5 || '/f' || p_partkey % 11 AS file, p_brand AS name, 'd' || p_size % 5 AS dir FROM part),
c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS call_id, 'd' || l_suppkey % 5 || '/f' || l_partkey % 11 AS file, 'd' || l_suppkey % 5 AS dir, 'Brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1) AS name FROM lineitem),
t AS (SELECT 1 AS tier, name, file AS place, count(*) AS n, list_sort(list(uid))[:3] AS ids FROM s GROUP BY name, file UNION ALL SELECT 2, name, dir, count(*), list_sort(list(uid))[:3] FROM s GROUP BY name, dir UNION ALL SELECT 3, name, '', count(*), list_sort(list(uid))[:3] FROM s GROUP BY name),
j AS (SELECT call_id, tier, n, ids FROM c JOIN t USING (name) WHERE place = CASE tier WHEN 1 THEN file WHEN 2 THEN dir ELSE '' END),
b AS (SELECT call_id, min(tier) AS tier FROM j GROUP BY call_id),
p AS (SELECT call_id, tier, sum(n) AS n, list_sort(flatten(list(ids)))[:3] AS ids FROM j JOIN b USING (call_id, tier) GROUP BY call_id, tier)
SELECT call_id, unnest(ids) AS dst, tier, round(CASE tier WHEN 1 THEN 0.75 WHEN 2 THEN 0.55 ELSE 0.35 END / least(n, 3), 3)::DOUBLE AS confidence FROM p""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    return _resolve(table(spark, d, "part"), table(spark, d, "lineitem"))


def _resolve(part: DataFrame, li: DataFrame) -> DataFrame:
    place = lambda a, b: F.concat(F.lit("d"), (a % 5).cast("string"), F.lit("/f"), (b % 11).cast("string"))
    p = part.select(F.col("p_partkey").alias("uid"), place(F.col("p_size"), F.col("p_partkey")).alias("file"), F.col("p_brand").alias("name"))
    name = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 5 + 1).cast("string"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    calls = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.lit(-1).cast("long").alias("caller"), place(F.col("l_suppkey"), F.col("l_partkey")).alias("file"), name.alias("name")).distinct()
    return graph.resolve_names(calls, p)


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'source' AS side, src AS missing, count(*) AS n FROM edges WHERE src NOT IN (SELECT uid FROM nodes WHERE seq % 9 <> 0) GROUP BY src UNION ALL SELECT 'target', dst, count(*) FROM edges WHERE kind <> 'PLACED' AND dst NOT IN (SELECT uid FROM nodes WHERE seq % 9 <> 0) GROUP BY dst UNION ALL SELECT 'target', 'orders', count(*) FROM edges WHERE kind = 'PLACED'")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    loose = graph.dangling(key_nodes(spark, d).filter("seq % 9 <> 0"), graph.merge_edges(key_edges(spark, d)))
    named = loose.withColumn("missing", F.when(F.col("missing").startswith("order:"), "orders").otherwise(F.col("missing")))
    return named.groupBy("side", "missing").agg(F.count("*").alias("n"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT uid FROM nodes WHERE uid NOT IN (SELECT src FROM edges WHERE kind IN ('PLACED', 'HAS_NATION')) AND uid NOT IN (SELECT dst FROM edges WHERE kind IN ('PLACED', 'HAS_NATION'))")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = key_edges(spark, d).filter("kind in ('PLACED', 'HAS_NATION')")  # merged ones have the same ends
    return graph.orphans(key_nodes(spark, d), edges).select("uid")


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, s AS (SELECT uid FROM nodes WHERE file = 'crm/customer/3'), u1 AS (SELECT DISTINCT src AS uid FROM edges JOIN s ON dst = s.uid), u2 AS (SELECT DISTINCT src AS uid FROM edges JOIN u1 ON dst = u1.uid),
u AS (SELECT uid FROM u1 UNION SELECT uid FROM u2), a AS (SELECT uid FROM s UNION SELECT uid FROM u)
SELECT 'symbol' AS kind, uid FROM s UNION ALL SELECT 'dependent', uid FROM u UNION ALL SELECT DISTINCT 'file', file FROM nodes WHERE uid IN (SELECT uid FROM a) UNION ALL SELECT 'entrypoint', uid FROM a WHERE starts_with(uid, 'region')""")
def affected_closure(spark: SparkSession, d: str) -> DataFrame:
    nodes = key_nodes(spark, d)
    changed = spark.createDataFrame([("crm/customer/3",)], "file string")
    return graph.affected(changed, nodes, graph.merge_edges(key_edges(spark, d)), nodes.filter("kind = 'region'"))


# -- flows ------------------------------------------------------------------------------------------
_FLOWS = f"""{EDGES_SQL}, src AS (SELECT 's' || r_regionkey AS ref, 'region:' || r_regionkey AS owner, 0.5 + 0.1 * (r_regionkey % 3) AS c FROM region),
snk AS (SELECT 'k' || c_custkey AS ref, 'customer:' || c_custkey AS owner, 0.3 + 0.1 * (c_custkey % 7) AS c FROM customer),
f AS (SELECT src.ref AS source_ref, snk.ref AS sink_ref, src.c AS sc, snk.c AS kc, least(e1.confidence, e2.confidence) AS pc, e1.resolved AND e2.resolved AS resolved FROM src JOIN edges e1 ON e1.src = src.owner JOIN edges e2 ON e2.src = e1.dst JOIN snk ON snk.owner = e2.dst)"""


def _pairs(spark: SparkSession, d: str, cap: int = 20_000) -> DataFrame:
    edges, nodes = graph.merge_edges(key_edges(spark, d)), key_nodes(spark, d)
    sources = nodes.filter("kind = 'region'").select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("ref"), F.col("uid").alias("owner"), (0.5 + 0.1 * (F.col("seq") % 3)).alias("confidence"))
    sinks = nodes.filter("kind = 'customer'").select(F.concat(F.lit("k"), F.col("seq").cast("string")).alias("ref"), F.col("uid").alias("owner"), (0.3 + 0.1 * (F.col("seq") % 7)).alias("confidence"))
    return flows.pair_flows(sources, sinks, graph.shortest_paths(edges, sources.select(F.col("owner").alias("uid")), 3), cap)


@query(f"WITH {_FLOWS} SELECT source_ref, sink_ref, round(pc, 3)::DOUBLE AS path_confidence FROM f ORDER BY round(sc, 6) DESC, round(kc, 6) DESC, source_ref, sink_ref LIMIT 500")
def flow_pairs_capped(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 500).select("source_ref", "sink_ref", F.round("path_confidence", 3).alias("path_confidence"))


@query(f"WITH {_FLOWS} SELECT source_ref, sink_ref, round(least(0.9, greatest(0.05, least(sc, kc) * CASE WHEN pc = 1 THEN 1.0 ELSE 0.6 END * greatest(0.4, 1 - 0.08 * (3 - 2)) * 0.55)), 3)::DOUBLE AS confidence, round(least(sc, kc) * 0.5, 4)::DOUBLE AS proximity FROM f")
def flow_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, 1 << 30)
    value = flows.call_path_confidence(F.col("source_confidence"), F.col("sink_confidence"), F.col("path_confidence") == 1, F.size("path"), F.lit(True))
    return p.select("source_ref", "sink_ref", value.alias("confidence"), F.round(flows.proximity_confidence(F.col("source_confidence"), F.col("sink_confidence")), 4).alias("proximity"))


_SURFACE = """SELECT o_orderkey, round(((CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END / 5)
 * (CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.7 ELSE 0.4 END) * (CASE WHEN o_custkey % 5 = 0 THEN (CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END / 5) WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.25 END)
 * greatest(0.05, (o_orderkey % 11) / 10) * (CASE WHEN o_orderkey % 3 = 0 THEN 0.6 ELSE 1.0 END) * (CASE WHEN o_orderkey % 4 = 0 THEN 0.7 ELSE 1.0 END) * (CASE WHEN o_orderkey % 5 = 0 THEN 0.85 ELSE 1.0 END))::VARCHAR::DECIMAL(30, 20), 6)::DOUBLE AS priority FROM orders"""


def _surface(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    names = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low"}
    severity = F.coalesce(F.create_map(*[x for a, b in names.items() for x in (F.lit(a), F.lit(b))])[F.col("o_orderpriority")], F.lit("info"))
    rows = o.select(
        "o_orderkey", severity.alias("severity"), F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "indirect").otherwise("weak").alias("controllability"), (F.col("o_custkey") % 2 == 0).alias("reachable"), (F.col("o_custkey") % 5 != 0).alias("measured"),
        ((k % 11) / 10).alias("confidence"), (k % 3 == 0).alias("controls"), (k % 4 == 0).alias("sanitized"), (k % 5 == 0).alias("covered"),
    )
    return flows.surface_priority(rows)


@query(_SURFACE)
def surface_priority(spark: SparkSession, d: str) -> DataFrame:
    return _surface(spark, d).select("o_orderkey", "priority")


@query(f"SELECT * FROM ({_SURFACE}) ORDER BY priority DESC, o_orderkey LIMIT 100")
def top_surface(spark: SparkSession, d: str) -> DataFrame:
    return _surface(spark, d).select("o_orderkey", "priority").orderBy(F.desc("priority"), "o_orderkey").limit(100)


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, (o_orderkey % 20) / 20 AS conf FROM orders)
SELECT k AS ref, p AS severity, conf::DOUBLE AS confidence FROM x ORDER BY (c % 2 = 0) DESC, CASE p WHEN '1-URGENT' THEN 5 ELSE 0 END DESC, conf DESC, k LIMIT 2000""")
def top_flows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("none").alias("severity"), ((F.col("o_orderkey") % 20) / 20).alias("confidence"), (F.col("o_custkey") % 2 == 0).alias("reachable"))
    return flows.top_flows(rows).select("ref", F.col("p").alias("severity"), "confidence")


@query("""SELECT p_partkey, round(least(0.95, greatest(0.05, 0.5 + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END - CASE WHEN p_size % 3 = 0 THEN 0.15 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 0.35 ELSE 0 END - least(0.2, 0.03 * (p_size % 9)))), 3)::DOUBLE AS taint,
 round(least(0.97, 0.55 + CASE WHEN p_size % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END + least(0.1, 0.02 * (p_size % 9))), 2)::DOUBLE AS triage FROM part""")
def taint_and_triage(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "part"), F.col("p_size")
    return p.select("p_partkey", flows.taint_confidence(F.lit(0.5), s % 9, s % 2 == 0, s % 3 == 0, s % 5 == 0).alias("taint"), flows.triage(F.when(s % 4 == 0, "CWE-1").otherwise(""), s % 2 == 0, s % 9).alias("triage"))
