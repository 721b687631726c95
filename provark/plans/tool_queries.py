"""Registered queries: the read tools over a model of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.operators import flows, graph, rules, tools
from provark.plans.bindings import EDGES_SQL, key_edges, lines
from provark.plans.storage import query, table

#: The keys as a code model: customers are functions called by their nation's class, suppliers its methods and imports.
KINDS = {"HAS_CUSTOMER": "CALLS", "HAS_NATION": "CONTAINS", "PLACED": "TESTED_BY"}


def _edges(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")], F.when(F.col("seq") % 2 == 0, "IMPORTS").otherwise("HAS_METHOD"))
    return graph.merge_edges(key_edges(spark, d)).withColumn("kind", kind)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, key, kind, label: table(spark, d, name).select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("uid"), F.lit(kind).alias("kind"), F.col(f"{name[0]}_name").alias("name"), F.concat(F.lit("doc/"), (F.col(key) % 100).cast("string")).alias("file"), F.col(key).cast("long").alias("seq"))
    rows = one("customer", "c_custkey", "function", "customer").union(one("supplier", "s_suppkey", "method", "supplier")).union(one("nation", "n_nationkey", "class", "nation"))
    return rows.withColumns({"start_line": (F.col("seq") % 7 + 1).cast("long"), "end_line": (F.col("seq") % 7 + 1 + F.col("seq") % 5).cast("long"), "qualname": F.col("name")})


MODEL_SQL = f"""{EDGES_SQL}, me AS (SELECT src, dst, confidence, CASE kind WHEN 'HAS_CUSTOMER' THEN 'CALLS' WHEN 'HAS_NATION' THEN 'CONTAINS' WHEN 'PLACED' THEN 'TESTED_BY' ELSE CASE WHEN seq % 2 = 0 THEN 'IMPORTS' ELSE 'HAS_METHOD' END END AS kind FROM edges),
mk AS (SELECT 'customer:' || c_custkey AS uid, 'function' AS kind, c_name AS name, c_custkey::BIGINT AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'method', s_name, s_suppkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, n_nationkey FROM nation),
mn AS (SELECT uid, kind, name, k AS seq, 'doc/' || k % 100 AS file, k % 7 + 1 AS a, k % 7 + 1 + k % 5 AS b FROM mk)"""
ROLES_SQL = "ro AS (SELECT 'r' || s_suppkey AS ref, ['source', 'sink', 'sanitizer', 'validator', 'control'][s_suppkey % 5 + 1] AS category, (s_suppkey % 10) / 10 AS confidence, 'customer:' || s_suppkey AS owner FROM supplier)"
FLOWS_SQL = "fl AS (SELECT 'f' || o_orderkey AS ref, 'customer:' || o_custkey AS a, 'nation:' || o_custkey % 25 AS b, o_custkey % 2 = 0 AS reachable, CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' ELSE 'low' END AS severity, (o_orderkey % 20) / 20 AS confidence FROM orders)"


def _roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, ("source", "sink", "sanitizer", "validator", "control")))
    return table(spark, d, "supplier").select(F.concat(F.lit("r"), k.cast("string")).alias("ref"), F.element_at(names, (k % 5 + 1).cast("int")).alias("category"), ((k % 10) / 10).alias("confidence"), F.concat(F.lit("customer:"), k.cast("string")).alias("owner"))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    path = F.array(F.concat(F.lit("nation:"), (c % 25).cast("string")), F.concat(F.lit("customer:"), c.cast("string")))
    return o.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("ref"), path.alias("path"), (c % 2 == 0).alias("reachable"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("low").alias("severity"), ((F.col("o_orderkey") % 20) / 20).alias("confidence"))


def model(spark: SparkSession, d: str) -> tools.Model:
    t = lambda n: table(spark, d, n)
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    return tools.Model(
        nodes,
        edges,
        files=t("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text"),
        roles=_roles(spark, d),
        flows=_flows(spark, d),
        settings=rules.setting_hits(lines(spark, d)),
        dependencies=t("part").select(F.col("p_brand").alias("ecosystem"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name")),
        observations=t("events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("seq"), "value"),
        coverage=t("lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").alias("line")),
        boundaries=t("orders").select(F.explode(flows.boundaries(F.col("o_orderstatus"), F.col("o_orderpriority"), {"F": "network", "O": "process"}, {"1-URGENT": "shell", "2-HIGH": "network"})).alias("boundary")),
    )


def _cap(q: str, order: str, n: int = tools.ROWS) -> str:
    return f"WITH RECURSIVE {MODEL_SQL}, {ROLES_SQL}, {FLOWS_SQL}, q AS ({q}) SELECT *, (SELECT count(*) FROM q) > {n} AS truncated FROM q ORDER BY {order} LIMIT {n}"


@query("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id = 3) SELECT line, content FROM l WHERE line <= 160 AND NOT (line = n AND content = '')")
def tool_get_file(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_file(model(spark, d), "doc/3")


@query(f"WITH {MODEL_SQL} SELECT uid, kind, name, [] AS callees, list_sort((SELECT list(DISTINCT src) FROM me WHERE kind = 'CALLS' AND dst = 'customer:8')) AS callers FROM mn WHERE uid = 'customer:8'")
def tool_get_function(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_function(model(spark, d), "customer:8").select("uid", "kind", "name", "callees", "callers")


@query(_cap("SELECT uid, kind, name FROM mn WHERE uid IN (SELECT dst FROM me WHERE src = 'nation:3' AND kind IN ('CONTAINS', 'HAS_METHOD'))", "uid"))
def tool_get_class(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_class(model(spark, d), "nation:3").select("uid", "kind", "name", "truncated")


@query(_cap("SELECT src AS uid, confidence FROM me WHERE kind = 'CALLS' AND dst = 'customer:10'", "uid"))
def tool_get_callers(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_callers(model(spark, d), "customer:10")


@query(_cap("SELECT dst AS uid, confidence FROM me WHERE kind = 'CALLS' AND src = 'nation:2'", "uid"))
def tool_get_callees(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_callees(model(spark, d), "nation:2")


@query(_cap("SELECT dst AS uid FROM me WHERE kind = 'IMPORTS' AND src = 'nation:4'", "uid"))
def tool_get_imports(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_imports(model(spark, d), "nation:4")


@query(_cap("SELECT DISTINCT src AS uid, 1 AS hops FROM me WHERE kind = 'CALLS' AND dst = 'customer:12'", "hops, uid"))
def tool_get_dependents(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_dependents(model(spark, d), "customer:12")


@query(f"""WITH {MODEL_SQL}, s AS (SELECT b.uid AS sibling, CASE WHEN a.file = b.file THEN 1 ELSE 2 END AS tier FROM mn a JOIN mn b ON a.uid <> b.uid WHERE a.uid = 'supplier:7')
SELECT 'supplier:7' AS uid, sibling, tier, row_number() OVER (ORDER BY tier, sibling) AS rank FROM s QUALIFY rank <= 40""")
def tool_get_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_siblings(model(spark, d), "supplier:7")


@query("""SELECT 'region:1' AS root, 'customer:' || c_custkey AS uid, ['region:1', 'nation:' || c_nationkey, 'customer:' || c_custkey] AS path,
  CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 2 = 0 THEN 'resolved' ELSE 'union' END AS precision FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def path_precision(spark: SparkSession, d: str) -> DataFrame:
    """Resolved paths first, else those of all edges, with the precision said."""
    edges, root = _edges(spark, d).filter("kind in ('CONTAINS', 'CALLS')"), spark.createDataFrame([("region:1",)], "uid string")
    found = flows.coalesce_paths(*[graph.shortest_paths(e, root, 4) for e in (graph.admitted(edges, "resolved"), edges)])
    return found.filter("uid like 'customer:%'")


@query("""SELECT 'region:1' AS root, 'customer:' || c_custkey AS uid, ['region:1', 'nation:' || c_nationkey, 'customer:' || c_custkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_custkey = (SELECT min(c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)""")
def tool_get_execution_path(spark: SparkSession, d: str) -> DataFrame:
    """The path to the first customer of a region."""
    m = model(spark, d)
    paths = graph.shortest_paths(m.edges.filter("kind in ('CONTAINS', 'CALLS')"), spark.createDataFrame([("region:1",)], "uid string"), 4)
    first = paths.filter("uid like 'customer:%'").agg(F.min(F.substring_index("uid", ":", -1).cast("long"))).head()[0]
    return tools.get_execution_path(tools.Model(m.nodes, m.edges, paths=paths), "region:1", f"customer:{first}").select("root", "uid", "path")


@query(_cap("SELECT ref, confidence::DOUBLE AS confidence FROM fl WHERE b = 'nation:4'", "confidence DESC, ref"))
def tool_get_dataflow(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_dataflow(model(spark, d), "nation:4").select("ref", "confidence", "truncated")


def _role_query(name: str, *categories: str):
    wanted = ", ".join(f"'{c}'" for c in categories)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return tools.TOOLS[name](model(spark, d)).select("ref", "category", "confidence", "truncated")

    query(_cap(f"SELECT ref, category, confidence::DOUBLE AS confidence FROM ro WHERE category IN ({wanted})", "confidence DESC, ref"), f"tool_{name}")(run)


for _name, *_categories in (("get_sources", "source"), ("get_sinks", "sink"), ("get_sanitizers", "sanitizer", "validator"), ("get_controls", "control")):
    _role_query(_name, *_categories)


@query("SELECT DISTINCT b AS boundary, false AS truncated FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'network' WHEN 'O' THEN 'process' END AS b FROM orders UNION ALL SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'shell' WHEN '2-HIGH' THEN 'network' END FROM orders) WHERE b IS NOT NULL")
def tool_get_trust_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_trust_boundaries(model(spark, d))


@query(f"WITH {FLOWS_SQL} SELECT ref, severity, confidence::DOUBLE AS confidence FROM fl ORDER BY reachable DESC, severity = 'critical' DESC, confidence DESC, ref LIMIT 40")
def tool_get_security_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_security_candidates(model(spark, d)).select("ref", "severity", "confidence")


@query(_cap("SELECT DISTINCT dst AS test FROM me WHERE kind = 'TESTED_BY' AND src = 'customer:4'", "test"))
def tool_get_related_tests(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_related_tests(model(spark, d), "customer:4")


@query("SELECT true AS available, count(DISTINCT l_partkey) AS covered FROM lineitem WHERE l_suppkey = 3")
def tool_get_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_coverage(model(spark, d), "3")


@query("SELECT false AS available, NULL::BIGINT AS covered FROM region WHERE r_regionkey = 0")
def tool_get_coverage_absent(spark: SparkSession, d: str) -> DataFrame:
    """Coverage that no run measured is absent, not 0."""
    return tools.get_coverage(tools.Model(_nodes(spark, d), _edges(spark, d)), "3")


@query(_cap("SELECT event_type AS scope, event_id AS seq, value FROM events WHERE event_type = 'error'", "seq"))
def tool_get_runtime_observations(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_runtime_observations(model(spark, d), "error")


@query(_cap("SELECT p_brand AS ecosystem, p_name || ' ' || p_partkey AS name FROM part WHERE p_brand = 'Brand#22'", "ecosystem, name"))
def tool_get_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_dependencies(model(spark, d), "Brand#22")


@query(f"WITH {MODEL_SQL} SELECT 'doc' AS module, count(*) AS nodes, count(*) FILTER (kind IN ('function', 'method')) AS callables, false AS truncated FROM mn")
def tool_get_architecture_summary(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_architecture_summary(model(spark, d))


@query(f"WITH {MODEL_SQL} SELECT uid, name FROM mn WHERE contains(lower(name), '00003') OR contains(lower(uid), '00003') ORDER BY lower(name) <> '00003', length(uid), uid LIMIT 40")
def tool_search_symbols(spark: SparkSession, d: str) -> DataFrame:
    return tools.search_symbols(model(spark, d), "00003").select("uid", "name")


@query(f"""WITH {MODEL_SQL}, l AS (SELECT 'doc/' || doc_id AS file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT * FROM l WHERE contains(content, 'License') ORDER BY file, line LIMIT 30)
SELECT h.file, h.line, h.content, arg_max(uid, a * 10000000 - seq) AS owner FROM h LEFT JOIN mn ON mn.file = h.file AND h.line BETWEEN a AND b AND kind IN ('function', 'method') GROUP BY ALL""")
def tool_search_code(spark: SparkSession, d: str) -> DataFrame:
    return tools.search_code(model(spark, d), "License").select("file", "line", "content", "owner")


@query(f"""WITH s AS (SELECT doc_id AS id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS content FROM documents),
v AS (SELECT id, line, lower(regexp_extract(content, '([A-Za-z_]+) *[:=] *"?([^" ]+)', 1)) AS setting, regexp_extract(content, '([A-Za-z_]+) *[:=] *"?([^" ]+)', 2) AS value FROM s WHERE trim(content) <> '' AND NOT starts_with(ltrim(content), '#') AND NOT starts_with(ltrim(content), '//')),
q AS (SELECT * FROM v WHERE setting <> '' AND NOT regexp_matches(lower(value), '^(changeme|placeholder|example|xxx+|your[-_].*)$')) SELECT *, (SELECT count(*) FROM q) > 40 AS truncated FROM q ORDER BY id, line LIMIT 40""")
def tool_get_configuration(spark: SparkSession, d: str) -> DataFrame:
    return tools.get_configuration(model(spark, d))


# -- what the tools' tables are made of ----------------------------------------------------------------
@query("SELECT 'f' || o_orderkey AS flow_ref, list_sort(list(DISTINCT 't' || s_suppkey)) AS tests FROM orders JOIN supplier ON s_suppkey = o_custkey GROUP BY o_orderkey")
def covering_tests(spark: SparkSession, d: str) -> DataFrame:
    """Flows with the tests of any element of their path: suppliers test the customer of their key."""
    edges = table(spark, d, "supplier").select(F.concat(F.lit("customer:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit("TESTED_BY").alias("kind"))
    return flows.covering_tests(_flows(spark, d).withColumnRenamed("ref", "flow_ref"), edges)


@query(f"WITH {FLOWS_SQL}, {ROLES_SQL} SELECT fl.ref AS flow_ref, list_sort(list(DISTINCT ro.ref)) AS refs FROM fl JOIN ro ON ro.owner = fl.a WHERE category IN ('sanitizer', 'validator') GROUP BY fl.ref")
def roles_on_path(spark: SparkSession, d: str) -> DataFrame:
    return flows.on_path(_flows(spark, d).withColumnRenamed("ref", "flow_ref"), _roles(spark, d).filter("category in ('sanitizer', 'validator')"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 3 > 0 AND o_custkey % 2 = 1 THEN (o_orderkey % 20) / 20 * 0.5 ELSE (o_orderkey % 20) / 20 END, 4)::DOUBLE AS confidence FROM orders")
def scored_flows(spark: SparkSession, d: str) -> DataFrame:
    """Halved where unreachability was measured, and only there."""
    value = flows.score_flow((F.col("o_orderkey") % 20) / 20, F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(value, 4).alias("confidence"))


@query("SELECT l_suppkey AS ref, max(l_quantity) AS confidence, arg_min(l_orderkey * 10 + l_linenumber, struct_pack(q := -l_quantity, s := l_orderkey * 10 + l_linenumber)) AS seq FROM lineitem GROUP BY 1")
def best_flows(spark: SparkSession, d: str) -> DataFrame:
    """One flow a ref: the most confident, then the first."""
    return flows.best_flows(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_quantity").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


@query("SELECT 'customer:' || c_custkey AS ref, 'known' AS kind FROM customer UNION ALL SELECT DISTINCT 'order:' || o_orderkey, 'inferred' FROM orders")
def flow_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints that flows name and nobody made are made, so none dangles."""
    own = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("ref"), F.lit("known").alias("kind"))
    pairs = table(spark, d, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source_ref"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("sink_ref"))
    return flows.flow_endpoints(pairs, own)


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS kind, l_suppkey % 9 AS file, l_partkey % 4 AS fn FROM lineitem), c AS (SELECT s_suppkey AS cid, ['A', 'N', 'R'][s_suppkey % 3 + 1] AS kind, s_suppkey % 7 AS file, s_suppkey % 5 AS fn FROM supplier),
j AS (SELECT f.*, cid, CASE WHEN f.file = c.file AND f.fn = c.fn THEN 0 WHEN f.file = c.file THEN 1 ELSE 2 END AS tier FROM (SELECT DISTINCT * FROM f) f LEFT JOIN c USING (kind))
SELECT id, kind, file, fn AS function, arg_min(cid, tier * 100000000 + CASE WHEN tier = 1 THEN -cid ELSE cid END) AS clause_id FROM j GROUP BY id, kind, file, fn""")
def clause_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of the same function the first clause, else of the same file the last, else the first of the kind."""
    found = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kind"), (F.col("l_suppkey") % 9).alias("file"), (F.col("l_partkey") % 4).alias("function")).distinct()
    k = F.col("s_suppkey")
    clauses = table(spark, d, "supplier").select(k.alias("clause_id"), F.element_at(F.array(*map(F.lit, "ANR")), (k % 3 + 1).cast("int")).alias("kind"), (k % 7).alias("file"), (k % 5).alias("function"), k.alias("seq"))
    return flows.match_clause(found, clauses)


@query("SELECT l_orderkey AS id, arg_max(l_linenumber, struct_pack(s := l_quantity, q := -l_linenumber)) AS clause_id FROM lineitem GROUP BY 1")
def clause_specificity(spark: SparkSession, d: str) -> DataFrame:
    return flows.specificity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("clause_id"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("seq")))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'direct' WHEN 'MACHINERY' THEN 'harness' ELSE 'unknown' END AS testability FROM customer")
def testability(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "http").when(F.col("c_mktsegment") == "MACHINERY", "library").otherwise("other")
    return table(spark, d, "customer").select("c_custkey", flows.testability(kind).alias("testability"))


@query(f"WITH {MODEL_SQL} SELECT uid, kind, name FROM mn WHERE kind IN ('class', 'method')")
def nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of(_nodes(spark, d), "class", "method").select("uid", "kind", "name")


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE resolved")
def admitted_resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.admitted(graph.merge_edges(key_edges(spark, d)), "resolved").select("src", "dst")


_NAMES = ("main", "Main", "serve", "serve_all", "handler", "on_load", "lambda_handler", "LLVMFuzzerTestOneInput", "App", "dispatch", "parse_header", "handle", "entrypoint_2")
_DECORATORS = ("", "@app.get('/a')", "@router.post('/b')", "@pytest.mark.task", "@GET('/c')", "app.route('/d')", "@cli.command", "@cached", "@route('/e')")


@query(f"""WITH c AS (SELECT c_custkey, [{', '.join(f"'{n}'" for n in _NAMES)}][c_custkey % 13 + 1] AS name, ['{"', '".join(x.replace("'", "''") for x in _DECORATORS)}'][c_custkey // 13 % 9 + 1] AS deco, c_mktsegment = 'MACHINERY' AS class FROM customer)
SELECT c_custkey, CASE WHEN class THEN NULL WHEN lower(name) IN ('main', 'lambda_handler', 'llvmfuzzertestoneinput') THEN 'cli' WHEN lower(name) IN ('handle', 'handler', 'entrypoint', 'dispatch', 'serve', 'app') THEN 'library'
  WHEN regexp_matches(lower(deco), '^@?(app[.]|router[.]|get|post|route)') THEN 'http' END AS entrypoint FROM c""")
def entrypoint_marks(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are, then decorators by their beginnings; 234 combinations of name, decorator and kind."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 13 + 1).cast("int"))
    decorator = F.element_at(F.array(*map(F.lit, _DECORATORS)), (F.floor(k / 13) % 9 + 1).cast("int"))
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "class").otherwise("function")
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), kind.alias("kind"), F.filter(F.array(F.lit("@x"), decorator), lambda x: x != "").alias("decorators"))
    return graph.mark_entrypoints(rows).select("c_custkey", "entrypoint")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'web service' WHEN s_suppkey % 5 = 0 THEN 'command line' WHEN s_suppkey % 2 = 0 THEN 'library' ELSE 'unknown' END AS type,
  list_filter([CASE WHEN s_suppkey % 3 = 0 THEN '4 routes' END, CASE WHEN s_suppkey % 5 = 0 THEN '2 commands' END, CASE WHEN s_suppkey % 2 = 0 THEN '9 exported symbols' END], lambda x: x IS NOT NULL) AS evidence,
  list_filter([CASE WHEN s_suppkey % 3 > 0 THEN 'routes: none found' END, 'tests: not measured', 'containers: none found'], lambda x: x IS NOT NULL) AS gaps FROM supplier""")
def application_and_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What an application is, by ordered rules with evidence, and what is unknown of it."""
    k = F.col("s_suppkey")
    of = lambda cond, n: F.when(cond, n).otherwise(0)
    facts = table(spark, d, "supplier").select("s_suppkey", of(k % 3 == 0, 4).alias("routes"), of(k % 5 == 0, 2).alias("commands"), of(k % 2 == 0, 9).alias("exported"), F.lit(None).cast("int").alias("tests"), F.lit(0).alias("containers"))
    return tools.gaps(tools.classify_application(facts)).select("s_suppkey", "type", "evidence", "gaps")


@query(f"""WITH {EDGES_SQL}, a AS (SELECT DISTINCT dst AS uid FROM edges WHERE src = 'region:2'), b AS (SELECT DISTINCT dst AS uid FROM edges JOIN a ON src = a.uid)
SELECT uid, hops FROM (SELECT 'region:2' AS uid, 0 AS hops UNION ALL SELECT uid, 1 FROM a UNION ALL SELECT uid, 2 FROM b) ORDER BY hops, uid LIMIT 200""")
def evidence_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """What a node's evidence leads to, in the direction of the edges."""
    return graph.subgraph(graph.merge_edges(key_edges(spark, d)), "region:2", 2, 200, directed=True)
