"""Registered queries: sources, sinks, text functions, channels and evidence over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provark.functions import arrow_udfs
from provark.functions import text as tx
from provark.operators import candidates, compare, contract, flows, graph, integrity, kpi, lookups
from provark.plans.analysis_queries import CLAUSES, _VERDICTS, run_events
from provark.plans.bindings import EDGES_SQL, NODES_SQL, key_edges, key_nodes, records
from provark.plans.storage import query, shared_dir, stored, table
from provark.sources import code_rules, external, readers, sinks, taint
from provark.sources import manifests as manifests_of
from provark.sources import settings as settings_of
from provark.streaming import events as ev
from provark.streaming import follow


def _text(*parts) -> Column:
    """Columns and literal texts, one after the other."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources ------------------------------------------------------------------------------------------
def _written(rows: DataFrame, root: str) -> None:
    """Files (path, text) below a shared folder, each by the task that has its row; a task that runs again writes the same."""
    base = root.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                full = os.path.join(base, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8") as f:
                    f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@query("""WITH f AS (SELECT 'src/' || CASE s_suppkey % 3 WHEN 1 THEN 'node_modules' ELSE 'd' || s_suppkey % 7 END || '/f' || s_suppkey || CASE s_suppkey % 3 WHEN 2 THEN '.unknown' ELSE '.py' END AS path, s_suppkey % 5 AS more FROM supplier),
g AS (SELECT * FROM f WHERE NOT contains(path, 'node_modules') ORDER BY path LIMIT 4000)
SELECT path, 'python' AS language, 2 + more AS lines FROM g WHERE ends_with(path, '.py')""")
def tree_index(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files on storage, one a supplier, walked and indexed: ignored folders and unknown languages are left out,
    and the first 4,000 files count, as the reader's bound has it."""
    k = F.col("s_suppkey")
    folder = F.when(k % 3 == 1, "node_modules").otherwise(_text("d", k % 7))
    suffix = F.when(k % 3 == 2, ".unknown").otherwise(".py")
    text = F.concat(_text("x = ", k, "\n"), F.repeat(F.lit("y = 1\n"), (k % 5).cast("int")))
    root = _folder(spark, "tree")
    _written(table(spark, d, "supplier").select(_text("src/", folder, "/f", k, suffix).alias("path"), text.alias("text")), root)
    return readers.index_tree(spark, root).select("path", "language", "lines")


@query("SELECT s_suppkey AS case_id, s_acctbal AS value FROM supplier WHERE s_suppkey % 10 <> 9 ORDER BY s_suppkey LIMIT 40")
def corpus_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases from a folder of JSON files, one a supplier, in order of file name, up to the reader's bound; a file that does not
    parse is left out."""
    k = F.col("s_suppkey")
    text = F.concat(_text('{"case_id": ', k, ', "value": ', F.col("s_acctbal")), F.when(k % 10 == 9, "").otherwise("}"))
    root = _folder(spark, "corpus")
    _written(table(spark, d, "supplier").select(_text("case-", F.lpad(k.cast("string"), 9, "0"), ".json").alias("path"), text.alias("text")), root)
    return readers.json_corpus(spark, root, "case_id long, value double", 40).select("case_id", "value")


@query("SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, user_id AS case_id, event_type AS scope, 'value' AS metric, value AS v_num FROM events")
def trace_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested trace documents, a user's events as its calls, flattened to long metrics."""
    calls = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))), lambda s: F.struct(s["event_type"].alias("scope"), F.create_map(F.lit("value"), s["value"]).alias("metrics")))
    documents = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(calls.alias("calls"))
    return contract.flatten_trace(documents).select("seq", "case_id", "scope", "metric", "v_num")


@query(f"WITH {EDGES_SQL} SELECT src, dst, confidence FROM edges WHERE kind = 'HAS_CUSTOMER'")
def edge_pattern(spark: SparkSession, d: str) -> DataFrame:
    return readers.edge_pattern(key_nodes(spark, d), graph.merge_edges(key_edges(spark, d)), "HAS_CUSTOMER", "nation", "customer")


@query("SELECT 'nation:' || c_nationkey AS process, len(list(DISTINCT c_custkey)) AS members FROM customer GROUP BY c_nationkey")
def execution_flows(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "customer").select(_text("customer:", F.col("c_custkey")).alias("src"), _text("nation:", F.col("c_nationkey")).alias("dst"), F.lit("STEP_IN_PROCESS").alias("kind"))
    return readers.execution_flows(edges).select("process", F.size("members").alias("members"))


@query("SELECT o_orderkey AS id, 1 AS row, o_orderstatus AS status, NULL::VARCHAR AS note FROM orders UNION ALL SELECT o_orderkey, 2, 'a|b', o_orderpriority FROM orders")
def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables in pipes: the rule and ragged rows go, escaped bars stay, empty cells are null."""
    body = _text("title\n| status | note |\n|:---|---|\n| ", F.col("o_orderstatus"), " | |\n| a\\|b | ", F.col("o_orderpriority"), " |\n| ragged |\nend")
    cells = readers.pipe_table(table(spark, d, "orders").select("o_orderkey", body.alias("body")), "o_orderkey", "body")
    return cells.select("id", "row", F.col("cells")["status"].alias("status"), F.col("cells")["note"].alias("note"))


@query("SELECT s_suppkey AS id, unnest(['NAME', 'KEY', 'TWICE']) AS key, unnest([s_name, s_suppkey || ' x', 'last']) AS value FROM supplier")
def env_files(spark: SparkSession, d: str) -> DataFrame:
    body = _text("# head\nexport NAME=", F.col("s_name"), "\nKEY = \"", F.col("s_suppkey"), " x\"\nTWICE=first\nnot a line\nTWICE='last'\n")
    return readers.dotenv(table(spark, d, "supplier").select("s_suppkey", body.alias("body")), "s_suppkey", "body")


@query("""WITH p AS (SELECT p_partkey AS k, 'a' || lpad(p_partkey::VARCHAR, 9, '0') || '/' AS dir FROM part),
r AS (SELECT 'pypi' AS ecosystem, 'Pkg' || k % 60 AS name, k || '.0' AS version, dir || 'requirements.txt' AS path FROM p WHERE k % 4 = 0 UNION ALL SELECT 'npm', '@s/n' || k % 50, '^' || k || '.1', dir || 'package.json' FROM p WHERE k % 4 = 1
  UNION ALL SELECT 'go', 'x.org/m' || k % 40, 'v' || k || '.2', dir || 'go.mod' FROM p WHERE k % 4 = 2 UNION ALL SELECT 'maven', 'art' || k % 30, k || '.3', dir || 'pom.xml' FROM p WHERE k % 4 = 3)
SELECT ecosystem, name, version, path FROM r QUALIFY row_number() OVER (PARTITION BY ecosystem, lower(name) ORDER BY path) = 1""")
def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies of manifests of four ecosystems; of a name the first by path stays."""
    k = F.col("p_partkey")
    folder = _text("a", F.lpad(k.cast("string"), 9, "0"), "/")
    case = lambda a, b, c, e: F.when(k % 4 == 0, a).when(k % 4 == 1, b).when(k % 4 == 2, c).otherwise(e)
    name = case("requirements.txt", "package.json", "go.mod", "pom.xml")
    text = case(
        _text("# needs\nPkg", k % 60, "==", k, ".0\n"), _text('{"dependencies": {"@s/n', k % 50, '": "^', k, '.1"}}'), _text("module a\nrequire x.org/m", k % 40, " v", k, ".2\n"), _text("<dependency><artifactId>art", k % 30, "</artifactId><version>", k, ".3</version></dependency>")
    )
    return manifests_of.dependencies(table(spark, d, "part").select(F.concat(folder, name).alias("path"), text.alias("text"))).select("ecosystem", "name", "version", "path")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
d AS (SELECT k, k % 4 AS f, n, p, 'p' || p AS name, (n % 2 = 0 AND k % 4 <> 2) AS dev, CASE WHEN n % 3 = 0 AND k % 4 IN (0, 1) THEN NULL ELSE CASE k % 4 WHEN 2 THEN 'v' WHEN 3 THEN '^' ELSE '' END || n || '.' || s || CASE k % 4 WHEN 2 THEN '.0' ELSE '' END END AS version, s FROM l)
SELECT ['pypi', 'crates', 'go', 'npm'][f + 1] AS ecosystem, k AS file, CASE f WHEN 2 THEN 'x.io/' ELSE '' END || name AS name, min(version) AS version, bool_or(dev) AS dev, count(*) AS times FROM d GROUP BY ALL""")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """A manifest an order in one of four formats, its line items as dependencies of runtime and development, among what
    is none: build requirements, features, scripts, replaced modules."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    f = F.col("k") % 4

    def line(i: Column) -> Column:
        n, p, bare = i["n"], i["p"], i["n"] % 3 == 0
        version = _text(n, ".", i["s"])
        return (
            F.when(f == 0, _text('  "p', p, "[x]", F.when(bare, "").otherwise(F.concat(F.lit(">="), version)), "; extra == 'a'\","))
            .when(f == 1, F.when(bare, _text("p", p, ' = { git = "https://a.b/1.2" }')).otherwise(F.when(n % 5 == 0, _text("p", p, ' = { version = "', version, '", features = ["y"] }')).otherwise(_text("p", p, ' = "', version, '"'))))
            .when(f == 2, _text("\tx.io/p", p, " v", version, ".0 // indirect"))
            .otherwise(_text('    "p', p, '": "^', version, '"'))
        )

    items = own.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("n", "p", "s"))).alias("items"))  # an order's items go to its file at once, each once
    lines = lambda of: F.call_function("array_join", F.transform(of, line), F.when(f == 3, ",\n").otherwise("\n"))
    run, dev = F.filter("items", lambda i: i["n"] % 2 != 0), F.filter("items", lambda i: i["n"] % 2 == 0)
    files = items.select("k", F.when(f != 2, lines(run)).alias("a"), F.when(f != 2, lines(dev)).alias("b"), F.when(f == 2, lines(F.col("items"))).alias("all"))
    a, b = F.col("a"), F.col("b")
    text = (
        F.when(f == 0, _text('[build-system]\nrequires = [\n  "hatch>=1",\n]\n[project]\nversion = "1.0"\ndependencies = [ # own\n', a, "\n]\n[project.optional-dependencies]\nt = [\n", b, "\n]\n[project.urls]\nhome = 'x'\n"))
        .when(f == 1, _text('[package]\nname = "self"\nversion = "9.9"\n\n[dependencies]\n', a, "\n\n[features]\nz = []\n[dev-dependencies]\n", b, "\n"))
        .when(f == 2, _text("module self\n\ngo 1.22\nrequire (\n", F.col("all"), "\n)\nreplace (\n\tx.io/gone v1.0.0 => ../x v0.0.0\n)\n"))
        .otherwise(_text('{"version": "1.0", "engines": {"node": "18"}, "scripts": {"a": "1.0"},\n  "dependencies": {\n', a, '\n  },\n  "devDependencies": {\n', b, "\n  }\n}\n"))
    )
    name = F.element_at(F.array(*map(F.lit, ("pyproject.toml", "Cargo.toml", "go.mod", "package.json"))), (f + 1).cast("int"))
    found = manifests_of.declared(files.select(_text(F.col("k"), "/", name).alias("path"), text.alias("text")))
    by = ["ecosystem", F.substring_index("path", "/", 1).cast("long").alias("file"), "name"]
    return found.groupBy(*by).agg(F.min("version").alias("version"), F.bool_or("dev").alias("dev"), F.count("*").alias("times"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN 0 ELSE p_size END AS locked FROM part")
def lock_files(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("int")
    path = F.when(k % 3 == 0, _text(k, "/poetry.lock")).when(k % 3 == 1, _text(k, "/go.sum")).otherwise(_text(k, "/package-lock.json"))
    text = F.when(k % 3 == 0, F.expr("repeat('[[package]]\\nname = 1\\n', int(p_size))")).when(k % 3 == 1, F.expr("repeat('a.b/c v1.0 h1:x=\\n', int(p_size))")).otherwise("{broken")
    return readers.locked_count(table(spark, d, "part").select(path.alias("path"), text.alias("text"), n.alias("n"))).select(F.substring_index("path", "/", 1).cast("long").alias("id"), "locked")


@query("""SELECT s_suppkey, ['container', 'compose', 'ci', 'deployment', 'environment', 'settings', NULL][s_suppkey % 7 + 1] AS role, list_distinct_ports AS ports FROM (SELECT s_suppkey, CASE WHEN s_suppkey + 1000 = 8080 THEN [8080] ELSE [s_suppkey + 1000, 8080] END AS list_distinct_ports FROM supplier)""")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    """What configuration files are for, by path, and the ports that they declare."""
    k = F.col("s_suppkey")
    path = F.element_at(F.array(*map(F.lit, ("x/Dockerfile", "docker-compose.dev.yml", ".github/workflows/a.yml", "k8s/a.yaml", "x/.env.local", "a/b.toml", "a/b.txt"))), (k % 7 + 1).cast("int"))
    text = _text("port: ", k + 1000, "\nsupport 4321\nEXPOSE 8080\nEXPOSE 99999\nlisten=", k + 1000, "\n")
    return table(spark, d, "supplier").select("s_suppkey", readers.config_roles(path).alias("role"), readers.ports(text).alias("ports"))


#: Settings of services: a line that is one of the guarded ones, and its harmless twin; @ is a number.
_TWINS = (
    ("debug_enabled", "debug: true", "debug: false"),
    ("bind_all_interfaces", "bind: 0.0.0.0:@", "netmask: 0.0.0.0"),
    ("tls_verification_disabled", "verify: False", "verify: True"),
    ("permissive_cors", 'allow_origins: "*"', 'allow_methods: "*"'),
    ("secret_literal", 'password: "pw@abcdefgh"', 'password: "changeme@"'),
    ("auth_disabled", "auth_required: no", "auth_required: yes"),
    ("privileged_container", "privileged: true", "privileged: false"),
)
_SETTINGS_SQL = f"""sl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS i FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)),
hit AS (SELECT *, [{', '.join(f"'{t[0]}'" for t in _TWINS)}][n % 7 + 1] AS id, [{', '.join(f"'{t[1].split(':')[0]}'" for t in _TWINS)}][n % 7 + 1] AS key FROM sl WHERE p % 2 = 0)"""


def _service_files(spark: SparkSession, d: str) -> DataFrame:
    """A YAML file an order with a service a line item, nested under its name, between comments."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in _TWINS]), (F.col("n") % 7 + 1).cast("int"))
    line = F.replace(F.when(F.col("p") % 2 == 0, pick(1)).otherwise(pick(2)), F.lit("@"), F.col("p").cast("string"))
    part = _text("svc", F.col("n"), ":\n    # debug: true\n    ", line, "\n")
    files = own.withColumn("part", part).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "s", "part"))), lambda x: x["part"]), "").alias("text"))
    return files.select(_text(F.col("k"), "/config.yaml").alias("path"), "text")


@query(f"WITH {_SETTINGS_SQL} SELECT id, k AS file, i * 3 AS line, 'svc' || n || '.' || key AS keys FROM hit")
def config_settings(spark: SparkSession, d: str) -> DataFrame:
    """Guarded settings with the key path that leads to them; comments and harmless twins are none."""
    found = settings_of.guarded(settings_of.settings(_service_files(spark, d)))
    return found.select("id", F.substring_index("path", "/", 1).cast("long").alias("file"), "line", "keys")


@query(f"""WITH {_SETTINGS_SQL}, u AS (SELECT s_suppkey AS k, list_filter([CASE WHEN s_suppkey % 3 <> 1 THEN 'root' END, 'port', CASE WHEN s_suppkey % 2 = 0 THEN 'bound' END], lambda x: x IS NOT NULL) AS signals FROM supplier)
SELECT 'config.' || id AS rule_id, count(*) AS n, CASE id WHEN 'debug_enabled' THEN 'CWE-489' WHEN 'bind_all_interfaces' THEN 'CWE-1327' ELSE '' END AS cwe, CASE WHEN id IN ('debug_enabled', 'bind_all_interfaces') THEN 'medium' ELSE 'low' END AS severity, 0.75::DOUBLE AS confidence FROM hit GROUP BY id UNION ALL
SELECT 'deployment.container_image', sum(len(signals)), '', 'low', 0.6 FROM u UNION ALL SELECT 'config.permission_change', least(10, count(*)), '', 'low', 0.45 FROM part UNION ALL
SELECT 'config.container_runs_as_root', count(*), '', 'low', 0.75 FROM supplier WHERE s_suppkey % 3 = 2""")
def config_channel(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of configuration: settings, images of three kinds, and the first ten lines that change permissions."""
    k = F.col("s_suppkey")
    user = F.when(k % 3 == 0, "").when(k % 3 == 1, "USER app\n").otherwise("USER root\n")
    image = _text("FROM a\n", user, "EXPOSE ", k + 1000, "\n", F.when(k % 2 == 0, "CMD serve 0.0.0.0\n").otherwise("CMD serve 10.0.0.0\n"))
    files = _service_files(spark, d).unionByName(table(spark, d, "supplier").select(_text("s", k, "/Dockerfile").alias("path"), image.alias("text")))
    files = files.unionByName(table(spark, d, "part").select(_text("p", F.col("p_partkey"), "/run.sh").alias("path"), _text("echo ", F.col("p_name"), "\n  chmod ", F.col("p_size"), " x\n").alias("text")))
    found = settings_of.config_candidates(files)
    return found.groupBy("rule_id", "cwe", "severity", "confidence").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pytest' WHEN p_partkey % 3 = 0 THEN 'jest' END AS framework, list_sort(['test_' || p_partkey, 'test_b']) AS cases FROM part WHERE p_partkey % 5 <> 0""")
def test_files(spark: SparkSession, d: str) -> DataFrame:
    """Test files by path, the framework of most markers, their cases."""
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, _text("src/", k, ".py")).otherwise(_text("tests/test_", k, ".py"))
    body = F.concat(F.when(k % 2 == 0, "import pytest\n").when(k % 3 == 0, "describe(expect(\n").otherwise(""), _text("def test_", k, "():\n  pass\ndef test_b():\n  pass\n"))
    found = readers.test_files(table(spark, d, "part").select(path.alias("path"), body.alias("text")), {"pytest": ["import pytest"], "jest": [r"describe\(", r"expect\("]})
    return found.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("id"), "framework", "cases")


@query("""WITH r AS (SELECT s_suppkey % 5 AS f, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['GET'] WHEN 1 THEN ['GET', 'POST'] WHEN 2 THEN ['GET'] WHEN 3 THEN ['POST'] ELSE ['ANY'] END) AS method,
  CASE s_suppkey % 5 WHEN 0 THEN '/a' || s_suppkey % 9 || '/{id}' WHEN 1 THEN '/b' || s_suppkey % 9 WHEN 2 THEN '/c' || s_suppkey % 9 WHEN 3 THEN '/d' || s_suppkey % 9 || '/[slug]' ELSE '/api/e' || s_suppkey % 9 END AS path, s_suppkey AS k FROM supplier)
SELECT method, path, CASE f WHEN 0 THEN ['id'] WHEN 1 THEN ['q'] WHEN 3 THEN ['slug'] WHEN 4 THEN ['page'] ELSE []::VARCHAR[] END AS params, count(DISTINCT k) AS files FROM r GROUP BY method, path, f""")
def http_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of five families, merged by method and path, with placeholders and query parameters."""
    k = F.col("s_suppkey")
    n = k % 9
    path = F.when(k % 5 == 3, _text("web", k, "/app/d", n, "/[slug]/route.ts")).when(k % 5 == 4, _text("web", k, "/pages/api/e", n, ".ts")).otherwise(_text("s", k, ".py"))
    text = (
        F.when(k % 5 == 0, _text("@router.get('/a", n, "/{id}')\ndef f(): pass\n@router.get('no-slash')"))
        .when(k % 5 == 1, _text("@app.route('/b", n, "', methods=['GET', 'POST'])\ndef f():\n  request.args.get('q')"))
        .when(k % 5 == 2, _text("if (pathname === '/c", n, "') {}"))
        .when(k % 5 == 3, F.lit("export async function POST(r) {}"))
        .otherwise(F.lit("export default (req) => req.query.page"))
    )
    return readers.http_routes(table(spark, d, "supplier").select(path.alias("path"), text.alias("text"))).select("method", "path", "params", F.size("files").cast("long").alias("files"))


@query("""SELECT s_suppkey AS id, unnest(['shell', 'eval', 'secret']) AS rule, unnest([2, 3, 4]) AS line, unnest(['CWE-78', 'CWE-95', 'CWE-798']) AS cwe FROM supplier WHERE s_suppkey % 4 > 0 UNION ALL SELECT s_suppkey, 'sql', 1, 'CWE-89' FROM supplier WHERE s_suppkey % 4 = 0""")
def code_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules over the syntax trees of Python sources."""
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, 'c.execute("select " + x)\nos.system("fixed")\n').otherwise(_text("import os\nos.system(x", k, ")\neval(y)\npassword = 'hunter", k, "22'\neval('1')\n"))
    found = code_rules.scan(table(spark, d, "supplier").select(_text(k, "/a.py").alias("path"), text.alias("text")))
    return found.select(F.substring_index("file", "/", 1).cast("long").alias("id"), "rule", "line", "cwe")


@query("""SELECT s_suppkey AS id, 'stdin' AS source_kind, 2 AS source_line, CASE WHEN s_suppkey % 2 = 0 THEN 'code' ELSE 'command' END AS sink_kind, 3 AS sink_line, s_suppkey % 3 = 0 AS sanitized FROM supplier""")
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    """Data flow inside a function from its source to its sink, cleaned on the way or not."""
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, "shlex.quote(input())").otherwise("input()")
    text = F.concat(F.lit("def f():\n    x = "), value, F.lit("\n    "), F.when(k % 2 == 0, "eval(x)").otherwise("os.system(x)"), F.lit("\n"))
    found = taint.taint_flows(table(spark, d, "supplier").select(_text(k, "/a.py").alias("path"), text.alias("text")))
    return found.select(F.substring_index("path", "/", 1).cast("long").alias("id"), "source_kind", "source_line", "sink_kind", "sink_line", "sanitized")


#: Parts of programs: where data comes from, how a name gets it, what is asked about it, where it goes.
_SOURCES = ("input()", "os.environ.get('K')", "request.args.get('q')", "sys.argv[1]", "request.form['x']")
_CARRIERS = (
    "    x = @\n",
    "    x: str = @\n",
    "    (x := @)\n",
    "    if c():\n        x = @\n    else:\n        x = ''\n",
    "    x = ''\n    for y in some():\n        x += @\n",
    "    x = @ if c() else 'a'\n",
    "    x = [y for y in @]\n",
    "    x = ''\n    try:\n        x = @\n        go()\n        x = ''\n    except ValueError:\n        pass\n",
    "    with held() as x:\n        x = @\n",
    "    z = @\n    x, w = z, 1\n",
    "    x = z = ''\n    while c():\n        x = z\n        z = @\n",
    '    x = f"a{@}"\n',
    "    x = @\n    if c():\n        x = ''\n",
    "    x = @\n    x = ''\n",
)
_ASKED = ("", "    if not ok(x):\n        return\n", "    if ok(x):\n        pass\n", "    x = int(x)\n", "    if c():\n        x = int(x)\n", "    x = shlex.quote(x)\n")
_SINKS = ("eval(x)", "os.system('ls ' + x)", "subprocess.run(x)", "cursor.execute('a = %s' % x)", 'exec(f"{x}")')


def flow_programs(orders: DataFrame) -> DataFrame:
    """path and text of a program an order: its parts are dealt by the order's key, in over 4,000 combinations; half of
    them stand in a function, half at a module's level."""
    k = F.xxhash64(F.col("o_orderkey").cast("long"))
    nth = lambda parts, by: F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.shiftrightunsigned(k, by), F.lit(len(parts))) + 1).cast("int"))
    head = nth(("def f():\n", "if c():\n"), 2)
    body = F.concat(F.replace(nth(_CARRIERS, 8), F.lit("@"), nth(_SOURCES, 16)), nth(_ASKED, 24), F.lit("    "), nth(_SINKS, 32), F.lit("\n"))
    return orders.select(_text(F.col("o_orderkey"), "/a.py").alias("path"), F.concat(head, body).alias("text"))


@query()
def taint_programs(spark: SparkSession, d: str) -> DataFrame:
    """Flows of programs of many shapes, counted by all that is said of them. No SQL: tests run the programs' paths."""
    found = taint.taint_flows(flow_programs(table(spark, d, "orders")))
    return found.groupBy("function", "source_kind", "sink_kind", "hops", "interpolated", "validated", "sanitized").agg(F.count("*").alias("flows"), F.sum(F.col("sink_line") - F.col("source_line")).alias("lines"))


#: Statements and the rule that each breaks, if any.
_STATEMENTS = (
    ("os.system(x)", "shell"), ("os.system('fixed')", ""), ("subprocess.run(a, shell=True)", "shell"), ("subprocess.run(a)", ""), ("eval(y)", "eval"), ("eval('1')", ""), ("c.execute('a' + x)", "sql"), ("c.execute('a')", ""),
    ("c.execute(f'a {x}')", "sql"), ("pickle.loads(b)", "deserialisation"), ("json.loads(b)", ""), ("yaml.load(b)", "deserialisation"), ("yaml.load(b, Loader=L)", ""), ("requests.get(u, verify=False)", "tls"), ("requests.get(u)", ""),
    ("app.run(debug=True)", "debug"), ("app.run(debug=False)", ""), ("app.run(host='0.0.0.0')", "bind_all"), ("app.run(host='127.0.0.1')", ""), ("password = 'hunter22'", "secret"), ("password = 'changeme1'", ""), ("render_template_string(t)", "template"), ("render_template_string('t')", ""),
)
_BLOCKS = ("", "if c:", "for i in xs:", "while c:", "with o:", "class K:")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS i FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)),
b AS (SELECT *, CASE WHEN (p + n) % {len(_BLOCKS)} = 0 THEN 1 ELSE 2 END AS size, [{', '.join(f"'{r}'" for _, r in _STATEMENTS)}][(p * 7 + s) % {len(_STATEMENTS)} + 1] AS rule FROM l),
spot AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY i) AS line FROM b),
c AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{c}')" for r, (c, _) in code_rules.RULES.items())}) v(rule, cwe))
SELECT k AS id, rule, line::BIGINT AS line, cwe FROM spot JOIN c USING (rule)""")
def code_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rules over programs of a statement a line item, of 23 statements in six kinds of blocks: hits and their twins."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    nth = lambda parts, i: F.element_at(F.array(*map(F.lit, parts)), (i % len(parts) + 1).cast("int"))
    head = nth(_BLOCKS, F.col("p") + F.col("n"))
    body = nth([x for x, _ in _STATEMENTS], F.col("p") * 7 + F.col("s"))
    part = F.when(head == "", F.concat(body, F.lit("\n"))).otherwise(F.concat(head, F.lit("\n    "), body, F.lit("\n")))
    files = own.withColumn("part", part).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "s", "part"))), lambda x: x["part"]), "").alias("text"))
    found = code_rules.scan(files.select(_text(F.col("k"), "/a.py").alias("path"), "text"))
    return found.select(F.substring_index("file", "/", 1).cast("long").alias("id"), "rule", F.col("line").cast("long").alias("line"), "cwe")


@query("""SELECT s_suppkey AS id, unnest(['path_join', 'index_write']) AS rule, unnest([2, 7]) AS line FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'c_copy', 3 FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'c_copy', 4 FROM supplier WHERE s_suppkey % 3 = 1""")
def bound_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules on bounds: paths joined unchecked, writes at a free index, copies in C; twins that check have none."""
    k = F.col("s_suppkey")
    free = F.lit("def f(root, name):\n    return root / name\n\ndef g(a, xs):\n    i = 0\n    for x in xs:\n        a[i] = x\n        i += 1\n")
    bound = F.lit("def f(root, name):\n    return (root / name).resolve()\n\ndef g(a, xs):\n    i = 0\n    while i < len(a):\n        a[i] = xs\n        i += 1\n")
    native = F.concat(F.lit("// strcpy(a, b);\n"), F.when(k % 2 == 0, "int n = len;").otherwise("int n = MIN(len, 8);"), F.lit("\nmemcpy(a, b, n);\n  strcpy(a, b);\n"))
    text = F.when(k % 3 == 0, free).when(k % 3 == 1, native).otherwise(bound)
    path = F.when(k % 3 == 1, _text(k, "/a.c")).otherwise(_text(k, "/a.py"))
    found = code_rules.scan(table(spark, d, "supplier").select(path.alias("path"), text.alias("text")))
    return found.select(F.substring_index("file", "/", 1).cast("long").alias("id"), "rule", "line")


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, round(sum(confidence), 3)::DOUBLE AS confidence FROM edges GROUP BY kind")
def provider_pages(spark: SparkSession, d: str) -> DataFrame:
    """A provider's graph in pages of JSON lines, read by the external format, a task a page."""
    external.register(spark)
    path = _folder(spark, "provider")
    pages = graph.merge_edges(key_edges(spark, d)).select("src", "dst", "kind", "confidence")
    pages.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/raw")
    _pages(spark, f"{path}/raw", f"{path}/pages", "edges")
    found = spark.read.format("provider_graph").option("path", f"{path}/pages").load()
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.round(F.sum("confidence"), 3).alias("confidence"))


@query("SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders WHERE o_orderstatus = 'F'")
def provider_matches(spark: SparkSession, d: str) -> DataFrame:
    """What a provider gives for one kind: it filters while it reads, without a limit."""
    external.register(spark)
    path = _folder(spark, "provider")
    o = table(spark, d, "orders")
    edges = o.select(_text("customer:", F.col("o_custkey")).alias("src"), _text("order:", F.col("o_orderkey")).alias("dst"), _text("HAS_", F.col("o_orderstatus")).alias("kind"), F.lit(1.0).alias("confidence"))
    edges.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/raw")
    _pages(spark, f"{path}/raw", f"{path}/pages", "edges")
    return external.matching(spark, f"{path}/pages", limit=None, kind="HAS_F").select("src", "dst")


def _pages(spark: SparkSession, raw: str, pages: str, name: str) -> None:
    """Names a folder's part files as a provider's pages: renames only, nothing is read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(pages))
    for i, status in enumerate(fs.listStatus(jvm.Path(raw))):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), jvm.Path(f"{pages}/{name}-{i:05d}.jsonl"))


@query("SELECT user_id::VARCHAR AS run_id, count(*) AS events, max(seq) AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1")
def committed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events appended by a stream to the external log, batch by batch, and read back from what is committed."""
    external.register(spark)
    path = _folder(spark, "log")
    ev.dedup(run_events(spark, d)).select("run_id", "seq", "t", "payload").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(external.LOGGED).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    stream.writeStream.format("event_log").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.format("event_log").option("path", f"{path}/out").load()
    return back.groupBy("run_id").agg(F.count("*").alias("events"), F.max("seq").alias("last"))


# -- sinks --------------------------------------------------------------------------------------------
@query("SELECT user_id::VARCHAR AS run_id, count(*) AS events, max(seq) AS last FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1")
def event_sink(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to the run-wise table in two parts, read back."""
    path, rows = _folder(spark, "events"), ev.dedup(run_events(spark, d))
    sinks.append_events(rows.filter("seq <= 3"), path)
    sinks.append_events(rows.filter("seq > 3"), path)
    back = spark.read.schema("run_id string, seq long, ts timestamp, t string, payload string, bucket int").parquet(path)
    return back.groupBy("run_id").agg(F.count("*").alias("events"), F.max("seq").alias("last"))


@query("SELECT 'r1' AS run_id, unnest([1, 2, 3]) AS seq, unnest(['a', 'b', 'c']) AS stage, unnest([(SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(*) FROM orders)]) AS rows, unnest([true, false, true]) AS as_first")
def stage_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Stages' states with their digests: equal states have equal ones, whatever the order of rows."""
    root, state = _folder(spark, "stages"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    back = sinks.checkpoint(state, root, "r1", "a", 1)
    sinks.checkpoint(back.filter("o_orderstatus = 'F'"), root, "r1", "b", 2)
    sinks.checkpoint(back.orderBy(F.desc("o_orderkey")), root, "r1", "c", 3)
    kept = spark.read.parquet(f"{root}/manifest")
    first = kept.filter("seq = 1").select(F.col("state_hash").alias("first"))
    return kept.crossJoin(F.broadcast(first)).select("run_id", "seq", "stage", "rows", (F.col("state_hash") == F.col("first")).alias("as_first"))  # three rows


@query("SELECT lang AS name, sha256(text) AS digest, strlen(text) AS bytes FROM documents GROUP BY lang, text")
def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.artifacts(table(spark, d, "documents"), "lang", "text").select("name", "digest", F.col("bytes").cast("long").alias("bytes"))


@query("""SELECT conv_id AS key, count(*)::INT AS seq, true AS valid FROM conversations GROUP BY conv_id""")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """First turns make chains, the others are appended to them: each chain then verifies as one."""
    rows, fields = table(spark, d, "conversations"), ["conv_id", "turn", "role", "text"]
    chain = stored(integrity.build_chain(rows.filter("turn = 0"), "conv_id", "turn", fields), "audit")
    whole = stored(chain.unionByName(sinks.append_audit(chain, rows.filter("turn > 0"), "conv_id", "turn", fields)), "audit")
    return integrity.chain_head(whole).join(integrity.verify_chain(whole), "key").select("key", "seq", "valid")


@query("SELECT o_orderkey AS finding, arg_min(l_returnflag, l_linenumber) AS stage, coalesce(NOT arg_min(l_quantity < 25, l_linenumber), true) AS remaining FROM orders LEFT JOIN (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    """Changes with the first result of their composite key; what has none or failed remains."""
    first = compare.first_seen(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])
    results = first.select(F.lit(1).alias("iteration"), F.col("l_orderkey").alias("finding"), F.col("l_returnflag").alias("stage"), (F.col("l_quantity") < 25).alias("ok"), F.col("l_linenumber").alias("seq"))
    return sinks.remaining_work(table(spark, d, "orders").select(F.lit(1).alias("iteration"), F.col("o_orderkey").alias("finding")), results).select("finding", "stage", "remaining")


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'up 1'""")
def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    rows = counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "value")
    up = spark.createDataFrame([("up", {}, 1)], "name string, labels map<string,string>, value long")
    return sinks.metric_lines(rows.unionByName(up))


# -- functions ----------------------------------------------------------------------------------------
@query("""SELECT s_suppkey AS id, 'a/b.py' AS file, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INT END AS line, CASE WHEN s_suppkey % 3 = 0 THEN 'a/b.py' ELSE 'a/b.py:f' || s_suppkey END AS uid, 'red ' || s_suppkey AS plain, ['timeout', 'oom'] AS signals,
  CASE WHEN s_suppkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, '/v/' || s_suppkey AS route, 'src/b.py:' || s_suppkey AS site, {'k': 'second', 'only': '1'}.only || {'k': 'second'}.k AS merged,
  CASE WHEN s_suppkey < 10 THEN s_suppkey * 100 || ' B' WHEN s_suppkey = 50 THEN '4.9 KB' ELSE NULL END AS size FROM supplier""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Locations, ids, escapes, signals, decorators, traces, maps and sizes."""
    k = F.col("s_suppkey")
    file, line = tx.split_location(F.when(k % 2 == 0, _text("a/b.py:", k)).otherwise("a/b.py"))
    uid = tx.canonical_uid(F.lit("./a\\b.py"), _text("f", k), F.when(k % 3 == 0, "File").otherwise("function"))
    method, route = tx.route(F.when(k % 2 == 0, _text("@app.post('/v/", k, "')")).otherwise(_text('@app.route("/v/', k, '")')))
    trace = _text('File "src/a.py", line 1, in f\nFile "src/b.py", line ', k, ', in g\nFile "/usr/lib/x.py", line 9, in h')
    merged = tx.merge_maps(F.create_map(F.lit("k"), F.lit("first"), F.lit("only"), F.lit("1")), F.create_map(F.lit("k"), F.lit("second")))
    size = F.when((k < 10) | (k == 50), tx.human_bytes(k * 100))
    return table(spark, d, "supplier").select(
        k.alias("id"), file.alias("file"), line.alias("line"), uid.alias("uid"), tx.strip_ansi(_text("\x1b[31mred\x1b[0m ", k)).alias("plain"), tx.markers(F.lit("killed: out of memory after timeout"), {"timeout": "timeout", "out of memory": "oom", "memory": "oom"}).alias("signals"),
        method.alias("method"), route.alias("route"), tx.crash_site(trace, "src/").alias("site"), F.concat(merged["only"], merged["k"]).alias("merged"), size.alias("size"),
    )


@query("""SELECT c_custkey, regexp_matches(p, '^src/(.*/)?gen/[^/]*[.]py$') AS guarded, regexp_matches(p, '^[^/]*[.]lock$') AS locked FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'src/gen/a.py' WHEN 1 THEN 'src/x/y/gen/b.py' WHEN 2 THEN 'a.lock' ELSE 'sub/a.lock' END AS p FROM customer)""")
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    p = F.element_at(F.array(*map(F.lit, ("src/gen/a.py", "src/x/y/gen/b.py", "a.lock", "sub/a.lock"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", p.rlike(tx.glob_to_regex("src/**/gen/*.py")).alias("guarded"), p.rlike(tx.glob_to_regex("*.lock")).alias("locked"))


@query("SELECT c_custkey, '***' AS a, '***' AS b, c_name AS c FROM customer")
def redacted_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = tx.redact_map(F.create_map(F.lit("db_password"), F.col("c_name"), F.lit("myApiKey"), F.col("c_name"), F.lit("tokens_used"), F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", fields["db_password"].alias("a"), fields["myApiKey"].alias("b"), fields["tokens_used"].alias("c"))


@query("""SELECT event_id, '{"a":' || event_id || ',"n":[{"z":1}]}' AS stable FROM events""")
def stable_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON without what differs from run to run, at any depth, keys in order."""
    body = _text('{"n": [{"pid": ', F.col("user_id"), ', "z": 1}], "duration_ms": 5, "a": ', F.col("event_id"), ', "timestamp": "t"}')
    return table(spark, d, "events").select("event_id", arrow_udfs.without_volatile(body).alias("stable"))


@query("SELECT event_id, true AS good, false AS other FROM events")
def signature_checks(spark: SparkSession, d: str) -> DataFrame:
    signed = table(spark, d, "events").withColumn("s", arrow_udfs.hmac_sha256(b"key")(F.col("props")))
    return signed.select("event_id", arrow_udfs.hmac_verify(b"key")(F.col("props"), F.col("s")).alias("good"), arrow_udfs.hmac_verify(b"other")(F.col("props"), F.col("s")).alias("other"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'crypto' WHEN 1 THEN 'auth' END AS sensitive FROM supplier")
def dependency_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("@scope/Crypto-JS", "passport", "left-pad"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", lookups.sensitivity(name, {"crypto-js": "crypto", "passport": "auth"}).alias("sensitive"))


# -- patches ------------------------------------------------------------------------------------------
def _patches(spark: SparkSession, d: str) -> DataFrame:
    """Two files a patch: one changes an SQL comment, which looks like a file's head, the other is removed."""
    k = F.col("s_suppkey")
    text = _text("--- a/q", k, ".sql\n+++ b/q", k, ".sql\n@@ -1,3 +1,4 @@\n select 1\n--- old\n+++ new ", k, "\n+import pickle\n end\n--- a/secrets/key\n+++ /dev/null\n@@ -1 +0,0 @@\n-", k, "\n")
    return table(spark, d, "supplier").select(k.alias("id"), text.alias("patch"))


@query("SELECT s_suppkey AS id, 2 AS files, 2 AS hunks, 2 AS added, 2 AS removed FROM supplier")
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_stats(_patches(spark, d))


@query("SELECT s_suppkey AS id, 'select 1' || chr(10) || '-- old' || chr(10) || 'end' || chr(10) || s_suppkey AS before, 'select 1' || chr(10) || '++ new ' || s_suppkey || chr(10) || 'import pickle' || chr(10) || 'end' AS after FROM supplier")
def diff_sides(spark: SparkSession, d: str) -> DataFrame:
    return compare.before_after(_patches(spark, d))


@query("SELECT s_suppkey AS id, 'hunk: -1 +2; hunk: -1 +0' AS summary FROM supplier")
def hunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _patches(spark, d).select("id", arrow_udfs.hunk_summary("patch").alias("summary"))


@query("SELECT page_id, true AS same FROM pages")
def patch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A page's diff, applied to the page, gives what it was made from."""
    pages = table(spark, d, "pages").select("page_id", "html", F.replace("html", F.lit("<p>"), F.lit("--\n<p class='x'>")).alias("after"))
    return pages.select("page_id", (arrow_udfs.patched("html", arrow_udfs.unified_diff("html", "after")) == F.col("after")).alias("same"))


@query("""SELECT s_suppkey AS id, 'protected_path' AS rule, 'secrets/key' AS detail FROM supplier UNION ALL SELECT s_suppkey, 'import', '+import pickle' FROM supplier UNION ALL SELECT s_suppkey, 'blast_radius', '0.9' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'assurance_level', 'C' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'file_count', '2' FROM supplier""")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    patches = _patches(spark, d)
    radius = patches.select("id", F.when(k % 3 == 0, 0.9).otherwise(0.5).alias("score"))
    levels = patches.select("id", F.when(k % 2 == 0, "C").otherwise("B").alias("level"))
    return compare.policy_violations(patches, ["secrets/**"], max_files=1, radius=radius, levels=levels)


# -- rollups ------------------------------------------------------------------------------------------
@query("SELECT l_returnflag AS indexer, l_linestatus AS language, count(*) AS files, sum(l_linenumber)::BIGINT AS symbols, sum(l_suppkey)::BIGINT AS lines, count(*) FILTER (l_partkey % 3 = 0) AS skipped FROM lineitem GROUP BY ALL")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("indexer"), F.col("l_linestatus").alias("language"), F.col("l_linenumber").alias("symbols"), F.col("l_suppkey").alias("lines"), F.when(F.col("l_partkey") % 3 == 0, "minified").alias("skip_reason"))
    return kpi.index_summary(rows)


@query(f"WITH {NODES_SQL}, m AS (SELECT regexp_replace(file, '/[^/]*$', '') AS module, kind, seq FROM nodes), c AS (SELECT module, count(*) AS sinks FROM m WHERE seq % 3 = 0 GROUP BY 1) SELECT m.module, count(*) AS files, sum(seq % 4)::BIGINT AS callables, sum(seq % 2)::BIGINT AS entrypoints, any_value(sinks) AS sinks FROM m LEFT JOIN c USING (module) GROUP BY m.module")
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    nodes = key_nodes(spark, d)
    files = nodes.select("file", (F.col("seq") % 4).alias("callables"), (F.col("seq") % 2).alias("entrypoints"))
    hits = nodes.filter("seq % 3 = 0").select("file", F.lit("sink").alias("category"))
    return kpi.module_rollup(files, hits).select("module", "files", "callables", "entrypoints", F.col("by_category")["sink"].alias("sinks"))


@query("SELECT count(*) AS executions, sum(l_quantity) AS bytes, max(l_extendedprice) AS peak_ram, sum(l_linenumber)::BIGINT AS cpu_ms FROM lineitem")
def sandbox_totals(spark: SparkSession, d: str) -> DataFrame:
    return kpi.sandbox_totals(table(spark, d, "lineitem").select(F.col("l_quantity").alias("bytes"), F.col("l_extendedprice").alias("ram"), F.col("l_linenumber").alias("cpu_ms")))


@query("SELECT DISTINCT lang AS language FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE n_chars > 20000000 OR lang = 'en')")
def language_parity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("language"))
    return kpi.language_parity(docs, docs.filter("language = 'en'"))


_STATS = "o AS (SELECT o_orderstatus AS source_kind, o_orderpriority AS sink_kind, CASE WHEN o_orderkey % 2 = 0 THEN 'call path' ELSE 'proximity' END AS basis, o_custkey % 2 = 0 AS r, o_custkey % 5 = 0 AS s FROM orders)"


@query(f"WITH {_STATS} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS key, count(*) AS flows, count(*) FILTER (r) AS reachable, count(*) FILTER (s) AS sanitized FROM o GROUP BY {c}" for c in ("source_kind", "sink_kind", "basis")))
def security_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source_kind"), F.col("o_orderpriority").alias("sink_kind"), F.when(F.col("o_orderkey") % 2 == 0, "call path").otherwise("proximity").alias("basis"), (c % 2 == 0).alias("reachable"), (c % 5 == 0).alias("sanitized"))
    return flows.security_stats(rows)


@query("""WITH r AS (SELECT 'region:' || n_regionkey AS uid, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'region:' || r_regionkey AS uid, (SELECT count(*) FROM r WHERE r.uid = 'region:' || r_regionkey AND k % 2 = 0) AS controls, (SELECT count(*) FROM r WHERE r.uid = 'region:' || r_regionkey AND k % 2 = 1) AS sinks, (r_regionkey % 2)::BIGINT AS flows FROM region""")
def entrypoint_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What each region reaches: its customers are controls and sinks."""
    k = F.col("seq")
    nodes = key_nodes(spark, d)
    entry = nodes.filter("kind = 'region'").select("uid", "seq")
    roles = nodes.filter("kind = 'customer'").select(_text("r", k).alias("ref"), F.col("uid").alias("owner"), F.when(k % 2 == 0, "control").otherwise("sink").alias("category"))
    edges = graph.merge_edges(key_edges(spark, d))
    return lookups.entrypoint_rollup(entry.select("uid"), edges, roles, entry.filter("seq % 2 = 1").select(F.col("uid").alias("entry")))


# -- channels, clauses, evidence ------------------------------------------------------------------------
@query("""SELECT 'runtime' AS channel, event_type AS location, 'runtime.' || (user_id % 4) AS rule_id, round(least(0.95, 0.5 + 0.1 * count(*) FILTER (value > 100)), 3)::DOUBLE AS confidence FROM events GROUP BY event_type, user_id % 4 HAVING count(*) FILTER (value > 100) > 0
UNION ALL SELECT 'config', s_suppkey || ':1', 'config.' || CASE s_suppkey % 3 WHEN 0 THEN 'debug' ELSE 'verify' END, CASE s_suppkey % 3 WHEN 0 THEN 0.7 ELSE 0.9 END FROM supplier WHERE s_suppkey % 3 < 2""")
def other_channels(spark: SparkSession, d: str) -> DataFrame:
    """Guard counters and risky settings as candidates; a channel that gave none adds none."""
    counters = table(spark, d, "events").groupBy(F.col("event_type").alias("scope"), (F.col("user_id") % 4).cast("string").alias("guard")).agg(F.count_if(F.col("value") > 100).alias("hits"))
    k = F.col("s_suppkey")
    settings = table(spark, d, "supplier").select(k.alias("id"), F.lit(1).alias("line"), F.when(k % 3 == 0, "debug").when(k % 3 == 1, "verify").otherwise("name").alias("setting"))
    parts = [candidates.runtime_channel(counters), candidates.config_channel(settings, {"debug": 0.7, "verify": 0.9}), candidates.config_channel(settings, {"none": 1.0})]
    return candidates.all_channels(parts)


@query(f"WITH {_VERDICTS} SELECT clause_id, applicable AS support FROM w")
def observation_support(spark: SparkSession, d: str) -> DataFrame:
    return lookups.observation_support(contract.verdicts(records(spark, d), CLAUSES))


@query(f"WITH {_VERDICTS} SELECT clause_id, status FROM w WHERE status = 'UNSUPPORTED'")
def clauses_by_status(spark: SparkSession, d: str) -> DataFrame:
    return lookups.with_status(contract.verdicts(records(spark, d), CLAUSES), "unsupported").select("clause_id", "status")


@query(f"WITH {_VERDICTS}, s AS (SELECT * FROM w WHERE status = 'SURVIVING') SELECT 'hit' AS change, clause_id FROM s WHERE scope = 'view' UNION ALL SELECT 'miss', clause_id FROM s")
def clauses_in_radius(spark: SparkSession, d: str) -> DataFrame:
    """Surviving clauses of the scopes that a change touches; all of them where it touches none."""
    judged = stored(contract.verdicts(records(spark, d), CLAUSES), "judged")
    touched = lambda scope: spark.createDataFrame([(scope,)], "scope string")
    of = lambda label, scope: contract.in_radius(judged, touched(scope)).select(F.lit(label).alias("change"), "clause_id")
    return of("hit", "view").union(of("miss", "no such scope"))


@query("SELECT 'python' AS language, 'atheris' AS engine, NULL AS reason UNION ALL SELECT 'c', 'plain', NULL UNION ALL SELECT 'go', NULL, 'no engine for go and fuzz'")
def engine_selection(spark: SparkSession, d: str) -> DataFrame:
    """Coverage feedback first, fallbacks last, then by id; or why there is none. A fixed list of engines."""
    rows = [("zeta", ["python"], True, False, True), ("atheris", ["python"], True, False, True), ("plain", ["python", "c"], False, True, True), ("gone", ["c", "go"], True, False, False)]
    engines = spark.createDataFrame([(i, x, ["fuzz"], fb, alt, ok) for i, x, fb, alt, ok in rows], "id string, languages array<string>, strategies array<string>, feedback boolean, fallback boolean, available boolean")
    one = lambda x: compare.select_engine(engines, x, "fuzz").select(F.lit(x).alias("language"), "engine", "reason")
    return one("python").union(one("c")).union(one("go"))


@query("""WITH e AS (SELECT s_name AS id, unnest(['l' || s_nationkey, 'l' || s_suppkey % 40]) AS language, unnest(CASE WHEN s_suppkey % 5 = 0 THEN ['fuzz', 'replay'] ELSE ['fuzz'] END) AS strategy, s_suppkey % 3 = 0 AS feedback, s_suppkey % 2 = 0 AS fallback FROM supplier WHERE s_acctbal > 0),
x AS (SELECT id, feedback, fallback, l.language, t.strategy FROM (SELECT DISTINCT id, feedback, fallback, language FROM e WHERE language IS NOT NULL) l JOIN (SELECT DISTINCT id, strategy FROM e WHERE strategy IS NOT NULL) t USING (id)),
b AS (SELECT language, strategy, arg_min(id, CASE WHEN feedback THEN '0' ELSE '1' END || CASE WHEN fallback THEN '1' ELSE '0' END || id) AS engine FROM x GROUP BY ALL),
w AS (SELECT DISTINCT 'l' || c_custkey % 45 AS language, unnest(['fuzz', 'replay', 'prove']) AS strategy FROM customer)
SELECT language, strategy, engine, CASE WHEN engine IS NULL THEN 'no engine for ' || language || ' and ' || strategy END AS reason FROM w LEFT JOIN b USING (language, strategy)""")
def engine_choices(spark: SparkSession, d: str) -> DataFrame:
    """The engine for every language and strategy that is wanted, of all suppliers as engines; or why there is none."""
    k = F.col("s_suppkey")
    engines = table(spark, d, "supplier").select(
        F.col("s_name").alias("id"), F.array_distinct(F.array(_text("l", F.col("s_nationkey")), _text("l", k % 40))).alias("languages"), F.when(k % 5 == 0, F.array(F.lit("fuzz"), F.lit("replay"))).otherwise(F.array(F.lit("fuzz"))).alias("strategies"),
        (k % 3 == 0).alias("feedback"), (k % 2 == 0).alias("fallback"), (F.col("s_acctbal") > 0).alias("available"),
    )
    wanted = table(spark, d, "customer").select(_text("l", F.col("c_custkey") % 45).alias("language"), F.explode(F.array(*map(F.lit, ("fuzz", "replay", "prove")))).alias("strategy"))
    return compare.select_engines(engines, wanted)


@query("""WITH e AS (SELECT user_id AS case_id, event_id AS seq, event_type = 'view' AS opens FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY case_id ORDER BY seq) + CASE WHEN opens THEN 0 ELSE 1 END AS depth FROM e)
SELECT c.case_id, c.seq AS return_seq, (SELECT max(o.seq) FROM d o WHERE o.case_id = c.case_id AND o.depth = c.depth AND o.opens AND o.seq < c.seq) AS call_seq FROM d c WHERE NOT c.opens""")
def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Views as calls and clicks as their returns, of each user."""
    rows = table(spark, d, "events").filter("event_type in ('view', 'click')").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.lit("f").alias("function"), F.when(F.col("event_type") == "view", "call").otherwise("return").alias("kind"))
    return compare.call_pairs(rows).select("case_id", "return_seq", "call_seq")


@query("SELECT DISTINCT 'f' || o_custkey % 50 AS path FROM orders UNION SELECT 'f' || s_suppkey FROM supplier")
def cross_checked(spark: SparkSession, d: str) -> DataFrame:
    ours = table(spark, d, "orders").select(_text("f", F.col("o_custkey") % 50).alias("path"))
    return compare.cross_checked(ours, table(spark, d, "supplier").select(_text("f", F.col("s_suppkey")).alias("path")))


@query("""WITH f AS (SELECT o_orderkey AS k, 'file' || o_custkey % 20 AS file, o_orderkey % 30 AS line FROM orders), s AS (SELECT s_suppkey AS k, 'file' || s_suppkey % 20 AS file, s_suppkey % 10 AS a, s_suppkey % 10 + 8 AS b FROM supplier),
o AS (SELECT f.k, arg_max(s.k, s.a * 1000000 - s.k) AS owner FROM f JOIN s ON f.file = s.file AND line BETWEEN a AND b GROUP BY f.k),
x AS (SELECT 'finding:' || k AS source_ref, 'LOCATED_IN' AS relation, 'symbol:' || owner AS target_ref FROM o UNION SELECT 'finding:' || f.k, 'EXHIBITS', 'flow:' || c_custkey FROM f JOIN customer ON f.file = 'file' || c_custkey % 20 AND line = c_custkey % 30 UNION SELECT 'finding:' || k, 'COVERED_BY', 'test:' || owner FROM o WHERE owner % 2 = 0)
SELECT relation, count(*) AS n, count(DISTINCT source_ref) AS sources, count(DISTINCT target_ref) AS targets, 0 AS dangling FROM x GROUP BY relation""")
def evidence_attach(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their symbol, flows and tests as evidence; no edge dangles."""
    file = lambda c: _text("file", F.col(c) % 20).alias("file")
    findings = table(spark, d, "orders").select(_text("finding:", F.col("o_orderkey")).alias("ref"), file("o_custkey"), (F.col("o_orderkey") % 30).alias("line"))
    k = F.col("s_suppkey")
    symbols = table(spark, d, "supplier").select(_text("symbol:", k).alias("uid"), file("s_suppkey"), (k % 10).alias("start_line"), (k % 10 + 8).alias("end_line"), k.alias("seq"))
    ends = table(spark, d, "customer").select(_text("flow:", F.col("c_custkey")).alias("ref"), file("c_custkey"), (F.col("c_custkey") % 30).alias("line"))
    tests = table(spark, d, "supplier").filter(k % 2 == 0).select(_text("symbol:", k).alias("uid"), _text("test:", k).alias("test"))
    return integrity.attach(findings, symbols, ends, tests).counts()


@query("SELECT unnest(['as signed', 'other key', 'changed node', 'dangling']) AS what, unnest([true, false, false, false]) AS verified")
def certificate_checks(spark: SparkSession, d: str) -> DataFrame:
    """A certificate over the keys' graph: verified as signed, and by nothing else."""
    nodes = stored(key_nodes(spark, d).select(F.col("uid").alias("ref"), F.col("kind").alias("type"), F.col("name").alias("title"), F.col("file").alias("content")), "nodes")
    edges = stored(graph.merge_edges(key_edges(spark, d)).filter("kind <> 'PLACED'").select(F.col("src").alias("source_ref"), F.col("kind").alias("relation"), F.col("dst").alias("target_ref")), "edges")
    document = integrity.certificate(nodes, edges, b"k")
    changed = nodes.withColumn("title", F.when(F.col("ref") == "region:1", "x").otherwise(F.col("title")))
    checks = {"as signed": (nodes, b"k"), "other key": (nodes, b"x"), "changed node": (changed, b"k"), "dangling": (nodes.filter("ref <> 'region:1'"), b"k")}
    return spark.createDataFrame([(what, integrity.verify_certificate(document, n, edges, key)) for what, (n, key) in checks.items()], "what string, verified boolean")


# -- streams ------------------------------------------------------------------------------------------
@query("SELECT user_id::VARCHAR AS run_id, count(*) AS events, max(seq) AS last, count(DISTINCT seq) AS different FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream in bounded batches: each (run, seq) once, though some were delivered twice."""
    path, out = _folder(spark, "stream"), _folder(spark, "deduped")
    run_events(spark, d).select("run_id", "seq", "ts", "t", "payload").repartition(8).write.parquet(path)
    follow.drain_to(ev.dedup_stream(ev.read_events(spark, path, 3), "10000 days"), out, _folder(spark, "state"))
    return spark.read.schema(ev.EVENT).parquet(out).groupBy("run_id").agg(F.count("*").alias("events"), F.max("seq").alias("last"), F.count_distinct("seq").alias("different"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS run_id, row_number() OVER w AS seq, epoch_us(ts) AS micros, event_id, user_id % 3 = 0 AND row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS done
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, coalesce(lag(seq) OVER w, 0) AS before, lead(seq) OVER w AS behind, lead(micros) OVER w AS later FROM e WHERE done OR event_id % 97 <> 0 WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, 'event' AS kind, seq, seq AS until, micros FROM g UNION ALL SELECT run_id, 'end', seq, seq, micros FROM g WHERE done
UNION ALL SELECT run_id, 'gap', before + 1, seq - 1, NULL FROM g WHERE seq > before + 1
UNION ALL SELECT run_id, 'heartbeat', seq, seq, micros + 15000000 FROM g WHERE NOT done AND (behind IS NULL OR behind > seq + 1 OR later - micros > 15000000)""")
def live_follow(spark: SparkSession, d: str) -> DataFrame:
    """Runs followed live: the events come in three instalments, some one late, some again, some never; the follower starts
    anew for each from its checkpoint. A user is a run; every third ends with its last event."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id")
    seq = F.row_number().over(by.orderBy("ts", "event_id")).cast("long")
    done = (F.col("user_id") % 3 == 0) & (F.col("_seq") == F.count("*").over(by))
    rows = e.withColumn("_seq", seq).select(F.col("user_id").cast("string").alias("run_id"), F.col("_seq").alias("seq"), "ts", F.when(done, "done").otherwise("log").alias("t"), F.lit("{}").alias("payload"), "event_id")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    third = (span.b - span.a) / 3
    due = F.when(F.col("ts") < F.lit(span.a + third), 0).when(F.col("ts") < F.lit(span.a + 2 * third), 1).otherwise(2)
    late = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    again = F.when(F.col("event_id") % 5 == 0, F.array(due + late, due + late + 1)).otherwise(F.array(due + late))
    sent = rows.filter("t = 'done' or event_id % 97 <> 0").select("*", F.explode(again).alias("part"))
    last = spark.createDataFrame([("", 1, span.b + 20 * third, "log", "{}", 4)], "run_id string, seq long, ts timestamp, t string, payload string, part int")
    sent = stored(sent.drop("event_id").unionByName(last), "sent")
    source, out, state = (_folder(spark, n) for n in ("instalments", "followed", "state"))
    apart = int(third.total_seconds() * 1000) + 86_400_000  # how late an event may be
    for part in range(5):
        sent.filter(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        follow.drain_to(follow.follow(ev.read_events(spark, source, 1000), f"{apart} milliseconds", apart), out, state)
    found = spark.read.schema(follow.FOLLOWED).parquet(out).filter("run_id <> ''")
    return found.select("run_id", "kind", "seq", "until", F.unix_micros("ts").alias("micros"))


@query("SELECT DISTINCT user_id::VARCHAR AS run_id FROM events WHERE event_type = 'signup'")
def finished_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a terminal event: a follower stops there."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_type") == "signup", "done").otherwise("log").alias("t"))
    return ev.finished(rows)


@query("SELECT user_id::VARCHAR AS run_id, CASE WHEN event_type = 'view' THEN 'phase' ELSE 'metric' END AS t, max(seq) AS seq FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY ALL")
def latest_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ev.latest_by_type(run_events(spark, d)).select("run_id", "t", "seq")
