"""Registered queries whose texts have as many shapes as the orders have combinations of lines; their SQL computes from the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.functions import arrow_udfs
from provark.functions import text as tx
from provark.operators import compare, rules
from provark.plans.source_queries import _text
from provark.plans.storage import query, table
from provark.sources import readers

_LINES = "l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)"
#: A line's part of its order's patch: file, binary or not, removed and added lines, an import, a second hunk.
_PARTS = f"""{_LINES}, b AS (SELECT *, CASE WHEN p % 7 = 0 THEN 'secrets' ELSE 'src' || p % 4 END || '/f' || n || '.py' AS f, s % 5 = 4 AS bin, p % 3 AS gone, s % 4 AS come,
  p % 11 = 0 AND s % 4 > 0 AS imp, n % 2 = 0 AS more FROM l)"""
_STATS = """SELECT k AS id, count(DISTINCT f) FILTER (NOT bin) AS files, coalesce(sum(1 + more::INT) FILTER (NOT bin), 0)::BIGINT AS hunks,
  coalesce(sum(come) FILTER (NOT bin), 0)::BIGINT AS added, coalesce(sum(gone) FILTER (NOT bin), 0)::BIGINT AS removed FROM b GROUP BY k"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    named = {"l_orderkey": "k", "l_linenumber": "n", "l_partkey": "p", "l_suppkey": "s"}
    return table(spark, d, "lineitem").select(*[F.col(a).alias(b) for a, b in named.items()]).distinct()


def _gathered(lines: DataFrame, text) -> DataFrame:
    """id, text: the texts of an order's lines one after the other; an order has a few lines."""
    rows = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "p", "s", text.alias("text")))).alias("rows"))
    return rows.select(F.col("k").alias("id"), F.array_join("rows.text", "").alias("text"))


def order_patches(lines: DataFrame) -> DataFrame:
    """id, patch: a patch an order, a file a line: binary or with one or two hunks, removed and added lines that may look
    like a file's head, protected folders and imports."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    gone, come, imports = (p % 3).cast("int"), (s % 4).cast("int"), (p % 11 == 0) & (s % 4 > 0)
    file = F.concat(F.when(p % 7 == 0, "secrets").otherwise(_text("src", p % 4)), _text("/f", n, ".py"))
    out = F.when(p % 2 == 0, F.repeat(F.lit("--- r\n"), gone)).otherwise(F.repeat(F.lit("-r\n"), gone))
    left = come - imports.cast("int")
    in_ = F.concat(F.when(imports, "+import pickle\n").otherwise(""), F.when(s % 2 == 0, F.repeat(F.lit("+++ a\n"), left)).otherwise(F.repeat(F.lit("+a\n"), left)))
    hunk = F.concat(_text("--- a/", file, "\n+++ b/", file, "\n@@ -1,", gone + 1, " +1,", come + 1, " @@\n c", n, "\n"), out, in_)
    block = F.when(s % 5 == 4, _text("Binary files a/", file, " and b/", file, " differ\n")).otherwise(F.concat(hunk, F.when(n % 2 == 0, "@@ -9 +9 @@\n x\n").otherwise("")))
    return _gathered(lines, block).withColumnRenamed("text", "patch")


@query(f"WITH {_PARTS} {_STATS}")
def order_diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff_stats(order_patches(_lines(spark, d)))


@query(f"""WITH {_PARTS}, t AS ({_STATS}) SELECT DISTINCT k AS id, 'protected_path' AS rule, f AS detail FROM b WHERE NOT bin AND p % 7 = 0
UNION ALL SELECT DISTINCT k, 'binary', '' FROM b WHERE bin UNION ALL SELECT k, 'import', '+import pickle' FROM b WHERE NOT bin AND imp
UNION ALL SELECT id, 'file_count', files::VARCHAR FROM t WHERE files > 3 UNION ALL SELECT id, 'size', added::VARCHAR FROM t WHERE added > 6
UNION ALL SELECT id, 'blast_radius', score::VARCHAR FROM (SELECT o_orderkey AS id, o_custkey % 10 / 10 AS score FROM orders) SEMI JOIN b ON id = k WHERE score > 0.8
UNION ALL SELECT o_orderkey, 'assurance_level', o_level FROM (SELECT *, ['A', 'B', 'C', 'R'][o_custkey % 4 + 1] AS o_level FROM orders) SEMI JOIN b ON o_orderkey = k WHERE o_level IN ('C', 'R')""")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the policy over patches of many shapes, with radii and levels of the orders' customers."""
    orders, c = table(spark, d, "orders"), F.col("o_custkey")
    radius = orders.select(F.col("o_orderkey").alias("id"), (c % 10 / 10).alias("score"))
    levels = orders.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, compare.LEVELS)), (c % 4 + 1).cast("int")).alias("level"))
    return compare.policy_violations(order_patches(_lines(spark, d)), ["secrets/**"], max_files=3, max_added=6, radius=radius, levels=levels)


@query(f"""WITH {_PARTS} SELECT k AS id, string_agg('c' || n || repeat(chr(10) || CASE WHEN p % 2 = 0 THEN '-- r' ELSE 'r' END, gone) || CASE WHEN more THEN chr(10) || 'x' ELSE '' END, chr(10) ORDER BY n, p, s) AS before,
  string_agg('c' || n || CASE WHEN imp THEN chr(10) || 'import pickle' ELSE '' END || repeat(chr(10) || CASE WHEN s % 2 = 0 THEN '++ a' ELSE 'a' END, come - imp::INT) || CASE WHEN more THEN chr(10) || 'x' ELSE '' END, chr(10) ORDER BY n, p, s) AS after
FROM b WHERE NOT bin GROUP BY k""")
def order_diff_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of the patches that have a hunk."""
    return compare.before_after(order_patches(_lines(spark, d)).filter(F.col("patch").contains("@@ ")))


@query(f"""WITH {_PARTS} SELECT k AS id, string_agg('hunk: -' || gone || ' +' || come || CASE WHEN more THEN '; hunk: -0 +0' ELSE '' END, '; ' ORDER BY n, p, s) AS summary FROM b WHERE NOT bin GROUP BY k""")
def order_hunks(spark: SparkSession, d: str) -> DataFrame:
    return order_patches(_lines(spark, d)).filter(F.col("patch").contains("@@ ")).select("id", arrow_udfs.hunk_summary("patch").alias("summary"))


#: Methods of the routes, by line number.
_METHODS = ("get", "post", "put", "delete", "patch")


@query(f"""WITH {_LINES}, m AS (SELECT *, ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'][n % 5 + 1] AS m, CASE WHEN k % 4 = 0 THEN ['q' || k % 3] ELSE [] END AS q FROM l),
r AS (SELECT k, q, m AS method, '/a' || s % 9 || '/{{id}}' AS path, ['id'] AS ph FROM m WHERE p % 4 = 0 UNION ALL SELECT k, q, unnest(CASE WHEN n % 2 = 0 THEN ['GET', 'POST'] ELSE ['GET'] END), '/b' || s % 9, [] FROM m WHERE p % 4 = 1
  UNION ALL SELECT k, q, 'GET', '/c' || s % 9, [] FROM m WHERE p % 4 = 2 UNION ALL SELECT k, q, m, '/a' || s % 9 || '/:slug', ['slug'] FROM m WHERE p % 4 = 3)
SELECT method, path, list_sort(list_distinct(flatten(list(list_concat(ph, q))))) AS params, count(DISTINCT k) AS files FROM r GROUP BY method, path""")
def order_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of files that mix four families; parameters of a route come from its path and from every file that has it."""
    k, n, p, s = (F.col(c) for c in "knps")
    method = F.element_at(F.array(*map(F.lit, _METHODS)), (n % 5 + 1).cast("int"))
    route = (
        F.when(p % 4 == 0, _text("@router.", method, "('/a", s % 9, "/{id}')\ndef f(id): pass\n"))
        .when(p % 4 == 1, F.concat(_text("@app.route('/b", s % 9, "'"), F.when(n % 2 == 0, ", methods=['GET', 'POST']").otherwise(""), F.lit(")\ndef g(): pass\n")))
        .when(p % 4 == 2, _text("if (pathname === '/c", s % 9, "') {}\n"))
        .otherwise(_text("router.", method, "(`/a", s % 9, "/:slug`, h)\n"))
    )
    files = _gathered(_lines(spark, d), route)
    read = F.when(F.col("id") % 4 == 0, _text("request.args.get('q", F.col("id") % 3, "')\n")).otherwise("")
    return readers.route_counts(files.select(_text("s", F.col("id"), ".py").alias("path"), F.concat("text", read).alias("text")))


@query("""SELECT *, row_number() OVER (ORDER BY file, line, rule) - 1 AS at FROM (SELECT DISTINCT 'src/f' || l_partkey % 97 || '.py' AS file, l_orderkey % 500 AS line, 'r' || l_suppkey % 13 AS rule FROM lineitem)""")
def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Findings in a scan's order."""
    rows = table(spark, d, "lineitem").select(_text("src/f", F.col("l_partkey") % 97, ".py").alias("file"), (F.col("l_orderkey") % 500).alias("line"), _text("r", F.col("l_suppkey") % 13).alias("rule"))
    return rules.scan_order(rows.distinct())


@query(f"""WITH {_LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS i FROM l)
SELECT k AS id, 'K' || s % 3 AS key, arg_max(p || CASE WHEN p % 5 = 1 THEN ' x' ELSE '' END, i) AS value FROM a WHERE p % 5 IN (0, 1, 3) GROUP BY k, s % 3""")
def order_env(spark: SparkSession, d: str) -> DataFrame:
    """Environment files of exported, quoted, repeated and commented keys and of lines that are none."""
    n, p, key = F.col("n"), F.col("p"), _text("K", F.col("s") % 3)
    line = F.when(p % 5 == 0, _text("export ", key, "=", p)).when(p % 5 == 1, _text(key, ' = "', p, ' x"')).when(p % 5 == 2, _text("# ", key, "=", p)).when(p % 5 == 3, _text(key, "='", p, "'")).otherwise(_text("no line ", n))
    return readers.dotenv(_gathered(_lines(spark, d), F.concat(line, F.lit("\n"))), "id", "text")


@query(f"""WITH {_LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS row FROM l)
SELECT k AS id, row, CASE WHEN p % 4 = 3 THEN 'x|' || p ELSE p::VARCHAR END AS a, CASE WHEN p % 4 <> 1 THEN s::VARCHAR END AS b FROM a WHERE p % 4 <> 2""")
def order_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables in pipes that mix whole, empty, escaped and ragged rows; a ragged row keeps its number to itself."""
    p, s = F.col("p"), F.col("s")
    line = F.when(p % 4 == 0, _text("| ", p, " | ", s, " |\n")).when(p % 4 == 1, _text("| ", p, " | |\n")).when(p % 4 == 2, "| ragged |\n").otherwise(_text("|x\\|", p, "|", s, "|\n"))
    texts = _gathered(_lines(spark, d), line).select("id", _text("title\n| a | b |\n|:--|---|\n", F.col("text")).alias("text"))
    cells = readers.pipe_table(texts, "id", "text")
    return cells.select("id", F.col("row").cast("long").alias("row"), F.col("cells")["a"].alias("a"), F.col("cells")["b"].alias("b"))


@query(f"""WITH {_LINES}, f AS (SELECT k, CASE WHEN p % 6 = 5 THEN 'f' || p || '.lock' ELSE ['src', 'lib', 'a'][p % 3 + 1] || repeat('/x', s % 3) || CASE WHEN n % 2 = 0 THEN '/gen' ELSE '' END || '/f' || p || CASE WHEN p % 4 = 0 THEN '.lock' ELSE '.py' END END AS path FROM l),
g AS (SELECT k, path, string_split(path, '/') AS w FROM f)
SELECT k AS id, count(*) FILTER (w[1] = 'src' AND len(w) > 2 AND w[-2] = 'gen' AND suffix(path, '.py')) AS guarded, count(*) FILTER (len(w) = 1 AND suffix(path, '.lock')) AS locked, count(*) FILTER (w[1] = 'lib' AND len(w) = 3 AND suffix(path, '.py')) AS direct FROM g GROUP BY k""")
def order_globs(spark: SparkSession, d: str) -> DataFrame:
    """Files of each order that three patterns match: folders of any depth, a name without a folder, one folder."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    deep = F.concat(F.element_at(F.array(*map(F.lit, ("src", "lib", "a"))), (p % 3 + 1).cast("int")), F.repeat(F.lit("/x"), (s % 3).cast("int")), F.when(n % 2 == 0, "/gen").otherwise(""), _text("/f", p), F.when(p % 4 == 0, ".lock").otherwise(".py"))
    path = F.when(p % 6 == 5, _text("f", p, ".lock")).otherwise(deep)
    patterns = {"guarded": "src/**/gen/*.py", "locked": "*.lock", "direct": "lib/*/*.py"}
    return _lines(spark, d).withColumn("path", path).groupBy(F.col("k").alias("id")).agg(*[F.count_if(F.col("path").rlike(tx.glob_to_regex(g))).alias(a) for a, g in patterns.items()])


#: Parts of field names; the SQL names those that hide a value.
_HEADS, _SEPARATORS, _TAILS = ("db", "token", "my", "x"), ("_", ".", "-"), ("password", "tokens", "api_key", "name", "secret")


@query(f"""WITH {_LINES} SELECT k AS id, n, p, s, {list(_HEADS)}[p % 4 + 1] || {list(_SEPARATORS)}[s % 3 + 1] || {list(_TAILS)}[n % 5 + 1] AS name,
CASE WHEN p % 4 = 1 OR n % 5 IN (0, 2, 4) THEN '***' ELSE p::VARCHAR END AS value FROM l""")
def order_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Fields of sixty names, masked by a whole segment or a part of the name."""
    pick = lambda words, c, m: F.element_at(F.array(*map(F.lit, words)), (F.col(c) % m + 1).cast("int"))
    lines = _lines(spark, d).withColumn("name", F.concat(pick(_HEADS, "p", 4), pick(_SEPARATORS, "s", 3), pick(_TAILS, "n", 5)))
    masked = tx.redact_map(F.create_map("name", F.col("p").cast("string")))
    return lines.select(F.col("k").alias("id"), "n", "p", "s", "name", F.map_values(masked)[0].alias("value"))


@query(f"""WITH {_LINES} SELECT k AS id, '{{"rows":[0' || string_agg(CASE p % 3 WHEN 0 THEN ',{{"p":' || p || ',"s":' || s || '}}' WHEN 1 THEN ',{{"p":{{"z":' || s || '}}}}' ELSE ',[' || p || ',{{}}]' END, '' ORDER BY n, p, s) || ']}}' AS stable FROM l GROUP BY k""")
def order_stable_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON of three kinds of members without what differs from run to run."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    member = F.when(p % 3 == 0, _text(', {"s": ', s, ', "p": ', p, "}")).when(p % 3 == 1, _text(', {"pid": ', n, ', "p": {"timestamp": "t", "z": ', s, "}}")).otherwise(_text(", [", p, ', {"duration_ms": ', s, "}]"))
    return _gathered(_lines(spark, d), member).select("id", arrow_udfs.without_volatile(_text('{"rows": [0', F.col("text"), '], "timestamp": 1}')).alias("stable"))


@query(f"WITH {_LINES} SELECT k AS id, count(*) FILTER (p % 3 > 0)::INT AS locked FROM l GROUP BY k")
def order_locks(spark: SparkSession, d: str) -> DataFrame:
    """Lock files of four formats with lines that are no entries."""
    k, p = F.col("k"), F.col("p")
    packages = F.when(p % 3 > 0, _text("[[package]]\nname = ", p, "\n")).otherwise("# [[package]]\n")
    sums = F.when(p % 3 > 0, _text("a/b", p, " v1.", p, " h1:x=\n")).otherwise(_text("a/b", p, "\n"))
    yarn = F.when(p % 3 > 0, _text('"b', p, '@1":\n  version "1"\n')).otherwise("  dependencies:\n")
    files = _gathered(_lines(spark, d), F.when(k % 4 < 2, packages).when(k % 4 == 2, sums).otherwise(yarn))
    name = F.element_at(F.array(*map(F.lit, ("poetry.lock", "Cargo.lock", "go.sum", "yarn.lock"))), (F.col("id") % 4 + 1).cast("int"))
    return readers.locked_count(files.select(_text(F.col("id"), "/", name).alias("path"), "text")).select(F.substring_index("path", "/", 1).cast("long").alias("id"), "locked")


@query(f"""WITH {_LINES}, h AS (SELECT k, count(*) FILTER (p % 4 = 0) AS a, 2 * count(*) FILTER (p % 4 = 2) AS b,
list(DISTINCT CASE WHEN p % 4 = 1 THEN 'test_' || s % 5 ELSE 'case ' || s % 5 END) FILTER (p % 2 = 1) AS cases FROM l WHERE k % 4 < 3 GROUP BY k)
SELECT k AS id, CASE WHEN a + b = 0 THEN NULL WHEN a >= b THEN 'pytest' ELSE 'jest' END AS framework, list_sort(coalesce(cases, [])) AS cases FROM h""")
def order_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test files by three kinds of paths; markers of two frameworks are mixed and may tie, cases repeat."""
    i, p, s = F.col("id"), F.col("p"), F.col("s") % 5
    line = F.when(p % 4 == 0, "import pytest\n").when(p % 4 == 1, _text("def test_", s, "():\n  pass\n")).when(p % 4 == 2, "describe(expect(\n").otherwise(_text("it('case ", s, "')\n"))
    path = F.when(i % 4 == 0, _text("tests/a", i, ".py")).when(i % 4 == 1, _text("src/test_", i, ".py")).when(i % 4 == 2, _text("src/", i, ".spec.ts")).otherwise(_text("src/", i, ".py"))
    files = _gathered(_lines(spark, d), line).select(path.alias("path"), "text")
    found = readers.test_files(files, {"pytest": ["import pytest"], "jest": [r"describe\(", r"expect\("]})
    return found.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("id"), "framework", "cases")


#: What a trace's other lines say, and the labels by which they are counted.
_SIGNALS = {"timed out": "timeout", "out of memory": "oom", "stack overflow": "overflow", "killed": "oom"}


@query(f"""WITH {_LINES}, f AS (SELECT *, CASE WHEN p % 3 > 0 THEN 'src/' ELSE '/usr/lib/' END || 'm' || s % 7 || '.py:' || n * 10 AS site, row_number() OVER (PARTITION BY k ORDER BY n, p, s) AS i FROM l),
g AS (SELECT k, arg_max(site, i) FILTER (p % 5 > 0 AND p % 3 > 0) AS site, bool_or(p % 5 = 0 AND s % 4 = 0) AS t, bool_or(p % 5 = 0 AND s % 4 = 1) AS o, bool_or(p % 5 = 0 AND s % 4 = 3) AS late, bool_or(p % 5 = 0 AND s % 4 = 2) AS v FROM f GROUP BY k)
SELECT k AS id, site, list_filter([CASE WHEN t THEN 'timeout' END, CASE WHEN o THEN 'oom' END, CASE WHEN v THEN 'overflow' END, CASE WHEN late AND NOT o THEN 'oom' END],
  lambda x: x IS NOT NULL) AS signals FROM g""")
def order_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces that mix frames of the project and of libraries with messages: the last own frame and the signals, in order."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    frame = _text('  File "', F.when(p % 3 > 0, "src/").otherwise("/usr/lib/"), "m", s % 7, '.py", line ', n * 10, ", in g", s, "\n")
    message = F.element_at(F.array(*map(F.lit, _SIGNALS)), (s % 4 + 1).cast("int"))
    texts = _gathered(_lines(spark, d), F.when(p % 5 == 0, F.concat(message, F.lit("\n"))).otherwise(frame))
    return texts.select("id", tx.crash_site(F.col("text"), "src/").alias("site"), tx.markers(F.col("text"), _SIGNALS).alias("signals"))


@query(f"""WITH {_LINES}, c AS (SELECT *, ['src', './lib', 'a\\b'][p % 3 + 1] AS dir FROM l)
SELECT k AS id, n, p, s, dir || '/f' || s || CASE WHEN n % 3 = 1 THEN ':x' ELSE '' END AS file, CASE WHEN n % 3 = 0 THEN (p % 1000)::INT END AS line,
  regexp_replace(replace(dir, '\\', '/'), '^[.]/', '') || '/f' || s || CASE WHEN s % 2 = 0 THEN '' ELSE ':g' || p END AS uid,
  ['GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'GET'][p % 6 + 1] AS method, '/v' || s % 9 || CASE WHEN n % 2 = 0 THEN '/{{id}}' ELSE '' END AS route, 'red ' || p AS plain FROM c""")
def line_places(spark: SparkSession, d: str) -> DataFrame:
    """Locations, ids, decorators and escapes in all combinations of folder, suffix, kind and method."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    file = _text(F.element_at(F.array(*map(F.lit, ("src", "./lib", "a\\b"))), (p % 3 + 1).cast("int")), "/f", s)
    place, line = tx.split_location(F.concat(file, F.when(n % 3 == 0, _text(":", p % 1000)).when(n % 3 == 1, ":x").otherwise("")))
    call = F.element_at(F.array(*map(F.lit, (*_METHODS, "route"))), (p % 6 + 1).cast("int"))
    method, path = tx.route(_text("@app.", call, F.when(s % 2 == 0, "('").otherwise('( "'), "/v", s % 9, F.when(n % 2 == 0, "/{id}").otherwise(""), F.when(s % 2 == 0, "')").otherwise('")')))
    uid = tx.canonical_uid(file, _text("g", p), F.when(s % 4 == 0, "File").when(s % 4 == 2, "file").otherwise("function"))
    plain = tx.strip_ansi(_text("\x1b[", s % 40, ";1mred\x1b[0m ", p, "\x1b[K"))
    return _lines(spark, d).select(F.col("k").alias("id"), "n", "p", "s", place.alias("file"), line.alias("line"), uid.alias("uid"), method.alias("method"), path.alias("route"), plain.alias("plain"))
