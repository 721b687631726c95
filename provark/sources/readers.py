"""Sources: source trees, corpora, traces, manifests, tables in text, environment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provark.functions.text import lines_of, minified_reason
from provark.plans.storage import stored

#: Suffixes of languages, and what a scan passes over.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "php": "php", "sh": "shell", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml"}
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "target")
IGNORED_SUFFIXES = ("png", "jpg", "gif", "ico", "pdf", "zip", "gz", "whl", "so", "pyc", "woff", "woff2")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])[suffix(path)]


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path (below the root), content, length of a tree's files, sorted, without ignored folders and suffixes.

    The reader prunes nothing by itself: the path filter applies before contents are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(path.alias("path"), "content", "length")
    inner = F.split("path", "/")
    keep = ~F.arrays_overlap(inner, F.array(*map(F.lit, IGNORED_DIRS))) & ~suffix(F.col("path")).isin(*IGNORED_SUFFIXES)
    if suffixes:
        keep &= suffix(F.col("path")).isin(*suffixes)
    return rows.filter(keep).orderBy("path")


def index_tree(spark: SparkSession, root: str, max_files: int = 4000) -> DataFrame:
    """Files of a known language as records, among the first `max_files` files in order of path."""
    known = list_files(spark, root).limit(max_files).filter(language(F.col("path")).isNotNull())
    return file_records(known.select("path", F.decode("content", "UTF-8").alias("text")))


def file_records(files: DataFrame) -> DataFrame:
    """path, language, lines (line feeds and one), sha256, skip_reason of (path, text)."""
    return files.select(
        "path",
        language(F.col("path")).alias("language"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"),
        F.sha2("text", 256).alias("sha256"),
        minified_reason(F.col("path"), F.col("text")).alias("skip_reason"),
    )


def json_corpus(spark: SparkSession, path: str, schema: str, limit: int = 40) -> DataFrame:
    """Cases of a folder of JSON files in order of file name; files that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    whole = stored(rows.withColumn("file", F.input_file_name()), "json-corpus")  # the corrupt column needs more than itself read
    return whole.filter("_corrupt_record is null").drop("_corrupt_record").orderBy("file").limit(limit)


def pipe_table(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, cells (map of header to cell) of tables in pipes: ragged rows and the rule go, empty is null."""
    bars = lambda c: F.transform(F.split(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\|", ""), r"(?<!\\)\|$", ""), r"(?<!\\)\|", -1), lambda x: F.nullif(F.replace(F.trim(x), F.lit("\\|"), F.lit("|")), F.lit("")))
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(text_col))).alias("at", "raw")).filter(F.trim("raw").startswith("|"))
    rows = rows.filter(~F.col("raw").rlike(r"^\s*\|?[\s:|-]+\|?\s*$")).withColumn("cells", bars(F.col("raw")))
    first = F.first("cells").over(Window.partitionBy("id").orderBy("at"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    body = rows.withColumns({"header": first, "n": number}).filter((F.col("n") > 1) & (F.size("cells") == F.size("header")))
    return body.select("id", (F.col("n") - 1).alias("row"), F.map_from_arrays("header", "cells").alias("cells"))


def dotenv(texts: DataFrame, id_col: str, text_col: str, limit: int = 200) -> DataFrame:
    """id, key, value of KEY=VALUE lines: export and quotes go, comments too; the last of a key stays, `limit` lines count."""
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(F.slice(lines_of(F.col(text_col)), 1, limit)).alias("at", "raw"))
    line = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    value = F.regexp_replace(F.regexp_extract("raw", line, 2), r"""^(["'])(.*)\1$""", "$2")
    parsed = rows.select("id", "at", F.regexp_extract("raw", line, 1).alias("key"), value.alias("value")).filter("key <> ''")
    return parsed.groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))


def locked_count(files: DataFrame) -> DataFrame:
    """path, locked: entries of lock files by their format; 0 where one does not parse."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    count = (
        F.when(name == "package-lock.json", F.size(F.array_remove(F.json_object_keys(F.get_json_object("text", "$.packages")), "")))
        .when(name == "poetry.lock", F.regexp_count("text", F.lit(r"(?m)^\[\[package\]\]")))
        .when(name == "Cargo.lock", F.regexp_count("text", F.lit(r"(?m)^\[\[package\]\]")))
        .when(name == "yarn.lock", F.regexp_count("text", F.lit(r"(?m)^\S.*:$")))
        .when(name == "go.sum", F.regexp_count("text", F.lit(r"(?m)^\S+ v\S+ h1:")))
    )
    return files.select("path", F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).alias("locked"))


def config_roles(path: Column) -> Column:
    """What a configuration file is for, by ordered rules over its path."""
    return (
        F.when(path.rlike(r"(^|/)Dockerfile"), "container")
        .when(path.rlike(r"docker-compose.*\.ya?ml$"), "compose")
        .when(path.rlike(r"(^|/)\.github/workflows/"), "ci")
        .when(path.rlike(r"(^|/)(k8s|kubernetes|helm)/"), "deployment")
        .when(path.rlike(r"(^|/)\.env"), "environment")
        .when(path.rlike(r"\.(ya?ml|toml|ini|cfg|conf)$"), "settings")
    )


def ports(text: Column) -> Column:
    """Declared ports from 1 to 65535: distinct, in order. A port is a setting named so (`port: 80`, `HTTP_PORT=80`), an
    EXPOSE or listen instruction, or an entry of a compose list (`"8080:80"`, of which both count)."""
    setting = r"""(?im)(?:^|[^A-Za-z])(?:port|listen)["']?\s*[:=]\s*["']?(?:[\w.\-]*:)?([0-9]{1,5})(?![0-9.:])"""
    told = r"""(?im)^\s*(?:expose|listen)\s+(?:[\d.]+:)?([0-9]{1,5})(?![0-9.:])"""
    published = r"""(?m)^\s*-\s*["']?(?:[\d.]+:)?([0-9]{1,5}):([0-9]{1,5})(?:/(?:tcp|udp))?["']?\s*$"""
    whole = F.regexp_extract_all(text, F.lit(f"{setting}|{told}|{published}"), F.lit(0))
    numbers = F.flatten(F.transform(whole, lambda x: F.array(*[F.try_to_number(F.nullif(F.regexp_extract(x, p, g), F.lit("")), F.lit("99999")).cast("int") for p, g in ((setting, 1), (told, 1), (published, 1), (published, 2))])))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(1, 65535)))


def test_files(files: DataFrame, frameworks: dict[str, list[str]]) -> DataFrame:
    """path, framework, cases of test files (by path): the framework of most marker hits, the first on ties;
    cases are distinct and sorted."""
    own = files.filter(F.col("path").rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._]test\.[a-z]+$|\.spec\.[a-z]+$"))
    scores = [F.struct(sum((F.regexp_count("text", F.lit(m)) for m in marks), F.lit(0)).alias("hits"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, marks) in enumerate(frameworks.items())]
    best = F.array_max(F.array(*scores))
    cases = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"def (test_[A-Za-z0-9_]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"""(?:it|test)\(["']([^"']+)"""), F.lit(1)))))
    return own.select("path", F.when(best["hits"] > 0, best["name"]).alias("framework"), cases.alias("cases"))


def http_routes(files: DataFrame) -> DataFrame:
    """method, path, params, files: routes merged by method and path; a path begins with `/`. Families: decorators
    and app.get(...) calls by method, @app.route with its methods (GET without), comparisons with a pathname (GET),
    and file paths: Next.js `app/**/route.*` by the methods that it exports, `pages/api/**` for any method (ANY).
    params: placeholders of the path, and query parameters that the file reads."""
    known = _route_rows(files)
    return known.groupBy("method", "path").agg(_route_params(), F.array_sort(F.collect_set("file")).alias("files"))


def route_counts(files: DataFrame) -> DataFrame:
    """method, path, params, files: the routes of http_routes with the number of their files, a row of files being one
    file: a route that thousands of files have is counted where they are, and no row gathers their names."""
    return _route_rows(files).groupBy("method", "path").agg(_route_params(), F.count("*").alias("files"))


def _route_params() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("_p")))).alias("params")


def _route_rows(files: DataFrame) -> DataFrame:
    """file, method, path, _p: the distinct routes of each file (path, text; a row a file), all families in one read."""
    found = lambda pattern, i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
    route = lambda method, path: F.struct(method.alias("method"), path.alias("path"))
    none = F.array().cast("array<struct<method:string,path:string>>")
    shapes = [r"""@\w+\.(get|post|put|delete|patch)\(\s*["']([^"']+)""", r"""\b(?:app|router)\.(get|post|put|delete|patch)\(\s*["'`]([^"'`]+)"""]
    every = [F.zip_with(found(s, 1), found(s, 2), lambda m, p: route(F.upper(m), p)) for s in shapes]
    flask = r"""@\w+\.route\(\s*["']([^"']+)["']([^)]*)\)"""
    named = lambda o: F.regexp_extract_all(o, F.lit(r"""["'](GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)["']"""), F.lit(1))
    told = lambda o: F.when(F.size(named(o)) > 0, named(o)).otherwise(F.array(F.lit("GET")))
    every.append(F.flatten(F.zip_with(found(flask, 1), found(flask, 2), lambda p, o: F.transform(told(o), lambda m: route(m, p)))))
    every.append(F.transform(found(r"""pathname\s*===?\s*["']([^"']+)["']""", 1), lambda p: route(F.lit("GET"), p)))
    below = lambda pattern: F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract("path", pattern, 1)), r"/$", "")
    app, api = r"(?:^|/)app/(.*?)/?route\.[jt]sx?$", r"(?:^|/)pages/(api/.*?)(?:/index)?\.[jt]sx?$"
    exported = found(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b", 1)
    every.append(F.when(F.col("path").rlike(app), F.transform(exported, lambda m: route(m, F.when(below(app) == "", "/").otherwise(below(app))))))
    every.append(F.when(F.col("path").rlike(api), F.array(route(F.lit("ANY"), below(api)))))
    routes = F.array_distinct(F.concat(*[F.coalesce(e, none) for e in every]))
    reads = F.concat(found(r"""(?:request\.args\.get|searchParams\.get|query\.get)\(\s*["'](\w+)""", 1), found(r"req\.query\.(\w+)", 1))
    # outer: else the array is made once more to look whether it is empty; an empty one falls with the filter
    rows = files.select(F.col("path").alias("file"), reads.alias("_q"), F.explode_outer(routes).alias("r")).select("file", "_q", "r.*")
    params = F.regexp_extract_all("path", F.lit(r"[{:<\[](?:\w+:)?(\w+)[}>\]]?"), F.lit(1))
    own = rows.filter(F.col("path").startswith("/"))
    return own.select("file", "method", "path", F.concat(params, F.coalesce("_q", F.array().cast("array<string>"))).alias("_p"))


def edge_pattern(nodes: DataFrame, edges: DataFrame, kind: str, source_kind: str | None = None, target_kind: str | None = None) -> DataFrame:
    """(a)-[kind]->(b) as src, dst, confidence, with optional kinds of both ends."""
    rows = edges.filter(F.col("kind") == kind)
    for end, wanted in (("src", source_kind), ("dst", target_kind)):
        if wanted:
            own = nodes.filter(F.col("kind") == wanted).select(F.col("uid").alias(end))
            rows = rows.join(own, end, "left_semi")
    return rows.select("src", "dst", "confidence")


def execution_flows(edges: DataFrame, kind: str = "STEP_IN_PROCESS") -> DataFrame:
    """process, members: distinct members of each process, sorted."""
    return edges.filter(F.col("kind") == kind).groupBy(F.col("dst").alias("process")).agg(F.array_sort(F.collect_set("src")).alias("members"))
