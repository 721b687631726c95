"""Dependencies of manifests, by the structure of each format: maps of JSON, tables of TOML, blocks of go.mod and XML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import lines_of

#: The maps of JSON manifests that hold dependencies, and whether they are for development.
NPM = {"dependencies": False, "devDependencies": True, "peerDependencies": False, "optionalDependencies": False}
COMPOSER = {"require": False, "require-dev": True}
_DEP = "array<struct<name: string, version: string, dev: boolean>>"
_REQUIREMENT = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(.*)$"
_STRINGS = r"""(?:[^\]"'#]|#[^\n]*|"[^"]*"|'[^']*')*"""


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """What `build` makes of a value that it names more than once: a column named twice is worked out twice."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _dep(name: Column, version: Column, dev: Column) -> Column:
    given = _once(F.trim(version), lambda v: F.nullif(v, F.lit("")))
    return F.struct(name.alias("name"), given.alias("version"), dev.alias("dev"))


def _all(text: Column, pattern: str, build: Callable[[Column], Column]) -> Column:
    """What `build` makes of each whole match of a pattern."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)


def _version(spec: Column) -> Column:
    """The first version number of a specifier; a direct reference has none."""
    return _once(spec, lambda x: F.when(~F.ltrim(x).startswith("@"), F.regexp_extract(x, r"([0-9][^\s,;)#]*)", 1)))


def _json(maps: dict[str, bool]) -> Callable[[Column], Column]:
    def read(text: Column) -> Column:
        found = F.from_json(text, ", ".join(f"`{m}` map<string, string>" for m in maps))
        return _once(found, lambda j: F.concat(*[_entries(j[m], dev) for m, dev in maps.items()]))

    return read


def _entries(own: Column, dev: bool) -> Column:
    pairs = F.map_entries(F.coalesce(own, F.create_map().cast("map<string, string>")))
    return F.transform(pairs, lambda e: _dep(e["key"], e["value"], F.lit(dev)))


def _requirement(line: Column, dev: Column) -> Column:
    own = F.regexp_replace(line, ";.*$", "")  # a marker says where, not what
    return _once(own, lambda x: _dep(F.regexp_extract(x, _REQUIREMENT, 1), _version(F.regexp_extract(x, _REQUIREMENT, 2)), dev))


def _requirements(text: Column) -> Column:
    """Lines that name a package: no options, comments, markers or hashes; a line may go on behind a backslash."""
    joined = F.regexp_replace(text, r"\\\r?\n", " ")
    lines = F.transform(lines_of(joined), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(^|\s)#.*$", ""), r"(;|\s--).*$", "")))
    lines = F.filter(lines, lambda x: x.rlike(r"^[A-Za-z0-9]") & ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    return F.transform(lines, lambda x: _requirement(x, F.col("path").contains("dev")))


def _tables(text: Column) -> Column:
    """header, body of a TOML text's tables; what stands before the first has no header."""
    parts = F.split(text, r"""(?m)^(?=[ \t]*\[\[?\s*[A-Za-z"'])""")
    header = lambda p: F.trim(F.regexp_extract(p, r"^\s*\[\[?([^\]\n]+)\]", 1))
    return F.transform(parts, lambda p: F.struct(header(p).alias("header"), p.alias("body")))


def _pairs(body: Column, dev: Column, but: str = "") -> Column:
    """`name = value` lines: a value is a version, or an inline table that may have one."""
    line = r"""^\s*["']?([A-Za-z0-9._-]+)["']?\s*=\s*(.*)$"""
    given = F.filter(F.regexp_extract_all(body, F.lit("(?m)" + line), F.lit(0)), lambda x: ~F.trim(x).startswith("#"))
    value = lambda x: F.regexp_extract(x, line, 2)
    version = lambda v: F.when(v.startswith("{"), F.regexp_extract(v, r"""\bversion\s*=\s*["']([^"']*)["']""", 1)).otherwise(F.regexp_extract(v, r"""^["']([^"']*)["']""", 1))
    named = F.transform(given, lambda x: F.trim(x))
    found = F.transform(named, lambda x: _dep(F.regexp_extract(x, line, 1), _once(value(x), version), dev))
    # a dotted name is a key of another one's table: only its version says something
    found = F.transform(found, lambda d: F.struct(F.regexp_replace(d["name"], r"\.version$", "").alias("name"), d["version"].alias("version"), d["dev"].alias("dev")))
    return F.filter(found, lambda d: ~d["name"].contains(".") & (d["name"] != but))


def _own_table(header: Column, body: Column, pattern: str, dev: Column) -> Column:
    """A dependency that is a table of its own: its name ends the header."""
    version = F.regexp_extract(body, r"""(?m)^\s*version\s*=\s*["']([^"']*)["']""", 1)
    return F.array(_dep(F.regexp_replace(F.regexp_extract(header, pattern, 1), "[\"']", ""), version, dev))


def _cargo(text: Column) -> Column:
    def read(t: Column) -> Column:
        h, dev = t["header"], t["header"].contains("dev-dependencies")
        own = r"""(?:^|\.)(?:dev-|build-)?dependencies\.([^.]+)$"""
        return F.when(h.rlike(r"(^|\.)(dev-|build-)?dependencies$"), _pairs(t["body"], dev)).when(h.rlike(own), _own_table(h, t["body"], own, dev)).otherwise(F.array().cast(_DEP))

    return F.flatten(F.transform(_tables(text), read))


def _quoted(text: Column, dev: Column) -> Column:
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"""(?m)#[^\n]*$|"[^"\n]*"|'[^'\n]*'"""), F.lit(0)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return F.transform(F.filter(bare, lambda x: ~x.startswith("#") & x.rlike(r"^\s*[A-Za-z0-9]")), lambda x: _requirement(x, dev))


def _pyproject(text: Column) -> Column:
    def read(t: Column) -> Column:
        h, b = t["header"], t["body"]
        listed = F.regexp_extract(b, rf"(?m)^\s*dependencies\s*=\s*\[({_STRINGS})\]", 1)
        arrays = F.array_join(F.regexp_extract_all(b, F.lit(rf"=\s*\[({_STRINGS})\]"), F.lit(1)), "\n")
        dev = F.lit(True)
        return (
            F.when(h == "project", _quoted(listed, F.lit(False)))
            .when(h.isin("project.optional-dependencies", "dependency-groups"), _quoted(arrays, dev))
            .when(h.rlike(r"^tool\.poetry\.dependencies$"), _pairs(b, F.lit(False), "python"))
            .when(h.rlike(r"^tool\.poetry\.(dev-dependencies|group\.[^.]+\.dependencies)$"), _pairs(b, dev, "python"))
            .otherwise(F.array().cast(_DEP))
        )

    return F.flatten(F.transform(_tables(text), read))


def _pipfile(text: Column) -> Column:
    def read(t: Column) -> Column:
        return F.when(t["header"].isin("packages", "dev-packages"), _pairs(t["body"], t["header"] == "dev-packages")).otherwise(F.array().cast(_DEP))

    return F.flatten(F.transform(_tables(text), read))


def _go(text: Column) -> Column:
    blocks = lambda plain: F.array_join(F.regexp_extract_all(plain, F.lit(r"(?ms)^\s*require\s*\((.*?)^\s*\)"), F.lit(1)), "\n")
    alone = lambda plain: F.array_join(F.regexp_extract_all(plain, F.lit(r"(?m)^\s*require\s+([^\s(]\S*\s+v\S+)"), F.lit(1)), "\n")
    line = r"(?m)^\s*(\S+)\s+(v\S+)"
    given = _once(F.regexp_replace(text, r"(?m)//.*$", ""), lambda plain: F.concat_ws("\n", alone(plain), blocks(plain)))
    return _all(given, line, lambda x: _dep(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2), F.lit(False)))


def _gem(text: Column) -> Column:
    line = r"""(?m)^[ \t]*gem\s*\(?\s*["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""
    return _all(text, line, lambda x: _dep(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2), F.lit(False)))


def _maven(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<exclusions>.*?</exclusions>", "")
    one = lambda x, tag: F.regexp_extract(x, rf"(?s)<{tag}>\s*([^<]*?)\s*</{tag}>", 1)
    return _all(plain, r"(?s)<dependency>.*?</dependency>", lambda x: _dep(one(x, "artifactId"), one(x, "version"), one(x, "scope") == "test"))


def _gradle(text: Column) -> Column:
    line = r"""(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|[pP]rocessor))\s*\(?\s*["'][^:"']+:([^:"']+)(?::([^"'@:]*))?["'@:]"""
    return _all(text, line, lambda x: _dep(F.regexp_extract(x, line, 2), F.regexp_extract(x, line, 3), F.regexp_extract(x, line, 1).startswith("test")))


def _pubspec(text: Column) -> Column:
    """The keys one step in from `dependencies:` and `dev_dependencies:`."""
    parts = F.split(text, r"(?m)^(?=[A-Za-z_])")
    line = r"""(?m)^(?:  |\t)([A-Za-z0-9_]+):[ \t]*["']?([^\s"'#]*)"""

    def read(p: Column) -> Column:
        own = _all(p, line, lambda x: _dep(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2), p.startswith("dev_")))
        return F.when(p.rlike(r"^(dev_)?dependencies:"), own).otherwise(F.array().cast(_DEP))

    return F.flatten(F.transform(parts, read))


#: File names (patterns) of manifests, in their ecosystem.
FORMATS: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    (r"^package\.json$", "npm", _json(NPM)),
    (r"^composer\.json$", "packagist", _json(COMPOSER)),
    (r"^requirements[^/]*\.txt$", "pypi", _requirements),
    (r"^pyproject\.toml$", "pypi", _pyproject),
    (r"^Pipfile$", "pypi", _pipfile),
    (r"^Cargo\.toml$", "crates", _cargo),
    (r"^go\.mod$", "go", _go),
    (r"^Gemfile$", "rubygems", _gem),
    (r"^pom\.xml$", "maven", _maven),
    (r"^build\.gradle(\.kts)?$", "maven", _gradle),
    (r"^pubspec\.yaml$", "pub", _pubspec),
)


def declared(files: DataFrame) -> DataFrame:
    """ecosystem, path, at, name, version, dev: every dependency that a manifest (path, text) declares, in its order.

    version is null where none is given; a requirement has the number only, other formats the text as it stands. A file
    that does not parse has none, nor has a null text. Every file is read by the one format of its name, in one scan."""
    name, at = F.substring_index("path", "/", -1), F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed([*enumerate(FORMATS)]):
        at = F.when(name.rlike(pattern), i).otherwise(at)
    text, read = F.coalesce("text", F.lit("")), F.when(F.lit(False), F.array().cast(_DEP))
    for i, (_, _, reader) in enumerate(FORMATS):
        read = read.when(F.col("_format") == i, reader(text).cast(_DEP))
    known = files.select("path", "text", at.alias("_format"))  # once a file, not a dependency
    rows = known.select("_format", "path", F.posexplode(read).alias("at", "d"))  # of no format: null, so no row
    rows = rows.withColumn("ecosystem", F.get(F.array(*[F.lit(e) for _, e, _ in FORMATS]), F.col("_format")))
    return rows.select("ecosystem", "path", "at", "d.*").filter("name <> ''")


def dependencies(files: DataFrame) -> DataFrame:
    """ecosystem, name, version, path, dev of manifests (path, text): of each (ecosystem, lower-case name) the first by path
    and place stays."""
    first = F.row_number().over(Window.partitionBy("ecosystem", F.lower("name")).orderBy("path", "at"))
    return declared(files).withColumn("_n", first).filter("_n = 1").select("ecosystem", "name", "version", "path", "dev")
