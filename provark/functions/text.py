"""Column functions over text: paths, identifiers, lines, markers, formats. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's splitlines takes for line ends.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def dirname(path: Column) -> Column:
    """The part before the last slash; `.` without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def last_identifier(call: Column) -> Column:
    """`a.b.c(x)` -> `c`."""
    return F.trim(F.substring_index(F.substring_index(call, "(", 1), ".", -1))


def split_location(location: Column) -> tuple[Column, Column]:
    """`file:line` split from the right; the line is null where it is no number."""
    file = F.regexp_extract(location, r"^(.*?)(?::([0-9]+))?$", 1)
    return file, F.regexp_extract(location, r":([0-9]+)$", 1).try_cast("int")


def slashes(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def canonical_uid(file: Column, name: Column, kind: Column) -> Column:
    """One id for what several providers call by different ids: `file` for files, else `file:name`."""
    return F.when(F.lower(kind) == "file", slashes(file)).otherwise(F.concat_ws(":", slashes(file), name))


def safe_charset(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._/@:+-]*$")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of `characters` a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def clean_metric(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", "_")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def markers(text: Column, needles: dict[str, str]) -> Column:
    """Labels of the needles that a text contains: distinct, in the order given."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(label)) for n, label in needles.items()])))


def frames(trace: Column) -> Column:
    """Stack frames `File "x", line n, in f` as structs of file, line and function, outermost first."""
    pattern = F.lit(r'File "([^"]+)", line ([0-9]+), in ([^\s]+)')
    part = lambda i: F.regexp_extract_all(trace, pattern, F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda s: F.struct(s["a"].alias("file"), s["b"].cast("int").alias("line"), s["c"].alias("function")))


def crash_site(trace: Column, root: str = "") -> Column:
    """The last frame inside the project, `file:line`; null without one."""
    inner = F.filter(frames(trace), lambda s: s["file"].startswith(root))
    last = F.try_element_at(inner, F.lit(-1))
    return F.when(F.size(inner) > 0, F.concat_ws(":", last["file"], last["line"].cast("string")))


def route(decorator: Column) -> tuple[Column, Column]:
    """HTTP method and path of a route decorator; the method is GET where none is named."""
    method = F.upper(F.regexp_extract(decorator, r"\.(get|post|put|delete|patch|head|options)\(", 1))
    path = F.regexp_extract(decorator, r"""\(\s*["']([^"']*)["']""", 1)
    return F.when(method != "", method).otherwise(F.lit("GET")), path


def boundary_values(literals: Column, cap: int = 12) -> Column:
    """Each literal's neighbours and itself: distinct, in order, at most `cap`."""
    around = F.flatten(F.transform(literals, lambda v: F.array(v - 1, v, v + 1)))
    return F.slice(F.array_distinct(around), 1, cap)


def boundary_inputs(literals: Column, cap: int = 12) -> Column:
    """Inputs around the literals (kind, value) of a condition: a whole number, both neighbours; a fraction and one more and
    less; a text, its capitals, one letter more, and nothing; true and false for a flag; for `len` texts of 0, 1, 64 and
    1024 letters. As texts: distinct, in order, at most `cap`."""
    v = lambda x: x["value"]
    whole = lambda x: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (v(x).cast("long") + d).cast("string"))
    part = lambda x: F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: (v(x).cast("double") + d).cast("string"))
    told = lambda x: (
        F.when(x["kind"] == "int", whole(x))
        .when(x["kind"] == "float", part(x))
        .when(x["kind"] == "str", F.array(v(x), F.upper(v(x)), F.concat(v(x), F.lit("x")), F.lit("")))
        .when(x["kind"] == "bool", F.array(F.lit("true"), F.lit("false")))
        .when(x["kind"] == "len", F.array(F.lit(""), F.lit("x"), F.repeat(F.lit("x"), 64), F.repeat(F.lit("x"), 1024)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.slice(F.array_distinct(F.flatten(F.transform(literals, told))), 1, cap)


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps; the second wins where they share a key."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def clock(ms: Column) -> Column:
    """Milliseconds as mm:ss."""
    seconds = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.round(n / 1024**2, 1).cast("string"), F.lit(" MB")))
    )


def normalised_path(path: Column) -> Column:
    """A bounded set of labels: UUIDs become {id}, numbers {n}."""
    uuid = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    step = lambda p: F.when(p.rlike(uuid), F.lit("{id}")).when(p.rlike(r"^[0-9]+$"), F.lit("{n}")).otherwise(p)
    return F.array_join(F.transform(F.split(path, "/"), step), "/")


def redact_map(fields: Column, exact: tuple[str, ...] = ("password", "secret", "token", "authorization", "cookie"), inside: tuple[str, ...] = ("api_key", "apikey", "private_key")) -> Column:
    """Values of fields whose name has a secret segment (between _ . -) or part are masked."""
    secret = lambda k: F.arrays_overlap(F.split(F.lower(k), r"[_.\-]"), F.array(*map(F.lit, exact))) | F.lower(k).rlike("|".join(inside))
    return F.transform_values(fields, lambda k, v: F.when(secret(k), F.lit("***")).otherwise(v))


def glob_to_regex(pattern: str) -> str:
    """`**` crosses slashes, `*` and `?` do not; anchored."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\.^$|()[]{}+" else c
            i += 1
    return f"^{out}$"


def digest(*columns: Column) -> Column:
    """A canonical digest of values: nulls and separators are told apart, so different rows differ."""
    escaped = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.regexp_replace(c.cast("string"), "%", "%25"), "\\|", "%7C")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *escaped), 256)


def lines_of(text: Column) -> Column:
    """Lines as splitlines gives them: no empty last one."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def minified_reason(path: Column, text: Column) -> Column:
    """Why a file counts as generated: bundle name, a line over 2000, or over 20 lines of 400 on average; else null."""
    lines = F.split(text, "\n", -1)
    return (
        F.when(path.rlike(r"(?i)(\.min\.|bundle|vendor)"), F.lit("bundle name"))
        .when(F.array_max(F.transform(lines, F.length)) > 2000, F.lit("long line"))
        .when((F.size(lines) > 20) & (F.length(text) / F.size(lines) > 400), F.lit("dense lines"))
    )
