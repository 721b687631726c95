"""Data flow inside functions and modules: Python sources are parsed, never run; rows of flows come out of batches."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

from provark.sources.flow_states import FlowStates, Mark, Origin, State, Value, dotted, either, marked, scopes

#: What brings data in (calls, and things read without a call), what runs it, and what cleans it.
SOURCES = {"input": "stdin", "request.args.get": "http", "request.form.get": "http", "request.get_json": "http", "os.environ.get": "env", "os.getenv": "env", "sys.stdin.read": "stdin", "open": "file"}
READ = {"request.args": "http", "request.form": "http", "request.json": "http", "request.cookies": "http", "request.headers": "http", "sys.argv": "argv", "os.environ": "env"}
SINKS = {"eval": "code", "exec": "code", "os.system": "command", "subprocess.run": "command", "subprocess.call": "command", "subprocess.Popen": "command", "cursor.execute": "sql", "pickle.loads": "deserialisation", "yaml.load": "deserialisation"}
CLEANERS = {"shlex.quote", "html.escape", "int", "float", "re.escape", "quote"}
FLOW = "path string, function string, source_kind string, source_line int, sink_kind string, sink_line int, hops int, interpolated boolean, validated boolean, sanitized boolean"


class Taint(FlowStates):
    """Origins are outside data; a flow is a sink's first argument that may hold any, once for each origin."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[tuple[Origin, str, int], Mark] = {}

    def source(self, n: ast.AST) -> str | None:
        return SOURCES.get(dotted(n.func)) if isinstance(n, ast.Call) else READ.get(dotted(n))

    def call(self, n: ast.Call, arguments: list[Value], owner: Value, state: State) -> Value:
        name = dotted(n.func)
        if name in SINKS:
            for origin, mark in next((a for a in arguments if a), {}).items():
                key = origin, SINKS[name], n.lineno
                self.found[key] = mark.joined(self.found.get(key, mark))
        if name in SOURCES:
            return {}
        given = marked(either(*arguments, owner), hops=1)
        if name in CLEANERS:
            given = marked(given, cleaned=True)
        return marked(given, interpolated=True) if isinstance(n.func, ast.Attribute) and n.func.attr == "format" else given


#: How many answers a Python process keeps for texts that come again, and the longest text that it keeps.
KEPT, LONGEST = 20_000, 2_000


def again(f: Callable[[str], Sequence]) -> Callable[[str], Sequence]:
    """f, asked once for a short text that a process meets again while it is kept; answers are not to be changed."""
    kept = lru_cache(KEPT)(f)
    return lambda text: kept(text) if len(text) <= LONGEST else f(text)


def flows_of(path: str, text: str) -> list[tuple]:
    """Flows of a file, of its module level too; one that does not parse has none, nor has a scope nested too deeply."""
    return [(path, *f) for f in _flows_in(text)]


@again
def _flows_in(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for name, _, body in scopes(tree):
        states = Taint()
        try:
            states.block(body, {})
        except RecursionError:
            continue
        for ((kind, line), sink, at), m in sorted(states.found.items(), key=lambda f: (f[0][2], f[0][0])):
            out.append((name, kind, line, sink, at, m.hops, m.interpolated, m.checked, m.cleaned))
    return out


def taint_flows(files: DataFrame) -> DataFrame:
    """Flows within functions of Python files (path, text); score them with flows.taint_confidence.

    A flow is given once for each source and sink line, over all paths between them: `hops` are the fewest, it is
    interpolated if any path does so, validated and sanitized only if all paths are. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FLOW.split(", ")]
        for batch in batches:
            yield pd.DataFrame([f for p, t in zip(batch["path"], batch["text"]) for f in flows_of(p, t or "")], columns=names)

    return files.filter("path like '%.py'").select("path", "text").mapInPandas(run, FLOW)


LITERAL = "array<struct<kind string, value string>>"


def literals_of(condition: str | None) -> list[tuple[str, str]]:
    """(kind, value) of the literals that a Python condition compares with, and `len` for each length that it asks."""
    return _literals_in(condition or "")


@again
def _literals_in(condition: str) -> list[tuple[str, str]]:
    try:
        tree = ast.parse(condition, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Compare):
            out += [(type(c.value).__name__, str(c.value)) for c in n.comparators if isinstance(c, ast.Constant) and isinstance(c.value, (int, float, str))]
        elif isinstance(n, ast.Call) and dotted(n.func).split(".")[-1] == "len":
            out.append(("len", ""))
    return out


def condition_literals(conditions: Column) -> Column:
    """literals_of, a batch at a time; null has none."""
    return pandas_udf(lambda batch: batch.map(literals_of), LITERAL)(conditions)
