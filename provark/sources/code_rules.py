"""Rules over syntax trees of Python sources, in batches, and over lines of C sources; sources are parsed, never run."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provark.functions.text import lines_of
from provark.sources.flow_states import FlowStates, Mark, State, Value, dotted, either, marked, scopes
from provark.sources.taint import again

FINDING = "rule string, file string, line int, cwe string, severity string, snippet string"
#: Class and severity of each rule.
RULES = {
    "shell": ("CWE-78", "high"),
    "eval": ("CWE-95", "high"),
    "sql": ("CWE-89", "high"),
    "deserialisation": ("CWE-502", "high"),
    "tls": ("CWE-295", "medium"),
    "debug": ("CWE-489", "low"),
    "secret": ("CWE-798", "high"),
    "bind_all": ("CWE-605", "medium"),
    "template": ("CWE-79", "medium"),
    "index_write": ("CWE-1284", "high"),
    "path_join": ("CWE-22", "high"),
    "c_copy": ("CWE-787", "critical"),
}
#: C calls that copy without a length, what shows a bound, and the lines before and after a call that may show it.
UNBOUNDED = ("strcpy(", "strcat(", "sprintf(", "gets(")
BOUNDS = ("MIN(", "min(", "sizeof", "<=", ">=", "clamp", "CAP")
BEFORE, AFTER = 11, 4
#: Calls and parts that hold a path to its root, and words of a variable that names one.
CONTAINING, INSIDE = ("resolve", "relative_to", "samefile", "commonpath"), ("parents", "parts")
ROOTS = ("ROOT", "DIR", "PATH", "BASE")
#: Calls that only make another path of a path, and such as only look whether it is there.
PATHS, PROBES = ("Path", "PurePath", "PosixPath", "str", "fspath", "abspath", "normpath", "joinpath"), ("exists", "is_file", "is_dir")


def _true(n: ast.AST) -> bool:
    return isinstance(n, ast.Constant) and n.value is True


def _false(n: ast.AST) -> bool:
    return isinstance(n, ast.Constant) and n.value is False


def _built(n: ast.AST) -> bool:
    """A text put together at run time."""
    return isinstance(n, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in n.values) or isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Mod)) or isinstance(n, ast.Call) and dotted(n.func).endswith("format")


class Bounds(FlowStates):
    """What a function's parameters and counters come to, on flow states.

    An origin is a parameter, a step of a counter, or a path joined from a parameter. A write at a counter is open where
    some path from its last step asked nothing about it. A joined path is open where some path uses it, gives it away or
    drops it without a call or question that keeps it inside its root."""

    def __init__(self) -> None:
        super().__init__()
        self.writes: list[ast.AST] = []
        self.joins: dict[int, ast.AST] = {}
        self.open: set[int] = set()
        self.kept: set[int] = set()

    def begin(self, f: ast.FunctionDef | ast.AsyncFunctionDef) -> State:
        given = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, *filter(None, (f.args.vararg, f.args.kwarg))]
        return {a.arg: {("parameter", f.lineno): Mark()} for a in given if a.arg not in ("self", "cls")}

    def step(self, n: ast.AugAssign, old: Value, new: Value) -> Value:
        return {("step", n.lineno): Mark()} if isinstance(n.target, ast.Name) else either(old, new)

    def store(self, n: ast.Subscript | ast.Attribute, value: Value, state: State) -> None:
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Name):
            index = state.get(n.slice.id, {})
            if any(kind == "step" and not m.checked for (kind, _), m in index.items()):
                self.writes.append(n)
        if isinstance(n, ast.Attribute):
            self.leave(value)

    def binary(self, n: ast.BinOp, left: Value, right: Value) -> Value:
        if isinstance(n.op, ast.Div) and self._root(n.left) and any(kind == "parameter" for kind, _ in right):
            self.joins[n.lineno] = n
            return left | {("join", n.lineno): Mark()}
        return either(left, right)

    def _root(self, n: ast.AST) -> bool:
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Div):
            return self._root(n.left)
        if isinstance(n, ast.Call):
            return dotted(n.func).split(".")[-1] in PATHS
        return any(w in dotted(n).split(".")[-1].upper() for w in ROOTS)

    def call(self, n: ast.Call, arguments: list[Value], owner: Value, state: State) -> Value:
        value, name = either(*arguments, owner), dotted(n.func).split(".")[-1]
        if isinstance(n.func, ast.Attribute) and n.func.attr in CONTAINING:
            for x in ast.walk(n):
                if isinstance(x, ast.Name) and x.id in state:
                    state[x.id] = self._inside(state[x.id])
            return self._inside(value)
        if name not in PATHS and name not in PROBES:
            self.leave(value)
        return marked(value, hops=1)

    def check(self, question: ast.AST, state: State) -> State:
        state = super().check(question, state)
        if any(isinstance(x, ast.Attribute) and x.attr in INSIDE for x in ast.walk(question)):
            names = {x.id for x in ast.walk(question) if isinstance(x, ast.Name)} & state.keys()
            state = state | {n: self._inside(state[n]) for n in names}
        return state

    def _inside(self, value: Value) -> Value:
        self.kept |= {line for kind, line in value if kind == "join"}
        return marked(value, cleaned=True)

    def leave(self, value: Value) -> None:
        self.open |= {line for (kind, line), m in value.items() if kind == "join" and not m.cleaned}

    def open_joins(self) -> list[ast.AST]:
        return [n for line, n in self.joins.items() if line in self.open or line not in self.kept]


#: Texts that are cut into statements, and where: before a line that begins with a name, a decorator or a text.
_PLAIN, _STATEMENT = re.compile(r"[\t\n\x20-\x7e]*"), re.compile(r"(?m)^(?=[A-Za-z_@\"'])")


def findings(path: str, text: str) -> list[tuple]:
    """Findings of a file in order of line and rule; one that does not parse has none.

    Rules look at one statement of a file at a time, so a statement that comes again is parsed once a process. If every
    part parses by itself, the file is their sequence; else (an `else`, a decorator, a text over lines) it is read whole."""
    out, first = [], 0
    if _PLAIN.fullmatch(text) and "__future__" not in text:
        for part in _STATEMENT.split(text):
            found = _findings_in(part)
            if found is None:
                break
            out += [(rule, path, first + line, *RULES[rule], snippet) for rule, line, snippet in found]
            first += part.count("\n")
        else:
            return out
    return [(rule, path, line, *RULES[rule], snippet) for rule, line, snippet in _findings_in(text) or ()]


@again
def _findings_in(text: str) -> list[tuple[str, int, str]] | None:
    """Rule, line and snippet; None for what does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines, out = text.splitlines(), set()

    def hit(rule: str, n: ast.AST) -> None:
        out.add((rule, n.lineno, lines[n.lineno - 1].strip()[:200]))

    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            called, words = dotted(n.func), {k.arg: k.value for k in n.keywords}
            first = n.args[0] if n.args else None
            if called in ("os.system", "os.popen") and not isinstance(first, ast.Constant) or called.startswith("subprocess.") and _true(words.get("shell")):
                hit("shell", n)
            if called in ("eval", "exec") and not isinstance(first, ast.Constant):
                hit("eval", n)
            if called.endswith((".execute", ".executemany")) and first is not None and _built(first):
                hit("sql", n)
            if called in ("pickle.loads", "pickle.load", "marshal.loads") or called == "yaml.load" and "Loader" not in words:
                hit("deserialisation", n)
            if _false(words.get("verify")):
                hit("tls", n)
            if _true(words.get("debug")):
                hit("debug", n)
            if any(isinstance(v, ast.Constant) and v.value == "0.0.0.0" for v in [*n.args, *words.values()]):
                hit("bind_all", n)
            if called.endswith(("render_template_string", "Markup")) and first is not None and not isinstance(first, ast.Constant):
                hit("template", n)
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            names = " ".join(dotted(t).lower() for t in n.targets)
            value = n.value.value.lower()
            if any(w in names for w in ("password", "secret", "token", "api_key")) and len(value) >= 6 and not any(w in value for w in ("example", "changeme", "placeholder", "your")):
                hit("secret", n)
    for _, node, body in scopes(tree)[1:]:
        states = Bounds()
        try:
            states.block(body, states.begin(node))
        except RecursionError:
            continue
        for rule, places in (("index_write", states.writes), ("path_join", states.open_joins())):
            for place in places:
                hit(rule, place)
    return sorted(out, key=lambda f: (f[1], f[0]))


def c_findings(files: DataFrame) -> DataFrame:
    """Copies of C files (path, text) without a bound in sight, in built-in expressions: memcpy where no line from 11
    before to 4 after shows a bound, a call without a length (names that end like one too) always; the first of the two
    that a line holds decides. Comment lines are none."""
    lines = lines_of(F.coalesce("text", F.lit("")))
    holds = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))

    def place(line, i):
        first = F.greatest(i - BEFORE, F.lit(0))
        near = F.array_join(F.slice("lines", first + 1, i + AFTER + 1 - first), "\n")
        copied = F.when(F.contains(line, F.lit("memcpy(")), ~holds(near, BOUNDS)).otherwise(holds(line, UNBOUNDED))
        bare = F.trim(line)
        comment = F.startswith(bare, F.lit("//")) | F.startswith(bare, F.lit("*")) | F.startswith(bare, F.lit("/*"))
        return F.when(copied & ~comment, F.struct((i + 1).alias("line"), F.substring(bare, 1, 200).alias("snippet")))

    rows = files.filter("path like '%.c' or path like '%.h'").select("path", lines.alias("lines"))
    hits = rows.select("path", F.explode(F.array_compact(F.transform("lines", place))).alias("h"))
    cwe, severity = RULES["c_copy"]
    return hits.select(F.lit("c_copy").alias("rule"), F.col("path").alias("file"), "h.line", F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity"), "h.snippet")


def scan(files: DataFrame, skip_tests: bool = True) -> DataFrame:
    """Findings of Python and C files (path, text), those of test folders left out; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FINDING.split(", ")]
        for batch in batches:
            yield pd.DataFrame([f for p, t in zip(batch["path"], batch["text"]) for f in findings(p, t or "")], columns=names)

    own = files.filter(~F.concat(F.lit("/"), F.col("path")).contains("/tests/")) if skip_tests else files
    python = own.filter("path like '%.py' or path like '%.pyi'").select("path", "text").mapInPandas(run, FINDING)
    return python.unionByName(c_findings(own))
