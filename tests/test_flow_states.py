"""Flow states against running the program: every decision of small random programs, both ways."""

import random

import pytest
from pyspark.sql import functions as F

from provark.plans.source_queries import flow_programs
from provark.sources import code_rules, taint

FIRST, CLEAN = 0x4E00, 0x400  # letters that repr() leaves as they are


class Paths:
    """Answers every question of a run by the next bit; counts upwards through all answers."""

    def __init__(self):
        self.bits, self.at = [], 0

    def ask(self):
        if self.at == len(self.bits):
            self.bits.append(False)
        self.at += 1
        return self.bits[self.at - 1]

    def next(self):
        self.at = 0
        while self.bits and self.bits[-1]:
            self.bits.pop()
        if self.bits:
            self.bits[-1] = True
        return bool(self.bits)


def run_all(text, call="f()", most=4000):
    """(source line, sink line) -> whether every run that got there was cleaned; values carry a letter of their origin."""
    import sys

    paths, hits = Paths(), {}
    line = lambda: sys._getframe(2).f_lineno

    def source(*_):
        return chr(FIRST + line())

    def sink(value, *_):
        at = line()
        for ch in str(value):
            if ord(ch) >= FIRST:
                key = ((ord(ch) - FIRST) % CLEAN, at)
                hits[key] = hits.get(key, True) and ord(ch) >= FIRST + CLEAN

    def clean(value):
        return "".join(chr(ord(c) + CLEAN) if FIRST <= ord(c) < FIRST + CLEAN else c for c in str(value))

    def go():
        if paths.ask():
            raise ValueError

    turns = {}

    def again():
        at = line()
        turns[at] = turns.get(at, 0) + 1
        return turns[at] < 4 and paths.ask()

    def some():
        for _ in range(3):
            if not paths.ask():
                return
            yield "y"

    class Held:
        def __enter__(self):
            return ""

        def __exit__(self, *_):
            return False

    code = compile(text, "p", "exec")
    for _ in range(most):
        turns.clear()
        given = {"input": source, "eval": sink, "exec": sink, "int": clean, "go": go, "some": some, "c": paths.ask, "again": again, "held": Held, "ok": lambda v: paths.ask()}
        try:
            exec(code, given)
            if call:
                eval(call, {**given, "__builtins__": {}})
        except ValueError:
            pass
        if not paths.next():
            return hits
    return None


def program(rnd):
    names, out = ["x", "y", "z"], ["def f():", *[f"    {n} = ''" for n in ("x", "y", "z")]]

    def value():
        n = rnd.choice(names)
        return rnd.choice(["input()", n, n, "'k'", f"int({n})", f"f'a{{{n}}}'", f"str({n}) + 'b'", f"(input() if c() else {n})", f"[v for v in {n}]", f"({n} := {value_of(n)})"])

    def value_of(n):
        return rnd.choice(["input()", "''", rnd.choice(names)])

    def block(depth, pad, loop, guarded):
        out.append(pad + "pass")
        for _ in range(rnd.randrange(1, 4)):
            if guarded:
                out.append(pad + "go()")
            kind = rnd.choice(["set", "set", "sink", "sink", "if", "else", "for", "while", "try", "with", "ann", "aug", "leave"])
            n = rnd.choice(names)
            inner = pad + "    "
            if depth == 0 and kind in ("if", "else", "for", "while", "try", "with"):
                kind = "set"
            if kind == "set":
                out.append(f"{pad}{n} = {value()}")
            elif kind == "ann":
                out.append(f"{pad}{n}: str = {value()}")
            elif kind == "aug":
                out.append(f"{pad}{n} = str({n})")
                out.append(f"{pad}{n} += str({value()})")
            elif kind == "sink":
                out.append(f"{pad}eval({n})")
            elif kind in ("if", "else"):
                out.append(f"{pad}if c():")
                block(depth - 1, inner, loop, guarded)
                if kind == "else":
                    out.append(f"{pad}else:")
                    block(depth - 1, inner, loop, guarded)
            elif kind == "for":
                out.append(f"{pad}for _ in some():")
                block(depth - 1, inner, True, guarded)
            elif kind == "while":
                out.append(f"{pad}while again():")
                block(depth - 1, inner, True, guarded)
            elif kind == "try":
                out.append(f"{pad}try:")
                block(depth - 1, inner, loop, True)
                out.append(f"{inner}go()")
                out.append(f"{pad}except ValueError:")
                block(depth - 1, inner, loop, guarded)
            elif kind == "with":
                out.append(f"{pad}with held() as {n}:")
                block(depth - 1, inner, loop, guarded)
            elif loop and kind == "leave":
                out.append(pad + rnd.choice(["break", "continue"]))
                return
        if guarded:
            out.append(pad + "go()")

    block(2, "    ", False, False)
    return "\n".join([*out, *[f"    eval({n})" for n in names]]) + "\n"


def test_random_programs_match_running_them():
    rnd, met, flows = random.Random(20), 0, 0
    for _ in range(900):
        text = program(rnd)
        if text.count("while") + text.count("for _") > 2 or (ran := run_all(text)) is None:
            continue
        found = {(f[3], f[5]): f[9] for f in taint.flows_of("p.py", text)}
        assert found.keys() == ran.keys(), text
        assert all(ran[k] or not v for k, v in found.items()), text  # "cleaned" is never said where a run was not
        met, flows = met + 1, flows + len(found)
    assert met > 250 and flows > 800


def test_shapes_of_the_query_match_running_them(spark):
    """The programs of the registered query, those in functions, by running all of their paths."""
    orders = spark.range(1500).select(F.col("id").alias("o_orderkey"))
    shapes, flows = set(), 0
    for r in flow_programs(orders).collect():
        if "shlex" in r.text or "while" in r.text or not r.text.startswith("def f") or "input()" not in r.text or "os." in r.text or "subprocess" in r.text or "cursor" in r.text:
            continue
        ran = run_all(r.text)
        found = {(f[3], f[5]): f[9] for f in taint.flows_of("p.py", r.text)}
        assert found.keys() == ran.keys(), r.text
        assert all(ran[k] or not v for k, v in found.items()), r.text
        shapes.add(r.text)
        flows += len(found)
    assert len(shapes) >= 40 and flows > 20
    assert flow_programs(orders).select("text").distinct().count() >= 200


@pytest.mark.parametrize(
    ("body", "checked"),
    [
        ("    if not ok(x):\n        return\n", True),
        ("    if ok(x):\n        pass\n", False),
        ("    if x not in ('a', 'b'):\n        x = 'a'\n", True),
        ("    if x in ('a', 'b'):\n        pass\n    else:\n        raise E\n", True),
        ("    assert ok(x) and c\n", True),
        ("    if c and ok(x):\n        y = 1\n", False),
        ("    while not ok(x):\n        x = input()\n", True),
        ("    if len(x) > 10:\n        return\n", True),
    ],
)
def test_what_counts_as_checked(body, checked):
    (flow, *_) = taint.flows_of("a.py", f"def f(c):\n    x = input()\n{body}    eval(x)\n")
    assert flow[8] is checked


def test_deep_code_and_odd_files():
    assert taint.flows_of("a.py", "x = " + "(" * 5000 + ")" * 5000) == []
    assert taint.flows_of("a.py", "x = \x00") == []
    deep = "x = input()\n" + "x = " + "+".join(["x"] * 800) + "\neval(x)\n"
    assert len(taint.flows_of("a.py", deep)) in (0, 1)
    assert code_rules.findings("a.py", "def f(:") == []


JOIN = "def f(root, name, c):\n    p = root / name\n"


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        (JOIN + "    return p\n", [2]),
        (JOIN + "    return p.resolve()\n", []),
        (JOIN + "    if root not in p.parents:\n        raise E\n    return open(p)\n", []),
        (JOIN + "    if c:\n        p.relative_to(root)\n    return open(p)\n", [2]),
        (JOIN + "    p.relative_to(root)\n    return open(p)\n", []),
        (JOIN + "    open(p)\n    p.relative_to(root)\n", [2]),
        (JOIN + "    if p.exists():\n        return p.resolve()\n", []),
        ("def f(self, name):\n    with open(self.base_dir / f'{name}.txt') as g:\n        return g\n", [2]),
        ("def f(self, a, n):\n    return (a + 1) / n\n", []),
        ("def f(root):\n    return root / 'fixed'\n", []),
    ],
)
def test_path_joins(text, lines):
    assert [f[2] for f in code_rules.findings("a.py", text) if f[0] == "path_join"] == lines


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        ("    for x in xs:\n        a[i] = x\n        i += 1\n", [4]),
        ("    while i < len(a):\n        a[i] = xs\n        i += 1\n", []),
        ("    for x in xs:\n        if i >= len(a):\n            break\n        a[i] = x\n        i += 1\n", []),
        ("    for x in xs:\n        i += 1\n        a[i] = x\n    return i < 3\n", [5]),
        ("    for x in xs:\n        a[i] = x\n", []),
        ("    for x in xs:\n        i += 1\n        assert i < 9\n        a[i] = x\n", []),
    ],
)
def test_counters(body, lines):
    text = "def g(a, xs):\n    i = 0\n" + body
    assert [f[2] for f in code_rules.findings("a.py", text) if f[0] == "index_write"] == lines


def test_statements_that_come_again_are_parsed_once(monkeypatch):
    """a file is its statements' sequence where each parses by itself; the same findings as of the whole file."""
    import ast
    import random

    from provark.plans.source_queries import _BLOCKS, _STATEMENTS
    from provark.sources import code_rules

    pick = random.Random(5)
    odd = ("if a:\n    eval(x)\nelse:\n    eval(y)\n", "@app.get('/')\ndef f(p):\n    return ROOT / p\n", 't = """\neval(z)\nb = 1\n"""\n', "x = [\neval(q)\n]\n", "a = 1 + \\\neval(b)\n", "# note\n\n", "def g(a):\n    # é\n    eval(a)\n", "from __future__ import annotations\n", "f(:\n", "eval(a); eval(b)\n")
    plain = [b + "\n" if not h else f"{h}\n    {b}\n" for h in _BLOCKS for b, _ in _STATEMENTS]
    for n in range(300):
        text = "".join(pick.choice(odd if pick.random() < (n % 3) / 4 else plain) for _ in range(pick.randrange(7)))
        whole = [(rule, "a.py", line, *code_rules.RULES[rule], snippet) for rule, line, snippet in code_rules._findings_in(text) or ()]
        assert code_rules.findings("a.py", text) == whole
    calls, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: calls.append(1) or parse(*a, **k))
    for k in range(50):
        code_rules.findings("a.py", "".join(pick.choice(plain) for _ in range(6)))
    assert len(calls) <= len(plain)
