"""Rule sets over lines of text: one projection matches all rules, no rule is ever crossed with all lines."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.functions.text import lines_of
from provark.plans.storage import numbered

SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    kind: str
    pattern: str
    languages: tuple[str, ...] = ("*",)
    cwe: str = ""
    severity: str = "medium"
    confidence: float = 0.5
    unless: str = ""
    #: Literals of which a line that matches holds one: tried before the pattern; none means any line is tried.
    literals: tuple[str, ...] = ()


#: An own small rule set over prose and pages; code rules come as an extension of the same form.
TEXT_RULES = [
    Rule("email", "source", "personal", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", severity="medium", confidence=0.8, literals=("@",)),
    Rule("ip", "source", "network", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", severity="low", confidence=0.6, literals=(".",)),
    Rule("phone", "source", "personal", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", severity="medium", confidence=0.9, literals=("+1 (",)),
    Rule("secret", "sink", "credential", r"(password|token|secret|api_key)[ ]*[:=]", cwe="CWE-798", severity="high", confidence=0.7, unless=r"(example|placeholder|changeme)", literals=("password", "token", "secret", "api_key")),
    Rule("access_key", "sink", "credential", r"AKIA[A-Z0-9]{16}", cwe="CWE-798", severity="critical", confidence=0.95, literals=("AKIA",)),
    Rule("license", "control", "license", r"(MIT License|Apache License|GNU General Public License|All rights reserved)", severity="info", confidence=0.5, literals=("License", "All rights reserved")),
    Rule("spanish_only", "control", "language", r"[ñó]", languages=("es",), severity="info", confidence=0.3),
]


def override(base: list[Rule], extension: list[Rule]) -> list[Rule]:
    """The base in order, replaced by id; new rules follow. A rule whose pattern does not compile is refused."""
    good = {}
    for rule in extension:
        try:
            re.compile(rule.pattern)
            good[rule.id] = rule
        except re.error:
            continue
    out = [good.pop(r.id, r) for r in base]
    return out + list(good.values())


def override_rows(base: DataFrame, extension: DataFrame) -> DataFrame:
    """The same over rule tables: an extension's rows replace those of the same id."""
    return base.join(extension.select("id"), "id", "left_anti").unionByName(extension)


def explode_lines(docs: DataFrame, id_col: str, text_col: str, comments: tuple[str, ...] = ("#", "//")) -> DataFrame:
    """id, line (from 1), content: lines that are neither blank nor comments, with their own numbers."""
    rows = docs.select(F.col(id_col).alias("id"), *[c for c in docs.columns if c == "lang"], F.posexplode(lines_of(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "content"))
    live = F.trim("content") != ""
    for c in comments:
        live &= ~F.ltrim("content").startswith(c)
    return rows.filter(live).select("id", *[c for c in rows.columns if c == "lang"], (F.col("at") + 1).alias("line"), "content")


def applies(rule: Rule, language: Column) -> Column:
    return F.lit(True) if "*" in rule.languages else F.coalesce(language.isin(*rule.languages), F.lit(False))


def _needed(tree) -> tuple[str, ...]:
    """Of a parsed pattern: literals of which a match holds one, the set whose shortest is longest; empty if none is sure."""
    best, run = (), ""
    sets = []
    for op, arg in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            sets.append((run,))
            run = ""
        if name == "SUBPATTERN":
            sets.append(_needed(arg[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            sets.append(_needed(arg[-1]))
        elif name == "ATOMIC_GROUP":
            sets.append(_needed(arg))
        elif name == "BRANCH":
            every = [_needed(x) for x in arg[1]]
            sets.append(tuple(sorted({x for e in every for x in e})) if all(every) else ())
    for s in sets:
        if s and min(map(len, s)) > min(map(len, best), default=0):
            best = s
    return best


def needed_literals(rule: Rule) -> tuple[str, ...]:
    """Lower-case literals of which every line that matches the rule holds one; none where the pattern does not say. Those
    that the rule states itself come first. A pattern that Python cannot parse says nothing."""
    if rule.literals and all(x.isascii() for x in rule.literals):
        return tuple(sorted({x.lower() for x in rule.literals}))
    try:
        parsed = re._parser.parse(rule.pattern)
    except (re.error, OverflowError, RecursionError):
        return ()
    return () if parsed.state.flags & re.VERBOSE else _needed(parsed)


def _trie(words: list[str]) -> str:
    """A pattern of all words that branches letter by letter and takes the longest."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if "" in words else "")


def match_rules(lines: DataFrame, rules: list[Rule], language: str | None = None) -> DataFrame:
    """A row for each line and rule that matches it: the line's columns, rule_id, category, kind, cwe,
    severity, confidence, snippet (what matched first).

    Literals that a match must hold are taken out of the patterns once. One pass over a line, by a pattern that branches
    letter by letter, finds which of them it holds; only rules of those, and rules without any, are tried on it. So a line
    costs much the same for ten rules and for hundreds. The rules themselves are a constant."""
    owners: dict[str, set[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if needed := needed_literals(r):
            for x in needed:
                owners.setdefault(x, set()).add(i)
        else:
            always.append(i)
    # the longest literal at a place is found; those that it begins with are there too
    held = {x: sorted(set().union(*[o for y, o in owners.items() if x.startswith(y)])) for x in owners}
    tried = F.array(*map(F.lit, always)).cast("array<int>")
    if held:
        told = F.from_json(F.lit(json.dumps(held)), "map<string, array<int>>")
        there = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(f"(?=({_trie(sorted(held))}))"), F.lit(1)))
        tried = F.array_distinct(F.concat(tried, F.flatten(F.transform(there, lambda x: told[x]))))
    if not rules:
        return lines.limit(0).selectExpr("*", "'' rule_id", "'' category", "'' kind", "'' cwe", "'' severity", "0d confidence", "'' snippet", "0 rule_seq")
    given = [{"rule_id": r.id, "category": r.category, "kind": r.kind, "cwe": r.cwe, "severity": r.severity, "confidence": r.confidence, "pattern": r.pattern, "unless": r.unless, "spoken": r.languages, "rule_seq": i} for i, r in enumerate(rules)]
    fields = "rule_id string, category string, kind string, cwe string, severity string, confidence double, pattern string, unless string, spoken array<string>, rule_seq int"
    table = F.from_json(F.lit(json.dumps(given)), f"array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>")
    rows = lines.select("*", F.explode(tried).alias("_i")).withColumn("_r", F.get(table, F.col("_i")))
    r = F.col("_r")
    found = F.rlike("content", r["pattern"]) & ((r["unless"] == "") | ~F.rlike("content", r["unless"]))
    if language:
        found &= F.array_contains(r["spoken"], "*") | F.coalesce(F.array_contains(r["spoken"], F.col(language)), F.lit(False))
    snippet = F.call_function("regexp_extract", F.col("content"), r["pattern"], F.lit(0))
    told = ["rule_id", "category", "kind", "cwe", "severity", "confidence"]
    return rows.filter(found).select(*lines.columns, *[r[c].alias(c) for c in told], snippet.alias("snippet"), r["rule_seq"].alias("rule_seq"))


def dedup_hits(hits: DataFrame, keys: tuple[str, ...] = ("category", "id", "line")) -> DataFrame:
    """One hit a key: a strictly better confidence replaces, ties keep the first rule."""
    best = F.max_by(F.struct(*[c for c in hits.columns if c not in keys]), F.struct("confidence", -F.col("rule_seq")))
    return hits.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def union_engines(findings: list[DataFrame], keys: tuple[str, ...] = ("rule", "file", "line")) -> DataFrame:
    """Findings of several engines, the preferred first: one a key."""
    every = None
    for i, f in enumerate(findings):
        f = f.withColumn("_engine", F.lit(i))
        every = f if every is None else every.unionByName(f)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_engine"))
    return every.withColumn("_n", first).filter("_n = 1").drop("_n", "_engine")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.lower(severity)], F.lit(0))


def setting_hits(lines: DataFrame) -> DataFrame:
    """`key = value` settings of lines, except where the value is a placeholder."""
    key, value = F.regexp_extract("content", r"([A-Za-z_]+) *[:=] *\"?([^\" ]+)", 1), F.regexp_extract("content", r"([A-Za-z_]+) *[:=] *\"?([^\" ]+)", 2)
    rows = lines.select("id", "line", F.lower(key).alias("setting"), value.alias("value")).filter("setting <> ''")
    return rows.filter(~F.lower("value").rlike("^(changeme|placeholder|example|xxx+|your[-_].*)$"))


__all__ = ["Rule", "TEXT_RULES", "applies", "dedup_hits", "explode_lines", "match_rules", "override", "override_rows", "replace", "setting_hits", "severity_rank", "union_engines"]


def scan_order(findings: DataFrame) -> DataFrame:
    """findings with their place, from 0, by file, line and rule. Nulls come first; equal rows follow each other in any order."""
    return numbered(findings, [F.col("file"), F.col("line"), F.col("rule")], "at")
