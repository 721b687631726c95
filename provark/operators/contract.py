"""Contracts mined from traces: long metrics, profiles, proposed clauses, compiled predicates, verdicts."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provark.plans.storage import numbered, stored

METRICS = "seq long, scope string, case_id string, kind string, metric string, v_type string, v_num double, v_str string, v_bool boolean"


def flatten_trace(documents: DataFrame) -> DataFrame:
    """Long metrics of trace documents (case_id, calls array<struct<scope, metrics map<string,double>>>)."""
    calls = documents.select("case_id", F.posexplode("calls").alias("at", "call"))
    rows = calls.select("case_id", "at", F.col("call.scope").alias("scope"), F.explode("call.metrics").alias("metric", "v_num"))
    return rows.select(F.col("at").cast("long").alias("seq"), "scope", "case_id", F.lit("call").alias("kind"), "metric", F.lit("num").alias("v_type"), "v_num", F.lit(None).cast("string").alias("v_str"), F.lit(None).cast("boolean").alias("v_bool"))


def holdout(cases: DataFrame, ratio: float = 0.4, id_col: str = "case_id") -> DataFrame:
    """case_id, held: the sorted ids' every stride-th is held out; stride = max(2, round(1 / ratio)), so .4 takes
    every second. The number of an id comes from range-partitioned counts, not from one sorted task."""
    stride = max(2, round(1 / ratio))
    ids = cases.select(F.col(id_col).alias("case_id")).distinct()
    return numbered(ids, [F.col("case_id")], "_at").select("case_id", (F.col("_at") % stride == stride - 1).alias("held"))


def profiles(metrics: DataFrame, monotonic: tuple[str, ...] = ("ret_seq",), cap: int = 8, longest: int = 40) -> DataFrame:
    """scope, metric, kind, samples, low, high, values, all_true.

    All booleans: boolean. All numbers: monotonic (a named metric that never falls by seq), zero, length
    (names with `len`), else count. All strings, at most `cap` distinct of at most `longest`: enum. Mixed
    types make no profile. Booleans are told from numbers first. A set grows to cap + 1 values at most."""
    order = Window.partitionBy("scope", "metric").orderBy("seq")
    named = metrics.filter(F.col("metric").isin(*monotonic))  # only these need an order, the rest is a plain aggregate
    steps = named.withColumn("_up", F.coalesce(F.col("v_num") >= F.lag("v_num").over(order), F.lit(True))).groupBy("scope", "metric").agg(F.bool_and("_up").alias("_up"))
    grouped = metrics.groupBy("scope", "metric").agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("v_type") == "bool").alias("_b"),
        F.count_if(F.col("v_type") == "num").alias("_n"),
        F.count_if(F.col("v_type") == "str").alias("_s"),
        F.min("v_num").alias("low"),
        F.max("v_num").alias("high"),
        F.bool_and("v_bool").alias("all_true"),
        F.max(F.length("v_str")).alias("_long"),
    )
    texts = metrics.filter("v_type = 'str'").select("scope", "metric", "v_str").distinct()
    ranked = texts.withColumn("_r", F.row_number().over(Window.partitionBy("scope", "metric").orderBy("v_str"))).filter(F.col("_r") <= cap + 1)
    sets = ranked.groupBy("scope", "metric").agg(F.array_sort(F.collect_list("v_str")).alias("values"))
    every = lambda c: F.col(c) == F.col("samples")
    numeric = F.when(F.col("metric").isin(*monotonic) & F.col("_up"), "monotonic").when((F.col("low") == 0) & (F.col("high") == 0), "zero").when(F.contains("metric", F.lit("len")), "length").otherwise("count")
    kind = F.when(every("_b"), "boolean").when(every("_n"), numeric).when(every("_s") & (F.size("values") <= cap) & (F.col("_long") <= longest), "enum")
    out = grouped.join(steps, ["scope", "metric"], "left").join(sets, ["scope", "metric"], "left").withColumn("kind", kind).filter("kind is not null")
    return out.select("scope", "metric", "kind", "samples", "low", "high", F.when(F.col("kind") == "enum", F.col("values")).alias("values"), F.when(F.col("kind") == "boolean", F.col("all_true")).alias("all_true"))


def widen(base: DataFrame, counterexamples: DataFrame, cap: int = 8) -> DataFrame:
    """Profiles widened by counterexamples (scope, metric, v_num, v_str): the maximum rises, a zero becomes a
    count, an enum takes new values until the cap and is dropped beyond; a minimum never moves."""
    seen = counterexamples.groupBy("scope", "metric").agg(F.max("v_num").alias("_top"), F.collect_set("v_str").alias("_new"))
    wide = base.join(seen, ["scope", "metric"], "left")
    values = F.when(F.col("kind") == "enum", F.array_sort(F.array_union("values", F.coalesce("_new", F.array().cast("array<string>")))))
    out = wide.withColumns({"high": F.greatest("high", F.col("_top")), "values": values, "kind": F.when((F.col("kind") == "zero") & (F.col("_top") > 0), "count").otherwise(F.col("kind"))})
    return out.filter((F.col("kind") != "enum") | (F.size("values") <= cap)).drop("_top", "_new")


def propose(profiles_: DataFrame, cap: int = 200) -> DataFrame:
    """Clauses from profiles, without a model: scope, metric, kind, predicate; at most `cap` in order."""
    number = lambda c: F.regexp_replace(F.call_function("format_number", F.col(c), F.lit("0.######")), "^-0$", "0")
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.slice("values", 1, 12), lambda v: F.concat(F.lit("'"), F.regexp_replace(v, r"(['\\])", r"\\$1"), F.lit("'"))), ", "), F.lit("]"))
    predicate = (
        F.when(F.col("kind").isin("length", "count"), F.concat_ws(" ", "metric", F.lit("<="), number("high")))
        .when(F.col("kind") == "zero", F.concat_ws(" ", "metric", F.lit("== 0")))
        .when(F.col("kind") == "enum", F.concat_ws(" ", "metric", F.lit("in"), listed))
        .when(F.col("kind") == "boolean", F.concat_ws(" ", "metric", F.lit("=="), F.when(F.col("all_true"), "True").otherwise("False")))
        .when(F.col("kind") == "monotonic", F.concat_ws(" ", "metric", F.lit(">= 1")))
        .when(F.col("kind") == "containment", F.concat_ws(" ", "metric", F.lit("== 1")))
    )
    return profiles_.withColumn("predicate", predicate).filter("predicate is not null").orderBy("scope", "metric").limit(cap).select("scope", "metric", "kind", "predicate")


class Rejected(ValueError):
    """A predicate outside the grammar."""


#: The bounds of the grammar.
MOST_CHARACTERS, MOST_NODES = 400, 120


class Predicate:
    """A predicate over metrics, parsed as a Python expression and turned into a column; no text is evaluated.

    Allowed: names (metrics), numbers, strings, True and False, lists of constants, + - * / // %, unary - and
    not, and, or, chained comparisons, in and not in. At least one metric and one comparison."""

    def __init__(self, text: str):
        if len(text) > MOST_CHARACTERS:
            raise Rejected("too long")
        if "\n" in text or ";" in text:
            raise Rejected("several lines or statements")
        try:
            tree = ast.parse(text, mode="eval")
        except (SyntaxError, ValueError, RecursionError) as e:
            raise Rejected(str(e)) from e
        nodes = list(ast.walk(tree))
        if len(nodes) > MOST_NODES:
            raise Rejected("too many parts")
        self.text = text
        self.metrics = sorted({n.id for n in nodes if isinstance(n, ast.Name)})
        if not self.metrics:
            raise Rejected("no metric")
        if not any(isinstance(n, ast.Compare) for n in nodes):
            raise Rejected("no comparison")
        self._tree = tree.body
        self._check(self._tree)
        self.types = self._typed(self._tree)

    def _check(self, n: ast.AST) -> None:
        allowed = (ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple)
        for x in ast.walk(n):
            if not isinstance(x, allowed) or isinstance(x, ast.Constant) and not isinstance(x.value, (bool, int, float, str)):
                raise Rejected(type(x).__name__)

    def _typed(self, tree: ast.AST) -> dict[str, str]:
        """num, str or bool of each metric, by what it is compared with or used as; num where nothing tells."""
        types: dict[str, str] = {}
        tell = lambda n, t: types.setdefault(n.id, t) if isinstance(n, ast.Name) and t else None
        kind = lambda n: {bool: "bool", str: "str"}.get(type(n.value)) if isinstance(n, ast.Constant) else None
        for n in ast.walk(tree):
            if isinstance(n, ast.Compare):
                sides = [n.left, *n.comparators]
                for a, b in zip(sides, sides[1:]):
                    told = next((kind(x) for x in b.elts if kind(x)), None) if isinstance(b, (ast.List, ast.Tuple)) else kind(b)
                    tell(a, told)
                    tell(b, kind(a))
            elif isinstance(n, ast.BoolOp):
                for x in n.values:
                    tell(x, "bool")
            elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
                tell(n.operand, "bool")
        return types

    def type_of(self, metric: str) -> str:
        return self.types.get(metric, "num")

    def column(self, values: dict[str, Column]) -> Column:
        """The predicate over the given columns, each of its metric's type (`type_of`); null where a metric is missing
        or an operation fails. Values of different types are unequal, and have no order."""
        missing = [m for m in self.metrics if m not in values]
        if missing:
            return F.lit(None).cast("boolean")
        known = F.lit(True)
        for m in self.metrics:
            known &= values[m].isNotNull()
        return F.when(known, self._truth(self._tree, values))

    def _kind(self, n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return self.type_of(n.id)
        if isinstance(n, ast.Constant):
            return "bool" if isinstance(n.value, bool) else "str" if isinstance(n.value, str) else "num"
        if isinstance(n, (ast.Compare, ast.BoolOp)) or isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return "bool"
        return "num"

    def _truth(self, n: ast.AST, v: dict[str, Column]) -> Column:
        """A value as a condition: numbers other than 0 and texts that are not empty hold."""
        own, kind = self._of(n, v), self._kind(n)
        return own if kind == "bool" else own != 0.0 if kind == "num" else F.length(own) > 0

    def _number(self, n: ast.AST, v: dict[str, Column]) -> Column:
        kind = self._kind(n)
        return F.lit(None).cast("double") if kind == "str" else self._of(n, v).cast("double")

    def _of(self, n: ast.AST, v: dict[str, Column]) -> Column:
        if isinstance(n, ast.Name):
            return v[n.id]
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value) if isinstance(n.value, int) and not isinstance(n.value, bool) else n.value)
        if isinstance(n, ast.UnaryOp):
            return ~self._truth(n.operand, v) if isinstance(n.op, ast.Not) else -self._number(n.operand, v)
        if isinstance(n, ast.BoolOp):
            out = self._truth(n.values[0], v)
            for x in n.values[1:]:
                out = out & self._truth(x, v) if isinstance(n.op, ast.And) else out | self._truth(x, v)
            return out
        if isinstance(n, ast.BinOp):
            a, b = self._number(n.left, v), self._number(n.right, v)
            quotient = F.floor(F.try_divide(a, b)).cast("double")
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.FloorDiv: lambda: quotient, ast.Mod: lambda: a - b * quotient}[type(n.op)]()
        if isinstance(n, ast.Compare):
            out, left = None, n.left
            for op, right in zip(n.ops, n.comparators):
                one = self._compared(left, op, right, v)
                out = one if out is None else out & one
                left = right
            return out
        raise Rejected(type(n).__name__)

    def _compared(self, left: ast.AST, op: ast.cmpop, right: ast.AST, v: dict[str, Column]) -> Column:
        kind = self._kind(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple)):
                raise Rejected("in needs a list")
            same = [self._of(x, v) for x in right.elts if self._kind(x) == kind]
            found = self._of(left, v).isin(*same) if same else F.lit(False)
            return ~found if isinstance(op, ast.NotIn) else found
        other = self._kind(right)
        if "str" in (kind, other) and kind != other:
            return F.lit(isinstance(op, ast.NotEq)) if isinstance(op, (ast.Eq, ast.NotEq)) else F.lit(None).cast("boolean")
        a, b = (self._of(left, v), self._of(right, v)) if kind == other else (self._number(left, v), self._number(right, v))
        return {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]


def scope_matches(clause: Column, record: Column) -> Column:
    """`*` or nothing, the same, `mod:*` and `…*` as prefixes, or a bare function name."""
    return (
        F.coalesce(clause.isin("*", ""), F.lit(True))
        | (clause == record)
        | (clause.endswith("*") & F.startswith(record, F.substring(clause, 1, F.length(clause) - 1)))
        | (~F.contains(clause, F.lit(":")) & (clause == F.substring_index(record, ":", -1)))
    )


def _metric(records: DataFrame, name: str, kind: str) -> Column:
    """A metric of its type; a flag counts as 1 or 0 where a number is wanted."""
    at = lambda c, t: F.try_element_at(c, F.lit(name)) if c in records.columns else F.lit(None).cast(t)
    flag = at("flags", "boolean")
    return {"num": lambda: F.coalesce(at("metrics", "double"), flag.cast("double")), "str": lambda: at("texts", "string"), "bool": lambda: flag}[kind]()


def verdicts(records: DataFrame, clauses: list[tuple[str, str, str]], mode: str = "full") -> DataFrame:
    """clause_id, scope, applicable, passed, failed, status, counterexample (case_id) over wide records
    (seq, scope, case_id, metrics map<string,double> and, where there are any, texts map<string,string> and flags
    map<string,boolean>). clauses: (clause_id, scope, predicate).

    A record meets the clauses of the scopes that match it, not all of them.

    mode full counts everything; mode first stops at the first failure: passes before it, at most 1 failure.
    Never applicable: UNSUPPORTED, which is not false. No clauses: an empty table."""
    if not clauses:
        return records.sparkSession.createDataFrame([], "clause_id string, scope string, applicable long, passed long, failed long, counterexample string, status string")
    own: dict[str, list[Column]] = {}
    taken: dict[tuple[str, str], str] = {}  # a metric that many clauses name is looked up once a record
    for clause_id, scope, text in clauses:
        predicate = Predicate(text)
        value = predicate.column({m: F.col(taken.setdefault((m, predicate.type_of(m)), f"_m{len(taken)}")) for m in predicate.metrics})
        own.setdefault(scope, []).append(F.struct(F.lit(clause_id).alias("clause_id"), F.lit(scope).alias("clause_scope"), value.alias("ok")))
    none = F.array().cast("array<struct<clause_id: string, clause_scope: string, ok: boolean>>")
    met = [F.when(scope_matches(F.lit(scope), F.col("scope")), F.array(*parts)).otherwise(none) for scope, parts in own.items()]
    every = F.array(*[F.struct(F.lit(c).alias("clause_id"), F.lit(s).alias("clause_scope"), F.lit(None).cast("boolean").alias("ok")) for c, s, _ in clauses])
    first_row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a partition: it has every clause, so that those of no scope are seen
    flat = records.select("seq", "scope", "case_id", *[_metric(records, m, t).alias(name) for (m, t), name in taken.items()])
    rows = flat.select("seq", "case_id", F.concat(*met, F.when(first_row, every).otherwise(none)).alias("v"))
    rows = rows.select("seq", "case_id", F.explode("v").alias("v")).select("seq", "case_id", "v.*")
    failed = F.col("ok") == F.lit(False)
    if mode == "first":
        first = rows.filter(failed).groupBy("clause_id", "clause_scope").agg(F.min("seq").alias("_f"))  # a row a clause
        rows = rows.join(F.broadcast(first), ["clause_id", "clause_scope"], "left").filter("_f is null or seq <= _f")
    out = rows.groupBy("clause_id", F.col("clause_scope").alias("scope")).agg(
        F.count_if(F.col("ok").isNotNull()).alias("applicable"),
        F.count_if("ok").alias("passed"),
        F.count_if(failed).alias("failed"),
        F.min_by("case_id", F.when(failed, F.col("seq"))).alias("counterexample"),
    )
    status = F.when(F.col("applicable") == 0, "UNSUPPORTED").when(F.col("failed") > 0, "FALSIFIED").otherwise("SURVIVING")
    return out.withColumn("status", status)


def summary(verdicts_: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return verdicts_.agg(F.count("*").alias("total"), of("SURVIVING"), of("FALSIFIED"), of("UNSUPPORTED"))


def recheck(verdicts_: DataFrame) -> DataFrame:
    """One row: held, broken, unsupported, passed; any broken or unsupported clause fails, none at all passes with a gap."""
    out = verdicts_.agg(F.count_if(F.col("status") == "SURVIVING").alias("held"), F.count_if(F.col("status") == "FALSIFIED").alias("broken"), F.count_if(F.col("status") == "UNSUPPORTED").alias("unsupported"))
    return out.withColumns({"passed": (F.col("broken") == 0) & (F.col("unsupported") == 0), "coverage_gap": F.col("held") + F.col("broken") + F.col("unsupported") == 0})


def in_radius(clauses: DataFrame, touched: DataFrame) -> DataFrame:
    """Surviving clauses whose scope a change touches; all surviving ones where none is."""
    surviving = clauses.filter("status = 'SURVIVING'")
    hit = surviving.join(touched.select("scope").distinct(), "scope", "left_semi")
    return hit if hit.head(1) else surviving


def falsify(base: DataFrame, records: DataFrame, metrics: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Profiles and last verdicts after at most `rounds` of proposing, checking on records and widening by
    the metrics of falsified clauses. Only clause texts, at most 200, reach the driver. Profiles, a row a scope and
    metric, are stored a round, so that metrics are read once for each."""
    current, last = stored(base, "profiles"), None
    for _ in range(rounds):
        texts = [(f"{r.scope}/{r.metric}", r.scope, r.predicate) for r in propose(current).collect()]
        if not texts:
            break
        last = verdicts(records, texts)
        broken = [r.clause_id for r in last.filter("status = 'FALSIFIED'").select("clause_id").collect()]
        if not broken:
            break
        key = F.concat_ws("/", "scope", "metric")
        current = stored(widen(current, metrics.filter(key.isin(*broken))), "profiles")
    return current, last
