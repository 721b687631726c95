"""Secret scan with multipart linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import materialise

#: Fixed patterns; a match counts if its measured part has the least length.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Equal to ACCESS and HEX with their least lengths: what they match is the whole rest of a run.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
#: Weak candidates, reported only beside complementary parts: opaque runs, and endpoints.
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SPAN = "array<struct<start:int,ord:int,end:int,good:boolean>>"


def _gather(items: Column, first: Column, at: str, one, to, keep: str = SPAN) -> Column:
    """Walks `items` from the state field `at`; collects one(at, item) and moves to to(at, item).

    What is collected goes into blocks of 256 that are put together at the end, so no long array grows by single copies."""

    def step(state: Column, item: Column) -> Column:
        full, new = F.size(state["out"]) >= 256, F.array(one(state[at], item))
        return F.struct(
            to(state[at], item).alias(at),
            F.when(full, new).otherwise(F.concat(state["out"], new)).alias("out"),
            F.when(full, F.concat(state["done"], F.array(state["out"]))).otherwise(state["done"]).alias("done"),
        )

    start = F.struct(first.alias(at), F.array().cast(keep).alias("out"), F.array().cast(f"array<{keep}>").alias("done"))
    return F.aggregate(items, start, step, lambda state: F.flatten(F.concat(state["done"], F.array(state["out"]))))


def spans(text: Column, pattern: str, ord_: int, good=None) -> Column:
    """Leftmost non-overlapping matches as (start, ord, end, good); code points, end exclusive.

    The matches and the pieces between them, in turn, make up the text: their lengths add up to positions."""
    pieces = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def one(at: Column, z: Column) -> Column:
        start = at + F.length(z["0"])
        keep = F.lit(True) if good is None else good(z["1"])
        return F.struct(start.cast("int").alias("start"), F.lit(ord_).alias("ord"), (start + F.length(z["1"])).cast("int").alias("end"), keep.alias("good"))

    # the last piece has no match behind it: its place is null, and so is its span's
    walked = _gather(pieces, F.lit(0), "at", one, lambda at, z: (at + F.length(z["0"]) + F.length(z["1"])).cast("int"))
    return F.filter(walked, lambda s: s["end"].isNotNull() & s["good"])


def joined(spans_: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(name, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, base and found (arrays of start, ord, end, good), and the `keep` columns.

    base: assignments, access identifiers and hexadecimal runs. found: base and the linked weak candidates.
    Weak candidates are opaque mixed runs (`secret`) and `endpoint`s that overlap no base span. One is reported only
    where a complementary part starts within `scope` code points of its own start: for a secret, an access
    identifier or an endpoint; for an endpoint, a base span of any kind or a secret. The parts meet in an
    interval join: bins of `scope` starts, each weak part against its own and both neighbouring bins. A bin
    holds at most `scope` parts of a kind, so no bin can be hot; overlaps are found in such bins too.

    Null text counts as empty. Rows with the same id stay apart. Empty tables give no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("body"), *keep)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    base = F.array_sort(F.concat(spans(F.col("body"), ASSIGN, 0, value), spans(F.col("body"), ACCESS_LONG, 1), spans(F.col("body"), HEX_LONG, 2)))
    weak = F.concat(spans(F.col("body"), OPAQUE, 3, _mixed), spans(F.col("body"), ENDPOINT, 4))
    stored = materialise(rows.withColumn("base", base).withColumn("weak", weak).drop("body"), "secret-spans")
    some = stored.filter((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    bins = lambda s: F.sequence(F.floor(F.col(f"{s}.start") / scope), F.floor((F.col(f"{s}.end") - 1) / scope))
    weaks, bases = some.select("row", F.explode("weak").alias("w")), some.select("row", F.explode("base").alias("b"))
    hit = (F.col("b.start") < F.col("w.end")) & (F.col("w.start") < F.col("b.end"))
    covered = weaks.withColumn("bin", F.explode(bins("w"))).join(bases.withColumn("bin", F.explode(bins("b"))), ["row", "bin"]).filter(hit).select("row", "w").distinct()
    free = materialise(weaks.join(covered, ["row", "w"], "left_anti"), "secret-weak")
    parts = free.withColumn("bin", F.floor(F.col("w.start") / scope))
    others = bases.select("row", F.col("b").alias("a")).union(free.select("row", F.col("w").alias("a")))
    others = others.withColumn("bin", F.explode(F.array(*[F.floor(F.col("a.start") / scope) + d for d in (-1, 0, 1)])))
    near = F.abs(F.col("a.start") - F.col("w.start")) <= scope
    of_secret, of_endpoint = F.col("a.ord").isin(1, 4), F.col("a.ord") < 4
    complements = ((F.col("w.ord") == 3) & of_secret) | ((F.col("w.ord") == 4) & of_endpoint)
    linked = parts.join(others, ["row", "bin"]).filter(near & complements).groupBy("row").agg(F.collect_set("w").alias("more"))
    out = stored.join(linked, "row", "left")
    found = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select("doc_id", "base", found.alias("found"), *keep)


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """The report of `secret_spans`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return secret_spans(docs, **options).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """The documents with every found span replaced by `mask`; overlapping spans share one mask. Columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text_col)]
    text = F.col(own)
    plain = docs.toDF(*names).withColumn("none", F.lit(None).cast("long"))
    found = secret_spans(plain, "none", own, scope, keep=tuple(names))

    def one(at: Column, s: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mask))).otherwise(F.lit(""))

    gaps = _gather(F.col("found"), F.lit(0), "at", one, lambda at, s: F.greatest(at, s["end"]), "array<string>")
    masked = F.concat(F.array_join(gaps, ""), F.substring(text, F.array_max(F.transform("found", lambda s: s["end"])) + 1, F.length(text)))
    out = F.when(F.size("found") > 0, masked).otherwise(text)
    return found.select(*[(out if c == own else F.col(c)).alias(name) for c, name in zip(names, docs.columns)])
