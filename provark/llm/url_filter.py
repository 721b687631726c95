"""URL filter: a blocked Bloom filter of listed keys, then an exact join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provark.llm.common import ascii_lower, lookup, materialise

#: Rules (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
Rule = tuple[str, str, str]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, `www.`, query, fragment or closing slash."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, bits: int = 5) -> Column:
    """A 64-bit word with up to `bits` bits set, from a hash other than the block's."""
    h = F.xxhash64(F.lit("mask"), key)
    word = F.lit(0).cast("long")
    for i in range(bits):
        at = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return word


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows (block, word); at most `blocks` of them."""
    return keys.select(_block(F.col(key), blocks).alias("block"), _mask(F.col(key)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "canonical",
    bits_per_key: int = 16,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, listed, probes_passed.

    The longest fitting rule decides; without one, a listed canonical URL is blocked and any other allowed.
    Rules, which the caller holds as a list, are looked up in a constant map: for each shape (labels of the host,
    characters of the path) that they have, by the host's last labels and the head of the path.
    Distinct canonical URLs, counted on the map side, pass the blocked Bloom filter or not; possible hits go to an
    exact hash join with the listed ones, which removes false positives; pages look theirs up, where a URL may hold any
    share of all pages. Filter and list are broadcast only while their counted rows stay below `broadcast_bytes`;
    beyond that both joins are shuffled, over keys that occur once. probes_passed: 1 where the page's URL passed the filter.

    Null or malformed URLs have empty host and path and no rule; they are allowed. Rows with the same id stay
    apart. Empty pages, rules or list are fine. Other columns are ignored, whatever their names."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    entries = materialise(listed.select(F.col(listed_col).cast("string").alias("entry")).filter("entry is not null").distinct(), "url-list")
    n = entries.count()
    blocks = 1 << max(4, (n * bits_per_key // 64).bit_length())
    small = lambda df, size: F.broadcast(df) if size <= broadcast_bytes else df
    filter_rows = small(bloom_blocks(entries, "entry", blocks), blocks * 16)
    probes = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("size"))
    passed = probes.join(filter_rows, _block(F.col("key"), blocks) == F.col("block")).filter(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    exact = passed.join(small(entries, n * 256), F.col("key") == F.col("entry"), "left").select("key", "size", F.col("entry").isNotNull().alias("on_list"))
    known = lookup(rows, materialise(exact, "url-hits"), "key", "size")
    best = F.lit(None).cast("struct<n:int,rule:string,judged:string>")
    if rules:
        held = F.create_map(*[x for h, p, v in rules for x in (F.lit(f"{h}{p}"), F.struct(F.lit(len(h + p)).alias("n"), F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("judged")))])
        fit = lambda labels, length: F.when(
            (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= length),
            F.try_element_at(held, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))),
        )
        best = F.array_max(F.array_compact(F.array(*[fit(*shape) for shape in shapes])))
    out = known.withColumn("best", best).withColumn("listed", F.coalesce("on_list", F.lit(False)))
    verdict = F.coalesce(F.col("best.judged"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed", F.col("on_list").isNotNull().cast("long").alias("probes_passed"))
