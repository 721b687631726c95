"""How the driver's tables stand in for the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provark.operators import rules
from provark.plans.storage import table

EDGE = "src string, dst string, kind string, provenance array<string>, confidence double, seq long"


def key_edges(spark: SparkSession, d: str) -> DataFrame:
    """Raw edges of two providers over the keys: region, nation, customer, order, and supplier.

    `scan` (name matches, .55) has those whose child key is no multiple of 3, `runtime` (1.0) the even ones."""
    t = lambda n: table(spark, d, n)
    uid = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    parts = [
        t("nation").select(uid("region", "n_regionkey").alias("src"), uid("nation", "n_nationkey").alias("dst"), F.lit("HAS_NATION").alias("kind"), F.col("n_nationkey").cast("long").alias("seq")),
        t("customer").select(uid("nation", "c_nationkey").alias("src"), uid("customer", "c_custkey").alias("dst"), F.lit("HAS_CUSTOMER").alias("kind"), F.col("c_custkey").alias("seq")),
        t("orders").select(uid("customer", "o_custkey").alias("src"), uid("order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("kind"), F.col("o_orderkey").alias("seq")),
        t("supplier").select(uid("nation", "s_nationkey").alias("src"), uid("supplier", "s_suppkey").alias("dst"), F.lit("HAS_SUPPLIER").alias("kind"), F.col("s_suppkey").alias("seq")),
    ]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    one = lambda cond, p, c: every.filter(cond).select("src", "dst", "kind", F.array(F.lit(p)).alias("provenance"), F.lit(c).alias("confidence"), "seq")
    return one("seq % 3 <> 0", "scan", 0.55).union(one("seq % 2 = 0", "runtime", 1.0)).union(one("seq % 3 = 0 and seq % 2 <> 0", "parse", 0.35))


#: The same edges in SQL, merged.
EDGES_SQL = """
raw AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'HAS_NATION' AS kind, n_nationkey::BIGINT AS seq FROM nation UNION ALL
  SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'HAS_CUSTOMER', c_custkey FROM customer UNION ALL
  SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED', o_orderkey FROM orders UNION ALL
  SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'HAS_SUPPLIER', s_suppkey FROM supplier),
given AS (
  SELECT src, dst, kind, seq, 'scan' AS provider, 0.55 AS confidence FROM raw WHERE seq % 3 <> 0 UNION ALL
  SELECT src, dst, kind, seq, 'runtime', 1.0 FROM raw WHERE seq % 2 = 0 UNION ALL
  SELECT src, dst, kind, seq, 'parse', 0.35 FROM raw WHERE seq % 3 = 0 AND seq % 2 <> 0),
edges AS (
  SELECT src, kind, dst, list_sort(list(DISTINCT provider)) AS provenance,
         (CASE WHEN count(DISTINCT provider) > 1 THEN 1.0 ELSE max(confidence) END)::DOUBLE AS confidence, min(seq) AS seq,
         bool_or(provider IN ('gitnexus', 'runtime', 'semgrep')) AS resolved
  FROM given GROUP BY src, kind, dst)"""


def key_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    own = lambda df, kind, key, name, file: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("uid"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat(F.lit(f"{file}/"), F.lit(kind), F.lit("/"), (F.col(key) % 10).cast("string")).alias("file"), F.col(key).cast("long").alias("seq"))
    return own(t("region"), "region", "r_regionkey", "r_name", "geo").union(own(t("nation"), "nation", "n_nationkey", "n_name", "geo")).union(own(t("customer"), "customer", "c_custkey", "c_name", "crm")).union(own(t("supplier"), "supplier", "s_suppkey", "s_name", "crm"))


NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS uid, 'region' AS kind, r_name AS name, 'geo/region/' || r_regionkey % 10 AS file, r_regionkey::BIGINT AS seq FROM region UNION ALL
  SELECT 'nation:' || n_nationkey, 'nation', n_name, 'geo/nation/' || n_nationkey % 10, n_nationkey FROM nation UNION ALL
  SELECT 'customer:' || c_custkey, 'customer', c_name, 'crm/customer/' || c_custkey % 10, c_custkey FROM customer UNION ALL
  SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'crm/supplier/' || s_suppkey % 10, s_suppkey FROM supplier)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    return rules.explode_lines(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", "text")


LINES_SQL = """
cut AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
lines AS (SELECT doc_id AS id, lang, line, content FROM cut WHERE trim(content) <> '' AND NOT starts_with(ltrim(content), '#') AND NOT starts_with(ltrim(content), '//'))"""


def call_events(spark: SparkSession, d: str) -> DataFrame:
    """Trace records: an event's type is the scope, its id the case, value and k the metrics."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("scope"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("case_id"), F.col("value"), k.alias("k"), "user_id", "ts")


EVENTS_SQL = "e AS (SELECT event_id AS seq, event_type AS scope, 'c' || event_id AS case_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, ts FROM events)"


def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The records in long form: value_len and k as numbers, big as boolean, kind_tag as text, zero always 0."""
    e = call_events(spark, d)
    none = lambda t: F.lit(None).cast(t)
    num = lambda name, c: F.struct(F.lit(name).alias("metric"), F.lit("num").alias("v_type"), c.cast("double").alias("v_num"), none("string").alias("v_str"), none("boolean").alias("v_bool"))
    flag = F.struct(F.lit("big").alias("metric"), F.lit("bool").alias("v_type"), none("double").alias("v_num"), none("string").alias("v_str"), (F.col("value") >= 0).alias("v_bool"))
    tag = F.struct(F.lit("tag").alias("metric"), F.lit("str").alias("v_type"), none("double").alias("v_num"), F.concat(F.lit("t"), (F.col("seq") % 5).cast("string")).alias("v_str"), none("boolean").alias("v_bool"))
    rows = e.select("seq", "scope", "case_id", F.lit("call").alias("kind"), F.explode(F.array(num("value_len", F.round("value", 2)), num("k", F.col("k")), num("zero", F.lit(0)), flag, tag)).alias("m"))
    return rows.select("seq", "scope", "case_id", "kind", "m.*")


def records(spark: SparkSession, d: str) -> DataFrame:
    e = call_events(spark, d)
    return e.select("seq", "scope", "case_id", F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k").cast("double")), lambda _, v: v.isNotNull()).alias("metrics"))
