"""F: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.plans.registry import Tables, query


@query("f01_wrapped_gap", """
SELECT l_orderkey, l_linenumber, least(m, 360 - m) AS gap FROM (
  SELECT l_orderkey, l_linenumber, ((l_partkey - l_suppkey) % 360 + 360) % 360 AS m FROM lineitem)""")
def f01(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.wrapped_gap(F.col("l_partkey"), F.col("l_suppkey"), F.lit(360).cast("long")).cast("long").alias("gap"))


@query("f02_decibels", """
SELECT event_id, round(10 * log10(value), 6) AS db, round(CASE WHEN value > 0 THEN 20 * log10(value / 2048.0) END, 6) AS dbfs FROM events WHERE value > 0""")
def f02(t: Tables) -> DataFrame:
    return t.events.where("value > 0").select("event_id", F.round(fn.decibels(F.col("value")), 6).alias("db"), F.round(fn.dbfs(F.col("value")), 6).alias("dbfs"))


@query("f03_finite", """
SELECT l_orderkey, l_linenumber, NOT (l_discount = 0) AND isfinite(l_extendedprice / nullif(l_discount, 0)) AS ok FROM lineitem""")
def f03(t: Tables) -> DataFrame:
    ratio = F.when(F.col("l_discount") != 0, F.col("l_extendedprice") / F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.finite(ratio).alias("ok"))


@query("f04_time_formats", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, make_timestamp(epoch_us(ts)) AS back FROM events""")
def f04(t: Tables) -> DataFrame:
    ns = fn.micros(F.col("ts")) * 1000
    return t.events.select("event_id", "ts", ns.alias("ns")).select("event_id", fn.iso_utc(F.col("ts")).alias("iso"), fn.from_nanoseconds(F.col("ns")).cast("timestamp_ntz").alias("back"))


@query("f05_canonical_digest", """
SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def f05(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", fn.canonical_digest("n_nationkey", "n_name", "n_regionkey").alias("digest"))


@query("f06_clean_name", """
SELECT c_custkey, regexp_replace(lower(trim(c_name)), '0$', '') AS label, regexp_extract(c_name, '([0-9]+)$', 1) AS serial FROM customer""")
def f06(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.clean_name(F.col("c_name"), "0").alias("label"), F.regexp_extract("c_name", "([0-9]+)$", 1).alias("serial"))


@query("f07_safe_identity", """
SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9._#-]*') AS name_ok, regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9._#-]*') AS brand_ok FROM part""")
def f07(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.safe_identity(F.col("p_name")).alias("name_ok"), fn.safe_identity(F.col("p_brand")).alias("brand_ok"))


@query("f08_item_or_default", """
SELECT vec_id, round(coalesce(embedding[label + 1], 0), 6) AS own, round(coalesce(embedding[1000], -1), 6) AS past FROM embeddings""")
def f08(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(fn.item_or(v, F.col("label"), F.lit(0.0)).cast("double"), 6).alias("own"), F.round(fn.item_or(v, 999, F.lit(-1.0)).cast("double"), 6).alias("past"))


@query("f09_map_of_pairs", """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS urgent FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def f09(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return maps.select("o_custkey", F.size("m").cast("long").alias("priorities"), F.try_element_at("m", F.lit("1-URGENT")).alias("urgent"))


@query("f10_packed_states", """
SELECT o_orderkey, o_orderkey & 3 AS s0, (o_orderkey >> 2) & 3 AS s1, (o_orderkey >> 4) & 3 AS s2, (o_orderkey >> 6) & 3 AS s3 FROM orders""")
def f10(t: Tables) -> DataFrame:
    states = t.orders.select("o_orderkey", fn.packed_states(F.col("o_orderkey"), 4).alias("s"))
    return states.select("o_orderkey", *(F.col("s")[i].alias(f"s{i}") for i in range(4)))


@query("f11_guard_band", """
SELECT l_orderkey, l_linenumber, greatest(0.0, (l_extendedprice - 30000.0) * 0.5) AS guard FROM lineitem""")
def f11(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", fn.guard_band(F.col("l_extendedprice"), 30000.0).alias("guard"))


@query("f12_linear_interpolation", """
SELECT event_id, round(prev + (next - prev) * (epoch_us(ts) - pts) / nullif(nts - pts, 0), 6) AS between_neighbours FROM (
  SELECT event_id, user_id, ts, lag(value) OVER w AS prev, lead(value) OVER w AS next, lag(epoch_us(ts)) OVER w AS pts, lead(epoch_us(ts)) OVER w AS nts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def f12(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = fn.micros(F.col("ts"))
    e = t.events.withColumn("us", us).withColumns({"x0": F.lag("us").over(w), "y0": F.lag("value").over(w), "x1": F.lead("us").over(w), "y1": F.lead("value").over(w)})
    x = fn.linear(F.col("us"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return e.select("event_id", F.round(F.when(F.col("x1") > F.col("x0"), x), 6).alias("between_neighbours"))


@query("f13_scores", """
SELECT event_id, round(exp(-abs(value - 50) / 25), 6) AS score, least(greatest(value, 10), 90) AS clamped FROM events""")
def f13(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(fn.exponential_score(F.col("value") - 50, 25.0), 6).alias("score"), fn.clamp(F.col("value"), 10.0, 90.0).alias("clamped"))
