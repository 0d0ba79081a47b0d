"""P, S, C: projections, source handling, currency and integrity. Reports are orders with their line items nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.operators import currency, ordered, project
from orrery.plans.registry import Tables, query
from orrery.sources import scratch

UNIQUE = "u AS (SELECT l_orderkey, l_linenumber, l_suppkey, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY ALL)"


def reports(t: Tables) -> DataFrame:
    """One nested document for each order: checks by line number, each with its receivers."""
    rx = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    checks = rx.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("l_suppkey", "price", "discount"))).alias("receivers"))
    return checks.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "receivers"))).alias("checks"))


@query("p01_probe_projection", f"""WITH {UNIQUE}
SELECT l_orderkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS check_index, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey) - 1 AS INTEGER) AS receiver, l_suppkey, price, discount >= 0.05 AS candidate FROM u""")
def p01(t: Tables) -> DataFrame:
    rows = project.probes(reports(t), "checks", "receivers", ["l_orderkey"])
    return rows.select("l_orderkey", "check_index", "receiver", "rx.l_suppkey", "rx.price", (F.col("rx.discount") >= 0.05).alias("candidate"))


@query("p02_recordings", """
SELECT o_orderkey AS recording_id, strftime(o_orderdate, '%Y-%m-%d') AS day, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS labels FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS p FROM orders) WHERE p = 1""")
def p02(t: Tables) -> DataFrame:
    one = ordered.newest(t.orders, ["o_orderkey"], ["o_custkey"])
    return one.select(F.col("o_orderkey").alias("recording_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("labels"))


@query("p03_analysis_runs", """
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS run_id FROM orders""")
def p03(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", project.run_id("o_orderkey", "o_custkey", "o_orderstatus").alias("run_id"))


@query("p05_windows_outer", f"""WITH {UNIQUE} SELECT o_orderkey, count(l_linenumber) AS receivers FROM orders LEFT JOIN u ON o_orderkey = l_orderkey GROUP BY 1""")
def p05(t: Tables) -> DataFrame:
    rows = t.orders.join(reports(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").select("o_orderkey", F.explode_outer("checks").alias("c"))
    return rows.groupBy("o_orderkey").agg(F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.size("c.receivers"))), F.lit(0)).cast("long").alias("receivers"))


@query("p06_receiver_count_validation", f"""WITH {UNIQUE}, c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM u GROUP BY ALL) SELECT CASE WHEN n = 1 THEN 'accepted' ELSE 'receiver count' END AS outcome, count(*) AS checks FROM c GROUP BY 1""")
def p06(t: Tables) -> DataFrame:
    c = reports(t).select(F.explode("checks").alias("c"))
    return c.groupBy(F.when(F.size("c.receivers") == 1, "accepted").otherwise("receiver count").alias("outcome")).agg(F.count("*").alias("checks"))


@query("p08_track_points", """
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.04 THEN l_discount END, l_tax) AS qualified FROM lineitem""")
def p08(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_discount")), "l_tax").alias("qualified"))


@query("p10_best_candidate", f"""WITH {UNIQUE} SELECT l_orderkey, arg_min(l_suppkey, struct_pack(r := CASE WHEN discount > 0 THEN CAST(round(discount * 100) AS INTEGER) ELSE 1073741824 END, s := l_suppkey)) AS best FROM u GROUP BY 1""")
def p10(t: Tables) -> DataFrame:
    rows = project.probes(reports(t), "checks", "receivers", ["l_orderkey"])
    rank = F.coalesce(F.when(F.col("rx.discount") > 0, F.rint(F.col("rx.discount") * 100).cast("int")), F.lit(1 << 30))
    return rows.groupBy("l_orderkey").agg(F.min_by("rx.l_suppkey", F.struct(rank, "rx.l_suppkey")).alias("best"))


@query("p11_source_documents", """
SELECT doc_id, kind, bytes, digest FROM (SELECT doc_id, 'text' AS kind, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS digest FROM documents UNION ALL SELECT doc_id, 'source', octet_length(encode(source)), sha256(source) FROM documents)""")
def p11(t: Tables) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("text"), F.lit("source")), F.array(F.coalesce("text", F.lit("")), "source"))
    rows = t.documents.select("doc_id", F.explode(F.map_entries(m)).alias("e"))
    return rows.select("doc_id", F.col("e.key").alias("kind"), F.octet_length("e.value").cast("long").alias("bytes"), F.sha2("e.value", 256).alias("digest"))


@query("p13_dashboard_records", """
SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '","n":' || n || CASE WHEN q IS NULL THEN '' ELSE ',"q":' || q END || '}' AS detail FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount > 0.09) AS q0, nullif(count(*) FILTER (l_discount > 0.09), 0) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def p13(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.nullif(F.count_if(F.col("l_discount") > 0.09), F.lit(0)).alias("q"))
    return t.orders.join(n, "o_orderkey").select("o_orderkey", F.to_json(F.struct("o_orderstatus", "n", "q")).alias("detail"))


@query("p14_listing_rows", """
SELECT p_partkey, '{"p_name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '}' AS listing FROM part""")
def p14(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.struct("p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))).alias("listing"))


@query("p15_parameter_audit", """
SELECT source, count(*) AS documents, min(n_chars) AS least, median(n_chars) AS median, count(DISTINCT lang) AS languages FROM documents GROUP BY 1""")
def p15(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.min("n_chars").alias("least"), F.median("n_chars").alias("median"), F.count_distinct("lang").alias("languages"))


@query("p16_status", """
SELECT l_orderkey, CASE WHEN max(l_discount) >= 0.09 THEN 'confirmed' WHEN max(l_tax) >= 0.07 THEN 'qualified' WHEN max(l_quantity) >= 40 THEN 'candidate' ELSE 'analyzed' END AS status FROM lineitem GROUP BY 1""")
def p16(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("x"), F.max("l_quantity").alias("q"))
    return g.select("l_orderkey", F.coalesce(project.status(confirmed=F.col("d") >= 0.09, qualified=F.col("x") >= 0.07, candidate=F.col("q") >= 40), F.lit("analyzed")).alias("status"))


@query("p17_evidence_tier", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 5 WHEN n >= 6 THEN 4 WHEN d >= 0.09 THEN 3 WHEN q >= 45 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END AS tier FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_discount) AS d, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def p17(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    tests = [(F.col("o_orderpriority") == "1-URGENT", 5), (F.col("n") >= 6, 4), (F.col("d") >= 0.09, 3), (F.col("q") >= 45, 2), (F.col("n") >= 1, 1)]
    tier = F.lit(0)
    for test, n in reversed(tests):
        tier = F.when(test, n).otherwise(tier)
    return t.orders.join(g, "o_orderkey", "left").select("o_orderkey", tier.alias("tier"))


STAMP = "'ch' || o_custkey % 8 || '-lower-edge-' || CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y%m%dT%H%M%SZ') END"


@query("p18_stamp_date", f"""
SELECT o_orderkey, CASE WHEN regexp_extract(name, '([0-9]{{8}})T[0-9]{{6}}Z', 1) <> '' THEN strftime(strptime(regexp_extract(name, '([0-9]{{8}})T[0-9]{{6}}Z', 1), '%Y%m%d'), '%Y-%m-%d') END AS day FROM (SELECT o_orderkey, {STAMP} AS name FROM orders)""")
def p18(t: Tables) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 10 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"))
    name = F.concat(F.lit("ch"), (F.col("o_custkey") % 8).cast("string"), F.lit("-lower-edge-"), stamp)
    return t.orders.select("o_orderkey", F.date_format(project.stamp_date(name), "yyyy-MM-dd").alias("day"))


@query("p19_tuning_key", """
SELECT o_orderkey, 'ch' || o_custkey % 8 || '-' || CASE WHEN o_orderkey % 2 = 0 THEN 'lower' ELSE 'upper' END AS tuning FROM orders""")
def p19(t: Tables) -> DataFrame:
    region = F.when(F.col("o_orderkey") % 2 == 0, "lower-edge").otherwise("upper-edge")
    return t.orders.select("o_orderkey", project.tuning_key(F.col("o_custkey") % 8, region).alias("tuning"))


@query("p20_receiver_position", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 < 6 THEN 'R' || (s_suppkey % 7) // 2 + 1 || 'A' || (s_suppkey % 7) % 2 + 1 END AS position FROM supplier""")
def p20(t: Tables) -> DataFrame:
    label = F.when(F.col("s_suppkey") % 7 < 6, F.concat(F.lit("lnb-"), F.char(97 + F.col("s_suppkey") % 7))).otherwise("port-9")
    return t.supplier.select("s_suppkey", project.receiver_position(label).alias("position"))


@query("p21_strict_negatives", """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_discount > 0.05 OR l_tax > 0.05))""")
def p21(t: Tables) -> DataFrame:
    hits = t.lineitem.where("l_discount > 0.05 or l_tax > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus != 'F'").join(hits, "o_orderkey", "left_anti").select("o_orderkey")


@query("p22_interesting_checks", f"""WITH {UNIQUE} SELECT l_orderkey, l_linenumber, bool_or(discount >= 0.08) AS interesting FROM u GROUP BY ALL""")
def p22(t: Tables) -> DataFrame:
    c = reports(t).select("l_orderkey", F.explode("checks").alias("c"))
    return c.select("l_orderkey", "c.l_linenumber", F.exists("c.receivers", lambda r: r["discount"] >= 0.08).alias("interesting"))


@query("p23_assignment_balance", """
SELECT ['a', 'b', 'c'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS arm, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE - 1 / 3.0, 9) AS excess FROM orders GROUP BY 1""")
def p23(t: Tables) -> DataFrame:
    arms = t.orders.groupBy(project.assigned(F.col("o_orderkey"), ["a", "b", "c"]).alias("arm")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row for each arm
    return arms.select("arm", "n", F.round(share - 1 / 3, 9).alias("excess"))


@query("p24_uncalibrated_verdict", """
WITH thr AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.9) AS threshold FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber <= 4 GROUP BY 1)
SELECT l_linenumber, count(*) AS n, count(v) AS judged, count(*) FILTER (v) AS fired FROM (SELECT l_linenumber, CASE WHEN threshold IS NOT NULL THEN l_extendedprice >= threshold END AS v FROM lineitem LEFT JOIN thr USING (l_linenumber)) GROUP BY 1""")
def p24(t: Tables) -> DataFrame:
    thr = t.lineitem.where("l_returnflag = 'N' and l_linenumber <= 4").groupBy("l_linenumber").agg(F.percentile("l_extendedprice", F.lit(0.9)).alias("threshold"))
    v = project.verdict(F.col("l_extendedprice"), F.col("threshold"))
    return t.lineitem.join(thr, "l_linenumber", "left").withColumn("v", v).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("v").alias("judged"), F.count_if("v").alias("fired"))


@query("p25_pass_rows", f"""WITH {UNIQUE} SELECT l_orderkey, min(l_linenumber) AS rise, max(l_linenumber) AS sets, arg_max(l_linenumber, struct_pack(p := price, l := -l_linenumber)) AS culmination FROM u GROUP BY 1""")
def p25(t: Tables) -> DataFrame:
    rows = reports(t).select("l_orderkey", F.explode("checks").alias("c")).select("l_orderkey", "c.l_linenumber", F.explode("c.receivers").alias("r"))
    return rows.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("rise"), F.max("l_linenumber").alias("sets"), F.max_by("l_linenumber", F.struct("r.price", -F.col("l_linenumber"))).alias("culmination"))


@query("p26_observation_mode", """
SELECT coalesce(mode, 'rejected') AS mode, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority LIKE '1-%' THEN 'narrow' WHEN o_orderpriority LIKE '2-%' THEN 'wide' WHEN o_orderstatus = 'F' THEN 'survey' END AS mode FROM orders) GROUP BY 1""")
def p26(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    mode = F.coalesce(F.when(p.like("1-%"), "narrow").when(p.like("2-%"), "wide"), F.when(F.col("o_orderstatus") == "F", "survey"))
    return t.orders.groupBy(F.coalesce(mode, F.lit("rejected")).alias("mode")).agg(F.count("*").alias("n"))


@query("s03_schema_census", """
SELECT coalesce(tag, 'unreadable') AS tag, count(*) AS documents, count(*) FILTER (k % 2 = 0) AS current FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS tag, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def s03(t: Tables) -> DataFrame:
    tag = F.when(F.col("event_id") % 13 != 0, F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy(F.coalesce(tag, F.lit("unreadable")).alias("tag")).agg(F.count("*").alias("documents"), F.count_if(k % 2 == 0).alias("current"))


@query("s05_source_authentication", """
WITH claim AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 50 = 0 THEN '!' ELSE '' END) AS digest FROM documents WHERE doc_id % 41 <> 0), actual AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 37 <> 0)
SELECT CASE WHEN c.doc_id IS NULL THEN 'unclaimed' WHEN a.doc_id IS NULL THEN 'missing' WHEN c.digest <> a.digest THEN 'changed' ELSE 'accepted' END AS outcome, count(*) AS n FROM claim c FULL OUTER JOIN actual a ON c.doc_id = a.doc_id GROUP BY 1""")
def s05(t: Tables) -> DataFrame:
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    claim = t.documents.where(i % 41 != 0).select("doc_id", F.sha2(F.concat(text, F.when(i % 50 == 0, "!").otherwise("")), 256).alias("c"))
    actual = t.documents.where(i % 37 != 0).select("doc_id", F.sha2(text, 256).alias("a"))
    outcome = currency.first_reason(unclaimed=F.col("c").isNull(), missing=F.col("a").isNull(), changed=F.col("c") != F.col("a"))
    return claim.join(actual, "doc_id", "full_outer").groupBy(F.coalesce(outcome, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("s10_ad_hoc_sql", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def s10(t: Tables) -> DataFrame:
    from orrery.sources.catalog import register_tables

    register_tables(t.spark, {"supplier": t.supplier, "nation": t.nation}, "adhoc_")
    return t.spark.sql("SELECT n_name, count(*) AS suppliers FROM adhoc_supplier JOIN adhoc_nation ON s_nationkey = n_nationkey GROUP BY n_name")


@query("s16_duplicate_documents", """
SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS p FROM customer) WHERE p = 1""")
def s16(t: Tables) -> DataFrame:
    return ordered.newest(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_name"]).select("c_nationkey", "c_custkey")


@query("s17_sweep_import", """
WITH r AS (SELECT o_orderkey, unnest(['even', 'odd']) AS radio, o_custkey FROM orders WHERE o_orderstatus <> 'P') SELECT radio, o_custkey % 8 AS tuning, count(*) AS entries FROM r WHERE (radio = 'even') = (o_orderkey % 2 = 0) GROUP BY ALL""")
def s17(t: Tables) -> DataFrame:
    radios = F.create_map(F.lit("even"), F.col("o_orderkey") % 2 == 0, F.lit("odd"), F.col("o_orderkey") % 2 == 1)
    rows = t.orders.where("o_orderstatus != 'P'").select("o_custkey", F.explode(radios).alias("radio", "mine")).where("mine")
    return rows.groupBy("radio", (F.col("o_custkey") % 8).alias("tuning")).agg(F.count("*").alias("entries"))


DRIFT = """now AS (SELECT doc_id, n_chars AS bytes, doc_id % 5 + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS mtime, md5(coalesce(text, '') || CASE WHEN doc_id % 22 = 0 THEN 'x' ELSE '' END) AS digest FROM documents WHERE doc_id % 17 <> 0),
rec AS (SELECT doc_id, n_chars AS bytes, doc_id % 5 AS mtime, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 19 <> 0),
d AS (SELECT coalesce(n.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'gone' WHEN n.bytes = r.bytes AND n.mtime = r.mtime THEN 'current' WHEN n.digest = r.digest THEN 'touched' ELSE 'changed' END AS state FROM now n FULL OUTER JOIN rec r ON n.doc_id = r.doc_id)"""


def drifted(t: Tables) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    now = t.documents.where(i % 17 != 0).select("doc_id", F.col("n_chars").alias("bytes"), (i % 5 + (i % 11 == 0).cast("long")).alias("mtime"), F.md5(F.concat(text, F.when(i % 22 == 0, "x").otherwise(""))).alias("digest"))
    recorded = t.documents.where(i % 19 != 0).select("doc_id", F.col("n_chars").alias("bytes"), (i % 5).alias("mtime"), F.md5(text).alias("digest"))
    return currency.drift(now, recorded, ["doc_id"], ["bytes", "mtime"], "digest")


@query("c01_source_signatures", "SELECT doc_id, n_chars AS bytes, doc_id % 5 AS mtime FROM documents")
def c01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("n_chars").alias("bytes"), (F.col("doc_id") % 5).alias("mtime"))


@query("c02_drift_decision", f"WITH {DRIFT} SELECT doc_id, state FROM d")
def c02(t: Tables) -> DataFrame:
    return drifted(t)


@query("c03_unit_grouping", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def c03(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("c04_stale_units", f"WITH {DRIFT}, s AS (SELECT DISTINCT doc_id % 10 AS unit FROM d WHERE state IN ('changed', 'added', 'gone')) SELECT doc_id FROM documents WHERE doc_id % 10 IN (SELECT unit FROM s)")
def c04(t: Tables) -> DataFrame:
    stale = drifted(t).where("state in ('changed', 'added', 'gone')").select((F.col("doc_id") % 10).alias("unit")).distinct()
    return t.documents.withColumn("unit", F.col("doc_id") % 10).join(stale, "unit", "left_semi").select("doc_id")


@query("c05_exclusion_ledger", """
SELECT doc_id, CASE WHEN n_chars < 60 THEN 'too short' WHEN lang NOT IN ('en', 'de') THEN 'language' END AS reason FROM documents WHERE n_chars < 60 OR lang NOT IN ('en', 'de')""")
def c05(t: Tables) -> DataFrame:
    reason = currency.first_reason(**{"too short": F.col("n_chars") < 60, "language": ~F.col("lang").isin("en", "de")})
    return t.documents.select("doc_id", reason.alias("reason")).where("reason is not null")


@query("c06_null_census", """
SELECT * FROM (SELECT 'a' AS "column", count(*) FILTER (l_discount = 0) AS nulls FROM lineitem UNION ALL SELECT 'b', count(*) FILTER (l_tax = 0) FROM lineitem) WHERE nulls > 0""")
def c06(t: Tables) -> DataFrame:
    return currency.null_census(t.lineitem.select(F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.col("l_quantity").alias("c")))


@query("c07_partition_status", f"WITH {DRIFT} SELECT doc_id % 10 AS unit, count(*) AS sources, count(*) FILTER (state <> 'current') AS stale FROM d GROUP BY 1")
def c07(t: Tables) -> DataFrame:
    return drifted(t).groupBy((F.col("doc_id") % 10).alias("unit")).agg(F.count("*").alias("sources"), F.count_if(F.col("state") != "current").alias("stale"))


@query("c08_referential_check", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def c08(t: Tables) -> DataFrame:
    return currency.orphans(t.lineitem, t.orders.where("o_orderstatus != 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("c10_coverage_difference", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS recordings, count(l_orderkey) AS received FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1""")
def c10(t: Tables) -> DataFrame:
    got = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("got", F.lit(1))
    return t.orders.join(got, "o_orderkey", "left").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("recordings"), F.count("got").alias("received"))


@query("c11_collision_guard", "SELECT source, lang, count(DISTINCT n_chars) AS digests FROM documents GROUP BY ALL HAVING count(DISTINCT n_chars) > 1")
def c11(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count_distinct("n_chars").alias("digests")).where("digests > 1")


@query("c12_listing_compaction", """
WITH u AS (SELECT o_orderkey AS id, 0 AS arrival, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem) SELECT id, arrival, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival DESC, v DESC) AS p FROM u) WHERE p = 1""")
def c12(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("arrival"), F.col("o_totalprice").alias("v"))
    new = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("arrival"), F.col("l_extendedprice").alias("v"))
    return ordered.newest(old.unionByName(new), ["id"], [F.desc("arrival"), F.desc("v")])


@query("c13_shard_summary", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS confirmed FROM orders GROUP BY 1")
def c13(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"))


@query("c14_derived_currency", """
SELECT p_partkey FROM part WHERE sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') NOT IN (SELECT sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') FROM part WHERE p_partkey % 3 = 0)""")
def c14(t: Tables) -> DataFrame:
    keyed = t.part.select("p_partkey", fn.canonical_digest("p_brand", "p_size").alias("digest"))
    return keyed.join(keyed.where("p_partkey % 3 = 0").select("digest"), "digest", "left_anti").select("p_partkey")


@query("p04_run_summary", """
SELECT o_orderkey, o_orderstatus AS state, n, round(coverage, 6) AS coverage FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) / 350 AS coverage FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def p04(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.struct(F.count("*").alias("n"), (F.sum("l_quantity") / 350).alias("coverage")).alias("summary"))
    return t.orders.join(s, "o_orderkey").select("o_orderkey", F.col("o_orderstatus").alias("state"), "summary.n", F.round("summary.coverage", 6).alias("coverage"))


@query("p07_confirmed_events", """
WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS confirmed FROM orders), l AS (SELECT l_orderkey, count(*) AS links FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1)
SELECT o_orderkey, links FROM c LEFT JOIN l ON o_orderkey = l_orderkey WHERE confirmed OR links IS NOT NULL""")
def p07(t: Tables) -> DataFrame:
    """A confirmed recording without links is one event with nothing known about it."""
    links = t.lineitem.where("l_discount >= 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("links"))
    return t.orders.join(links, "o_orderkey", "left").where("o_orderstatus = 'F' or links is not null").select("o_orderkey", "links")


@query("p09_decodes", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_discount END, least(l_discount, l_tax)) AS accuracy FROM lineitem")
def p09(t: Tables) -> DataFrame:
    soft = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(soft, F.least("l_discount", "l_tax")).alias("accuracy"))


@query("s02_multi_kind_scan", """
SELECT kind, count(*) AS documents, count(DISTINCT k) AS recordings FROM (SELECT 'analysis' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'track', l_orderkey FROM lineitem UNION ALL SELECT 'association', l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def s02(t: Tables) -> DataFrame:
    """One reader with its own schema for each kind of document under reports/<kind>/; the recording is part of the path."""
    root = scratch.fresh(t.spark, "reports")
    part = lambda k: F.concat(F.lit("r"), F.pmod(k, F.lit(16)).cast("string"))
    kinds = {
        "analysis": (t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total")), "total double"),
        "track": (t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("points")), "points bigint"),
        "association": (t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("satellite")), "satellite bigint"),
    }
    counts = []
    for kind, (docs, extra) in kinds.items():
        docs.withColumn("group", part(F.col("k"))).write.partitionBy("group").json(f"{root}/reports/kind={kind}")
        found = t.spark.read.schema(f"k bigint, {extra}").option("mode", "FAILFAST").json(f"{root}/reports/kind={kind}")
        kind_of = F.regexp_extract("_metadata.file_path", "reports/kind=([^/]+)/group=r([0-9]+)/", 1)
        counts.append(found.select(kind_of.alias("kind"), "k").groupBy("kind").agg(F.count("*").alias("documents"), F.count_distinct("k").alias("recordings")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("s04_receipt_discovery", """
SELECT regexp_extract(path, 'runs/([^/]+)/([^/]+)/completion.json', 1) AS pipeline, regexp_extract(path, 'runs/([^/]+)/([^/]+)/completion.json', 2) AS recording FROM (SELECT 'runs/p' || o_custkey % 3 || '/r' || o_orderkey || '/completion.json' AS path, o_orderstatus FROM orders) WHERE o_orderstatus = 'F'""")
def s04(t: Tables) -> DataFrame:
    """Receipts under runs/<pipeline>/: a run exists only where its receipt says success."""
    root = scratch.fresh(t.spark, "runs")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    receipts = t.orders.select(F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("pipeline"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("recording"), status.alias("status"))
    receipts.write.partitionBy("pipeline").json(f"{root}/runs")
    found = t.spark.read.schema("recording string, status string").option("mode", "FAILFAST").json(f"{root}/runs/pipeline=*")
    return found.where("status = 'success'").select(F.regexp_extract("_metadata.file_path", "runs/pipeline=([^/]+)/", 1).alias("pipeline"), "recording")


@query("s09_schema_evolution", """
SELECT era, count(*) AS n, count(tax) AS with_tax FROM (SELECT 'old' AS era, NULL::DOUBLE AS tax FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' UNION ALL SELECT 'new', l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01') GROUP BY 1""")
def s09(t: Tables) -> DataFrame:
    """Partitions written at two times, the older without a column, read as one table by column name."""
    root = scratch.fresh(t.spark, "eras")
    cut = F.expr("timestamp_ntz '1996-01-01 00:00:00'")
    t.lineitem.where(F.col("l_shipdate") < cut).select("l_orderkey").write.parquet(f"{root}/era=old")
    t.lineitem.where(F.col("l_shipdate") >= cut).select("l_orderkey", F.col("l_tax").alias("tax")).write.parquet(f"{root}/era=new")
    from orrery.sources.reports import read_partitions

    return read_partitions(t.spark, root).groupBy("era").agg(F.count("*").alias("n"), F.count("tax").alias("with_tax"))


@query("s08_commit_markers", """
SELECT o_orderstatus AS unit, count(*) AS rows, count(*) FILTER (o_orderpriority LIKE '1-%') AS missing, true AS current FROM orders GROUP BY 1""")
def s08(t: Tables) -> DataFrame:
    """Partitions with a marker each, appended after the data; a reader takes a partition only as its newest marker tells."""
    root = scratch.fresh(t.spark, "marked")
    rows = t.orders.select("o_orderkey", F.when(~F.col("o_orderpriority").like("1-%"), F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("unit"))
    rows.write.partitionBy("unit").option("compression", "zstd").parquet(f"{root}/table")
    counted = lambda df: df.groupBy("unit").agg(F.count("*").alias("rows"), F.count_if(F.col("priority").isNull()).alias("missing"), F.sum(F.xxhash64("o_orderkey").cast("decimal(20,0)")).alias("seal"))
    table = t.spark.read.schema("o_orderkey bigint, priority string, unit string").parquet(f"{root}/table")
    counted(table).withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/markers")
    newest = ordered.newest(t.spark.read.parquet(f"{root}/markers"), ["unit"], [F.desc("written")])
    held = counted(table).select("unit", F.col("seal").alias("now"))
    return newest.join(held, "unit", "left").select("unit", "rows", "missing", F.coalesce(F.col("seal") == F.col("now"), F.lit(False)).alias("current"))


@query("s14_waterfall_rows", "SELECT vec_id, unnest(range(0, len(embedding))) AS bin, round(CAST(unnest(embedding) AS DOUBLE), 6) AS level FROM embeddings")
def s14(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("bin", "level")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round(F.col("level").cast("double"), 6).alias("level"))


@query("c09_projection_parity", """
WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 1) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey, round(sum(CASE WHEN o_custkey % 97 = 0 THEN 0 ELSE o_totalprice END), 1) AS v FROM orders GROUP BY 1)
SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def c09(t: Tables) -> DataFrame:
    total = lambda x: F.round(F.sum(fn.exact(x)), 1).cast("double").alias("v")
    a = t.orders.groupBy("o_custkey").agg(total(F.col("o_totalprice")))
    b = t.orders.groupBy("o_custkey").agg(total(F.when(F.col("o_custkey") % 97 == 0, 0.0).otherwise(F.col("o_totalprice"))))
    return currency.parity(a, b)


@query("c15_build_states", f"WITH {DRIFT} SELECT state, count(*) AS n FROM d GROUP BY 1")
def c15(t: Tables) -> DataFrame:
    return drifted(t).groupBy("state").agg(F.count("*").alias("n"))


@query("s13_latest_fix", """
WITH e AS (SELECT *, event_id % 5 <> 0 AS valid, event_id % 3 = 0 AS fixed FROM events), r AS (SELECT user_id, max(event_id) AS i FROM e WHERE valid GROUP BY 1), g AS (SELECT user_id, max(event_id) AS i FROM e WHERE fixed GROUP BY 1)
SELECT r.user_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS gps, round(e.event_id % 90 + (e.event_id % 60) / 60.0, 6) AS latitude, round(-(e.event_id % 180 + (e.event_id % 60) / 60.0), 6) AS longitude, CAST(g.i % 13 AS INTEGER) AS satellites
FROM r JOIN e ON e.event_id = r.i LEFT JOIN g ON g.user_id = r.user_id""")
def s13(t: Tables) -> DataFrame:
    """Each event as the two sentences of a receiver's log, a fifth of them void or with a wrong checksum, and each log's latest fix."""
    from orrery.sources import text

    i = F.col("event_id")
    minutes = F.format_string("%02d.0000", i % 60)
    lat, lon = F.concat(F.format_string("%02d", i % 90), minutes), F.concat(F.format_string("%03d", i % 180), minutes)
    status = F.when((i % 5 == 0) & (i % 2 == 0), "V").otherwise("A")
    rmc = F.concat_ws(",", F.lit("GPRMC"), F.date_format("ts", "HHmmss"), status, lat, F.lit("N"), lon, F.lit("W"), F.lit(""), F.lit(""), F.date_format("ts", "ddMMyy"), F.lit(""), F.lit(""), F.lit("A"))
    gga = F.concat_ws(",", F.lit("GPGGA"), F.date_format("ts", "HHmmss"), lat, F.lit("N"), lon, F.lit("W"), F.when(i % 3 == 0, "1").otherwise("0"), (i % 13).cast("string"), F.lit("0.9"), F.lit("12.5"))
    sums = lambda body: F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda s, x: s.bitwiseXOR(x))
    wrong = F.when((i % 5 == 0) & (i % 2 == 1), 1).otherwise(0)
    sentence = lambda body, off: F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(sums(body).bitwiseXOR(off).cast("long")), 2, "0"))
    lines = t.events.select("user_id", "event_id", F.explode(F.array(sentence(rmc, wrong), sentence(gga, F.lit(0)))).alias("value"))
    fix = text.latest_fix(lines, ["user_id"], "event_id")
    return fix.select("user_id", F.date_format("gps", "yyyy-MM-dd HH:mm:ss").alias("gps"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "satellites")
