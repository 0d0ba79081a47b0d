"""PL: plans, audits and backlogs. Recordings are orders; gates and receipts are their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.operators import currency, ordered
from orrery.plans.registry import Tables, query

GATES_SQL = "g AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS d, min(l_tax) AS x, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)"


def gates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_discount").alias("d"), F.min("l_tax").alias("x"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("pl01_evidence_intervals", """
WITH b AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type <> 'signup' AND value > 60), k AS (SELECT user_id, event_type, s - 600 AS a, s + 600 AS b FROM b UNION ALL SELECT user_id, 'control', 1704067200 + d * 86400, 1704067200 + d * 86400 + 60 FROM (SELECT DISTINCT user_id FROM b), (SELECT unnest(range(0, 30)) AS d)),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM k), g AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS parts, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS reasons FROM g GROUP BY user_id, run""")
def pl01(t: Tables) -> DataFrame:
    s = F.call_function("div", fn.micros(F.col("ts")), F.lit(1_000_000))
    hits = t.events.where("event_type != 'signup' and value > 60").select("user_id", "event_type", s.alias("s"))
    spans = hits.select("user_id", "event_type", (F.col("s") - 600).alias("a"), (F.col("s") + 600).alias("b"))
    day = F.explode(F.sequence(F.lit(0), F.lit(29)))
    controls = hits.select("user_id").distinct().withColumn("d", day).select("user_id", F.lit("control").alias("event_type"), (F.lit(1704067200) + F.col("d").cast("long") * 86400).alias("a")).withColumn("b", F.col("a") + 60)
    merged = ordered.merge_intervals(spans.unionByName(controls), ["user_id"], "a", "b", 0, "event_type")
    return merged.select("user_id", "a", "b", "parts", F.array_join("event_types", "+").alias("reasons"))


@query("pl02_evidence_audit", f"""WITH {GATES_SQL} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'orphan' WHEN returned > 0 THEN 'unverified' WHEN d > 0.09 THEN 'stale' ELSE 'held' END AS outcome FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) FULL OUTER JOIN g ON o_orderkey = l_orderkey) GROUP BY 1""")
def pl02(t: Tables) -> DataFrame:
    g = gates(t).withColumn("receipt", F.lit(True))
    both = t.orders.where("o_orderkey % 9 != 0").select("o_orderkey", F.lit(True).alias("manifest")).join(g, "o_orderkey", "full_outer")
    why = currency.first_reason(missing=F.col("receipt").isNull(), orphan=F.col("manifest").isNull(), unverified=F.col("returned") > 0, stale=F.col("d") > 0.09)
    return both.groupBy(F.coalesce(why, F.lit("held")).alias("outcome")).agg(F.count("*").alias("n"))


@query("pl03_lifecycle_plan", f"""WITH {GATES_SQL} SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'active' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'young' WHEN coalesce(n, 0) = 0 THEN 'unanalysed' WHEN d >= 0.09 THEN 'keep' ELSE 'eligible' END AS status FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")
def pl03(t: Tables) -> DataFrame:
    young = F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-01-01 00:00:00'")
    plan = currency.first_reason(active=F.col("o_orderstatus") == "P", young=young, unanalysed=F.coalesce("n", F.lit(0)) == 0, keep=F.col("d") >= 0.09)
    return t.orders.join(gates(t), "o_orderkey", "left").select("o_orderkey", F.coalesce(plan, F.lit("eligible")).alias("status"))


@query("pl04_reclamation_plan", f"""WITH {GATES_SQL} SELECT CASE WHEN l_orderkey IS NULL THEN 'no durable copy' WHEN returned > 0 THEN 'copy changed' WHEN x > 0.05 THEN 'not analysed' ELSE 'reclaimable' END AS gate, count(*) AS n, round(sum(o_totalprice), 2) AS bytes FROM orders LEFT JOIN g ON o_orderkey = l_orderkey GROUP BY 1""")
def pl04(t: Tables) -> DataFrame:
    gate = currency.first_reason(**{"no durable copy": F.col("n").isNull(), "copy changed": F.col("returned") > 0, "not analysed": F.col("x") > 0.05})
    rows = t.orders.join(gates(t), "o_orderkey", "left")
    return rows.groupBy(F.coalesce(gate, F.lit("reclaimable")).alias("gate")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("pl05_convergence_plan", """
WITH a AS (SELECT p_name, p_brand, count(*) AS n FROM part WHERE p_size < 30 GROUP BY ALL), b AS (SELECT p_name, p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY ALL)
SELECT CASE WHEN b.p_name IS NULL THEN 'publish' WHEN a.p_name IS NULL THEN 'remote only' WHEN a.n = b.n THEN 'equal' ELSE 'conflict' END AS status, count(*) AS n FROM a FULL OUTER JOIN b ON a.p_name = b.p_name AND a.p_brand = b.p_brand GROUP BY 1""")
def pl05(t: Tables) -> DataFrame:
    side = lambda where, n: t.part.where(where).groupBy("p_name", "p_brand").agg(F.count("*").alias(n))
    both = side("p_size < 30", "a").join(side("p_size > 20", "b"), ["p_name", "p_brand"], "full_outer")
    status = F.when(F.col("b").isNull(), "publish").when(F.col("a").isNull(), "remote only").when(F.col("a") == F.col("b"), "equal").otherwise("conflict")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("pl06_layout_plan", """
SELECT doc_id, source || '/' || lang || '/' || doc_id AS target, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 AS eligible FROM documents""")
def pl06(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("target"), (place <= 5).alias("eligible"))


@query("pl07_replay_plan", f"""WITH {GATES_SQL} SELECT coalesce(CASE WHEN l_orderkey IS NULL THEN 'no report' WHEN n < 2 THEN 'too few' WHEN d < 0.05 THEN 'no candidate' END, 'planned') AS reason, count(*) AS n FROM orders LEFT JOIN g ON o_orderkey = l_orderkey GROUP BY 1""")
def pl07(t: Tables) -> DataFrame:
    why = currency.first_reason(**{"no report": F.col("n").isNull(), "too few": F.col("n") < 2, "no candidate": F.col("d") < 0.05})
    rows = t.orders.join(gates(t), "o_orderkey", "left").select(F.coalesce(why, F.lit("planned")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("pl08_completion_audit", """
SELECT o_orderpriority, count(*) AS waiting, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""")
def pl08(t: Tables) -> DataFrame:
    waiting = currency.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    return waiting.groupBy("o_orderpriority").agg(F.count("*").alias("waiting"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("oldest"))


@query("pl09_backfill_selection", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def pl09(t: Tables) -> DataFrame:
    open_ = currency.orphans(t.orders, t.lineitem.where("l_linestatus = 'O'"), "o_orderkey", "l_orderkey")
    return open_.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey")


@query("pl10_calibration_status", """
WITH m AS (SELECT l_suppkey, count(*) AS n, median(l_extendedprice) AS mid FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1)
SELECT s_suppkey, CASE WHEN m.l_suppkey IS NULL THEN 'never measured' WHEN n < 200 THEN 'too few samples' WHEN mid < 50000 THEN 'out of range' ELSE 'applied' END AS reason FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey""")
def pl10(t: Tables) -> DataFrame:
    m = t.lineitem.where("l_discount >= 0.05").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.median("l_extendedprice").alias("mid"))
    why = currency.first_reason(**{"never measured": F.col("n").isNull(), "too few samples": F.col("n") < 200, "out of range": F.col("mid") < 50000})
    return t.supplier.join(m, "s_suppkey", "left").select("s_suppkey", F.coalesce(why, F.lit("applied")).alias("reason"))


@query("pl11_coverage_status", f"""WITH {GATES_SQL} SELECT o_orderstatus, count(*) AS held, count(l_orderkey) AS available, count(*) FILTER (n >= 3) AS scored, count(*) FILTER (returned > 0) AS annotated FROM orders LEFT JOIN g ON o_orderkey = l_orderkey GROUP BY 1""")
def pl11(t: Tables) -> DataFrame:
    rows = t.orders.join(gates(t), "o_orderkey", "left")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("held"), F.count("n").alias("available"), F.count_if(F.col("n") >= 3).alias("scored"), F.count_if(F.col("returned") > 0).alias("annotated"))
