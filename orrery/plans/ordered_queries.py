"""W, T, U: ordered scans, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.operators import ordered
from orrery.plans.registry import Tables, query

BY_USER = ["user_id"]


def seconds(t: Tables) -> DataFrame:
    """Events with their time in seconds."""
    return t.events.withColumn("s", fn.micros(F.col("ts")) / 1e6)


@query("w01_confirmation_links", """
SELECT user_id, count(*) AS candidates, count(*) FILTER (s - ps <= 20000 AND least(abs(event_id - pe) % 500, 500 - abs(event_id - pe) % 500) <= 120 AND abs(value - pv) <= 25 + 0.001 * (s - ps)) AS links FROM (
  SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS s, lag(epoch_us(ts) / 1e6) OVER w AS ps, lag(event_id) OVER w AS pe, lag(value) OVER w AS pv FROM events WHERE value > 40 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""")
def w01(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = seconds(t).where("value > 40").withColumns({"ps": F.lag("s").over(w), "pe": F.lag("event_id").over(w), "pv": F.lag("value").over(w)})
    dt = F.col("s") - F.col("ps")
    ok = (dt <= 20000) & (fn.wrapped_gap(F.col("event_id"), F.col("pe"), F.lit(500).cast("long")) <= 120) & (F.abs(F.col("value") - F.col("pv")) <= 25 + 0.001 * dt)
    return c.groupBy("user_id").agg(F.count("*").alias("candidates"), F.count_if(ok).alias("links"))


SPANS = "SELECT user_id, event_type, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS b FROM events"
MERGE_SQL = """r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached + 900 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)"""


def spans(t: Tables) -> DataFrame:
    s = F.call_function("div", fn.micros(F.col("ts")), F.lit(1_000_000))
    return t.events.select("user_id", "event_type", s.alias("a"), (s + F.floor(F.col("value") * 60)).alias("b"))


@query("w02_merged_events", f"""
WITH s AS ({SPANS}), {MERGE_SQL} SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS parts FROM g GROUP BY user_id, run""")
def w02(t: Tables) -> DataFrame:
    return ordered.merge_intervals(spans(t), BY_USER, "a", "b", 900)


@query("w03_dual_epoch_links", """
WITH d AS (SELECT o_custkey, o_orderdate, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT *, lag(m) OVER w AS pm, lag(o_orderdate) OVER w AS pd FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate))
SELECT o_custkey, count(*) FILTER (abs(m - pm) <= 50000 AND datediff('day', pd, o_orderdate) <= 120) AS links FROM l GROUP BY 1""")
def w03(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.avg("o_totalprice").alias("m"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    l = d.withColumns({"pm": F.lag("m").over(w), "pd": F.lag("o_orderdate").over(w)})
    ok = (F.abs(F.col("m") - F.col("pm")) <= 50000) & (F.datediff("o_orderdate", "pd") <= 120)
    return l.groupBy("o_custkey").agg(F.count_if(ok).alias("links"))


@query("w04_dual_slopes", """
WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER w AS dq, l_extendedprice - lag(l_extendedprice) OVER w AS dp FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT l_suppkey, count(*) FILTER (abs(dq) <= 15 AND abs(dp) <= 15000 AND abs(dp / 1000 - dq) <= 10) AS links, count(*) AS n FROM l GROUP BY 1""")
def w04(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    dq, dp = F.col("l_quantity") - F.lag("l_quantity").over(w), F.col("l_extendedprice") - F.lag("l_extendedprice").over(w)
    l = t.lineitem.select("l_suppkey", dq.alias("dq"), dp.alias("dp"))
    ok = (F.abs("dq") <= 15) & (F.abs("dp") <= 15000) & (F.abs(F.col("dp") / 1000 - F.col("dq")) <= 10)
    return l.groupBy("l_suppkey").agg(F.count_if(ok).alias("links"), F.count("*").alias("n"))


@query("w05_time_continuity", """
WITH l AS (SELECT user_id, event_type, value - lag(value) OVER w AS dv, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS n, count(*) FILTER (abs(dv / dt) <= 0.001) AS typical, count(*) FILTER (abs(dv / dt) <= 0.01) AS plausible FROM l WHERE dt > 0 GROUP BY ALL""")
def w05(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    us = fn.micros(F.col("ts"))
    l = t.events.withColumn("us", us).select("user_id", "event_type", (F.col("value") - F.lag("value").over(w)).alias("dv"), ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("dt")).where("dt > 0")
    slew = F.abs(F.col("dv") / F.col("dt"))
    return l.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(slew <= 0.001).alias("typical"), F.count_if(slew <= 0.01).alias("plausible"))


@query("w06_interval_union", f"""
WITH s AS ({SPANS}), {MERGE_SQL} SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS parts, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS reasons FROM g GROUP BY user_id, run""")
def w06(t: Tables) -> DataFrame:
    merged = ordered.merge_intervals(spans(t), BY_USER, "a", "b", 900, "event_type")
    return merged.select("user_id", "a", "b", "parts", F.array_join("event_types", "+").alias("reasons"))


@query("w07_interval_coverage", f"""
WITH s AS ({SPANS}), c AS (SELECT user_id, greatest(a, 1704067200)::DOUBLE AS a, least(b, 1706659200)::DOUBLE AS b FROM s WHERE greatest(a, 1704067200) < least(b, 1706659200)),
p AS (SELECT *, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1704067200) AS reached FROM c)
SELECT user_id, round(sum(greatest(0, b - greatest(a, reached))) / 2592000.0, 9) AS coverage FROM p GROUP BY 1""")
def w07(t: Tables) -> DataFrame:
    covered = ordered.coverage(spans(t).withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")}), BY_USER, "a", "b", 1704067200.0, 1706659200.0)
    return covered.select("user_id", F.round("coverage", 9).alias("coverage"))


@query("w09_hop_segments", """
WITH j AS (SELECT user_id, event_id, value, ts, CASE WHEN abs(value - lag(value) OVER w) > 60 THEN 1 ELSE 0 END AS hop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(hop) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM j)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM g GROUP BY ALL HAVING count(*) >= 5""")
def w09(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hop = F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) > 60, F.lit(False)).cast("int")
    g = t.events.withColumn("hop", hop).withColumn("segment", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n >= 5")


@query("w10_transitions", """
SELECT event_id, user_id, round(value - prev, 6) AS step FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE abs(value - prev) >= 100""")
def w10(t: Tables) -> DataFrame:
    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    step = F.col("value") - F.col("prev")
    return t.events.withColumn("prev", prev).where(F.abs(step) >= 100).select("event_id", "user_id", F.round(step, 6).alias("step"))


@query("w11_transient_guard", """
WITH x AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase')
SELECT p.event_id, min(abs(p.us - x.us)) // 1000000 AS nearest, count(*) FILTER (abs(p.us - x.us) <= 3600000000) AS inside FROM p JOIN x USING (user_id) WHERE abs(p.us - x.us) <= 86400000000 GROUP BY 1""")
def w11(t: Tables) -> DataFrame:
    from orrery.operators.joins import within

    e = t.events.withColumn("us", fn.micros(F.col("ts")))
    near = within(e.where("event_type = 'purchase'").select("user_id", "event_id", "us"), e.where("event_type = 'error'").select("user_id", F.col("us").alias("x")), ["user_id"], "us", "x", 86_400_000_000)
    gap = F.abs(F.col("us") - F.col("x"))
    return near.groupBy("event_id").agg(F.call_function("div", F.min(gap), F.lit(1_000_000)).alias("nearest"), F.count_if(gap <= 3_600_000_000).alias("inside"))


@query("w12_phase_lock", """
WITH m AS (SELECT l_suppkey, median(l_quantity) AS med FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN abs(l_quantity - med) <= 10 THEN 1.0 ELSE 0.0 END), 9) AS near, avg(CASE WHEN abs(l_quantity - med) <= 10 THEN 1.0 ELSE 0.0 END) >= 0.4 AS locked FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def w12(t: Tables) -> DataFrame:
    med = t.lineitem.groupBy("l_suppkey").agg(F.median("l_quantity").alias("med"))
    near = F.avg((F.abs(F.col("l_quantity") - F.col("med")) <= 10).cast("double"))
    return t.lineitem.join(med, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(near, 9).alias("near"), (near >= 0.4).alias("locked"))


@query("w13_activity_windows", """
WITH r AS (SELECT user_id, event_id, ts, value > 30 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM r WHERE on_)
SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM g GROUP BY user_id, run HAVING count(*) >= 3""")
def w13(t: Tables) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    on = t.events.withColumn("i", i).where("value > 30")
    run = F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i"))
    return on.withColumn("run", run).groupBy("user_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).where("n >= 3").drop("run")


@query("w14_margin_gate", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, lead(o_totalprice) OVER w AS second, row_number() OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey))
SELECT o_custkey, o_orderkey, o_totalprice, second, round(second - o_totalprice, 4) AS margin, o_totalprice <= 50000 AND coalesce(second - o_totalprice >= 10000, true) AS passed FROM r WHERE p = 1""")
def w14(t: Tables) -> DataFrame:
    return ordered.margin_gate(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey", 10000, 50000).withColumn("margin", F.round("margin", 4))


@query("w15_temporal_split", """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER w AS lo, max(epoch_us(ts)) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, count(*) FILTER (us <= lo + 0.7 * (hi - lo)) AS train, count(*) FILTER (us > lo + 0.7 * (hi - lo)) AS holdout FROM s GROUP BY 1""")
def w15(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    s = t.events.withColumn("us", fn.micros(F.col("ts"))).withColumns({"lo": F.min("us").over(w), "hi": F.max("us").over(w)})
    train = F.col("us") <= F.col("lo") + 0.7 * (F.col("hi") - F.col("lo"))
    return s.groupBy("user_id").agg(F.count_if(train).alias("train"), F.count_if(~train).alias("holdout"))


@query("w16_retention", """
WITH pins AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_discount >= 0.1), r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM pins))
SELECT o_orderkey, o_orderstatus FROM r WHERE p > 500""")
def w16(t: Tables) -> DataFrame:
    pins = t.lineitem.where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    free = t.orders.join(pins, "o_orderkey", "left_anti")
    p = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return free.withColumn("p", p).where("p > 500").select("o_orderkey", "o_orderstatus")


@query("w17_annotated_picks", """
WITH b AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) ORDER BY value DESC, event_id) AS p FROM events)
SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM b WHERE p = 1 ORDER BY value DESC, event_id LIMIT 16""")
def w17(t: Tables) -> DataFrame:
    day = F.floor(fn.micros(F.col("ts")) / 86_400e6)
    best = ordered.newest(t.events.withColumn("day", day), ["user_id", "day"], [F.desc("value"), "event_id"])
    top = best.orderBy(F.desc("value"), "event_id").limit(16)
    return top.select("event_id", "value", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")).cast("long").alias("place"))  # 16 rows


@query("w18_non_maximum_suppression", """
WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM events),
g AS (SELECT user_id, i, event_id, true AS chosen, [us] AS kept FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, len(list_filter(g.kept, lambda k: abs(k - e.us) <= 21600000000)) = 0,
    CASE WHEN len(list_filter(g.kept, lambda k: abs(k - e.us) <= 21600000000)) = 0 THEN list_append(g.kept, e.us) ELSE g.kept END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT event_id, user_id, value FROM g JOIN events USING (event_id, user_id) WHERE chosen""")
def w18(t: Tables) -> DataFrame:
    from orrery.operators.selection import suppressed

    e = t.events.select("event_id", "user_id", "value", fn.micros(F.col("ts")).alias("us"))
    return suppressed(e, "event_id", ["user_id"], [("us", 21_600_000_000)], [-F.col("value")]).select("event_id", "user_id", "value")


NEAR3 = "abs(k.d - n.d) < 172800 AND abs(k.f - n.f) < 10 AND abs(k.r - n.r) < 4"


@query("w18_three_ways", f"""
WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS s, epoch_us(ts) / 1e6 AS d, value AS f, user_id AS r, (event_id * 7919) % 1009 AS v FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, id) AS i FROM e),
g AS (SELECT s, i, id, true AS chosen, [{{'d': d, 'f': f, 'r': r}}] AS kept FROM n WHERE i = 1
  UNION ALL SELECT n.s, n.i, n.id, len(list_filter(g.kept, lambda k: {NEAR3})) = 0,
    CASE WHEN len(list_filter(g.kept, lambda k: {NEAR3})) = 0 THEN list_append(g.kept, {{'d': n.d, 'f': n.f, 'r': n.r}}) ELSE g.kept END FROM g JOIN n ON n.s = g.s AND n.i = g.i + 1),
k AS (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY i) AS place FROM g WHERE chosen)
SELECT s AS event_type, id, place FROM k WHERE place <= 32""")
def w18_three_ways(t: Tables) -> DataFrame:
    from orrery.operators.selection import suppressed

    e = t.events.select("event_type", F.col("event_id").alias("id"), (fn.micros(F.col("ts")) / 1e6).alias("d"), F.col("value").alias("f"), F.col("user_id").alias("r"), ((F.col("event_id") * 7919) % 1009).alias("v"))
    kept = suppressed(e, "id", ["event_type"], [("d", 172_800), ("f", 10), ("r", 4)], [-F.col("v")], strict=True)
    return ordered.newest(kept, ["event_type"], [F.desc("v"), "id"], 32, "place").select("event_type", "id", F.col("place").cast("long").alias("place"))


@query("w19_simultaneity", """
SELECT o_orderdate, o_orderstatus, a, b, round(a - b, 4) AS skew, CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN a IS NULL OR b IS NULL THEN 'one' WHEN abs(a - b) <= 50000 THEN 'together' ELSE 'apart' END AS verdict FROM (
  SELECT o_orderdate, o_orderstatus, min(o_totalprice) FILTER (o_custkey % 2 = 0) AS a, min(o_totalprice) FILTER (o_custkey % 2 = 1) AS b FROM orders GROUP BY ALL)""")
def w19(t: Tables) -> DataFrame:
    side = lambda k: F.min(F.when(F.col("o_custkey") % 2 == k, F.col("o_totalprice")))
    g = t.orders.groupBy("o_orderdate", "o_orderstatus").agg(side(0).alias("a"), side(1).alias("b"))
    a, b = F.col("a"), F.col("b")
    verdict = F.when(a.isNull() & b.isNull(), "neither").when(a.isNull() | b.isNull(), "one").when(F.abs(a - b) <= 50000, "together").otherwise("apart")
    return g.select("o_orderdate", "o_orderstatus", "a", "b", F.round(a - b, 4).alias("skew"), verdict.alias("verdict"))


@query("w20_next_window", """
SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS next FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice >= 20000 GROUP BY 1""")
def w20(t: Tables) -> DataFrame:
    open_ = t.orders.where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00' and o_totalprice >= 20000")
    return open_.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next"))


@query("w23_gap_clusters", """
WITH j AS (SELECT user_id, value, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 7200000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM j)
SELECT user_id, CAST(c AS BIGINT) AS cluster, count(*) AS n, round(least(greatest(max(value) - min(value), 5), 200), 6) AS spread FROM g GROUP BY ALL""")
def w23(t: Tables) -> DataFrame:
    e = t.events.withColumn("us", fn.micros(F.col("ts")))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = ordered.islands(e, BY_USER, ["ts", "event_id"], gap > 7_200_000_000, "cluster")
    return g.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.round(fn.clamp(F.max("value") - F.min("value"), 5.0, 200.0), 6).alias("spread"))


@query("t01_newest_listing", """
SELECT event_id, user_id FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS start FROM events) ORDER BY start DESC NULLS LAST, event_id DESC LIMIT 100""")
def t01(t: Tables) -> DataFrame:
    start = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return t.events.orderBy(start.desc_nulls_last(), F.desc("event_id")).limit(100).select("event_id", "user_id")


@query("t02_detail_by_key", """
SELECT * FROM orders WHERE o_orderkey = 77 AND o_orderdate >= TIMESTAMP '1990-01-01'""")
def t02(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 77 and o_orderdate >= timestamp_ntz '1990-01-01 00:00:00'")


@query("t03_strongest", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50""")
def t03(t: Tables) -> DataFrame:
    return t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("t04_representative_examples", """
WITH q AS (SELECT unnest([0.05, 0.5, 0.99]) AS f), x AS (SELECT f, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.99) AS c FROM q, events GROUP BY f),
d AS (SELECT f, event_id, value, row_number() OVER (PARTITION BY f ORDER BY abs(value - CASE f WHEN 0.05 THEN a WHEN 0.5 THEN b ELSE c END), event_id) AS p FROM x, events)
SELECT CAST(f AS DOUBLE) AS f, event_id, value FROM d WHERE p = 1""")
def t04(t: Tables) -> DataFrame:
    marks = t.events.agg(*(F.percentile("value", F.lit(f)).alias(f"q{i}") for i, f in enumerate((0.05, 0.5, 0.99))))
    at = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"q{i}").alias("q")) for i, f in enumerate((0.05, 0.5, 0.99)))))
    targets = marks.select(at.alias("m")).select("m.*")
    near = t.events.select("event_id", "value").join(F.broadcast(targets))  # three rows
    return near.groupBy("f").agg(F.min_by(F.struct("event_id", "value"), F.struct(F.abs(F.col("value") - F.col("q")), "event_id")).alias("b")).select("f", "b.event_id", "b.value")


@query("t05_top_five_each", """
SELECT l_suppkey, l_orderkey, l_linenumber, p FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS p FROM lineitem) WHERE p <= 5""")
def t05(t: Tables) -> DataFrame:
    top = ordered.newest(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5, "p")
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("p").cast("long").alias("p"))


@query("t06_region_ranking", """
WITH r AS (SELECT n_regionkey, c_nationkey, median(c_acctbal) AS med, stddev_pop(c_acctbal) AS sd, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT c_nationkey, n_regionkey, round(med - 0.1 * sd, 6) AS score FROM r ORDER BY score DESC, c_nationkey LIMIT 10 OFFSET 3""")
def t06(t: Tables) -> DataFrame:
    r = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.median("c_acctbal").alias("med"), F.stddev_pop("c_acctbal").alias("sd"))
    scored = r.select("c_nationkey", "n_regionkey", F.round(F.col("med") - 0.1 * F.col("sd"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "c_nationkey").offset(3).limit(10)


@query("t07_schedule_order", """
SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 - 300 AS starts, epoch_us(o_orderdate) // 1000000 + 300 AS stops FROM orders WHERE o_orderstatus = 'P' ORDER BY starts, o_orderkey""")
def t07(t: Tables) -> DataFrame:
    s = F.call_function("div", fn.micros(F.col("o_orderdate")), F.lit(1_000_000))
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey", (s - 300).alias("starts"), (s + 300).alias("stops")).orderBy("starts", "o_orderkey")


@query("t08_upcoming", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 16""")
def t08(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= timestamp_ntz '1997-06-01 00:00:00'").orderBy("o_orderdate", "o_orderkey").limit(16).select("o_orderkey", "o_custkey")


@query("u01_union_of_links", """
SELECT 'cross' AS kind, l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.09 UNION ALL SELECT 'dual', l_orderkey, l_linenumber FROM lineitem WHERE l_tax >= 0.07 UNION ALL SELECT 'own', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 48""")
def u01(t: Tables) -> DataFrame:
    kinds = {"cross": "l_discount >= 0.09", "dual": "l_tax >= 0.07", "own": "l_quantity >= 48"}
    found = F.filter(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in kinds.items())), lambda k: k.isNotNull())
    return t.lineitem.select(F.explode(found).alias("kind"), "l_orderkey", "l_linenumber")  # one scan for all three


@query("u02_key_sets", """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT 'both' AS side, l_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', l_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', l_partkey FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u02(t: Tables) -> DataFrame:
    a, b = (t.lineitem.where(f"l_returnflag = '{k}'").select("l_partkey").distinct() for k in "RA")
    named = lambda df, side: df.select(F.lit(side).alias("side"), "l_partkey")
    return named(a.intersect(b), "both").union(named(a.join(b, "l_partkey", "left_anti"), "only_a")).union(named(b.join(a, "l_partkey", "left_anti"), "only_b"))


@query("u03_parity_both_ways", """
WITH a AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 3) AS v FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice - CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice * l_discount END, 3) AS v FROM lineitem)
SELECT 'left' AS side, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, round(v, 0) FROM a EXCEPT ALL SELECT l_orderkey, l_linenumber, round(v, 0) FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT l_orderkey, l_linenumber, round(v, 0) FROM b EXCEPT ALL SELECT l_orderkey, l_linenumber, round(v, 0) FROM a)""")
def u03(t: Tables) -> DataFrame:
    from orrery.operators.currency import parity

    x, d = F.col("l_extendedprice"), F.col("l_discount")
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.round(fn.rounded_half_up(x * (1 - d), 3), 0).alias("v"))
    b = t.lineitem.select("l_orderkey", "l_linenumber", F.round(fn.rounded_half_up(x - F.when(F.col("l_linenumber") == 7, 0.0).otherwise(x * d), 3), 0).alias("v"))
    return parity(a, b)


@query("u04_union_by_name", """
SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier""")
def u04(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("u05_distinct_identities", """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS ids FROM lineitem GROUP BY 1""")
def u05(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    return g.select("l_orderkey", F.size("s").cast("long").alias("suppliers"), F.array_join("s", ",").alias("ids"))


@query("u06_recent_merge", """
WITH u AS (SELECT o_orderkey AS id, o_orderdate AS seen, 0 AS kind FROM orders UNION ALL SELECT l_orderkey, l_shipdate, 1 FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, kind) AS p FROM u)
SELECT id, kind FROM r WHERE p = 1 ORDER BY seen DESC, id LIMIT 200""")
def u06(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit(0).alias("kind"))
    b = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.lit(1).alias("kind"))
    one = ordered.newest(a.unionByName(b), ["id"], [F.desc("at"), "kind"])
    return one.orderBy(F.desc("at"), "id").limit(200).select("id", "kind")
