"""J: joins. Snapshots are a customer's orders, instants are events or line items, radios are the parity of user_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.operators import joins, ordered
from orrery.plans.registry import Tables, query

DAY = 86_400


def day_number(ts: Column) -> Column:
    return F.call_function("div", fn.micros(ts), F.lit(DAY * 1_000_000))


def whole_seconds(ts: Column) -> Column:
    return F.call_function("div", fn.micros(ts), F.lit(1_000_000))


CURRENT = "current_orders AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1)"


def current_orders(t: Tables) -> DataFrame:
    return ordered.newest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("j01_current_run", f"WITH {CURRENT} SELECT o_custkey, o_orderkey, o_totalprice FROM current_orders")
def j01(t: Tables) -> DataFrame:
    return current_orders(t).select("o_custkey", "o_orderkey", "o_totalprice")


@query("j02_current_records", f"WITH {CURRENT} SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN current_orders ON l_orderkey = o_orderkey")
def j02(t: Tables) -> DataFrame:
    return t.lineitem.join(current_orders(t).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("j03_probes_view", f"""WITH {CURRENT}
SELECT n_name, count(*) AS probes, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN current_orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def j03(t: Tables) -> DataFrame:
    rows = t.lineitem.join(current_orders(t), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("probes"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("j04_sidecar_left_joins", """
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1), r AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_tax >= 0.07 GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS links, q FROM orders LEFT JOIN l ON o_orderkey = l.l_orderkey LEFT JOIN r ON o_orderkey = r.l_orderkey""")
def j04(t: Tables) -> DataFrame:
    l = t.lineitem.where("l_discount >= 0.09").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    r = t.lineitem.where("l_tax >= 0.07").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return t.orders.select("o_orderkey").join(l, "o_orderkey", "left").join(r, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("links"), "q")


@query("j05_provider_identity", """
WITH b AS (SELECT l_orderkey, l_returnflag AS provider, arg_min(l_suppkey, struct_pack(p := -l_extendedprice, s := l_suppkey)) AS best FROM lineitem WHERE l_discount >= 0.02 GROUP BY ALL)
SELECT l_orderkey, count(*) AS providers, CASE WHEN count(*) > 1 THEN CAST(count(DISTINCT best) = 1 AS INTEGER) END AS agree, max(best) FILTER (provider = 'R') AS best_r FROM b GROUP BY 1""")
def j05(t: Tables) -> DataFrame:
    best = t.lineitem.where("l_discount >= 0.02").groupBy("l_orderkey", F.col("l_returnflag").alias("provider")).agg(F.min_by("l_suppkey", F.struct(-F.col("l_extendedprice"), "l_suppkey")).alias("best"))
    g = best.groupBy("l_orderkey").agg(F.count("*").alias("providers"), F.count_distinct("best").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("provider", "best"))).alias("m"))
    return g.select("l_orderkey", "providers", F.when(F.col("providers") > 1, (F.col("kinds") == 1).cast("int")).alias("agree"), F.try_element_at("m", F.lit("R")).alias("best_r"))


@query("j06_provider_comparison", """
WITH a AS (SELECT * FROM lineitem WHERE l_tax < 0.06), b AS (SELECT * FROM lineitem WHERE l_tax > 0.02)
SELECT 'both' AS side, count(*) AS n, round(avg(a.l_extendedprice), 4) AS mean FROM a JOIN b USING (l_orderkey, l_linenumber)
UNION ALL SELECT 'only_a', count(*), round(avg(l_extendedprice), 4) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)
UNION ALL SELECT 'only_b', count(*), round(avg(l_extendedprice), 4) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)""")
def j06(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    a, b = t.lineitem.where("l_tax < 0.06").select(*keys, "l_extendedprice"), t.lineitem.where("l_tax > 0.02").select(*keys, "l_extendedprice")
    told = lambda df, side: df.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean")).select(F.lit(side).alias("side"), "n", "mean")
    return told(a.join(b.select(*keys), keys), "both").union(told(a.join(b, keys, "left_anti"), "only_a")).union(told(b.join(a, keys, "left_anti"), "only_b"))


@query("j07_as_of_available", """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey % 1500 AS k, l_shipdate FROM lineitem), o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, o_orderkey FROM i ASOF LEFT JOIN o ON o_custkey = k AND l_shipdate >= o_orderdate""")
def j07(t: Tables) -> DataFrame:
    i = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1500).alias("k"), "l_shipdate")
    newest = t.orders.groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.as_of(i, newest, ["k"], "l_shipdate", "o_orderdate", ["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderkey")


@query("j08_nearest_epoch", """
WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 - 820454400 AS s FROM events), o AS (SELECT o_custkey, epoch_us(o_orderdate) // 1000000 AS os, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, os, o_orderkey FROM (SELECT event_id, os, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY abs(s - os), os) AS p FROM i JOIN o ON o_custkey = user_id) WHERE p = 1""")
def j08(t: Tables) -> DataFrame:
    i = t.events.select("event_id", F.col("user_id").alias("k"), (whole_seconds(F.col("ts")) - 820454400).alias("s"))
    o = t.orders.groupBy(F.col("o_custkey").alias("k"), whole_seconds(F.col("o_orderdate")).alias("os")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.nearest(i, o, ["k"], "s", "os", ["o_orderkey"]).where("os is not null").select("event_id", "os", "o_orderkey")


@query("j09_latest_with_age", """
SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest, datediff('day', max(o_orderdate), TIMESTAMP '1998-12-31') <= 365 AS fresh FROM orders GROUP BY 1""")
def j09(t: Tables) -> DataFrame:
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.max("o_orderdate"))
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), (age <= 365).alias("fresh"))


@query("j10_history_range", """
SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""")
def j10(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate between timestamp_ntz '1996-01-01 00:00:00' and timestamp_ntz '1996-12-31 00:00:00'").select("o_custkey", "o_orderkey")


@query("j11_by_name", """
SELECT lower(p_name) AS name, min(p_partkey) AS p_partkey, count(*) AS n, count(*) > 1 AS ambiguous FROM part WHERE p_brand = 'Brand#13' GROUP BY 1""")
def j11(t: Tables) -> DataFrame:
    return t.part.where("p_brand = 'Brand#13'").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n"), (F.count("*") > 1).alias("ambiguous"))


PASSES = "passes AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 AS b FROM orders)"


def passes(t: Tables) -> DataFrame:
    a = day_number(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", "o_custkey", a.alias("a"), (a + 20).alias("b"))


@query("j12_points_in_intervals", f"""WITH {PASSES}, i AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, epoch_us(l_shipdate) // 86400000000 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, o_orderkey, d - a AS into_pass FROM i JOIN passes ON o_custkey = k AND d BETWEEN a AND b""")
def j12(t: Tables) -> DataFrame:
    i = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("o_custkey"), day_number(F.col("l_shipdate")).alias("d"))
    found = joins.contained(i, passes(t), ["o_custkey"], "d", "a", "b", 32)
    return found.select("l_orderkey", "l_linenumber", "o_orderkey", (F.col("d") - F.col("a")).alias("into_pass"))


@query("j13_interval_overlaps", f"""WITH {PASSES}, q AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, epoch_us(l_shipdate) // 86400000000 AS c, epoch_us(l_shipdate) // 86400000000 + CAST(l_quantity AS BIGINT) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, o_orderkey, shared FROM (SELECT l_orderkey, l_linenumber, o_orderkey, least(b, d) - greatest(a, c) AS shared, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY least(b, d) - greatest(a, c) DESC, o_orderkey) AS p FROM q JOIN passes ON o_custkey = k AND a <= d AND c <= b) WHERE p = 1""")
def j13(t: Tables) -> DataFrame:
    c = day_number(F.col("l_shipdate"))
    q = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("o_custkey"), c.alias("c"), (c + F.col("l_quantity").cast("long")).alias("d"))
    met = joins.overlapping(q, passes(t), ["o_custkey"], ("c", "d"), ("a", "b"), 32).withColumn("shared", F.least("b", "d") - F.greatest("a", "c"))
    best = met.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.struct("o_orderkey", "shared"), F.struct("shared", -F.col("o_orderkey"))).alias("x"))
    return best.select("l_orderkey", "l_linenumber", "x.o_orderkey", "x.shared")


@query("j14_hardware_epochs", """
WITH e AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT event_id, o_orderkey FROM events JOIN e ON o_custkey = user_id AND ts - INTERVAL 10000 DAY >= a AND ts - INTERVAL 10000 DAY < coalesce(b, TIMESTAMP '2100-01-01')""")
def j14(t: Tables) -> DataFrame:
    i = t.events.select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("interval 10000 days")).alias("at"))
    o = t.orders.groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.as_of(i, o, ["k"], "at", "o_orderdate", ["o_orderkey"]).where("o_orderkey is not null").select("event_id", "o_orderkey")


SWEEPS = "s AS (SELECT CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS sweep, user_id % 2 AS radio, event_type, max(value) AS v FROM events GROUP BY ALL)"


def sweeps(t: Tables) -> DataFrame:
    """The largest value of each hour, radio (parity) and tuning (event type)."""
    hour = F.floor(fn.micros(F.col("ts")) / 3600e6)
    return t.events.groupBy(hour.alias("sweep"), (F.col("user_id") % 2).alias("radio"), "event_type").agg(F.max("value").alias("v"))


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = sweeps(t)
    return tuple(s.where(f"radio = {r}").select("sweep", "event_type", F.col("v").alias(n)) for r, n in ((0, "a"), (1, "b")))


@query("j15_paired_sweeps", f"""WITH {SWEEPS}, n AS (SELECT sweep, count(DISTINCT radio) AS radios, count(*) AS cells FROM s GROUP BY 1)
SELECT CASE radios WHEN 2 THEN 'paired' ELSE 'single' END AS kind, count(*) AS sweeps, CAST(sum(cells) AS BIGINT) AS cells FROM n GROUP BY 1""")
def j15(t: Tables) -> DataFrame:
    n = sweeps(t).groupBy("sweep").agg(F.count_distinct("radio").alias("radios"), F.count("*").alias("cells"))
    return n.groupBy(F.when(F.col("radios") == 2, "paired").otherwise("single").alias("kind")).agg(F.count("*").alias("sweeps"), F.sum("cells").alias("cells"))


@query("j16_instant_join", f"""WITH {SWEEPS} SELECT x.sweep, x.event_type, x.v AS a, y.v AS b FROM s x JOIN s y ON x.sweep = y.sweep AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1""")
def j16(t: Tables) -> DataFrame:
    a, b = sides(t)
    return a.join(b, ["sweep", "event_type"])


@query("j17_shifted_control", f"""WITH {SWEEPS} SELECT x.event_type, count(*) AS n, count(*) FILTER (x.v > 60 AND y.v > 60) AS both_fired FROM s x JOIN s y ON y.sweep = x.sweep + 2 AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1 GROUP BY 1""")
def j17(t: Tables) -> DataFrame:
    a, b = sides(t)
    pairs = a.join(b.withColumn("sweep", F.col("sweep") - 2), ["sweep", "event_type"])
    return pairs.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if((F.col("a") > 60) & (F.col("b") > 60)).alias("both_fired"))


@query("j18_scrambled_donor", f"""WITH {SWEEPS}, d AS (SELECT DISTINCT event_type, sweep FROM s WHERE radio = 0 AND EXISTS (SELECT 1 FROM s y WHERE y.sweep = s.sweep AND y.event_type = s.event_type AND y.radio = 1)),
r AS (SELECT event_type, sweep, coalesce(lead(sweep) OVER w, first_value(sweep) OVER w) AS donor, count(*) OVER (PARTITION BY event_type) AS n FROM d WINDOW w AS (PARTITION BY event_type ORDER BY sweep))
SELECT r.event_type, r.sweep, r.donor, x.v AS a, y.v AS b FROM r JOIN s x ON x.sweep = r.sweep AND x.event_type = r.event_type AND x.radio = 0 JOIN s y ON y.sweep = r.donor AND y.event_type = r.event_type AND y.radio = 1 WHERE n > 1""")
def j18(t: Tables) -> DataFrame:
    a, b = sides(t)
    both = a.join(b, ["sweep", "event_type"])
    ring = Window.partitionBy("event_type")
    w = ring.orderBy("sweep")
    donor = F.coalesce(F.lead("sweep").over(w), F.first("sweep").over(w))
    r = both.select("event_type", "sweep", "a").withColumns({"donor": donor, "n": F.count("*").over(ring)}).where("n > 1")
    donors = both.select("event_type", F.col("sweep").alias("donor"), "b")
    return r.join(donors, ["event_type", "donor"]).select("event_type", "sweep", "donor", "a", "b")


@query("j19_cross_receiver", f"""WITH {SWEEPS}, p AS (SELECT sweep, event_type, max(v) FILTER (radio = 0) AS a, max(v) FILTER (radio = 1) AS b FROM s GROUP BY ALL)
SELECT event_type, count(*) AS n, count(*) FILTER (least(abs(a - b) % 100, 100 - abs(a - b) % 100) <= 10) AS near FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def j19(t: Tables) -> DataFrame:
    side = lambda r: F.max(F.when(F.col("radio") == r, F.col("v")))
    p = sweeps(t).groupBy("sweep", "event_type").agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    return p.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(fn.wrapped_gap(F.col("a"), F.col("b"), 100.0) <= 10).alias("near"))


@query("j20_cross_edge", """
WITH e AS (SELECT l_orderkey, l_linestatus, l_suppkey, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT x.l_suppkey, count(*) AS n, count(*) FILTER (abs(x.v * 1.02 - y.v) <= 15000) AS agree FROM e x JOIN e y ON x.l_suppkey = y.l_suppkey AND x.l_orderkey % 200 = y.l_orderkey % 200 AND x.l_linestatus = 'F' AND y.l_linestatus = 'O' GROUP BY 1""")
def j20(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy("l_orderkey", "l_linestatus", "l_suppkey").agg(F.max("l_extendedprice").alias("v")).withColumn("m", F.col("l_orderkey") % 200)
    x, y = e.where("l_linestatus = 'F'").select("l_suppkey", "m", F.col("v").alias("a")), e.where("l_linestatus = 'O'").select("l_suppkey", "m", F.col("v").alias("b"))
    pairs = x.join(y, ["l_suppkey", "m"])
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") * 1.02 - F.col("b")) <= 15000).alias("agree"))


@query("j21_band_join", """
SELECT event_id, count(*) AS n, arg_min(p_partkey, struct_pack(d := abs(value * 5 - p_retailprice), k := p_partkey)) AS nearest FROM events JOIN part ON abs(value * 5 - p_retailprice) <= 0.5 GROUP BY 1""")
def j21(t: Tables) -> DataFrame:
    """Equal prices are one entry with its count and smallest key: pairs grow with the prices in reach, not with the parts."""
    e = t.events.select("event_id", (F.col("value") * 5).alias("v"))
    prices = t.part.groupBy("p_retailprice").agg(F.count("*").alias("c"), F.min("p_partkey").alias("p_partkey"))
    near = joins.within(e, prices, [], "v", "p_retailprice", 0.5)
    gap = F.abs(F.col("v") - F.col("p_retailprice"))
    return near.groupBy("event_id").agg(F.sum("c").alias("n"), F.min_by("p_partkey", F.struct(gap, "p_partkey")).alias("nearest"))


TRACKS = "tr AS (SELECT user_id, user_id % 2 AS rx, event_type, min(epoch_us(ts) // 1000000) AS a, max(epoch_us(ts) // 1000000) AS b, avg(value) AS m FROM events GROUP BY user_id, event_type, CAST(floor(epoch_us(ts) / 864e8) AS BIGINT))"


def tracks(t: Tables) -> DataFrame:
    """A user's events of a day and type; means are exact, so equal tracks have equal ones and their ties go by key."""
    s = whole_seconds(F.col("ts"))
    day = F.floor(fn.micros(F.col("ts")) / 864e8)
    return t.events.groupBy("user_id", "event_type", day.alias("day")).agg(F.min(s).alias("a"), F.max(s).alias("b"), fn.exact_mean(F.col("value")).alias("m")).withColumn("rx", F.col("user_id") % 2)


def tracks_in_order(t: Tables) -> DataFrame:
    """As tracks(), but a mean is that of the SQL to the last bit where events are stored by event_id: doubles added in that order, not an exact sum.

    Gates and ties on these means fall as the SQL's do. Equal values in another order may have another mean, there as here.
    """
    keys = ["user_id", "event_type", "day"]
    events = t.events.select("user_id", "event_type", F.floor(fn.micros(F.col("ts")) / 864e8).alias("day"), "event_id", "value", whole_seconds(F.col("ts")).alias("s"))
    added = fn.summed_in_order(events, keys, ["event_id", "value"], "value", "sum")
    mean = F.max_by("sum", "sum_place") / F.nullif(F.count("value"), F.lit(0).cast("long"))
    return added.groupBy(*keys).agg(F.min("s").alias("a"), F.max("s").alias("b"), mean.alias("m")).withColumn("rx", F.col("user_id") % 2)


@query("j22_track_pairs", f"""WITH {TRACKS}, o AS (SELECT x.user_id AS xu, y.user_id AS yu, x.event_type, x.a AS xa, y.a AS ya, (least(x.b, y.b) - greatest(x.a, y.a)) / nullif(greatest(x.b, y.b) - least(x.a, y.a), 0)::DOUBLE AS iou, abs(x.m - y.m) AS d FROM tr x JOIN tr y ON x.event_type = y.event_type AND x.rx = 0 AND y.rx = 1 AND x.a <= y.b AND y.a <= x.b)
SELECT event_type, count(*) AS pairs, count(*) FILTER (iou >= 0.3 AND d <= 20) AS gated, round(avg(iou), 6) AS iou FROM o WHERE iou IS NOT NULL GROUP BY 1""")
def j22(t: Tables) -> DataFrame:
    tr = tracks_in_order(t)
    x = tr.where("rx = 0").select("event_type", F.col("user_id").alias("xu"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("m").alias("xm"))
    y = tr.where("rx = 1").select("event_type", F.col("user_id").alias("yu"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("m").alias("ym"))
    met = joins.overlapping(x, y, ["event_type"], ("xa", "xb"), ("ya", "yb"), 43_200)
    whole = F.greatest("xb", "yb") - F.least("xa", "ya")
    met = met.where(whole > 0).withColumn("iou", (F.least("xb", "yb") - F.greatest("xa", "ya")) / whole)
    ok = (F.col("iou") >= 0.3) & (F.abs(F.col("xm") - F.col("ym")) <= 20)
    return met.groupBy("event_type").agg(F.count("*").alias("pairs"), F.count_if(ok).alias("gated"), F.round(F.avg("iou"), 6).alias("iou"))


@query("j23_offset_consensus", """
WITH s AS (SELECT x.event_type, x.event_id, x.value, count(*) AS support FROM events x JOIN events y ON x.event_type = y.event_type AND x.user_id = y.user_id AND abs(x.value - y.value) <= 5 GROUP BY ALL),
b AS (SELECT event_type, arg_max(value, struct_pack(s := support, k := -event_id)) AS centre FROM s GROUP BY 1)
SELECT s.event_type, round(centre, 6) AS centre, count(*) AS kept, round(median(value), 6) AS median FROM s JOIN b USING (event_type) WHERE abs(value - centre) <= 5 GROUP BY ALL""")
def j23(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "user_id", "event_id", "value")
    near = joins.within(e, e.select("event_type", "user_id", F.col("value").alias("y")), ["event_type", "user_id"], "value", "y", 5)
    support = near.groupBy("event_type", "event_id", "value").agg(F.count("*").alias("support"))
    best = support.groupBy("event_type").agg(F.max_by("value", F.struct("support", -F.col("event_id"))).alias("centre"))
    kept = support.join(best, "event_type").where(F.abs(F.col("value") - F.col("centre")) <= 5)
    return kept.groupBy("event_type", F.round("centre", 6).alias("centre")).agg(F.count("*").alias("kept"), F.round(F.median("value"), 6).alias("median"))


NEAR_PAIRS = "p AS (SELECT x.user_id, x.event_id AS l, y.event_id AS r, -abs(x.value - y.value) AS score FROM events x JOIN events y ON x.event_type = 'view' AND y.event_type = 'click' AND x.user_id = y.user_id AND abs(x.value - y.value) <= 3)"


def near_pairs(t: Tables) -> DataFrame:
    side = lambda k, i, v: t.events.where(f"event_type = '{k}'").select("user_id", F.col("event_id").alias(i), F.col("value").alias(v))
    return joins.within(side("view", "l", "x"), side("click", "r", "y"), ["user_id"], "x", "y", 3).select("l", "r", (-F.abs(F.col("x") - F.col("y"))).alias("score"))


@query("j24_mutual_best", f"""
WITH {NEAR_PAIRS}, q AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS b FROM p) SELECT l, r, round(score, 6) AS score FROM q WHERE a = 1 AND b = 1""")
def j24(t: Tables) -> DataFrame:
    return joins.mutual_best(near_pairs(t), "l", "r", "score").select("l", "r", F.round("score", 6).alias("score"))


@query("j24_boundary_pairs", f"""
WITH RECURSIVE {NEAR_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, l, r) AS i FROM p),
g AS (SELECT user_id, i, l, r, score, true AS chosen, [l] AS ls, [r] AS rs FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.l, o.r, o.score, NOT list_contains(g.ls, o.l) AND NOT list_contains(g.rs, o.r),
    CASE WHEN list_contains(g.ls, o.l) OR list_contains(g.rs, o.r) THEN g.ls ELSE list_append(g.ls, o.l) END,
    CASE WHEN list_contains(g.ls, o.l) OR list_contains(g.rs, o.r) THEN g.rs ELSE list_append(g.rs, o.r) END FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1)
SELECT l, r, round(score, 6) AS score FROM g WHERE chosen""")
def j24_boundary_pairs(t: Tables) -> DataFrame:
    from orrery.operators.selection import matched

    return matched(near_pairs(t), "l", "r", "score").select("l", "r", F.round("score", 6).alias("score"))


@query("j25_event_hypotheses", f"""WITH {TRACKS}, h AS (SELECT x.user_id, x.a, x.m, y.user_id AS cand, (least(x.b, y.b) - greatest(x.a, y.a)) / nullif(x.b - x.a, 0)::DOUBLE AS share, exp(-abs(x.m - y.m) / 25) AS score FROM tr x JOIN tr y ON x.event_type = 'view' AND y.event_type = 'error' AND x.a <= y.b AND y.a <= x.b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a ORDER BY score DESC, cand) AS p FROM h WHERE share >= 0.25) SELECT user_id, a, cand, round(score, 6) AS score FROM r WHERE p = 1""")
def j25(t: Tables) -> DataFrame:
    return event_hypotheses(t)


def event_hypotheses(t: Tables) -> DataFrame:
    tr = tracks_in_order(t).withColumn("all", F.lit(1))
    x = tr.where("event_type = 'view'").select("all", "user_id", "a", "b", "m")
    y = tr.where("event_type = 'error'").select("all", F.col("user_id").alias("cand"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("m").alias("cm"))
    met = joins.overlapping(x, y, ["all"], ("a", "b"), ("c", "d"), 43_200)
    share = (F.least("b", "d") - F.greatest("a", "c")) / F.nullif(F.col("b") - F.col("a"), F.lit(0))
    scored = met.where(share >= 0.25).withColumn("score", fn.exponential_score(F.col("m") - F.col("cm"), 25.0))
    best = ordered.newest(scored, ["user_id", "a"], [F.desc("score"), "cand"])
    return best.select("user_id", "a", "cand", F.round("score", 6).alias("score"))


@query("j28_continuations", """
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) // 1000000 AS s FROM events), c AS (SELECT y.event_id AS seg, x.event_id AS pred, abs(x.value - y.value) AS d FROM e x JOIN e y ON x.user_id = y.user_id AND y.s > x.s AND y.s - x.s <= 7200 AND abs(x.value - y.value) <= 30),
r AS (SELECT *, lead(d) OVER w AS second, row_number() OVER w AS p FROM c WINDOW w AS (PARTITION BY seg ORDER BY d, pred)) SELECT seg, pred, round(d, 6) AS d FROM r WHERE p = 1 AND coalesce(second - d >= 2, true)""")
def j28(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "value", whole_seconds(F.col("ts")).alias("s"))
    seg = e.select(F.col("event_id").alias("seg"), "user_id", F.col("value").alias("sv"), F.col("s").alias("ss"))
    pred = e.select(F.col("event_id").alias("pred"), "user_id", F.col("value").alias("pv"), F.col("s").alias("ps"))
    c = joins.within(seg, pred, ["user_id"], "ss", "ps", 7200).where((F.col("ss") > F.col("ps")) & (F.abs(F.col("sv") - F.col("pv")) <= 30)).withColumn("d", F.abs(F.col("sv") - F.col("pv")))
    gated = ordered.margin_gate(c, ["seg"], "d", "pred", 2, float("inf")).where("passed")
    return gated.select("seg", "pred", F.round("d", 6).alias("d"))


@query("j30_coverage_check", f"""WITH {PASSES}, i AS (SELECT event_id, user_id AS k, epoch_us(ts - INTERVAL 10000 DAY) // 86400000000 AS d FROM events)
SELECT event_id FROM i WHERE NOT EXISTS (SELECT 1 FROM passes WHERE o_custkey = k AND d BETWEEN a AND b)""")
def j30(t: Tables) -> DataFrame:
    i = t.events.select("event_id", F.col("user_id").alias("o_custkey"), day_number(F.col("ts") - F.expr("interval 10000 days")).alias("d"))
    return joins.contained(i, passes(t), ["o_custkey"], "d", "a", "b", 32, "left_anti").select("event_id")


@query("j31_fingerprint_pairs", """
WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings)
SELECT x.vec_id AS l, y.vec_id AS r, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (x.norm * y.norm), 5) AS cosine FROM n x JOIN n y ON x.label = y.label AND x.vec_id < y.vec_id
WHERE list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (x.norm * y.norm) > 0.9""")
def j31(t: Tables) -> DataFrame:
    from orrery.operators.spectra import cosine_pairs

    return cosine_pairs(t.embeddings, "vec_id", "embedding", 0.9, "label").select("l", "r", F.round("cosine", 5).alias("cosine"))


@query("j32_feature_confirmation", """
WITH g AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS grp FROM events)
SELECT user_id, grp, count(*) AS n, max(value) - min(value) <= 20 AS confirmed FROM g GROUP BY ALL HAVING count(*) = 3""")
def j32(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    g = t.events.withColumn("grp", F.call_function("div", place, F.lit(3)))
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), ((F.max("value") - F.min("value")) <= 20).alias("confirmed")).where("n = 3")


@query("j33_evidence_gate", f"""WITH {PASSES}, i AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_discount, epoch_us(l_shipdate) // 86400000000 AS d FROM lineitem), m AS (SELECT i.*, EXISTS (SELECT 1 FROM passes WHERE o_custkey = k AND d BETWEEN a AND b) AS inside FROM i)
SELECT CASE WHEN NOT inside THEN 'outside' WHEN l_discount < 0.03 THEN 'far' ELSE 'kept' END AS cause, count(*) AS n FROM m GROUP BY 1""")
def j33(t: Tables) -> DataFrame:
    i = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("o_custkey"), "l_discount", day_number(F.col("l_shipdate")).alias("d"))
    side = lambda how: joins.contained(i, passes(t), ["o_custkey"], "d", "a", "b", 32, how)
    marked = side("left_semi").withColumn("inside", F.lit(True)).union(side("left_anti").withColumn("inside", F.lit(False)))
    cause = F.when(~F.col("inside"), "outside").when(F.col("l_discount") < 0.03, "far").otherwise("kept")
    return marked.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("j34_tuning_plan", """
SELECT l_orderkey, count(*) AS planned, count(o_orderkey) AS known, count(o_orderkey) = count(*) AS usable FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1""")
def j34(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderstatus != 'P'").select("o_orderkey")
    joined = t.lineitem.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("planned"), F.count("o_orderkey").alias("known"), (F.count("o_orderkey") == F.count("*")).alias("usable"))


@query("j35_nearest_key", """
WITH k AS (SELECT n_nationkey, n_nationkey * 20 + 10 AS published FROM nation), r AS (SELECT event_id, n_nationkey, abs(value - published) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - published), n_nationkey) AS p FROM events, k)
SELECT event_id, CASE WHEN d <= 5 THEN n_nationkey END AS tuning, CASE WHEN d > 5 THEN 'too far' END AS reason FROM r WHERE p = 1""")
def j35(t: Tables) -> DataFrame:
    keys = t.nation.select("n_nationkey", (F.col("n_nationkey") * 20 + 10).alias("published"))
    table = keys.agg(F.collect_list(F.struct("n_nationkey", "published")).alias("keys"))
    near = F.array_min(F.transform("keys", lambda k: F.struct(F.abs(F.col("value") - k["published"]).alias("d"), k["n_nationkey"].alias("n"))))
    best = t.events.join(F.broadcast(table)).withColumn("b", near)  # one row of the dimension's 25 keys
    return best.select("event_id", F.when(F.col("b.d") <= 5, F.col("b.n")).alias("tuning"), F.when(F.col("b.d") > 5, "too far").alias("reason"))


@query("j36_position_to_time", """
WITH c AS (SELECT user_id, event_id AS pos, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'click')), n AS (SELECT *, lead(pos) OVER w AS npos, lead(us) OVER w AS nus FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
q AS (SELECT user_id, event_id AS at_ FROM events WHERE event_type = 'error')
SELECT q.user_id, at_, round((us + (nus - us) * (at_ - pos) / (npos - pos)::DOUBLE) / 1e6, 3) AS s FROM q JOIN n ON q.user_id = n.user_id AND at_ > pos AND at_ < npos""")
def j36(t: Tables) -> DataFrame:
    us = fn.micros(F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("pos")
    clock = t.events.where("event_type in ('view', 'click')").select("user_id", F.col("event_id").alias("pos"), us.alias("us")).withColumns({"npos": F.lead("pos").over(w), "nus": F.lead("us").over(w)})
    q = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("at_"))
    found = joins.as_of(q, clock, ["user_id"], "at_", "pos", ["us", "npos", "nus"]).where("npos is not null")
    s = F.col("us") + (F.col("nus") - F.col("us")) * (F.col("at_") - F.col("pos")) / (F.col("npos") - F.col("pos"))
    return found.select("user_id", "at_", F.round(s / 1e6, 3).alias("s"))
