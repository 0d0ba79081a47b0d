"""E, G: estimators, fits, resampling and graphs. Chains A and B are the parity of user_id; a cell is an hour and tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as fn
from orrery.operators import currency, estimators, stats
from orrery.plans.join_queries import SWEEPS, sides
from orrery.plans.registry import Tables, query

P = 0.1


@query("e01_line_fit", """
SELECT l_suppkey, n, round(slope, 6) AS slope, round(intercept, 5) AS intercept, round(sqrt(greatest(0, vy - slope * slope * vx)), 5) AS rms FROM (
  SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, var_pop(l_extendedprice) AS vy, var_pop(l_quantity) AS vx FROM lineitem GROUP BY 1) WHERE n >= 3 AND vx > 0""")
def e01(t: Tables) -> DataFrame:
    f = estimators.line_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice")
    return f.select("l_suppkey", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("rms", 5).alias("rms"))


@query("e02_quadratic_fit", """
WITH s AS (SELECT l_suppkey, count(*) AS n, sum(1.0::DOUBLE) AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM (SELECT l_suppkey, l_quantity / 50 AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS w FROM s)
SELECT l_suppkey, n, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / w, 4) AS c0, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / w, 4) AS c1, round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / w, 4) AS c2 FROM d WHERE n >= 4 AND abs(w) > 0""")
def e02(t: Tables) -> DataFrame:
    xy = t.lineitem.select("l_suppkey", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return estimators.quadratic_fit(xy, ["l_suppkey"], "x", "y").select("l_suppkey", "n", *(F.round(c, 4).alias(c) for c in ("c0", "c1", "c2")))


@query("e02_robust_quadratic_fit")
def e02_robust(t: Tables) -> DataFrame:
    xy = t.lineitem.select("l_suppkey", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return estimators.robust_quadratic(xy, ["l_suppkey"], "x", "y", 10.0).select("l_suppkey", "n", *(F.round(c, 3).alias(c) for c in ("c0", "c1", "c2")))


@query("e03_weighted_nuisance", """
WITH g AS (SELECT l_suppkey, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM (SELECT l_suppkey, 1 + l_discount AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1)
SELECT l_suppkey, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 5) AS drift, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 4) AS "offset" FROM g WHERE sw * sxx - sx * sx > 1e-9""")
def e03(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("w", 1 + F.col("l_discount"))
    return estimators.weighted_line(df, ["l_suppkey"], "l_quantity", "l_extendedprice", "w").select("l_suppkey", F.round("drift", 5).alias("drift"), F.round("offset", 4).alias("offset"))


@query("e04_shift_search", """
WITH o AS (SELECT user_id, event_id % 40 AS k, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT user_id, event_id % 40 AS k, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
s AS (SELECT o.user_id, d, sqrt(avg((o.v - p.v) * (o.v - p.v))) AS rms, count(*) AS n FROM o, (SELECT unnest([-2, -1, 0, 1, 2]) AS d), p WHERE p.user_id = o.user_id AND p.k = o.k + d GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, d, round(rms, 6) AS rms, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(rms, 6), d) AS r FROM s) WHERE r = 1""")
def e04(t: Tables) -> DataFrame:
    side = lambda kind, v: t.events.where(f"event_type = '{kind}'").groupBy("user_id", (F.col("event_id") % 40).alias("k")).agg(F.avg("value").alias(v))
    shifted = side("view", "o").withColumn("d", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1, 2))))).withColumn("k", F.col("k") + F.col("d"))
    fit = shifted.join(side("click", "p"), ["user_id", "k"]).groupBy("user_id", "d").agg(F.round(F.sqrt(F.avg((F.col("o") - F.col("p")) * (F.col("o") - F.col("p")))), 6).alias("rms"), F.count("*").alias("n")).where("n >= 2")
    best = F.row_number().over(Window.partitionBy("user_id").orderBy("rms", "d"))
    return fit.withColumn("r", best).where("r = 1").drop("r")


@query("e05_eligibility_reasons", """
SELECT reason, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN count(*) < 3 THEN 'points' WHEN datediff('day', min(l_shipdate), max(l_shipdate)) < 30 THEN 'duration' WHEN count(DISTINCT l_suppkey) < 2 THEN 'receivers' WHEN max(l_discount) < 0.05 THEN 'no candidate' ELSE 'eligible' END AS reason FROM lineitem GROUP BY 1) GROUP BY 1""")
def e05(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("days"), F.count_distinct("l_suppkey").alias("rx"), F.max("l_discount").alias("d"))
    reason = currency.first_reason(points=F.col("n") < 3, duration=F.col("days") < 30, receivers=F.col("rx") < 2, **{"no candidate": F.col("d") < 0.05})
    return g.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("e06_stability_verdict", """
WITH b AS (SELECT l_suppkey, l_linenumber, arg_max(l_returnflag, struct_pack(p := l_extendedprice, k := l_orderkey)) AS best, max(l_extendedprice) > 90000 AS passed FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(DISTINCT best) = 1 AS same, bool_and(passed) AS passed FROM b GROUP BY 1""")
def e06(t: Tables) -> DataFrame:
    b = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.max_by("l_returnflag", F.struct("l_extendedprice", "l_orderkey")).alias("best"), (F.max("l_extendedprice") > 90000).alias("passed"))
    return b.groupBy("l_suppkey").agg((F.count_distinct("best") == 1).alias("same"), F.bool_and("passed").alias("passed"))


CELLS = f"""{SWEEPS}, c AS (SELECT x.sweep, x.event_type, x.v > 60 AS a, y.v > 60 AS b FROM s x JOIN s y ON x.sweep = y.sweep AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1)"""
MODEL = """CASE WHEN a - 0.1 <= 0 OR b - 0.1 <= 0 THEN 'no excess' WHEN ab - a * 0.1 - b * 0.1 + 0.01 <= 0 THEN 'anticoincident' WHEN (a - 0.1) * (b - 0.1) / (ab - a * 0.1 - b * 0.1 + 0.01) > 1 + 1e-9 THEN 'occupancy above one'
  WHEN 0.1 + (ab - a * 0.1 - b * 0.1 + 0.01) / (b - 0.1) > 1 + 1e-9 OR 0.1 + (ab - a * 0.1 - b * 0.1 + 0.01) / (a - 0.1) > 1 + 1e-9 THEN 'rate above one' END AS reason, (a - 0.1) * (b - 0.1) / (ab - a * 0.1 - b * 0.1 + 0.01) AS f0"""
RATES = "avg(CASE WHEN a THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN b THEN 1.0::DOUBLE ELSE 0 END) AS b, avg(CASE WHEN a AND b THEN 1.0::DOUBLE ELSE 0 END) AS ab"


def cells(t: Tables) -> DataFrame:
    a, b = sides(t)
    return a.join(b, ["sweep", "event_type"]).select("sweep", "event_type", (F.col("a") > 60).alias("a"), (F.col("b") > 60).alias("b"))


def rate(c: Column) -> Column:
    return F.avg(c.cast("double"))


def rates(g) -> DataFrame:
    return g.agg(F.count("*").alias("n"), rate(F.col("a")).alias("ra"), rate(F.col("b")).alias("rb"), rate(F.col("a") & F.col("b")).alias("rab"))


def solved(df: DataFrame, *keep: str) -> DataFrame:
    m = estimators.coincidence(F.col("ra"), F.col("rb"), F.col("rab"), P)
    return df.select(*keep, F.round(m["f"], 6).alias("f"), m["reason"].alias("reason"))


@query("e07_coincidence_model", f"""WITH {CELLS}, r AS (SELECT event_type, sweep // 24 AS day, {RATES} FROM c GROUP BY ALL), m AS (SELECT *, {MODEL} FROM r) SELECT event_type, day, CASE WHEN reason IS NULL THEN round(f0, 6) END AS f, reason FROM m""")
def e07(t: Tables) -> DataFrame:
    return solved(rates(cells(t).groupBy("event_type", F.call_function("div", F.col("sweep"), F.lit(24)).alias("day"))), "event_type", "day")


@query("e08_cell_rates", f"""WITH {CELLS}, r AS (SELECT event_type, sweep % 24 AS hour, count(*) AS n, {RATES} FROM c GROUP BY GROUPING SETS ((event_type), (event_type, hour), ())), m AS (SELECT *, {MODEL} FROM r) SELECT event_type, hour, n, CASE WHEN reason IS NULL THEN round(f0, 6) END AS f, reason FROM m""")
def e08(t: Tables) -> DataFrame:
    c = cells(t).withColumn("hour", F.col("sweep") % 24)
    e, h = F.col("event_type"), F.col("hour")
    return solved(rates(c.groupingSets([[e], [e, h], []], e, h)), "event_type", "hour", "n")


@query("e09_joint_bootstrap")
def e09(t: Tables) -> DataFrame:
    drawn = estimators.bootstrap_rates(cells(t), ["event_type"], "sweep", "a", "b", 200, 7)
    m = estimators.coincidence(F.col("a"), F.col("b"), F.col("both"), P)
    spread = drawn.select("draw", m["f"].alias("f")).groupBy("draw").agg((F.max("f") / F.min("f")).alias("ratio"), F.count("f").alias("solved"))
    return spread.agg(F.count("*").alias("draws"), F.sum("solved").alias("solved"), F.round(F.percentile("ratio", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("ratio", F.lit(0.975)), 6).alias("high"))


@query("e10_spread", f"""WITH {CELLS}, r AS (SELECT event_type, {RATES} FROM c GROUP BY 1), m AS (SELECT *, {MODEL} FROM r), g AS (SELECT CASE WHEN reason IS NULL THEN f0 END AS f, reason FROM m)
SELECT round(min(f), 6) AS least, round(max(f), 6) AS most, round(max(f) / min(f), 6) AS ratio, count(reason) AS unsolvable FROM g""")
def e10(t: Tables) -> DataFrame:
    m = estimators.coincidence(F.col("ra"), F.col("rb"), F.col("rab"), P)
    g = rates(cells(t).groupBy("event_type")).select(m["f"].alias("f"), m["reason"].alias("reason"))
    return g.agg(F.round(F.min("f"), 6).alias("least"), F.round(F.max("f"), 6).alias("most"), F.round(F.max("f") / F.min("f"), 6).alias("ratio"), F.count("reason").alias("unsolvable"))


@query("e11_negative_controls", f"""WITH {SWEEPS}, c AS (SELECT 'observed' AS kind, x.v > 60 AS a, y.v > 60 AS b FROM s x JOIN s y ON x.sweep = y.sweep AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1
  UNION ALL SELECT 'shifted', x.v > 60, y.v > 60 FROM s x JOIN s y ON y.sweep = x.sweep + 2 AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1), r AS (SELECT kind, count(*) AS n, {RATES} FROM c GROUP BY 1)
SELECT kind, n, round(a, 9) AS a, round(b, 9) AS b, round(ab, 9) AS ab, round(ab - a * b, 9) AS excess FROM r""")
def e11(t: Tables) -> DataFrame:
    a, b = sides(t)
    fired = lambda kind, df: df.select(F.lit(kind).alias("kind"), (F.col("a") > 60).alias("a"), (F.col("b") > 60).alias("b"))
    both = fired("observed", a.join(b, ["sweep", "event_type"])).union(fired("shifted", a.join(b.withColumn("sweep", F.col("sweep") - 2), ["sweep", "event_type"])))
    r = rates(both.groupBy("kind"))
    return r.select("kind", "n", F.round("ra", 9).alias("a"), F.round("rb", 9).alias("b"), F.round("rab", 9).alias("ab"), F.round(F.col("rab") - F.col("ra") * F.col("rb"), 9).alias("excess"))


@query("e12_axis_movement", """
WITH l AS (SELECT 'flag' AS axis, l_returnflag AS level, l_linestatus AS m, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), l_linestatus, l_extendedprice FROM lineitem UNION ALL SELECT 'tax', CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR), l_linestatus, l_extendedprice FROM lineitem),
g AS (SELECT axis, level, m, median(v) AS f FROM l GROUP BY ALL HAVING count(*) >= 30) SELECT axis, m, count(*) AS levels, round(max(f) - min(f), 4) AS gap, arg_min(level, struct_pack(f := f, l := level)) AS lowest FROM g GROUP BY ALL""")
def e12(t: Tables) -> DataFrame:
    axes = {"flag": F.col("l_returnflag"), "line": F.col("l_linenumber").cast("string"), "tax": F.rint(F.col("l_tax") * 100).cast("int").cast("string")}
    long = t.lineitem.select(F.col("l_linestatus").alias("m"), F.col("l_extendedprice").alias("v"), F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), c.alias("level")) for n, c in axes.items()))).alias("x")).select("m", "v", "x.*")
    g = long.groupBy("axis", "level", "m").agg(F.count("*").alias("n"), F.median("v").alias("f")).where("n >= 30")
    return g.groupBy("axis", "m").agg(F.count("*").alias("levels"), F.round(F.max("f") - F.min("f"), 4).alias("gap"), F.min_by("level", F.struct("f", "level")).alias("lowest"))


@query("e13_leave_one_out", """
WITH d AS (SELECT user_id, event_type, CASE WHEN max(value) > 150 THEN 1 ELSE 0 END AS f FROM events GROUP BY ALL), t AS (SELECT *, sum(f) OVER (PARTITION BY user_id) - f AS others FROM d)
SELECT event_type, CAST(sum(f) FILTER (others > 0) AS BIGINT) AS hits, count(*) FILTER (others > 0) AS confirmed, CAST(sum(f) FILTER (others = 0) AS BIGINT) AS lone, count(*) FILTER (others = 0) AS unconfirmed FROM t GROUP BY 1""")
def e13(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id", "event_type").agg((F.max("value") > 150).cast("int").alias("f"))
    o = d.withColumn("others", F.sum("f").over(Window.partitionBy("user_id")) - F.col("f"))
    yes, no = F.col("others") > 0, F.col("others") == 0
    return o.groupBy("event_type").agg(F.sum(F.when(yes, F.col("f"))).alias("hits"), F.count_if(yes).alias("confirmed"), F.sum(F.when(no, F.col("f"))).alias("lone"), F.count_if(no).alias("unconfirmed"))


@query("e14_guard_band_curve", """
WITH b AS (SELECT unnest(range(0, 20)) AS bin), k AS (SELECT DISTINCT event_type FROM events), e AS (SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n, avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END) AS r FROM events GROUP BY ALL)
SELECT k.event_type, b.bin, coalesce(n, 0) AS n, round(r, 9) AS rate FROM k CROSS JOIN b LEFT JOIN e ON e.event_type = k.event_type AND e.bin = b.bin""")
def e14(t: Tables) -> DataFrame:
    grid = t.events.select("event_type").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    e = t.events.groupBy("event_type", F.floor(F.col("value") / 25).alias("bin")).agg(F.count("*").alias("n"), F.round(rate(F.col("user_id") % 2 == 0), 9).alias("rate"))
    return grid.join(e, ["event_type", "bin"], "left").select("event_type", "bin", F.coalesce("n", F.lit(0)).alias("n"), "rate")


@query("e15_instant_verdict", f"""WITH {CELLS}, v AS (SELECT sweep, bool_or(a AND b) AS hit, count(*) AS n FROM c GROUP BY 1) SELECT hit, count(*) AS instants, CAST(sum(n) AS BIGINT) AS cells FROM v GROUP BY 1""")
def e15(t: Tables) -> DataFrame:
    v = cells(t).groupBy("sweep").agg(F.bool_or(F.col("a") & F.col("b")).alias("hit"), F.count("*").alias("n"))
    return v.groupBy("hit").agg(F.count("*").alias("instants"), F.sum("n").alias("cells"))


@query("e16_cluster_bootstrap")
def e16(t: Tables) -> DataFrame:
    captures = t.lineitem.groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("v"))
    medians = estimators.bootstrap_medians(captures, "l_orderkey", "v", 50, 3)
    return medians.agg(F.count("*").alias("draws"), F.round(F.percentile("v", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 4).alias("high"))


@query("e17_stratum_bootstrap")
def e17(t: Tables) -> DataFrame:
    per = stats.stratified_difference(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], F.col("l_discount") >= 0.05, "l_extendedprice", 5)
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn("w", estimators.poisson_weight(4, "draw", "l_returnflag", "l_linestatus", "l_linenumber")).where("w > 0")
    medians = estimators.weighted_median(drawn, ["draw"], "difference", "w")
    return medians.agg(F.count("*").alias("draws"), F.round(F.percentile("difference", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("difference", F.lit(0.975)), 4).alias("high"))


@query("e18_empirical_false_alarm", """
WITH n AS (SELECT l_linestatus, l_extendedprice AS s FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT l_linestatus, l_extendedprice AS s FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1), u AS (SELECT *, 1 AS o FROM o UNION ALL SELECT *, 0 FROM n),
r AS (SELECT *, sum(1 - o) OVER (PARTITION BY l_linestatus ORDER BY s DESC) AS above, sum(1 - o) OVER (PARTITION BY l_linestatus) AS n FROM u) SELECT l_linestatus, s AS l_extendedprice, round((1 + above) / (n + 1), 9) AS p FROM r WHERE o = 1""")
def e18(t: Tables) -> DataFrame:
    p = stats.smoothed_exceedance(t.lineitem.where("l_returnflag = 'R' and l_linenumber = 1"), t.lineitem.where("l_returnflag = 'N'"), ["l_linestatus"], "l_extendedprice")
    return p.select("l_linestatus", "l_extendedprice", F.round("p", 9).alias("p"))


@query("e19_extreme_value_threshold", """
SELECT l_suppkey, n, round(-ln(1 - pow(1 - 0.01, 1.0 / n)), 6) AS threshold FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def e19(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return g.select("l_suppkey", "n", F.round(estimators.extreme_value_threshold(F.col("n"), 0.01), 6).alias("threshold"))


@query("e20_tolerance_budget", """
SELECT p_partkey, round(sqrt(pow(p_size * 0.5, 2) + pow(p_retailprice * 0.01, 2) + 25) + 3, 6) AS tolerance FROM part""")
def e20(t: Tables) -> DataFrame:
    rate_term, age_term = F.col("p_size") * 0.5, F.col("p_retailprice") * 0.01
    return t.part.select("p_partkey", F.round(F.sqrt(rate_term * rate_term + age_term * age_term + 25) + 3, 6).alias("tolerance"))


@query("e21_consensus_support", """
WITH s AS (SELECT x.l_orderkey, x.l_linenumber, x.l_extendedprice AS v, count(*) AS support FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND abs(x.l_extendedprice - y.l_extendedprice) <= 9000 GROUP BY ALL),
b AS (SELECT l_orderkey, arg_max(v, struct_pack(s := support, k := -v)) AS centre, max(support) AS support FROM s GROUP BY 1 HAVING max(support) >= 3) SELECT l_orderkey, centre, support FROM b""")
def e21(t: Tables) -> DataFrame:
    from orrery.operators.joins import within

    x = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    near = within(x, x.select("l_orderkey", F.col("v").alias("y")), ["l_orderkey"], "v", "y", 9000)
    support = near.groupBy("l_orderkey", "l_linenumber", "v").agg(F.count("*").alias("support"))
    best = support.groupBy("l_orderkey").agg(F.max_by("v", F.struct("support", -F.col("v"))).alias("centre"), F.max("support").alias("support"))
    return best.where("support >= 3")


@query("e22_weighted_median", """
WITH c AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), u AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_suppkey) / 2 AS half FROM c)
SELECT l_suppkey, min(v) AS l_extendedprice FROM u WHERE upto >= half GROUP BY 1""")
def e22(t: Tables) -> DataFrame:
    return estimators.weighted_median(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("e23_qualification_reasons", """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'short' END, CASE WHEN p_retailprice < 1000 THEN 'weak' END, CASE WHEN p_brand = 'Brand#11' THEN 'broadband' END], lambda x: x IS NOT NULL), '+') AS reasons, p_size >= 10 AND p_retailprice >= 1000 AND p_brand <> 'Brand#11' AS qualified FROM part""")
def e23(t: Tables) -> DataFrame:
    reasons = currency.all_reasons(short=F.col("p_size") < 10, weak=F.col("p_retailprice") < 1000, broadband=F.col("p_brand") == "Brand#11")
    return t.part.withColumn("r", reasons).select("p_partkey", F.array_join("r", "+").alias("reasons"), (F.size("r") == 0).alias("qualified"))


@query("e24_spacing_gates", """
SELECT user_id, round(t, 6) AS true_score, round(w, 6) AS wrong_score, t - w >= 5 AND n >= 5 AS qualified FROM (SELECT user_id, max(value) FILTER (event_type = 'view') AS t, least(max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'error')) AS w, count(*) AS n FROM events GROUP BY 1) WHERE t IS NOT NULL AND w IS NOT NULL""")
def e24(t: Tables) -> DataFrame:
    on = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    g = t.events.groupBy("user_id").agg(on("view").alias("t"), on("click").alias("c"), on("error").alias("e"), F.count("*").alias("n")).withColumn("w", F.least("c", "e")).where("t is not null and w is not null")
    return g.select("user_id", F.round("t", 6).alias("true_score"), F.round("w", 6).alias("wrong_score"), ((F.col("t") - F.col("w") >= 5) & (F.col("n") >= 5)).alias("qualified"))


@query("e25_relative_calibration", f"""WITH {SWEEPS}, p AS (SELECT x.event_type, x.sweep::DOUBLE AS x, y.v - x.v AS d FROM s x JOIN s y ON x.sweep = y.sweep AND x.event_type = y.event_type AND x.radio = 0 AND y.radio = 1)
SELECT event_type, count(*) AS n, round(regr_slope(d, x), 7) AS slope, round(avg(d), 6) AS mean FROM p GROUP BY 1 HAVING count(*) >= 3""")
def e25(t: Tables) -> DataFrame:
    a, b = sides(t)
    p = a.join(b, ["sweep", "event_type"]).select("event_type", F.col("sweep").cast("double").alias("x"), (F.col("b") - F.col("a")).alias("d"))
    return p.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.regr_slope("d", "x"), 7).alias("slope"), F.round(F.avg("d"), 6).alias("mean")).where("n >= 3")


@query("e26_consensus_value", """
SELECT l_orderkey, round(sum(l_extendedprice / (1 + l_discount)) / sum(1 / (1 + l_discount)), 6) AS consensus, round(sqrt(1 / sum(1 / (1 + l_discount)) + 0.25), 6) AS sigma FROM lineitem GROUP BY 1""")
def e26(t: Tables) -> DataFrame:
    w = 1 / (1 + F.col("l_discount"))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") / (1 + F.col("l_discount"))) / F.sum(w), 6).alias("consensus"), F.round(F.hypot(F.sqrt(1 / F.sum(w)), F.lit(0.5)), 6).alias("sigma"))


@query("e27_prediction_verdict", """
WITH f AS (SELECT l_suppkey, sqrt(var_pop(l_extendedprice - l_quantity * 1500)) AS fit, sqrt(var_pop(l_extendedprice - (51 - l_quantity) * 1500)) AS control, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(fit, 4) AS fit, round(control, 4) AS control, fit < 0.5 * control AND n >= 20 AS matched FROM f""")
def e27(t: Tables) -> DataFrame:
    rms = lambda prediction: F.sqrt(F.var_pop(F.col("l_extendedprice") - prediction * 1500))
    f = t.lineitem.groupBy("l_suppkey").agg(rms(F.col("l_quantity")).alias("fit"), rms(51 - F.col("l_quantity")).alias("control"), F.count("*").alias("n"))
    return f.select("l_suppkey", F.round("fit", 4).alias("fit"), F.round("control", 4).alias("control"), ((F.col("fit") < 0.5 * F.col("control")) & (F.col("n") >= 20)).alias("matched"))
